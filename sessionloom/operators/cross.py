"""Cross-sectional operators: universes, breadth, cohorts, factors, baskets, ledgers, setups and validation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.functions import series as S
from sessionloom.functions import stats
from sessionloom.sources.bars import PRICE_SCALE

# ---------------------------------------------------------------- universe and calendar


def scan_universe(members: DataFrame, on_disk: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Symbols named by any list, that have bars and are no synthetic index."""
    return members.select("symbol").distinct().join(on_disk.select("symbol"), "symbol", "left_semi").join(synthetic.select("symbol"), "symbol", "left_anti")


def orphans(on_disk: DataFrame, known: DataFrame) -> DataFrame:
    """Symbols with bars that no list knows."""
    return on_disk.select("symbol").distinct().join(known.select("symbol"), "symbol", "left_anti")


def modal_last_date(bars: DataFrame) -> DataFrame:
    """The last date that most symbols share; of ties the later."""
    return bars.groupBy("symbol").agg(F.max("date").alias("last")).groupBy("last").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("last")).limit(1)


def market_calendar(bars: DataFrame) -> DataFrame:
    """The sessions of the longest series that ends on the modal last date (of ties the first name)."""
    ends = bars.groupBy("symbol").agg(F.max("date").alias("last"), F.count("*").alias("n"))
    best = ends.join(F.broadcast(modal_last_date(bars).select("last")), "last").orderBy(F.desc("n"), "symbol").limit(1)
    return bars.join(F.broadcast(best.select("symbol")), "symbol").select("date")


# ---------------------------------------------------------------- breadth and risk


def breadth(bars: DataFrame, calendar: DataFrame, least: int = 30) -> DataFrame:
    """By session: per cent of symbols above their 20-, 50- and 200-session averages (of those that have one), new yearly highs and lows, and symbols counted."""
    w = W.partitionBy("symbol")
    x = bars.withColumn("total", F.count("*").over(w)).where(F.col("total") >= least)
    price = S.to_price_col("close")
    x = x.select("date", price.alias("p"), *(S.rolling_mean("close", n).alias(f"ma{n}") for n in (20, 50, 200)), (F.col("close") >= S.rolling(F.max, "close", 252)).alias("high"), (F.col("close") <= S.rolling(F.min, "close", 252)).alias("low"))
    g = x.groupBy("date").agg(*((F.avg(F.when(F.col(f"ma{n}").isNotNull(), (F.col("p") > F.col(f"ma{n}")).cast("double"))) * 100).alias(f"pct_above_{n}") for n in (20, 50, 200)), F.coalesce(F.sum(F.col("high").cast("long")), F.lit(0)).alias("new_highs"), F.coalesce(F.sum(F.col("low").cast("long")), F.lit(0)).alias("new_lows"), F.count("*").alias("n"))
    return calendar.select("date").distinct().join(g, "date", "left").withColumn("net_highs", F.col("new_highs") - F.col("new_lows"))


def index_panel(bars: DataFrame, least: int = 260) -> DataFrame:
    """The last session of each long enough symbol: returns of a week, month, quarter and year to date, and distances in per cent."""
    from sessionloom.operators.analytics import horizon_returns, leader_rows

    long = bars.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("symbol")
    h = horizon_returns(bars.join(long, "symbol", "left_semi"), (5, 21, 63))
    top = bars.withColumn("rn", F.row_number().over(S.latest_first())).where("rn <= 252").groupBy("symbol").agg(F.max("close").alias("top"), F.max_by("close", "date").alias("last"))
    return h.join(top.select("symbol", ((F.col("last") / F.col("top").cast("double") - 1) * 100).alias("off_high")), "symbol").join(leader_rows(bars).select("symbol", "ma50", "ma200"), "symbol")


def ratio_series(bars: DataFrame, numerator: str, denominator: str, sessions: int = 126, least: int = 70) -> DataFrame:
    """date, ratio, r1m, r3m of two symbols on their common sessions, and the last sessions rebased to 100; no rows if too short."""
    a = bars.where(F.col("symbol") == numerator).select("date", F.col("close").alias("a"))
    b = bars.where(F.col("symbol") == denominator).select("date", F.col("close").alias("b"))
    x = a.join(b, "date").select(F.lit(f"{numerator}/{denominator}").alias("symbol"), "date", (F.col("a") / F.col("b").cast("double")).alias("ratio"))
    w, back = S.by_symbol(), S.latest_first()
    x = x.withColumn("r1m", F.col("ratio") / F.lag("ratio", 21).over(w) - 1).withColumn("r3m", F.col("ratio") / F.lag("ratio", 63).over(w) - 1).withColumn("rn", F.row_number().over(back)).withColumn("n", F.count("*").over(W.partitionBy("symbol")))
    base = F.max(F.when(F.col("rn") == F.least(F.lit(sessions), F.col("n")), F.col("ratio"))).over(W.partitionBy("symbol"))
    return x.withColumn("spark_line", F.when(F.col("rn") <= sessions, F.col("ratio") / base * 100)).where(F.col("n") >= least).drop("rn", "n")


def pct_rank(value: str, *keys: str) -> Column:
    """Rank as a share with ties averaged, of the values that are known."""
    w = W.partitionBy(*keys).orderBy(value)
    ties = F.count(value).over(W.partitionBy(*keys, value))
    return F.when(F.col(value).isNotNull(), (F.sum(F.when(F.col(value).isNotNull(), 1).otherwise(0)).over(w.rangeBetween(W.unboundedPreceding, W.currentRow)) - (ties - 1) / 2) / F.count(value).over(W.partitionBy(*keys)))


def equal_weight(returns: DataFrame, mask: str) -> DataFrame:
    """Level of the equal-weight index of the symbols that the mask named a session before: symbols' mean return, 0 when there are none.

    ``returns``: symbol, date, ret and the mask column.
    """
    x = returns.withColumn("held", F.coalesce(F.lag(mask).over(S.by_symbol()), F.lit(False)))
    day = x.groupBy("date").agg(F.coalesce(F.avg(F.when(F.col("held"), F.col("ret"))), F.lit(0.0)).alias("ret"), F.sum(F.col("held").cast("long")).alias("members"))
    return day.withColumn("level", chain_level("ret"))


def chain_level(ret: str, start: float = 100.0, key: str | None = None) -> Column:
    """Compounded level by date, within a key if one is named; one row for each date, so a short series.

    A return below -1, as the spread of two returns can be, turns the sign.
    """
    w = (W.partitionBy(key) if key else W.partitionBy()).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    factor = F.lit(1.0) + F.coalesce(F.col(ret), F.lit(0.0))
    size = F.exp(F.sum(F.when(factor != 0, F.log(F.abs(factor))).otherwise(0.0)).over(w))
    turns = F.sum(F.when(factor < 0, 1).otherwise(0)).over(w)
    return F.when(F.min(F.abs(factor)).over(w) == 0, 0.0).otherwise(F.lit(start) * size * F.when(turns % 2 == 1, -1.0).otherwise(1.0))


def padded(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """symbol, date, close, p, ret on every session of the calendar from a symbol's first bar on.

    ``close`` is null where a symbol has no bar, ``p`` the last known one, and ``ret``
    its change, so a closed market is a return of 0 that counts.
    """
    x = S.on_calendar(bars.select("symbol", "date", "close"), calendar).withColumn("p", S.last_known("close").cast("double"))
    return x.withColumn("ret", F.col("p") / F.lag("p").over(S.by_symbol()) - 1.0)


def _beside(bars: DataFrame, calendar: DataFrame, benchmark: str) -> DataFrame:
    """Padded members with the benchmark's return ``b`` and price ``bp`` of each session."""
    x = padded(bars, calendar)
    b = x.where(F.col("symbol") == benchmark).select("date", F.col("ret").alias("b"), F.col("p").alias("bp"))
    return x.where(F.col("symbol") != benchmark).join(b, "date", "left")


def beta_cohorts(bars: DataFrame, benchmark: str, calendar: DataFrame | None = None, window: int = 126, share: float = 0.2) -> DataFrame:
    """By session: levels of the equal-weight top and bottom fifth by rolling beta, and their ratio; all on one calendar."""
    x = _beside(bars, market_calendar(bars) if calendar is None else calendar, benchmark)
    both = F.when(F.col("ret").isNotNull() & F.col("b").isNotNull(), F.col("b"))
    x = x.withColumn("beta", F.when(F.count(both).over(S.frame(window)) >= window, F.covar_samp("ret", "b").over(S.frame(window)) / F.var_samp("b").over(S.frame(window))))
    x = x.withColumn("rank", pct_rank("beta", "date"))
    x = x.withColumn("top", F.coalesce(F.col("rank") >= 1 - share, F.lit(False))).withColumn("bottom", F.coalesce(F.col("rank") <= share, F.lit(False)))
    hi, lo = equal_weight(x, "top").select("date", F.col("level").alias("high_beta")), equal_weight(x, "bottom").select("date", F.col("level").alias("low_beta"))
    return hi.join(lo, "date").withColumn("ratio", F.col("high_beta") / F.col("low_beta"))


def momentum_cohort(bars: DataFrame, benchmark: str, calendar: DataFrame | None = None, skip: int = 21, back: int = 147, share: float = 0.2) -> DataFrame:
    """By session: members of the top fifth by momentum, their index, it beside the benchmark, and the shares of it and of all above the 50-session average."""
    x = _beside(bars, market_calendar(bars) if calendar is None else calendar, benchmark)
    w = S.by_symbol()
    c = F.col("close").cast("double")
    x = x.withColumn("mom", F.lag(c, skip).over(w) / F.lag(c, back).over(w) - 1.0).withColumn("above", S.to_price_col("close") > S.rolling_mean("close", 50))
    x = x.withColumn("rank", pct_rank("mom", "date")).withColumn("top", F.coalesce(F.col("rank") >= 1 - share, F.lit(False)))
    share_of = lambda c: F.avg(F.when(c & F.col("above").isNotNull(), F.col("above").cast("double"))) * 100
    b = x.groupBy("date").agg(share_of(F.col("top")).alias("leaders_above"), share_of(F.lit(True)).alias("all_above"), F.sum(F.col("top").cast("long")).alias("named"), F.max("bp").alias("bp"))
    return b.join(equal_weight(x, "top").select("date", "level"), "date").withColumn("relative", F.col("level") / (F.col("bp") / PRICE_SCALE)).drop("bp")


# ---------------------------------------------------------------- setups


def volume_masks(bars: DataFrame) -> DataFrame:
    """Volume at a yearly or all-time high, relative volume and traded value of each session."""
    w = S.by_symbol()
    v = F.col("volume").cast("double")
    x = bars.withColumn("v", v).withColumn("prior", F.lag("v").over(w))
    ever = w.rowsBetween(W.unboundedPreceding, 0)
    known = lambda c: F.coalesce(c & (F.col("volume") > 0), F.lit(False))
    return x.select(
        "symbol", "date", "close", "volume", known(F.col("volume") >= S.rolling(F.max, "volume", 252, 60)).alias("year_high"), known(F.when(F.count("volume").over(ever) >= 60, F.col("volume") >= F.max("volume").over(ever))).alias("ever_high"),
        (F.col("v") / F.nullif(S.rolling_median("prior", 51, 20), F.lit(0.0))).alias("rvol"), (S.to_price_col("close") * F.col("v")).alias("dollar"),
    )


def volume_edge(bars: DataFrame, last: int = 5, least_dollar: float = 10e6, least: int = 65, year: int = 252) -> DataFrame:
    """The latest yearly volume high of each symbol within its last sessions, at enough traded value.

    symbol, date, ever_high, ipo_high (all-time high of a series shorter than a
    year), rvol, chg, off_high (of the last close, from the year's highest up to the
    hit), dvol_m and r1w.
    """
    w, whole = S.by_symbol(), W.partitionBy("symbol")
    p = F.col("close").cast("double")
    m = volume_masks(bars).withColumn("rn", F.row_number().over(S.latest_first())).withColumn("n", F.count("*").over(whole))
    m = m.withColumn("chg", p / F.lag(p).over(w) - 1.0).withColumn("hi52", F.max(p).over(S.frame(year)))
    at = lambda k: F.max(F.when(F.col("rn") == k, p)).over(whole)
    m = m.withColumn("last", at(1)).withColumn("week", at(6))
    hit = m.where((F.col("n") >= least) & (F.col("rn") <= last) & F.col("year_high") & (F.col("dollar") >= least_dollar))
    hit = hit.withColumn("k", F.row_number().over(S.latest_first())).where("k = 1")
    return hit.select("symbol", "date", "ever_high", (F.col("ever_high") & (F.col("n") < year)).alias("ipo_high"), "rvol", "chg", (F.col("last") / F.col("hi52") - 1.0).alias("off_high"), (F.col("dollar") / 1e6).alias("dvol_m"), F.when(F.col("n") > 6, F.col("last") / F.col("week") - 1.0).alias("r1w"))


def tight_flags(bars: DataFrame, flags: tuple[int, ...] = tuple(range(10, 36)), gain: float = 1.0, pull: float = 0.25, at_high: float = 0.05, still: float = 0.15, run: int = 40, year: int = 252) -> DataFrame:
    """Sessions in a flag of h closes after a doubling: symbol, date, and of the flags that fit the one of greatest gain (of ties the shortest).

    The run tops h sessions ago at the yearly high, from the lowest close of the
    ``run`` sessions up to there; since then no close fell further than ``pull``, and
    the last stands near the yearly high.  A series of fewer than ``year + run``
    sessions has none.  Each h is a pair of window frames over one sort.
    """
    w = S.by_symbol()
    x = bars.select("symbol", "date", F.col("close").cast("double").alias("c")).withColumn("n", F.count("*").over(W.partitionBy("symbol")))
    x = x.withColumn("hi52", S.rolling(F.max, "c", year)).withColumn("base", S.rolling(F.min, "c", run))
    fits = []
    for h in flags:
        peak = F.lag("c", h).over(w)
        deep = 1.0 - F.min("c").over(S.frame(h)) / peak
        g = peak / F.lag("base", h).over(w) - 1.0
        ok = (g >= gain) & (deep <= pull) & (peak >= F.lag("hi52", h).over(w) * (1 - at_high)) & (F.col("c") >= F.col("hi52") * (1 - still))
        fits.append(F.when(ok, F.struct(g.alias("gain"), F.lit(-h).alias("minus_h"), deep.alias("pull"))))
    best = x.select("symbol", "date", F.when(F.col("n") >= year + run, F.array_max(F.array_compact(F.array(*fits)))).alias("b")).where("b is not null")
    return best.select("symbol", "date", "b.gain", (-F.col("b.minus_h")).alias("flag"), "b.pull")


def flag_list(bars: DataFrame, run: int = 40, year: int = 252, **kw) -> DataFrame:
    """Symbols whose last session is in a flag: gain, flag, pull, the flag's mean volume beside the run's, and distance from the yearly high."""
    x = bars.select("symbol", "date", "close", "volume", F.row_number().over(S.latest_first()).alias("rn"))
    now = tight_flags(bars, run=run, year=year, **kw).join(x.where("rn = 1").select("symbol", "date"), ["symbol", "date"])
    near = x.where(F.col("rn") <= year).join(now, "symbol")
    flag = F.avg(F.when(F.col("rn") <= F.col("flag"), F.col("volume")))
    before = F.avg(F.when((F.col("rn") > F.col("flag")) & (F.col("rn") <= F.col("flag") + run), F.col("volume")))
    return near.groupBy("symbol", "gain", "flag", "pull").agg(F.when(before > 0, flag / before).alias("volratio"), (F.max(F.when(F.col("rn") == 1, F.col("close"))) / F.max("close").cast("double") - 1.0).alias("off_high"))


def counts_through_time(bars: DataFrame, calendar: DataFrame, least_dollar: float = 10e6, **kw) -> DataFrame:
    """date, flags, volume_highs: symbols in a flag, and at a yearly volume high of enough traded value, on each session of the calendar."""
    flags = tight_flags(bars, **kw).groupBy("date").agg(F.count("*").alias("flags"))
    highs = volume_masks(bars).where(F.col("year_high") & (F.col("dollar") >= least_dollar)).groupBy("date").agg(F.count("*").alias("volume_highs"))
    return calendar.select("date").distinct().join(flags, "date", "left").join(highs, "date", "left").select("date", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("flags", "volume_highs")))


def leaderboard(bars: DataFrame, themes: DataFrame, least: int = 70) -> DataFrame:
    """Themes (symbol, ordinal) of enough sessions by one-month return now and a month ago: ranks, their change, and returns; ties in the order of the list."""
    w = S.by_symbol()
    p = F.col("close").cast("double")
    x = bars.join(themes.select("symbol"), "symbol", "left_semi").select("symbol", "date", S.lag_ret(k=5).alias("r1w"), S.lag_ret(k=21).alias("r1m"), S.lag_ret(k=63).alias("r3m"), (F.lag(p, 21).over(w) / F.lag(p, 42).over(w) - 1.0).alias("prev1m"), F.row_number().over(S.latest_first()).alias("rn"), F.count("*").over(W.partitionBy("symbol")).alias("n"))
    last = x.where((F.col("rn") == 1) & (F.col("n") >= least)).join(themes.select("symbol", "ordinal"), "symbol").withColumn("one", F.lit(1))
    rank = lambda c: F.row_number().over(W.partitionBy("one").orderBy(F.desc_nulls_last(c), "ordinal"))
    return last.withColumn("rank", rank("r1m")).withColumn("prev_rank", rank("prev1m")).select("symbol", "r1w", "r1m", "r3m", "rank", "prev_rank", (F.col("prev_rank") - F.col("rank")).alias("change"))


# ---------------------------------------------------------------- baskets and ledgers


def equal_weight_baskets(bars: DataFrame, members: DataFrame, fill: str = "pad") -> DataFrame:
    """basket, date, level, adj_level, ret, names: members' mean return chained from 100 on the union of their sessions.

    ``fill="pad"`` counts a closed market as a return of 0 from the member's first
    bar on; ``"none"`` leaves it out.
    """
    m = members.select("basket", "symbol").distinct()
    b = bars.join(m, "symbol").select("basket", "symbol", "date", "close", "adj_close")
    w = W.partitionBy("basket", "symbol").orderBy("date")
    if fill == "pad":
        grid = b.select("basket", "date").distinct().join(m, "basket")
        b = grid.join(b, ["basket", "symbol", "date"], "left")
        for c in ("close", "adj_close"):
            b = b.withColumn(c, F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    r = lambda c: F.col(c).cast("double") / F.lag(F.col(c).cast("double")).over(w) - 1.0
    x = b.withColumn("r", r("close")).withColumn("ra", r("adj_close"))
    day = x.groupBy("basket", "date").agg(F.avg("r").alias("r"), F.avg("ra").alias("ra"), F.count("r").alias("names"))
    return day.select("basket", "date", chain_level("r", key="basket").alias("level"), chain_level("ra", key="basket").alias("adj_level"), F.col("r").alias("ret"), "names")


def as_bars(levels: DataFrame, name: str = "basket") -> DataFrame:
    """Index levels as bars: flat, without volume, in fixed point."""
    p = F.rint(F.col("level") * 100_000).cast("long")
    return levels.select(F.col(name).alias("symbol"), "date", p.alias("open"), p.alias("high"), p.alias("low"), p.alias("close"), F.rint(F.col("adj_level") * 100_000).cast("long").alias("adj_close"), F.lit(0).cast("long").alias("volume"))


def composition(bars: DataFrame, members: DataFrame) -> DataFrame:
    """For each member of each basket: first date, last close and last one-day return."""
    x = bars.withColumn("ret", S.lag_ret())
    g = x.groupBy("symbol").agg(F.min("date").alias("first_date"), S.to_price_col_of(F.max_by("close", "date")).alias("last_close"), F.max_by("ret", "date").alias("last_ret"))
    return members.select("basket", "symbol").join(g, "symbol")


def theme_tags(members: DataFrame) -> DataFrame:
    """The baskets of each symbol, sorted."""
    return members.groupBy("symbol").agg(F.array_sort(F.collect_set("basket")).alias("tags"))


def full_dates(bars: DataFrame, members: DataFrame) -> DataFrame:
    """The date from which all members of a basket have bars."""
    first = bars.groupBy("symbol").agg(F.min("date").alias("first"))
    return members.join(first, "symbol").groupBy("basket").agg(F.max("first").alias("full_date"))


def ledger_walk(ledger: dict) -> tuple[list[dict], list[str]]:
    """Instances (symbol, entry, exit or None) and current members of a ledger of dated swaps.

    ``ledger``: {"init": (date, [symbols]), "swaps": [(date, [(out, in), ...]), ...]}.  A
    symbol put in again while held starts anew; one taken out that is not held is ignored.
    """
    start, names = ledger["init"]
    held = {s: start for s in names}
    done = []
    for day, swaps in ledger["swaps"]:
        for out, new in swaps:
            if out in held:
                done.append({"symbol": out, "entry": held.pop(out), "exit": day})
            if new:
                held[new] = day
    return done + [{"symbol": s, "entry": d, "exit": None} for s, d in held.items()], list(held)


def ledger_names(ledger: dict) -> set[str]:
    """Every symbol that a ledger ever names."""
    return set(ledger["init"][1]) | {x for _, swaps in ledger["swaps"] for pair in swaps for x in pair if x}


def instances(spark: SparkSession, ledger: dict) -> DataFrame:
    rows, _ = ledger_walk(ledger)
    return spark.createDataFrame([(r["symbol"], str(r["entry"]), None if r["exit"] is None else str(r["exit"])) for r in rows], "symbol string, entry string, exit string").select("symbol", F.to_date("entry").alias("entry"), F.to_date("exit").alias("exit"))


def realized(held: DataFrame, bars: DataFrame) -> DataFrame:
    """Entry and exit prices (the last close on or before) and the return in per cent of each instance; open ones to their last bar."""
    price = bars.select("symbol", "date", "close")
    last = price.groupBy("symbol").agg(F.max("date").alias("last"))
    x = held.join(last, "symbol").withColumn("until", F.coalesce("exit", "last"))
    x = S.as_of_backward(x, price, "entry").withColumnRenamed("close", "entry_close").drop("bar_date")
    x = S.as_of_backward(x, price, "until").withColumnRenamed("close", "exit_close").drop("bar_date")
    return x.select("symbol", "entry", "exit", S.to_price_col("entry_close").alias("entry_price"), S.to_price_col("exit_close").alias("exit_price"), F.bround((F.col("exit_close") / F.col("entry_close").cast("double") - 1) * 100, 1).alias("ret_pct"))


def ledger_index(held: DataFrame, bars: DataFrame, slots: int = 5) -> DataFrame:
    """date, level: 100 (1 + sum of the instances' returns over slots); closed ones are frozen, prices are the last known."""
    price = bars.select("symbol", "date", "close")
    entry = S.as_of_backward(held, price, "entry").withColumnRenamed("close", "entry_close").drop("bar_date")
    start = held.agg(F.min("entry").alias("start"))
    days = price.join(held.select("symbol").distinct(), "symbol", "left_semi").select("date").distinct().join(F.broadcast(start)).where("date >= start").select("date")
    # a level is the sum of all moves up to it: each bar of a name moves the instances that hold it
    moves = price.withColumn("prior", F.lag("close").over(S.by_symbol())).join(entry, "symbol").where("date > entry and (exit is null or date <= exit)")
    moves = moves.groupBy("date").agg(F.sum((F.col("close") - F.col("prior")) / F.col("entry_close").cast("double")).alias("move"))
    so_far = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)  # one row for each date
    return days.join(moves, "date", "left").select("date", (100 * (1 + F.coalesce(F.sum("move").over(so_far), F.lit(0.0)) / slots)).alias("level"))


# ---------------------------------------------------------------- factors

FACTORS = {"mom121": 252, "mom12": 252, "mom1": 21, "offhigh": 252, "vol": 63, "beta": 252, "ddepth": 252, "trend": 200}


def _deepest(window: int):
    """A group's rows by date with ``ddepth``: the deepest fall from a prior high within the window, in strides of some thousand rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        p = np.concatenate([np.full(window - 1, np.nan), pdf["close"].to_numpy(float)])
        view = np.lib.stride_tricks.sliding_window_view(p, window)
        out = np.full(len(pdf), np.nan)
        for i in range(0, len(pdf), 4000):
            part = view[i : i + 4000]
            out[i : i + 4000] = np.fmin.reduce(part / np.fmax.accumulate(part, axis=1) - 1.0, axis=1)
        return pdf.assign(ddepth=out)

    return run


def factor_scores(bars: DataFrame, calendar: DataFrame, benchmark: str) -> DataFrame:
    """symbol, date, row, first_row, close, dollar and a raw score of each factor, on one calendar without fill."""
    cal = calendar.select("date").distinct()
    cal = cal.withColumn("one", F.lit(1)).withColumn("row", F.row_number().over(W.partitionBy("one").orderBy("date"))).drop("one")
    x = S.on_calendar(bars.select("symbol", "date", "close", "adj_close", "volume"), cal).join(cal, "date")
    w = S.by_symbol()
    p = F.col("close").cast("double")
    lag = lambda k: F.lag(p, k).over(w)
    x = x.withColumn("ret", p / lag(1) - 1.0).withColumn("ret_adj", S.lag_ret("adj_close"))
    b = x.where(F.col("symbol") == benchmark).select("date", F.col("ret").alias("b"))
    x = x.where(F.col("symbol") != benchmark).join(b, "date", "left")
    x = x.groupBy("symbol").applyInPandas(_deepest(252), x.schema.simpleString()[7:-1] + ",ddepth:double")
    mean = lambda n: F.avg(p).over(S.frame(n))
    return x.select(
        "symbol", "date", "row", F.min(F.when(F.col("close").isNotNull(), F.col("row"))).over(W.partitionBy("symbol")).alias("first_row"), S.to_price_col("close").alias("close"), "ret", "ret_adj", S.rolling_median(S.to_price_col("close") * F.col("volume"), 20, 10).alias("dollar"),
        (lag(21) / lag(252) - 1.0).alias("mom121"), (p / lag(252) - 1.0).alias("mom12"), (p / lag(21) - 1.0).alias("mom1"), (p / F.max(p).over(S.frame(252)) - 1.0).alias("offhigh"), (F.stddev_pop("ret").over(S.frame(63)) * F.sqrt(F.lit(252.0))).alias("vol"),
        (F.covar_pop("ret", "b").over(S.frame(252)) / F.nullif(F.var_pop("b").over(S.frame(252)), F.lit(0.0))).alias("beta"), "ddepth", ((p / mean(20) + p / mean(50) + p / mean(200)) / 3 - 1.0).alias("trend"),
    )


def rebalance_picks(scores: DataFrame, names: int = 20, min_price: float = 1.0, min_dollar: float = 5e6, min_share: float = 0.75, factors: dict[str, int] = FACTORS) -> DataFrame:
    """factor, date, row, symbol, z, side: the symbols of highest and lowest score at each month's last session.

    A session counts when enough symbols are eligible under the longest look-back;
    the final session of the calendar never does.  z is of scores clipped to their
    1st and 99th percentiles, with population deviation; ties go by name.
    """
    ends = scores.groupBy(F.trunc("date", "MM").alias("m")).agg(F.max("row").alias("row"))
    last = scores.agg(F.max("row").alias("last"))
    ends = ends.join(F.broadcast(last)).where("row < last").select("row")
    x = scores.join(ends, "row", "left_semi")
    fit = (F.col("close") >= min_price) & (F.col("dollar") >= min_dollar)
    longest = max(factors.values())
    enough = x.groupBy("row").agg(F.sum((fit & (F.col("first_row") <= F.col("row") - longest)).cast("long")).alias("n"))
    total = scores.agg(F.countDistinct("symbol").alias("total"))
    enough = enough.join(F.broadcast(total)).where(F.col("n") >= min_share * F.col("total"))
    x = x.join(enough.select("row"), "row", "left_semi")
    long = x.select("symbol", "date", "row", F.explode(F.array(*(F.struct(F.lit(k).alias("factor"), F.when(fit & (F.col("first_row") <= F.col("row") - n), F.col(k)).alias("raw")) for k, n in factors.items()))).alias("f")).select("symbol", "date", "row", "f.*").where("raw is not null and not isnan(raw)")
    w = W.partitionBy("factor", "row")
    c = long.withColumn("lo", F.percentile("raw", F.lit(0.01)).over(w)).withColumn("hi", F.percentile("raw", F.lit(0.99)).over(w)).withColumn("c", F.least(F.greatest("raw", "lo"), "hi"))
    sd = F.stddev_pop("c").over(w)
    z = c.withColumn("z", F.when(sd > 0, (F.col("c") - F.avg("c").over(w)) / sd).otherwise(0.0))
    r = z.withColumn("place", F.row_number().over(w.orderBy(F.desc(F.round("z", 9)), "symbol"))).withColumn("n", F.count("*").over(w))
    cut = F.least(F.lit(names), F.floor(F.col("n") / 2))
    return r.withColumn("side", F.when(F.col("place") <= cut, "hi").when(F.col("place") > F.col("n") - cut, "lo")).where("side is not null").select("factor", "date", "row", "symbol", "z", "side")


def factor_snapshot(scores: DataFrame, picks: DataFrame, factors: dict[str, int] = FACTORS) -> DataFrame:
    """factor, side, symbol, z_snapshot, scored, per_side, date of each factor's last choice.

    ``z_snapshot`` is among all symbols with a score and enough history, whether or
    not their price and traded value let them be chosen; ``z`` of the picks is among
    those that could be.
    """
    last = picks.groupBy("factor").agg(F.max("row").alias("row"))
    raw = F.explode(F.array(*(F.struct(F.lit(k).alias("factor"), F.when(F.col("first_row") <= F.col("row") - n, F.col(k)).alias("raw")) for k, n in factors.items()))).alias("f")
    long = scores.join(last.select("row").distinct(), "row", "left_semi").select("symbol", "row", raw).select("symbol", "row", "f.*").join(last, ["factor", "row"]).where("raw is not null and not isnan(raw)")
    z = stats.winsorized_z(long, "raw", "factor", out="z_snapshot").withColumn("scored", F.count("*").over(W.partitionBy("factor")))
    mine = picks.join(last, ["factor", "row"]).withColumn("per_side", F.count("*").over(W.partitionBy("factor", "side")))
    return mine.join(z.select("factor", "symbol", F.round("z_snapshot", 2).alias("z_snapshot"), "scored"), ["factor", "symbol"]).select("factor", "side", "symbol", "z_snapshot", "scored", "per_side", "date")


def factor_levels(scores: DataFrame, picks: DataFrame) -> DataFrame:
    """id, factor, side, date, level, adj_level: members chosen at a session earn the sessions after it up to the next choice.

    Sides are hi, lo and ls, the difference of their returns, which has no dividends
    of its own.  Each choice is laid out on its sessions, so the join is on (symbol, session).
    """
    end = scores.agg(F.max("row").alias("end"))
    rows = picks.select("factor", "row").distinct().withColumn("next", F.lead("row").over(W.partitionBy("factor").orderBy("row"))).join(F.broadcast(end)).withColumn("next", F.coalesce("next", "end"))
    held = picks.select("factor", "row", "side", "symbol").join(rows, ["factor", "row"]).where("next > row").withColumn("at", F.explode(F.sequence(F.col("row") + 1, F.col("next"))))
    x = scores.select("symbol", F.col("row").alias("at"), "date", "ret", "ret_adj").join(held.select("factor", "side", "symbol", "at"), ["symbol", "at"])
    day = x.groupBy("factor", "side", "date").agg(F.avg("ret").alias("ret"), F.avg("ret_adj").alias("ret_adj"))
    side = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    spread = day.groupBy("factor", "date").agg((side("hi", "ret") - side("lo", "ret")).alias("ret")).select("factor", F.lit("ls").alias("side"), "date", "ret", F.col("ret").alias("ret_adj"))
    day = day.unionByName(spread).where("ret is not null").withColumn("id", F.concat_ws("_", F.lit("fac"), "factor", "side"))
    return day.select("id", "factor", "side", "date", chain_level("ret", key="id").alias("level"), chain_level("ret_adj", key="id").alias("adj_level"))


# ---------------------------------------------------------------- validation

GAP_DAYS = {"GSPC": 14}


def validate(bars: DataFrame, max_gap: int = 10, gaps: dict[str, int] = GAP_DAYS, stale_days: int = 3, flat_allowed: tuple[str, ...] = ()) -> DataFrame:
    """One row per symbol: counts of faults, and whether the series is stale, gapped or flat."""
    w = S.by_symbol()
    x = bars.withColumn("gap", F.date_diff("date", F.lag("date").over(w)))
    bad = F.lit(False)
    for c in ("open", "high", "low", "close"):
        bad = bad | F.col(c).isNull() | (F.col(c) <= 0)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    g = x.groupBy("symbol").agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("date")).alias("dup_dates"), n(bad).alias("bad_prices"), n((F.col("high") < F.col("low")) | (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))).alias("inverted"), n(F.col("high") == F.col("low")).alias("flat"), F.max("gap").alias("max_gap"), F.max("date").alias("last_date"))
    limit = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in gaps.items() for v in kv)), F.col("symbol")), F.lit(max_gap)) if gaps else F.lit(max_gap)
    ref = F.broadcast(modal_last_date(bars).select(F.col("last").alias("reference")))
    g = g.join(ref)
    return g.select("symbol", "n", "dup_dates", "bad_prices", "inverted", "flat", "max_gap", "last_date", (F.col("last_date") < F.date_sub("reference", stale_days)).alias("stale"), (F.coalesce("max_gap", F.lit(0)) > limit).alias("gapped"), ((F.col("flat") > 0.95 * F.col("n")) & ~F.col("symbol").isin(*flat_allowed) if flat_allowed else F.col("flat") > 0.95 * F.col("n")).alias("flat_series"))


def verdict(report: DataFrame, core: tuple[str, ...] = (), tolerance: float = 0.02) -> DataFrame:
    """failed and why: any duplicate, bad or inverted bar; a core symbol stale; or more stale or gapped symbols than tolerated."""
    r = report.agg(F.count("*").alias("files"), F.sum("dup_dates").alias("dups"), F.sum("bad_prices").alias("bad"), F.sum("inverted").alias("inverted"), F.sum(F.col("stale").cast("long")).alias("stale"), F.sum(F.col("gapped").cast("long")).alias("gapped"), F.max((F.col("stale") & (F.col("symbol").isin(*core) if core else F.lit(False))).cast("int")).alias("core_stale"))
    return r.select("*", ((F.col("dups") > 0) | (F.col("bad") > 0) | (F.col("inverted") > 0) | (F.col("core_stale") > 0) | (F.col("stale") > tolerance * F.col("files")) | (F.col("gapped") > tolerance * F.col("files"))).alias("failed"))
