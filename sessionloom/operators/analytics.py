"""Analytics of single series, for all symbols at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.functions import series as S
from sessionloom.functions import stats

# ---------------------------------------------------------------- gaps and volume

GAP_BUCKETS = (("down 2 % or more", None, -0.02), ("down 1 to 2 %", -0.02, -0.01), ("down 0.5 to 1 %", -0.01, -0.005), ("up 0.5 to 1 %", 0.005, 0.01), ("up 1 to 2 %", 0.01, 0.02), ("up 2 % or more", 0.02, None))


def gap_features(bars: DataFrame) -> DataFrame:
    """symbol, date, gap, open_to_close, next_ret, filled; ``filled``: the day's range reached the prior close."""
    pc = F.lag("close").over(S.by_symbol())
    d = bars.select("symbol", "date", pc.cast("double").alias("pc"), *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")), S.lead_ret().alias("next_ret"))
    gap = (F.col("open") - F.col("pc")) / F.col("pc")
    return d.where("pc is not null").select("symbol", "date", gap.alias("gap"), ((F.col("close") - F.col("open")) / F.col("open")).alias("open_to_close"), "next_ret", F.when(gap > 0, F.col("low") < F.col("pc")).otherwise(F.col("high") > F.col("pc")).alias("filled"))


def gap_study(bars: DataFrame, least: float = 0.005, min_n: int = 10) -> DataFrame:
    """Statistics of open-to-close moves by gap bucket (lo, hi], all symbols pooled."""
    g = gap_features(bars).where(F.abs("gap") >= least)
    bucket = F.lit(None).cast("string")
    for name, lo, hi in reversed(GAP_BUCKETS):
        c = F.lit(True)
        if lo is not None:
            c = c & (F.col("gap") > lo)
        if hi is not None:
            c = c & (F.col("gap") <= hi)
        bucket = F.when(c, F.lit(name)).otherwise(bucket)
    g = g.withColumn("bucket", bucket).where("bucket is not null")
    out = g.groupBy("bucket").agg(F.count("*").alias("n"), (F.avg("open_to_close") * 100).alias("mean_pct"), stats.win_rate("open_to_close").alias("win_rate"), F.avg(F.col("filled").cast("double")).alias("fill_rate"), (F.avg("gap") * 100).alias("mean_gap_pct"))
    return out.where(F.col("n") >= min_n)


def volume_signals(bars: DataFrame, window: int = 50, below: float = 0.5, horizons: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """symbol, date, ratio, low_volume and forward returns, after the warm-up."""
    ratio = F.col("volume") / S.rolling(F.avg, F.col("volume").cast("double"), window)
    d = bars.select("symbol", "date", ratio.alias("ratio"), *(S.lead_ret(k=k).alias(f"fwd{k}") for k in horizons)).where("ratio is not null")
    return d.withColumn("low_volume", F.col("ratio") < below)


def volume_study(bars: DataFrame, **kw) -> DataFrame:
    """By horizon: outcomes after low volume beside those of all sessions, pooled; an episode is a session of low volume with an outcome."""
    d = volume_signals(bars, **kw)
    names = [c for c in d.columns if c.startswith("fwd")]
    long = d.select("low_volume", F.explode(F.array(*(F.struct(F.lit(int(c[3:])).alias("horizon"), F.col(c).alias("ret")) for c in names))).alias("x")).select("low_volume", "x.*").where("ret is not null")
    low = F.when(F.col("low_volume"), F.col("ret"))
    return long.groupBy("horizon").agg(F.count(low).alias("n"), F.count(low).alias("episodes"), (F.avg(low) * 100).alias("mean_pct"), F.avg((low > 0).cast("double")).alias("win_rate"), (F.avg("ret") * 100).alias("base_mean_pct"), F.avg((F.col("ret") > 0).cast("double")).alias("base_win_rate"))


# ---------------------------------------------------------------- betas

BETA_WINDOWS = {"full": None, "ytd": "ytd", "252": 252, "504": 504, "756": 756, "1260": 1260}


def beta_table(bars: DataFrame, benchmark: str, windows: dict = BETA_WINDOWS, min_obs: int = 60) -> DataFrame:
    """One row per symbol and window: beta, alpha, correlation, volatilities and compounded returns against a benchmark.

    Windows count sessions that both series have; a window with fewer than
    ``min_obs`` keeps its row with null figures.  The benchmark has no row.
    """
    r = bars.select("symbol", "date", S.lag_ret().alias("ret")).where("ret is not null")
    bench = r.where(F.col("symbol") == benchmark).select("date", F.col("ret").alias("b"))
    j = r.where(F.col("symbol") != benchmark).join(bench, "date")
    j = j.withColumn("rn", F.row_number().over(S.latest_first())).withColumn("last", F.max("date").over(W.partitionBy("symbol")))
    inside = [F.when(F.lit(True) if k is None else (F.year("date") == F.year("last")) if k == "ytd" else F.col("rn") <= k, F.lit(name)) for name, k in windows.items()]
    x = j.select("symbol", "date", "ret", "b", F.explode(F.array_compact(F.array(*inside))).alias("window"))
    full = lambda c: F.when(F.count("*") >= min_obs, c)
    beta = F.covar_samp("ret", "b") / F.var_samp("b")
    return x.groupBy("symbol", "window").agg(
        F.count("*").alias("n_obs"), F.min("date").alias("sample_start"), F.max("date").alias("sample_end"), full(beta).alias("beta"), full(F.avg("ret") - beta * F.avg("b")).alias("alpha_daily"), full(F.corr("ret", "b")).alias("corr"), full(F.corr("ret", "b") * F.corr("ret", "b")).alias("r2"),
        full(F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("stock_vol_ann"), full(F.stddev_samp("b") * F.sqrt(F.lit(252.0))).alias("benchmark_vol_ann"), full(F.exp(F.sum(F.log1p("ret"))) - 1).alias("stock_return"), full(F.exp(F.sum(F.log1p("b"))) - 1).alias("benchmark_return"),
    )


# ---------------------------------------------------------------- cycles

PHASES = ("Accumulation", "Markup", "Distribution", "Markdown")


def cycle_signals(bars: DataFrame, ma: int = 200, slope: int = 21, band: float = 0.05, peak: int = 756, range_dd: float = -0.10, vol: int = 21) -> DataFrame:
    """symbol, date, close, ma, slope, dd, vol and the phase of each session before short runs are merged."""
    w = S.by_symbol()
    d = bars.withColumn("ma", S.rolling_mean("close", ma, ma // 2)).withColumn("ret", S.lag_ret())
    d = d.withColumn("slope", (F.col("ma") / F.lag("ma", slope).over(w) - 1.0) * F.lit(252.0 / slope))
    top = F.max("close").over(S.frame(peak))
    d = d.withColumn("dd", F.col("close") / top.cast("double") - 1.0).withColumn("vol", S.rolling(F.stddev_samp, "ret", vol) * F.sqrt(F.lit(252.0)))
    price = S.to_price_col("close")
    above = price >= F.col("ma")
    phase = F.when((F.col("slope") > band) & above, "Markup").when((F.col("slope") < -band) & ~above, "Markdown").when(F.col("ma").isNotNull() & (F.col("dd") >= range_dd), "Distribution").when(F.col("ma").isNotNull(), "Accumulation")
    d = d.withColumn("raw", phase)
    first = F.first("raw", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return d.select("symbol", "date", price.alias("close"), "ma", "slope", "dd", "vol", F.coalesce("raw", first, S.last_known("raw")).alias("phase"))


def merge_short_runs(phases: list, least: int) -> list:
    """Runs shorter than ``least`` join their longer neighbour (the left one of equals), shortest and earliest first."""
    runs: list[list] = []
    for p in phases:
        if runs and runs[-1][0] == p:
            runs[-1][1] += 1
        else:
            runs.append([p, 1])
    while len(runs) > 1:
        k = min(range(len(runs)), key=lambda i: runs[i][1])
        if runs[k][1] >= least:
            break
        before, after = runs[k - 1][1] if k else -1, runs[k + 1][1] if k + 1 < len(runs) else -1
        runs[k][0] = runs[k - 1][0] if before >= after else runs[k + 1][0]
        joined: list[list] = []
        for p, n in runs:
            if joined and joined[-1][0] == p:
                joined[-1][1] += n
            else:
                joined.append([p, n])
        runs = joined
    return [p for p, n in runs for _ in range(n)]


def cycles(bars: DataFrame, min_days: int = 40, **signals) -> DataFrame:
    """The signals with phases whose runs last ``min_days`` at least."""
    d = cycle_signals(bars, **signals)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        pdf["phase"] = merge_short_runs(pdf["phase"].tolist(), min_days)
        return pdf

    return d.groupBy("symbol").applyInPandas(run, d.schema)


def segments(d: DataFrame) -> DataFrame:
    """Runs of one phase: dates, days, first and last price, return and mean volatility in per cent."""
    w = S.by_symbol()
    change = (F.coalesce(F.lag("phase").over(w) != F.col("phase"), F.lit(True))).cast("int")
    x = d.withColumn("change", change).withColumn("run", F.sum("change").over(w))
    g = x.groupBy("symbol", "run", "phase").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days"), F.min_by("close", "date").alias("first"), F.max_by("close", "date").alias("last"), F.avg("vol").alias("vol"))
    return g.select("symbol", "run", "phase", "start", "end", "days", F.bround("first", 2).alias("px_start"), F.bround("last", 2).alias("px_end"), F.bround((F.col("last") / F.col("first") - 1) * 100, 1).alias("ret_pct"), F.bround(F.col("vol") * 100, 1).alias("avg_vol"))


def phase_summary(segs: DataFrame) -> DataFrame:
    """Medians of the segments of each phase."""
    return segs.groupBy("symbol", "phase").agg(F.count("*").alias("n"), (F.median("days") / 252.0 * 12).alias("median_months"), F.median("ret_pct").alias("median_move"), F.median("avg_vol").alias("median_vol"))


def phase_matrix(d: DataFrame) -> DataFrame:
    """date, symbol and the number of the phase, 0 to 3, on the union of calendars; null where a symbol has no session."""
    index = F.array_position(F.array(*(F.lit(p) for p in PHASES)), F.col("phase")) - 1
    grid = d.select("date").distinct().join(d.select("symbol").distinct(), how="cross")
    return grid.join(d.select("symbol", "date", index.cast("int").alias("phase_index")), ["symbol", "date"], "left")


# ---------------------------------------------------------------- weeks, drawdowns, seasons

def weekly_closes(bars: DataFrame) -> DataFrame:
    """symbol, week (its Friday), close of the week's last session."""
    return bars.groupBy("symbol", S.week_ending_friday("date").alias("week")).agg(F.max_by("close", "date").alias("close"))


def drawdowns(bars: DataFrame, least: float = 0.03) -> DataFrame:
    """Falls below the running high: depth, peak, trough, sessions' dates, days from peak to trough and to recovery (null while open)."""
    w = S.by_symbol()
    d = bars.select("symbol", "date", "close", F.max("close").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("top"))
    d = d.withColumn("dd", F.col("close") / F.col("top").cast("double") - 1.0).withColumn("prior", F.lag("date").over(w)).withColumn("run", F.sum((F.col("close") == F.col("top")).cast("int")).over(w)).withColumn("next_date", F.lead("date").over(w))
    e = d.where("dd < 0").groupBy("symbol", "run").agg(F.min("dd").alias("dd"), F.min("prior").alias("peak"), F.min_by("date", F.struct("dd", "date")).alias("trough"), F.max_by("next_date", "date").alias("recovered"))
    return e.where(F.col("dd") <= -least).select("symbol", (-F.col("dd")).alias("depth"), "peak", "trough", F.date_diff("trough", "peak").alias("p2t"), F.date_diff("recovered", "trough").alias("rec"))


def drawdown_distribution(episodes: DataFrame, steps: tuple[float, ...] = tuple(k / 20 for k in range(1, 20))) -> DataFrame:
    """For each symbol and depth step: episodes of that depth or more, their share, years that had one, and the upper median of their days to the trough."""
    years = episodes.withColumn("year", F.year("trough"))
    total = F.count("*").over(W.partitionBy("symbol"))
    x = years.withColumn("total", total).select("*", F.explode(F.array(*(F.lit(s) for s in steps))).alias("at_least")).where("depth >= at_least")
    g = x.groupBy("symbol", "at_least").agg(F.count("*").alias("n"), F.max("total").alias("total"), F.countDistinct("year").alias("years"), F.max("trough").alias("last"), F.array_sort(F.collect_list("p2t")).alias("days"))
    return g.select("symbol", "at_least", "n", (F.col("n") / F.col("total")).alias("share"), "years", "last", F.get("days", F.floor(F.size("days") / 2).cast("int")).alias("median_p2t"))


def month_returns(bars: DataFrame, price: str = "adj_close") -> DataFrame:
    """symbol, month (its last day), return on the month before that has bars."""
    m = bars.groupBy("symbol", F.last_day("date").alias("month")).agg(F.max_by(price, "date").cast("double").alias("p"))
    return m.select("symbol", "month", (F.col("p") / F.lag("p").over(W.partitionBy("symbol").orderBy("month")) - 1.0).alias("ret")).where("ret is not null")


def seasonality(bars: DataFrame, least: int = 12) -> DataFrame:
    """Mean return of each calendar month, clipped to the month's own 10th and 90th percentiles."""
    m = month_returns(bars).withColumn("all", F.count("*").over(W.partitionBy("symbol"))).where(F.col("all") >= least).withColumn("m", F.month("month"))
    w = W.partitionBy("symbol", "m")
    x = m.withColumn("lo", F.percentile("ret", F.lit(0.1)).over(w)).withColumn("hi", F.percentile("ret", F.lit(0.9)).over(w))
    return x.groupBy("symbol", F.col("m").alias("month")).agg((F.avg(F.least(F.greatest("ret", "lo"), "hi")) * 100).alias("mean_pct"), F.count("*").alias("n"))


# ---------------------------------------------------------------- leaders

def wilder_rsi(closes: np.ndarray, n: int) -> float | None:
    """The latest relative strength index; None for fewer than 5n closes."""
    if len(closes) < 5 * n:
        return None
    d = np.diff(np.asarray(closes, float))
    up, down = max(d[0], 0.0), max(-d[0], 0.0)
    for x in d[1:]:
        up += (max(x, 0.0) - up) / n
        down += (max(-x, 0.0) - down) / n
    if down == 0:
        return None if up == 0 else 100.0
    return 100.0 - 100.0 / (1.0 + up / down)


def _wilder_step(n: float):
    """One session of Wilder's smoothing of rises u and falls v."""
    def step(a: Column, x: Column) -> Column:
        up, down = F.greatest(x["d"], F.lit(0.0)), F.greatest(-x["d"], F.lit(0.0))
        return F.struct((a["u"] + (up - a["u"]) / F.lit(n)).alias("u"), (a["v"] + (down - a["v"]) / F.lit(n)).alias("v"))

    return step


def rsi(bars: DataFrame, periods: tuple[int, ...] = (7, 14, 21)) -> DataFrame:
    """symbol and rsi<n>, folded over each symbol's closes in order, inside the JVM."""
    w = S.by_symbol()
    d = bars.select("symbol", "date", (F.col("close") - F.lag("close").over(w)).cast("double").alias("d"))
    g = d.groupBy("symbol").agg(F.array_sort(F.collect_list(F.when(F.col("d").isNotNull(), F.struct("date", "d")))).alias("ds"), F.count("*").alias("n"))
    out = g
    for p in periods:
        start = F.struct(F.greatest(g["ds"][0]["d"], F.lit(0.0)).alias("u"), F.greatest(-g["ds"][0]["d"], F.lit(0.0)).alias("v"))
        step = _wilder_step(float(p))
        fold = F.when((F.col("n") >= 5 * p), F.aggregate(F.slice("ds", F.lit(2), F.greatest(F.size("ds") - 1, F.lit(0))), start, step))
        out = out.withColumn(f"f{p}", fold)
    value = lambda p: F.when(F.col(f"f{p}.v") == 0, F.when(F.col(f"f{p}.u") > 0, 100.0)).otherwise(100.0 - 100.0 / (1.0 + F.col(f"f{p}.u") / F.col(f"f{p}.v")))
    return out.select("symbol", *(value(p).alias(f"rsi{p}") for p in periods))


def horizon_returns(bars: DataFrame, horizons: tuple[int, ...] = (1, 5, 21, 63, 126, 252, 756, 1260), price: str = "close") -> DataFrame:
    """symbol, as_of, r<k> and ytd in per cent: the last close against that of k sessions before, and of last year's end."""
    x = bars.withColumn("rn", F.row_number().over(S.latest_first())).withColumn("last", F.max("date").over(W.partitionBy("symbol")))
    at = lambda k: F.max(F.when(F.col("rn") == k + 1, F.col(price))).cast("double")
    base = F.max_by(price, F.when(F.year("date") < F.year("last"), F.col("date"))).cast("double")
    g = x.groupBy("symbol").agg(F.max("date").alias("as_of"), at(0).alias("p0"), *(at(k).alias(f"p{k}") for k in horizons), F.when(F.min(F.year("date")) < F.max(F.year("last")), base).alias("py"))
    return g.select("symbol", "as_of", *(((F.col("p0") / F.col(f"p{k}") - 1) * 100).alias(f"r{k}") for k in horizons), ((F.col("p0") / F.col("py") - 1) * 100).alias("ytd"))


def relative_volume(bars: DataFrame, windows: tuple[int | str, ...] = (1, 5, 21, 63, 126, "ytd", 252, 756, 1260), base: int = 252, least: int = 20) -> DataFrame:
    """Mean positive volume of the last k sessions (or of the last session's year) over that of the ``base`` sessions before them."""
    whole = W.partitionBy("symbol")
    x = bars.withColumn("rn", F.row_number().over(S.latest_first())).withColumn("v", F.when(F.col("volume") > 0, F.col("volume").cast("double"))).withColumn("n", F.count("*").over(whole))
    x = x.withColumn("year", F.sum((F.year("date") == F.year(F.max("date").over(whole))).cast("int")).over(whole))
    cols = []
    for name in windows:
        k = F.col("year") if name == "ytd" else F.lit(name)
        before = F.when((F.col("rn") > k) & (F.col("rn") <= k + base), F.col("v"))
        cols.append(F.when((F.count(before) >= least) & (F.max(F.col("n") - k) >= 0), F.avg(F.when(F.col("rn") <= k, F.col("v"))) / F.avg(before)).alias(f"rv{name}" if name != "ytd" else "rvytd"))
    return x.groupBy("symbol").agg(*cols)


def leader_rows(bars: DataFrame, least: int = 30) -> DataFrame:
    """The last session of each symbol with enough of them: distance from the highest and lowest close of a year, from averages, volatility of log returns and traded millions."""
    c = F.when(F.col("close") > 0, F.col("close").cast("double"))
    x = bars.withColumn("ret", F.log(c) - F.log(F.lag(c).over(S.by_symbol()))).withColumn("rn", F.row_number().over(S.latest_first()))
    near = lambda c, k: F.when(F.col("rn") <= k, c)
    last = F.max(near(F.col("close"), 1)).cast("double")
    of = lambda k, c: F.when(F.count("*") >= k, c)
    avg = lambda k: of(k, F.sum(near(F.col("close"), k)).cast("double") / k)
    g = x.groupBy("symbol").agg(
        F.count("*").alias("sessions"), F.max("date").alias("as_of"), (last / F.lit(100000.0)).alias("close"), (of(60, last / F.max(near(F.col("close"), 252)) - 1) * 100).alias("off52"), (of(60, last / F.min(near(F.col("close"), 252)) - 1) * 100).alias("up52"), ((last / avg(50) - 1) * 100).alias("ma50"), ((last / avg(200) - 1) * 100).alias("ma200"),
        of(61, F.stddev_pop(near(F.col("ret"), 126)) * F.sqrt(F.lit(252.0)) * 100).alias("vol"), of(63, F.avg(near(F.col("close") / F.lit(100000.0) * F.col("volume"), 63)) / 1e6).alias("adv"),
    )
    return g.where(F.col("sessions") >= least).drop("sessions")


def sigma_moves(bars: DataFrame, k: int = 5, least: int = 4) -> DataFrame:
    """How unusual the latest k-session return is among all earlier ones: deviations, and how many were as far from their mean."""
    r = bars.select("symbol", "date", S.lag_ret(k=k).alias("r"), F.row_number().over(S.latest_first()).alias("rn")).where("r is not null")
    whole = W.partitionBy("symbol")
    old = F.when(F.col("rn") > 1, F.col("r"))
    x = r.withColumn("cur", F.round(F.max(F.when(F.col("rn") == 1, F.col("r"))).over(whole) * 100, 2) / 100).withColumn("m", F.avg(old).over(whole)).withColumn("sd", F.stddev_samp(old).over(whole)).withColumn("old", old)
    far = F.abs(F.col("cur") - F.col("m"))
    g = x.groupBy("symbol").agg((F.max("cur") * 100).alias("move_pct"), F.max(F.when(F.col("sd") > 0, far / F.col("sd"))).alias("sigma"), F.sum((F.abs(F.col("old") - F.col("m")) >= far).cast("long")).alias("as_large"), F.count("old").alias("n"))
    return g.where((F.col("n") >= least) & F.col("sigma").isNotNull())


def move_context(bars: DataFrame, last: int = 5) -> DataFrame:
    """The last sessions' moves against all before them: z without removing the mean, and rank in per cent."""
    r = bars.select("symbol", "date", S.lag_ret().alias("r"), F.row_number().over(S.latest_first()).alias("rn")).where("r is not null")
    new, old = r.where(F.col("rn") <= last), r.where(F.col("rn") > last)
    g = old.groupBy("symbol").agg(F.stddev_samp("r").alias("sd"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.abs("r"))).alias("sizes"))
    j = new.join(g, "symbol").where("n >= 4")
    below = F.size(F.filter("sizes", lambda x: x <= F.abs("r")))
    return j.select("symbol", "date", (F.col("r") * 100).alias("move_pct"), F.when(F.col("sd") > 0, F.abs("r") / F.col("sd")).alias("z"), ((below + 1) / (F.col("n") + 1) * 100).alias("pct"), "n")


def rebase(bars: DataFrame, calendar: DataFrame, price: str = "close") -> DataFrame:
    """Levels on a shared calendar, carried forward and starting at 100."""
    x = S.on_calendar(bars.select("symbol", "date", price), calendar).withColumn("p", S.last_known(price)).where("p is not null")
    first = F.first("p").over(S.by_symbol().rowsBetween(W.unboundedPreceding, 0)).cast("double")
    return x.select("symbol", "date", F.round(F.col("p") * 100.0 / first, 3).alias("level"))


def dividend_steps(bars: DataFrame, calendar: DataFrame, tolerance: float = 2e-5) -> DataFrame:
    """symbol, k, date, factor: where total return, on one calendar and beside price from 1.0 on, leaves the last step given.

    ``k`` counts sessions from the symbol's first.  A symbol without steps after the
    first, or whose adjusted price has a gap at its start, gives none.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        p, t = pdf["close"].to_numpy(float), pdf["adj_close"].to_numpy(float)
        keep, values = [], []
        if len(p) and not np.isnan(t).any() and t[0] > 0:
            f = (t / t[0]) / (p / p[0])
            k = 0
            while k < len(f):
                keep.append(k)
                values.append(float(f"{f[k]:.7g}"))
                far = np.flatnonzero(np.abs(f[k + 1 :] / values[-1] - 1) > tolerance)
                if not len(far):
                    break
                k += 1 + int(far[0])
            if len(keep) == 1 and values[0] == 1.0:
                keep, values = [], []
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[keep].to_numpy(), "k": np.array(keep, np.int32), "date": pdf["date"].iloc[keep].to_numpy(), "factor": np.array(values, float)})

    x = S.on_calendar(bars.select("symbol", "date", "close", "adj_close"), calendar)
    x = x.select("symbol", "date", S.last_known("close").alias("close"), S.last_known("adj_close").alias("adj_close")).where("close is not null")
    return x.groupBy("symbol").applyInPandas(run, "symbol string, k int, date date, factor double")


def reaction_sessions(events: DataFrame, bars: DataFrame) -> DataFrame:
    """The session that reacts to each event (symbol, ts local time, after_close): the first on or after its day, or the next day after the close."""
    target = F.date_add(F.to_date("ts"), F.col("after_close").cast("int"))
    return S.as_of_forward(events.withColumn("target", target), bars.select("symbol", "date"), "target").where("session is not null")


# ---------------------------------------------------------------- earnings per share

def eps_schedule(eps: DataFrame, basis: int, q3_start_month: dict[str, int] | None = None) -> DataFrame:
    """symbol, from_date, fy, eps: which year's estimate a forward price-earnings line uses from when.

    ``eps``: symbol, fy, report_date, eps, kind (h reported, e estimate, f frozen).  A
    report of year fy moves the line to fy + basis; the start of the third fiscal
    quarter of fy + 1 (the given month) moves it a year earlier.  Losses and frozen
    anchors give no line; of two on a date the later year wins.
    """
    anchor = eps.where("kind <> 'f' and report_date is not null").select("symbol", F.col("fy").alias("anchor"), F.col("report_date").alias("from_date"))
    moves = anchor.select("symbol", "from_date", (F.col("anchor") + basis).alias("fy"))
    if q3_start_month:
        months = F.create_map(*(F.lit(x) for kv in q3_start_month.items() for x in kv))
        start = F.try_element_at(months, F.col("symbol"))
        # the fiscal year n starts in the month `start`, of the year before n unless that is January
        year = F.col("anchor") + 1
        q3 = F.add_months(F.make_date(F.when(start == 1, year).otherwise(year - 1), start, F.lit(1)), 6)
        moves = moves.unionByName(anchor.select("symbol", q3.alias("from_date"), (F.col("anchor") + basis + 1).alias("fy")).where("from_date is not null"))
    j = moves.join(eps.select("symbol", "fy", "eps"), ["symbol", "fy"]).where("eps > 0")
    w = W.partitionBy("symbol", "from_date").orderBy(F.desc("fy"))
    return j.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("symbol", "from_date", "fy", "eps")


def check_eps(eps: DataFrame) -> DataFrame:
    """Rows that break the rules: fiscal years strictly increasing, known kinds, a number."""
    w = W.partitionBy("symbol").orderBy("report_date", "fy")
    x = eps.withColumn("prev", F.lag("fy").over(w))
    return x.where((F.col("fy") <= F.col("prev")) | F.col("eps").isNull() | ~F.col("kind").isin("h", "e", "f") | F.col("kind").isNull()).drop("prev")


# ---------------------------------------------------------------- regimes and rotation

def regime_masks(close: DataFrame, calendar_symbol: str, ma: int = 200) -> DataFrame:
    """date, regime, on: each symbol against its long average and its quarter's move, on one calendar, carried forward."""
    cal = close.where(F.col("symbol") == calendar_symbol).select("date")
    x = S.on_calendar(close.select("symbol", "date", "close"), cal).withColumn("close", S.last_known("close"))
    x = x.withColumn("ma", S.rolling_mean("close", ma)).withColumn("quarter", S.lag_ret(k=63))
    price = S.to_price_col("close")
    named = F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("on")) for n, c in (("above", price > F.col("ma")), ("below", price < F.col("ma")), ("rising", F.col("quarter") > 0.02), ("falling", F.col("quarter") < -0.02))))
    return x.select("date", "symbol", F.explode(named).alias("x")).select("date", F.concat_ws("_", "symbol", "x.rule").alias("regime"), "x.on")


def regimes(close: DataFrame, calendar_symbol: str, rules: dict[str, tuple], ma: int = 200, look: int = 63) -> DataFrame:
    """date, regime, on by named rules, on one calendar, carried forward; a rule is (kind, symbol, threshold) or (kind, symbol, other, threshold).

    Kinds: ``above`` and ``below`` the average of ``ma`` sessions; ``over`` and ``under``
    a level; ``up`` and ``down`` by points, ``gain`` and ``loss`` by a share, over
    ``look`` sessions; ``leads`` and ``lags`` as gain and loss of the ratio of two symbols.
    """
    cal = close.where(F.col("symbol") == calendar_symbol).select("date")
    names = sorted({x for r in rules.values() for x in r[1:] if isinstance(x, str)})
    x = S.on_calendar(close.where(F.col("symbol").isin(names)).select("symbol", "date", "close"), cal).withColumn("close", S.to_price_col_of(S.last_known("close")))
    # a row for each date, so the windows below are short
    x = x.groupBy("date").agg(*(F.max(F.when(F.col("symbol") == n, F.col("close"))).alias(n) for n in names)).withColumn("symbol", F.lit("all"))
    back = lambda c: F.lag(c, look).over(S.by_symbol())

    def met(kind: str, name: str, *rest) -> Column:
        v = F.col(name)
        if kind in ("above", "below"):
            mean = S.rolling(F.avg, name, ma)
            return v > mean if kind == "above" else v < mean
        if kind in ("over", "under"):
            return v > rest[0] if kind == "over" else v < rest[0]
        if kind in ("leads", "lags"):
            v = v / F.col(rest[0])
        moved = v - back(v) if kind in ("up", "down") else v / back(v) - 1.0
        return moved > rest[-1] if kind in ("up", "gain", "leads") else moved < -rest[-1]

    on = F.array(*(F.struct(F.lit(k).alias("regime"), F.coalesce(met(*r), F.lit(False)).alias("on")) for k, r in rules.items()))
    return x.select("date", on.alias("x")).select("date", F.explode("x").alias("x")).select("date", "x.regime", "x.on")


def mask_string(masks: DataFrame) -> DataFrame:
    """regime, n and the mask as a string of 0 and 1 in the order of dates."""
    bit = F.col("on").cast("int").cast("string")
    g = masks.groupBy("regime").agg(F.sum(F.col("on").cast("long")).alias("n"), F.array_sort(F.collect_list(F.struct("date", bit.alias("bit")))).alias("bits"))
    return g.select("regime", "n", F.concat_ws("", F.transform("bits", lambda x: x["bit"])).alias("mask"))


def masked_stats(bars: DataFrame, masks: DataFrame) -> DataFrame:
    """Returns under each regime: n, mean, yearly mean, share above zero, t with population deviation, and excess over all days."""
    r = bars.select("symbol", "date", S.lag_ret().alias("r")).where("r is not null")
    own = r.groupBy("symbol").agg((F.avg("r") * 252).alias("own"))
    g = r.join(masks.where("on"), "date").groupBy("symbol", "regime").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), (F.avg("r") * 252).alias("ann"), stats.win_rate("r").alias("hit"), F.when(F.stddev_pop("r") > 0, F.avg("r") / (F.stddev_pop("r") / F.sqrt(F.count("r")))).alias("t"))
    return g.join(own, "symbol").withColumn("excess", F.col("ann") - F.col("own")).drop("own")


def rotation(bars: DataFrame, unit: str = "MM") -> DataFrame:
    """Compounded return of each symbol in each month, quarter or year, with its rank there and whether the period is the last."""
    r = bars.select("symbol", F.trunc("date", unit).alias("bucket"), S.lag_ret().alias("r")).where("r is not null")
    g = r.groupBy("symbol", "bucket").agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("ret"))
    top = g.agg(F.max("bucket").alias("top"))
    g = g.join(F.broadcast(top))
    return g.select("symbol", "bucket", "ret", (F.col("bucket") == F.col("top")).alias("partial"), F.row_number().over(W.partitionBy("bucket").orderBy(F.desc(F.round("ret", 9)), "symbol")).alias("rank"))
