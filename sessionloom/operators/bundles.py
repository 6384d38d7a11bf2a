"""Composed results: leaders, themes, the weekly scoreboard, canned studies and a query function for a service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.functions import series as S
from sessionloom.functions import stats
from sessionloom.operators import analytics as A
from sessionloom.operators import cross as X
from sessionloom.operators import events as E


def leaders(bars: DataFrame, members: DataFrame, meta: DataFrame | None = None, stale_days: int = 5) -> DataFrame:
    """One row per member: last session's figures, horizon returns, relative volume, strength, tags, and whether it is stale."""
    own = bars.join(members.select("symbol").distinct(), "symbol", "left_semi")
    out = A.leader_rows(own).join(A.horizon_returns(own).drop("as_of"), "symbol").join(A.relative_volume(own), "symbol").join(A.rsi(own), "symbol").join(X.theme_tags(members), "symbol")
    if meta is not None:
        out = out.join(meta, "symbol", "left")
    ref = X.modal_last_date(own).select(F.col("last").alias("reference"))
    return out.join(F.broadcast(ref)).withColumn("stale", F.col("as_of") < F.date_sub("reference", stale_days)).drop("reference")


def week_context(bars: DataFrame, weeks: int = 4) -> DataFrame:
    """The last weeks' moves against all before them, as for sessions."""
    w = A.weekly_closes(bars).withColumnRenamed("week", "date")
    return A.move_context(w, weeks)


def _gauges(frame: DataFrame, columns: dict[str, str], lookback: int) -> DataFrame:
    """gauge, last, pct of columns of a frame with a row for each date."""
    long = frame.select("date", F.explode(F.array(*(F.struct(F.lit(g).alias("symbol"), F.col(c).cast("double").alias("v")) for g, c in columns.items()))).alias("x")).select("date", "x.*")
    return stats.percentile_of_last(long, "v", lookback).withColumnRenamed("symbol", "gauge")


def breadth_gauges(bars: DataFrame, calendar: DataFrame, lookback: int = 1260) -> DataFrame:
    """gauge, last, pct: breadth figures of the last session and where they stand in the last years."""
    return _gauges(X.breadth(bars, calendar), {c: c for c in ("pct_above_20", "pct_above_50", "pct_above_200", "net_highs")}, lookback)


def risk_gauges(bars: DataFrame, benchmark: str, calendar: DataFrame | None = None, lookback: int = 1260) -> DataFrame:
    """gauge, last, pct, r5, r10, r63 of four measures of risk appetite.

    beta: the month's change of the high-beta beside the low-beta fifth, in per cent
    (with its changes over a week, two weeks and a quarter); lead_breadth: leaders
    above their 50-session average; spread: that less the share of all; lead_rel:
    the month's change of the leaders beside the benchmark.  A ratio's change and not
    its level is ranked.
    """
    calendar = X.market_calendar(bars) if calendar is None else calendar
    b = X.beta_cohorts(bars, benchmark, calendar).select("date", "ratio")
    m = X.momentum_cohort(bars, benchmark, calendar).select("date", "leaders_above", "all_above", "relative")
    x = b.join(m, "date").withColumn("symbol", F.lit("all"))
    change = lambda c, k: (F.col(c) / F.lag(c, k).over(S.by_symbol()) - 1.0) * 100
    x = x.select("date", "symbol", change("ratio", 21).alias("beta"), F.col("leaders_above").alias("lead_breadth"), (F.col("leaders_above") - F.col("all_above")).alias("spread"), change("relative", 21).alias("lead_rel"), *(change("ratio", k).alias(f"r{k}") for k in (5, 10, 63)))
    g = _gauges(x, {c: c for c in ("beta", "lead_breadth", "spread", "lead_rel")}, lookback)
    extra = x.groupBy(F.lit("beta").alias("gauge")).agg(*(F.max_by(f"r{k}", "date").alias(f"r{k}") for k in (5, 10, 63)))
    return g.join(F.broadcast(extra), "gauge", "left")


def scoreboard(bars: DataFrame, calendar: DataFrame, lookback: int = 1260, week: int = 5, least_dollar: float = 10e6) -> DataFrame:
    """gauge, last, pct of the six weekly gauges: three breadth shares, net highs, flags, and volume highs of the last sessions."""
    n = X.counts_through_time(bars, calendar, least_dollar).withColumn("symbol", F.lit("all")).withColumn("volume_highs", S.rolling(F.sum, "volume_highs", week))
    x = X.breadth(bars, calendar).join(n.drop("symbol"), "date")
    return _gauges(x, {c: c for c in ("pct_above_20", "pct_above_50", "pct_above_200", "net_highs", "flags", "volume_highs")}, lookback)


def theme_levels(bars: DataFrame, members: DataFrame) -> DataFrame:
    """basket, symbol, date, level: members rebased to 100 on the basket's sessions up to the modal last date."""
    cut = X.modal_last_date(bars).select("last")
    b = bars.join(F.broadcast(cut)).where(F.col("date") <= F.col("last")).drop("last").join(members, "symbol")
    days = b.select("basket", "date").distinct().join(members, "basket")
    w = W.partitionBy("basket", "symbol").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    x = days.join(b.select("basket", "symbol", "date", "close"), ["basket", "symbol", "date"], "left").withColumn("p", F.last("close", ignorenulls=True).over(w)).where("p is not null")
    return x.select("basket", "symbol", "date", F.round(F.col("p") * 100.0 / F.first("p").over(w).cast("double"), 3).alias("level"))


def theme_series(bars: DataFrame, rail: DataFrame, members: DataFrame, floor: int = 30, member_floor: int = 15) -> DataFrame:
    """One row per series of the themes page: symbol, kind, ordinal, n, i0, p0, levels, steps, full_date.

    ``rail`` (symbol, ordinal, and optionally kind and floor) are the listed series,
    ``members`` (basket, symbol) the constituents, which get a line of their own at a
    lower floor.  The calendar is the union of all sessions up to the modal last one;
    ``i0`` is the place of a series' first session there, ``p0`` its first price,
    ``levels`` start at 100 and ``steps`` are its dividend factors; ``full_date`` is
    when the last member of a basket began.
    """
    listed = rail.select("symbol", "ordinal", *(F.col(c) if c in rail.columns else F.lit(v).alias(c) for c, v in (("kind", "etf"), ("floor", floor))))
    extra = members.select("symbol").distinct().join(listed.select("symbol"), "symbol", "left_anti").select("symbol", F.lit(None).cast("int").alias("ordinal"), F.lit("stock").alias("kind"), F.lit(member_floor).alias("floor"))
    n = bars.groupBy("symbol").agg(F.count("*").alias("n"))
    kept = listed.withColumn("ordinal", F.col("ordinal").cast("int")).unionByName(extra).join(n, "symbol").where(F.col("n") >= F.col("floor")).drop("floor")
    own = bars.join(kept.select("symbol"), "symbol", "left_semi")
    cut = X.modal_last_date(own).select("last")
    cal = own.select("date").distinct().join(F.broadcast(cut)).where(F.col("date") <= F.col("last")).select("date")
    place = cal.withColumn("i", F.row_number().over(W.orderBy("date")) - 1)  # one row for each session
    own = own.join(F.broadcast(cut)).where(F.col("date") <= F.col("last")).drop("last")
    first = own.groupBy("symbol").agg(F.min("date").alias("date"), S.to_price_col_of(F.min_by("close", "date")).alias("p0")).join(place, "date").select("symbol", F.col("i").alias("i0"), "p0")
    levels = A.rebase(own, cal).groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "level"))), lambda x: x["level"]).alias("levels"))
    steps = A.dividend_steps(own, cal).groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "factor"))), lambda x: F.struct(x["k"].alias("k"), x["factor"].alias("factor"))).alias("steps"))
    full = X.full_dates(bars, members).withColumnRenamed("basket", "symbol")
    return kept.join(first, "symbol").join(levels, "symbol").join(steps, "symbol", "left").join(full, "symbol", "left")


def ledger_meta(spark, ledger: dict) -> DataFrame:
    """kind, name, value: each name's held windows, each swap date's lines, and the current names, as a page shows them."""
    done, current = X.ledger_walk(ledger)
    windows: dict[str, list[str]] = {}
    for r in sorted(done, key=lambda r: (str(r["entry"]), r["symbol"])):
        windows.setdefault(r["symbol"], []).append(f"{r['entry']}..{r['exit'] or ''}")
    rows = [("window", k, ",".join(v)) for k, v in windows.items()]
    for day, swaps in ledger["swaps"]:
        rows.append(("event", str(day), ",".join(f"{out}>{new}" for out, new in swaps)))
    return spark.createDataFrame(rows + [("current", k, str(i)) for i, k in enumerate(current)], "kind string, name string, value string")


def basket_order(groups: DataFrame, baskets: DataFrame) -> DataFrame:
    """symbol, label, ordinal of the baskets in the order of the rail (group_ordinal, item_ordinal)."""
    one = groups.join(baskets.select("symbol").distinct(), "symbol", "left_semi")
    return one.select("symbol", "label", F.row_number().over(W.orderBy("group_ordinal", "item_ordinal")).alias("ordinal"))  # dozens of baskets


def dip_by_trend(bars: DataFrame, symbol: str, threshold: float = -0.03, days: int = 200) -> DataFrame:
    """regime, n, up_pct, mean_pct, t: what followed falls, of all and above and below the long average."""
    rules = {"all": None, "above": f"{symbol} > {symbol}_{days}dma", "below": f"{symbol} < {symbol}_{days}dma"}
    c = E.compare_regimes(bars, symbol, rules, threshold=threshold)
    return c.select("regime", "n", (F.col("win_rate") * 100).alias("up_pct"), "mean_pct", F.col("t_stat").alias("t"))


def bounce_rank(bars: DataFrame, symbols: list[str], when: str, threshold: float = -0.02) -> DataFrame:
    """symbol, n, up_pct, mean_pct, rank: what followed falls under a condition, best mean first."""
    named = bars.where(F.col("symbol").isin(symbols))
    # the condition's own series is needed beside the named ones
    s = E.event_study(bars, threshold=threshold, when=when).join(named.select("symbol").distinct(), "symbol", "left_semi")
    g = E.summarize_event(s, "symbol")
    return g.select("symbol", "n", (F.col("win_rate") * 100).alias("up_pct"), "mean_pct", F.row_number().over(W.orderBy(F.desc_nulls_last("mean_pct"), "symbol")).alias("rank"))


def crash_distribution(bars: DataFrame, symbol: str, threshold: float = -0.025) -> DataFrame:
    """lo, count, n, up_pct, mean_pct, base_up_pct: the sessions after a crash in bins of one per cent, beside the share of all sessions that rose."""
    s = E.event_study(bars, symbol, threshold=threshold).where("outcome_ret is not null")
    bins = stats.dynamic_histogram(s, "outcome_ret").select(F.col("bin").alias("lo"), F.col("n").alias("count"))
    total = s.agg(F.count("*").alias("n"), (F.avg((F.col("outcome_ret") > 0).cast("double")) * 100).alias("up_pct"), (F.avg("outcome_ret") * 100).alias("mean_pct"))
    r = bars.where(F.col("symbol") == symbol).select("symbol", S.lag_ret().alias("r")).where("r is not null").agg((F.avg((F.col("r") > 0).cast("double")) * 100).alias("base_up_pct"))
    return bins.join(F.broadcast(total)).join(F.broadcast(r))


def study_or_rows(cube: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """A result for each key: the cube's where it was kept, else statistics of the key's rows (``outcome_ret``), with ``source`` to tell.

    ``cube``: keys, n, up, mean, t, ci_lo, ci_hi.
    """
    mine = stats.row_stats(rows.withColumn("__v", F.col("outcome_ret") * 100), "__v", *keys).withColumn("source", F.lit("rows"))
    kept = cube.select(*keys, "n", "up", "mean", "t", "ci_lo", "ci_hi").withColumn("source", F.lit("cube"))
    return kept.unionByName(mine.join(kept.select(*keys), list(keys), "left_anti"))


def weekend(bars: DataFrame, members: DataFrame, benchmark: str, least_dollar: float = 10e6) -> dict[str, DataFrame]:
    """The tables of the weekly page: scoreboard, risk, themes, volume, flags, gauges and breadth."""
    cal = X.market_calendar(bars)
    themes = members.select("symbol").distinct().withColumn("ordinal", F.col("symbol"))
    return {
        "scoreboard": scoreboard(bars, cal, least_dollar=least_dollar), "risk": risk_gauges(bars, benchmark, cal), "themes": X.leaderboard(bars, themes).orderBy(F.desc("r1w")), "volume": X.volume_edge(bars, least_dollar=least_dollar).orderBy(F.desc("rvol")),
        "flags": X.flag_list(bars).orderBy(F.desc("gain")), "gauges": X.counts_through_time(bars, cal, least_dollar).orderBy("date"), "breadth": X.breadth(bars, cal).orderBy("date"),
    }


def drawdown_payload(bars: DataFrame) -> DataFrame:
    """symbol, json: every series' falls from its highs, for a shard a symbol."""
    from sessionloom.sources.sinks import json_rows

    return json_rows(A.drawdowns(bars), "symbol")


def run_event(bars: DataFrame, params: dict[str, str], cap: int = 1500) -> dict:
    """What a service answers: parameters as text in, statistics, histogram and the first rows out.

    ``worst_n`` wins over ``threshold``; pending rows are listed, not counted; an
    empty sample has n = 0.  Bad parameters raise ValueError.
    """
    ints, floats = {"day", "worst_n", "streak", "horizon", "strict_next_dow"}, {"threshold"}
    names = {"symbol", "streak_dir", "streak_gap", "streak_anchor", "since", "price", "measure_field", "when"}
    kw: dict = {}
    for k, v in params.items():
        if v in ("", None):
            continue
        if k not in ints | floats | names:
            raise ValueError(f"unknown parameter {k!r}")
        kw[k] = int(v) if k in ints else float(v) if k in floats else v
    if "symbol" not in kw:
        raise ValueError("symbol is missing")
    if kw.get("worst_n"):
        kw.pop("threshold", None)
    study = E.event_study(bars, **kw)
    known = study.where("outcome_ret is not null")
    s = stats.summarize(known, "outcome_ret").first().asDict()
    rows = study.orderBy(F.desc("trigger_date")).limit(cap).collect()
    return {"stats": s, "bins": known.agg(stats.histogram("outcome_ret").alias("h")).first().h, "rows": [{k: (v.isoformat() if hasattr(v, "isoformat") else v) for k, v in r.asDict().items()} for r in rows]}


def health(bars: DataFrame) -> dict:
    """Symbols and the latest date."""
    r = bars.agg(F.countDistinct("symbol").alias("count"), F.max("date").alias("as_of")).first()
    return {"count": r["count"], "as_of": r["as_of"].isoformat() if r["as_of"] else None}
