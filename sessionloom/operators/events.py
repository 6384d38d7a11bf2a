"""Conditional event studies and multi-session sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.functions import series as S
from sessionloom.functions import stats
from sessionloom.operators import gate
from sessionloom.sources.bars import view_name

RESULT = ("trigger_date", "trigger_dow", "trigger_ret", "outcome_date", "outcome_dow", "outcome_ret")


def returns(bars: DataFrame) -> DataFrame:
    """symbol, date, dow, ret, next_date, next_ret, next_dow of every session."""
    w = S.by_symbol()
    base = bars.select("symbol", "date", S.isodow("date").alias("dow"), S.lag_ret().alias("ret"))
    return base.select("*", F.lead("date").over(w).alias("next_date"), F.lead("ret").over(w).alias("next_ret"), F.lead("dow").over(w).alias("next_dow"))


def _check_intraday(bars: DataFrame) -> None:
    flat = bars.agg(F.avg((F.col("high") == F.col("low")).cast("double"))).first()[0]
    if flat is not None and flat > 0.95:
        raise ValueError("high, low and range mean nothing for a series with flat bars; measure ret")


def _measure(field: str, at: int, base: int, px: str):
    w = S.by_symbol()
    ahead = lambda c, k: F.lead(F.col(c).cast("double"), k).over(w) if k else F.col(c).cast("double")
    if field == "ret":
        return ahead(px, at) / ahead(px, base) - 1.0
    if field in ("hi", "lo"):
        return ahead({"hi": "high", "lo": "low"}[field], at) / ahead("close", base) - 1.0
    if field == "range":
        return (ahead("high", at) - ahead("low", at)) / ahead("close", base)
    raise ValueError(f"measure is ret, hi, lo or range, not {field!r}")


def event_study(bars: DataFrame, symbol: str | None = None, *, day: int | None = None, threshold: float | None = None, worst_n: int | None = None, streak: int | None = None, streak_dir: str = "down", streak_gap: str | None = None, streak_anchor: str = "start", horizon: int = 1, strict_next_dow: int | None = None, since: str | None = None, price: str = "close", measure_field: str = "ret", when: str | None = None, require_ret: bool = False) -> DataFrame:
    """What followed the sessions that meet a trigger: symbol and the six result columns.

    All symbols are studied at once unless one is named.  Features of ``when`` are
    computed on the conditioners' own histories and joined by exact date.  Outcomes
    past the data's end are rows with null outcomes.  ``worst_n`` keeps, for each
    symbol, the rows with the least trigger_ret (nulls last, then by date) after all
    other filters.
    """
    if streak_anchor not in ("start", "after"):
        raise ValueError("streak_anchor is start or after")
    mine = bars if symbol is None else bars.where(view_name(F.col("symbol")) == symbol.lower())
    if measure_field != "ret":
        _check_intraday(mine)
    w = S.by_symbol()
    k = 0 if streak is None else streak if streak_anchor == "after" else streak - 1
    df = mine.withColumn("pc", F.lag("close").over(w))
    hit = F.col("pc").isNotNull() & ((F.col("close") < F.col("pc")) if streak_dir == "down" else (F.col("close") > F.col("pc")))
    if streak_gap is not None:
        hit = hit & ((F.col("open") > F.col("pc")) if streak_gap == "up" else (F.col("open") < F.col("pc")))
    df = df.withColumn("hit", F.coalesce(hit, F.lit(False)))
    ok = F.lit(True)
    if streak is not None:
        first = 1 if streak_anchor == "after" else 0
        if not first:
            ok = F.col("hit") & ~F.coalesce(F.lag("hit").over(w), F.lit(False))
        for i in range(1, streak + first):
            ok = ok & F.coalesce(F.lead("hit", i).over(w), F.lit(False))
    df = df.select(
        "symbol", F.col("date").alias("trigger_date"), S.isodow("date").alias("trigger_dow"), S.lag_ret(price).alias("trigger_ret"),
        F.lead("date", k + horizon).over(w).alias("outcome_date"), F.lead(S.isodow("date"), k + horizon).over(w).alias("outcome_dow"), _measure(measure_field, k + horizon, k, price).alias("outcome_ret"), ok.alias("ok"),
    ).where("ok")
    if day is not None:
        df = df.where(F.col("trigger_dow") == day)
    if threshold is not None:
        df = df.where(F.col("trigger_ret") <= threshold)
    if strict_next_dow is not None:
        df = df.where(F.col("outcome_dow") == strict_next_dow)
    if since is not None:
        df = df.where(F.col("trigger_date") >= F.lit(since).cast("date"))
    if require_ret:
        df = df.where("trigger_ret is not null")
    if when:
        tree = gate.parse(when)
        df = gate.gated(df, bars, gate.features(tree), "trigger_date").where(gate.column(tree))
    df = df.select("symbol", *RESULT)
    if worst_n:
        order = W.partitionBy("symbol").orderBy(F.asc_nulls_last("trigger_ret"), "trigger_date")
        df = df.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= worst_n).drop("rn")
    return df


def summarize_event(study: DataFrame, *keys: str) -> DataFrame:
    """Statistics of the outcomes that are known."""
    return stats.summarize(study.where("outcome_ret is not null"), "outcome_ret", *keys)


def compare_regimes(bars: DataFrame, symbol: str | None, regimes: dict[str, str | None], **study) -> DataFrame:
    """Statistics under each named condition (None: under any), from one pass: every row is counted for the gates it meets."""
    base = event_study(bars, symbol, **study)
    trees = {name: when and gate.parse(when) for name, when in regimes.items()}
    wide = gate.gated(base, bars, set().union(*(gate.features(t) for t in trees.values() if t)), "trigger_date")
    met = F.array_compact(F.array(*(F.when(gate.column(t) if t else F.lit(True), F.lit(name)) for name, t in trees.items())))
    return summarize_event(wide.select("symbol", "outcome_ret", F.explode(met).alias("regime")), "symbol", "regime")


def sequence(bars: DataFrame, legs: list[str | list[str]], subject: str, *, anchor_day: int | None = None, measure_offset: int = 1, measure_field: str = "ret", since: str | None = None) -> DataFrame:
    """What followed sessions that start a chain of conditions on consecutive sessions.

    The series are first joined on their common dates (from ``since`` on); features,
    with full averages, and sessions are those of the joined calendar.  The outcome
    is the move of one session, ``measure_offset`` after the last leg; chains that
    end too late for it give no row.
    """
    trees = [[gate.parse(c, extended=True) for c in (leg if isinstance(leg, list) else [leg])] for leg in legs]
    subject = subject.lower()
    wanted = set().union(*(gate.features(t) for leg in trees for t in leg))
    names = sorted({f.series for f in wanted} | {subject})
    view = bars.withColumn("view", view_name(F.col("symbol")))
    joined = None
    for s in names:
        own = view.where(F.col("view") == s).select("date", F.col("close").alias(f"{s}__c"), *([F.col("high").alias("sub__h"), F.col("low").alias("sub__l")] if s == subject else []))
        joined = own if joined is None else joined.join(own, "date")
    if since is not None:
        joined = joined.where(F.col("date") >= F.lit(since).cast("date"))
    joined = joined.withColumn("symbol", F.lit(subject))
    for f in sorted(wanted, key=lambda f: f.column):
        c = f"{f.series}__c"
        w = S.by_symbol()
        price = F.col(c).cast("double")
        value = {"val": lambda: S.to_price_col(c), "prev": lambda: F.lag(S.to_price_col(c)).over(w), "ret": lambda: price / F.lag(price).over(w) - 1.0, "ret_prev": lambda: F.lag(price).over(w) / F.lag(price, 2).over(w) - 1.0, "dma": lambda: S.rolling_mean(c, f.n)}[f.kind]()
        joined = joined.withColumn(f.column, value)
    if measure_field != "ret":
        _check_intraday(view.where(F.col("view") == subject))
    w = S.by_symbol()
    sub, prev = F.col(f"{subject}__c").cast("double"), F.lag(F.col(f"{subject}__c").cast("double")).over(w)
    high, low = F.col("sub__h").cast("double"), F.col("sub__l").cast("double")
    if measure_field not in ("ret", "hi", "lo", "range"):
        raise ValueError(f"measure is ret, hi, lo or range, not {measure_field!r}")
    value = {"ret": sub / prev - 1.0, "hi": high / prev - 1.0, "lo": low / prev - 1.0, "range": (high - low) / prev}[measure_field]
    for k, leg in enumerate(trees):
        met = F.lit(True)
        for t in leg:
            met = met & F.coalesce(gate.column(t, unequal_null=True), F.lit(False))
        joined = joined.withColumn(f"leg{k}", met)
    joined = joined.withColumn("m", value)
    at = len(legs) - 1 + measure_offset
    chain = F.lit(True)
    for k in range(len(legs)):
        chain = chain & F.coalesce(F.lead(f"leg{k}", k).over(w) if k else F.col("leg0"), F.lit(False))
    out = joined.select(F.col("date").alias("anchor_date"), S.isodow("date").alias("anchor_dow"), F.lead("date", at).over(w).alias("measure_date"), F.lead(S.isodow("date"), at).over(w).alias("measure_dow"), F.lead("m", at).over(w).alias("outcome_ret"), chain.alias("ok"))
    out = out.where("ok and measure_date is not null")
    return (out if anchor_day is None else out.where(F.col("anchor_dow") == anchor_day)).drop("ok")


def render(study: DataFrame) -> DataFrame:
    """A line of text for each row; outcomes not known yet are shown as ``?``."""
    pct = lambda c: F.when(F.col(c).isNull(), F.lit("?")).otherwise(F.format_string("%+.2f%%", F.col(c) * 100))
    return study.select("*", F.concat_ws(" ", "symbol", F.date_format("trigger_date", "yyyy-MM-dd"), pct("trigger_ret"), F.coalesce(F.date_format("outcome_date", "yyyy-MM-dd"), F.lit("?")), pct("outcome_ret")).alias("line"))
