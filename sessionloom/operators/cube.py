"""The event-study cube: all subjects, triggers, weekdays, conditions and horizons in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.functions import series as S
from sessionloom.functions import stats
from sessionloom.operators import gate
from sessionloom.sources.bars import view_name

THRESHOLDS = {"any": None, "le1": -0.01, "le2": -0.02, "le25": -0.025, "le3": -0.03, "le4": -0.04, "le5": -0.05}
WORST = {"worst20": 20, "worst50": 50}
HORIZONS = (1, 5)
MIN_N = 3


def _moments(horizons: tuple[int, ...]) -> list:
    """For each horizon a struct of count, sum, sum of squares, rises and bin counts of its outcomes in per cent."""
    out = []
    for h in horizons:
        v = F.col(f"o{h}") * 100
        n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
        bins = [n((v >= lo) & ((v <= hi) if i == len(stats.EDGES) - 2 else (v < hi))).alias(f"b{i}") for i, (lo, hi) in enumerate(zip(stats.EDGES, stats.EDGES[1:]))]
        out.append(F.struct(F.count(v).alias("n"), F.coalesce(F.sum(v), F.lit(0.0)).alias("s"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias("q"), n(v > 0).alias("u"), *bins).alias(f"m{h}"))
    return out


def cube(bars: DataFrame, subjects: list[str] | None, conditions: dict[str, str | None], thresholds: dict = THRESHOLDS, worst: dict = WORST, horizons: tuple[int, ...] = HORIZONS, min_n: int = MIN_N, ci: bool = True) -> DataFrame:
    """subject, trigger, weekday, condition, horizon -> n, up_pct, mean_pct, t, ci_lo, ci_hi, counts.

    ``{subj}`` in a condition names the subject.  A session meets several triggers
    and conditions; conditions are exploded from an array, so the table is read once
    and each combination is a group and not a filter.  Sessions without a return meet
    nothing.  Sums are taken once for each subject, weekday and condition, and combined
    to nested thresholds and to all weekdays.  Worst-n picks its sessions before outcomes that are not known drop.
    """
    view = view_name(F.col("symbol"))
    mine = bars if subjects is None else bars.where(view.isin(*subjects))
    trees = {k: None if c is None else gate.parse(c.replace("{subj}", "subj")) for k, c in conditions.items()}
    wanted = set().union(*(gate.features(t) for t in trees.values() if t is not None)) if trees else set()
    own = [f for f in wanted if f.series == "subj"]
    x = mine.select(view.alias("subject"), "symbol", "date", S.isodow("date").alias("dow"), S.lag_ret().alias("ret"), *(S.lead_ret(k=h).alias(f"o{h}") for h in horizons), *(gate.feature_column(f).alias(f.column) for f in own)).where("ret is not null")
    x = gate.gated(x, bars, {f for f in wanted if f.series != "subj"}, "date")
    met = F.array_compact(F.array(*(F.lit(k) if t is None else F.when(gate.column(t), F.lit(k)) for k, t in trees.items())))
    x = x.select("subject", "date", "dow", "ret", *(f"o{h}" for h in horizons), F.explode(met).alias("condition"))
    # thresholds are nested: a session counts once, in the tier of those it meets, and tiers are summed afterwards
    names = [k for k, _ in sorted(thresholds.items(), key=lambda kt: float("inf") if kt[1] is None else kt[1], reverse=True)]
    tier = sum((F.lit(1) if thresholds[k] is None else (F.col("ret") <= thresholds[k]).cast("int") for k in names), F.lit(0))
    every = ["subject", "condition"]
    tiers = x.withColumn("tier", tier).where("tier > 0").groupBy(*every, "dow", "tier").agg(*_moments(horizons))
    tiers = tiers.withColumn("trigger", F.explode(F.slice(F.array(*(F.lit(k) for k in names)), F.lit(1), F.col("tier")))).withColumn("weekday", F.explode(F.array(F.lit(0), F.col("dow"))))
    # the worst of all days are among the worst of each weekday
    most = max(worst.values())
    days = x.withColumn("rn", F.row_number().over(W.partitionBy(*every, "dow").orderBy("ret", "date"))).where(F.col("rn") <= most)
    whole = days.withColumn("rn", F.row_number().over(W.partitionBy(*every).orderBy("ret", "date"))).where(F.col("rn") <= most)
    low = days.withColumn("weekday", F.col("dow")).unionByName(whole.withColumn("weekday", F.lit(0)))
    pick = F.array_compact(F.array(*(F.when(F.col("rn") <= n, F.lit(k)) for k, n in worst.items())))
    low = low.withColumn("trigger", F.explode(pick)).groupBy(*every, "weekday", "trigger").agg(*_moments(horizons))
    parts = [*every, "weekday", "trigger", *(f"m{h}" for h in horizons)]
    both = tiers.select(*parts).unionByName(low.select(*parts))
    long = both.select("subject", "trigger", "weekday", "condition", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"m{h}").alias("m")) for h in horizons))).alias("x")).select("subject", "trigger", "weekday", "condition", "x.horizon", "x.m.*")
    bins = [f"b{i}" for i in range(len(stats.EDGES) - 1)]
    g = long.groupBy("subject", "trigger", "weekday", "condition", "horizon").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q", "u", *bins))).where(F.col("n") >= min_n)
    g = g.withColumn("m", F.col("s") / F.col("n")).withColumn("up", F.col("u") / F.col("n") * 100)
    spread = F.col("q") - F.col("s") * F.col("m")
    # a spread within rounding of the sums is none
    g = g.withColumn("sd", F.when(spread > F.col("q") * 1e-13, F.sqrt(spread / (F.col("n") - 1))).otherwise(0.0)).withColumn("counts", F.array(*bins))
    se = F.col("sd") / F.sqrt("n")
    out = g.withColumn("t", F.when(F.col("sd") > 0, F.col("m") / se))
    keys = ["subject", "trigger", "weekday", "condition", "horizon", "n"]
    if not ci:
        return out.select(*keys, F.col("up").alias("up_pct"), F.col("m").alias("mean_pct"), "t", "counts")
    half = F.when(F.col("sd") > 0, stats.t_crit("n") * se).otherwise(0.0)
    out = out.withColumn("half", half)
    return out.select(*keys, F.round("up", 1).alias("up_pct"), F.round("m", 3).alias("mean_pct"), F.round("t", 2).alias("t"), F.round(F.col("m") - F.col("half"), 3).alias("ci_lo"), F.round(F.col("m") + F.col("half"), 3).alias("ci_hi"), "counts")
