"""Statistics of returns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Histogram edges in per cent; the last bin is closed.
EDGES = (-1e9, -10, -7, -5, -3, -2, -1, 0, 1, 2, 3, 5, 7, 10, 1e9)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's distribution."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def t_critical(df: int, level: float = 0.95) -> float:
    """The two-sided critical value, by bisection."""
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > 1 - level else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b - 1) if pd.notna(a) and b >= 2 else np.nan for a, b in zip(t, n)])


@F.pandas_udf(T.DoubleType())
def t_crit(n: pd.Series) -> pd.Series:
    known = {k: t_critical(int(k) - 1) for k in n.dropna().unique() if k >= 2}
    return n.map(known)


def mean(c: str) -> Column:
    return F.avg(c)


def win_rate(c: str) -> Column:
    """Share of values above zero; zero is no win."""
    return F.avg((F.col(c) > 0).cast("double"))


def sharpe(c: str, periods: int = 252) -> Column:
    sd = F.stddev_pop(c)
    return F.when(sd > 0, F.avg(c) / sd * F.lit(math.sqrt(periods)))


def t_stat(c: str) -> Column:
    """One-sample t against 0; null for fewer than two values or none that differ."""
    sd = F.stddev_samp(c)
    return F.when((F.count(c) >= 2) & (sd > 0), F.avg(c) / (sd / F.sqrt(F.count(c))))


def histogram(c: str, edges: tuple[float, ...] = EDGES) -> Column:
    """Counts in bins of per cent, half open but for the last."""
    v = F.col(c) * 100
    return F.array(*(F.coalesce(F.sum(((v >= lo) & ((v <= hi) if i == len(edges) - 2 else (v < hi))).cast("long")), F.lit(0)) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))))


def summarize(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, mean_pct, win_rate, sharpe, t_stat, p_ttest, p_permutation of each group.

    ``p_permutation`` is 1: a permutation keeps the mean.  An empty group is one row
    with n = 0 when there are no keys.  Nulls do not count.
    """
    g = (df.groupBy(*keys) if keys else df).agg(F.count(value).alias("n"), (mean(value) * 100).alias("mean_pct"), win_rate(value).alias("win_rate"), sharpe(value).alias("sharpe"), t_stat(value).alias("t_stat"))
    g = g.withColumn("p_ttest", F.nanvl(t_pvalue("t_stat", "n"), F.lit(None).cast("double"))).withColumn("p_permutation", F.when(F.col("n") > 0, 1.0))
    return g


def bootstrap_ci(df: DataFrame, value: str, order: str, *keys: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """ci_95_lo and ci_95_hi of the mean of each group, by resampling its values in descending ``order``.

    A group's values are one study's outcomes: thousands, whatever the table's size.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order, ascending=False, kind="stable")[value].dropna().to_numpy(float)
        row = {k: pdf[k].iloc[0] for k in keys}
        if len(x):
            rng = np.random.default_rng(seed)
            means = np.concatenate([x[rng.integers(0, len(x), (min(1000, draws - i), len(x)))].mean(axis=1) for i in range(0, draws, 1000)])
            lo, hi = np.percentile(means, [2.5, 97.5])
        else:
            lo = hi = None
        return pd.DataFrame([{**row, "ci_95_lo": lo, "ci_95_hi": hi}])

    kinds = dict(df.dtypes)
    return df.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "ci_95_lo double", "ci_95_hi double"]))


def percentile_of_last(df: DataFrame, value: str, lookback: int, least: int = 30) -> DataFrame:
    """For each symbol: 100 times the share of its last ``lookback`` values below the latest one."""
    from sessionloom.functions.series import latest_first

    w = df.where(F.col(value).isNotNull()).withColumn("rn", F.row_number().over(latest_first())).where(F.col("rn") <= lookback)
    last = F.max(F.when(F.col("rn") == 1, F.col(value)))
    tail = w.groupBy("symbol").agg(last.alias("last"), F.collect_list(value).alias("tail"))
    return tail.select("symbol", "last", F.when(F.size("tail") >= least, F.size(F.filter("tail", lambda x: x < F.col("last"))) * 100.0 / F.size("tail")).alias("pct"))


def winsorized_z(df: DataFrame, value: str, *keys: str, out: str = "z") -> DataFrame:
    """z of values clipped to their 1st and 99th percentiles within the keys; 0 where they do not differ."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys)
    ends = df.withColumn("__lo", F.percentile(value, F.lit(0.01)).over(w)).withColumn("__hi", F.percentile(value, F.lit(0.99)).over(w))
    clipped = ends.withColumn("__c", F.least(F.greatest(F.col(value), F.col("__lo")), F.col("__hi")))
    sd = F.stddev_pop("__c").over(w)
    return clipped.withColumn(out, F.when(sd > 0, (F.col("__c") - F.avg("__c").over(w)) / sd).otherwise(0.0)).drop("__lo", "__hi", "__c")


def dynamic_histogram(df: DataFrame, value: str) -> DataFrame:
    """Counts in bins of one per cent from the floor of the least to the ceiling of the greatest; the last is closed."""
    v = F.col(value) * 100
    ends = df.agg(F.floor(F.min(v)).alias("lo"), F.ceil(F.max(v)).alias("hi"))
    b = df.where(F.col(value).isNotNull()).join(F.broadcast(ends)).withColumn("bin", F.least(F.floor(v), F.greatest(F.col("hi") - 1, F.col("lo"))))
    return b.groupBy("bin").agg(F.count("*").alias("n"))


#: Two-sided 5 % points of t for 1 to 30 degrees of freedom, to two digits.
T_POINTS = (12.71, 4.30, 3.18, 2.78, 2.57, 2.45, 2.36, 2.31, 2.26, 2.23, 2.20, 2.18, 2.16, 2.14, 2.13, 2.12, 2.11, 2.10, 2.09, 2.09, 2.08, 2.07, 2.07, 2.06, 2.06, 2.06, 2.05, 2.05, 2.05, 2.04)


def t_of_page(df: str | Column) -> Column:
    """The two-sided 5 % point of t as a page computes it: a table up to 30, an approximation beyond, null below 1."""
    n = F.col(df) if isinstance(df, str) else df
    return F.when((n >= 1) & (n <= 30), F.get(F.array(*(F.lit(x) for x in T_POINTS)), (n - 1).cast("int"))).when(n > 30, 1.96 + 2.4 / n)


def row_stats(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, up, mean, t, ci_lo, ci_hi of outcomes in per cent, from rows: what stands in for a study that was not kept."""
    v = F.col(value)
    g = df.where(v.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg((v > 0).cast("double")).alias("up"), F.avg(v).alias("m"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    half = F.when(F.col("sd") > 0, t_of_page(F.col("n") - 1) * se).otherwise(0.0)
    return g.select(*keys, "n", F.round(F.col("up") * 100, 2).alias("up"), F.round("m", 3).alias("mean"), F.when(F.col("sd") > 0, F.round(F.col("m") / se, 2)).alias("t"), F.round(F.col("m") - half, 3).alias("ci_lo"), F.round(F.col("m") + half, 3).alias("ci_hi"))


def span_of(df: DataFrame, years: int | None, date: str = "date") -> DataFrame:
    """The rows of the last years up to the last date, that date's day of years ago included; None: all."""
    if years is None:
        return df
    top = df.agg(F.add_months(F.max(date), -12 * years).alias("__cut"))
    return df.join(F.broadcast(top)).where(F.col(date) >= F.col("__cut")).drop("__cut")


def colour_scale(df: DataFrame, value: str, n: str, thin: int = 60) -> DataFrame:
    """The cells with ``scale``, the size that nine tenths of all stay under, their share of it from -1 to 1, and whether they are thin."""
    size = df.where(F.col(value).isNotNull()).agg(F.array_sort(F.collect_list(F.abs(value))).alias("a"))  # a heat map's cells: hundreds
    at = F.get("a", F.floor(F.size("a") * 0.9).cast("int"))
    scale = size.select(F.greatest(F.lit(1e-6), F.coalesce(at, F.lit(0.1))).alias("scale"))
    shade = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(value) / F.col("scale")))
    return df.join(F.broadcast(scale)).withColumn("shade", shade).withColumn("thin", F.col(n) < thin)


def envelope(df: DataFrame, value: str, columns: int = 950, most: int = 3000, date: str = "date") -> DataFrame:
    """A line thinned for drawing: of each symbol with more than ``most`` points, the deepest (of ties the first) and the last of each column of pixels."""
    from pyspark.sql import Window as W

    whole = W.partitionBy("symbol")
    day = F.unix_date(date)
    x = df.withColumn("__n", F.count("*").over(whole)).withColumn("__0", F.min(day).over(whole)).withColumn("__1", F.max(day).over(whole))
    x = x.withColumn("__c", F.floor((day - F.col("__0")) / F.greatest(F.col("__1") - F.col("__0"), F.lit(1)) * columns))
    w = W.partitionBy("symbol", "__c")
    deep = F.row_number().over(w.orderBy(F.asc_nulls_last(value), date)) == 1
    last = F.row_number().over(w.orderBy(F.desc(date))) == 1
    return x.withColumn("__keep", (F.col("__n") <= most) | deep | last).where("__keep").select(*df.columns)
