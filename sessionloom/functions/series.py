"""Column helpers for ordered series: every window is partitioned by symbol and ordered by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.sources.bars import PRICE_SCALE


def by_symbol(*order: str) -> W:
    return W.partitionBy("symbol").orderBy(*(order or ("date",)))


def latest_first() -> W:
    return W.partitionBy("symbol").orderBy(F.desc("date"))


def frame(n: int) -> W:
    """The current row and the n-1 before it."""
    return by_symbol().rowsBetween(-(n - 1), 0)


def isodow(d: str | Column) -> Column:
    return F.weekday(d) + 1


def week_ending_friday(d: str | Column) -> Column:
    return F.date_add(F.to_date(F.col(d) if isinstance(d, str) else d), F.pmod(F.lit(5) - isodow(d), F.lit(7)))


def lag_ret(price: str = "close", k: int = 1) -> Column:
    """price / price k sessions ago - 1, of fixed-point or double prices."""
    p = F.col(price).cast("double")
    return p / F.lag(p, k).over(by_symbol()) - F.lit(1.0)


def lead_ret(price: str = "close", k: int = 1) -> Column:
    p = F.col(price).cast("double")
    return F.lead(p, k).over(by_symbol()) / p - F.lit(1.0)


def rolling(fn, column: str | Column, n: int, least: int | None = None) -> Column:
    """An aggregate over the last n sessions, null where fewer than ``least`` (n by default) have a value."""
    c = F.col(column) if isinstance(column, str) else column
    out = fn(c).over(frame(n))
    return out if least == 1 else F.when(F.count(c).over(frame(n)) >= (n if least is None else least), out)


def rolling_mean(column: str, n: int, least: int | None = None) -> Column:
    """Mean of a fixed-point column as a price: the sum is of integers, so it is exact."""
    w = frame(n)
    mean = F.sum(column).over(w).cast("double") / F.count(column).over(w) / F.lit(float(PRICE_SCALE))
    return mean if least == 1 else F.when(F.count(column).over(w) >= (n if least is None else least), mean)


def rolling_median(column: str | Column, n: int, least: int) -> Column:
    return rolling(lambda c: F.percentile(c, F.lit(0.5)), column, n, least)


def last_known(column: str) -> Column:
    """Forward fill."""
    return F.last(column, ignorenulls=True).over(by_symbol().rowsBetween(W.unboundedPreceding, 0))


def on_calendar(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every symbol on every session of the calendar; cells without a bar are null."""
    return bars.select("symbol").distinct().join(calendar.select("date").distinct(), how="cross").join(bars, ["symbol", "date"], "left")


def as_of_backward(left: DataFrame, right: DataFrame, date: str = "date") -> DataFrame:
    """Each row of ``left`` (symbol, ``date``, ...) with the last bar of its symbol on or before that date.

    The two tables are stacked and the bars carried forward, which is one sort by
    symbol and no range join.
    """
    keep = [c for c in left.columns]
    values = [c for c in right.columns if c not in ("symbol", "date")]
    a = left.select("*", F.struct("*").alias("__row"), F.lit(1).alias("__side"))
    b = right.select("symbol", F.col("date").alias(date), F.struct(F.col("date").alias("bar_date"), *values).alias("__bar"), F.lit(0).alias("__side"))
    both = a.select("symbol", date, "__row", F.lit(None).cast(b.schema["__bar"].dataType).alias("__bar"), "__side").unionByName(b.select("symbol", date, F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), "__bar", "__side"))
    w = W.partitionBy("symbol").orderBy(date, "__side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("__bar", F.last("__bar", ignorenulls=True).over(w)).where("__side = 1").select(*(F.col(f"__row.{c}").alias(c) for c in keep), "__bar.*")


def as_of_forward(left: DataFrame, right: DataFrame, date: str = "date") -> DataFrame:
    """Each row of ``left`` with ``session``: the first bar date of its symbol on or after the row's date, else null.

    The different dates of both tables are stacked and walked once from the last (a frame
    up to the end would be read anew for each row), and the rows join the session of
    their date, so no task sorts all rows of a symbol.  Null symbols and dates have no session.
    """
    asked = left.select("symbol", F.col(date).alias("__at"), F.lit(None).cast("date").alias("session"))
    bars = right.select("symbol", F.col("date").alias("__at"), F.col("date").cast("date").alias("session"))
    at = asked.unionByName(bars).where("symbol is not null and __at is not null").groupBy("symbol", "__at").agg(F.max("session").alias("session"))
    w = W.partitionBy("symbol").orderBy(F.desc("__at")).rowsBetween(W.unboundedPreceding, 0)
    found = at.select("symbol", F.col("__at").alias(date), F.last("session", ignorenulls=True).over(w).alias("session"))
    return left.join(found, ["symbol", date], "left").select(*left.columns, "session")


def to_price_col(name: str) -> Column:
    return F.col(name) / F.lit(float(PRICE_SCALE))


def to_price_col_of(c: Column) -> Column:
    return c / F.lit(float(PRICE_SCALE))
