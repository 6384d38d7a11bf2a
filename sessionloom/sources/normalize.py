"""Raw vendor bars to stored bars, refresh selection and the other small sources."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.sources.bars import PRICE_SCALE, PRICES, file_stem

#: Exchange clocks by suffix: time zone and the minute of the day from which a bar is complete.
CLOCKS = {".T": ("Asia/Tokyo", 15 * 60 + 35), ".KS": ("Asia/Seoul", 15 * 60 + 35), ".KQ": ("Asia/Seoul", 15 * 60 + 35), "": ("America/New_York", 16 * 60 + 5)}


def _clock(symbol: Column, pick) -> Column:
    out = F.lit(pick(CLOCKS[""]))
    for suffix, v in CLOCKS.items():
        if suffix:
            out = F.when(symbol.endswith(suffix), F.lit(pick(v))).otherwise(out)
    return out


def normalize(raw: DataFrame, now: datetime | None = None, cutoff: date | None = None) -> DataFrame:
    """Stored bars from vendor rows (symbol, date, Open ... Adj Close, Volume in any spelling).

    In this order: names are lower-cased with ``_``; a missing or wholly null
    adj_close is the close; rows with a null price go, a null volume is 0; rows with
    a price not above 0 go; high and low are widened to the bar; Saturdays, Sundays
    and dates after the cutoff go; the bar of the exchange's present day goes before
    its close; prices become fixed point, rounded half to even.
    """
    df = raw.toDF(*(c.strip().lower().replace(" ", "_") for c in raw.columns))
    if "adj_close" not in df.columns:
        df = df.withColumn("adj_close", F.lit(None).cast("double"))
    none = F.count("adj_close").over(W.partitionBy("symbol")) == 0
    df = df.withColumn("adj_close", F.when(none, F.col("close")).otherwise(F.col("adj_close")))
    df = df.dropna(subset=list(PRICES)).fillna(0, subset=["volume"])
    for p in PRICES:
        df = df.where((F.col(p) > 0) & ~F.isnan(F.col(p).cast("double")))
    df = df.withColumn("__h", F.greatest("open", "high", "low", "close")).withColumn("low", F.least("open", "high", "low", "close")).withColumn("high", F.col("__h"))
    df = df.withColumn("date", F.to_date("date")).where(F.weekday("date") < 5)
    if cutoff is not None:
        df = df.where(F.col("date") <= F.lit(cutoff))
    if now is not None:
        stamp = F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
        local = F.convert_timezone(F.lit("UTC"), _clock(F.col("symbol"), lambda v: v[0]), stamp)
        early = (F.hour(local) * 60 + F.minute(local)) < _clock(F.col("symbol"), lambda v: v[1])
        df = df.where(~((F.col("date") == F.to_date(local)) & early))
    return df.select("symbol", "date", *(F.rint(F.col(p).cast("double") * float(PRICE_SCALE)).cast("long").alias(p) for p in PRICES), F.col("volume").cast("long").alias("volume"))


def store_bars(raw: DataFrame, path: str, **kw) -> int:
    """Normalise vendor bars and write them; the number of symbols written, none of which is empty."""
    from sessionloom.sources.sinks import write_bars

    bars = normalize(raw, **kw)
    n = bars.select("symbol").distinct().count()
    if n:
        write_bars(bars, path)
    return n


#: Series whose vendor symbol is not their name.
SPECIAL = {"JP6674": "6674.T", "JP7011": "7011.T", "KR005930": "005930.KS"}


def equity_universe(*lists: DataFrame, special: dict[str, str] = SPECIAL) -> DataFrame:
    """series, symbol: every name of any list once, with the symbol to ask a vendor for."""
    out = None
    for names in lists:
        one = names.select(F.col(names.columns[0]).alias("series")).where("series is not null")
        out = one if out is None else out.unionByName(one)
    renamed = F.try_element_at(F.create_map(*(F.lit(x) for kv in special.items() for x in kv)), F.col("series"))
    return out.distinct().select("series", F.coalesce(renamed, "series").alias("symbol"))


def stale_symbols(bars: DataFrame, days: int = 3) -> DataFrame:
    """Symbols whose last bar is more than ``days`` before the latest of all: those to fetch again."""
    last = bars.groupBy("symbol").agg(F.max("date").alias("last_date"))
    top = last.agg(F.max("last_date").alias("top"))
    return last.join(F.broadcast(top)).where(F.col("last_date") < F.date_sub("top", days)).select("symbol", "last_date")


def refetch(bars: DataFrame, fetch, days: int = 3) -> DataFrame | None:
    """The hook for a vendor: ``fetch(symbols)`` is called with the stale symbols, if any."""
    names = [r.symbol for r in stale_symbols(bars, days).select("symbol").collect()]
    return fetch(sorted(names)) if names else None


def last_session(now: datetime) -> date:
    """The last weekday whose session has ended in New York terms, given local time there."""
    day = now.date() if now.hour * 60 + now.minute >= 16 * 60 + 5 else now.date() - timedelta(days=1)
    while day.weekday() > 4:
        day -= timedelta(days=1)
    return day


def read_members(spark: SparkSession, path: str, columns: tuple[str, ...] = ("ticker", "name", "sector", "industry")) -> DataFrame:
    """A membership table from CSV: missing columns and nulls are empty strings."""
    df = spark.read.csv(path, header=True)
    return df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns))


#: Vendor sectors to the eleven standard ones; others stay as they are.
SECTORS = {"Technology": "Information Technology", "Financial Services": "Financials", "Healthcare": "Health Care", "Consumer Cyclical": "Consumer Discretionary", "Consumer Defensive": "Consumer Staples", "Basic Materials": "Materials"}


def merge_metadata(members: DataFrame, extra: DataFrame) -> DataFrame:
    """Members with their stem and standard sector, and extra rows for stems that no member has."""
    sector = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SECTORS.items() for x in kv)), F.col("sector")), F.col("sector"))
    tidy = lambda d: d.withColumn("stem", file_stem(F.col("ticker"))).withColumn("sector", sector)
    m = tidy(members)
    return m.unionByName(tidy(extra).join(m.select("stem"), "stem", "left_anti").select(*m.columns))


#: The legal ending of a name, as a pattern.
LEGAL = r"(?i)[\s,]*\b(?:the\s+)?(?:inc|incorporated|corp|corporation|co|company|companies|ltd|limited|plc|llc|lp|nv|n\.v|sa|s\.a|ag|se|oyj|abp|holding|holdings|group|kk|k\.k)\.?$"


def tidy_name(name: Column, rounds: int = 6) -> Column:
    """A company's name without its legal endings; a name that is nothing else keeps the last of them."""
    for _ in range(rounds):
        less = F.btrim(F.regexp_replace(name, LEGAL, ""), F.lit(" ,."))
        name = F.when(less == "", name).otherwise(less)
    return name


def earnings_events(spark: SparkSession, path: str) -> DataFrame:
    """symbol, ts (local wall clock), after_close, reported from a cache of events by series."""
    kind = "map<string, struct<symbol:string, checked:string, events:array<struct<ts:string, after_close:boolean, reported:boolean>>>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    e = text.select(F.explode("m").alias("symbol", "v")).select("symbol", F.explode("v.events").alias("e"))
    ts = F.to_timestamp_ntz(F.regexp_replace("e.ts", r"(Z|[+-]\d\d:?\d\d)$", ""))
    return e.select("symbol", ts.alias("ts"), F.coalesce("e.after_close", F.hour(ts) >= 12).alias("after_close"), F.coalesce("e.reported", F.lit(False)).alias("reported"))


def earnings_queue(checked: DataFrame, today: date, days: int = 7) -> DataFrame:
    """Symbols (symbol, checked) never looked up or not for ``days``."""
    return checked.where(F.col("checked").isNull() | (F.to_date("checked") <= F.date_sub(F.lit(today), days)))


def read_eps(spark: SparkSession, path: str) -> DataFrame:
    """symbol, fy, report_date, eps, kind from the file of vintages (rows of year, date, number, kind)."""
    kind = "struct<series:map<string, struct<label:string, rows:array<array<string>>>>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("j"))
    r = text.select(F.explode("j.series").alias("symbol", "v")).select("symbol", F.explode("v.rows").alias("r"))
    return r.select("symbol", F.get("r", 0).cast("int").alias("fy"), F.try_to_timestamp(F.get("r", 1)).cast("date").alias("report_date"), F.get("r", 2).cast("double").alias("eps"), F.get("r", 3).alias("kind"))
