"""Daily bars: one long table (symbol, date, open, high, low, close, adj_close, volume).

Prices are stored as whole numbers of 1/100 000 (``PRICE_SCALE``), so sums over
windows are exact; :func:`priced` gives doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE_SCALE = 100_000
PRICES = ("open", "high", "low", "close", "adj_close")
BARS_SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType()), *(T.StructField(p, T.LongType()) for p in PRICES), T.StructField("volume", T.LongType())])
#: Vendor symbols whose stem is no transformation of the symbol.
ALIASES = {"GC=F": "GOLD", "SI=F": "SILVER", "CL=F": "OIL", "HG=F": "COPPER", "DX-Y.NYB": "DXY"}


def to_price(x: Column) -> Column:
    """Fixed point to double."""
    return x / F.lit(float(PRICE_SCALE))


def priced(bars: DataFrame) -> DataFrame:
    """The bars with prices as doubles."""
    return bars.select("symbol", "date", *(to_price(F.col(p)).alias(p) for p in PRICES), "volume")


def file_stem(symbol: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """The file name of a vendor symbol: its alias, else itself without leading ``^``."""
    out = F.regexp_replace(symbol, r"^\^+", "")
    if aliases:
        pairs = [F.lit(x) for kv in aliases.items() for x in kv]
        out = F.coalesce(F.try_element_at(F.create_map(*pairs), symbol), out)
    return out


def view_name(symbol: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """The query name of a symbol: its stem in lower case, ``-`` and ``.`` as ``_``."""
    return F.translate(F.lower(file_stem(symbol, aliases)), "-.", "__")


#: The ways in which modules name a query view; they differ in ``.`` and ``^`` and in the use of aliases.
VIEW_NAMES = {
    "event": lambda c: F.translate(F.lower(F.regexp_replace(F.trim(c), r"^\^+", "")), "-.", "__"),
    "beta": lambda c: F.translate(F.lower(c), "-^", "_"),
    "theme": lambda c: F.translate(F.lower(file_stem(c)), "-.", "__"),
    "basket": lambda c: F.translate(F.lower(file_stem(c)), "-", "_"),
    "ledger": lambda c: F.translate(F.lower(file_stem(c)), "-.", "__"),
    "catalog": lambda c: F.translate(F.lower(c), "-^", "_"),
}


def read_bars(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Bars from a folder with a Parquet file for each symbol, named by the file, or with a folder ``symbol=...`` for each.

    Only the columns asked for are read; a symbol list becomes a filter on the file
    or folder name.  Two files with one query name are an error when :func:`check_catalog` runs.
    """
    want = columns or (*PRICES, "volume")
    df = spark.read.schema(T.StructType([f for f in BARS_SCHEMA if f.name != "symbol"])).parquet(path)
    # Spark gives file names as in a URL, and a folder's once more as it wrote them
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/symbol=([^/]*)/[^/]*$", 1)
    name = F.regexp_extract(plain(F.col("_metadata.file_name")), r"^(.*)\.parquet$", 1)
    df = df.select(F.when(folder != "", plain(plain(folder))).otherwise(name).alias("symbol"), "date", *want)
    return df.where(F.col("symbol").isin(symbols)) if symbols else df


def catalog(bars: DataFrame) -> DataFrame:
    """symbol, view, first_date, last_date, n."""
    return bars.groupBy("symbol").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n")).withColumn("view", view_name(F.col("symbol")))


def check_catalog(symbols: DataFrame) -> None:
    """Raise where two symbols share a query name."""
    clash = symbols.groupBy("view").agg(F.count("*").alias("n"), F.min("symbol").alias("a"), F.max("symbol").alias("b")).where("n > 1").orderBy("view").limit(1).collect()
    if clash:
        raise RuntimeError(f"{clash[0].a} and {clash[0].b} have the query name {clash[0].view}")


def register(spark: SparkSession, bars: DataFrame, name: str = "bars") -> None:
    """Views ``bars`` and ``<bars>_priced``, the function ``to_price`` and the table function ``returns``."""
    bars.createOrReplaceTempView(name)
    priced(bars).createOrReplaceTempView(f"{name}_priced")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION to_price(x BIGINT) RETURNS DOUBLE RETURN x / {float(PRICE_SCALE)}D")
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION returns(tkr STRING)
RETURNS TABLE (date DATE, dow INT, ret DOUBLE, next_date DATE, next_ret DOUBLE, next_dow INT)
RETURN SELECT date, dow, ret, lead(date) OVER (ORDER BY date), lead(ret) OVER (ORDER BY date), lead(dow) OVER (ORDER BY date)
FROM (SELECT date, weekday(date) + 1 AS dow, close / lag(close) OVER (ORDER BY date) - 1D AS ret FROM {name}_priced WHERE symbol = returns.tkr)""")


def query(spark: SparkSession, sql: str, **args) -> DataFrame:
    """Any SQL over the registered views, with named arguments."""
    return spark.sql(sql, args=args or None)


def _cents(price: Column) -> Column:
    return F.round(price * 100).cast("long") * (PRICE_SCALE // 100)


def bars_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the five order priorities: prices of a day's orders, in the order of their keys."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("symbol"), F.col("o_orderdate").cast("date").alias("date"), "o_orderkey", _cents(F.col("o_totalprice")).alias("p"))
    o = o.where(F.weekday("date") < 5)
    g = o.groupBy("symbol", "date").agg(F.min_by("p", "o_orderkey").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o_orderkey").alias("close"), F.count("*").alias("volume"))
    return g.select("symbol", "date", "open", "high", "low", "close", F.col("close").alias("adj_close"), "volume")


def bars_of_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the 25 brands: unit prices of the lines shipped on a day."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", F.col("l_shipdate").cast("date").alias("date"), _cents(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.col("l_quantity").cast("long").alias("q"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("b"), F.regexp_replace("p_brand", "[^0-9]", "")).alias("symbol"))
    j = line.where(F.weekday("date") < 5).join(part, "l_partkey")
    g = j.groupBy("symbol", "date").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.expr("sum(p) div count(p)").alias("close"), F.sum("q").alias("volume"))
    return g.select("symbol", "date", F.expr("(low + high) div 2").alias("open"), "high", "low", "close", F.col("close").alias("adj_close"), "volume")


#: The same bars for DuckDB, as common table expressions.
ORDERS_SQL = """bars AS (
  SELECT symbol, date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, arg_max(p, k) AS adj_close, count(*) AS volume
  FROM (SELECT 'p' || o_orderpriority[1] AS symbol, CAST(o_orderdate AS DATE) AS date, o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) * 1000 AS p FROM orders)
  WHERE isodow(date) < 6 GROUP BY symbol, date)"""
BRANDS_SQL = """bars AS (
  SELECT symbol, date, (min(p) + max(p)) // 2 AS open, max(p) AS high, min(p) AS low, CAST(sum(p) AS BIGINT) // count(p) AS close, CAST(sum(p) AS BIGINT) // count(p) AS adj_close, CAST(sum(q) AS BIGINT) AS volume
  FROM (SELECT 'b' || regexp_replace(p_brand, '[^0-9]', '', 'g') AS symbol, CAST(l_shipdate AS DATE) AS date, CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT) * 1000 AS p, CAST(l_quantity AS BIGINT) AS q FROM lineitem JOIN part ON l_partkey = p_partkey)
  WHERE isodow(date) < 6 GROUP BY symbol, date)"""
