"""Queries of the composed results."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.operators import analytics as A
from sessionloom.operators import bundles as B
from sessionloom.operators import cross as X
from sessionloom.plans.cross import _BASKET, _CAL, _COHORT, _FLAGS, _MASKS, _RAMP, _members, ramped
from sessionloom.plans.registry import query
from sessionloom.plans.studies import BRA, ORD, r6
from sessionloom.sources.bars import bars_of_brands, bars_of_orders
from sessionloom.sources.normalize import earnings_queue, tidy_name


@query("x27_leaders")
def _(spark, d):
    b = bars_of_brands(spark, d)
    return B.leaders(b, _members(b)).withColumn("tags", F.array_join("tags", ","))


@query("a36_week_context", f"""{ORD}, k AS (SELECT symbol, CAST(date + CAST((5 - isodow(date) + 7) % 7 AS INT) AS DATE) AS week, arg_max(close, date) AS close FROM bars GROUP BY ALL), m AS (SELECT symbol, week, close / lag(close) OVER w - 1 AS ret, row_number() OVER (PARTITION BY symbol ORDER BY week DESC) AS rn FROM k WINDOW w AS (PARTITION BY symbol ORDER BY week)),
  o AS (SELECT symbol, stddev_samp(ret) AS sd, count(*) AS n FROM m WHERE ret IS NOT NULL AND rn > 4 GROUP BY symbol) SELECT a.symbol, a.week AS date, round(any_value(a.ret) * 100, 6) AS move_pct, round(abs(any_value(a.ret)) / any_value(sd), 6) AS z, round((sum(CAST(abs(b.ret) <= abs(a.ret) AS INT)) + 1) / (any_value(n) + 1) * 100, 6) AS pct, any_value(n) AS n
  FROM m a JOIN o USING (symbol) JOIN m b ON b.symbol = a.symbol AND b.rn > 4 AND b.ret IS NOT NULL WHERE a.rn <= 4 AND a.ret IS NOT NULL AND n >= 4 AND sd > 0 GROUP BY a.symbol, a.week""")
def _(spark, d):
    return r6(B.week_context(bars_of_orders(spark, d)).where("z is not null"), "move_pct", "z", "pct")


_BREADTH = f"""bx AS (SELECT date, close, count(*) OVER (PARTITION BY symbol) AS total, {', '.join(f'CASE WHEN count(*) OVER m{n} >= {n} THEN sum(close) OVER m{n} / count(*) OVER m{n} END AS ma{n}' for n in (20, 50, 200))}, CASE WHEN count(*) OVER y >= 252 THEN close >= max(close) OVER y END AS hi, CASE WHEN count(*) OVER y >= 252 THEN close <= min(close) OVER y END AS lo FROM bars
  WINDOW m20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), m50 AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING), m200 AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING), y AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING)),
  bg AS (SELECT date, {', '.join(f'avg(CASE WHEN ma{n} IS NOT NULL THEN CAST(close > ma{n} AS INT) END) * 100 AS pct_above_{n}' for n in (20, 50, 200))}, coalesce(sum(CAST(hi AS INT)), 0) AS new_highs, coalesce(sum(CAST(lo AS INT)), 0) AS new_lows FROM bx WHERE total >= 30 GROUP BY date), bd AS (SELECT * FROM cal JOIN bg USING (date))"""
_PCT = lambda src: f"gx AS (SELECT gauge, date, v, row_number() OVER (PARTITION BY gauge ORDER BY date DESC) AS k FROM ({src}) WHERE v IS NOT NULL), gy AS (SELECT gauge, max(v) FILTER (WHERE k = 1) AS last FROM gx GROUP BY gauge), gp AS (SELECT gauge, any_value(last) AS last, CASE WHEN count(*) >= 30 THEN 100.0 * avg(CAST(v < last AS INT)) END AS pct FROM gx JOIN gy USING (gauge) WHERE k <= 1260 GROUP BY gauge)"


@query("x9_risk_gauges", f"""{BRA}, {_COHORT}, cg AS (SELECT date, leaders_above, leaders_above - all_above AS spread, {', '.join(f"(ratio / lag(ratio, {k}) OVER w - 1) * 100 AS r{k}" for k in (5, 10, 21, 63))}, (relative / lag(relative, 21) OVER w - 1) * 100 AS rel FROM ch WINDOW w AS (ORDER BY date)),
  {_PCT("SELECT 'beta' AS gauge, date, r21 AS v FROM cg UNION ALL SELECT 'lead_breadth', date, leaders_above FROM cg UNION ALL SELECT 'spread', date, spread FROM cg UNION ALL SELECT 'lead_rel', date, rel FROM cg")}
  SELECT gauge, round(last, 5) AS last, round(pct, 6) AS pct, {', '.join(f"CASE WHEN gauge = 'beta' THEN (SELECT round(arg_max(r{k}, date), 5) FROM cg) END AS r{k}" for k in (5, 10, 63))} FROM gp""")
def _(spark, d):
    x = B.risk_gauges(bars_of_brands(spark, d), "b11")
    return x.select("gauge", F.round("pct", 6).alias("pct"), *(F.round(c, 5).alias(c) for c in ("last", "r5", "r10", "r63")))


@query("x16_scoreboard", f"""{_RAMP}, {_CAL}, {_MASKS}, {_FLAGS}, {_BREADTH}, nn AS (SELECT cal.date, coalesce(a.flags, 0) AS flags, coalesce(b.highs, 0) AS highs FROM cal LEFT JOIN (SELECT date, count(*) AS flags FROM fl GROUP BY date) a USING (date) LEFT JOIN (SELECT date, count(*) AS highs FROM vx WHERE year_high AND dollar >= 1000 GROUP BY date) b USING (date)), n5 AS (SELECT date, flags, CASE WHEN count(*) OVER w >= 5 THEN sum(highs) OVER w END AS highs FROM nn WINDOW w AS (ORDER BY date ROWS 4 PRECEDING)),
  {_PCT("SELECT 'flags' AS gauge, date, CAST(flags AS DOUBLE) AS v FROM n5 UNION ALL SELECT 'volume_highs', date, CAST(highs AS DOUBLE) FROM n5 UNION ALL SELECT 'net_highs', date, CAST(new_highs - new_lows AS DOUBLE) FROM bd UNION ALL SELECT 'pct_above_20', date, pct_above_20 FROM bd UNION ALL SELECT 'pct_above_50', date, pct_above_50 FROM bd UNION ALL SELECT 'pct_above_200', date, pct_above_200 FROM bd")}
  SELECT gauge, round(last, 5) AS last, round(pct, 6) AS pct FROM gp""")
def _(spark, d):
    b = ramped(spark, d)
    x = B.scoreboard(b, X.market_calendar(b), least_dollar=1000)
    return x.select("gauge", F.round("last", 5).alias("last"), F.round("pct", 6).alias("pct"))


@query("x28_theme_levels", f"""{BRA}, {_BASKET}, m AS (SELECT last FROM (SELECT last, count(*) AS k FROM (SELECT max(date) AS last FROM bars GROUP BY symbol) GROUP BY last) ORDER BY k DESC, last DESC LIMIT 1), b AS (SELECT basket, symbol, date, close FROM bars JOIN mb USING (symbol), m WHERE date <= last),
  g AS (SELECT d.basket, mb.symbol, d.date, last_value(b.close IGNORE NULLS) OVER (PARTITION BY d.basket, mb.symbol ORDER BY d.date) AS p FROM (SELECT DISTINCT basket, date FROM b) d JOIN mb ON mb.basket = d.basket LEFT JOIN b ON b.basket = d.basket AND b.symbol = mb.symbol AND b.date = d.date)
  SELECT basket, symbol, date, round(p * 100.0::DOUBLE / first_value(p) OVER (PARTITION BY basket, symbol ORDER BY date), 3) AS level FROM g WHERE p IS NOT NULL""")
def _(spark, d):
    b = bars_of_brands(spark, d)
    return B.theme_levels(b, _members(b))


_DIP = """s AS (SELECT symbol, date, close, ret, lead(close) OVER w / close - 1 AS o, CASE WHEN count(*) OVER m >= 1 THEN sum(close) OVER m / count(*) OVER m END AS ma FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date), m AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING))"""


@query("x32_dip_by_trend", f"""{ORD}, {_DIP}, h AS (SELECT *, close > ma AS up, close < ma AS down FROM s WHERE symbol = 'p1' AND ret <= -0.03 AND o IS NOT NULL), l AS (SELECT 'all' AS regime, o FROM h UNION ALL SELECT 'above', o FROM h WHERE up UNION ALL SELECT 'below', o FROM h WHERE down)
  SELECT regime, count(*) AS n, round(avg(CAST(o > 0 AS INT)) * 100, 6) AS up_pct, round(avg(o) * 100, 6) AS mean_pct, round(avg(o) / (stddev_samp(o) / sqrt(count(*))), 6) AS t FROM l GROUP BY regime""")
def _(spark, d):
    return r6(B.dip_by_trend(bars_of_orders(spark, d), "p1"), "up_pct", "mean_pct", "t")


@query("x32_bounce_rank", f"""{ORD}, {_DIP}, h AS (SELECT s.symbol, s.o FROM s JOIN s g ON g.date = s.date AND g.symbol = 'p1' WHERE s.symbol IN ('p2', 'p3', 'p4', 'p5') AND s.ret <= -0.02 AND s.o IS NOT NULL AND g.close / 100000.0 > 150000), a AS (SELECT symbol, count(*) AS n, avg(CAST(o > 0 AS INT)) * 100 AS up_pct, avg(o) * 100 AS mean_pct FROM h GROUP BY symbol)
  SELECT symbol, n, round(up_pct, 6) AS up_pct, round(mean_pct, 6) AS mean_pct, row_number() OVER (ORDER BY mean_pct DESC, symbol) AS rank FROM a""")
def _(spark, d):
    x = B.bounce_rank(bars_of_orders(spark, d), ["p2", "p3", "p4", "p5"], "p1 > 150000")
    return r6(x.withColumn("rank", F.col("rank").cast("long")), "up_pct", "mean_pct")


@query("x32_crash_distribution", f"""{ORD}, {_DIP}, h AS (SELECT o, o * 100 AS v FROM s WHERE symbol = 'p1' AND ret <= -0.025 AND o IS NOT NULL), b AS (SELECT least(floor(v), greatest((SELECT ceil(max(v)) FROM h) - 1, (SELECT floor(min(v)) FROM h))) AS lo, count(*) AS c FROM h GROUP BY lo)
  SELECT CAST(lo AS BIGINT) AS lo, c AS count, (SELECT count(*) FROM h) AS n, (SELECT round(avg(CAST(o > 0 AS INT)) * 100, 6) FROM h) AS up_pct, (SELECT round(avg(o) * 100, 6) FROM h) AS mean_pct, (SELECT round(avg(CAST(ret > 0 AS INT)) * 100, 6) FROM r WHERE symbol = 'p1' AND ret IS NOT NULL) AS base_up_pct FROM b""")
def _(spark, d):
    return r6(B.crash_distribution(bars_of_orders(spark, d), "p1"), "up_pct", "mean_pct", "base_up_pct")


@query("f6_study_or_rows", f"""{ORD}, {_DIP}, h AS (SELECT symbol, month(date) AS month, o * 100 AS v FROM s WHERE ret <= -0.5 AND o IS NOT NULL), c AS (SELECT symbol, month, count(*) AS n, avg(CAST(v > 0 AS INT)) * 100 AS up, avg(v) AS m, coalesce(stddev_samp(v), 0) AS sd FROM h GROUP BY symbol, month)
  SELECT symbol, CAST(month AS INT) AS month, n, CASE WHEN n >= 12 THEN 'cube' ELSE 'rows' END AS source, round(m, 3) AS mean FROM c""")
def _(spark, d):
    from sessionloom.functions import stats
    from sessionloom.operators import events as E

    rows = E.event_study(bars_of_orders(spark, d), threshold=-0.5).where("outcome_ret is not null").withColumn("month", F.month("trigger_date"))
    cube = stats.row_stats(rows.withColumn("v", F.col("outcome_ret") * 100), "v", "symbol", "month").where("n >= 12")
    return B.study_or_rows(cube, rows, "symbol", "month").select("symbol", "month", "n", "source", "mean")


@query("x28_theme_series", f"""{BRA}, {_BASKET}, k AS (SELECT symbol, count(*) AS n, CASE WHEN symbol IN ('b11', 'b12') THEN 'etf' ELSE 'stock' END AS kind FROM bars GROUP BY symbol HAVING count(*) >= 15), m AS (SELECT last FROM (SELECT last, count(*) AS c FROM (SELECT max(date) AS last FROM bars GROUP BY symbol) GROUP BY last) ORDER BY c DESC, last DESC LIMIT 1),
  c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars, m WHERE date <= last)), e AS (SELECT symbol, min(date) AS date, arg_min(close, date) AS p, arg_max(close, date) AS q FROM bars, m WHERE date <= last GROUP BY symbol)
  SELECT e.symbol, kind, n, CAST(i AS INT) AS i0, round(p / 100000.0, 6) AS p0, round(q * 100.0::DOUBLE / p, 3) AS last_level, (SELECT max(i) + 1 FROM c) - i AS n_levels FROM e JOIN k USING (symbol) JOIN c USING (date)""")
def _(spark, d):
    b = bars_of_brands(spark, d)
    rail = spark.createDataFrame([("b11", 1), ("b12", 2)], "symbol string, ordinal int")
    t = B.theme_series(b, rail, _members(b))
    return t.select("symbol", "kind", "n", "i0", F.round("p0", 6).alias("p0"), F.element_at("levels", -1).alias("last_level"), F.size("levels").cast("long").alias("n_levels"))


@query("h10_ledger_meta", """SELECT * FROM (VALUES ('window', 'p1', '1996-01-04..1997-03-05,1998-06-01..'), ('window', 'p2', '1996-01-04..1998-06-01'), ('window', 'p3', '1998-06-01..'), ('window', 'p4', '1997-03-05..1998-06-01'), ('window', 'p5', '1997-03-05..'), ('event', '1997-03-05', 'p1>p4,p9>p5'), ('event', '1998-06-01', 'p4>p1,p2>p3'), ('current', 'p3', '0'), ('current', 'p5', '1'), ('current', 'p1', '2')) t(kind, name, value)""")
def _(spark, d):
    from sessionloom.plans.cross import LEDGER

    return B.ledger_meta(spark, LEDGER)


@query("h6_equity_universe", "SELECT series, coalesce(nullif(CASE series WHEN 'JP6674' THEN '6674.T' ELSE '' END, ''), series) AS symbol FROM (SELECT p_brand AS series FROM part UNION SELECT 'JP6674' UNION SELECT n_name FROM nation)")
def _(spark, d):
    from sessionloom.sources.normalize import equity_universe

    read = lambda t, c: spark.read.parquet(f"{d}/{t}.parquet").select(c)
    return equity_universe(read("part", "p_brand"), read("nation", "n_name"), spark.createDataFrame([("JP6674",), (None,)], "x string"))


@query("h18_basket_order", f"{BRA}, {_BASKET}, g AS (SELECT DISTINCT basket FROM mb) SELECT basket AS symbol, upper(basket) AS label, row_number() OVER (ORDER BY CAST(basket[2] AS INT) % 2, basket DESC) AS ordinal FROM g")
def _(spark, d):
    m = _members(bars_of_brands(spark, d)).select(F.col("basket").alias("symbol")).distinct()
    k = F.substring("symbol", 2, 1).cast("int")
    groups = m.select("symbol", F.upper("symbol").alias("label"), (k % 2).alias("group_ordinal"), (-k).alias("item_ordinal"))
    return B.basket_order(groups, m).withColumn("ordinal", F.col("ordinal").cast("long"))


_NAMES = "(VALUES ('^GSPC'), ('BRK-B'), ('6674.T'), ('GC=F'), ('DX-Y.NYB'), ('aapl'), (' ^IXIC '))"
_STEM = "CASE x WHEN 'GC=F' THEN 'GOLD' WHEN 'DX-Y.NYB' THEN 'DXY' ELSE regexp_replace(x, '^\\^+', '') END"


@query("h2_view_name_variants", f"""SELECT x AS symbol, translate(lower(regexp_replace(trim(x), '^\\^+', '')), '-.', '__') AS event, replace(replace(lower(x), '-', '_'), '^', '') AS beta, translate(lower({_STEM}), '-.', '__') AS theme, replace(lower({_STEM}), '-', '_') AS basket, translate(lower({_STEM}), '-.', '__') AS ledger, replace(replace(lower(x), '-', '_'), '^', '') AS catalog FROM {_NAMES} t(x)""")
def _(spark, d):
    from sessionloom.sources.bars import VIEW_NAMES

    names = spark.createDataFrame([(x,) for x in ("^GSPC", "BRK-B", "6674.T", "GC=F", "DX-Y.NYB", "aapl", " ^IXIC ")], "symbol string")
    return names.select("symbol", *(f(F.col("symbol")).alias(k) for k, f in VIEW_NAMES.items()))


@query("k7_drawdown_payload", f"""{ORD}, t AS (SELECT symbol, date, close, max(close) OVER (PARTITION BY symbol ORDER BY date) AS top FROM bars), g AS (SELECT symbol, date, close / top - 1 AS dd, sum(CAST(close = top AS INT)) OVER (PARTITION BY symbol ORDER BY date) AS run FROM t) SELECT symbol, count(*) AS episodes FROM (SELECT symbol, run, min(dd) AS dd FROM g WHERE dd < 0 GROUP BY symbol, run) WHERE dd <= -0.03 GROUP BY symbol""")
def _(spark, d):
    x = B.drawdown_payload(bars_of_orders(spark, d))
    return x.select("symbol", F.json_array_length("json").cast("long").alias("episodes"))


@query("f7_regimes_by_win_rate", f"""{ORD}, s AS (SELECT symbol, date, close, ret, lead(close) OVER w / close - 1 AS o, sum(close) OVER m / count(*) OVER m AS ma FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date), m AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING)),
  h AS (SELECT s.o, a.ret > 0 AS c1, b.ret < 0 AS c2, c.close > c.ma AS c3 FROM s LEFT JOIN s a ON a.date = s.date AND a.symbol = 'p2' LEFT JOIN s b ON b.date = s.date AND b.symbol = 'p3' LEFT JOIN s c ON c.date = s.date AND c.symbol = 'p4' WHERE s.symbol = 'p1' AND s.ret <= -0.01 AND s.o IS NOT NULL),
  l AS (SELECT 'p2 up' AS regime, o FROM h WHERE c1 UNION ALL SELECT 'p3 down', o FROM h WHERE c2 UNION ALL SELECT 'p4 above', o FROM h WHERE c3), g AS (SELECT regime, count(*) AS n, round(avg(CAST(o > 0 AS INT)), 6) AS win_rate FROM l GROUP BY regime HAVING count(*) >= 3)
  SELECT *, row_number() OVER (ORDER BY win_rate DESC, regime) AS rank FROM g""")
def _(spark, d):
    from sessionloom.operators.events import compare_regimes

    c = compare_regimes(bars_of_orders(spark, d), "p1", {"p2 up": "p2_up", "p3 down": "p3_down", "p4 above": "p4 > p4_50dma"}, threshold=-0.01)
    c = r6(c.where("n >= 3"), "win_rate")
    return c.select("regime", "n", "win_rate", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("win_rate"), "regime")).cast("long").alias("rank"))


_TAILS = ("", ", Inc.", " Holdings Ltd", " Group PLC", " Companies, LLC", " K.K", " Oyj", " The Company", " & Co., Ltd.", " S.A", " Incorporated", " class A")


def _tidied(x: str, rounds: int = 6) -> str:
    from sessionloom.sources.normalize import LEGAL

    for _ in range(rounds):
        less = f"trim(regexp_replace({x}, '{LEGAL[4:]}', '', 'i'), ' ,.')"
        x = f"(SELECT CASE WHEN y.b = '' THEN y.a ELSE y.b END FROM (SELECT z.a, {less.replace(x, 'z.a')} AS b FROM (SELECT {x} AS a) z) y)"
    return x


@query("x31_tidy_names", f"SELECT s_suppkey, {_tidied('n')} AS name FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 12 = 7 THEN 'Group Holdings' ELSE s_name || [" + ", ".join(f"'{t}'" for t in _TAILS) + "][1 + s_suppkey % 12] END AS n FROM supplier)")
def _(spark, d):
    k = (F.col("s_suppkey") % 12).cast("int")
    tail = F.get(F.array(*(F.lit(t) for t in _TAILS)), k)
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return s.select("s_suppkey", tidy_name(F.when(k == 7, "Group Holdings").otherwise(F.concat("s_name", tail))).alias("name"))


def _eps(spark, d):
    b = bars_of_orders(spark, d).withColumn("fy", F.year("date"))
    g = b.groupBy("symbol", "fy").agg(F.max("date").alias("report_date"), F.sum("close").alias("s"), F.count("*").alias("n"))
    return g.select("symbol", "fy", "report_date", (F.floor(F.col("s") / F.col("n") / 1e5) - 100000).cast("double").alias("eps"), F.lit("h").alias("kind"))


_EPS = "eps AS (SELECT symbol, fy, report_date, CAST(floor(s / n / 1e5) - 100000 AS DOUBLE) AS eps FROM (SELECT symbol, year(date) AS fy, max(date) AS report_date, CAST(sum(close) AS BIGINT) AS s, count(*) AS n FROM bars GROUP BY ALL))"


@query("a40_eps_schedule", f"{ORD}, {_EPS} SELECT a.symbol, a.report_date AS from_date, CAST(b.fy AS INT) AS fy, b.eps FROM eps a JOIN eps b ON a.symbol = b.symbol AND b.fy = a.fy + 1 WHERE b.eps > 0")
def _(spark, d):
    return A.eps_schedule(_eps(spark, d), 1)


@query("a41_eps_faults", f"{ORD}, {_EPS}, q AS (SELECT symbol, CASE WHEN fy % 3 = 0 THEN fy - 1 ELSE fy END AS fy, report_date FROM eps), p AS (SELECT symbol, fy, lag(fy) OVER (PARTITION BY symbol ORDER BY report_date, fy) AS prev FROM q) SELECT symbol, CAST(fy AS INT) AS fy FROM p WHERE fy <= prev")
def _(spark, d):
    # each third year is given the number of the year before it
    e = _eps(spark, d).withColumn("fy", F.when(F.col("fy") % 3 == 0, F.col("fy") - 1).otherwise(F.col("fy")))
    return A.check_eps(e).select("symbol", "fy")


@query("s14_earnings_queue", f"{BRA}, k AS (SELECT symbol, CASE WHEN symbol <> 'b11' THEN max(date) - coalesce(TRY_CAST(symbol[3] AS INT), 0) END AS checked FROM bars GROUP BY symbol) SELECT symbol FROM k WHERE checked IS NULL OR checked <= DATE '2001-11-05' - 7")
def _(spark, d):
    from datetime import date

    last = bars_of_brands(spark, d).groupBy("symbol").agg(F.max("date").alias("last"))
    checked = last.select("symbol", F.when(F.col("symbol") != "b11", F.date_sub("last", F.coalesce(F.substring("symbol", 3, 1).try_cast("int"), F.lit(0)))).alias("checked"))
    return earnings_queue(checked, date(2001, 11, 5)).select("symbol")


@query("k5_json_shards")
def _(spark, d):
    from sessionloom.sources.sinks import json_rows

    b = bars_of_orders(spark, d)
    return json_rows(A.month_returns(b).withColumn("month", F.col("month").cast("string")), "symbol")


@query("st14_move_stat", f"{BRA}, o AS (SELECT symbol, sqrt(var_samp(ret)) AS sd, count(*) AS n FROM r WHERE rn > 1 AND ret IS NOT NULL GROUP BY symbol) SELECT r.symbol, round(abs(ret) / sd, 6) AS z FROM r JOIN o USING (symbol) WHERE rn = 1 AND n >= 4 AND sd > 0 AND ret IS NOT NULL")
def _(spark, d):
    return A.move_context(bars_of_brands(spark, d), 1).where("z is not null").select("symbol", F.round("z", 6).alias("z"))
