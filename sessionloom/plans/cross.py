"""Queries of the cross-sectional operators, joins and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.functions import series as S
from sessionloom.operators import cross as X
from sessionloom.plans.registry import query
from sessionloom.plans.studies import BRA, ORD, r6
from sessionloom.sources.bars import BRANDS_SQL, ORDERS_SQL, bars_of_brands, bars_of_orders

_CAL = "cal AS (SELECT DISTINCT date FROM bars WHERE symbol = (SELECT symbol FROM (SELECT symbol, max(date) AS last, count(*) AS n FROM bars GROUP BY symbol) WHERE last = (SELECT last FROM (SELECT last, count(*) AS k FROM (SELECT max(date) AS last FROM bars GROUP BY symbol) GROUP BY last) ORDER BY k DESC, last DESC LIMIT 1) ORDER BY n DESC, symbol LIMIT 1))"


@query("x1_scan_universe", f"{BRA} SELECT DISTINCT symbol FROM bars WHERE symbol IN ('b11', 'b12', 'b23', 'b34') AND symbol <> 'b12'")
def _(spark, d):
    b = bars_of_brands(spark, d)
    named = spark.createDataFrame([("b11",), ("b12",), ("b23",), ("b34",), ("zz",), ("b11",)], "symbol string")
    return X.scan_universe(named, b.select("symbol").distinct(), spark.createDataFrame([("b12",)], "symbol string"))


@query("h5_orphans", f"{BRA} SELECT DISTINCT symbol FROM bars WHERE symbol NOT IN ('b11', 'b12', 'b13')")
def _(spark, d):
    return X.orphans(bars_of_brands(spark, d), spark.createDataFrame([("b11",), ("b12",), ("b13",)], "symbol string"))


@query("x2_calendar", f"{BRA}, {_CAL} SELECT date FROM cal")
def _(spark, d):
    return X.market_calendar(bars_of_brands(spark, d))


@query("x3_breadth", f"""{BRA}, {_CAL}, a AS (SELECT date, close, count(*) OVER (PARTITION BY symbol) AS total, {', '.join(f'CASE WHEN count(*) OVER m{n} >= {n} THEN sum(close) OVER m{n} / count(*) OVER m{n} END AS ma{n}' for n in (20, 50, 200))}, CASE WHEN count(*) OVER y >= 252 THEN close >= max(close) OVER y END AS hi, CASE WHEN count(*) OVER y >= 252 THEN close <= min(close) OVER y END AS lo FROM bars
  WINDOW m20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), m50 AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING), m200 AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING), y AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING)),
  g AS (SELECT date, {', '.join(f'round(avg(CASE WHEN ma{n} IS NOT NULL THEN CAST(close > ma{n} AS INT) END) * 100, 6) AS pct_above_{n}' for n in (20, 50, 200))}, CAST(coalesce(sum(CAST(hi AS INT)), 0) AS BIGINT) AS new_highs, CAST(coalesce(sum(CAST(lo AS INT)), 0) AS BIGINT) AS new_lows, count(*) AS n FROM a WHERE total >= 30 GROUP BY date)
  SELECT cal.date, pct_above_20, pct_above_50, pct_above_200, new_highs, new_lows, new_highs - new_lows AS net_highs, n FROM cal LEFT JOIN g USING (date)""")
def _(spark, d):
    b = bars_of_brands(spark, d)
    return r6(X.breadth(b, X.market_calendar(b)), "pct_above_20", "pct_above_50", "pct_above_200")


@query("x4_index_panel", f"""{BRA} SELECT symbol, max(date) AS as_of, round((max(close) FILTER (WHERE rn = 1) / max(close) FILTER (WHERE rn = 6) - 1) * 100, 6) AS r5, round((max(close) FILTER (WHERE rn = 1) / max(close) FILTER (WHERE rn = 64) - 1) * 100, 6) AS r63, round((max(close) FILTER (WHERE rn = 1) / max(close) FILTER (WHERE rn <= 252) - 1) * 100, 6) AS off_high FROM r GROUP BY symbol HAVING count(*) >= 260""")
def _(spark, d):
    return r6(X.index_panel(bars_of_brands(spark, d)).select("symbol", "as_of", "r5", "r63", "off_high"), "r5", "r63", "off_high")


@query("x5_ratio_series", f"""{BRA}, a AS (SELECT x.date, x.close / y.close AS ratio FROM bars x JOIN bars y ON x.date = y.date AND y.symbol = 'b12' WHERE x.symbol = 'b11'), b AS (SELECT *, ratio / lag(ratio, 21) OVER w - 1 AS r1m, ratio / lag(ratio, 63) OVER w - 1 AS r3m, row_number() OVER (ORDER BY date DESC) AS k FROM a WINDOW w AS (ORDER BY date))
  SELECT 'b11/b12' AS symbol, date, round(ratio, 6) AS ratio, round(r1m, 6) AS r1m, round(r3m, 6) AS r3m, round(CASE WHEN k <= 126 THEN ratio / (SELECT ratio FROM b WHERE k = 126) * 100 END, 6) AS spark_line FROM b""")
def _(spark, d):
    return r6(X.ratio_series(bars_of_brands(spark, d), "b11", "b12"), "ratio", "r1m", "r3m", "spark_line")


_RANK = """rk AS (SELECT *, CASE WHEN v IS NOT NULL THEN (sum(CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY date ORDER BY v NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (count(v) OVER (PARTITION BY date, v) - 1) / 2.0) / count(v) OVER (PARTITION BY date) END AS rank FROM mo)"""


@query("x6_pct_rank", f"{BRA}, mo AS (SELECT symbol, date, volume % 7 AS v FROM bars), {_RANK} SELECT symbol, date, round(rank, 6) AS rank FROM rk")
def _(spark, d):
    b = bars_of_brands(spark, d).select("symbol", "date", (F.col("volume") % 7).alias("v"))
    return b.select("symbol", "date", F.round(X.pct_rank("v", "date"), 6).alias("rank"))


#: Members and the benchmark b11 on one calendar; cohorts by beta and momentum, chained from 100.
_COHORT = f"""{_CAL}, pg AS (SELECT s.symbol, cal.date, b.close, CAST(last_value(b.close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY cal.date) AS DOUBLE) AS p FROM cal CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = cal.date),
  pr AS (SELECT *, p / lag(p) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM pg), bm AS (SELECT date, ret AS b, p AS bp FROM pr WHERE symbol = 'b11'),
  nm AS (SELECT pr.symbol, pr.date, ret, bp, CASE WHEN count(ret + b) OVER f >= 126 THEN covar_samp(ret, b) OVER f / var_samp(b) OVER f END AS beta, lag(close, 21) OVER w / lag(close, 147) OVER w - 1 AS mom, CASE WHEN count(close) OVER m >= 50 THEN close > sum(close) OVER m / 50.0 END AS above FROM pr JOIN bm USING (date) WHERE pr.symbol <> 'b11'
    WINDOW w AS (PARTITION BY pr.symbol ORDER BY pr.date), f AS (PARTITION BY pr.symbol ORDER BY pr.date ROWS 125 PRECEDING), m AS (PARTITION BY pr.symbol ORDER BY pr.date ROWS 49 PRECEDING)),
  rk AS (SELECT *, {', '.join(f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {v} NULLS LAST) + (count(*) OVER (PARTITION BY date, {v}) - 1) / 2.0) / count({v}) OVER (PARTITION BY date) END AS {v}_rank" for v in ("beta", "mom"))} FROM nm),
  hl AS (SELECT *, {', '.join(f"coalesce(lag({c}) OVER (PARTITION BY symbol ORDER BY date), FALSE) AS {n}" for n, c in (("top", "beta_rank >= 0.8"), ("bottom", "beta_rank <= 0.2"), ("lead", "mom_rank >= 0.8")))} FROM rk),
  dy AS (SELECT date, avg(ret) FILTER (WHERE top) AS h, avg(ret) FILTER (WHERE bottom) AS l, avg(ret) FILTER (WHERE lead) AS m, count(*) FILTER (WHERE mom_rank >= 0.8) AS named, avg(CAST(above AS INT)) FILTER (WHERE mom_rank >= 0.8) * 100 AS leaders_above, avg(CAST(above AS INT)) * 100 AS all_above, max(bp) AS bp FROM hl GROUP BY date),
  lv AS (SELECT *, {', '.join(f"100 * exp(sum(ln(1 + coalesce({c}, 0))) OVER o) AS {n}" for n, c in (("high_beta", "h"), ("low_beta", "l"), ("level", "m")))} FROM dy WINDOW o AS (ORDER BY date ROWS UNBOUNDED PRECEDING)), ch AS (SELECT *, high_beta / low_beta AS ratio, level / (bp / 100000.0) AS relative FROM lv)"""


@query("x7_x8_momentum_index", f"{BRA}, {_COHORT} SELECT date, named, round(leaders_above, 6) AS leaders_above, round(all_above, 6) AS all_above, round(level, 6) AS level, round(relative, 6) AS relative FROM ch")
def _(spark, d):
    return r6(X.momentum_cohort(bars_of_brands(spark, d), "b11"), "leaders_above", "all_above", "level", "relative")


@query("x6_beta_cohorts", f"{BRA}, {_COHORT} SELECT date, round(high_beta, 6) AS high_beta, round(low_beta, 6) AS low_beta, round(ratio, 6) AS ratio FROM ch")
def _(spark, d):
    return r6(X.beta_cohorts(bars_of_brands(spark, d), "b11"), "high_beta", "low_beta", "ratio")


@query("x7_momentum_members", f"{BRA}, {_COHORT} SELECT symbol, date FROM rk WHERE mom_rank >= 0.8")
def _(spark, d):
    b = bars_of_brands(spark, d)
    x = X.padded(b, X.market_calendar(b)).where("symbol <> 'b11'")
    c, w = F.col("close").cast("double"), S.by_symbol()
    x = x.withColumn("mom", F.lag(c, 21).over(w) / F.lag(c, 147).over(w) - 1.0)
    return x.withColumn("rank", X.pct_rank("mom", "date")).where(F.col("rank") >= 1 - 0.2).select("symbol", "date")


@query("x6_rolling_beta", f"""{BRA}, j AS (SELECT a.symbol, a.date, a.ret, b.ret AS b FROM r a JOIN r b ON a.date = b.date AND b.symbol = 'b11' WHERE a.symbol <> 'b11' AND a.ret IS NOT NULL AND b.ret IS NOT NULL)
  SELECT symbol, date, round(CASE WHEN count(*) OVER w >= 126 THEN covar_samp(ret, b) OVER w / var_samp(b) OVER w END, 5) AS beta FROM j WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 125 PRECEDING)""")
def _(spark, d):
    r = bars_of_brands(spark, d).select("symbol", "date", S.lag_ret().alias("ret")).where("ret is not null")
    j = r.where("symbol <> 'b11'").join(r.where("symbol = 'b11'").select("date", F.col("ret").alias("b")), "date")
    w = S.frame(126)
    return j.select("symbol", "date", F.round(F.when(F.count("*").over(w) >= 126, F.covar_samp("ret", "b").over(w) / F.var_samp("b").over(w)), 5).alias("beta"))


_MASKS = """vm AS (SELECT symbol, date, volume, close, coalesce(CASE WHEN count(*) OVER y >= 60 THEN volume >= max(volume) OVER y END AND volume > 0, FALSE) AS year_high, coalesce(CASE WHEN count(*) OVER e >= 60 THEN volume >= max(volume) OVER e END AND volume > 0, FALSE) AS ever_high, lag(volume) OVER w AS prior,
    close / lag(close) OVER w - 1 AS chg, max(close) OVER y AS hi52 FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY date), y AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING), e AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
  vx AS (SELECT symbol, date, close, chg, hi52, year_high, ever_high, CASE WHEN count(prior) OVER m >= 20 THEN volume / nullif(median(prior) OVER m, 0) END AS rvol, close / 100000.0 * volume AS dollar, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM vm WINDOW m AS (PARTITION BY symbol ORDER BY date ROWS 50 PRECEDING))"""


@query("x10_volume_masks", f"{BRA}, {_MASKS} SELECT symbol, date, year_high, ever_high, round(rvol, 6) AS rvol FROM vx")
def _(spark, d):
    return r6(X.volume_masks(bars_of_brands(spark, d)).select("symbol", "date", "year_high", "ever_high", "rvol"), "rvol")


@query("x10_no_volume", f"WITH {BRANDS_SQL.replace('bars AS', 'b0 AS', 1)}, bars AS (SELECT * REPLACE (CASE WHEN symbol = 'b11' THEN 0 ELSE volume END AS volume) FROM b0), {_MASKS} SELECT symbol, CAST(sum(CAST(year_high AS INT)) AS BIGINT) AS year_highs, CAST(sum(CAST(ever_high AS INT)) AS BIGINT) AS ever_highs FROM vx GROUP BY symbol")
def _(spark, d):
    b = bars_of_brands(spark, d).withColumn("volume", F.when(F.col("symbol") == "b11", 0).otherwise(F.col("volume")).cast("long"))
    return X.volume_masks(b).groupBy("symbol").agg(*(F.sum(F.col(c).cast("long")).alias(c + "s") for c in ("year_high", "ever_high")))


@query("x12_volume_edge", f"""{BRA}, {_MASKS}, ends AS (SELECT symbol, max(close) FILTER (WHERE k = 1) AS last, max(close) FILTER (WHERE k = 6) AS week FROM vx GROUP BY symbol), h AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS j FROM vx WHERE n >= 65 AND k <= 60 AND year_high AND dollar >= 1000)
  SELECT symbol, date, ever_high, ever_high AND n < 252 AS ipo_high, round(rvol, 6) AS rvol, round(chg, 6) AS chg, round(last / hi52 - 1, 6) AS off_high, round(dollar / 1e6, 6) AS dvol_m, round(last / week - 1, 6) AS r1w FROM h JOIN ends USING (symbol) WHERE j = 1""")
def _(spark, d):
    return r6(X.volume_edge(bars_of_brands(spark, d), 60, 1000), "rvol", "chg", "off_high", "dvol_m", "r1w")


#: Orders' sessions with closes that double in 40 sessions and then rest for 80, of which each session differs a little.
_LEVEL = "100 * pow(2.2, floor((k - 1) / 120)) * pow(2.2, least((k - 1) % 120, 40) / 40.0) * (1 + (volume % 5) / 100.0)"
_RAMP = f"WITH {ORDERS_SQL.replace('bars AS', 'b0 AS', 1)}, b1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM b0), bars AS (SELECT symbol, date, CAST(round({_LEVEL}, 2) * 100000 AS BIGINT) AS close, volume FROM b1)"


def ramped(spark, d):
    b = bars_of_orders(spark, d).withColumn("k", F.row_number().over(S.by_symbol()))
    return b.select("symbol", "date", (F.round(F.expr(_LEVEL), 2) * 100000).cast("long").alias("close"), "volume")


_HS = range(10, 36)
_FLAGS = f"""f0 AS (SELECT symbol, date, CAST(close AS DOUBLE) AS c, volume, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn, CASE WHEN count(*) OVER y >= 252 THEN max(close) OVER y END AS hi, CASE WHEN count(*) OVER r >= 40 THEN min(close) OVER r END AS base FROM bars WINDOW y AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING), r AS (PARTITION BY symbol ORDER BY date ROWS 39 PRECEDING)),
  f1 AS (SELECT *, {', '.join(f"lag(c, {h}) OVER w AS p{h}, lag(hi, {h}) OVER w AS t{h}, lag(c, {h}) OVER w / lag(base, {h}) OVER w - 1 AS g{h}, min(c) OVER (PARTITION BY symbol ORDER BY date ROWS {h - 1} PRECEDING) AS m{h}" for h in _HS)} FROM f0 WINDOW w AS (PARTITION BY symbol ORDER BY date)),
  f2 AS ({' UNION ALL '.join(f"SELECT symbol, date, rn, {h} AS h, g{h} AS g, 1 - m{h} / p{h} AS pull FROM f1 WHERE n >= 292 AND g{h} >= 1.0 AND 1 - m{h} / p{h} <= 0.25 AND p{h} >= t{h} * (1 - 0.05) AND c >= hi * (1 - 0.15)" for h in _HS)}),
  fl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY g DESC, h) AS j FROM f2) WHERE j = 1)"""


@query("x11_tight_flags", f"{_RAMP}, {_FLAGS} SELECT symbol, date, round(g, 6) AS gain, h AS flag, round(pull, 6) AS pull FROM fl")
def _(spark, d):
    return r6(X.tight_flags(ramped(spark, d)), "gain", "pull")


@query("x13_flag_list", f"""{_RAMP.replace('FROM b1)', 'FROM b1 WHERE k <= 780)')}, {_FLAGS}, l AS (SELECT symbol, h, g, pull FROM fl WHERE rn = 1), v AS (SELECT f0.symbol, avg(volume) FILTER (WHERE rn <= h) / avg(volume) FILTER (WHERE rn > h AND rn <= h + 40) AS volratio, max(c) FILTER (WHERE rn = 1) / max(c) FILTER (WHERE rn <= 252) - 1 AS off_high FROM f0 JOIN l USING (symbol) GROUP BY f0.symbol)
  SELECT symbol, round(g, 6) AS gain, h AS flag, round(pull, 6) AS pull, round(volratio, 6) AS volratio, round(off_high, 6) AS off_high FROM l JOIN v USING (symbol)""")
def _(spark, d):
    b = ramped(spark, d).withColumn("k", F.row_number().over(S.by_symbol())).where("k <= 780").drop("k")
    return r6(X.flag_list(b), "gain", "pull", "volratio", "off_high")


@query("x14_counts", f"{_RAMP}, {_CAL}, {_MASKS}, {_FLAGS} SELECT cal.date, coalesce(a.flags, 0) AS flags, coalesce(b.highs, 0) AS volume_highs FROM cal LEFT JOIN (SELECT date, count(*) AS flags FROM fl GROUP BY date) a USING (date) LEFT JOIN (SELECT date, count(*) AS highs FROM vx WHERE year_high AND dollar >= 1000 GROUP BY date) b USING (date)")
def _(spark, d):
    b = ramped(spark, d)
    return X.counts_through_time(b, X.market_calendar(b), 1000)


@query("x15_leaderboard", f"""{BRA}, a AS (SELECT symbol, date, close / lag(close, 5) OVER w - 1 AS r1w, close / lag(close, 21) OVER w - 1 AS r1m, close / lag(close, 63) OVER w - 1 AS r3m, lag(close, 21) OVER w / lag(close, 42) OVER w - 1 AS p, rn, count(*) OVER (PARTITION BY symbol) AS n FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date)),
  b AS (SELECT *, row_number() OVER (ORDER BY r1m DESC NULLS LAST, symbol) AS rank, row_number() OVER (ORDER BY p DESC NULLS LAST, symbol) AS prev_rank FROM a WHERE rn = 1 AND n >= 70) SELECT symbol, round(r1w, 6) AS r1w, round(r1m, 6) AS r1m, round(r3m, 6) AS r3m, rank, prev_rank, prev_rank - rank AS change FROM b""")
def _(spark, d):
    b = bars_of_brands(spark, d)
    x = X.leaderboard(b, b.select("symbol").distinct().withColumn("ordinal", F.col("symbol")))
    return r6(x.select("symbol", "r1w", "r1m", "r3m", *(F.col(c).cast("long").alias(c) for c in ("rank", "prev_rank", "change"))), "r1w", "r1m", "r3m")


_BASKET = "mb AS (SELECT DISTINCT 'g' || symbol[2] AS basket, symbol FROM bars)"


def _members(b):
    return b.select(F.concat(F.lit("g"), F.substring("symbol", 2, 1)).alias("basket"), "symbol").distinct()


@query("x17_basket_pad", f"""{BRA}, {_BASKET}, d AS (SELECT DISTINCT basket, date FROM bars JOIN mb USING (symbol)), g AS (SELECT basket, symbol, date, last_value(close IGNORE NULLS) OVER (PARTITION BY basket, symbol ORDER BY date) AS p FROM d JOIN mb USING (basket) LEFT JOIN bars USING (symbol, date)),
  q AS (SELECT *, p / lag(p) OVER (PARTITION BY basket, symbol ORDER BY date) - 1 AS ret FROM g), y AS (SELECT basket, date, avg(ret) AS ret, count(ret) AS names FROM q GROUP BY ALL) SELECT basket, date, round(ret, 6) AS ret, names FROM y""")
def _(spark, d):
    b = bars_of_brands(spark, d)
    return X.equal_weight_baskets(b, _members(b)).select("basket", "date", F.round("ret", 6).alias("ret"), "names")


@query("x17_basket_no_fill", f"""{BRA}, {_BASKET}, q AS (SELECT basket, date, ret FROM r JOIN mb USING (symbol)), y AS (SELECT basket, date, avg(ret) AS ret, count(ret) AS names FROM q GROUP BY ALL) SELECT basket, date, round(ret, 6) AS ret, names FROM y""")
def _(spark, d):
    b = bars_of_brands(spark, d)
    return X.equal_weight_baskets(b, _members(b), fill="none").select("basket", "date", F.round("ret", 6).alias("ret"), "names")


@query("x26_composition", f"{BRA}, {_BASKET} SELECT basket, symbol, min(date) AS first_date, round(arg_max(close, date) / 100000.0, 6) AS last_close, round(arg_max(ret, date), 6) AS last_ret FROM r JOIN mb USING (symbol) GROUP BY ALL")
def _(spark, d):
    b = bars_of_brands(spark, d)
    return r6(X.composition(b, _members(b)), "last_close", "last_ret")


@query("x29_full_dates", f"{BRA}, {_BASKET} SELECT basket, max(f) AS full_date FROM (SELECT basket, symbol, min(date) AS f FROM bars JOIN mb USING (symbol) GROUP BY ALL) GROUP BY basket")
def _(spark, d):
    b = bars_of_brands(spark, d)
    return X.full_dates(b, _members(b))


@query("x30_theme_tags", f"{BRA}, {_BASKET}, t AS (SELECT * FROM mb UNION SELECT 'all', symbol FROM mb) SELECT symbol, string_agg(basket, ',' ORDER BY basket) AS tags FROM t GROUP BY symbol")
def _(spark, d):
    m = _members(bars_of_brands(spark, d))
    return X.theme_tags(m.unionByName(m.withColumn("basket", F.lit("all")))).select("symbol", F.array_join("tags", ",").alias("tags"))


LEDGER = {"init": ("1996-01-04", ["p1", "p2", "p3"]), "swaps": [("1997-03-05", [("p1", "p4"), ("p9", "p5")]), ("1998-06-01", [("p4", "p1"), ("p2", "p3")])]}
_HELD = "held AS (SELECT * FROM (VALUES ('p1', DATE '1996-01-04', DATE '1997-03-05'), ('p4', DATE '1997-03-05', DATE '1998-06-01'), ('p2', DATE '1996-01-04', DATE '1998-06-01'), ('p3', DATE '1998-06-01', NULL), ('p5', DATE '1997-03-05', NULL), ('p1', DATE '1998-06-01', NULL)) t(symbol, entry, \"exit\"))"


@query("x22_ledger", f'WITH {_HELD} SELECT symbol, entry, "exit" FROM held')
def _(spark, d):
    return X.instances(spark, LEDGER)


@query("x24_j4_realized", f"""{ORD}, {_HELD}, e AS (SELECT h.*, coalesce("exit", (SELECT max(date) FROM bars b WHERE b.symbol = h.symbol)) AS until FROM held h)
  SELECT e.symbol, entry, "exit", (SELECT arg_max(close, date) FROM bars b WHERE b.symbol = e.symbol AND b.date <= e.entry) / 100000.0 AS entry_price, (SELECT arg_max(close, date) FROM bars b WHERE b.symbol = e.symbol AND b.date <= e.until) / 100000.0 AS exit_price FROM e""")
def _(spark, d):
    return X.realized(X.instances(spark, LEDGER), bars_of_orders(spark, d)).drop("ret_pct")


@query("x23_ledger_index", f"""{ORD}, {_HELD}, dd AS (SELECT DISTINCT date FROM bars WHERE symbol IN (SELECT symbol FROM held) AND date >= DATE '1996-01-04'), k AS (SELECT h.*, dd.date, CASE WHEN "exit" < dd.date THEN "exit" ELSE dd.date END AS mark FROM held h JOIN dd ON dd.date >= h.entry),
  a AS (SELECT k.date, k.symbol, k.entry, b.close AS m FROM k ASOF JOIN bars b ON k.symbol = b.symbol AND k.mark >= b.date), h2 AS (SELECT DISTINCT h.symbol, h.entry, b.close AS e FROM held h ASOF JOIN bars b ON h.symbol = b.symbol AND h.entry >= b.date)
  SELECT date, round(100 * (1 + sum(m / e - 1) / 5), 6) AS level FROM a JOIN h2 USING (symbol, entry) GROUP BY date""")
def _(spark, d):
    return r6(X.ledger_index(X.instances(spark, LEDGER), bars_of_orders(spark, d)), "level")


@query("j5_forward_as_of", f"{ORD}, t AS (SELECT DISTINCT symbol, CAST(date_trunc('month', date) AS DATE) AS day FROM bars) SELECT t.symbol, day, min(b.date) AS session FROM t JOIN bars b ON b.symbol = t.symbol AND b.date >= day GROUP BY ALL")
def _(spark, d):
    b = bars_of_orders(spark, d)
    t = b.select("symbol", F.trunc("date", "MM").alias("day")).distinct()
    return S.as_of_forward(t, b.select("symbol", "date"), "day")


@query("j7_forward_fill", f"""{ORD}, g AS (SELECT s.symbol, c.date, b.close FROM (SELECT DISTINCT date FROM bars) c CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = c.date) SELECT symbol, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date) AS close FROM g""")
def _(spark, d):
    b = bars_of_orders(spark, d)
    return S.on_calendar(b.select("symbol", "date", "close"), b.select("date")).select("symbol", "date", S.last_known("close").alias("close"))


@query("x18_factor_scores", f"""{BRA}, rows AS (SELECT date, row_number() OVER (ORDER BY date) AS row FROM (SELECT DISTINCT date FROM bars)), g AS (SELECT s.symbol, rows.date, row, close FROM rows CROSS JOIN (SELECT DISTINCT symbol FROM bars WHERE symbol <> 'b11') s LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = rows.date)
  SELECT symbol, date, round(lag(close, 21) OVER w / lag(close, 252) OVER w - 1, 6) AS mom121, round(close / lag(close, 21) OVER w - 1, 6) AS mom1, round(close / max(close) OVER y - 1, 6) AS offhigh FROM g WINDOW w AS (PARTITION BY symbol ORDER BY date), y AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING)""")
def _(spark, d):
    b = bars_of_brands(spark, d)
    return r6(X.factor_scores(b, b.select("date"), "b11").select("symbol", "date", "mom121", "mom1", "offhigh"), "mom121", "mom1", "offhigh")


def _picks(spark, d):
    b = bars_of_brands(spark, d)
    s = X.factor_scores(b, b.select("date"), "b11")
    return s, X.rebalance_picks(s, names=5, min_dollar=0.0, min_share=0.3)


#: Scores of all eight factors on the calendar of all dates, month-end picks and their sides; z in both ways.
_NEED = {"mom121": 252, "mom12": 252, "mom1": 21, "offhigh": 252, "vol": 63, "beta": 252, "ddepth": 252, "trend": 200}
_ZC = lambda name, over: f"CASE WHEN stddev_pop(c) OVER ({over}) > 0 THEN (c - avg(c) OVER ({over})) / stddev_pop(c) OVER ({over}) ELSE 0 END AS {name}"
_CLIP = "SELECT *, least(greatest(raw, quantile_cont(raw, 0.01) OVER (PARTITION BY factor, row)), quantile_cont(raw, 0.99) OVER (PARTITION BY factor, row)) AS c FROM"
_FAC = f"""fr AS (SELECT date, row_number() OVER (ORDER BY date) AS row FROM (SELECT DISTINCT date FROM bars)), fg AS (SELECT s.symbol, fr.date, fr.row, CAST(b.close AS DOUBLE) AS close, CAST(b.adj_close AS DOUBLE) AS adj, b.close / 100000.0 * b.volume AS dv FROM fr CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = fr.date),
  fs AS (SELECT *, close / lag(close) OVER w - 1 AS ret, adj / lag(adj) OVER w - 1 AS ret_adj FROM fg WINDOW w AS (PARTITION BY symbol ORDER BY row)), fb AS (SELECT row, ret AS b FROM fs WHERE symbol = 'b11'),
  fx AS (SELECT fs.*, b, min(CASE WHEN close IS NOT NULL THEN fs.row END) OVER (PARTITION BY symbol) AS first_row, CASE WHEN count(dv) OVER d20 >= 10 THEN median(dv) OVER d20 END AS dollar, lag(close, 21) OVER w / lag(close, 252) OVER w - 1 AS mom121, close / lag(close, 252) OVER w - 1 AS mom12, close / lag(close, 21) OVER w - 1 AS mom1, close / max(close) OVER y - 1 AS offhigh,
    stddev_pop(ret) OVER v * sqrt(252) AS vol, covar_pop(ret, b) OVER y / nullif(var_pop(b) OVER y, 0) AS beta, (close / avg(close) OVER d20 + close / avg(close) OVER d50 + close / avg(close) OVER d200) / 3 - 1 AS trend, list(close) OVER y AS closes FROM fs LEFT JOIN fb USING (row) WHERE symbol <> 'b11'
    WINDOW w AS (PARTITION BY symbol ORDER BY fs.row), y AS (PARTITION BY symbol ORDER BY fs.row ROWS 251 PRECEDING), v AS (PARTITION BY symbol ORDER BY fs.row ROWS 62 PRECEDING), d20 AS (PARTITION BY symbol ORDER BY fs.row ROWS 19 PRECEDING), d50 AS (PARTITION BY symbol ORDER BY fs.row ROWS 49 PRECEDING), d200 AS (PARTITION BY symbol ORDER BY fs.row ROWS 199 PRECEDING)),
  fe AS (SELECT row FROM (SELECT date_trunc('month', date) AS m, max(row) AS row FROM fr GROUP BY m) WHERE row < (SELECT max(row) FROM fr)),
  fd AS (SELECT * EXCLUDE (closes), list_min([c / list_max(closes[:i]) - 1 FOR c, i IN list_filter(closes, lambda x: x IS NOT NULL)]) AS ddepth FROM (SELECT * REPLACE (list_filter(closes, lambda x: x IS NOT NULL) AS closes) FROM fx JOIN fe USING (row))),
  fo AS (SELECT *, close / 100000.0 >= 1 AND dollar >= 0 AS fit FROM fd), fm AS (SELECT row FROM fo GROUP BY row HAVING count(*) FILTER (WHERE fit AND first_row <= row - 252) >= 0.3 * (SELECT count(DISTINCT symbol) FROM fo)),
  fa AS (SELECT * FROM ({' UNION ALL '.join(f"SELECT symbol, date, row, fit, '{k}' AS factor, {k} AS raw FROM fo JOIN fm USING (row) WHERE first_row <= row - {n}" for k, n in _NEED.items())}) WHERE raw IS NOT NULL),
  fc AS ({_CLIP} fa WHERE fit), fz AS (SELECT *, {_ZC("z", "PARTITION BY factor, row")} FROM fc), fp AS (SELECT *, row_number() OVER (PARTITION BY factor, row ORDER BY round(z, 9) DESC, symbol) AS place, count(*) OVER (PARTITION BY factor, row) AS n FROM fz),
  pk AS (SELECT factor, date, row, symbol, z, CASE WHEN place <= least(5, n // 2) THEN 'hi' WHEN place > n - least(5, n // 2) THEN 'lo' END AS side FROM fp)"""


@query("x19_x20_rebalance_picks", f"{BRA}, {_FAC} SELECT factor, date, row, symbol, round(z, 5) AS z, side FROM pk WHERE side IS NOT NULL")
def _(spark, d):
    return _picks(spark, d)[1].withColumn("row", F.col("row").cast("long")).withColumn("z", F.round("z", 5))


@query("k4_factor_snapshot", f"""{BRA}, {_FAC}, la AS (SELECT factor, max(row) AS row FROM pk WHERE side IS NOT NULL GROUP BY factor), sc AS ({_CLIP} fa JOIN la USING (factor, row)), sz AS (SELECT *, {_ZC("z_snapshot", "PARTITION BY factor")}, count(*) OVER (PARTITION BY factor) AS scored FROM sc)
  SELECT pk.factor, side, pk.symbol, round(z_snapshot, 2) AS z_snapshot, scored, count(*) OVER (PARTITION BY pk.factor, side) AS per_side, pk.date FROM pk JOIN la USING (factor, row) JOIN sz ON sz.factor = pk.factor AND sz.symbol = pk.symbol WHERE side IS NOT NULL""")
def _(spark, d):
    return X.factor_snapshot(*_picks(spark, d))


@query("x21_factor_levels", f"""{BRA}, {_FAC}, rw AS (SELECT factor, row, coalesce(lead(row) OVER (PARTITION BY factor ORDER BY row), (SELECT max(row) FROM fr)) AS nxt FROM (SELECT DISTINCT factor, row FROM pk WHERE side IS NOT NULL)),
  dy AS (SELECT pk.factor, side, fs.date, avg(ret) AS ret, avg(ret_adj) AS ret_adj FROM pk JOIN rw USING (factor, row) JOIN fs ON fs.symbol = pk.symbol AND fs.row > pk.row AND fs.row <= nxt WHERE side IS NOT NULL GROUP BY ALL),
  al AS (SELECT * FROM dy UNION ALL SELECT factor, 'ls', date, h.ret - l.ret, h.ret - l.ret FROM (SELECT * FROM dy WHERE side = 'hi') h JOIN (SELECT * FROM dy WHERE side = 'lo') l USING (factor, date))
  SELECT 'fac_' || factor || '_' || side AS id, factor, side, date, sign(product(1 + ret) OVER o) * round(ln(abs(100 * product(1 + ret) OVER o)), 6) AS level, sign(product(1 + coalesce(ret_adj, 0)) OVER o) * round(ln(abs(100 * product(1 + coalesce(ret_adj, 0)) OVER o)), 6) AS adj_level FROM al WHERE ret IS NOT NULL WINDOW o AS (PARTITION BY factor, side ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    # the noise of these tables compounds beyond any scale: the signed logarithm of the levels
    x = X.factor_levels(*_picks(spark, d))
    return x.select("id", "factor", "side", "date", *((F.signum(c) * F.round(F.log(F.abs(c)), 6)).alias(c) for c in ("level", "adj_level")))


@query("x33_validate", f"""{BRA}, g AS (SELECT symbol, count(*) AS n, count(*) - count(DISTINCT date) AS dup_dates, CAST(sum(CAST(open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 AS INT)) AS BIGINT) AS bad_prices, CAST(sum(CAST(high < low OR high < greatest(open, close) OR low > least(open, close) AS INT)) AS BIGINT) AS inverted, CAST(sum(CAST(high = low AS INT)) AS BIGINT) AS flat, max(gap) AS max_gap, max(date) AS last_date
  FROM (SELECT *, date - lag(date) OVER (PARTITION BY symbol ORDER BY date) AS gap FROM bars) GROUP BY symbol), ref AS (SELECT last_date AS reference FROM (SELECT last_date, count(*) AS k FROM g GROUP BY last_date) ORDER BY k DESC, last_date DESC LIMIT 1)
  SELECT symbol, n, dup_dates, bad_prices, inverted, flat, CAST(max_gap AS INT) AS max_gap, last_date, last_date < reference - 3 AS stale, max_gap > 10 AS gapped, flat > 0.95 * n AS flat_series FROM g, ref""")
def _(spark, d):
    return X.validate(bars_of_brands(spark, d), gaps={})


@query("x33_verdict", f"""{BRA}, g AS (SELECT symbol, count(*) - count(DISTINCT date) AS dup_dates, sum(CAST(open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 AS INT)) AS bad_prices, sum(CAST(high < low OR high < greatest(open, close) OR low > least(open, close) AS INT)) AS inverted, max(gap) AS max_gap, max(date) AS last_date FROM (SELECT *, date - lag(date) OVER (PARTITION BY symbol ORDER BY date) AS gap FROM bars) GROUP BY symbol),
  ref AS (SELECT last_date AS reference FROM (SELECT last_date, count(*) AS k FROM g GROUP BY last_date) ORDER BY k DESC, last_date DESC LIMIT 1), t AS (SELECT count(*) AS files, CAST(sum(dup_dates) AS BIGINT) AS dups, CAST(sum(bad_prices) AS BIGINT) AS bad, CAST(sum(inverted) AS BIGINT) AS inverted, CAST(sum(CAST(last_date < reference - 3 AS INT)) AS BIGINT) AS stale, CAST(sum(CAST(max_gap > 10 AS INT)) AS BIGINT) AS gapped, 0 AS core_stale FROM g, ref)
  SELECT *, dups > 0 OR bad > 0 OR inverted > 0 OR stale > 0.02 * files OR gapped > 0.02 * files AS failed FROM t""")
def _(spark, d):
    return X.verdict(X.validate(bars_of_brands(spark, d), gaps={}))
