"""Queries of the catalog, the event-study engine and the statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.functions import series as S
from sessionloom.functions import stats
from sessionloom.operators import cube as C
from sessionloom.operators import events as E
from sessionloom.plans.registry import query
from sessionloom.sources.bars import BRANDS_SQL, ORDERS_SQL, bars_of_brands, bars_of_orders, catalog, register, view_name
from sessionloom.sources.bars import query as run_sql

#: The bars with prior close, return and reverse rank.
R_SQL = """r AS (SELECT *, lag(close) OVER w AS pc, close / lag(close) OVER w - 1 AS ret, isodow(date) AS dow,
  row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))"""
ORD, BRA = f"WITH {ORDERS_SQL}, {R_SQL}", f"WITH {BRANDS_SQL}, {R_SQL}"


def r6(df, *columns):
    """The frame with some columns rounded to six digits."""
    return df.select(*(F.round(c, 6).alias(c) if c in columns else c for c in df.columns))


@query("s1_catalog", ORD + " SELECT symbol, lower(symbol) AS view, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM bars GROUP BY symbol")
def _(spark, d):
    return catalog(bars_of_orders(spark, d))


@query("s2_adhoc_sql", ORD + " SELECT symbol, count(*) AS n, round(max(close) / 100000.0, 6) AS top FROM bars WHERE volume > 1 GROUP BY symbol")
def _(spark, d):
    register(spark, bars_of_orders(spark, d), "adhoc_bars")
    return run_sql(spark, "SELECT symbol, count(*) AS n, round(max(to_price(close)), 6) AS top FROM adhoc_bars WHERE volume > :least GROUP BY symbol", least=1)


@query("s6_last_dates", BRA + " SELECT symbol, max(date) AS last_date FROM bars GROUP BY symbol")
def _(spark, d):
    return bars_of_brands(spark, d).groupBy("symbol").agg(F.max("date").alias("last_date"))


@query("s12_stale_symbols", BRA + ", l AS (SELECT symbol, max(date) AS last_date FROM bars GROUP BY symbol) SELECT symbol, last_date FROM l WHERE last_date < (SELECT max(last_date) FROM l) - INTERVAL 1 DAY")
def _(spark, d):
    from sessionloom.sources.normalize import stale_symbols

    return stale_symbols(bars_of_brands(spark, d), 1)


@query("e1_returns", ORD + """ SELECT symbol, date, dow, round(ret, 6) AS ret, lead(date) OVER w AS next_date, round(lead(ret) OVER w, 6) AS next_ret, lead(dow) OVER w AS next_dow
  FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def _(spark, d):
    return r6(E.returns(bars_of_orders(spark, d)), "ret", "next_ret")


@query("e1_returns_function", ORD + """ SELECT date, dow, round(ret, 6) AS ret, lead(date) OVER w AS next_date, round(lead(ret) OVER w, 6) AS next_ret, lead(dow) OVER w AS next_dow
  FROM r WHERE symbol = 'p2' WINDOW w AS (ORDER BY date)""")
def _(spark, d):
    register(spark, bars_of_orders(spark, d))
    return spark.sql("SELECT date, dow, round(ret, 6) AS ret, next_date, round(next_ret, 6) AS next_ret, next_dow FROM returns('p2')")


def _study_sql(where: str, extra: str = "", k: int = 0, h: int = 1, outcome: str | None = None, bars: str = ORD, joins: str = "") -> str:
    base = f"lead(close, {k}) OVER w" if k else "close"
    out = outcome or f"lead(close, {k + h}) OVER w / {base} - 1"
    return f"""{bars}, x AS (SELECT *{extra} FROM r), s AS (SELECT symbol, date AS trigger_date, dow AS trigger_dow, ret AS trigger_ret, lead(date, {k + h}) OVER w AS outcome_date, lead(dow, {k + h}) OVER w AS outcome_dow, {out} AS outcome_ret, * EXCLUDE (symbol, date, dow, ret) FROM x WINDOW w AS (PARTITION BY symbol ORDER BY date))
  SELECT s.symbol, trigger_date, trigger_dow, round(trigger_ret, 6) AS trigger_ret, outcome_date, outcome_dow, round(outcome_ret, 6) AS outcome_ret FROM s {joins} WHERE {where}"""


def _study(spark, d, bars=bars_of_orders, **kw):
    return r6(E.event_study(bars(spark, d), **kw), "trigger_ret", "outcome_ret")


@query("e4_threshold_day_horizon", _study_sql("trigger_ret <= -0.02 AND trigger_dow = 5", h=5))
def _(spark, d):
    return _study(spark, d, threshold=-0.02, day=5, horizon=5)


@query("e4_any_session_pending", _study_sql("TRUE"))
def _(spark, d):
    return _study(spark, d)


_HIT = ", coalesce(close < pc, FALSE) AS hit"


@query("e4_streak_start", f"""{ORD}, x AS (SELECT *{_HIT} FROM r), y AS (SELECT *, hit AND NOT coalesce(lag(hit) OVER w, FALSE) AND coalesce(lead(hit, 1) OVER w, FALSE) AND coalesce(lead(hit, 2) OVER w, FALSE) AS ok,
  lead(date, 3) OVER w AS od, lead(dow, 3) OVER w AS ow, lead(close, 3) OVER w / lead(close, 2) OVER w - 1 AS o FROM x WINDOW w AS (PARTITION BY symbol ORDER BY date))
  SELECT symbol, date AS trigger_date, dow AS trigger_dow, round(ret, 6) AS trigger_ret, od AS outcome_date, ow AS outcome_dow, round(o, 6) AS outcome_ret FROM y WHERE ok""")
def _(spark, d):
    return _study(spark, d, streak=3)


@query("e4_streak_after_gap_up", f"""{ORD}, x AS (SELECT *, coalesce(close > pc AND open > pc, FALSE) AS hit FROM r), y AS (SELECT *, coalesce(lead(hit, 1) OVER w, FALSE) AND coalesce(lead(hit, 2) OVER w, FALSE) AS ok,
  lead(date, 3) OVER w AS od, lead(dow, 3) OVER w AS ow, lead(close, 3) OVER w / lead(close, 2) OVER w - 1 AS o FROM x WINDOW w AS (PARTITION BY symbol ORDER BY date))
  SELECT symbol, date AS trigger_date, dow AS trigger_dow, round(ret, 6) AS trigger_ret, od AS outcome_date, ow AS outcome_dow, round(o, 6) AS outcome_ret FROM y WHERE ok AND ret <= -0.01""")
def _(spark, d):
    return _study(spark, d, streak=2, streak_dir="up", streak_gap="up", streak_anchor="after", threshold=-0.01)


for _field, _expr in (("hi", "lead(high, 2) OVER w / close - 1"), ("lo", "lead(low, 2) OVER w / close - 1"), ("range", "(lead(high, 2) OVER w - lead(low, 2) OVER w) / close")):

    @query(f"e4_measure_{_field}", _study_sql("trigger_ret <= -0.01 AND trigger_date >= DATE '1996-01-01'", h=2, outcome=_expr))
    def _(spark, d, field=_field):
        return _study(spark, d, threshold=-0.01, horizon=2, measure_field=field, since="1996-01-01")


@query("e4_worst_n", _study_sql("TRUE") .replace("WHERE TRUE", "WHERE TRUE QUALIFY row_number() OVER (PARTITION BY s.symbol ORDER BY s.trigger_ret ASC NULLS LAST, trigger_date) <= 20"))
def _(spark, d):
    return _study(spark, d, worst_n=20)


@query("e4_strict_next_dow", _study_sql("outcome_dow = 1 AND trigger_dow = 5"))
def _(spark, d):
    return _study(spark, d, day=5, strict_next_dow=1)


_GATE = "LEFT JOIN (SELECT date, close / 100000.0 AS val, avg_close AS ma FROM (SELECT date, close, sum(close) OVER (ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) / count(*) OVER (ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) / 100000.0 AS avg_close FROM bars WHERE symbol = 'p1')) g ON g.date = trigger_date"


@query("e3_gate_average", _study_sql("trigger_ret <= 0.0 AND g.val > g.ma", joins=_GATE))
def _(spark, d):
    return _study(spark, d, threshold=0.0, when="p1 > p1_50dma")


@query("e3_gate_up_flag", _study_sql("g.ret > 0", joins="LEFT JOIN r g ON g.date = trigger_date AND g.symbol = 'p3'"))
def _(spark, d):
    return _study(spark, d, when="p3_up")


@query("e4_next_session_after_fall", f"""{ORD}, s AS (SELECT symbol, ret, lead(close) OVER w / close - 1 AS o FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date))
  SELECT symbol, count(o) AS n, round(avg(o) * 100, 6) AS mean_pct, round(avg(CAST(o > 0 AS INT)), 6) AS win_rate, round(avg(o) / (stddev_samp(o) / sqrt(count(o))), 6) AS t_stat FROM s WHERE ret <= -0.02 AND o IS NOT NULL GROUP BY symbol""")
def _(spark, d):
    s = E.event_study(bars_of_orders(spark, d), threshold=-0.02).where("outcome_ret is not null")
    return s.groupBy("symbol").agg(F.count("outcome_ret").alias("n"), F.round(F.avg("outcome_ret") * 100, 6).alias("mean_pct"), F.round(stats.win_rate("outcome_ret"), 6).alias("win_rate"), F.round(stats.t_stat("outcome_ret"), 6).alias("t_stat"))


_REGIMES = {"all": "p1 > 0", "p2 rose": "p2_up", "p3 above": "p3 > p3_200dma", "p4 fell before": "p4_ret_prev < 0"}


@query("e5_compare_regimes", f"""{ORD}, s AS (SELECT symbol, date, ret, lead(close) OVER w / close - 1 AS o, lag(ret) OVER w AS rprev, close / 100000.0 AS val, sum(close) OVER m / count(*) OVER m / 100000.0 AS ma FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date), m AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
  g AS (SELECT s.symbol, s.o, a.val > 0 AS c1, b.ret > 0 AS c2, c.val > c.ma AS c3, e.rprev < 0 AS c4 FROM s LEFT JOIN s a ON a.date = s.date AND a.symbol = 'p1' LEFT JOIN s b ON b.date = s.date AND b.symbol = 'p2' LEFT JOIN s c ON c.date = s.date AND c.symbol = 'p3' LEFT JOIN s e ON e.date = s.date AND e.symbol = 'p4' WHERE s.ret <= -0.01 AND s.o IS NOT NULL),
  l AS (SELECT symbol, 'all' AS regime, o FROM g WHERE c1 UNION ALL SELECT symbol, 'p2 rose', o FROM g WHERE c2 UNION ALL SELECT symbol, 'p3 above', o FROM g WHERE c3 UNION ALL SELECT symbol, 'p4 fell before', o FROM g WHERE c4)
  SELECT symbol, regime, count(*) AS n, round(avg(o) * 100, 6) AS mean_pct, round(avg(CAST(o > 0 AS INT)), 6) AS win_rate, round(avg(o) / stddev_pop(o) * sqrt(252), 6) AS sharpe FROM l GROUP BY symbol, regime HAVING stddev_pop(o) > 0""")
def _(spark, d):
    c = E.compare_regimes(bars_of_orders(spark, d), None, _REGIMES, threshold=-0.01)
    return r6(c.where("sharpe is not null").select("symbol", "regime", "n", "mean_pct", "win_rate", "sharpe"), "mean_pct", "win_rate", "sharpe")


@query("e6_sequence", f"""{ORD}, j AS (SELECT a.date, a.close AS c2, b.close AS c3, c.close AS c1 FROM bars a JOIN bars b ON a.date = b.date AND b.symbol = 'p3' JOIN bars c ON c.date = a.date AND c.symbol = 'p1' WHERE a.symbol = 'p2' AND a.date >= DATE '1993-01-01'),
  k AS (SELECT date, isodow(date) AS dow, c1 / lag(c1) OVER w - 1 AS m, coalesce(c2 / lag(c2) OVER w - 1 < 0, FALSE) AS l0, coalesce(c3 / lag(c3) OVER w - 1 > 0, FALSE) AND coalesce(CASE WHEN count(c2) OVER n >= 20 THEN c2 / 100000.0 > sum(c2) OVER n / count(c2) OVER n / 100000.0 END, FALSE) AS l1 FROM j WINDOW w AS (ORDER BY date), n AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
  q AS (SELECT date, dow, l0 AND coalesce(lead(l1) OVER w, FALSE) AS ok, lead(date, 2) OVER w AS md, lead(dow, 2) OVER w AS mw, lead(m, 2) OVER w AS o FROM k WINDOW w AS (ORDER BY date))
  SELECT date AS anchor_date, dow AS anchor_dow, md AS measure_date, mw AS measure_dow, round(o, 6) AS outcome_ret FROM q WHERE ok AND md IS NOT NULL""")
def _(spark, d):
    return r6(E.sequence(bars_of_orders(spark, d), ["p2_down", ["p3_up", "p2 > p2_20dma"]], "p1", since="1993-01-01"), "outcome_ret")


@query("e8_render", f"""{ORD}, s AS (SELECT symbol, date, ret, lead(date) OVER w AS od, lead(close) OVER w / close - 1 AS o FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date))
  SELECT concat_ws(' ', symbol, strftime(date, '%Y-%m-%d'), coalesce(format('{{:+.2f}}%', ret * 100), '?'), coalesce(strftime(od, '%Y-%m-%d'), '?'), coalesce(format('{{:+.2f}}%', o * 100), '?')) AS line FROM s WHERE ret <= -0.05""")
def _(spark, d):
    return E.render(E.event_study(bars_of_orders(spark, d), threshold=-0.05)).select("line")


@query("st1_summary", f"""{BRA} SELECT symbol, count(ret) AS n, round(avg(ret) * 100, 6) AS mean_pct, round(avg(CAST(ret > 0 AS INT)), 6) AS win_rate, round(avg(ret) / stddev_pop(ret) * sqrt(252), 6) AS sharpe, round(avg(ret) / (stddev_samp(ret) / sqrt(count(ret))), 6) AS t_stat, 1.0::DOUBLE AS p_permutation FROM r WHERE ret IS NOT NULL GROUP BY symbol""")
def _(spark, d):
    s = stats.summarize(E.returns(bars_of_brands(spark, d)).where("ret is not null"), "ret", "symbol")
    return r6(s.drop("p_ttest"), "mean_pct", "win_rate", "sharpe", "t_stat")


@query("st2_ttest_pvalue")
def _(spark, d):
    return stats.summarize(E.returns(bars_of_orders(spark, d)).where("ret is not null"), "ret", "symbol").select("symbol", "n", "t_stat", "p_ttest")


@query("st5_bootstrap_ci")
def _(spark, d):
    return stats.bootstrap_ci(E.event_study(bars_of_orders(spark, d), threshold=-0.02), "outcome_ret", "trigger_date", "symbol", draws=2000)


_BINS = ", ".join(f"count(*) FILTER (WHERE ret * 100 >= {lo} AND ret * 100 {'<=' if i == 13 else '<'} {hi})" for i, (lo, hi) in enumerate(zip(stats.EDGES, stats.EDGES[1:])))


@query("st8_histogram", f"{BRA} SELECT symbol, array_to_string([{_BINS}], ',') AS counts FROM r WHERE ret IS NOT NULL GROUP BY symbol")
def _(spark, d):
    return E.returns(bars_of_brands(spark, d)).where("ret is not null").groupBy("symbol").agg(F.concat_ws(",", F.transform(stats.histogram("ret"), lambda x: x.cast("string"))).alias("counts"))


@query("st9_dynamic_histogram", f"{ORD}, e AS (SELECT floor(min(ret * 100)) AS lo, ceil(max(ret * 100)) AS hi FROM r) SELECT CAST(least(floor(ret * 100), greatest(hi - 1, lo)) AS BIGINT) AS bin, count(*) AS n FROM r, e WHERE ret IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return stats.dynamic_histogram(E.returns(bars_of_orders(spark, d)), "ret").select(F.col("bin").cast("long").alias("bin"), "n")


@query("st11_percentile_of_last", f"{BRA}, t AS (SELECT symbol, close, rn FROM r WHERE rn <= 250) SELECT t.symbol, max(l.close) AS last, round(CASE WHEN count(*) >= 30 THEN sum(CAST(t.close < l.close AS INT)) * 100.0 / count(*) END, 6) AS pct FROM t JOIN t l ON l.symbol = t.symbol AND l.rn = 1 GROUP BY t.symbol")
def _(spark, d):
    return r6(stats.percentile_of_last(bars_of_brands(spark, d), "close", 250), "pct")


@query("st13_winsorized_z", f"""{BRA}, e AS (SELECT *, quantile_cont(volume, 0.01) OVER (PARTITION BY date) AS lo, quantile_cont(volume, 0.99) OVER (PARTITION BY date) AS hi FROM bars), c AS (SELECT symbol, date, least(greatest(volume, lo), hi) AS v FROM e)
  SELECT symbol, date, round(CASE WHEN stddev_pop(v) OVER w > 0 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w ELSE 0 END, 5) AS z FROM c WINDOW w AS (PARTITION BY date)""")
def _(spark, d):
    z = stats.winsorized_z(bars_of_brands(spark, d).withColumn("v", F.col("volume").cast("double")), "v", "date")
    return z.select("symbol", "date", F.round("z", 5).alias("z"))


_CONDS = {"none": None, "p1 above": "p1 > p1_50dma", "self above": "{subj} > {subj}_200dma", "p2 fell before": "p2_ret_prev < 0"}
_TRIG = ", ".join(f"('{k}', {'1e9' if v is None else v})" for k, v in C.THRESHOLDS.items())
_CUBE = f"""{ORD}, f AS (SELECT symbol, date, dow, ret, lag(ret) OVER w AS rprev, close / 100000.0 AS val, sum(close) OVER a / count(*) OVER a / 100000.0 AS ma50, sum(close) OVER b / count(*) OVER b / 100000.0 AS ma200, lead(close, 1) OVER w / close - 1 AS o1, lead(close, 5) OVER w / close - 1 AS o5 FROM r
    WINDOW w AS (PARTITION BY symbol ORDER BY date), a AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
  g AS (SELECT f.*, p.val > p.ma50 AS c1, f.val > f.ma200 AS c2, q.rprev < 0 AS c3 FROM f LEFT JOIN f p ON p.date = f.date AND p.symbol = 'p1' LEFT JOIN f q ON q.date = f.date AND q.symbol = 'p2' WHERE f.ret IS NOT NULL),
  h AS (SELECT *, 'none' AS condition FROM g UNION ALL SELECT *, 'p1 above' FROM g WHERE c1 UNION ALL SELECT *, 'self above' FROM g WHERE c2 UNION ALL SELECT *, 'p2 fell before' FROM g WHERE c3),
  d AS (SELECT *, unnest([0, dow]) AS weekday FROM h), o AS (SELECT *, row_number() OVER (PARTITION BY symbol, weekday, condition ORDER BY ret, date) AS place FROM d),
  s AS (SELECT symbol, weekday, condition, trigger, o1, o5 FROM d, (VALUES {_TRIG}) t(trigger, most) WHERE ret <= most UNION ALL SELECT symbol, weekday, condition, trigger, o1, o5 FROM o, (VALUES ('worst20', 20), ('worst50', 50)) t(trigger, most) WHERE place <= most),
  l AS (SELECT symbol, weekday, condition, trigger, 1 AS horizon, o1 * 100 AS v FROM s UNION ALL SELECT symbol, weekday, condition, trigger, 5, o5 * 100 FROM s)
  SELECT symbol AS subject, trigger, CAST(weekday AS INT) AS weekday, condition, CAST(horizon AS INT) AS horizon, count(*) AS n, round(avg(CAST(v > 0 AS INT)) * 100, 6) AS up_pct, round(avg(v), 6) AS mean_pct, round(CASE WHEN stddev_samp(v) > 0 THEN avg(v) / (stddev_samp(v) / sqrt(count(*))) END, 5) AS t,
    array_to_string([{_BINS.replace('ret * 100', 'v')}], ',') AS counts FROM l WHERE v IS NOT NULL GROUP BY ALL HAVING count(*) >= 3"""


@query("x25_cube", _CUBE)
def _(spark, d):
    c = C.cube(bars_of_orders(spark, d), None, _CONDS, ci=False)
    return c.select("subject", "trigger", F.col("weekday").cast("int").alias("weekday"), "condition", "horizon", "n", F.round("up_pct", 6).alias("up_pct"), F.round("mean_pct", 6).alias("mean_pct"), F.round("t", 5).alias("t"), F.concat_ws(",", F.transform("counts", lambda x: x.cast("string"))).alias("counts"))


@query("st7_cube_interval")
def _(spark, d):
    return C.cube(bars_of_orders(spark, d), None, {"none": None}).select("subject", "trigger", "weekday", "horizon", "n", "mean_pct", "ci_lo", "ci_hi")


@query("h2_view_names", "SELECT DISTINCT n_name AS symbol, replace(replace(lower(ltrim(n_name, '^')), '-', '_'), '.', '_') AS view FROM nation")
def _(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("symbol"), view_name(F.col("n_name")).alias("view")).distinct()


@query("h8_packed_series", f"""{ORD}, k AS (SELECT symbol, date, close, date - lag(date) OVER (PARTITION BY symbol ORDER BY date) AS gap FROM bars)
  SELECT symbol, date_diff('day', DATE '1970-01-01', min(date)) AS d0, string_agg(coalesce(gap, 0)::VARCHAR, ',' ORDER BY date) AS gaps, md5(string_agg(close::VARCHAR, ',' ORDER BY date)) AS closes FROM k GROUP BY symbol""")
def _(spark, d):
    from sessionloom.sources.sinks import packed_series

    return packed_series(bars_of_orders(spark, d)).select("symbol", F.col("d0").cast("long").alias("d0"), F.array_join(F.transform("gaps", lambda x: x.cast("string")), ",").alias("gaps"), F.md5(F.array_join(F.transform("closes", lambda x: x.cast("string")), ",")).alias("closes"))
