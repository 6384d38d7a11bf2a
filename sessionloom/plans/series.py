"""Queries of the analytics of single series."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from sessionloom.functions import series as S
from sessionloom.functions import stats
from sessionloom.operators import analytics as A
from sessionloom.plans.registry import query
from sessionloom.plans.studies import BRA, ORD, r6
from sessionloom.sources.bars import bars_of_brands, bars_of_orders
from sessionloom.sources.normalize import normalize

_GAP = "g AS (SELECT symbol, date, (open - pc) / pc AS gap, (close - open) / open AS otc, lead(close) OVER w / close - 1 AS nr, CASE WHEN (open - pc) / pc > 0 THEN low < pc ELSE high > pc END AS filled, pc FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date))"


@query("a1_gap_features", f"{ORD}, {_GAP} SELECT symbol, date, round(gap, 6) AS gap, round(otc, 6) AS open_to_close, round(nr, 6) AS next_ret, filled FROM g WHERE pc IS NOT NULL")
def _(spark, d):
    return r6(A.gap_features(bars_of_orders(spark, d)), "gap", "open_to_close", "next_ret")


@query("a2_gap_buckets", f"""{ORD}, {_GAP}, b AS (SELECT *, CASE WHEN gap <= -0.02 THEN 'down 2 % or more' WHEN gap <= -0.01 THEN 'down 1 to 2 %' WHEN gap <= -0.005 THEN 'down 0.5 to 1 %' WHEN gap > 0.02 THEN 'up 2 % or more' WHEN gap > 0.01 THEN 'up 1 to 2 %' WHEN gap > 0.005 THEN 'up 0.5 to 1 %' END AS bucket FROM g WHERE pc IS NOT NULL AND abs(gap) >= 0.005)
  SELECT bucket, count(*) AS n, round(avg(otc) * 100, 6) AS mean_pct, round(avg(CAST(otc > 0 AS INT)), 6) AS win_rate, round(avg(CAST(filled AS INT)), 6) AS fill_rate, round(avg(gap) * 100, 6) AS mean_gap_pct FROM b WHERE bucket IS NOT NULL GROUP BY bucket HAVING count(*) >= 10""")
def _(spark, d):
    return r6(A.gap_study(bars_of_orders(spark, d)), "mean_pct", "win_rate", "fill_rate", "mean_gap_pct")


_VOL = "v AS (SELECT symbol, date, CASE WHEN count(volume) OVER n >= 50 THEN volume / (sum(volume) OVER n / count(volume) OVER n) END AS ratio, lead(close, 5) OVER w / close - 1 AS fwd5, lead(close, 10) OVER w / close - 1 AS fwd10, lead(close, 20) OVER w / close - 1 AS fwd20 FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date), n AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"


@query("a3_low_volume", f"{BRA}, {_VOL} SELECT symbol, date, round(ratio, 6) AS ratio, round(fwd5, 6) AS fwd5, round(fwd10, 6) AS fwd10, round(fwd20, 6) AS fwd20, ratio < 0.5 AS low_volume FROM v WHERE ratio IS NOT NULL")
def _(spark, d):
    return r6(A.volume_signals(bars_of_brands(spark, d)), "ratio", "fwd5", "fwd10", "fwd20")


@query("a4_low_volume_study", f"""{BRA}, {_VOL}, s AS (SELECT *, ratio < 0.5 AS low FROM v WHERE ratio IS NOT NULL), l AS (SELECT low, 5 AS horizon, fwd5 AS ret FROM s UNION ALL SELECT low, 10, fwd10 FROM s UNION ALL SELECT low, 20, fwd20 FROM s)
  SELECT horizon, count(*) FILTER (WHERE low) AS n, count(*) FILTER (WHERE low) AS episodes, round(avg(ret) FILTER (WHERE low) * 100, 6) AS mean_pct, round(avg(CAST(ret > 0 AS INT)) FILTER (WHERE low), 6) AS win_rate, round(avg(ret) * 100, 6) AS base_mean_pct, round(avg(CAST(ret > 0 AS INT)), 6) AS base_win_rate FROM l WHERE ret IS NOT NULL GROUP BY horizon""")
def _(spark, d):
    return r6(A.volume_study(bars_of_brands(spark, d)), "mean_pct", "win_rate", "base_mean_pct", "base_win_rate")


@query("a5_betas", f"""{BRA}, j AS (SELECT a.symbol, a.date, a.ret, b.ret AS b, row_number() OVER (PARTITION BY a.symbol ORDER BY a.date DESC) AS k, max(a.date) OVER (PARTITION BY a.symbol) AS last FROM r a JOIN r b ON a.date = b.date AND b.symbol = 'b11' WHERE a.symbol <> 'b11' AND a.ret IS NOT NULL AND b.ret IS NOT NULL),
  x AS (SELECT *, 'full' AS "window" FROM j UNION ALL SELECT *, 'ytd' FROM j WHERE year(date) = year(last) UNION ALL SELECT *, '252' FROM j WHERE k <= 252 UNION ALL SELECT *, '504' FROM j WHERE k <= 504 UNION ALL SELECT *, '756' FROM j WHERE k <= 756 UNION ALL SELECT *, '1260' FROM j WHERE k <= 1260)
  SELECT symbol, "window", count(*) AS n_obs, min(date) AS sample_start, max(date) AS sample_end, round(CASE WHEN count(*) >= 60 THEN covar_samp(ret, b) / var_samp(b) END, 6) AS beta, round(CASE WHEN count(*) >= 60 THEN corr(ret, b) END, 6) AS corr, round(CASE WHEN count(*) >= 60 THEN avg(ret) - covar_samp(ret, b) / var_samp(b) * avg(b) END, 6) AS alpha_daily, round(CASE WHEN count(*) >= 60 THEN stddev_samp(ret) * sqrt(252) END, 6) AS stock_vol_ann FROM x GROUP BY symbol, "window" """)
def _(spark, d):
    return r6(A.beta_table(bars_of_brands(spark, d), "b11"), "beta", "corr", "alpha_daily", "stock_vol_ann").select("symbol", "window", "n_obs", "sample_start", "sample_end", "beta", "corr", "alpha_daily", "stock_vol_ann")


@query("a6_cycle_signals", f"""{ORD}, a AS (SELECT symbol, date, close, ret, CASE WHEN count(*) OVER m >= 100 THEN sum(close) OVER m / count(*) OVER m / 100000.0 END AS ma, close / max(close) OVER p - 1 AS dd FROM r WINDOW m AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 755 PRECEDING AND CURRENT ROW)),
  b AS (SELECT *, (ma / lag(ma, 21) OVER (PARTITION BY symbol ORDER BY date) - 1) * (252.0::DOUBLE / 21) AS slope FROM a),
  c AS (SELECT *, CASE WHEN slope > 0.05 AND close / 100000.0 >= ma THEN 'Markup' WHEN slope < -0.05 AND NOT close / 100000.0 >= ma THEN 'Markdown' WHEN ma IS NOT NULL AND dd >= -0.10 THEN 'Distribution' WHEN ma IS NOT NULL THEN 'Accumulation' END AS raw FROM b)
  SELECT symbol, date, round(ma, 6) AS ma, round(slope, 6) AS slope, round(dd, 6) AS dd, coalesce(raw, first_value(raw IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS phase FROM c""")
def _(spark, d):
    return r6(A.cycle_signals(bars_of_orders(spark, d)).select("symbol", "date", "ma", "slope", "dd", "phase"), "ma", "slope", "dd")


@query("a7_cycles")
def _(spark, d):
    return A.cycles(bars_of_orders(spark, d)).select("symbol", "date", "phase")


@query("a8_segments", f"""{ORD}, a AS (SELECT symbol, date, close, CASE WHEN ret > 0 THEN 'up' ELSE 'down' END AS phase FROM r), b AS (SELECT *, CAST(coalesce(lag(phase) OVER w <> phase, TRUE) AS INT) AS c FROM a WINDOW w AS (PARTITION BY symbol ORDER BY date)), e AS (SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY date) AS run FROM b)
  SELECT symbol, phase, min(date) AS start, max(date) AS "end", count(*) AS days, round(arg_max(close, date) / arg_min(close, date) - 1, 6) AS ret FROM e GROUP BY symbol, run, phase""")
def _(spark, d):
    x = bars_of_orders(spark, d).withColumn("ret", S.lag_ret()).select("symbol", "date", F.col("close").cast("double").alias("close"), F.when(F.col("ret") > 0, "up").otherwise("down").alias("phase"))
    g = A.segments(x.withColumn("vol", F.lit(0.0)))
    close = x.select("symbol", "date", "close")
    g = g.join(close.select("symbol", F.col("date").alias("start"), F.col("close").alias("a")), ["symbol", "start"]).join(close.select("symbol", F.col("date").alias("end"), F.col("close").alias("b")), ["symbol", "end"])
    return g.select("symbol", "phase", "start", "end", "days", F.round(F.col("b") / F.col("a") - 1, 6).alias("ret"))


@query("a8_phase_summary")
def _(spark, d):
    return A.phase_summary(A.segments(A.cycles(bars_of_orders(spark, d))))


@query("a9_phase_matrix")
def _(spark, d):
    return A.phase_matrix(A.cycle_signals(bars_of_orders(spark, d)))


@query("a26_weekly_closes", f"{ORD} SELECT symbol, CAST(date + CAST((5 - isodow(date) + 7) % 7 AS INT) AS DATE) AS week, arg_max(close, date) AS close FROM bars GROUP BY ALL")
def _(spark, d):
    return A.weekly_closes(bars_of_orders(spark, d))


_DD = """t AS (SELECT symbol, date, close, max(close) OVER w AS top, lag(date) OVER w AS prior, lead(date) OVER w AS nxt FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)), u AS (SELECT *, close / top - 1 AS dd, sum(CAST(close = top AS INT)) OVER (PARTITION BY symbol ORDER BY date) AS run FROM t),
  e AS (SELECT symbol, run, min(dd) AS dd, min(prior) AS peak, arg_max(nxt, date) FILTER (WHERE nxt IS NOT NULL OR date = lastd) AS rec0 FROM (SELECT *, max(date) OVER (PARTITION BY symbol) AS lastd FROM u) WHERE dd < 0 GROUP BY symbol, run),
  f AS (SELECT symbol, run, min(date) AS trough FROM u JOIN e USING (symbol, run) WHERE u.dd = e.dd GROUP BY symbol, run),
  q AS (SELECT symbol, run, CASE WHEN max(date) < any_value(lastd) THEN max(nxt) END AS rec FROM (SELECT *, max(date) OVER (PARTITION BY symbol) AS lastd FROM u) WHERE dd < 0 GROUP BY symbol, run),
  z AS (SELECT e.symbol, -e.dd AS depth, peak, trough, date_diff('day', peak, trough) AS p2t, date_diff('day', trough, rec) AS rec FROM e JOIN f USING (symbol, run) JOIN q USING (symbol, run) WHERE e.dd <= -0.03)"""


@query("a28_drawdowns", f"{BRA}, {_DD} SELECT symbol, round(depth, 6) AS depth, peak, trough, p2t, rec FROM z")
def _(spark, d):
    x = A.drawdowns(bars_of_brands(spark, d))
    return r6(x.withColumn("p2t", F.col("p2t").cast("long")).withColumn("rec", F.col("rec").cast("long")), "depth")


@query("a29_a30_drawdown_distribution", f"{BRA}, {_DD}, s AS (SELECT unnest([{', '.join(str(k / 20) for k in range(1, 20))}]::DOUBLE[]) AS at_least), c AS (SELECT symbol, count(*) AS total FROM z GROUP BY symbol) SELECT z.symbol, at_least, count(*) AS n, round(count(*) / max(total), 6) AS share, count(DISTINCT year(trough)) AS years, max(trough) AS last, list_sort(list(p2t))[count(*) // 2 + 1] AS median_p2t FROM z JOIN s ON depth >= at_least JOIN c ON c.symbol = z.symbol GROUP BY ALL")
def _(spark, d):
    x = A.drawdown_distribution(A.drawdowns(bars_of_brands(spark, d)))
    return r6(x.withColumn("median_p2t", F.col("median_p2t").cast("long")), "share")


@query("a31_rsi")
def _(spark, d):
    return r6(A.rsi(bars_of_brands(spark, d)), "rsi7", "rsi14", "rsi21")


@query("a32_seasonality", f"""{BRA}, m AS (SELECT symbol, last_day(date) AS month, arg_max(adj_close, date) AS p FROM bars GROUP BY ALL), n AS (SELECT symbol, month, p / lag(p) OVER (PARTITION BY symbol ORDER BY month) - 1 AS ret FROM m), a AS (SELECT *, month(month) AS mm, count(*) OVER (PARTITION BY symbol) AS c FROM n WHERE ret IS NOT NULL),
  b AS (SELECT *, quantile_cont(ret, 0.1) OVER w AS lo, quantile_cont(ret, 0.9) OVER w AS hi FROM a WHERE c >= 12 WINDOW w AS (PARTITION BY symbol, mm)) SELECT symbol, CAST(mm AS INT) AS month, round(avg(least(greatest(ret, lo), hi)) * 100, 6) AS mean_pct, count(*) AS n FROM b GROUP BY symbol, mm""")
def _(spark, d):
    return r6(A.seasonality(bars_of_brands(spark, d)), "mean_pct")


@query("a33_horizon_returns", f"""{BRA}, l AS (SELECT *, max(date) OVER (PARTITION BY symbol) AS last FROM r) SELECT symbol, max(date) AS as_of, {', '.join(f'round((max(close) FILTER (WHERE rn = 1) / max(close) FILTER (WHERE rn = {k + 1}) - 1) * 100, 6) AS r{k}' for k in (1, 5, 21, 63, 126, 252, 756, 1260))},
  round((max(close) FILTER (WHERE rn = 1) / arg_max(close, date) FILTER (WHERE year(date) < year(last)) - 1) * 100, 6) AS ytd FROM l GROUP BY symbol""")
def _(spark, d):
    x = A.horizon_returns(bars_of_brands(spark, d))
    return r6(x, *x.columns[2:])


_RV = {f"rv{k}": str(k) for k in (1, 5, 21, 63, 126, 252, 756, 1260)} | {"rvytd": "ytd"}


@query("a34_relative_volume", f"{BRA}, z AS (SELECT *, count(*) OVER s AS n, sum(CAST(year(date) = year(last) AS INT)) OVER s AS ytd FROM (SELECT *, max(date) OVER (PARTITION BY symbol) AS last FROM r) WINDOW s AS (PARTITION BY symbol)) SELECT symbol, " + ", ".join(f"round(CASE WHEN max(n - {k}) >= 0 AND count(*) FILTER (WHERE rn > {k} AND rn <= {k} + 252 AND volume > 0) >= 20 THEN avg(volume) FILTER (WHERE rn <= {k} AND volume > 0) / avg(volume) FILTER (WHERE rn > {k} AND rn <= {k} + 252 AND volume > 0) END, 6) AS {c}" for c, k in _RV.items()) + " FROM z GROUP BY symbol")
def _(spark, d):
    return r6(A.relative_volume(bars_of_brands(spark, d)), *_RV)


@query("a35_leader_rows", f"""{BRA}, g AS (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY date) AS lr FROM r) SELECT symbol, max(date) AS as_of, round(max(close) FILTER (WHERE rn = 1) / 100000.0, 6) AS close, round(CASE WHEN count(*) >= 60 THEN (max(close) FILTER (WHERE rn = 1) / max(close) FILTER (WHERE rn <= 252) - 1) * 100 END, 6) AS off52, round(CASE WHEN count(*) >= 60 THEN (max(close) FILTER (WHERE rn = 1) / min(close) FILTER (WHERE rn <= 252) - 1) * 100 END, 6) AS up52,
  round(CASE WHEN count(*) >= 50 THEN (max(close) FILTER (WHERE rn = 1) / (sum(close) FILTER (WHERE rn <= 50) / 50) - 1) * 100 END, 6) AS ma50, round(CASE WHEN count(*) >= 200 THEN (max(close) FILTER (WHERE rn = 1) / (sum(close) FILTER (WHERE rn <= 200) / 200) - 1) * 100 END, 6) AS ma200, round(CASE WHEN count(*) >= 61 THEN stddev_pop(lr) FILTER (WHERE rn <= 126) * sqrt(252) * 100 END, 6) AS vol, round(CASE WHEN count(*) >= 63 THEN avg(close / 100000.0 * volume) FILTER (WHERE rn <= 63) / 1e6 END, 9) AS adv FROM g GROUP BY symbol HAVING count(*) >= 30""")
def _(spark, d):
    x = A.leader_rows(bars_of_brands(spark, d))
    return r6(x, "close", "off52", "up52", "ma50", "ma200", "vol").withColumn("adv", F.round("adv", 9))


@query("st15_sigma_moves", f"""{BRA}, k AS (SELECT symbol, date, close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY date) - 1 AS x, rn FROM r), c AS (SELECT *, round(max(x) FILTER (WHERE rn = 1) OVER s * 100, 2) / 100 AS cur, avg(x) FILTER (WHERE rn > 1) OVER s AS m, stddev_samp(x) FILTER (WHERE rn > 1) OVER s AS sd FROM k WHERE x IS NOT NULL WINDOW s AS (PARTITION BY symbol))
  SELECT symbol, round(max(cur) * 100, 6) AS move_pct, round(max(abs(cur - m) / sd), 6) AS sigma, CAST(sum(CAST(abs(x - m) >= abs(cur - m) AS INT)) FILTER (WHERE rn > 1) AS BIGINT) AS as_large, count(*) FILTER (WHERE rn > 1) AS n FROM c GROUP BY symbol HAVING count(*) FILTER (WHERE rn > 1) >= 4 AND max(sd) > 0""")
def _(spark, d):
    return r6(A.sigma_moves(bars_of_brands(spark, d)), "move_pct", "sigma")


@query("a36_move_context", f"""{BRA}, o AS (SELECT symbol, stddev_samp(ret) AS sd, count(*) AS n FROM r WHERE ret IS NOT NULL AND rn > 5 GROUP BY symbol) SELECT a.symbol, a.date, round(any_value(a.ret) * 100, 6) AS move_pct, round(abs(any_value(a.ret)) / any_value(sd), 6) AS z, round((sum(CAST(abs(b.ret) <= abs(a.ret) AS INT)) + 1) / (any_value(n) + 1) * 100, 6) AS pct, any_value(n) AS n
  FROM r a JOIN o USING (symbol) JOIN r b ON b.symbol = a.symbol AND b.rn > 5 AND b.ret IS NOT NULL WHERE a.rn <= 5 AND a.ret IS NOT NULL AND n >= 4 AND sd > 0 GROUP BY a.symbol, a.date""")
def _(spark, d):
    return r6(A.move_context(bars_of_brands(spark, d)).where("z is not null"), "move_pct", "z", "pct")


@query("a37_reaction_sessions", f"""{ORD}, e AS (SELECT 'p' || o_orderpriority[1] AS symbol, o_orderkey AS id, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 2 AS INT) AS target FROM orders)
  SELECT e.symbol, id, b.date AS session FROM e ASOF JOIN bars b ON b.symbol = e.symbol AND e.target <= b.date""")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")  # every order is an event
    e = o.select(F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("symbol"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), (F.col("o_orderkey") % 2 == 1).alias("after_close"))
    return A.reaction_sessions(e, bars_of_orders(spark, d)).select("symbol", "id", "session")


@query("a38_rebase", f"""{BRA}, g AS (SELECT c.date, s.symbol, b.close FROM (SELECT date FROM bars WHERE symbol = 'b11') c CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN bars b ON b.date = c.date AND b.symbol = s.symbol),
  f AS (SELECT symbol, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date) AS p FROM g) SELECT symbol, date, round(p * 100.0::DOUBLE / first_value(p) OVER (PARTITION BY symbol ORDER BY date), 3) AS level FROM f WHERE p IS NOT NULL""")
def _(spark, d):
    b = bars_of_brands(spark, d)
    return A.rebase(b, b.where("symbol = 'b11'"))


@query("a39_dividend_steps", f"""{ORD}, c AS (SELECT DISTINCT date FROM bars), a AS (SELECT symbol, date, close, CASE WHEN symbol = 'p5' THEN close ELSE CAST(trunc(close * CASE WHEN date < DATE '1994-01-01' THEN 0.97 WHEN date < DATE '1996-01-01' THEN 0.985 ELSE 1.0 END) AS BIGINT) END AS adj FROM bars),
  g AS (SELECT s.symbol, c.date, last_value(a.close IGNORE NULLS) OVER w AS p, last_value(a.adj IGNORE NULLS) OVER w AS t FROM c CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN a ON a.symbol = s.symbol AND a.date = c.date WINDOW w AS (PARTITION BY s.symbol ORDER BY c.date)),
  f AS (SELECT symbol, date, row_number() OVER w - 1 AS k, (t / first_value(t) OVER w) / (p / first_value(p) OVER w) AS f FROM g WHERE p IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date)), j AS (SELECT *, lag(f) OVER (PARTITION BY symbol ORDER BY date) AS was FROM f),
  e AS (SELECT symbol, CAST(k AS INT) AS k, date, round(f, 6) AS factor FROM j WHERE was IS NULL OR abs(f / was - 1) > 2e-5) SELECT * FROM e WHERE symbol IN (SELECT symbol FROM e GROUP BY symbol HAVING count(*) > 1)""")
def _(spark, d):
    b = bars_of_orders(spark, d)
    share = F.when(F.col("date") < "1994-01-01", 0.97).when(F.col("date") < "1996-01-01", 0.985).otherwise(1.0)
    b = b.withColumn("adj_close", F.when(F.col("symbol") == "p5", F.col("close")).otherwise((F.col("close") * share).cast("long")))
    return A.dividend_steps(b, b.select("date").distinct()).withColumn("factor", F.round("factor", 6))


_MASK = """m AS (SELECT g.date, g.symbol, last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.date) AS close FROM (SELECT date, s.symbol FROM bars c CROSS JOIN (SELECT DISTINCT symbol FROM bars) s WHERE c.symbol = 'p1') g LEFT JOIN bars b ON b.date = g.date AND b.symbol = g.symbol),
  k AS (SELECT *, CASE WHEN count(close) OVER n >= 200 THEN sum(close) OVER n / count(close) OVER n / 100000.0 END AS ma, close / lag(close, 63) OVER w - 1 AS q FROM m WINDOW w AS (PARTITION BY symbol ORDER BY date), n AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
  h AS (SELECT date, symbol || '_above' AS regime, coalesce(close / 100000.0 > ma, FALSE) AS ok FROM k UNION ALL SELECT date, symbol || '_below', coalesce(close / 100000.0 < ma, FALSE) FROM k UNION ALL SELECT date, symbol || '_rising', coalesce(q > 0.02, FALSE) FROM k UNION ALL SELECT date, symbol || '_falling', coalesce(q < -0.02, FALSE) FROM k)"""


@query("a42_regime_masks", f"{ORD}, {_MASK} SELECT regime, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS n, string_agg(CAST(CAST(ok AS INT) AS VARCHAR), '' ORDER BY date) AS mask FROM h GROUP BY regime")
def _(spark, d):
    return A.mask_string(A.regime_masks(bars_of_orders(spark, d), "p1"))


REGIMES = {
    "trend_up": ("above", "p1"), "trend_down": ("below", "p1"), "calm": ("under", "p2", 100000), "stress": ("over", "p2", 200000), "rates_up": ("up", "p3", 20000), "rates_down": ("down", "p3", 20000),
    "oil_up": ("gain", "p4", 0.02), "oil_down": ("loss", "p4", 0.02), "credit_on": ("leads", "p5", "p2", 0.01), "credit_off": ("lags", "p5", "p2", 0.01),
}
_KINDS = """rg AS (SELECT c.date, b.symbol, b.close / 100000.0 AS v FROM (SELECT DISTINCT date FROM bars WHERE symbol = 'p1') c LEFT JOIN bars b ON b.date = c.date),
  rp AS (SELECT date, """ + ", ".join(f"last_value(max(v) FILTER (WHERE symbol = 'p{k}') IGNORE NULLS) OVER (ORDER BY date) AS p{k}" for k in range(1, 6)) + """ FROM rg GROUP BY date),
  rq AS (SELECT *, CASE WHEN count(p1) OVER m >= 200 THEN avg(p1) OVER m END AS ma, p3 - lag(p3, 63) OVER w AS d3, p4 / lag(p4, 63) OVER w - 1 AS c4, (p5 / p2) / lag(p5 / p2, 63) OVER w - 1 AS c5 FROM rp WINDOW w AS (ORDER BY date), m AS (ORDER BY date ROWS 199 PRECEDING)),
  rm AS (""" + " UNION ALL ".join(f"SELECT date, '{n}' AS regime, coalesce({c}, FALSE) AS ok FROM rq" for n, c in (("trend_up", "p1 > ma"), ("trend_down", "p1 < ma"), ("calm", "p2 < 100000"), ("stress", "p2 > 200000"), ("rates_up", "d3 > 20000"), ("rates_down", "d3 < -20000"), ("oil_up", "c4 > 0.02"), ("oil_down", "c4 < -0.02"), ("credit_on", "c5 > 0.01"), ("credit_off", "c5 < -0.01"))) + ")"


@query("a42_regime_kinds", f"{ORD}, {_KINDS} SELECT regime, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS n, string_agg(CAST(CAST(ok AS INT) AS VARCHAR), '' ORDER BY date) AS mask FROM rm GROUP BY regime")
def _(spark, d):
    return A.mask_string(A.regimes(bars_of_orders(spark, d), "p1", REGIMES))


@query("a43_regime_kind_stats", f"""{ORD}, {_KINDS}, y AS (SELECT symbol, avg(ret) * 252 AS own FROM r WHERE ret IS NOT NULL GROUP BY symbol) SELECT r.symbol, regime, count(*) AS n, round(avg(ret), 6) AS mean, round(avg(CAST(ret > 0 AS INT)), 6) AS hit, round(avg(ret) / (stddev_pop(ret) / sqrt(count(*))), 6) AS t, round(avg(ret) * 252 - any_value(own), 6) AS excess
  FROM r JOIN rm ON rm.date = r.date AND ok JOIN y ON y.symbol = r.symbol WHERE ret IS NOT NULL GROUP BY r.symbol, regime HAVING stddev_pop(ret) > 0""")
def _(spark, d):
    b = bars_of_orders(spark, d)
    return r6(A.masked_stats(b, A.regimes(b, "p1", REGIMES)).where("t is not null").drop("ann"), "mean", "hit", "t", "excess")


@query("f11_colour_scale", f"""{ORD}, {_KINDS}, c AS (SELECT r.symbol, regime, count(*) AS n, avg(ret) * 252 AS ann FROM r JOIN rm ON rm.date = r.date AND ok WHERE ret IS NOT NULL GROUP BY r.symbol, regime), z AS (SELECT greatest(1e-6, list_sort(list(abs(ann)))[1 + CAST(floor(count(*) * 0.9) AS INT)]) AS scale FROM c)
  SELECT symbol, regime, round(greatest(-1, least(1, ann / scale)), 6) AS shade, n < 60 AS thin FROM c, z""")
def _(spark, d):
    b = bars_of_orders(spark, d)
    c = A.masked_stats(b, A.regimes(b, "p1", REGIMES)).select("symbol", "regime", "n", "ann")
    return stats.colour_scale(c, "ann", "n").select("symbol", "regime", F.round("shade", 6).alias("shade"), "thin")


@query("f10_last_years", f"{BRA} SELECT symbol, count(*) AS n, min(date) AS first_date FROM bars WHERE date >= (SELECT max(date) FROM bars) - INTERVAL 3 YEAR GROUP BY symbol")
def _(spark, d):
    return stats.span_of(bars_of_brands(spark, d), 3).groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").alias("first_date"))


@query("f12_envelope", f"""{ORD}, c AS (SELECT symbol, date, close, floor((date - min(date) OVER s)::DOUBLE / (max(date) OVER s - min(date) OVER s) * 100) AS col FROM bars WINDOW s AS (PARTITION BY symbol)), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, col ORDER BY close, date) AS a, row_number() OVER (PARTITION BY symbol, col ORDER BY date DESC) AS b FROM c) SELECT symbol, date, close FROM k WHERE a = 1 OR b = 1""")
def _(spark, d):
    return stats.envelope(bars_of_orders(spark, d).select("symbol", "date", "close"), "close", columns=100, most=500)


@query("st10_t_critical", "SELECT CAST(n AS BIGINT) AS n, CASE WHEN n <= 30 THEN [12.71, 4.30, 3.18, 2.78, 2.57, 2.45, 2.36, 2.31, 2.26, 2.23, 2.20, 2.18, 2.16, 2.14, 2.13, 2.12, 2.11, 2.10, 2.09, 2.09, 2.08, 2.07, 2.07, 2.06, 2.06, 2.06, 2.05, 2.05, 2.05, 2.04][n]::DOUBLE ELSE round(1.96::DOUBLE + 2.4::DOUBLE / n, 9) END AS t FROM range(1, 61) u(n)")
def _(spark, d):
    return spark.range(1, 61).select(F.col("id").alias("n"), F.round(stats.t_of_page("id"), 9).alias("t"))


@query("a43_masked_stats", f"""{ORD}, {_MASK}, y AS (SELECT symbol, avg(ret) * 252 AS own FROM r WHERE ret IS NOT NULL GROUP BY symbol) SELECT r.symbol, regime, count(*) AS n, round(avg(ret), 6) AS mean, round(avg(ret) * 252, 6) AS ann, round(avg(CAST(ret > 0 AS INT)), 6) AS hit, round(avg(ret) / (stddev_pop(ret) / sqrt(count(*))), 6) AS t, round(avg(ret) * 252 - any_value(own), 6) AS excess
  FROM r JOIN h ON h.date = r.date AND ok JOIN y ON y.symbol = r.symbol WHERE ret IS NOT NULL GROUP BY r.symbol, regime HAVING stddev_pop(ret) > 0""")
def _(spark, d):
    b = bars_of_orders(spark, d)
    return r6(A.masked_stats(b, A.regime_masks(b, "p1")).where("t is not null"), "mean", "ann", "hit", "t", "excess")


@query("a44_rotation", f"""{BRA}, g AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS bucket, exp(sum(ln(1 + ret))) - 1 AS ret FROM r WHERE ret IS NOT NULL GROUP BY ALL) SELECT symbol, bucket, round(ret, 6) AS ret, bucket = (SELECT max(bucket) FROM g) AS partial, row_number() OVER (PARTITION BY bucket ORDER BY round(ret, 9) DESC, symbol) AS rank FROM g""")
def _(spark, d):
    return r6(A.rotation(bars_of_brands(spark, d)).withColumn("rank", F.col("rank").cast("long")), "ret")


@query("n1_n9_normalize", """WITH v AS (SELECT 'p' || o_orderpriority[1] AS symbol, CAST(o_orderdate AS DATE) AS date, o_orderkey AS k, o_totalprice AS o, o_totalprice + 5 - o_orderkey % 11 AS h, o_totalprice - 3 AS l, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN -o_totalprice ELSE o_totalprice + 1 END AS c, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS vol FROM orders)
  SELECT symbol, date, CAST(round_even(o * 100000, 0) AS BIGINT) AS open, CAST(round_even(greatest(o, h, l, c) * 100000, 0) AS BIGINT) AS high, CAST(round_even(least(o, h, l, c) * 100000, 0) AS BIGINT) AS low, CAST(round_even(c * 100000, 0) AS BIGINT) AS close, CAST(round_even(c * 100000, 0) AS BIGINT) AS adj_close, coalesce(vol, 0) AS volume
  FROM v WHERE c IS NOT NULL AND o > 0 AND h > 0 AND l > 0 AND c > 0 AND isodow(date) < 6 AND date <= DATE '1998-01-01'""")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    raw = o.select(F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("symbol"), F.col("o_orderdate").alias("Date"), p.alias("Open"), (p + 5 - k % 11).alias("High"), (p - 3).alias("Low"), F.when(k % 13 == 0, None).when(k % 17 == 0, -p).otherwise(p + 1).alias("Close"), F.when(k % 5 == 0, None).otherwise(k).alias("Volume"))
    return normalize(raw, cutoff=datetime(1998, 1, 1).date())


@query("a10_structure_inputs", f"""{ORD}, p AS (SELECT symbol, date, high / 100000.0 AS h, low / 100000.0 AS l, close / 100000.0 AS c, lag(close / 100000.0) OVER w AS pc, volume, lag(volume) OVER w AS v1 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
  q AS (SELECT *, ln(c) - ln(pc) AS r, greatest(h - l, coalesce(abs(h - pc), h - l), coalesce(abs(l - pc), h - l)) AS tr FROM p)
  SELECT symbol, date, round(CASE WHEN count(r) OVER s >= 60 THEN stddev_samp(r) OVER s * sqrt(252) END, 5) AS sigma, round(CASE WHEN count(*) OVER a >= 20 THEN avg(tr) OVER a END, 4) AS atr, round(CASE WHEN count(v1) OVER m >= 250 THEN volume / median(v1) OVER m END, 6) AS vn
  FROM q WINDOW s AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING), a AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), m AS (PARTITION BY symbol ORDER BY date ROWS 249 PRECEDING)""")
def _(spark, d):
    from sessionloom.operators.structures import prepare

    return prepare(bars_of_orders(spark, d)).select("symbol", "date", F.round("sigma", 5).alias("sigma"), F.round("atr", 4).alias("atr"), F.round("vn", 6).alias("vn"))


def _smooth(spark, d):
    """Brand bars with moves a tenth as large: the invented prices are noise that no structure fits."""
    b = bars_of_brands(spark, d)
    return b.select("symbol", "date", *(F.rint(F.lit(1e7) * F.exp(F.log(F.col(c).cast("double") / 1e7) / 10)).cast("long").alias(c) for c in ("open", "high", "low", "close", "adj_close")), "volume")


@query("a11_a18_structures")
def _(spark, d):
    from sessionloom.operators.structures import scan

    return scan(_smooth(spark, d))


@query("a18_audit_buffer")
def _(spark, d):
    from sessionloom.operators.structures import audit_buffer

    return audit_buffer(_smooth(spark, d))


@query("a19_a25_projection")
def _(spark, d):
    from sessionloom.operators.projection import project

    return project(bars_of_orders(spark, d))


@query("a24_walk_forward")
def _(spark, d):
    from sessionloom.operators.projection import walk_forward

    return walk_forward(bars_of_orders(spark, d))


@query("a27_analogs")
def _(spark, d):
    from sessionloom.operators.projection import analogs

    return analogs(bars_of_orders(spark, d), "p1", window=26, ahead=13, least=100)[0]


@query("a27_analog_fan")
def _(spark, d):
    from sessionloom.operators.projection import analogs

    return analogs(bars_of_orders(spark, d), "p1", window=26, ahead=13, least=100)[1]
