"""Setups, cohorts, leaders and regimes on planted series, against independent loops, with ties and exact boundaries."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sessionloom.functions import stats
from sessionloom.operators import analytics as A
from sessionloom.operators import bundles as B
from sessionloom.operators import cross as X
from sessionloom.operators import projection as P
from sessionloom.sources import normalize as N
from sessionloom.sources import sinks
from sessionloom.sources.bars import VIEW_NAMES, read_bars
from tests.test_engine import SCHEMA, sessions


def bars(spark, series, volumes=None, adjusted=None):
    rows = []
    for name, values in series.items():
        for i, (day, c) in enumerate(zip(sessions(len(values)), values)):
            if c is not None:
                p = round(c * 100_000)
                v = (volumes or {}).get(name, [100] * len(values))[i]
                a = (adjusted or {}).get(name, values)[i]
                rows.append((name, day, p, p, p, p, round(a * 100_000), v))
    return spark.createDataFrame(rows, SCHEMA).repartition(4, "symbol")


def flag_series(rise=45, rest=30, dip=0.1, lead=260):
    flat = [10 + 0.001 * (k % 7) for k in range(lead)]
    run = [10 * 2.4 ** ((k + 1) / rise) for k in range(rise)]
    return flat + run + [run[-1] * (1 - dip * abs(math.sin(k / 5))) for k in range(1, rest + 1)]


def flags_by_loop(c):
    out = {}
    if len(c) < 292:
        return out
    for t in range(len(c)):
        for h in range(10, 36):
            if t - h < 251:
                continue
            top, base = max(c[t - 251 : t + 1]), min(c[t - h - 39 : t - h + 1])
            peak = c[t - h]
            gain, pull = peak / base - 1, 1 - min(c[t - h + 1 : t + 1]) / peak
            if gain >= 1 and pull <= 0.25 and peak >= max(c[t - h - 251 : t - h + 1]) * 0.95 and c[t] >= top * 0.85 and (t not in out or gain > out[t][0]):
                out[t] = (gain, h, pull)
    return out


def test_planted_flags(spark):
    series = {"flag": flag_series(), "deep": flag_series(dip=0.5), "slow": [10 * 1.002**k for k in range(340)], "short": flag_series(lead=200), "tie": flag_series(rest=20)[:-20] + [24.0] * 20}
    found = {}
    for r in X.tight_flags(bars(spark, series)).collect():
        found.setdefault(r.symbol, {})[r.date] = (r.gain, r.flag, r.pull)
    for name, c in series.items():
        days = sessions(len(c))
        fixed = [round(x * 100_000) / 100_000 for x in c]
        want = {days[t]: v for t, v in flags_by_loop(fixed).items()}
        got = found.get(name, {})
        assert got.keys() == want.keys(), name
        for day, (gain, h, pull) in want.items():
            assert got[day] == (pytest.approx(gain), h, pytest.approx(pull))
    assert found.keys() == {"flag", "tie"} | ({"deep"} if "deep" in found else set())
    now = {r.symbol: r for r in X.flag_list(bars(spark, series, {"flag": [200] * 305 + [50] * 30})).collect()}
    h, v = now["flag"].flag, [200] * 305 + [50] * 30
    assert now["flag"].volratio == pytest.approx(np.mean(v[-h:]) / np.mean(v[-h - 40 : -h])) and now["flag"].off_high <= 0
    counts = X.counts_through_time(bars(spark, series), bars(spark, series).select("date").distinct(), 0).agg(F.sum("flags").alias("n")).first().n
    assert counts == sum(len(v) for v in found.values())


def test_a_fifth_of_25_names_has_six_members_with_the_boundary(spark):
    r = random.Random(1)
    series = {f"s{k:02}": list(np.cumprod([1 + r.gauss(0.0005 * k / 25, 0.01) for _ in range(170)]) * 50) for k in range(25)}
    series["bench"] = list(np.cumprod([1 + r.gauss(0, 0.01) for _ in range(170)]) * 50)
    series["s03"][160] = None  # a closed market is a return of 0, and no price for momentum
    b = bars(spark, series)
    frame = pd.DataFrame({k: [np.nan if x is None else round(x * 100_000) / 100_000 for x in v] for k, v in series.items()}, index=pd.Index(sessions(170)))
    c, bench = frame.drop(columns="bench"), frame["bench"]
    mom = c.shift(21) / c.shift(147) - 1
    lead = mom.rank(axis=1, pct=True) >= 0.8
    ret = c.ffill() / c.ffill().shift(1) - 1
    level = (1 + ret.where(lead.shift(1, fill_value=False)).mean(axis=1).fillna(0)).cumprod()
    got = {x.date: x for x in X.momentum_cohort(b, "bench", b.select("date").distinct()).collect()}
    assert {d: x.named for d, x in got.items()} == lead.sum(axis=1).to_dict() and max(x.named for x in got.values()) == 6
    ma, have = c.rolling(50).mean(), c.rolling(50).mean().notna()
    for d, x in got.items():
        assert x.level == pytest.approx(100 * level[d]) and x.relative == pytest.approx(100 * level[d] / bench[d])
        n = (lead & have).loc[d].sum()
        assert x.leaders_above == (pytest.approx(100 * ((c > ma) & lead & have).loc[d].sum() / n) if n else None)
    br = bench / bench.shift(1) - 1
    beta = ret.rolling(126).cov(br).div(br.rolling(126).var(), axis=0).rank(axis=1, pct=True)
    index = lambda m: (1 + ret.where(m.shift(1, fill_value=False)).mean(axis=1).fillna(0)).cumprod()
    ratio = index(beta >= 0.8) / index(beta <= 0.2)
    cohorts = {x.date: x.ratio for x in X.beta_cohorts(b, "bench", b.select("date").distinct()).collect()}
    assert all(cohorts[d] == pytest.approx(v) for d, v in ratio.items())
    g = {x.gauge: x for x in B.risk_gauges(b, "bench", b.select("date").distinct()).collect()}
    assert g["beta"].last == pytest.approx(100 * (ratio.iloc[-1] / ratio.iloc[-22] - 1)) and g["beta"].r63 == pytest.approx(100 * (ratio.iloc[-1] / ratio.iloc[-64] - 1))
    past = (ratio / ratio.shift(21) - 1).dropna()
    assert g["beta"].pct == pytest.approx(100 * (past < past.iloc[-1]).mean())


def test_ties_of_the_leaderboard_and_the_month_before(spark):
    up = [100.0] * 30 + [100 * 1.01**k for k in range(50)]
    series = {"a": up, "b": up, "c": [100.0 + k for k in range(80)], "short": up[:60]}
    themes = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3), ("short", 4)], "symbol string, ordinal int")
    got = {r.symbol: r for r in X.leaderboard(bars(spark, series), themes).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["b"].rank, got["a"].rank, got["c"].rank) == (1, 2, 3)
    c = series["c"]
    now, before = {k: v[-1] / v[-22] - 1 for k, v in series.items() if k != "short"}, {k: v[-22] / v[-43] - 1 for k, v in series.items() if k != "short"}
    order = lambda m: [k for k in sorted(["b", "a", "c"], key=lambda k: -round(m[k], 9))]
    assert {k: r.prev_rank - r.rank for k, r in got.items()} == {k: order(before).index(k) - order(now).index(k) for k in got}
    assert got["c"].r1w == pytest.approx(c[-1] / c[-6] - 1)


def test_volume_highs_need_volume_and_history(spark):
    n = 300
    series = {k: [50.0 + i * 0.01 for i in range(n)] for k in ("none", "high", "new", "thin")} | {"short": [50.0] * 64}
    vol = {"none": [0] * n, "high": [1000 + (i == n - 3) * 9000 for i in range(n)], "new": [1000] * n, "thin": [1 + (i == n - 2) for i in range(n)], "short": [1000] * 63 + [9000]}
    b = bars(spark, series, vol)
    assert X.volume_masks(b.where("symbol = 'none'")).where("year_high or ever_high").count() == 0
    got = {r.symbol: r for r in X.volume_edge(b, least_dollar=10_000).collect()}
    assert set(got) == {"high", "new"}
    x = got["high"]
    c = series["high"]
    assert x.date == sessions(n)[n - 3] and x.ever_high and not x.ipo_high and x.rvol == pytest.approx(10)
    assert x.chg == pytest.approx(c[n - 3] / c[n - 4] - 1) and x.off_high == pytest.approx(c[-1] / c[n - 3] - 1) and x.r1w == pytest.approx(c[-1] / c[-6] - 1) and x.dvol_m == pytest.approx(10_000 * c[n - 3] / 1e6)


def test_moves_far_from_their_mean(spark):
    r = random.Random(3)
    c = list(np.round(np.cumprod([1.01 + r.gauss(0, 0.01) for _ in range(60)]) * 50, 2))
    for series, n in ((c, 54), (c[:10], 4), (c[:9], None)):
        got = A.sigma_moves(bars(spark, {"s": series}), 5).collect()
        if n is None:
            assert got == []
            continue
        x = np.array(series)
        past = x[5:-1] / x[:-6] - 1
        cur = round((x[-1] / x[-6] - 1) * 100, 2) / 100
        far = abs(cur - past.mean())
        assert (got[0].n, got[0].as_large) == (n, int((np.abs(past - past.mean()) >= far).sum())) and got[0].sigma == pytest.approx(far / past.std(ddof=1))


def test_leader_rows_use_closes_log_returns_and_millions(spark):
    r = random.Random(4)
    c = list(np.round(np.cumprod([1 + r.gauss(0, 0.02) for _ in range(300)]) * 50, 2))
    b = bars(spark, {"s": c, "young": c[:59], "few": c[:29]})
    b = b.withColumn("high", F.col("high") * 2).withColumn("low", F.expr("low div 2"))
    got = {x.symbol: x for x in A.leader_rows(b).collect()}
    x = got["s"]
    logs = np.diff(np.log(c))
    assert x.off52 == pytest.approx((c[-1] / max(c[-252:]) - 1) * 100) and x.up52 == pytest.approx((c[-1] / min(c[-252:]) - 1) * 100)
    assert x.vol == pytest.approx(np.std(logs[-126:]) * math.sqrt(252) * 100) and x.adv == pytest.approx(np.mean(np.array(c[-63:]) * 100) / 1e6)
    assert got["young"].off52 is None and got["young"].vol is None and got["young"].adv is None and "few" not in got


def test_dividend_steps_open_at_one_and_follow_the_last_step(spark):
    n = 400
    c = [50 + 0.05 * k for k in range(n)]
    paid = [1 - 0.02 * (k < 100) - 0.01 * (k < 250) for k in range(n)]
    creep = [1 + 5e-6 * k for k in range(n)]
    adjusted = {"pays": [x * f for x, f in zip(c, paid)], "never": c, "creeps": [x * f for x, f in zip(c, creep)]}
    b = bars(spark, {k: c for k in adjusted}, adjusted=adjusted)
    got = {}
    for x in A.dividend_steps(b, b.select("date").distinct()).orderBy("symbol", "k").collect():
        got.setdefault(x.symbol, []).append((x.k, x.factor))
    assert [k for k, _ in got["pays"]] == [0, 100, 250] and got["pays"][0] == (0, 1.0) and "never" not in got
    assert got["pays"][1][1] == pytest.approx(0.99 / 0.97, rel=1e-6) and got["pays"][2][1] == pytest.approx(1 / 0.97, rel=1e-6)
    steps, last = [], None
    raw = [round(x * f * 1e5) / round(x * 1e5) for x, f in zip(c, creep)]
    for k, v in enumerate(raw):
        v /= raw[0]
        if last is None or abs(v / last - 1) > 2e-5:
            last = float(f"{v:.7g}")
            steps.append((k, last))
    assert got["creeps"] == steps


def test_five_kinds_of_regime(spark):
    r = random.Random(6)
    n = 300
    series = {k: list(np.round(np.cumprod([1 + r.gauss(0, 0.02) for _ in range(n)]) * 20, 2)) for k in ("m", "v", "y", "g", "h")}
    for k in range(0, n, 17):
        series["y"][k] = None
    rules = {"up": ("above", "m"), "down": ("below", "m"), "calm": ("under", "v", 15), "hot": ("over", "v", 25), "rise": ("up", "y", 0.25), "fall": ("down", "y", 0.25), "gain": ("gain", "g", 0.02), "loss": ("loss", "g", 0.02), "on": ("leads", "h", "g", 0.01), "off": ("lags", "h", "g", 0.01)}
    f = pd.DataFrame({k: [np.nan if x is None else x for x in v] for k, v in series.items()}, index=pd.Index(sessions(n))).ffill()
    ratio = f.h / f.g
    want = {"up": f.m > f.m.rolling(200).mean(), "down": f.m < f.m.rolling(200).mean(), "calm": f.v < 15, "hot": f.v > 25, "rise": f.y - f.y.shift(63) > 0.25, "fall": f.y - f.y.shift(63) < -0.25, "gain": f.g / f.g.shift(63) - 1 > 0.02, "loss": f.g / f.g.shift(63) - 1 < -0.02, "on": ratio / ratio.shift(63) - 1 > 0.01, "off": ratio / ratio.shift(63) - 1 < -0.01}
    got = {x.regime: x.mask for x in A.mask_string(A.regimes(bars(spark, series), "m", rules)).collect()}
    assert got == {k: "".join("1" if x else "0" for x in v) for k, v in want.items()} and sum("1" in v for v in got.values()) >= 8


def test_names_without_their_legal_endings(spark):
    names = ["Apple Inc.", "The Company", "Group Holdings", "Foo Companies, LLC", "Nokia Oyj", "Bar & Co., Ltd.", "Kirin Holdings K.K.", "Class Action Group plc", "Alphabet Inc. Class A", "Eni S.A", " ,Baz Incorporated", "Incorrect", "", None]
    want = ["Apple", "The Company", "Group", "Foo", "Nokia", "Bar &", "Kirin", "Class Action", "Alphabet Inc. Class A", "Eni", "Baz", "Incorrect", "", None]
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    assert [r.t for r in df.select("i", N.tidy_name(F.col("n")).alias("t")).orderBy("i").collect()] == want


def test_bars_come_back_from_where_they_were_written(spark, tmp_path):
    b = bars(spark, {"A.B": [1.5, 2.5], "x+y %": [3.0], "^Z": [4.0, 5.0, 6.0]})
    sinks.write_bars(b, str(tmp_path / "bars"))
    back = read_bars(spark, str(tmp_path / "bars"))
    key = lambda df: sorted(tuple(x) for x in df.select("symbol", "date", "close", "volume").collect())
    assert key(back) == key(b)
    assert {x.symbol for x in read_bars(spark, str(tmp_path / "bars"), symbols=["x+y %"]).collect()} == {"x+y %"}
    raw = spark.createDataFrame([("q", dt.date(2020, 1, 2), 1.0, 2.0, 0.5, 1.5, 10)], "symbol string, date date, Open double, High double, Low double, Close double, Volume long")
    assert N.store_bars(raw, str(tmp_path / "stored")) == 1 and read_bars(spark, str(tmp_path / "stored")).first().symbol == "q"
    assert N.store_bars(raw.limit(0), str(tmp_path / "none")) == 0 and not (tmp_path / "none").exists()


def test_small_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", None), ("a", 1)], "k string, v int")
    sinks.write_csv_file(df, str(tmp_path / "t.csv"), "k")
    assert (tmp_path / "t.csv").read_text().split() == ["k,v", "a,1", "b,"]
    assert sinks.read_json_cache(str(tmp_path / "c.json"), {"x": 1}) == {"x": 1}
    sinks.write_json_cache({"y": dt.date(2020, 1, 1)}, str(tmp_path / "c.json"))
    assert sinks.read_json_cache(str(tmp_path / "c.json"), {}) == {"y": "2020-01-01"}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["c.json", "t.csv"]


def test_page_helpers(spark):
    cells = spark.createDataFrame([(i, float(i - 10), 30 + i) for i in range(20)], "i int, v double, n int")
    got = {r.i: r for r in stats.colour_scale(cells, "v", "n").collect()}
    scale = sorted(abs(i - 10) for i in range(20))[18]
    assert got[0].scale == scale and got[0].shade == -1.0 and got[13].shade == pytest.approx(3 / scale) and [got[i].thin for i in range(20)] == [30 + i < 60 for i in range(20)]
    line = bars(spark, {"s": [100 - (k % 50) for k in range(400)]}).select("symbol", "date", "close")
    thin = stats.envelope(line, "close", columns=8, most=100)
    assert thin.count() <= 2 * 9 and thin.agg(F.min("close")).first()[0] == line.agg(F.min("close")).first()[0]
    assert stats.envelope(line, "close", most=400).count() == 400
    year = stats.span_of(line, 1).agg(F.min("date").alias("a")).first().a
    assert year >= dt.date(2020, 7, 13)
    rows = spark.createDataFrame([("k", 0.01), ("k", 0.03), ("k", None), ("one", -0.02)], "key string, outcome_ret double")
    cube = spark.createDataFrame([("one", 9, 50.0, 1.0, 2.0, 0.0, 3.0)], "key string, n long, up double, mean double, t double, ci_lo double, ci_hi double")
    got = {r.key: r for r in B.study_or_rows(cube, rows, "key").collect()}
    assert got["one"].source == "cube" and got["one"].n == 9 and got["k"].source == "rows" and (got["k"].n, got["k"].up, got["k"].mean) == (2, 100.0, 2.0)
    assert got["k"].ci_hi == pytest.approx(2 + 12.71 * 1.0, abs=1e-3)


def test_states_told_without_the_future(spark):
    r = random.Random(2)
    c = list(np.cumprod([1 + r.gauss(0.0005, 0.015) for _ in range(420)]) * 40)
    got = P.audit_causal(bars(spark, {"s": c}), 20).first()
    assert got.checked > 0 and got.causal


def test_view_names_of_all_modules(spark):
    df = spark.createDataFrame([("^GSPC",), ("BRK-B",), ("GC=F",), ("A.B",)], "s string")
    got = {k: [r[0] for r in df.select(f(F.col("s"))).collect()] for k, f in VIEW_NAMES.items()}
    assert got["event"] == ["gspc", "brk_b", "gc=f", "a_b"] and got["beta"] == got["catalog"] == ["gspc", "brk_b", "gc=f", "a.b"]
    assert got["theme"] == got["ledger"] == ["gspc", "brk_b", "gold", "a_b"] and got["basket"] == ["gspc", "brk_b", "gold", "a.b"]


def test_weekly_tables(spark, tmp_path):
    series = {"flag": flag_series(), "other": [20 + math.sin(k / 9) for k in range(335)], "bench": [30 + 0.01 * k for k in range(335)]}
    b = bars(spark, series, {"flag": [200_000] * 334 + [900_000]})
    members = spark.createDataFrame([("g", "flag"), ("g", "other")], "basket string, symbol string")
    tables = B.weekend(b, members, "bench")
    sinks.bundle(tables, str(tmp_path / "w.js"), "WEEK")
    text = (tmp_path / "w.js").read_text()
    assert text.startswith("window.WEEK = ") and all(f'"{k}"' in text for k in tables) and '"flag"' in text
    board = {r.gauge: r.last for r in tables["scoreboard"].collect()}
    assert board["flags"] == 1.0 and board["volume_highs"] == 1.0 and set(board) == {"pct_above_20", "pct_above_50", "pct_above_200", "net_highs", "flags", "volume_highs"}
    rail = spark.createDataFrame([("bench", 1), ("gone", 2)], "symbol string, ordinal int")
    t = {r.symbol: r for r in B.theme_series(b, rail, members).collect()}
    assert t["bench"].kind == "etf" and t["flag"].kind == "stock" and t["flag"].levels[0] == 100.0 and len(t["flag"].levels) == 335 and "gone" not in t
