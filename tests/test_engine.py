"""The time-series engine against hand-made cases and independent loops."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.functions import series as S
from sessionloom.functions import stats
from sessionloom.operators import analytics as A
from sessionloom.operators import cross as X
from sessionloom.operators import cube as C
from sessionloom.operators import events as E
from sessionloom.operators import gate
from sessionloom.sources import normalize as N
from sessionloom.sources import sinks
from sessionloom.sources.bars import check_catalog, catalog, read_bars, register

SCHEMA = "symbol string, date date, open long, high long, low long, close long, adj_close long, volume long"


def sessions(n, start=dt.date(2020, 1, 1)):
    out = []
    while len(out) < n:
        if start.weekday() < 5:
            out.append(start)
        start += dt.timedelta(days=1)
    return out


def bars_of(spark, **closes):
    rows = []
    for symbol, values in closes.items():
        for day, c in zip(sessions(len(values)), values):
            if c is not None:
                p = round(c * 100_000)
                rows.append((symbol, day, p, p, p, p, p, 100))
    return spark.createDataFrame(rows, SCHEMA)


def test_gate_language():
    t = gate.parse("VIX > 30")
    assert {f.column for f in gate.features(t)} == {"vix__val"}
    assert {f.column for f in gate.features(gate.parse("spy>=spy_200dma"))} == {"spy__val", "spy__dma200"}
    assert gate.parse("tnx_up") == gate.parse("tnx_ret > 0")
    assert {f.kind for f in gate.features(gate.parse("a_prev != b_ret_prev"))} == {"prev", "ret_prev"}
    for bad in ("", "vix", "vix >", "vix > 1 & a > 2", "a_b > 1", "vix ! 3", "(a > 1)"):
        with pytest.raises(ValueError):
            gate.parse(bad)
    assert gate.parse("(a > 1 | b_down) & a + 1 < b * 2", extended=True).name == "&"


def test_event_study_rules(spark):
    b = bars_of(spark, x=[100, 98, 97, 99, 95, 96, 96.5, 95, 94, 93, 92, 100], g=[1, 2, None, 1, 3, 2, 2, 2, 2, 2, 2, 2])
    s = {r.trigger_date: r for r in E.event_study(b, "x").collect()}
    assert len(s) == 12 and s[min(s)].trigger_ret is None and s[max(s)].outcome_ret is None
    down = E.event_study(b, "x", threshold=-0.02).collect()
    assert [round(r.trigger_ret, 4) for r in sorted(down, key=lambda r: r.trigger_date)] == [-0.02, -0.0404]
    streak = E.event_study(b, "x", streak=4).collect()
    assert len(streak) == 1 and round(streak[0].outcome_ret, 6) == round(100 / 92 - 1, 6)
    after = E.event_study(b, "x", streak=2, streak_anchor="after", threshold=-0.001).orderBy("trigger_date").collect()
    assert [r.trigger_date for r in after] == [sessions(12)[i] for i in (7, 8)]
    gated = E.event_study(b, "x", when="g > 1").collect()  # g has no bar on the third session
    assert sessions(12)[2] not in {r.trigger_date for r in gated} and len(gated) == 9
    worst = E.event_study(b, "x", worst_n=2).collect()
    assert {round(r.trigger_ret, 3) for r in worst} == {-0.04, -0.02}
    assert E.event_study(b, "x", require_ret=True).count() == 11
    with pytest.raises(ValueError):
        E.event_study(b, "x", measure_field="hi")
    assert E.summarize_event(E.event_study(b, "x")).first().n == 11
    assert E.summarize_event(E.event_study(b, "x", threshold=-0.9)).first().n == 0


def test_sequence_uses_the_common_calendar(spark):
    b = bars_of(spark, a=[1, 2, 3, 2, 3, 4, 5], s=[10, None, 11, 12, 13, 14, 15])
    got = E.sequence(b, ["a_up", "a_up"], "s").orderBy("anchor_date").collect()
    # common sessions 0 2 3 4 5 6; a rises at 2, 4, 5, 6
    assert [r.anchor_date for r in got] == [sessions(7)[4]]
    assert got[0].outcome_ret == pytest.approx(15 / 14 - 1)


def test_t_distribution():
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.t_critical(9) == pytest.approx(2.2621571628, abs=1e-8)
    assert stats.t_critical(200) == pytest.approx(1.9718962236, abs=1e-8)


@pytest.mark.parametrize("seed", range(3))
def test_rsi_against_recursion(spark, seed):
    r = np.random.default_rng(seed)
    x = 100 * np.exp(np.cumsum(r.normal(0, 0.015, 400)))
    got = A.rsi(bars_of(spark, a=x.tolist(), up=list(range(1, 201)), down=list(range(200, 0, -1)), short=x[:60].tolist())).collect()
    by = {g.symbol: g for g in got}
    for n in (7, 14, 21):
        assert by["a"][f"rsi{n}"] == pytest.approx(A.wilder_rsi(np.round(x * 100_000), n), abs=1e-6)
        assert by["up"][f"rsi{n}"] == 100 and by["down"][f"rsi{n}"] == 0
    assert by["short"].rsi21 is None and by["short"].rsi7 is not None


def test_normalizer(spark):
    now = dt.datetime(2026, 7, 29, 8, 57)
    rows = [(s, dt.date(2026, 7, 29), 100.0, 102.0, 99.0, 101.0, 1000) for s in ("7011.T", "005930.KS", "SPY")]
    rows += [("B", dt.date(2026, 7, 27), 10.0, 9.0, 11.0, 10.5, None), ("B", dt.date(2026, 7, 26), 1.0, 1.0, 1.0, 1.0, 1), ("B", dt.date(2026, 7, 24), 1.0, 1.0, -1.0, 1.0, 1), ("B", dt.date(2026, 7, 23), 1.0, None, 1.0, 1.0, 1), ("B", dt.date(2026, 7, 22), 0.000005, 0.000025, 0.000005, 0.000015, 1)]
    raw = spark.createDataFrame(rows, "symbol string, index date, Open double, High double, Low double, Close double, Volume long").withColumnRenamed("index", "Date")
    got = {(r.symbol, str(r.date)): r for r in N.normalize(raw, now).collect()}
    assert set(got) == {("7011.T", "2026-07-29"), ("005930.KS", "2026-07-29"), ("B", "2026-07-27"), ("B", "2026-07-22")}
    b = got["B", "2026-07-27"]
    assert (b.high, b.low, b.volume, b.adj_close) == (1_100_000, 900_000, 0, 1_050_000)
    half = got["B", "2026-07-22"]
    assert (half.open, half.high, half.close) == (0, 2, 2)  # half to even


def test_calendar_universe_and_staleness(spark):
    d = lambda *days: [dt.date(2026, 7, x) for x in days]
    rows = [(s, day, 1, 1, 1, 1, 1, 1) for s, days in (("AAPL", d(27, 28)), ("MSFT", d(27, 28)), ("JP7011", d(28, 29))) for day in days]
    b = spark.createDataFrame(rows, SCHEMA)
    assert X.modal_last_date(b).first()["last"] == dt.date(2026, 7, 28)
    assert [r.date for r in X.market_calendar(b).orderBy("date").collect()] == d(27, 28)
    fresh = spark.createDataFrame([("FRESH", dt.date(2026, 8, 13), 1, 1, 1, 1, 1, 1), ("STALE", dt.date(2026, 7, 1), 1, 1, 1, 1, 1, 1)], SCHEMA)
    asked = []
    N.refetch(fresh, asked.append)
    assert asked == [["STALE"]]
    assert N.last_session(dt.datetime(2026, 8, 16, 12)) == dt.date(2026, 8, 14)


def test_earnings_reactions_and_eps(spark, tmp_path):
    b = bars_of(spark, a=[100, 101, 105])
    days = sessions(3)
    path = tmp_path / "e.json"
    path.write_text(json.dumps({"a": {"symbol": "A", "checked": "2026-01-01", "events": [{"ts": f"{days[1]}T16:00:00-04:00", "after_close": True, "reported": True}, {"ts": f"{days[0]}T08:00:00-04:00", "after_close": False, "reported": True}, {"ts": f"{days[2]}T17:00:00-04:00", "after_close": True, "reported": False}]}}))
    got = A.reaction_sessions(N.earnings_events(spark, str(path)), b).collect()
    assert sorted(r.session for r in got) == [days[0], days[2]]
    rows = [("MU", 2022, "2022-09-29", 8.35, "h"), ("MU", 2023, "2023-09-27", -4.544, "h"), ("MU", 2024, "2024-09-25", 1.3, "h"), ("MU", 2025, "2025-09-23", 8.29, "e"), ("MU", 2026, None, 9.0, "f"), ("MU", 2027, None, 11.0, "f")]
    eps = spark.createDataFrame(rows, "symbol string, fy int, report_date string, eps double, kind string").withColumn("report_date", F.to_date("report_date"))
    one = {(str(r.from_date), r.fy, r.eps) for r in A.eps_schedule(eps, 1).collect()}
    assert one == {("2023-09-27", 2024, 1.3), ("2024-09-25", 2025, 8.29), ("2025-09-23", 2026, 9.0)}
    q3 = {(str(r.from_date), r.fy) for r in A.eps_schedule(eps, 1, {"MU": 9}).collect()}
    assert ("2026-03-01", 2027) in q3
    assert A.check_eps(eps.where("report_date is not null")).count() == 0
    assert A.check_eps(spark.createDataFrame([("Q", 2, "2020-01-01", 1.0, "h"), ("Q", 2, "2021-01-01", 1.0, "h")], "symbol string, fy int, report_date string, eps double, kind string").withColumn("report_date", F.to_date("report_date"))).count() == 1


def test_short_runs_merge():
    assert A.merge_short_runs(list("aaaabbaaaa"), 3) == list("aaaaaaaaaa")
    assert A.merge_short_runs(list("aabcccc"), 2) == list("aaacccc")[:2] + list("ccccc")
    assert A.merge_short_runs(list("ab"), 1) == list("ab")


def test_drawdowns_and_open_ones(spark):
    got = A.drawdowns(bars_of(spark, a=[100, 90, 95, 101, 99, 100, 90, 90])).orderBy("peak").collect()
    d = sessions(8)
    assert [(round(r.depth, 4), r.peak, r.trough, r.rec) for r in got] == [(0.1, d[0], d[1], (d[3] - d[1]).days), (round(1 - 90 / 101, 4), d[3], d[6], None)]


def test_ledger_walk():
    rows, now = X.ledger_walk({"init": ("d0", ["a", "b"]), "swaps": [("d1", [("a", "c"), ("zz", "d")]), ("d2", [("c", "a"), ("b", "d")])]})
    assert {(r["symbol"], r["entry"], r["exit"]) for r in rows} == {("a", "d0", "d1"), ("c", "d1", "d2"), ("b", "d0", "d2"), ("d", "d2", None), ("a", "d2", None)}
    assert sorted(now) == ["a", "d"]


def test_ranks_baskets_and_as_of(spark):
    r = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 5.0), ("c", 1, 1.0), ("d", 1, None)], "symbol string, date int, v double")
    assert {x.symbol: x.p for x in r.select("symbol", X.pct_rank("v", "date").alias("p")).collect()} == {"a": pytest.approx(2.5 / 3), "b": pytest.approx(2.5 / 3), "c": pytest.approx(1 / 3), "d": None}
    b = bars_of(spark, a=[100, 110, 121], b=[100, None, 100])
    m = spark.createDataFrame([("k", "a"), ("k", "b")], "basket string, symbol string")
    pad = [round(x.level, 4) for x in X.equal_weight_baskets(b, m).orderBy("date").collect()]
    bare = [round(x.level, 4) for x in X.equal_weight_baskets(b, m, fill="none").orderBy("date").collect()]
    assert pad == [100.0, 105.0, 110.25] and bare[1] == 110.0
    q = spark.createDataFrame([("a", sessions(3)[0] - dt.timedelta(days=1)), ("a", sessions(3)[2] + dt.timedelta(days=9))], "symbol string, date date")
    assert [x.close for x in S.as_of_backward(q, b.select("symbol", "date", "close")).orderBy("date").collect()] == [None, 12_100_000]


def test_cube_matches_single_studies(spark):
    r = random.Random(1)
    walk = [100.0]
    for _ in range(300):
        walk.append(walk[-1] * (1 + r.gauss(0, 0.02)))
    b = bars_of(spark, s=[round(x, 3) for x in walk], g=[round(x + 5, 3) for x in walk[::-1]])
    got = {(x.trigger, x.weekday, x.condition, x.horizon): x for x in C.cube(b, ["s"], {"none": None, "g": "g > g_50dma"}).collect()}
    one = stats.summarize(E.event_study(b, "s", threshold=-0.02, when="g > g_50dma", require_ret=True).where("outcome_ret is not null"), "outcome_ret").first()
    x = got["le2", 0, "g", 1]
    assert x.n == one.n and x.mean_pct == pytest.approx(one.mean_pct, abs=1e-3) and sum(x.counts) == x.n
    worst = E.event_study(b, "s", worst_n=20, horizon=5, require_ret=True).where("outcome_ret is not null")
    assert got["worst20", 0, "none", 5].n == worst.count()
    half = (x.ci_hi - x.ci_lo) / 2
    v = [100 * o.outcome_ret for o in E.event_study(b, "s", threshold=-0.02, when="g > g_50dma", require_ret=True).where("outcome_ret is not null").collect()]
    assert half == pytest.approx(stats.t_critical(len(v) - 1) * np.std(v, ddof=1) / len(v) ** 0.5, abs=2e-3)


def test_planted_box_and_channel(spark):
    from sessionloom.operators.structures import scan

    r = np.random.default_rng(0)
    box = 100 + 2.5 * np.sin(np.arange(160) / 6) + r.normal(0, 0.2, 160)
    up = np.linspace(106, 140, 60)
    x = np.concatenate([100 + r.normal(0, 0.8, 70), box, up])
    days = sessions(len(x))
    rows = [("q", d, int(c * 1e5), int((c + 0.3) * 1e5), int((c - 0.3) * 1e5), int(c * 1e5), int(c * 1e5), 1000 + i % 7) for i, (d, c) in enumerate(zip(days, x))]
    got = scan(spark.createDataFrame(rows, SCHEMA)).toPandas()
    boxes = got[got.kind == "box"]
    assert len(boxes) >= 1 and (boxes.direction == "up").any() and boxes[boxes.direction == "up"].iloc[0].end >= days[225]
    assert set(boxes[boxes.direction == "up"].tag) <= {"follow-through", "pending"}


def test_catalog_files_and_shards(spark, tmp_path):
    b = bars_of(spark, **{"^spx": [1, 2], "brk-b": [3, 4]})
    for name in ("^spx", "brk-b"):
        b.where(F.col("symbol") == name).drop("symbol").toPandas().astype({"volume": "int64"}).to_parquet(tmp_path / f"{name}.parquet")
    back = read_bars(spark, str(tmp_path / "*.parquet"))
    c = {r.symbol: r.view for r in catalog(back).collect()}
    assert c == {"^spx": "spx", "brk-b": "brk_b"}
    with pytest.raises(RuntimeError):
        check_catalog(spark.createDataFrame([("A.B", "a_b"), ("A-B", "a_b")], "symbol string, view string"))
    register(spark, b)
    assert [round(r.ret, 3) for r in spark.sql("select * from returns('^spx') where ret is not null").collect()] == [1.0]
    folder = tmp_path / "shards"
    folder.mkdir()
    (folder / "gone.js").write_text("x")
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 3.0), ("b", 1, 1.0)], "k string, i int, v double")
    assert sinks.write_shards(df, "k", str(folder)) == ["a.js", "b.js"]
    assert '"v":null' in (folder / "a.js").read_text() and not (folder / "gone.js").exists()
    assert math.isclose(stats.t_two_sided(0, 5), 1.0)


def test_service_function(spark):
    from sessionloom.operators.bundles import health, run_event

    b = bars_of(spark, x=[100, 98, 97, 99, 95, 96])
    got = run_event(b, {"symbol": "x", "threshold": "-0.01", "day": ""})
    assert got["stats"]["n"] == 3 and sum(got["bins"]) == 3 and len(got["rows"]) == 3
    assert run_event(b, {"symbol": "x", "threshold": "-0.5"})["stats"]["n"] == 0
    assert len(run_event(b, {"symbol": "x", "threshold": "-0.5", "worst_n": "2"})["rows"]) == 2
    assert health(b) == {"count": 1, "as_of": sessions(6)[-1].isoformat()}
    for bad in ({"symbol": "x", "zz": "1"}, {"threshold": "-1"}, {"symbol": "x", "day": "q"}):
        with pytest.raises(ValueError):
            run_event(b, bad)


def test_metadata_and_names(spark, tmp_path):
    (tmp_path / "m.csv").write_text("ticker,name,sector\nA,Foo Inc.,Technology\nBRK-B,,\n")
    m = N.read_members(spark, str(tmp_path / "m.csv"))
    extra = spark.createDataFrame([("^A", "x", "Energy", ""), ("GC=F", "Gold", "Healthcare", "")], "ticker string, name string, sector string, industry string")
    got = {r.stem: (r.sector, r.industry) for r in N.merge_metadata(m, extra).collect()}
    assert got == {"A": ("Information Technology", ""), "BRK-B": ("", ""), "GOLD": ("Health Care", "")}
    names = spark.createDataFrame([("Foo Holdings, Inc.",), ("Bar Company",), ("Cole",)], "n string").select(N.tidy_name(F.col("n")).alias("n"))
    assert [r.n for r in names.collect()] == ["Foo", "Bar", "Cole"]
