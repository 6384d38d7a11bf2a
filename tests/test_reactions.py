import datetime as dt
import random
import threading

import duckdb
from pyspark.sql import functions as F

from sessionloom.functions import series as S
from sessionloom.plans import registry
import sessionloom.plans.series  # noqa: F401


def test_every_event_gets_its_session(spark, tmp_path):
    r = random.Random(5)
    start = dt.datetime(1995, 3, 1)
    rows = [(k, start + dt.timedelta(days=r.randrange(60)), f"{r.randrange(1, 4)}-X", 100.0 + k) for k in range(1, 121)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp_ntz, o_orderpriority string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    days = {}
    for _, ts, priority, _ in rows:
        if ts.weekday() < 5:
            days.setdefault(f"p{priority[0]}", set()).add(ts.date())
    want = set()
    for k, ts, priority, _ in rows:
        target = ts.date() + dt.timedelta(days=k % 2)
        if later := [x for x in days[f"p{priority[0]}"] if x >= target]:
            want.add((f"p{priority[0]}", k, min(later)))
    got = {tuple(x) for x in registry.queries()["a37_reaction_sessions"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 100
    # and so does its SQL
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    assert set(con.execute(registry.oracle_sql()["a37_reaction_sessions"]).fetchall()) == want


ORDERS = "o_orderkey long, o_orderdate timestamp_ntz, o_orderpriority string, o_totalprice double"


def test_events_without_symbol_or_day_get_none(spark, tmp_path):
    day = dt.datetime(1995, 3, 6)
    rows = [(2, day, None, 1.0), (4, day, "1-X", 1.0), (6, None, "1-X", 1.0), (None, day, "1-X", 1.0), (8, day - dt.timedelta(days=400), "1-X", 1.0), (9, day, "1-X", 1.0), (4, day, "1-X", 2.0)]
    spark.createDataFrame(rows, ORDERS).write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted(map(tuple, registry.queries()["a37_reaction_sessions"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    assert got == sorted(con.execute(registry.oracle_sql()["a37_reaction_sessions"]).fetchall()) and {x[1] for x in got} == {4, 8} and len(got) == 3
    left = spark.createDataFrame([(None, 1, day.date()), ("a", 2, None), ("a", 3, day.date())], "symbol string, id long, on date")
    right = spark.createDataFrame([("a", day.date()), (None, day.date())], "symbol string, date date")
    x = S.as_of_forward(left, right, "on")
    assert x.columns == ["symbol", "id", "on", "session"] and {(r.id, r.session) for r in x.collect()} == {(1, None), (2, None), (3, day.date())}


def test_many_events_of_a_symbol_take_linear_time(spark):
    """200 000 events of one name: a walk to the end from each would be 20 000 000 000 steps."""
    n, days = 200_000, 1000
    at = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("id") % days).cast("int"))
    left = spark.range(n).select(F.lit("a").alias("symbol"), "id", at.alias("on"))
    right = spark.range(0, days, 7).select(F.lit("a").alias("symbol"), at.alias("date"))
    stop = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        x = S.as_of_forward(left, right, "on").groupBy(F.datediff("session", "on").alias("wait")).count().collect()
    finally:
        stop.cancel()
    # day k waits for the next multiple of 7, the last days (995 to 999) for none
    want = {}
    for k in range(days):
        wait = -k % 7 if k <= 994 else None
        want[wait] = want.get(wait, 0) + n // days
    assert {r.wait: r["count"] for r in x} == want
