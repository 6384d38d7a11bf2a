"""Writers: bars, tables and the data shards of a static site."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars by symbol, sorted by date within a file, in Parquet; partitions spread by symbol."""
    bars.repartition("symbol").sortWithinPartitions("symbol", "date").write.mode("overwrite").partitionBy("symbol").parquet(path, compression="snappy")


def write_table(df: DataFrame, path: str, csv: bool = False) -> None:
    """A result table in Parquet, and as CSV if asked."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    if csv:
        df.write.mode("overwrite").csv(f"{path}.csv", header=True)


def write_csv_file(df: DataFrame, path: str, order: str) -> None:
    """A small table as one CSV file in a given order, replaced at once; rows pass the driver one by one."""
    import csv

    with open(f"{path}.tmp", "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for r in df.orderBy(order).toLocalIterator():
            out.writerow(["" if v is None else v for v in r])
    os.replace(f"{path}.tmp", path)


def write_json_cache(value: dict, path: str) -> None:
    """A cache file, replaced at once so that a reader never sees half of it."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, indent=1, default=str)
    os.replace(f"{path}.tmp", path)


def read_json_cache(path: str, empty: dict) -> dict:
    if not os.path.exists(path):
        return empty
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def packed_series(bars: DataFrame, price: str = "close") -> DataFrame:
    """symbol, d0, gaps, closes: a series as its first epoch day, day gaps and whole-number prices."""
    g = bars.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(F.unix_date("date").alias("d"), F.col(price).alias("p")))).alias("x"))
    return g.select("symbol", F.get("x", 0)["d"].alias("d0"), F.transform("x", lambda e, i: F.when(i == 0, 0).otherwise(e["d"] - F.coalesce(F.get("x", i - 1)["d"], e["d"]))).alias("gaps"), F.transform("x", lambda e: e["p"]).alias("closes"))


def json_rows(df: DataFrame, key: str) -> DataFrame:
    """key, json: each key's rows as a JSON array in which nulls stay."""
    body = F.struct(*(c for c in df.columns if c != key))
    return df.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(body)), {"ignoreNullFields": "false"}).alias("json"))


def write_shards(df: DataFrame, key: str, folder: str, variable: str = "DATA") -> list[str]:
    """One script file a key, ``window.<variable>[key] = [...]``; files of keys that are gone are removed.

    Files come from the driver row by row, for a site's payload of some megabytes.
    """
    os.makedirs(folder, exist_ok=True)
    made = set()
    for r in json_rows(df, key).toLocalIterator():
        name = f"{r[0]}.js"
        tmp = os.path.join(folder, f".{name}.tmp")
        with open(tmp, "w", encoding="utf-8") as f:
            f.write(f"(window.{variable} = window.{variable} || {{}})[{json.dumps(r[0])}] = {r[1]};\n")
        os.replace(tmp, os.path.join(folder, name))
        made.add(name)
    for name in os.listdir(folder):
        if name.endswith(".js") and name not in made:
            os.remove(os.path.join(folder, name))
    return sorted(made)


def bundle(tables: dict[str, DataFrame], path: str, variable: str) -> None:
    """Several small tables as one script file, replaced at once."""
    out = {k: [json.loads(x) for x in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).toPandas()["j"]] for k, df in tables.items()}
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(f"window.{variable} = {json.dumps(out)};\n")
    os.replace(f"{path}.tmp", path)
