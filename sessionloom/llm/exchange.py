"""Moving many small numbers between tasks as few large rows.

A text has hundreds of shingles or windows.  As Spark rows each would cost a
microsecond and 24 bytes; here a map task sorts a *flush* of some million of
them by key and sends one row for each bucket, whose columns are arrays packed
into ``binary``.  The bucket is the top bits of a 64-bit hash, so buckets are
even, and a key that is hot sends at most one entry for each flush where the
caller pre-aggregates it.
"""

from __future__ import annotations

import ctypes
import math
import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a task holds before it sends them.
FLUSH = 1_500_000
#: Bytes of input (as Spark estimates its size) for each bucket.
BUCKET_BYTES = 4 << 20
#: A list of ids or hashes is broadcast up to this many rows, joined by a shuffle beyond it.
BROADCAST_ROWS = 1_000_000


def prepare(spark: SparkSession, size: int = 0) -> None:
    """What a query needs of its session: code for the workers, bounds for their memory, a checkpoint folder.

    With the size of the input, shuffles begin with a partition for each bucket's
    bytes of it, which adaptive execution then joins.
    """
    _ship(spark)
    start = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    want = min(20_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES))
    if int(spark.conf.get(start, None) or 0) < want:
        spark.conf.set(start, str(want))
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)), ("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")):
        try:
            if spark.conf.get(key) in (None, "10000", "-1", str(2**63 - 1), "256MB", str(256 << 20), str(64 << 20)):
                spark.conf.set(key, value)
        except Exception as e:  # a Spark without the setting
            if "SQL_CONF_NOT_FOUND" not in str(e):
                raise
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = os.path.join(tempfile.gettempdir(), "sessionloom-checkpoints")
        spark.sparkContext.setCheckpointDir(shared)


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Give the workers this package, unless they start where they find it."""
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    found = Path.cwd() == root or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if sc.applicationId in _shipped or (sc.master.startswith("local") and found):
        return
    name = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted((root / __package__.split(".")[0]).rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(name))
    _shipped.add(sc.applicationId)


def trimmed(run):
    """A task's function that gives freed memory back to the system at its end: the worker lives on, beside others."""

    def out(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return out


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder: computed once, and safe when executors are lost."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def input_bytes(df: DataFrame) -> int:
    """The size of a DataFrame with a column text: file sizes for a scan, else half its text is counted."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 50:
        return known
    return int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2


def by_row(docs: DataFrame) -> DataFrame:
    """The rows (doc_id, text, ...) with ``row_id``, which names a text: the doc_id where all its rows have one text.

    Where rows repeat a doc_id with other texts, each goes by a hash of both, below
    any other id, so that what is found of one of them is not done to the others.
    """
    tag = F.xxhash64("text")
    mixed = cut(docs.groupBy("doc_id").agg(F.min(tag).alias("a"), F.max(tag).alias("b")).where("a <> b").select("doc_id", F.lit(True).alias("mixed")))
    n = mixed.count()
    if not n:
        return docs.withColumn("row_id", F.col("doc_id"))
    named = docs.join(F.broadcast(mixed) if n <= BROADCAST_ROWS else mixed, "doc_id", "left")
    low = F.lit(-(1 << 62)) - F.shiftrightunsigned(F.xxhash64("doc_id", tag), 2)
    return named.withColumn("row_id", F.when(F.col("mixed"), low).otherwise(F.col("doc_id"))).drop("mixed")


def bucket_bits(size: int, per: int = BUCKET_BYTES) -> int:
    """Bits of the hash that name a bucket: about one bucket for each ``per`` bytes of input."""
    return min(20, max(3, math.ceil(math.log2(max(1, size / per)))))


def pack(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each run of equal ``bucket`` values (sorted); each column packed as bytes."""
    if len(bucket):
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    else:
        at = np.zeros(0, np.int64)
    ends = np.append(at, len(bucket))
    out = [pa.array(bucket[at].astype(np.int32))]
    for v in columns.values():
        v = np.ascontiguousarray(v)
        offsets = (ends * v.itemsize).astype(np.int32)
        out.append(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(v)]))
    return pa.RecordBatch.from_arrays(out, ["bucket", *columns])


def squeeze(values: np.ndarray) -> bytes:
    """Small non-negative integers compressed: their bytes by place, so that the high ones cost nothing."""
    return pa.compress(np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unsqueeze(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def pack_schema(*columns: str) -> str:
    return "bucket int, " + ", ".join(f"{c} binary" for c in columns)


def unpack(batches: Iterable[pa.RecordBatch], **kinds: type) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The entries of all rows, the length of each row's columns' entries, and the buckets."""
    parts: dict[str, list[np.ndarray]] = {k: [] for k in kinds}
    lengths, buckets = [], []
    for batch in batches:
        for i, (k, kind) in enumerate(kinds.items()):
            column = batch.column(batch.schema.get_field_index(k))
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            raw = column.buffers()[2]
            raw = raw if raw is not None else b""
            parts[k].append(np.frombuffer(np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]].tobytes(), kind))
            if i == 0:
                lengths.append(np.diff(offsets) // np.dtype(kind).itemsize)
        buckets.append(batch.column(batch.schema.get_field_index("bucket")).to_numpy(zero_copy_only=False))
    join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    return {k: join(v, kinds[k]) for k, v in parts.items()}, join(lengths, np.int64), join(buckets, np.int32)


def by_bucket(df: DataFrame, bits: int) -> DataFrame:
    """Each bucket to a partition of its own."""
    return df.repartitionById(1 << bits, F.col("bucket"))


def group_starts(key: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    if not len(key):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def semi(df: DataFrame, ids: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids``: by broadcast where the counted rows allow it."""
    return df.join(F.broadcast(ids) if rows <= BROADCAST_ROWS else ids, key, "left_semi")


def anti(df: DataFrame, ids: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows of ``df`` whose key is not in ``ids``; rows with a null key stay."""
    return df.join(F.broadcast(ids) if rows <= BROADCAST_ROWS else ids, key, "left_anti")


def batch(columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], list(columns))


def text_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, bytes, offsets) of chunks of batches with columns doc_id and text."""
    from . import vec

    for b in batches:
        ids = b.column(b.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
        for r0, r1, data, off in vec.chunks(b.column(b.schema.get_field_index("text"))):
            yield ids[r0:r1], data, off
