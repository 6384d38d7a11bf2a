"""Conflict-constrained best-fit packing of texts into training sequences.

Bins are ordered by what is left in them and carry bitmaps of the sources and
duplicate clusters they hold.  A piece goes to the tightest compatible bin: the
search starts at the least residual that holds it and continues to the next
larger until the bitmaps allow it.  Groups of rows, made by a hash of the
document and bounded in size, are packed independently, so no task holds more
than a group whatever the source or cluster.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .jaccard import grouped

CAPACITY = 2048
#: Pieces of one source in a bin.
PER_SOURCE = 2
#: Documents of a group that is packed by itself.
GROUP = 8192


class Bins:
    """Best fit under conflicts; bitmaps are integers with a bit for each local source or cluster."""

    def __init__(self, capacity: int, per_source: int) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.residuals: list[int] = []  # those with an open bin, ascending
        self.at: dict[int, list[int]] = {}
        self.sources: list[list[int]] = []  # bin -> bitmaps: source held once, twice, ...
        self.clusters: list[int] = []
        self.left: list[int] = []

    def _compatible(self, b: int, source: int, cluster: int) -> bool:
        return not (self.sources[b][-1] & source or self.clusters[b] & cluster)

    def _file(self, b: int) -> None:
        left = self.left[b]
        if left:
            if left not in self.at:
                self.at[left] = []
                insort(self.residuals, left)
            self.at[left].append(b)

    def place(self, size: int, source: int, cluster: int) -> int:
        i = bisect_left(self.residuals, size)
        while i < len(self.residuals):
            bins = self.at[self.residuals[i]]
            for k, b in enumerate(bins):
                if self._compatible(b, source, cluster):
                    bins.pop(k)
                    if not bins:
                        del self.at[self.residuals.pop(i)]
                    return self._put(b, size, source, cluster)
            i += 1
        self.sources.append([0] * self.per_source)
        self.clusters.append(0)
        self.left.append(self.capacity)
        return self._put(len(self.left) - 1, size, source, cluster)

    def _put(self, b: int, size: int, source: int, cluster: int) -> int:
        held = self.sources[b]
        for level in range(self.per_source):
            if not held[level] & source:
                held[level] |= source
                break
        self.clusters[b] |= cluster
        self.left[b] -= size
        self._file(b)
        return b


OUT = "bin_id long, slot int, doc_id long, piece int, start long, length long, left_over long"


def _pack(capacity: int, per_source: int):
    @ex.trimmed
    def run(batches):
        for t in grouped(batches, "g"):
            g = t["g"][0].as_py()
            rows = sorted(zip(*(t[c].to_pylist() for c in ("doc_id", "length", "source", "cluster"))), key=lambda r: (r[0], r[1], r[2] or "", r[3]))
            pieces, sources, clusters = [], {}, {}
            for r, (doc, length, source, cluster) in enumerate(rows):
                s = 1 << sources.setdefault(source, len(sources))
                c = 1 << clusters.setdefault(cluster, len(clusters))
                for k, a in enumerate(range(0, length, capacity)):
                    pieces.append((min(capacity, length - a), doc, k, a, s, c))
            pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
            bins, slots, out = Bins(capacity, per_source), {}, []
            for size, doc, k, a, s, c in pieces:
                b = bins.place(size, s, c)
                slot = slots.get(b, 0)
                slots[b] = slot + 1
                out.append((b, slot, doc, k, a, size))
            if out:
                b, slot, doc, k, a, size = (np.array(x) for x in zip(*out))
                yield ex.batch({"bin_id": (np.int64(g) << np.int64(24)) + b, "slot": slot.astype(np.int32), "doc_id": doc.astype(np.int64), "piece": k.astype(np.int32), "start": a.astype(np.int64), "length": size.astype(np.int64), "left_over": np.array(bins.left, np.int64)[b]})

    return run


def best_fit_packing(spark, docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, cluster=None) -> DataFrame:
    """bin_id, slot, doc_id, piece, start, length, left_over: every word of every text in one bin.

    Texts are measured in words and cut into pieces of at most ``capacity``.  A bin
    holds no two pieces of one duplicate cluster (``cluster``: a column, by default
    a hash of the text, so exact copies never meet) and at most ``per_source`` of
    one source (null is a source like others).  ``left_over`` is the room left in
    the piece's bin.

    Null and empty texts need no bin and give no row; rows with a null doc_id are
    left out; repeated rows are copies of one cluster.  Other columns are ignored.
    """
    ex.prepare(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.trim(text, F.lit("\x20\x09\x0a\x0b\x0c\x0d"))
    length = F.when(F.length(trimmed) == 0, 0).otherwise(F.regexp_count(trimmed, F.lit(r"[\x20\x09-\x0D]+")) + 1)
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), length.cast("long").alias("length"), source.alias("source"), F.coalesce(cluster if cluster is not None else F.xxhash64(text), F.xxhash64("doc_id")).alias("cluster"))
    rows = ex.cut(rows.where("length > 0"))
    n = rows.count()
    groups = max(1, -(-n // GROUP))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    parts = max(1, min(groups, 4096))
    return rows.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(_pack(capacity, per_source), OUT)
