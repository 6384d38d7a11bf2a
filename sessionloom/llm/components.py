"""Connected components of an edge table by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Each
step is one grouped minimum, combined where the edges are, and its join with the
edges, which splits a hub's where they are many; no adjacency list is ever gathered,
and the number of rounds grows with the logarithm of the size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import batch, cut, trimmed


@trimmed
def _contract(batches):
    """Edges of one partition, thinned to a star forest; what is left is at most one edge a node."""
    us, vs = [], []
    for b in batches:
        us.append(b.column(0).to_numpy())
        vs.append(b.column(1).to_numpy())
    if not us:
        return
    ids, inv = np.unique(np.concatenate(us + vs), return_inverse=True)
    n = len(inv) // 2
    a, b = inv[:n], inv[n:]
    label = np.arange(len(ids))
    while True:  # minimum label with pointer jumping
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    keep = np.flatnonzero(label != np.arange(len(ids)))
    yield batch({"u": ids[keep], "v": ids[label[keep]]})


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (u, v) reaches.

    Nodes are longs.  Self loops and repeated edges do not matter; nodes with a
    null end are left out; no edges give no rows.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null")
    loops = edges.where("u = v").select("u").distinct()
    e = cut(edges.where("u <> v").mapInArrow(_contract, "u long, v long"))
    while True:
        # large star: every larger neighbour of a node is tied to the node's least neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours are tied to the least of them
        mins = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = mins.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        new = cut(small)
        stars = new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and new.select("v").distinct().join(new.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
        e = new
        if stars:
            break
    tied = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = tied.unionByName(nodes)
    alone = loops.select(F.col("u").alias("node")).join(out, "node", "left_anti")
    return out.unionByName(alone.select("node", F.col("node").alias("component")))
