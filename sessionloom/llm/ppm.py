"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``order``, with the counts of the
bytes that follow each, taken from the training texts.  A byte is coded in the
longest context that was seen; where it did not follow that context, an escape
is coded (method C: as many escapes as distinct bytes) and the next shorter
context is tried, without the bytes that the longer one has excluded.  Below
order 0 all bytes not excluded are alike.  A text is coded to its end mark, so
the score of the empty text is that of an immediate end.

A context and the byte after it are one integer of ``order + 1`` bytes.  The trie is
a table of these with their counts, partitioned by them: nothing is pruned.  Its
shorter contexts, the totals of each context and what it excludes are sums and joins
of that table, so the probability of every code that any text has, seen in training
or not, is exact.  The codes that occur most are broadcast with their logarithms, and
so are words' counts; the other codes and words of a text travel to the buckets of
the table and come back as sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import vec

ORDER = 5
#: Codes (longest context and byte) whose logarithms are broadcast, the most frequent; the others' are joined.
MAX_NODES = 2_000_000
#: Words whose counts are broadcast for the base score; the others' counts are joined.
MAX_WORDS = 500_000
#: Marks the end of a text, and stands before its start; no UTF-8 text has these bytes.
END, PAD = 0xFF, 0xFE


def codes(data: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of each text and its end mark: context and byte as an integer; and the text."""
    n = len(off) - 1
    size = np.diff(off)
    total = len(data) + n * (order + 1)
    seq = np.full(total, PAD, np.uint8)
    shift = np.arange(n) * (order + 1) + order
    place = np.arange(len(data)) + np.repeat(shift, size)
    seq[place] = data
    ends = off[1:] + shift
    seq[ends] = END
    code = np.zeros(total, np.uint64)
    for k in range(order + 1):
        code[order:] |= seq[k : total - order + k].astype(np.uint64) << np.uint64(8 * (order - k))
    keep = seq != PAD
    return code[keep], np.repeat(np.arange(n), size + 1)


class Table:
    """Values (sorted, 64 bits) with a weight each, found by a hashed slot, else by binary search."""

    def __init__(self, values: np.ndarray, weights: np.ndarray) -> None:
        self.values, self.weights = values, weights
        self.size = 1 << max(10, min(23, int(4 * max(1, len(values))).bit_length()))
        self.slots = np.full(self.size, -1, np.int32)
        self.slots[(vec.mix(values) & np.uint64(self.size - 1)).astype(np.int64)] = np.arange(len(values), dtype=np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, whether they hold the value)."""
        if not len(self.values):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = self.slots[(vec.mix(wanted) & np.uint64(self.size - 1)).astype(np.int64)].astype(np.int64)
        ok = at >= 0
        ok[ok] = self.values[at[ok]] == wanted[ok]
        rest = np.flatnonzero(~ok)
        at[rest] = np.minimum(np.searchsorted(self.values, wanted[rest]), len(self.values) - 1)
        ok[rest] = self.values[at[rest]] == wanted[rest]
        return at, ok


def _count(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    u, inv, n = np.unique(values, return_inverse=True, return_counts=True)
    return u, n.astype(np.int64) if weights is None else np.bincount(inv, weights=weights, minlength=len(u)).astype(np.int64)


COUNTS = ex.pack_schema("value", "n", "docs") + ", kind int"


def _bucket(value: np.ndarray, bits: int) -> np.ndarray:
    return (vec.mix(value) >> np.uint64(64 - bits)).astype(np.int32)  # codes are no hashes: they go by one


def _gather(order: int, bits: int):
    """Counts of a task's texts: kind 0 codes (with no count where they stand in held-out texts), 1 training words (end marks are the word 0)."""

    def rows(kind, parts):
        value = np.concatenate([p[0] for p in parts])
        value, n = _count(value, np.concatenate([p[1] for p in parts]))
        bucket = _bucket(value, bits)
        by = np.argsort(bucket, kind="stable")
        b = ex.pack(bucket[by], {"value": value[by], "n": n[by], "docs": np.zeros(len(by), np.uint8)})
        return b.append_column("kind", pa.array(np.full(len(b), kind, np.int32)))

    def run(batches):
        held: dict[int, list] = {0: [], 1: []}
        for r0, r1, data, off, b_train in ((*c, b.column(2).to_numpy(zero_copy_only=False)) for b in batches for c in vec.chunks(b.column(1))):
            train = b_train[r0:r1]
            data = vec.lower(data)
            code, text = codes(data, off, order)
            held[0].append(_count(code, train[text].astype(np.int64)))
            s, e, wr = vec.word_bounds(data, off)
            h, n = _count(vec.word_hashes(data, s, e)[train[vec.owners(wr)]])
            if train.any():
                held[1].append((np.append(h, np.uint64(0)), np.append(n, int(train.sum()))))
            for kind in (0, 1):
                if sum(len(p[0]) for p in held[kind]) > ex.FLUSH:
                    merged = _count(np.concatenate([p[0] for p in held[kind]]), np.concatenate([p[1] for p in held[kind]]))
                    held[kind] = [merged]
                    if len(merged[0]) > ex.FLUSH // 2:
                        yield rows(kind, held[kind])
                        held[kind] = []
        for kind in (0, 1):
            if held[kind]:
                yield rows(kind, held[kind])

    return run


TOTALS = "kind int, value binary, n binary, size long, total long"


def _total(batches) -> Iterator[pa.RecordBatch]:
    """At a bucket: the counts of all tasks summed."""
    parts: dict[int, list] = {0: [], 1: []}
    for b in batches:
        kind = b.column(4).to_numpy()
        for k in (0, 1):
            x, _, _ = ex.unpack([b.filter(pa.array(kind == k))], value=np.uint64, n=np.int64)
            parts[k].append((x["value"], x["n"]))
    for k in (0, 1):
        if parts[k]:
            v, n = _count(np.concatenate([p[0] for p in parts[k]]), np.concatenate([p[1] for p in parts[k]]))
            for i in range(0, len(v), 500_000):
                yield ex.batch({"kind": np.array([k], np.int32), "value": pa.array([v[i : i + 500_000].tobytes()], pa.binary()), "n": pa.array([n[i : i + 500_000].tobytes()], pa.binary()), "size": np.array([len(v[i : i + 500_000])], np.int64), "total": np.array([int(n[i : i + 500_000].sum())], np.int64)})


def _floor(totals: DataFrame, kind: int, most: int) -> int:
    """The least count such that at most ``most`` values reach it."""

    def hist(batches):
        for b in batches:
            n = np.concatenate([np.frombuffer(x, np.int64) for x in b.column(0).to_pylist()] or [np.zeros(0, np.int64)])
            # counts up to 4096 (0: only in held-out texts) each, beyond that by powers of 2 to 1/8
            u, c = np.unique(np.where(n <= 4096, n, (2.0 ** (np.floor(np.log2(np.maximum(n, 1)) * 8) / 8)).astype(np.int64)), return_counts=True)
            yield ex.batch({"n": u, "c": c.astype(np.int64)})

    h = totals.where(F.col("kind") == kind).select("n").mapInArrow(hist, "n long, c long").groupBy("n").agg(F.sum("c").alias("c")).orderBy(F.desc("n")).collect()
    held, floor = 0, (h[0].n + 1 if h else 0)
    for r in h:
        if held + r.c > most:
            break
        held, floor = held + r.c, r.n
    return floor


def _unpacked(totals: DataFrame, kind: int, least: int, below: int | None = None) -> DataFrame:
    """Rows (value, n) of a kind with counts from ``least``, and under ``below``."""

    def rows(batches):
        for b in batches:
            for v, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v, n = np.frombuffer(v, np.int64), np.frombuffer(n, np.int64)
                ok = n >= least if below is None else (n >= least) & (n < below)
                yield ex.batch({"value": v[ok], "n": n[ok]})

    return totals.where(F.col("kind") == kind).select("value", "n").mapInArrow(rows, "value long, n long")


def _logarithms(seen: DataFrame, order: int, unseen: DataFrame) -> DataFrame:
    """(value, n, w): log10 of the probability of every code, of those in training (value, n) and of the others (value)."""
    mask = lambda k: (1 << (8 * (k + 1))) - 1
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("value").bitwiseAND(F.lit(mask(k))).alias("code")) for k in range(order + 1)))).alias("x")
    nodes = ex.cut(seen.select(each, "n").groupBy("x.k", "x.code").agg(F.sum("n").alias("n")))
    shorter = nodes.select((F.col("k") + 1).alias("k"), F.col("code").alias("short"), F.col("n").alias("taken"))
    cut_off = F.lit(0).cast("long")
    for k in range(1, order + 1):
        cut_off = F.when(F.col("k") == k, F.col("code").bitwiseAND(F.lit(mask(k - 1)))).otherwise(cut_off)
    # for each context: total, distinct bytes, and what these count in the next shorter context
    both = nodes.withColumn("short", cut_off).join(shorter, ["k", "short"], "left")
    contexts = ex.cut(both.groupBy("k", F.shiftrightunsigned("code", 8).alias("ctx")).agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum(F.coalesce("taken", F.lit(0))).alias("taken")))
    top = contexts.where(F.col("k") == order).select("ctx", "total", "distinct")
    known = seen.withColumn("ctx", F.shiftrightunsigned("value", 8)).join(top, "ctx").select("value", "n", F.log10(F.col("n") / (F.col("total") + F.col("distinct"))).alias("w"))
    # the others are escaped through the shorter contexts, of which orders 0 and 1 have at most 2 ** 16 nodes
    steps = unseen.select("value", each).select("value", "x.k", "x.code", F.shiftrightunsigned("x.code", 8).alias("ctx"))
    found = None
    for part, hint in (("k <= 1", F.broadcast), ("k > 1", lambda df: df)):
        mine = steps.where(part).join(hint(contexts.where(part)), ["k", "ctx"], "left").join(hint(nodes.where(part)), ["k", "code"], "left")
        found = mine if found is None else found.unionByName(mine)
    wide = found.groupBy("value").agg(*(F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(order + 1) for c in ("total", "distinct", "taken", "n")))
    w, closed = F.lit(0.0), F.lit(False)
    for k in range(order, -1, -1):
        col = lambda c: F.col(f"{c}{k}")  # noqa: B023, E731
        less = lambda c: F.coalesce(F.col(f"{c}{k + 1}"), F.lit(0)) if k < order else F.lit(0)  # noqa: B023, E731
        distinct = col("distinct") - less("distinct")
        all_ = F.greatest(col("total") - less("taken") + distinct, F.lit(1))
        w = w + F.when(closed | col("total").isNull(), 0.0).when(col("n").isNotNull(), F.log10(col("n") / all_)).when(distinct > 0, F.log10(distinct / all_)).otherwise(0.0)
        closed = closed | col("n").isNotNull()
    w = w - F.when(closed, 0.0).otherwise(F.log10(F.greatest(F.lit(1), F.lit(256) - F.coalesce("distinct0", F.lit(0)))))
    return known.unionByName(wide.select("value", F.lit(0).cast("long").alias("n"), w.alias("w")))


def _packed(batches):
    for b in batches:
        yield ex.batch({"v": pa.array([b.column(0).to_numpy().tobytes()], pa.binary()), "w": pa.array([b.column(1).to_numpy().tobytes()], pa.binary())})


def _packed_words(least: int):
    """Words of the totals' packed rows that have that count."""

    def run(batches):
        for b in batches:
            for v, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v, n = np.frombuffer(v, np.uint64), np.frombuffer(n, np.int64)
                ok = n >= least
                yield ex.batch({"v": pa.array([v[ok].tobytes()], pa.binary()), "w": pa.array([n[ok].astype(np.float64).tobytes()], pa.binary())})

    return run


def _sorted(table: DataFrame, pack) -> tuple[np.ndarray, np.ndarray]:
    """Values, sorted, and what goes with them, sent to the driver packed.

    One function packs what the table has: two in a row would be two workers a task.
    """
    values, weights = [np.zeros(0, np.uint64)], [np.zeros(0, np.float64)]
    for r in table.mapInArrow(ex.trimmed(pack), "v binary, w binary").toLocalIterator():
        values.append(np.frombuffer(r.v, np.uint64))
        weights.append(np.frombuffer(r.w, np.float64))
    v = np.concatenate(values)
    order = np.argsort(v)
    return v[order], np.concatenate(weights)[order]


_built: list = []


def _tables(model) -> tuple[Table, Table]:
    """The tables of a broadcast, made once in a worker."""
    value = model.value
    if not _built or _built[0][0] is not value:
        _built[:] = [(value, (Table(*value[:2]), Table(*value[2:])))]
    return _built[0][1]


def _parts(order: int, model, n_train: int, vocabulary: int):
    """For chunks of texts: what the broadcast tables say of them, and the codes and words they do not have."""
    below = n_train + 0.1 * (vocabulary + 1)

    def part(data, off):
        contexts, words = _tables(model)
        n = len(off) - 1
        data = vec.lower(data)
        code, text = codes(data, off, order)
        at, has = contexts.find(code)
        score = np.bincount(text[has], weights=contexts.weights[at[has]], minlength=n)
        s, e, wr = vec.word_bounds(data, off)
        h, owner = vec.word_hashes(data, s, e), vec.owners(wr)
        at, known = words.find(h)
        ends = words.weights[0] if len(words.values) and words.values[0] == 0 else 0
        base = np.bincount(owner[known], weights=np.log10((words.weights[at[known]] + 0.1) / below), minlength=n) + np.log10((ends + 0.1) / below)
        n_known = np.bincount(owner[known], minlength=n).astype(np.int64) + (ends > 0)
        return np.diff(wr).astype(np.int64) + 1, n_known, base, score, (text[~has], code[~has]), (owner[~known], h[~known])

    return part, np.log10(0.1 / below)


SCORES = "doc_id long, n_tokens long, n_known long, base double, score double"


def _scores(part, unknown: float):
    """Where the broadcast tables hold all: other words are unknown, and other codes there are none."""

    def run(batches):
        for ids, data, off in ex.text_chunks(batches):
            n_tokens, n_known, base, score, _, (owner, _) = part(data, off)
            yield ex.batch({"doc_id": ids, "n_tokens": n_tokens, "n_known": n_known, "base": base + unknown * np.bincount(owner, minlength=len(ids)), "score": score})

    return run


#: Kinds: 0 codes and 1 words of texts (docs: the texts' ids and tags), 2 and 3 the table's entries, 4 sums for texts, 5 texts.
MOVED = "bucket int, kind int, value binary, who binary, n binary, docs binary, sums binary"
_EMPTY = pa.binary()


def _moved(kind: int, bucket: np.ndarray, **columns) -> pa.RecordBatch:
    """One row for each run of a bucket (sorted); columns that are not given are empty."""
    rows = ex.pack(bucket, columns)
    out = {"bucket": rows.column(0), "kind": pa.array(np.full(len(rows), kind, np.int32))}
    for c in ("value", "who", "n", "docs", "sums"):
        i = rows.schema.get_field_index(c)
        out[c] = rows.column(i) if i >= 0 else pa.array([b""] * len(rows), _EMPTY)
    return pa.RecordBatch.from_arrays(list(out.values()), list(out))


def _doc_order(docs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = _bucket(docs[:, 0].view(np.uint64) ^ vec.mix(docs[:, 1].view(np.uint64)), bits)
    order = np.argsort(bucket, kind="stable")
    return bucket[order], order


def _send(part, bits: int):
    """Every distinct text of a chunk with its sums so far and how often it stands there; and its other codes and words."""

    def flush(kind, held):
        value, who, docs, at = [], [], [], 0
        for v, w, d in held:
            value.append(v)
            who.append(w + at)
            docs.append(d)
            at += len(d)
        value, who, docs = np.concatenate(value), np.concatenate(who), np.concatenate(docs)
        bucket = _bucket(value, bits)
        order = np.lexsort((who, value, bucket))
        bucket, value, who = bucket[order], value[order], who[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (who[1:] != who[:-1])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(value))).astype(np.int32)
        bucket, value, who = bucket[at], value[at], who[at].astype(np.int32)
        starts, names = np.append(ex.group_starts(bucket), len(bucket)), []
        for a, z in zip(starts[:-1], starts[1:]):
            mine, who[a:z] = np.unique(who[a:z], return_inverse=True)
            names.append(docs[mine].tobytes())
        rows = _moved(kind, bucket, value=value, who=who, n=n)
        return rows.set_column(5, "docs", pa.array(names, _EMPTY))

    def run(batches):
        held, size = {0: [], 1: []}, {0: 0, 1: 0}
        for b in batches:
            ids, tags = b.column(0).to_numpy(), b.column(2).to_numpy()
            for r0, r1, data, off in vec.chunks(b.column(1)):
                n_tokens, n_known, base, score, *others = part(data, off)
                docs = np.column_stack([ids[r0:r1], tags[r0:r1]])
                docs, row, own, n = np.unique(docs, axis=0, return_index=True, return_inverse=True, return_counts=True)
                first = np.full(len(own), -1)
                first[row] = np.arange(len(row))
                bucket, order = _doc_order(docs, bits)
                sums = np.column_stack([base[row], score[row]])[order]
                yield _moved(5, bucket, docs=docs[order].reshape(-1).view("V16"), n=np.column_stack([n, n_tokens[row], n_known[row]]).astype(np.int64)[order].reshape(-1).view("V24"), sums=sums.reshape(-1).view("V16"))
                for kind, (text, value) in enumerate(others):
                    mine = first[text] >= 0
                    held[kind].append((value[mine], first[text[mine]], docs))
                    size[kind] += int(mine.sum())
                    if size[kind] >= ex.FLUSH // 2:
                        yield flush(kind, held[kind])
                        held[kind], size[kind] = [], 0
        for kind in (0, 1):
            if size[kind]:
                yield flush(kind, held[kind])

    return run


def _entries(kind: int, bits: int, v: np.ndarray, n: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    """Rows of the table by bucket: values with their counts and logarithms."""
    bucket = _bucket(v, bits)
    order = np.argsort(bucket, kind="stable")
    return _moved(2 + kind, bucket[order], value=v[order], n=n[order].astype(np.int64), sums=w[order].astype(np.float64))


def _code_entries(bits: int):
    def run(batches):
        for b in batches:
            yield _entries(0, bits, b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy())

    return run


def _word_entries(bits: int, below_count: int, below: float):
    """The words of the totals' packed rows that are not broadcast."""

    def run(batches):
        for b in batches:
            for v, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v, n = np.frombuffer(v, np.uint64), np.frombuffer(n, np.int64)
                ok = n < below_count
                yield _entries(1, bits, v[ok], n[ok], np.log10((n[ok] + 0.1) / below))

    return run


def _look_up(bits: int, unknown: float):
    """At a bucket of values, the table's rows first: sums of each text's codes and words; texts pass through."""

    def run(batches):
        table = {0: [], 1: []}
        for b in batches:
            kinds = b.column(1).to_numpy()
            if (kinds == 5).any():
                yield b.filter(pa.array(kinds == 5))
            for k in (0, 1):
                mine = b.filter(pa.array(kinds == 2 + k))
                if len(mine):
                    x, _, _ = ex.unpack([mine], value=np.uint64, n=np.int64, sums=np.float64)
                    table[k].append(x)
            for k in (0, 1):
                for row in b.filter(pa.array(kinds == k)).to_pylist():
                    if len(table[k]) != 1 or "table" not in table[k][0]:
                        x = {c: np.concatenate([t[c] for t in table[k]]) if table[k] else np.zeros(0, d) for c, d in (("value", np.uint64), ("n", np.int64), ("sums", np.float64))}
                        order = np.argsort(x["value"])
                        x = {c: v[order] for c, v in x.items()}
                        table[k] = [x | {"table": Table(x["value"], x["sums"])}]
                    t = table[k][0]
                    value, who, tf = np.frombuffer(row["value"], np.uint64), np.frombuffer(row["who"], np.int32), np.frombuffer(row["n"], np.int32)
                    docs = np.frombuffer(row["docs"], np.int64).reshape(-1, 2)
                    at, has = t["table"].find(value)
                    w = np.where(has, t["sums"][at] if len(t["sums"]) else 0.0, unknown if k else 0.0) * tf
                    known = np.where(has, tf, 0) if k else np.zeros(len(tf))
                    sums = np.zeros((len(docs), 3))
                    sums[:, 1 - k] = np.bincount(who, weights=w, minlength=len(docs))
                    sums[:, 2] = np.bincount(who, weights=known, minlength=len(docs))
                    bucket, order = _doc_order(docs, bits)
                    yield _moved(4, bucket, docs=docs[order].reshape(-1).view("V16"), sums=sums[order].reshape(-1).view("V24"))

    return run


def _gathered(batches):
    """At a bucket of texts: a row for each time a text stands in the table, with all its sums."""
    texts, sums = [], []
    for b in batches:
        kinds = b.column(1).to_numpy()
        for kind, width, held in ((5, 2, texts), (4, 3, sums)):
            mine = b.filter(pa.array(kinds == kind))
            if len(mine):
                docs = np.frombuffer(b"".join(mine.column(5).to_pylist()), np.int64).reshape(-1, 2)
                n = np.frombuffer(b"".join(mine.column(4).to_pylist()), np.int64).reshape(-1, 3) if kind == 5 else None
                held.append((docs, np.frombuffer(b"".join(mine.column(6).to_pylist()), np.float64).reshape(-1, width), n))
    if not texts:
        return
    docs, own, n = (np.concatenate([t[i] for t in texts]) for i in range(3))
    order = np.lexsort((docs[:, 1], docs[:, 0]))
    docs, own, n = docs[order], own[order], n[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    sent = np.diff(np.append(at, len(docs)))  # chunks that have the text: each sent its codes and words
    times, docs, own, n = np.add.reduceat(n[:, 0], at), docs[at], own[at], n[at]
    more = np.zeros((len(docs), 3))
    if sums:
        d, s = np.concatenate([x[0] for x in sums]), np.concatenate([x[1] for x in sums])
        order = np.lexsort((d[:, 1], d[:, 0]))
        d, s = d[order], s[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        place = np.searchsorted(docs.view("i8,i8").ravel(), np.ascontiguousarray(d[first]).view("i8,i8").ravel())
        more[place] = np.add.reduceat(s, first, axis=0)
    more /= sent[:, None]
    columns = (docs[:, 0], n[:, 1], n[:, 2] + np.rint(more[:, 2]).astype(np.int64), own[:, 0] + more[:, 0], own[:, 1] + more[:, 1])
    ends = np.cumsum(times)
    for a in range(0, int(ends[-1]), 100_000):
        i = np.searchsorted(ends, np.arange(a, min(a + 100_000, int(ends[-1]))), "right")
        yield ex.batch(dict(zip(("doc_id", "n_tokens", "n_known", "base", "score"), (c[i] for c in columns))))


def ppm_scores(spark, docs: DataFrame, order: int = ORDER, max_nodes: int = MAX_NODES, max_words: int = MAX_WORDS, held_out: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of whole texts.

    Texts whose ``crc32(doc_id as text) mod held_out`` is not 0 train both models;
    all are scored, A-Z lower-cased.  ``base_score`` is that of words (and an end
    token) with additive smoothing; ``score`` is that of the bytes (and an end
    mark) under PPM.  ``max_nodes`` codes and ``max_words`` words, the most frequent,
    are looked up in broadcast tables, the others in a partitioned one: both scores
    are exact whatever these are.

    Null texts count as empty.  Rows with a null doc_id are left out; repeated rows
    count and are scored each.  Other columns are ignored.  Without training texts
    every byte has the probability 1/256 and N is 0.
    """
    ex.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out == 0
    bits = ex.bucket_bits(ex.input_bytes(docs), 4 * ex.BUCKET_BYTES)
    totals = ex.cut(ex.by_bucket(docs.withColumn("train", ~held).mapInArrow(ex.trimmed(_gather(order, bits)), COUNTS), bits).mapInArrow(ex.trimmed(_total), TOTALS))
    sums = totals.where("kind = 1").agg(F.sum("total").alias("n"), F.sum("size").alias("v")).first()
    n_train, vocabulary = int(sums.n or 0), int(sums.v or 0)
    below = n_train + 0.1 * (vocabulary + 1)
    context_floor, word_floor = _floor(totals, 0, max_nodes), _floor(totals, 1, max_words)
    weighed = ex.cut(_logarithms(_unpacked(totals, 0, 1), order, _unpacked(totals, 0, 0, 1)))
    codes_, logs = _sorted(weighed.where(F.col("n") >= context_floor).select("value", "w"), _packed)
    word_rows = totals.where("kind = 1").select("value", "n")
    words, counts = _sorted(word_rows, _packed_words(word_floor))
    if n_train and (not len(words) or words[0] != 0):  # the end token is always known
        words, counts = np.concatenate([np.zeros(1, np.uint64), words]), np.concatenate([np.array([float(docs.where(~held).count())]), counts])
    model = spark.sparkContext.broadcast((codes_, logs, words, counts))
    part, unknown = _parts(order, model, n_train, vocabulary)
    if vocabulary <= len(words) and not context_floor:
        scored = docs.mapInArrow(ex.trimmed(_scores(part, unknown)), SCORES)
    else:
        moved = docs.withColumn("tag", F.xxhash64("text")).mapInArrow(ex.trimmed(_send(part, bits)), MOVED)
        moved = moved.unionByName(weighed.where(F.col("n") < context_floor).select("value", "n", "w").mapInArrow(ex.trimmed(_code_entries(bits)), MOVED))
        moved = moved.unionByName(word_rows.mapInArrow(ex.trimmed(_word_entries(bits, word_floor, below)), MOVED))
        first = moved.repartitionById(1 << bits, F.col("bucket")).sortWithinPartitions(~F.col("kind").isin(2, 3))
        scored = ex.by_bucket(first.mapInArrow(ex.trimmed(_look_up(bits, unknown)), MOVED), bits).mapInArrow(ex.trimmed(_gathered), SCORES)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
