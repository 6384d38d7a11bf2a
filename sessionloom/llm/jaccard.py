"""Exact n-gram Jaccard join: size-aware, inverted lists for heavy and subsets for light sets.

The sets are the distinct word n-grams of the texts.

1. One pass over the texts counts for each set how many of its elements occur in
   another set.  A set that links with anything shares at least
   ``ceil(threshold * size)`` elements, so most texts leave here.  Equal sets
   become one class.  An element found twice within a flush is counted there and
   sends one entry, so hot elements hardly move.
2. The classes left order their shared elements from rare to common.  *Light*
   sets (at most ``x`` elements) enumerate the subsets of the fixed size that a
   linked light partner must share; *heavy* sets enter their rarest elements
   (those of which a partner must have one) in inverted lists, which are scanned.
   ``x`` is chosen by cost: how many sets of each size there are and how long the
   lists of their elements are is measured first.  A long list is scanned in blocks,
   of which each two meet in a group of their own.
3. Each candidate pair is verified once, on whole sets that travel to a block of
   classes and not to each pair.

Hot elements, in ``hot_df`` texts or more, are at most ``postings / hot_df`` in
number, which bounds the list of them that is broadcast; the order of elements
puts them last.
"""

from __future__ import annotations

import itertools
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import vec
from .components import connected_components

#: Largest set for which subsets may be enumerated.
LIGHT_MAX = 12
#: Classes of a block, and elements of their sets; the sets of two blocks meet in a verification task.
BLOCK, BLOCK_ELEMENTS = 256, 1 << 20
#: Entries of an inverted list that are scanned together; a longer list is split.
LIST = 4000
#: What a scanned pair costs beside an entry that is sent to a list.
PAIR = 0.1


def need(percent: int, size):
    """Elements that a set of ``size`` shares at least with any set it links with."""
    return -(-percent * size // 100)


def overlap(percent: int, s: int, t: int) -> int:
    """Least intersection of linked sets of sizes s and t."""
    return -(-percent * (s + t) // (100 + percent))


def order_within(values: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    """Order by (text, value) of values that come grouped by text."""
    bounds = np.searchsorted(texts, np.arange(n + 1))
    order = np.empty(len(values), np.int64)
    for a, b in zip(bounds[:-1], bounds[1:]):
        order[a:b] = np.argsort(values[a:b]) + a
    return order


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each lower-cased text, sorted within it: hashes, text numbers, set sizes."""
    data = vec.lower(data)
    s, e, wr = vec.word_bounds(data, off)
    h = vec.word_hashes(data, s, e)
    g = vec.run_hashes(h, width)
    n_words, owner = np.diff(wr), vec.owners(wr)
    whole = owner[: len(g)] == owner[width - 1 :] if len(g) else np.zeros(0, bool)
    values, texts = g[whole], owner[: len(g)][whole]
    order = order_within(values, texts, len(off) - 1)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):  # the whole sequence is one element, told from others by its length
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * vec.power(vec._P, len(h)), dtype=np.uint64)])
        one = (sums[wr[short + 1]] - sums[wr[short]]) * vec.power(vec._P_INV, len(h) + 1)[wr[short]]
        values = np.concatenate([values[order], vec.mix(one + n_words[short].astype(np.uint64))])
        texts = np.concatenate([texts[order], short])
        order = np.argsort(texts, kind="stable")
    values, texts = values[order], texts[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (texts[1:] != texts[:-1])
    values, texts = values[keep], texts[keep]
    return values, texts, np.bincount(texts, minlength=len(off) - 1)


def _set_keys(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits that name each set."""
    ends = np.cumsum(sizes)
    out = np.zeros((len(sizes), 2), np.int64)
    for c, mult in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(vec.mix(values * np.uint64(mult)), dtype=np.uint64)])
        out[:, c] = (sums[ends] - sums[ends - sizes]).view(np.int64)
    return out


SCAN = ex.pack_schema("value", "who", "ids", "info")


def _scan(width: int, bits: int):
    """Step 1, where the texts are: elements by bucket, and a record of each set."""
    shift = np.uint64(64 - bits)

    def flush(hold):
        values, texts, ids, sizes, keys = (np.concatenate(x) for x in zip(*hold))
        hold.clear()
        order = np.argsort(values)
        v, t = values[order], texts[order]
        del values, texts, order
        at = ex.group_starts(v)
        count = np.diff(np.append(at, len(v))).astype(np.int32)
        local = np.bincount(t[np.repeat(count > 1, count)], minlength=len(ids)).astype(np.int64)
        who = np.where(count == 1, t[at], -count)
        v = v[at]
        del t, at, count
        bucket = (v >> shift).astype(np.int32)
        starts = ex.group_starts(bucket)
        names = []
        for a, b in zip(starts, np.append(starts[1:], len(bucket))):
            single = who[a:b] >= 0
            mine, renamed = np.unique(who[a:b][single], return_inverse=True)
            who[a:b][single] = renamed
            names.append(ids[mine].tobytes())
        rows = ex.pack(bucket, {"value": v, "who": who})
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names, pa.binary()), pa.array([b""] * len(names), pa.binary())], ["bucket", "value", "who", "ids", "info"])
        # a record goes by its text's id, so a task that is run again sends it to the same bucket
        info = np.column_stack([ids, sizes, keys, local]).astype(np.int64)
        bucket = _doc_bucket(ids, bits)
        order = np.argsort(bucket, kind="stable")
        rows = ex.pack(bucket[order], {"info": info[order].reshape(-1).view("V40")})
        none = pa.array([b""] * len(rows), pa.binary())
        yield pa.RecordBatch.from_arrays([rows.column(0), none, none, none, rows.column(1)], ["bucket", "value", "who", "ids", "info"])

    @ex.trimmed
    def run(batches):
        hold, held, texts_at = [], 0, 0
        for ids, data, off in ex.text_chunks(batches):
            values, texts, sizes = shingle_sets(data, off, width)
            hold.append((values, (texts + texts_at).astype(np.int32), ids, sizes, _set_keys(values, sizes)))
            held, texts_at = held + len(values), texts_at + len(ids)
            if held >= ex.FLUSH:
                yield from flush(hold)
                hold, held, texts_at = [], 0, 0
        if hold:
            yield from flush(hold)

    return run


CREDIT = "kind int, doc_id long, n long, k1 long, k2 long, shared long"


def _credit(hot_df: int):
    """Step 1, at a bucket: elements in two sets or more are credited to their texts."""

    @ex.trimmed
    def run(batches):
        values, whos, docs = [], [], []
        for b in batches:
            for value, who, ids, info in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4))):
                if info:
                    x = np.frombuffer(info, np.int64).reshape(-1, 5)
                    yield ex.batch({"kind": np.zeros(len(x), np.int32), "doc_id": x[:, 0], "n": x[:, 1], "k1": x[:, 2], "k2": x[:, 3], "shared": x[:, 4]})
                if value:
                    who = np.frombuffer(who, np.int32)
                    ids = np.frombuffer(ids, np.int64)
                    values.append(np.frombuffer(value, np.uint64))
                    whos.append(np.where(who < 0, who, 0).astype(np.int32))
                    doc = np.zeros(len(who), np.int64)
                    doc[who >= 0] = ids[who[who >= 0]]
                    docs.append(doc)
        if not values:
            return
        v, w, d = np.concatenate(values), np.concatenate(whos), np.concatenate(docs)
        del values, whos, docs
        order = np.argsort(v)
        v, w, d = v[order], w[order], d[order]
        at = ex.group_starts(v)
        df = np.add.reduceat(np.where(w < 0, -w, 1).astype(np.int64), at)
        entries = np.diff(np.append(at, len(v)))
        ids, shared = np.unique(d[(w == 0) & np.repeat(df >= 2, entries)], return_counts=True)
        none = np.zeros(len(ids), np.int64)
        yield ex.batch({"kind": none.astype(np.int32), "doc_id": ids, "n": none, "k1": none, "k2": none, "shared": shared.astype(np.int64)})
        hot = np.flatnonzero(df >= hot_df)
        none = np.zeros(len(hot), np.int64)
        yield ex.batch({"kind": none.astype(np.int32) + 1, "doc_id": v[at[hot]].view(np.int64), "n": df[hot], "k1": none, "k2": none, "shared": none})

    return run


POSTINGS = ex.pack_schema("value", "doc", "df") + ", kind int"


def _doc_bucket(docs: np.ndarray, bits: int) -> np.ndarray:
    return (vec.mix(docs.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)


def _kinded(rows: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    return rows.append_column("kind", pa.array(np.full(len(rows), kind, np.int32)))


def _entries(values, docs, df, bits):
    """Rows by the bucket of the text, kind 1: elements, kind 2 (value 0): the size of the set in df."""
    bucket = _doc_bucket(docs, bits)
    order = np.argsort(bucket, kind="stable")
    return ex.pack(bucket[order], {"value": values[order], "doc": docs[order], "df": df[order].astype(np.int64)})


def _postings(width: int, bits: int, hot: tuple[bytes, bytes]):
    hot_values, hot_counts = np.frombuffer(hot[0], np.uint64), np.frombuffer(hot[1], np.int64)

    def flush(hold):
        values, texts, ids, sizes = (np.concatenate(x) for x in zip(*hold))
        hold.clear()
        yield _kinded(_entries(np.zeros(len(ids), np.uint64), ids, sizes, bits), 2)
        docs = ids[texts]
        del texts
        if len(hot_values):
            at = np.minimum(np.searchsorted(hot_values, values), len(hot_values) - 1)
            is_hot = hot_values[at] == values
            yield _kinded(_entries(values[is_hot], docs[is_hot], hot_counts[at[is_hot]] + (1 << 40), bits), 1)
            values, docs = values[~is_hot], docs[~is_hot]
        order = np.argsort(values)
        values, docs = values[order], docs[order]
        del order
        yield _kinded(ex.pack((values >> np.uint64(64 - bits)).astype(np.int32), {"value": values, "doc": docs, "df": np.zeros(len(docs), np.uint8)}), 0)

    @ex.trimmed
    def run(batches):
        hold, held, texts_at = [], 0, 0
        for ids, data, off in ex.text_chunks(batches):
            values, texts, sizes = shingle_sets(data, off, width)
            hold.append((values, (texts + texts_at).astype(np.int32), ids, sizes))
            held, texts_at = held + len(values), texts_at + len(ids)
            if held >= ex.FLUSH:
                yield from flush(hold)
                hold, held, texts_at = [], 0, 0
        if hold:
            yield from flush(hold)

    return run


def _split_kinds(batches):
    for b in batches:
        kind = b.column(4).to_numpy()
        yield b.filter(pa.array(kind == 0)), b.filter(pa.array(kind != 0))


def _frequencies(bits: int):
    """At the bucket of an element: its frequency goes back to the texts that have it, unless it is 1."""

    @ex.trimmed
    def run(batches):
        mine = []
        for own, rest in _split_kinds(batches):
            if len(rest):
                yield rest
            mine.append(own)
        x, _, _ = ex.unpack(mine, value=np.uint64, doc=np.int64)
        v, d = x["value"], x["doc"]
        order = np.argsort(v, kind="stable")
        v, d = v[order], d[order]
        at = ex.group_starts(v)
        count = np.diff(np.append(at, len(v)))
        df = np.repeat(count, count)
        keep = df >= 2
        yield _kinded(_entries(v[keep], d[keep], df[keep], bits), 1)

    return run


INDEX = "doc_id long, n long, elements binary, keys array<long>, pairs double"


def _subset_keys(values: np.ndarray, sizes: range, n: int, percent: int) -> list[int]:
    keys = []
    spread = vec.mix(values ^ np.uint64(0x6C69676874))
    for c in sorted({overlap(percent, n, t) for t in sizes}):
        if c <= len(values):
            pick = np.array(list(itertools.combinations(range(len(values)), c)), np.int64).reshape(-1, c)
            keys.extend(vec.mix(spread[pick].sum(axis=1, dtype=np.uint64) + np.uint64(c)).view(np.int64).tolist())
    return keys


def _index(percent: int):
    """Step 2, at the bucket of a text: its elements, the rarest of them, and how many pairs their lists make for it."""

    @ex.trimmed
    def run(batches):
        kinds, rows = [], []
        for b in batches:
            kinds.append(b.column(4).to_numpy())
            rows.append(b)
        if not rows:
            return
        x, length, _ = ex.unpack(rows, value=np.uint64, doc=np.int64, df=np.int64)
        size_entry = np.repeat(np.concatenate(kinds), length) == 2
        ids, first = np.unique(x["doc"][size_entry], return_index=True)
        sizes = x["df"][size_entry][first]
        v, d, df = (x[k][~size_entry] for k in ("value", "doc", "df"))
        order = np.lexsort((v, df, d))
        v, d, df = v[order], d[order], df[order] & np.int64((1 << 40) - 1)
        keep = np.ones(len(v), bool)  # a repeated row of the input counts once
        keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
        v, d, df = v[keep], d[keep], df[keep]
        lo, hi = np.searchsorted(d, ids, "left"), np.searchsorted(d, ids, "right")
        out = {"doc_id": [], "n": [], "elements": [], "keys": [], "pairs": []}
        for doc, n, a, b in zip(ids.tolist(), sizes.tolist(), lo, hi):
            prefix = n - need(percent, n) + 1 - (n - (b - a))
            if prefix <= 0:
                continue
            own = v[a:b]
            out["doc_id"].append(doc)
            out["n"].append(n)
            out["elements"].append(np.sort(own).tobytes())
            out["keys"].append(own[:prefix].view(np.int64).tolist())
            out["pairs"].append(float(df[a : a + prefix].sum()) / 2)
            if len(out["n"]) >= 2000:
                yield pa.RecordBatch.from_pydict(out, _INDEX)
                out = {k: [] for k in out}
        yield pa.RecordBatch.from_pydict(out, _INDEX)

    return run


_INDEX = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("elements", pa.binary()), ("keys", pa.list_(pa.int64())), ("pairs", pa.float64())])


LISTED = "key long, doc_id long, n long"


def _keys(percent: int, light: int):
    """The lists that each set enters: of its subsets if it is light, of its rarest elements if a partner can be heavy."""

    @ex.trimmed
    def run(batches):
        for b in batches:
            keys, at = [], []
            for i, (n, elements, rare) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())):
                top = n * 100 // percent
                mine = _subset_keys(np.frombuffer(elements, np.uint64), range(need(percent, n), min(top, light) + 1), n, percent) if n <= light else []
                mine = mine + rare if top > light else mine
                keys += mine
                at += [i] * len(mine)
            at = np.array(at, np.int64)
            yield ex.batch({"key": np.array(keys, np.int64), "doc_id": b.column(0).to_numpy()[at], "n": b.column(1).to_numpy()[at]})

    return run


def _candidates(percent: int):
    """Pairs of one list whose sizes allow a link, each once a partition; of two blocks of a list, pairs across them."""

    @ex.trimmed
    def run(batches):
        parts = [tuple(b.column(i).to_numpy() for i in range(4)) for b in batches]
        if not parts:
            return
        key, doc, n, side = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((doc, n, key))
        key, doc, n, side = key[order], doc[order], n[order], side[order]
        ids, code = np.unique(doc, return_inverse=True)
        code = code.astype(np.uint64)
        found, held = [], 0
        alive = np.arange(len(key))
        step = 1
        while len(alive):
            alive = alive[alive + step < len(key)]
            other = alive + step
            # sizes ascend within a list: once too large, always too large
            alive = alive[(key[alive] == key[other]) & (need(percent, n[other]) <= n[alive])]
            other = alive + step
            a, b = code[alive], code[other]
            pair = np.minimum(a, b) * np.uint64(len(ids)) + np.maximum(a, b)
            found.append(pair[(a != b) & ((side[alive] < 0) | (side[alive] != side[other]))])
            held += len(alive)
            step += 1
            if held > 2_000_000:
                found = [np.unique(np.concatenate(found))]
                held = 0
                if len(found[0]) > 1_000_000:
                    yield ex.batch({"a": ids[(found[0] // len(ids)).astype(np.int64)], "b": ids[(found[0] % len(ids)).astype(np.int64)]})
                    found = []
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        yield ex.batch({"a": ids[(pair // max(1, len(ids))).astype(np.int64)], "b": ids[(pair % max(1, len(ids))).astype(np.int64)]})

    return run


def grouped(batches, column: str):
    """Tables of equal values of a column from batches that are sorted by it."""
    held = []
    for b in batches:
        if not len(b):
            continue
        g = b.column(b.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
        at = ex.group_starts(g)
        if held and held[-1].column(b.schema.get_field_index(column))[-1].as_py() != g[0]:
            yield pa.Table.from_batches(held)
            held = []
        for i, j in zip(at, [*at[1:], None]):
            if j is None:
                held.append(b.slice(i))
            else:
                held.append(b.slice(i, j - i))
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _verify(percent: int):
    @ex.trimmed
    def run(batches):
        left, right = [], []
        for t in grouped(batches, "g"):
            doc, n = t["doc"].to_pylist(), t["n"].to_pylist()
            sets = {d: np.frombuffer(x, np.uint64) for d, x in zip(doc, t["elements"].to_pylist())}
            size = dict(zip(doc, n))
            codes = np.unique(np.concatenate(list(sets.values())), return_inverse=True)[1] if len(sets) > 2 else None
            if codes is not None:
                ends = np.cumsum([len(x) for x in sets.values()])
                coded = dict(zip(sets, np.split(codes, ends[:-1])))
                mark = np.zeros(int(codes.max()) + 1, bool)
            for a, partners in zip(doc, t["partners"].to_pylist()):
                if not partners:
                    continue
                if codes is not None:
                    mark[coded[a]] = True
                for b in partners:
                    if codes is None:
                        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    else:
                        common = int(np.count_nonzero(mark[coded[b]]))
                    if 100 * common >= percent * (size[a] + size[b] - common):
                        left.append(a)
                        right.append(b)
                if codes is not None:
                    mark[coded[a]] = False
            if len(left) > 20_000:
                yield ex.batch({"a": np.array(left, np.int64), "b": np.array(right, np.int64)})
                left, right = [], []
        yield ex.batch({"a": np.array(left, np.int64), "b": np.array(right, np.int64)})

    return run


def light_bound(percent: int, sizes: dict[int, tuple[int, float]]) -> int:
    """The largest light size at which the join costs least; ``sizes``: size -> (sets, pairs that their lists make)."""

    def cost(x: int) -> float:
        total = 0.0
        for s, (count, pairs) in sizes.items():
            top = s * 100 // percent
            if s <= x:
                total += count * sum(comb(s, c) for c in {overlap(percent, s, t) for t in range(need(percent, s), min(top, x) + 1)} if c <= s)
            if top > x:
                total += count * (s - need(percent, s) + 1) + PAIR * pairs
        return total

    return min(range(LIGHT_MAX + 1), key=lambda x: (cost(x), x))


def _listed(keys: DataFrame) -> DataFrame:
    """(key, doc_id, n, side) of the groups to scan: lists, or each two blocks of a long list."""
    longs = ex.cut(keys.groupBy("key").agg(F.count("*").alias("entries")).where(F.col("entries") > LIST).select("key", F.ceil(F.col("entries") / (LIST // 2)).alias("blocks")))
    n_long = longs.count()
    whole = F.lit(-1).cast("int").alias("side")
    if not n_long:
        return keys.select("key", "doc_id", "n", whole)
    mine = keys.join(F.broadcast(longs) if n_long <= ex.BROADCAST_ROWS else longs, "key", "left")
    short = mine.where("blocks is null").select("key", "doc_id", "n", whole)
    cut = mine.where("blocks is not null").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    group = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"), F.lit("block"))
    side = F.when(F.col("block") == F.col("other"), -1).otherwise((F.col("block") > F.col("other")).cast("int"))
    return short.unionByName(cut.select(group.alias("key"), "doc_id", "n", side.alias("side")))


def class_links(spark, docs: DataFrame, percent: int = 70, width: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, classes, links): one row per text, per class of equal sets, per pair of linked classes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    size = ex.input_bytes(docs)
    ex.prepare(spark, size)
    bits = ex.bucket_bits(size)
    hot_df = max(1000, 2 * size // 1_000_000)
    seen = ex.by_bucket(docs.mapInArrow(_scan(width, bits), SCAN), bits).mapInArrow(_credit(hot_df), CREDIT)
    seen = ex.cut(seen.groupBy("kind", "doc_id").agg(F.max(F.struct("n", "k1", "k2")).alias("s"), F.sum("shared").alias("shared")).select("kind", "doc_id", "s.*", "shared"))
    sets = seen.where("kind = 0").select("doc_id", "n", "k1", "k2", "shared")
    hot_rows = seen.where("kind = 1").select("doc_id", "n")
    hot = hot_rows.orderBy(F.desc("n"), "doc_id").limit(ex.BROADCAST_ROWS).toPandas() if not hot_rows.isEmpty() else None
    packed = (b"", b"")
    if hot is not None:
        v = hot["doc_id"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(v)
        packed = (v[order].tobytes(), hot["n"].to_numpy(np.int64)[order].tobytes())
    classes = ex.cut(sets.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("shared").alias("shared")))
    left = classes.where(F.col("shared") * 100 >= F.col("n") * percent)
    stats = left.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    post = ex.semi(docs, left.select(F.col("rep").alias("doc_id")), "doc_id", stats["rows"]).mapInArrow(_postings(width, bits, packed), POSTINGS)
    index = ex.by_bucket(ex.by_bucket(post, bits).mapInArrow(_frequencies(bits), POSTINGS), bits).mapInArrow(_index(percent), INDEX)
    index = ex.cut(index)
    lists = max(1, int((stats["n"] or 0) // 2_500_000) + 1)
    sizes = index.where(F.col("n") <= LIGHT_MAX).groupBy("n").agg(F.count("*").alias("sets"), F.sum("pairs").alias("pairs")).collect()
    light = light_bound(percent, {r.n: (r.sets, r.pairs) for r in sizes})
    keys = index.mapInArrow(_keys(percent, light), LISTED)
    pairs = _listed(keys).repartition(lists, "key").mapInArrow(_candidates(percent), "a long, b long").distinct()
    pairs = ex.cut(pairs)
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("doc"), "a"), F.struct(F.col("b").alias("doc"), "a"))).alias("x")).select("x.*")
    label = ends.groupBy("doc").agg(F.min("a").alias("c")).join(index.select(F.col("doc_id").alias("doc"), "n"), "doc")
    blocks = label.groupBy("c").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_ELEMENTS)).alias("blocks"))
    label = label.join(blocks, "c").select("doc", F.xxhash64("c", F.pmod(F.xxhash64("doc"), "blocks")).alias("block"))
    at = pairs.join(label.select(F.col("doc").alias("a"), F.col("block").alias("x")), "a").join(label.select(F.col("doc").alias("b"), F.col("block").alias("y")), "b")
    at = at.select("a", "b", F.xxhash64(F.least("x", "y"), F.greatest("x", "y")).alias("g"))
    at = at.groupBy("g", "a").agg(F.collect_list("b").alias("partners"))
    members = at.select("g", F.col("a").alias("doc"), "partners").unionByName(at.select("g", F.explode("partners").alias("doc"), F.array().cast("array<long>").alias("partners")))
    members = members.groupBy("g", "doc").agg(F.flatten(F.collect_list("partners")).alias("partners"))
    members = members.join(index.select(F.col("doc_id").alias("doc"), "n", "elements"), "doc").select("g", "doc", "n", "elements", "partners")
    links = ex.cut(members.repartition("g").sortWithinPartitions("g").mapInArrow(_verify(percent), "a long, b long"))
    return sets, classes, links


def ngram_jaccard(spark, docs: DataFrame, percent: int = 70, width: int = 3) -> DataFrame:
    """Near-duplicate groups: doc_id, n_shingles, n_similar, component_id, copies.

    Two texts link when ``100 * |A & B| >= percent * |A | B|`` for their sets of
    distinct ``width``-word shingles (A-Z lower-cased; a text with fewer words is
    one element).  ``n_similar`` counts the other texts linked directly, equal
    sets included; ``component_id`` is the least doc_id reachable by links;
    ``copies`` is the number of texts with an equal set.

    Null or empty texts, and texts of white space, have the empty set, link with
    nothing and are their own component.  Rows with a null doc_id are left out;
    rows that repeat a doc_id count once (with other texts, name the rows by
    :func:`exchange.by_row` first).  Other columns are ignored.
    An empty table gives no rows.
    """
    sets, classes, links = class_links(spark, docs, percent, width)
    both = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    degree = both.join(classes.select(F.col("rep").alias("other"), F.col("copies").alias("m")), "other").groupBy("rep").agg(F.sum("m").alias("linked"))
    comp = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("rep"), "component")
    per_class = classes.join(degree, "rep", "left").join(comp, "rep", "left").select("n", "k1", "k2", "copies", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_similar"), F.coalesce("component", "rep").alias("component_id"))
    return sets.select("doc_id", "n", "k1", "k2").join(per_class, ["n", "k1", "k2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies")
    )
