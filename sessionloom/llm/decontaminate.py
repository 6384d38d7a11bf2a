"""Benchmark decontamination by spaced-seed hashing.

A mask such as ``1101101`` hashes the token positions under its ones and ignores
the others, so a hit survives a substitution under a zero.  The hashes of all
test items are joined with those of each training text: where the text is read, if
the items are few enough to be broadcast, else in buckets of the hash, to which only
those hashes of texts travel that pass a filter of the items'.  Around each hit the
tokens of item and text are compared along their diagonal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import vec

#: Token positions that count, by mask.
MASKS = ("1110110111", "1101101", "1111011")
#: Tokens that must agree, or the whole item where it is shorter.
MIN_TOKENS = 12
#: Substitutions allowed in a hundred tokens of an overlap.
MAX_MISMATCH = 25
#: Tokens of test items that are broadcast; the seeds of a larger benchmark are joined by a shuffle.
BLOCK_TOKENS = 1_000_000


def _seed(h: np.ndarray, mask: str) -> np.ndarray:
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = np.full(n, np.uint64(len(mask)), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            key = key + h[i : i + n] * np.uint64(pow(vec._P, i + 1, 1 << 64))
    return vec.mix(key)


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    data = vec.lower(np.frombuffer(b"".join(raw), np.uint8))
    s, e, wr = vec.word_bounds(data, off)
    return vec.word_hashes(data, s, e), wr


def stretches(same: np.ndarray, least: int, mismatch: int) -> list[tuple[int, int]]:
    """The union of all stretches, from an agreeing token to another, with ``least`` agreeing tokens or more and few enough substitutions."""
    if same.sum() < least:
        return []
    # a stretch is good if its sum is not negative
    sums = np.concatenate([[0], np.cumsum(np.where(same, mismatch, mismatch - 100))])
    agree = np.concatenate([[0], np.cumsum(same)])
    ends = np.flatnonzero(same) + 1
    begins = ends - 1
    # the last good end of each begin, whose stretch has the most agreeing tokens
    highest = np.maximum.accumulate(sums[ends][::-1])[::-1]
    end = ends[np.searchsorted(-highest, -sums[begins], "right") - 1]
    ok = (end > begins) & (agree[end] - agree[begins] >= least)
    first, last = vec.merge_spans(begins[ok], end[ok])
    return list(zip(first.tolist(), last.tolist()))


class Index:
    """The seeds of the test items; what a task receives."""

    def __init__(self, ids: list[int], texts: list[str | None], masks: tuple[str, ...], min_tokens: int, mismatch: int) -> None:
        self.ids = np.array(ids, np.int64)
        self.h, self.ranges = _tokens(texts)
        self.min_tokens, self.mismatch = min_tokens, mismatch
        size = np.diff(self.ranges)
        longest = max(map(len, masks))
        # an item too short for the longest mask is looked for as a whole
        self.masks = list(masks) + ["1" * k for k in sorted(set(size[(size > 0) & (size < longest)].tolist()))]
        owner = vec.owners(self.ranges)
        self.seeds = []
        for i, m in enumerate(self.masks):
            key = _seed(self.h, m)
            at = np.arange(len(key))
            inside = owner[at] == owner[at + len(m) - 1] if len(key) else np.zeros(0, bool)
            if i >= len(masks):
                inside &= size[owner[at]] == len(m)
            else:
                inside &= size[owner[at]] >= longest
            key, at = key[inside], at[inside]
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            seen = np.zeros(1 << 20, bool)
            seen[(key >> np.uint64(44)).astype(np.int64)] = True
            self.seeds.append((key, at, seen))
        self.owner = owner

    def search(self, h: np.ndarray, ranges: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, first token, end token) of the overlaps in texts given as token hashes."""
        text_of = vec.owners(ranges)
        pairs = []
        for mask, (key, at, seen) in zip(self.masks, self.seeds):
            mine = _seed(h, mask)
            p = np.flatnonzero(seen[(mine >> np.uint64(44)).astype(np.int64)])
            if not len(p) or not len(key):
                continue
            p = p[text_of[p] == text_of[p + len(mask) - 1]]
            lo, hi = np.searchsorted(key, mine[p], "left"), np.searchsorted(key, mine[p], "right")
            n = hi - lo
            p = np.repeat(p, n)
            q = at[np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            pairs.append(np.column_stack([text_of[p], self.owner[q], p - q]))
        if not pairs:
            return []
        out = []
        for text, item, shift in np.unique(np.concatenate(pairs), axis=0).tolist():
            a, b = int(self.ranges[item]), int(self.ranges[item + 1])
            lo, hi = max(a, int(ranges[text]) - shift), min(b, int(ranges[text + 1]) - shift)
            same = self.h[lo:hi] == h[lo + shift : hi + shift]
            first = lo + shift - int(ranges[text])
            out += [(text, item, first + x, first + y) for x, y in stretches(same, min(self.min_tokens, b - a), self.mismatch)]
        return out


RESULT = "doc_id long, contaminated boolean, n_tokens long, matched_tokens long, items array<long>, spans array<struct<first:long,end:long>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _found(hits: list[list[tuple[int, int, int]]]) -> dict[str, pa.Array]:
    """The result columns of texts from their (item_id, first, end) overlaps."""
    spans = [vec.merge_spans(np.array([x[1] for x in v], np.int64), np.array([x[2] for x in v], np.int64)) for v in hits]
    return {
        "matched_tokens": pa.array([int((z - a).sum()) for a, z in spans], pa.int64()),
        "items": pa.array([sorted({x[0] for x in v}) for v in hits], pa.list_(pa.int64())),
        "spans": pa.array([[{"first": int(x), "end": int(y)} for x, y in zip(a, z)] for a, z in spans], _SPANS),
    }


def _search(index: Index):
    @ex.trimmed
    def run(batches):
        for ids, data, off in ex.text_chunks(batches):
            data = vec.lower(data)
            s, e, wr = vec.word_bounds(data, off)
            h = vec.word_hashes(data, s, e)
            found: dict[int, list] = {}
            for text, item, a, b in index.search(h, wr):
                found.setdefault(text, []).append((int(index.ids[item]), a, b))
            hits = [found.get(i, []) for i in range(len(ids))]
            yield ex.batch({"doc_id": ids, "contaminated": pa.array([bool(v) for v in hits]), "n_tokens": np.diff(wr), **_found(hits)})

    return run


# --- a benchmark of any size: seeds of items and texts meet in buckets -------------------------

ITEMS = "item long, item_id long, n long, tokens binary"
SEEDS = ex.pack_schema("key", "who", "tag", "at", "size") + ", kind int"
#: Bits of the filter of item seeds that tasks receive, at most 2 ** FILTER_BITS.
FILTER_BITS = 28
#: Parts of a bucket's text seeds, each with all of its item seeds, and of an item's hits.
SPLIT = 8


@ex.trimmed
def _item_tokens(batches):
    for b in batches:
        texts = b.column(2).to_pylist()
        h, wr = _tokens(texts)
        yield ex.batch({"item": b.column(0), "item_id": b.column(1), "n": np.diff(wr), "tokens": pa.array([h[a:z].tobytes() for a, z in zip(wr[:-1], wr[1:])], pa.binary())})


def _pack_seeds(kind: int, bits: int, split: int, key, who, tag, at, size):
    """Seeds by bucket: those of items go to every part of theirs, those of texts to the part of their text."""
    top = (key >> np.uint64(64 - bits)).astype(np.int64) * split
    part = (vec.mix(who.view(np.uint64) ^ tag.view(np.uint64)) % np.uint64(split)).astype(np.int64)
    for k in range(split) if kind == 0 else [None]:
        bucket = top + (part if k is None else k)
        order = np.argsort(bucket, kind="stable")
        rows = ex.pack(bucket[order], {"key": key[order], "who": who[order], "tag": tag[order], "at": at[order].astype(np.int32), "size": size[order].astype(np.int32)})
        yield rows.append_column("kind", pa.array(np.full(len(rows), kind, np.int32)))


def _item_seeds(masks: tuple[str, ...], bits: int, split: int):
    longest = max(map(len, masks))

    @ex.trimmed
    def run(batches):
        for b in batches:
            h = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint64)
            item, size = b.column(0).to_numpy(), b.column(2).to_numpy()
            wr = np.concatenate([[0], np.cumsum(size)])
            owner = vec.owners(wr)
            for m in [*masks, *("1" * int(k) for k in np.unique(size[(size > 0) & (size < longest)]))]:
                key = _seed(h, m)
                at = np.arange(len(key))
                own = owner[: len(key)]
                ok = (owner[at + len(m) - 1] == own) & (size[own] >= longest if m in masks else size[own] == len(m)) if len(key) else np.zeros(0, bool)
                key, at, own = key[ok], at[ok], own[ok]
                yield from _pack_seeds(0, bits, split, key, item[own], np.zeros(len(own), np.int64), at - wr[own], size[own])

    return run


def _filter_part(bits: int, filter_bits: int):
    """At a bucket: which of its stretch of the filter's places a seed has."""

    @ex.trimmed
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            x, length, bucket = ex.unpack([b], key=np.uint64)
            for k in np.unique(bucket).tolist():
                at = (x["key"][np.repeat(bucket, length) == k] >> np.uint64(64 - filter_bits)).astype(np.int64)
                held.setdefault(k, np.zeros(1 << (filter_bits - bits), bool))[at & ((1 << (filter_bits - bits)) - 1)] = True
        for k, seen in held.items():
            yield ex.batch({"bucket": pa.array([k], pa.int32()), "seen": pa.array([np.packbits(seen).tobytes()], pa.binary())})

    return run


def _text_seeds(masks: tuple[str, ...], bits: int, split: int, seen, filter_bits: int):
    @ex.trimmed
    def run(batches):
        held, size = [], 0
        places = np.frombuffer(seen.value, np.uint8)
        for b in batches:
            ids, tags = b.column(0).to_numpy(), b.column(2).to_numpy()
            for r0, r1, data, off in vec.chunks(b.column(1)):
                data = vec.lower(data)
                s, e, wr = vec.word_bounds(data, off)
                h, owner, n = vec.word_hashes(data, s, e), vec.owners(wr), np.diff(wr)
                for m in masks:
                    key = _seed(h, m)
                    place = (key >> np.uint64(64 - filter_bits)).astype(np.int64)
                    at = np.flatnonzero((places[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1)
                    at = at[owner[at] == owner[at + len(m) - 1]]
                    own = owner[at]
                    held.append((key[at], ids[r0:r1][own], tags[r0:r1][own], at - wr[own], n[own]))
                    size += len(at)
                if size >= ex.FLUSH:
                    yield from _pack_seeds(1, bits, split, *(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
        if held:
            yield from _pack_seeds(1, bits, split, *(np.concatenate(x) for x in zip(*held)))

    return run


HITS = "doc_id long, tag long, size long, item long, shift long"


@ex.trimmed
def _meet(batches):
    """At a part of a bucket, items' rows first: the diagonals of equal seeds, once for each batch of text seeds."""
    items, sorted_ = [], None
    for b in batches:
        kind = b.column(b.schema.get_field_index("kind")).to_numpy()
        x, _, _ = ex.unpack([b.filter(pa.array(kind == 0))], key=np.uint64, who=np.int64, at=np.int32)
        if len(x["key"]):
            items.append(x)
        x, _, _ = ex.unpack([b.filter(pa.array(kind == 1))], key=np.uint64, who=np.int64, tag=np.int64, at=np.int32, size=np.int32)
        if not len(x["key"]) or not items:
            continue
        if sorted_ is None or len(items) > 1:
            whole = {k: np.concatenate([i[k] for i in items]) for k in items[0]}
            order = np.argsort(whole["key"], kind="stable")
            items = [{k: v[order] for k, v in whole.items()}]
            sorted_ = items[0]
        lo, hi = np.searchsorted(sorted_["key"], x["key"], "left"), np.searchsorted(sorted_["key"], x["key"], "right")
        p = np.flatnonzero(hi > lo)
        ends = np.cumsum(hi[p] - lo[p])
        i = 0
        while i < len(p):  # a seed of many items is worked off in pieces
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 500_000, "right")))
            n = (hi - lo)[p[i:j]]
            q = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[p[i:j]], n)
            own = np.repeat(p[i:j], n)
            rows = np.unique(np.column_stack([x["who"][own], x["tag"][own], x["size"][own], sorted_["who"][q], x["at"][own].astype(np.int64) - sorted_["at"][q]]), axis=0)
            yield ex.batch(dict(zip(("doc_id", "tag", "size", "item", "shift"), np.ascontiguousarray(rows.T))))
            i = j


VERIFIED = "doc_id long, tag long, matched_tokens long, items array<long>, spans array<struct<first:long,end:long>>"


def _verify(min_tokens: int, mismatch: int):
    """Rows sorted by text, the text's own first: its tokens are compared with each diagonal's stretch of item tokens."""

    def done(key, hits):
        return ex.batch({"doc_id": pa.array([key[0]], pa.int64()), "tag": pa.array([key[1]], pa.int64()), **_found([hits])})

    @ex.trimmed
    def run(batches):
        key, h, hits = None, None, []
        for b in batches:
            for doc, tag, text, item_id, shift, lo, n, tokens in zip(*(c.to_pylist() for c in b.columns)):
                if (doc, tag) != key:
                    if hits:
                        yield done(key, hits)
                    key, h, hits = (doc, tag), _tokens([text])[0], []
                if tokens is not None:
                    other = np.frombuffer(tokens, np.uint64)
                    same = other == h[lo + shift : lo + shift + len(other)]
                    hits += [(item_id, lo + shift + x, lo + shift + y) for x, y in stretches(same, min(min_tokens, n), mismatch)]
        if hits:
            yield done(key, hits)

    return run


def _joined(spark, docs: DataFrame, items: DataFrame, masks, min_tokens: int, mismatch: int, words: int) -> DataFrame:
    """(doc_id, tag, matched_tokens, items, spans) of the contaminated texts, by a shuffled join of the seeds."""
    items = ex.cut(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").mapInArrow(_item_tokens, ITEMS).where("n > 0"))
    longest = max(map(len, masks))
    short = tuple("1" * r.n for r in items.where(F.col("n") < longest).select("n").distinct().orderBy("n").collect())
    bits = ex.bucket_bits(words * 32 * len(masks))
    size = ex.input_bytes(docs)
    split = int(min(64, max(SPLIT, size >> (30 + bits))))
    seeds = ex.cut(items.mapInArrow(_item_seeds(masks, bits, 1), SEEDS))
    filter_bits = min(FILTER_BITS, max(20, bits + 3, (16 * len(masks) * words).bit_length()))
    seen = bytearray(1 << (filter_bits - 3))
    for r in ex.by_bucket(seeds, bits).mapInArrow(_filter_part(bits, filter_bits), "bucket int, seen binary").toLocalIterator():
        seen[r.bucket << (filter_bits - bits - 3) : (r.bucket + 1) << (filter_bits - bits - 3)] = r.seen
    mine = docs.mapInArrow(_text_seeds((*masks, *short), bits, split, spark.sparkContext.broadcast(bytes(seen)), filter_bits), SEEDS)
    every = items.mapInArrow(_item_seeds(masks, bits, split), SEEDS).unionByName(mine)
    hits = every.repartitionById(split << bits, F.col("bucket")).sortWithinPartitions("kind").mapInArrow(_meet, HITS).distinct()
    hits = ex.cut(hits.withColumn("part", F.pmod(F.xxhash64("doc_id", "tag"), F.lit(SPLIT))))
    parts = items.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1)).cast("array<long>")))
    lo = F.greatest(F.lit(0), -F.col("shift"))
    hi = F.least(F.col("n"), F.col("size") - F.col("shift"))
    found = hits.join(parts, ["item", "part"]).select("doc_id", "tag", F.lit(None).cast("string").alias("text"), "item_id", "shift", lo.alias("lo"), "n", F.substring("tokens", (8 * lo + 1).cast("int"), (8 * (hi - lo)).cast("int")).alias("tokens"))
    own = docs.join(hits.select("doc_id", "tag").distinct(), ["doc_id", "tag"], "left_semi").dropDuplicates(["doc_id", "tag"])
    own = own.select("doc_id", "tag", "text", *(F.lit(None).cast("long").alias(c) for c in ("item_id", "shift", "lo", "n")), F.lit(None).cast("binary").alias("tokens"))
    return own.unionByName(found).repartition("doc_id", "tag").sortWithinPartitions("doc_id", "tag", F.col("tokens").isNotNull()).mapInArrow(_verify(min_tokens, mismatch), VERIFIED)


def decontaminate(spark, docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_tokens: int = MIN_TOKENS, mismatch: int = MAX_MISMATCH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, contaminated, n_tokens, matched_tokens, items, spans: training texts that hold test items.

    Tokens are words with A-Z lower-cased.  A text is contaminated by an item if,
    on the diagonal of a seed hit, ``min_tokens`` tokens (or all of a shorter item)
    agree in any stretch with at most ``mismatch`` substitutions in a hundred.
    ``items`` are the item_ids, ``spans`` the union of all such stretches in tokens.

    The seeds of a benchmark of up to ``block_tokens`` tokens are broadcast; those of
    a larger one are joined with the texts' by a shuffle.  The result is the same.

    Null and empty texts are clean; items without words match nothing; rows with
    a null doc_id are left out, items with a null item_id have id -1; repeated
    rows, and rows that repeat a doc_id with another text, give a row each.  Other
    columns are ignored.
    """
    ex.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    words = items.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    if words <= block_tokens:
        mine = items.orderBy("item_id", "text").collect()
        return docs.mapInArrow(_search(Index([r.item_id for r in mine], [r.text for r in mine], masks, min_tokens, mismatch)), RESULT)
    docs = docs.withColumn("tag", F.xxhash64("text"))
    found = ex.cut(_joined(spark, docs, items, masks, min_tokens, mismatch, words))
    rows = found.count()
    trimmed = F.trim(F.coalesce("text", F.lit("")), F.lit("\x20\x09\x0a\x0b\x0c\x0d"))
    n = F.when(F.length(trimmed) == 0, 0).otherwise(F.regexp_count(trimmed, F.lit(r"[\x20\x09-\x0D]+")) + 1).cast("long")
    out = docs.select("doc_id", "tag", n.alias("n_tokens")).join(F.broadcast(found) if rows <= ex.BROADCAST_ROWS // 10 else found, ["doc_id", "tag"], "left")
    return out.select("doc_id", F.col("matched_tokens").isNotNull().alias("contaminated"), "n_tokens", F.coalesce("matched_tokens", F.lit(0)).cast("long").alias("matched_tokens"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<first:long,end:long>>")).alias("spans"))
