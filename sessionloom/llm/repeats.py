"""Long repeats across documents: the part that both substring operators share.

A *window* is ``length`` consecutive elements (words or bytes) of one document.
Its *anchor* is the smallest hash among the ``gram``-element grams inside it, so
equal windows have equal anchors, and a run of windows shares one.

1. One pass sends each document's distinct anchors (a few per cent of its
   elements) to buckets, which tell the documents those that another place has.
   An anchor found twice within a flush is known to be shared where it is and
   sends one entry.
   An anchor with a thousand places, such as a phrase in many contexts, is hot:
   windows that have another gram go by that instead, which splits the group.
2. Documents whose text equals an earlier one are settled by that alone.  Of the
   others, runs of windows with shared anchors travel, as *fragments* with their
   elements, to the bucket of the anchor: all equal windows meet there, and only
   there.  Equal fragments of a flush travel once.
3. There, a matcher (suffix automata or suffix arrays) marks each window that has
   an earlier equal; the marks return to the documents as bit masks.

No step pairs documents, and what a task holds follows its bucket of distinct
fragments, not the copies of one text.  Fragments travel with their bytes, and
windows are compared by these; hashes alone decide that two whole texts (MD5) or
two fragments of one anchor (anchor and content, 128 bits) are equal.

A row is a document: rows that repeat a doc_id with another text are told apart by
a *tag*, a hash of the text that is 0 for all others, and neither is earlier.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import vec

#: Windows of a fragment at most: their marks fit 64 bits.
RUN = 64
#: Places from which an anchor is hot, or more for a large input: places / HOT bounds the hot anchors that tasks receive.
HOT = 1000


@dataclass(frozen=True)
class Kind:
    """What an element is: ``words`` (else bytes), the window's length, the anchor gram's length."""

    words: bool
    length: int
    gram: int


def elements(kind: Kind, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each element, range of elements of each text)."""
    if kind.words:
        s, e, wr = vec.word_bounds(data, off)
        return vec.word_hashes(data, s, e), wr
    return vec._BYTE[data], off


def windows(kind: Kind, values: np.ndarray, ranges: np.ndarray, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, text, anchor, twice) of every window; twice: the window has its anchor at two places.

    Grams in ``hot`` (sorted) anchor a window only if it has no other.
    """
    grams = vec.run_hashes(values, kind.gram)
    width = kind.length - kind.gram + 1
    count = np.maximum(0, np.diff(ranges) - kind.length + 1)
    text = np.repeat(np.arange(len(count)), count)
    start = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + ranges[:-1][text]
    # high half of the hash, then the place: the least is the leftmost least gram
    high, place = grams & np.uint64(0xFFFFFFFF00000000), np.arange(len(grams), dtype=np.uint64)
    name = vec.mix(grams)  # the least of many is no even hash: anchors go by another
    if hot is not None and len(hot):
        high[hot[np.minimum(np.searchsorted(hot, name), len(hot) - 1)] == name] = np.uint64(0xFFFFFFFF00000000)
    low = (vec.sliding_min(high | place, width) & np.uint64(0xFFFFFFFF))[start]
    if kind.words:
        return start, text, name[low], np.zeros(len(low), bool)
    last = (vec.sliding_min(high | (np.uint64(0xFFFFFFFF) - place), width) & np.uint64(0xFFFFFFFF))[start]
    return start, text, name[low], np.uint64(0xFFFFFFFF) - last != low


SEEN = ex.pack_schema("value", "doc", "info") + ", kind int"


def _kinded(rows: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    return rows.append_column("kind", pa.array(np.full(len(rows), kind, np.int32)))


def _doc_bucket(docs: np.ndarray, bits: int) -> np.ndarray:
    return (vec.mix(docs.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)


def _to_docs(values, docs, info, bits, kind):
    bucket = _doc_bucket(docs, bits)
    order = np.argsort(bucket, kind="stable")
    return _kinded(ex.pack(bucket[order], {"value": values[order], "doc": docs[order], "info": info[order]}), kind)


def _anchors(kind: Kind, bits: int):
    """Kind 0: an anchor, its document and places; 1: a shared anchor of a document; 3: a hot anchor."""

    def flush(hold):
        values, docs = (np.concatenate(x) for x in zip(*hold))
        hold.clear()
        order = np.argsort(values)
        v, d = values[order], docs[order]
        del values, docs, order
        at = ex.group_starts(v)
        count = np.diff(np.append(at, len(v)))
        many = np.repeat(count > 1, count)
        yield _to_docs(v[many], d[many], np.zeros(int(many.sum()), np.uint8), bits, 1)
        yield _kinded(ex.pack((v[at] >> np.uint64(64 - bits)).astype(np.int32), {"value": v[at], "doc": d[at], "info": count.astype(np.int32)}), 0)

    @ex.trimmed
    def run(batches):
        hold, held = [], 0
        for ids, data, off in ex.text_chunks(batches):
            values, ranges = elements(kind, data, off)
            _, text, low, twice = windows(kind, values, ranges)
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(new)
            if not kind.words and len(at):  # equal windows within one run: its anchor counts as found twice
                again = np.logical_or.reduceat(twice, at) | (np.diff(np.append(at, len(low))) > kind.length - kind.gram + 1)
                at = np.concatenate([at, at[again]])
            low, text = low[at], text[at]
            if kind.words:  # a document is no match for itself: each anchor once
                order = np.lexsort((low, text))
                low, text = low[order], text[order]
                keep = np.ones(len(low), bool)
                keep[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
                low, text = low[keep], text[keep]
            hold.append((low, ids[text]))
            held += len(low)
            if held >= ex.FLUSH:
                yield from flush(hold)
                hold, held = [], 0
        if hold:
            yield from flush(hold)

    return run


def _shared(bits: int, hot: int):
    @ex.trimmed
    def run(batches):
        mine = []
        for b in batches:
            k = b.column(4).to_numpy()
            if (k != 0).any():
                yield b.filter(pa.array(k != 0))
            mine.append(b.filter(pa.array(k == 0)))
        x, _, _ = ex.unpack(mine, value=np.uint64, doc=np.int64, info=np.int32)
        order = np.argsort(x["value"])
        v, d, places = x["value"][order], x["doc"][order], x["info"][order].astype(np.int64)
        at = ex.group_starts(v)
        count = np.diff(np.append(at, len(v)))
        keep = np.repeat(count > 1, count) & (places == 1)
        yield _to_docs(v[keep], d[keep], np.zeros(int(keep.sum()), np.uint8), bits, 1)
        if len(v):
            many = v[at[np.add.reduceat(places, at) >= hot]]
            yield _to_docs(many, np.zeros(len(many), np.int64), np.zeros(len(many), np.uint8), bits, 3)

    return run


DOCS = "doc_id long, anchors binary"


@ex.trimmed
def _per_doc(batches):
    """The shared anchors of each document that has any; the hot ones under a null document."""
    values, docs = [], []
    for b in batches:
        k = b.column(4).to_numpy()
        x, _, _ = ex.unpack([b.filter(pa.array(k == 3))], value=np.uint64)
        if len(x["value"]):
            yield ex.batch({"doc_id": pa.array([None], pa.int64()), "anchors": pa.array([x["value"].tobytes()], pa.binary())})
        x, _, _ = ex.unpack([b.filter(pa.array(k == 1))], value=np.uint64, doc=np.int64)
        values.append(x["value"])
        docs.append(x["doc"])
    if not values:
        return
    v, d = np.concatenate(values), np.concatenate(docs)
    order = np.lexsort((v, d))
    v, d = v[order], d[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    v, d = v[keep], d[keep]
    at = np.append(ex.group_starts(d), len(d))
    raw = v.tobytes()
    for i in range(0, len(at) - 1, 2000):
        lo, hi = at[i : min(i + 2000, len(at) - 1)], at[i + 1 : i + 2001]
        yield ex.batch({"doc_id": d[lo], "anchors": pa.array([raw[8 * a : 8 * b] for a, b in zip(lo, hi)], pa.binary())})


FRAGMENTS = ex.pack_schema("anchor", "content", "doc", "tag", "start", "count", "size", "body")


def _fragments(kind: Kind, bits: int, hot_bytes: bytes):
    """Runs of windows with a shared anchor: (anchor, content hash, document, start, windows), and each content once."""
    hot = np.frombuffer(hot_bytes, np.uint64)

    def flush(hold):
        anchor, content, doc, tag, start, count, place, size = (np.concatenate([h[i] for h in hold]) for i in range(8))
        # distinct contents first in their bucket's order, with their bytes
        order = np.lexsort((start, tag, doc, content, anchor))
        anchor, content, doc, tag, start, count, place, size = (x[order] for x in (anchor, content, doc, tag, start, count, place, size))
        first = np.ones(len(anchor), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
        bases = np.concatenate([np.full(len(h[0]), i) for i, h in enumerate(hold)])[order]
        bucket = (anchor >> np.uint64(64 - bits)).astype(np.int32)
        starts = ex.group_starts(bucket)
        bodies = []
        at = np.flatnonzero(first)
        cut = np.searchsorted(at, np.append(starts, len(bucket)))
        for i in range(len(starts)):
            mine = at[cut[i] : cut[i + 1]]
            whole = b"".join(hold[bases[j]][8][place[j] : place[j] + size[j]].tobytes() for j in mine.tolist())
            bodies.append(len(whole).to_bytes(8, "little") + pa.compress(whole, "zstd", asbytes=True))
        rows = ex.pack(bucket, {"anchor": anchor, "content": content, "doc": doc, "tag": tag, "start": start.astype(np.int32), "count": count.astype(np.int8), "size": np.where(first, size, 0).astype(np.int32)})
        yield rows.append_column("body", pa.array(bodies, pa.binary()))

    @ex.trimmed
    def run(batches):
        hold, held = [], 0
        for b in batches:
            mine = b.column(b.schema.get_field_index("anchors")).to_pylist()
            ids_all, tags_all = b.column(0).to_numpy(), b.column(b.schema.get_field_index("tag")).to_numpy()
            for r0, r1, data, off in vec.chunks(b.column(1)):
                ids, tags = ids_all[r0:r1], tags_all[r0:r1]
                if kind.words:
                    s, e, ranges = vec.word_bounds(data, off)
                    values = vec.word_hashes(data, s, e)
                else:
                    values, ranges = elements(kind, data, off)
                start, text, low, _ = windows(kind, values, ranges)
                keep = np.zeros(len(start), bool)
                bounds = np.searchsorted(text, np.arange(len(ids) + 1))
                for i in range(len(ids)):
                    a, z = bounds[i], bounds[i + 1]
                    if a < z and mine[r0 + i]:
                        have = np.frombuffer(mine[r0 + i], np.uint64)
                        at = np.minimum(np.searchsorted(have, low[a:z]), len(have) - 1)
                        keep[a:z] = have[at] == low[a:z]
                if len(hot) and np.isin(low[keep], hot).any():  # such windows go by their other grams
                    low = windows(kind, values, ranges, hot)[2]
                start, text, low = start[keep], text[keep], low[keep]
                if not len(start):
                    continue
                new = np.ones(len(start), bool)
                new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
                run_at = np.maximum.accumulate(np.where(new, np.arange(len(start)), 0))
                new |= (np.arange(len(start)) - run_at) % RUN == 0
                at = np.flatnonzero(new)
                count = np.diff(np.append(at, len(start)))
                sums = np.empty(len(values) + 1, np.uint64)
                sums[0] = 0
                np.cumsum(values * vec.power(vec._P, len(values)), out=sums[1:])
                first, end = start[at], start[at] + count + kind.length - 1
                content = vec.span_hash(sums, first, end) + count.astype(np.uint64)
                tag = tags[text[at]]
                if not kind.words:  # what a row of a repeated doc_id holds twice is found in its own fragments
                    content = content ^ np.where(tag != 0, vec.mix(tag.view(np.uint64)), np.uint64(0))
                place, size = (s[first], e[end - 1] - s[first]) if kind.words else (first, end - first)
                hold.append((low[at], content, ids[text[at]], tag, first - ranges[text[at]], count, place, size, data))
                held += int((count + kind.length).sum())
                if held >= ex.FLUSH * 8 or len(hold) >= 64:
                    yield from flush(hold)
                    hold, held = [], 0
        if hold:
            yield from flush(hold)

    return run


def windows_twice(kind: Kind, body: np.ndarray, at: np.ndarray, size: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a fragment holds a window whose hash another place has; the others match nothing."""
    hashes, whose = [], []
    for i in range(0, len(at), 2000):
        count, bytes_ = n[i : i + 2000], size[i : i + 2000]
        off = np.concatenate([[0], np.cumsum(bytes_)])
        place = np.arange(int(off[-1])) - np.repeat(off[:-1], bytes_) + np.repeat(at[i : i + 2000], bytes_)
        values, ranges = elements(kind, body[place], off)
        start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ranges[:-1], count)
        hashes.append(vec.run_hashes(values, kind.length)[start])
        whose.append(np.repeat(np.arange(i, i + len(count)), count))
    out = np.zeros(len(at), bool)
    if hashes:
        h, w = np.concatenate(hashes), np.concatenate(whose)
        order = np.argsort(h)
        h, w = h[order], w[order]
        twice = np.zeros(len(h), bool)
        twice[1:] = h[1:] == h[:-1]
        twice[:-1] |= twice[1:]
        out[w[twice]] = True
    return out


MARKS = ex.pack_schema("doc", "tag", "start", "mask")


def _match(kind: Kind, bits: int, matcher: Callable):
    """At the bucket of an anchor: which windows have an earlier equal."""

    @ex.trimmed
    def run(batches):
        parts = {k: [] for k in ("anchor", "content", "doc", "tag", "start", "count", "size")}
        bodies, body_at, base = [], [], 0
        for b in batches:
            x, _, _ = ex.unpack([b], anchor=np.uint64, content=np.uint64, doc=np.int64, tag=np.int64, start=np.int32, count=np.int8, size=np.int32)
            for k in parts:
                parts[k].append(x[k])
            size = x["size"].astype(np.int64)
            body_at.append(base + np.cumsum(size) - size)
            base += int(size.sum())
            bodies.extend(pa.decompress(v[8:], int.from_bytes(v[:8], "little"), "zstd", asbytes=True) for v in b.column(b.schema.get_field_index("body")).to_pylist())
        if not parts["anchor"]:
            return
        x = {k: np.concatenate(v) for k, v in parts.items()}
        at = np.concatenate(body_at)
        body = np.frombuffer(b"".join(bodies), np.uint8)
        del bodies, parts
        order = np.lexsort((x["start"], x["tag"], x["doc"], x["content"], x["anchor"]))
        anchor, content, doc, tag, start = (x[k][order] for k in ("anchor", "content", "doc", "tag", "start"))
        at, n, size = at[order], x["count"][order].astype(np.int64), x["size"][order].astype(np.int64)
        first = np.ones(len(anchor), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
        group = np.cumsum(first) - 1
        lead = np.flatnonzero(first)  # the earliest place of each content
        # one of the rows of a content brings its bytes
        bring = np.zeros(len(lead), np.int64)
        has = np.flatnonzero(size > 0)
        bring[group[has]] = has
        mask = matcher(kind, anchor[lead], body, at[bring], size[bring], n[lead], doc[lead], tag[lead], start[lead].astype(np.int64))
        full = np.where(n >= 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))
        # words: places of the lead's document are judged as it is; bytes: a repeated row is the same place
        own = doc == doc[lead][group]
        if not kind.words:
            own &= start == start[lead][group]
        out = np.where(own, mask[group], full)
        keep = np.flatnonzero(out)
        bucket = _doc_bucket(doc[keep], bits)
        by = np.argsort(bucket, kind="stable")
        keep = keep[by]
        yield ex.pack(bucket[by], {"doc": doc[keep], "tag": tag[keep], "start": start[keep].astype(np.int32), "mask": out[keep]})

    return run


SPANS = "doc_id long, tag long, spans binary"


def _spans(length: int):
    """At the bucket of a document: the union of its marked windows, as (start, end) pairs."""

    @ex.trimmed
    def run(batches):
        x, _, _ = ex.unpack(batches, doc=np.int64, tag=np.int64, start=np.int32, mask=np.uint64)
        bits = (x["mask"][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1) if len(x["mask"]) <= 200_000 else None
        if bits is not None:
            row, col = np.nonzero(bits)
        else:
            rows, cols = [], []
            for i in range(0, len(x["mask"]), 200_000):
                r, c = np.nonzero((x["mask"][i : i + 200_000, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
                rows.append((r + i).astype(np.int64))
                cols.append(c)
            row, col = np.concatenate(rows), np.concatenate(cols)
        d, t, s = x["doc"][row], x["tag"][row], x["start"][row].astype(np.int64) + col
        order = np.lexsort((s, t, d))
        d, t, s = d[order], t[order], s[order]
        if not len(d):
            return
        other = np.ones(len(d), bool)
        other[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
        new = other.copy()
        new[1:] |= s[1:] > s[:-1] + length
        at = np.flatnonzero(new)
        d, t, s, e, other = d[at], t[at], s[at], s[np.append(at[1:] - 1, len(s) - 1)] + length, other[at]
        ids = np.flatnonzero(other)
        pairs = np.column_stack([s, e]).astype(np.int64)
        ends = np.append(ids[1:], len(d))
        for i in range(0, len(ids), 2000):
            yield ex.batch({"doc_id": d[ids[i : i + 2000]], "tag": t[ids[i : i + 2000]], "spans": pa.array([pairs[a:b].tobytes() for a, b in zip(ids[i : i + 2000], ends[i : i + 2000])], pa.binary())})

    return run


def marked(docs: DataFrame, kind: Kind, matcher: Callable, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, spans, copy, and the columns to carry: every document with the elements that earlier windows cover.

    ``spans`` packs pairs of longs, (start, end) in elements, sorted and not
    touching; null where nothing is covered.  ``copy`` is true for a text equal to
    an earlier one: all of it is covered if it has a window.
    """
    ex.prepare(docs.sparkSession)
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry).where("doc_id is not null")
    size = ex.input_bytes(every.select("doc_id", "text"))
    bits = ex.bucket_bits(size)
    digests = ex.cut(every.where(F.octet_length("text") > 0).select("doc_id", F.unhex(F.md5("text")).alias("k"), F.xxhash64("text").alias("tag"), (F.octet_length("text") >= kind.length).alias("long")))
    mixed = ex.cut(digests.groupBy("doc_id").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("doc_id", F.lit(True).alias("mixed")))
    n_mixed = mixed.count()

    def tagged(df, tag):
        if not n_mixed:
            return df.withColumn("tag", F.lit(0).cast("long"))
        few = F.broadcast(mixed) if n_mixed <= ex.BROADCAST_ROWS else mixed
        return df.join(few, "doc_id", "left").withColumn("tag", F.when(F.col("mixed"), tag).otherwise(F.lit(0).cast("long"))).drop("mixed")

    row = ["doc_id", "tag"]
    every = tagged(every, F.xxhash64("text")).select("doc_id", "text", "tag", *carry)
    digests = tagged(digests.where("long"), F.col("tag"))
    lead = digests.groupBy("k").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("other")).where("lead <> other").select("k", "lead")
    copies = ex.cut(digests.join(lead, "k").where("doc_id <> lead").select(*row).distinct())
    first = ex.anti(every.select("doc_id", "text", "tag"), copies, row, copies.count())
    seen = ex.by_bucket(first.mapInArrow(_anchors(kind, bits), SEEN), bits).mapInArrow(_shared(bits, max(HOT, size // 5_000_000)), SEEN)
    work = ex.cut(ex.by_bucket(seen, bits).mapInArrow(_per_doc, DOCS))
    hot = b"".join(bytes(r.anchors) for r in work.where("doc_id is null").select("anchors").collect())
    hot = np.unique(np.frombuffer(hot, np.uint64)).tobytes()
    work = work.where("doc_id is not null")
    near = ex.semi(first, work.select("doc_id"), "doc_id", work.count()).join(work.hint("shuffle_merge"), "doc_id").select("doc_id", "text", "anchors", "tag")
    parts = ex.by_bucket(near.mapInArrow(_fragments(kind, bits, hot), FRAGMENTS), bits).mapInArrow(_match(kind, bits, matcher), MARKS)
    spans = ex.by_bucket(parts, bits).mapInArrow(_spans(kind.length), SPANS)
    found = ex.cut(spans.withColumn("copy", F.lit(False)).unionByName(copies.select(*row, F.lit(None).cast("binary").alias("spans"), F.lit(True).alias("copy"))))
    rows = found.count()
    if rows > ex.BROADCAST_ROWS:
        return every.join(found, row, "left").select("doc_id", "text", "spans", "copy", *carry)
    ids = F.broadcast(found.select(*row))
    touched = every.join(ids, row, "left_semi").join(found.hint("shuffle_merge"), row).select("doc_id", "text", "spans", "copy", *carry)
    rest = every.join(ids, row, "left_anti").select("doc_id", "text", F.lit(None).cast("binary").alias("spans"), F.lit(False).alias("copy"), *carry)
    return touched.unionByName(rest)


def span_array(spans: bytes | None, copy: bool | None, n: int, length: int) -> list[tuple[int, int]]:
    if copy:
        return [(0, n)] if n >= length else []
    return [] if spans is None else [tuple(x) for x in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist()]
