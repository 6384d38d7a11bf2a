"""Removal of repeated substrings: by words across documents, by bytes anywhere."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as ex
from .automaton import match_words
from .repeats import Kind, marked, span_array
from .suffixarray import match_bytes

#: Elements of the gram that anchors a window; shorter grams meet by chance more often.
WORD_GRAM, BYTE_GRAM = 8, 36


def _pieces(raw: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    if not spans:
        return [raw]
    return [raw[e:s] for e, s in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(raw)])]


def _each(b: pa.RecordBatch):
    text = b.column(1)
    for i, (spans, copy) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
        buf = text[i].as_buffer()
        yield buf.to_pybytes() if buf is not None else b"", spans, copy


def _rows(b: pa.RecordBatch, names: list[str], kinds: list, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    extra = b.schema.names[4:]
    return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds)), *(b.column(4 + i) for i in range(len(extra)))], ["doc_id", *names, *extra])


def substring_dedup(spark, docs: DataFrame, length: int = 50, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept: texts without the word windows of earlier documents.

    Words are runs of bytes other than space and U+0009 to U+000D, unchanged.  A
    word goes if it lies in ``length`` consecutive words that also start in a
    document with a smaller doc_id; windows are judged on the input.  ``kept``
    is the words left, joined by one space, and ``kept_sha256`` its digest.

    Null and empty texts have no words.  Rows with a null doc_id are left out;
    rows that repeat a doc_id, with the same text or another, give a row each, are
    each judged against smaller doc_ids and do not match each other.  Columns named
    in ``carry`` follow; others are ignored.
    """

    @ex.trimmed
    def out(batches):
        for b in batches:
            rows = []
            for raw, spans, copy in _each(b):
                words = raw.split()
                n = len(words)
                for i, j in reversed(span_array(spans, copy, n, length)):
                    del words[i:j]
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield _rows(b, ["n_words", "n_removed", "kept_sha256", "kept"], [pa.int64(), pa.int64(), pa.string(), pa.string()], rows)

    found = marked(docs, Kind(True, length, min(WORD_GRAM, length)), match_words, tuple(carry))
    return found.mapInArrow(out, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string" + _extra(found))


def suffix_array_dedup(spark, docs: DataFrame, length: int = 100, carry: tuple[str, ...] = (), decode: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept: texts without bytes repeated from earlier places.

    A byte of the UTF-8 text goes if it lies in a ``length``-byte string that also
    starts earlier: in a document with a smaller doc_id, or in the same one before
    it.  Matches may overlap, and are judged on the input.  ``kept`` (binary) is
    what is left; a cut may fall inside a character.  With ``decode`` it is a
    string, without the parts of characters that a cut leaves.

    Null texts count as empty.  Rows with a null doc_id are left out; rows that
    repeat a doc_id, with the same text or another, give a row each, are each judged
    against smaller doc_ids and their own text, and do not match each other.  Columns
    named in ``carry`` follow; others are ignored.
    """

    @ex.trimmed
    def out(batches):
        for b in batches:
            rows = []
            for raw, packed, copy in _each(b):
                spans = span_array(packed, copy, len(raw), length)
                pieces = _pieces(raw, spans)
                kept = b"".join(pieces)
                rows.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), "".join(p.decode("utf-8", "ignore") for p in pieces) if decode else kept))
            yield _rows(b, ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], [pa.int64()] * 3 + [pa.string(), pa.string() if decode else pa.binary()], rows)

    found = marked(docs, Kind(False, length, min(BYTE_GRAM, length)), match_bytes, tuple(carry))
    return found.mapInArrow(out, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept {'string' if decode else 'binary'}" + _extra(found))


def _extra(found: DataFrame) -> str:
    return "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields[4:])
