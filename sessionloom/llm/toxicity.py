"""Toxicity scores by lexicon induction.

Terms are the words and word beginnings (stems) of all texts that occur in a share
of them.  Over the graph of terms that stand near each other, weighted by positive
pointwise mutual information, random walks restart at the toxic seeds and at the
clean ones, and a term's polarity is the difference of the two walks' visits: a term
that no labelled text has gets one too.  Labels enter by the seeds, which are terms
whose odds differ between labelled toxic and other texts, and by the scale that turns
the polarities of a text's terms into a score.

The cells of the graph are counted in all texts, travel squeezed by buckets of a
term, and stay there; a step of the walks reads them with the visits of all terms,
whose number the share bounds, and returns a sum for each term.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import vec

#: Labelled texts of which seeds and scale are learnt, by the hash of their id: the bound of the sample.
MAX_LABELLED = 50_000
#: Share of the texts that a term occurs in at least (in LEAST texts in any case): at most (terms of a text) / SHARE terms exist.
SHARE, LEAST = 0.005, 3
#: Terms in a greater share of the texts are no nodes, unless labels tell them apart.
COMMON = 0.1
#: How far a seed's labels differ (:func:`_z`), words between neighbours at most, chance to go on walking, steps.
Z, NEAR, WALK, STEPS = 5.0, 5, 0.6, 6
#: What a count is discounted by: pairs of rare terms meet by chance.
DISCOUNT = 5
#: Bytes of the beginnings that are terms.
STEMS = (5, 4)


#: Lower case; what is neither an ASCII letter or digit nor part of another character separates words.
_LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() or c == 39 else 32 for c in range(256)], np.uint8)


def term_hashes(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For every word, from special to general: its hash, and that of its beginnings; and the words' ranges."""
    data = _LETTERS[data]
    s, e, wr = vec.word_bounds(data, off)
    sums = vec.rolling(data)
    out = [vec.span_hash(sums, s, e)]
    for k in STEMS:
        out.append(vec.span_hash(sums, s, np.minimum(e, s + k)) + np.uint64(k))
    return out, wr


@dataclass
class Lexicon:
    """Terms (sorted hashes) with weights, and the scale of the features."""

    terms: np.ndarray
    polarity: np.ndarray
    scale: np.ndarray

    def nodes(self, hashes: list[np.ndarray]) -> np.ndarray:
        """The term of each word: itself, else its longest beginning that is one, else -1."""
        out = np.full(len(hashes[0]), -1, np.int64)
        if not len(self.terms):
            return out
        for h in reversed(hashes):
            at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
            out = np.where(self.terms[at] == h, at, out)
        return out

    def features(self, hashes: list[np.ndarray], ranges: np.ndarray) -> np.ndarray:
        """A row for each text: strongest term, clearly toxic mass, its share, mean polarity, one."""
        n = len(ranges) - 1
        owner, node = vec.owners(ranges), self.nodes(hashes)
        p = np.where(node >= 0, np.maximum(self.polarity[node], 0.0), 0.0) if len(self.terms) else np.zeros(len(node))
        top = np.zeros(n)
        np.maximum.at(top, owner, p)
        mass = np.bincount(owner, weights=np.where(p > 0.5, p, 0.0), minlength=n)
        size = np.maximum(1, np.diff(ranges))
        return np.column_stack([top, np.log1p(mass), np.sqrt(mass / size), np.bincount(owner, weights=p, minlength=n) / size, np.ones(n)])

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(features @ self.scale, -30, 30)))


TERMS = ex.pack_schema("value", "df", "pos", "neg")


def _term_counts(bits: int):
    """The terms of a task's texts: texts that have them, labelled toxic ones, other labelled ones."""

    def merged(held):
        u, inv = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return u, *(np.bincount(inv, weights=np.concatenate([h[i] for h in held]), minlength=len(u)).astype(np.int32) for i in (1, 2, 3))

    def packed(h, *counts):
        return ex.pack((h >> np.uint64(64 - bits)).astype(np.int32), dict(zip(("value", "df", "pos", "neg"), (h, *counts))))

    def run(batches):
        held, size = [], 0
        for b in batches:
            toxic = b.column(b.schema.get_field_index("toxic")).fill_null(-1).to_numpy(zero_copy_only=False)
            for r0, r1, data, off in vec.chunks(b.column(b.schema.get_field_index("text"))):
                hashes, wr = term_hashes(data, off)
                owner = np.tile(vec.owners(wr), len(hashes))
                h = np.concatenate(hashes)
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                keep = np.ones(len(h), bool)
                keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                h, y = h[keep], toxic[r0:r1][owner[keep]]
                at = ex.group_starts(h)
                if len(at):
                    held.append((h[at], np.diff(np.append(at, len(h))), np.add.reduceat((y == 1).astype(np.int64), at), np.add.reduceat((y == 0).astype(np.int64), at)))
                    size += len(at)
                if size > ex.FLUSH:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > ex.FLUSH // 2:
                        yield packed(*held.pop())
                        size = 0
        if held:
            yield packed(*merged(held))

    return run


def _frequent_terms(least: int):
    def run(batches):
        x, _, _ = ex.unpack(batches, value=np.uint64, df=np.int32, pos=np.int32, neg=np.int32)
        if len(x["value"]):
            u, inv = np.unique(x["value"], return_inverse=True)
            df, pos, neg = (np.bincount(inv, weights=x[k], minlength=len(u)).astype(np.int64) for k in ("df", "pos", "neg"))
            ok = df >= least
            yield ex.batch({"term": u[ok].view(np.int64), "df": df[ok], "pos": pos[ok], "neg": neg[ok]})

    return run


def _z(pos, neg, n_pos, n_neg):
    """How far the labelled texts with a term differ from all: the signed root of the log-likelihood ratio."""
    n, rate = pos + neg, n_pos / (n_pos + n_neg)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(pos > 0, pos * np.log(pos / (n * rate)), 0.0) + np.where(neg > 0, neg * np.log(neg / (n * (1 - rate))), 0.0))
    return np.where(n > 0, np.sign(pos - n * rate) * np.sqrt(np.maximum(g, 0.0)), 0.0)


CELLS = "bucket int, code binary, n binary, size int"


def _cells(bucket: np.ndarray, code: np.ndarray, n: np.ndarray):
    """A row for each bucket: sorted codes and their counts, squeezed."""
    at = np.append(ex.group_starts(bucket), len(bucket))
    parts = list(zip(at[:-1], at[1:]))
    return ex.batch({
        "bucket": pa.array(bucket[at[:-1]].astype(np.int32)), "code": pa.array([ex.squeeze(np.diff(code[a:z], prepend=0)) for a, z in parts], pa.binary()),
        "n": pa.array([ex.squeeze(n[a:z]) for a, z in parts], pa.binary()), "size": pa.array([z - a for a, z in parts], pa.int32()),
    })


def _open(b: pa.RecordBatch):
    for code, n, size in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
        yield np.cumsum(ex.unsqueeze(code, size)), ex.unsqueeze(n, size)


def _near(terms: np.ndarray, common: np.ndarray, bits: int):
    """Counts of terms near each other, summed over the texts of a task; a cell goes by its smaller term."""
    lex = Lexicon(terms, np.zeros(len(terms)), np.zeros(0))
    n = len(terms)
    spread = (vec.mix(np.arange(n, dtype=np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)

    def summed(held):
        if len(held) == 1 and held[0][1] is None:
            u, c = np.unique(held[0][0], return_counts=True)
            return u, c.astype(np.int64)
        u, inv = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return u, np.bincount(inv, weights=np.concatenate([np.ones(len(h[0])) if h[1] is None else h[1] for h in held]), minlength=len(u)).astype(np.int64)

    def rows(code, count):
        bucket = spread[code // n]
        order = np.argsort(bucket, kind="stable")
        return _cells(bucket[order], code[order], count[order])

    def run(batches):
        held, size = [], 0
        for _, data, off in ex.text_chunks(batches):
            hashes, wr = term_hashes(data, off)
            node, owner = lex.nodes(hashes), vec.owners(wr)
            at = np.flatnonzero((node >= 0) & ~common[node])
            node, owner = node[at], owner[at]
            for j in range(1, NEAR + 1):
                ok = (at[j:] - at[:-j] <= NEAR) & (owner[j:] == owner[:-j])
                a, b = node[:-j][ok], node[j:][ok]
                code = (np.minimum(a, b) * n + np.maximum(a, b))[a != b]
                held.append((code, None))
                size += len(code)
            if size > ex.FLUSH:
                held = [summed(held)]
                size = len(held[0][0])
                if size > ex.FLUSH // 2:
                    yield rows(*held.pop())
                    size = 0
        if size:
            yield rows(*summed(held))

    return run


def _cell_sums(batches):
    """At a bucket: the counts of all tasks summed, a few at a time so that no more than the cells is held."""
    codes, counts, size, bucket = [], [], 0, 0

    def merged():
        u, inv = np.unique(np.concatenate(codes), return_inverse=True)
        return u, np.bincount(inv, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)

    last = 0
    for b in batches:
        for i, (code, n) in enumerate(_open(b)):
            bucket = b.column(0)[i].as_py()
            codes.append(code)
            counts.append(n)
            size += len(code)
            if size > 2 * last + 1_000_000:
                code, n = merged()
                codes, counts, last = [code], [n], len(code)
                size = last
    if codes:
        code, n = merged()
        yield _cells(np.full(len(code), bucket), code, n)


def _sums(names: tuple[str, ...], vectors):
    """Rows (term, sums): each cell gives the values that ``vectors`` makes of it to both of its terms."""

    def run(batches):
        total = None
        for b in batches:
            for code, n in _open(b):
                a, z, values = vectors(code, n)
                total = total if total is not None else np.zeros((len(names), vectors.terms))
                for k, (to_a, to_z) in enumerate(values):
                    total[k] += np.bincount(a, weights=to_a, minlength=vectors.terms) + np.bincount(z, weights=to_z, minlength=vectors.terms)
        if total is not None:
            at = np.flatnonzero(total.any(axis=0))
            yield ex.batch({"term": at, **{k: total[i][at] for i, k in enumerate(names)}})

    return run


class _Margins:
    """The cells of each term."""

    def __init__(self, terms: int) -> None:
        self.terms = terms

    def __call__(self, code, n):
        return code // self.terms, code % self.terms, [(n, n)]


class _Walk:
    """The weights of each term's edges or, with ``visits``, the visits that its neighbours send it."""

    def __init__(self, margin, visits=None) -> None:
        self.terms, self.margin, self.visits = len(margin.value), margin, visits

    def __call__(self, code, n):
        a, z = code // self.terms, code % self.terms
        margin = self.margin.value
        w = ppmi(n, margin[a], margin[z], margin.sum())
        if self.visits is None:
            return a, z, [(w, w)]
        return a, z, [(w * v[z], w * v[a]) for v in self.visits.value]


def ppmi(n: np.ndarray, a: np.ndarray, b: np.ndarray, total: float) -> np.ndarray:
    """Positive pointwise mutual information of cells with margins a and b, discounted where these are small."""
    least = np.minimum(a, b)
    return np.maximum(np.log(n * total / (a * b)), 0.0) * n / (n + 1) * least / (least + DISCOUNT)


def _by_term(cells: DataFrame, names: tuple[str, ...], vectors) -> np.ndarray:
    rows = cells.mapInArrow(_sums(names, vectors), "term long, " + ", ".join(f"{k} double" for k in names))
    rows = rows.groupBy("term").agg(*(F.sum(k).alias(k) for k in names)).toPandas()
    out = np.zeros((len(names), vectors.terms))
    for i, k in enumerate(names):
        out[i, rows["term"].to_numpy(np.int64)] = rows[k].to_numpy()
    return out


def polarities(spark, cells: DataFrame, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Polarity of each term from -1 to 1 by walks over the PPMI graph; ``toxic`` and ``clean`` weigh the seeds."""
    margin = spark.sparkContext.broadcast(_by_term(cells, ("n",), _Margins(len(toxic)))[0])
    out = _by_term(cells, ("w",), _Walk(margin))[0]
    start = np.stack([toxic / max(toxic.sum(), 1e-300), clean / max(clean.sum(), 1e-300)])
    x = start.copy()
    for _ in range(STEPS):
        visits = spark.sparkContext.broadcast(np.divide(x, out, out=np.zeros_like(x), where=out > 0))
        x = WALK * _by_term(cells, ("pos", "neg"), _Walk(margin, visits)) + (1 - WALK) * start
        visits.unpersist()
    # rounded, as sums differ in their last digits with the order of tasks
    return np.round(np.divide(x[0] - x[1], x[0] + x[1], out=np.zeros(len(toxic)), where=x.sum(axis=0) > 0), 9)


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    if not len(y):
        return w
    ridge = np.full(x.shape[1], 1e-2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        move = np.linalg.solve(hess, grad)
        w -= move * min(1.0, 4 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    return w


def induce(spark, docs: DataFrame, use: DataFrame, share: float = SHARE) -> Lexicon:
    """A lexicon from all texts (doc_id, text) and the labels to use (doc_id, toxic: 0 or 1), few enough to be broadcast."""
    labelled = docs.join(F.broadcast(use), "doc_id").select("doc_id", "text", "toxic")
    sides = labelled.agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).first()
    n_pos = int(sides.pos or 0)
    n_neg = int(sides.n) - n_pos
    if not n_pos or not n_neg:  # nothing to tell apart
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0), np.array([0, 0, 0, 0, np.log((n_pos + 0.5) / (n_neg + 0.5))]))
    n_docs = docs.count()
    bits = ex.bucket_bits(ex.input_bytes(docs), 4 * ex.BUCKET_BYTES)
    found = ex.by_bucket(docs.join(F.broadcast(use), "doc_id", "left").select("text", "toxic").mapInArrow(_term_counts(bits), TERMS), bits).mapInArrow(_frequent_terms(max(LEAST, int(np.ceil(share * n_docs)))), "term long, df long, pos long, neg long").toPandas()
    term = found["term"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(term)
    term, df, pos, neg = term[order], *(found[k].to_numpy(np.int64)[order] for k in ("df", "pos", "neg"))
    rate = n_pos / (n_pos + n_neg)
    z = _z(pos, neg, n_pos, n_neg)
    common = (df > COMMON * n_docs) & (np.abs(z) <= Z)
    often = pos >= 2 * rate * (pos + neg) if rate < 0.4 else pos > neg
    toxic = (z > Z) & often & ~common
    if not toxic.any() and len(z):
        toxic = (z == z.max()) & (z > 0)
    clean = np.where(~common & ~toxic & (pos <= 2 * rate * (pos + neg)), neg, 0)
    cells = ex.cut(ex.by_bucket(docs.mapInArrow(_near(term, common, bits), CELLS), bits).mapInArrow(_cell_sums, CELLS))
    lex = Lexicon(term, polarities(spark, cells, toxic.astype(float), clean.astype(float)), np.zeros(5))

    def features(batches):
        for b in batches:
            y = b.column(b.schema.get_field_index("toxic")).to_numpy()
            for r0, r1, data, off in vec.chunks(b.column(b.schema.get_field_index("text"))):
                f = lex.features(*term_hashes(data, off))
                yield ex.batch({"y": y[r0:r1].astype(np.float64), **{f"f{i}": f[:, i] for i in range(5)}})

    table = labelled.mapInArrow(features, "y double, f0 double, f1 double, f2 double, f3 double, f4 double").toPandas().to_numpy()
    table = table[np.lexsort(table.T)]
    lex.scale = _fit(table[:, 1:], table[:, 0])
    return lex


def toxicity(spark, docs: DataFrame, labels: DataFrame, held_out: int = 5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted, n_terms: how likely each whole text is toxic.

    Labels count where ``crc32(doc_id as text) mod held_out`` is not 0; of those,
    ``max_labelled`` at most are used, chosen by a hash of the id.  Terms and graph
    are counted in all texts; a term's polarity is that of the walks alone.  ``score``
    is from 0 to 1, ``predicted`` is 1 from 0.5.  Labels, language, source and id are
    no inputs of a score.

    Null and empty texts have no terms and get the score of such texts.  Rows with
    a null doc_id are left out; labels that are null or not 0 or 1 are ignored;
    repeated rows are scored each.  Other columns are ignored.  Without labels of
    both kinds all scores are the share of toxic labels.
    """
    ex.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out == 0
    use = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held)
    use = use.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    lex = induce(spark, docs, ex.cut(use))

    def run(batches):
        for ids, data, off in ex.text_chunks(batches):
            hashes, wr = term_hashes(data, off)
            score = lex.score(lex.features(hashes, wr))
            n = np.bincount(vec.owners(wr)[lex.nodes(hashes) >= 0], minlength=len(ids)).astype(np.int64)
            yield ex.batch({"doc_id": ids, "score": score, "predicted": (score >= 0.5).astype(np.int32), "n_terms": n})

    return docs.mapInArrow(run, "doc_id long, score double, predicted int, n_terms long").select("doc_id", held.alias("held_out"), "score", "predicted", "n_terms")
