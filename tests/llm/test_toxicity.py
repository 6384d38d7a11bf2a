import random
import zlib

import numpy as np

from sessionloom.llm import toxicity as tx


def data(n=600):
    r = random.Random(5)
    clean = [f"word{k}" for k in range(150)]
    bad = ["vilk", "grod", "snarf"]
    docs, labels = [], []
    for i in range(n):
        t = [r.choice(clean) for _ in range(r.randint(5, 60))]
        toxic = int(i % 6 == 0)
        for _ in range(toxic * r.randint(1, 4)):
            t.insert(r.randint(0, len(t)), r.choice([*bad, "stemx" + r.choice("abcdefgh") + str(r.randrange(99))]))
        docs.append((i, " ".join(t), "en"))
        if i % 3 != 1 or i % 6 == 0:
            labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = data()
    extra = [(9000, None, None), (9001, "", "en"), (9002, " \n", "en"), (None, "vilk", "en")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, toxic string").repartition(3)
    lab = spark.createDataFrame(labels + [(3, 1, None), (None, 1, 1), (5, 0, 7)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in tx.toxicity(spark, d, lab).collect()}
    assert len(got) == len(docs) + 3
    truth = {i: int(i % 6 == 0) for i, *_ in docs}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got.values())
    assert got[9000].predicted == got[9001].predicted == 0


def test_one_kind_of_label_and_no_rows(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert {x.predicted for x in tx.toxicity(spark, d, lab).collect()} == {0}
    assert len(tx.toxicity(spark, d, lab.limit(0)).collect()) == 2
    assert tx.toxicity(spark, d.limit(0), lab).collect() == []


def held_out_right(got, n):
    truth = {i: int(i % 6 == 0) for i in range(n)}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    return sum(got[i].predicted == truth[i] for i in held) / len(held)


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores_come_from_the_walks(spark, monkeypatch):
    docs, labels = data()
    d, lab = frames(spark, docs, labels)
    whole = held_out_right({x.doc_id: x for x in tx.toxicity(spark, d, lab).collect()}, len(docs))
    monkeypatch.setattr(tx, "polarities", lambda spark, cells, toxic, clean: np.zeros(len(toxic)))
    none = held_out_right({x.doc_id: x for x in tx.toxicity(spark, d, lab).collect()}, len(docs))
    assert whole >= 0.97 and none <= whole - 0.1


def test_a_term_that_no_labelled_text_has_gets_a_polarity(spark):
    docs, labels = data()
    seen = {i for i, *_ in labels}
    r = random.Random(8)
    free = [i for i, *_ in docs if i not in seen]
    for k, i in enumerate(free[:60]):
        w = docs[i][1].split()
        new = ["unseenbad", r.choice(["vilk", "grod", "snarf"])] if k % 2 else ["unseengood", "word7"]
        at = r.randint(0, len(w))
        w[at:at] = new
        docs[i] = (i, " ".join(w), "en")
    d, lab = frames(spark, docs, labels)
    lex = tx.induce(spark, d.select("doc_id", "text"), lab.select("doc_id", "toxic"))
    hashes = lambda w: tx.term_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0]
    at = {w: lex.nodes(hashes(w))[0] for w in ("unseenbad", "unseengood", "vilk", "word7")}
    assert all(v >= 0 for v in at.values())
    p = {w: lex.polarity[v] for w, v in at.items()}
    assert p["vilk"] > 0.5 and p["unseenbad"] > 0.3 and p["unseengood"] <= 0 and p["word7"] <= 0


def test_cells_and_walks_equal_a_dense_loop(spark, monkeypatch):
    """Small flushes, repeated rows, a long text and an empty one."""
    monkeypatch.setattr(tx.ex, "FLUSH", 200)
    r = random.Random(3)
    vocab = [f"{a}{b}" for a in "kmnp" for b in "aeiou"]
    texts = [" ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 9, 30]))) for _ in range(40)] + [" ".join(r.choice(vocab) for _ in range(6000))]
    texts += texts[:3]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    terms = np.sort(np.array([tx.term_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, 2]))[0][0][0] for w in vocab]))
    name = {w: int(np.searchsorted(terms, tx.term_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, 2]))[0][0][0])) for w in vocab}
    common = np.zeros(len(vocab), bool)
    common[name["ka"]] = True
    cells = tx.ex.cut(tx.ex.by_bucket(d.mapInArrow(tx._near(terms, common, 3), tx.CELLS), 3).mapInArrow(tx._cell_sums, tx.CELLS))
    n = len(vocab)
    c = np.zeros((n, n))
    for t in texts:
        w = t.split()
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + tx.NEAR + 1)):
                a, b = name[w[i]], name[w[j]]
                if a != b and not common[a] and not common[b]:
                    c[a, b] += 1
                    c[b, a] += 1
    row = c.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        m = np.minimum.outer(row, row)
        w = np.where(c > 0, np.maximum(np.log(c * row.sum() / np.outer(row, row)), 0) * c / (c + 1) * m / (m + tx.DISCOUNT), 0.0)
    out = w.sum(axis=1, keepdims=True)
    step = np.divide(w, out, out=np.zeros_like(w), where=out > 0)
    toxic, clean = np.zeros(n), np.zeros(n)
    toxic[[name["ma"], name["me"]]] = 1
    clean[[name["po"], name["pu"], name["no"]]] = [1, 2, 3]
    x = []
    for s in (toxic / toxic.sum(), clean / clean.sum()):
        v = s.copy()
        for _ in range(tx.STEPS):
            v = tx.WALK * (v @ step) + (1 - tx.WALK) * s
        x.append(v)
    want = np.divide(x[0] - x[1], x[0] + x[1], out=np.zeros(n), where=x[0] + x[1] > 0)
    assert np.allclose(tx.polarities(spark, cells, toxic, clean), want)


def test_repeated_rows_a_long_text_and_ties(spark):
    docs, labels = data(300)
    docs = [*docs, docs[0], docs[0], (8000, " ".join(["word1 vilk"] * 50_000), "en")]
    d, lab = frames(spark, docs, labels)
    got = [tuple(x) for x in tx.toxicity(spark, d, lab).collect()]
    assert len(got) == len(docs) and len({x for x in got if x[0] == 0}) == 1 and sum(x[0] == 0 for x in got) == 3
    assert next(x for x in got if x[0] == 8000)[3] == 1
    assert sorted(got) == sorted(tuple(x) for x in tx.toxicity(spark, d.repartition(5), lab).collect())


def test_squeezed_numbers_come_back():
    r = np.random.default_rng(1)
    for v in (np.zeros(0, np.int64), r.integers(0, 1 << 40, 1000), np.arange(5)):
        assert np.array_equal(tx.ex.unsqueeze(tx.ex.squeeze(v), len(v)), v)
