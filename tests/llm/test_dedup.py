import hashlib
import random

import numpy as np
import pytest

from sessionloom.llm import repeats
from sessionloom.llm import suffixarray as sa
from sessionloom.llm.automaton import SuffixAutomaton
from sessionloom.llm.dedup import substring_dedup, suffix_array_dedup


def brute_words(rows, length):
    first, out = {}, []
    rows = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in sorted(rows):
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k : k + length]), i)
    for i, w in rows:
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_bytes(rows, length):
    first, out = {}, []
    rows = [(i, (t or "").encode()) for i, t in rows]
    for i, b in rows:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(i, first.get(w, i))
    for i, b in rows:
        gone, own = np.zeros(len(b), bool), set()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if first[w] < i or w in own:
                gone[k : k + length] = True
            own.add(w)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def rows_for(seed, vocab=400):
    r = random.Random(seed)
    v = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(vocab)]
    passages = [[r.choice(v) for _ in range(n)] for n in (49, 50, 51, 70, 200)]
    rows = []
    for i in range(60):
        t = [r.choice(v) for _ in range(r.choice([0, 3, 40, 120, 300]))]
        for _ in range(r.choice([0, 1, 2])):
            p = list(r.choice(passages))
            if r.random() < 0.4:
                p[r.randrange(len(p))] = r.choice(v)
            k = r.randint(0, len(t))
            t[k:k] = p
        rows.append((i * 2, r.choice([" ", "\n", "  "]).join(t)))
    rows += [(200 + k, rows[k * 7][1]) for k in range(5)]
    return rows + [(300, None), (301, ""), (302, "a" * 500), (303, "xy" * 200), (304, "a" * 99), (305, "a" * 100), (306, "q r " * 300), (307, "\x00" * 150), (308, " ".join(["same"] * 120)), (309, " ".join(["same"] * 60))]


@pytest.mark.parametrize("seed,hot", [(1, 1000), (2, 3)])
def test_words(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = rows_for(seed)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows] + [(None, "x " * 80, 0)], "doc_id long, text string, n_words int").repartition(3)
    got = sorted(tuple(r)[:4] for r in substring_dedup(spark, df).collect())
    assert got == brute_words(rows, 50)


@pytest.mark.parametrize("seed,hot", [(1, 1000), (2, 3)])
def test_bytes(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = rows_for(seed)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows] + [(None, "x " * 80, 0)], "doc_id long, text string, n_bytes int").repartition(3)
    got = sorted(tuple(r)[:5] for r in suffix_array_dedup(spark, df).collect())
    assert got == brute_bytes(rows, 100)


def test_no_rows_and_repeated_rows(spark):
    t = " ".join(f"w{k}" for k in range(80))
    df = spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in substring_dedup(spark, df).collect()) == [(1, 80, 0), (1, 80, 0), (2, 80, 80)]
    assert sorted(tuple(r)[2] for r in suffix_array_dedup(spark, df).collect())[:2] == [0, 0]
    assert substring_dedup(spark, df.limit(0)).collect() == []
    assert suffix_array_dedup(spark, df.limit(0)).collect() == []


def repeated_ids():
    """doc_ids that several rows share: equal texts, unlike texts, a short one, texts that share passages, a long one."""
    r = random.Random(9)
    text = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    a, b, c, d = text(120), text(100), text(90), text(80)
    return [(1, a), (2, a), (2, b), (2, "few words"), (2, None), (3, b + " " + c), (3, d + " " + c), (3, c + " " + d + " " + c), (4, c + " " + a), (4, c + " " + a), (5, text(4000) + " " + d)]


def test_rows_that_repeat_a_doc_id_with_another_text(spark):
    rows = repeated_ids()
    df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, tag string, copy long").repartition(3)
    words = sorted(tuple(x)[:4] for x in substring_dedup(spark, df).collect())
    assert words == brute_words(rows, 50) and (2, 100, 0) in [x[:3] for x in words]
    assert sorted(tuple(x)[:5] for x in suffix_array_dedup(spark, df).collect()) == brute_bytes(rows, 100)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    r = np.random.default_rng(seed)
    parts = [bytes(r.integers(0, 3, n).astype(np.uint8)) for n in r.integers(1, 60, 12)]
    text = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.repeat(np.cumsum([len(p) for p in parts]), [len(p) for p in parts])
    order, levels = sa.suffix_array(text, ends, 128)
    suffixes = [bytes(text[i : ends[i]]) for i in range(len(text))]
    assert [suffixes[i] for i in order] == sorted(suffixes)
    lcp = sa.common_prefixes(order, levels, ends, text)
    for k in range(1, len(order)):
        a, b = suffixes[order[k - 1]], suffixes[order[k]]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert lcp[k] == n


def test_shards_of_one_anchor_merge(monkeypatch):
    from sessionloom.llm.repeats import Kind

    kind = Kind(False, 10, 4)
    r = random.Random(3)
    base = bytes(r.choice(b"abcdefgh") for _ in range(40))
    frags = [base[k : k + 20] for k in range(0, 20)] + [bytes(r.choice(b"abcdefgh") for _ in range(20)) for _ in range(5)]
    r.shuffle(frags)
    body = np.frombuffer(b"".join(frags), np.uint8)
    at, n = np.arange(len(frags)) * 20, np.full(len(frags), 11)
    doc, start, anchor = np.arange(len(frags)), np.zeros(len(frags), np.int64), np.zeros(len(frags), np.uint64)
    seen, want = set(), []
    for f in frags:
        m = 0
        for k in range(11):
            m |= (f[k : k + 10] in seen) << k
            seen.add(f[k : k + 10])
        want.append(m)
    for shard in (1 << 20, 100, 30):
        monkeypatch.setattr(sa, "SHARD", shard)
        assert sa.match_bytes(kind, anchor, body, at, n + 9, n, doc, np.zeros(len(frags), np.int64), start).tolist() == want
    # three fragments in a row are of one doc_id: rows of their own
    doc, tag, want = doc // 3, np.arange(len(frags)) + 1, []
    where = {}
    for f, i in zip(frags, doc.tolist()):
        for k in range(11):
            where[f[k : k + 10]] = min(i, where.get(f[k : k + 10], i))
    for f, i in zip(frags, doc.tolist()):
        want.append(sum((where[f[k : k + 10]] < i or f[k : k + 10] in [f[j : j + 10] for j in range(k)]) << k for k in range(11)))
    for shard in (1 << 20, 100, 30):
        monkeypatch.setattr(sa, "SHARD", shard)
        assert sa.match_bytes(kind, anchor, body, at, n + 9, n, doc, tag, start).tolist() == want


def test_automaton():
    r = random.Random(5)
    for _ in range(30):
        a, refs = SuffixAutomaton(), []
        for _ in range(4):
            refs.append([r.randrange(3) for _ in range(r.randint(1, 15))])
            a.add(refs[-1])
        q = [r.randrange(3) for _ in range(20)]
        subs = {tuple(s[i:j]) for s in refs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        want = [max([0, *(k for k in range(1, i + 2) if tuple(q[i + 1 - k : i + 1]) in subs)]) for i in range(len(q))]
        assert a.matching(q) == want
