import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sessionloom.llm import ppm
from sessionloom.llm.ppm import END, PAD, ppm_scores

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def low(t):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())


def brute_ppm(train, texts, order):
    follow = defaultdict(Counter)
    for t in train:
        seq = bytes([PAD] * order) + low(t) + bytes([END])
        for i in range(order, len(seq)):
            for k in range(order + 1):
                follow[seq[i - k : i]][seq[i]] += 1
    out = []
    for t in texts:
        seq, total = bytes([PAD] * order) + low(t) + bytes([END]), 0.0
        for i in range(order, len(seq)):
            gone = set()
            for k in range(order, -1, -1):
                c = follow.get(seq[i - k : i])
                if not c:
                    continue
                live = {b: n for b, n in c.items() if b not in gone}
                if not live:
                    continue
                both = sum(live.values()) + len(live)
                if seq[i] in live:
                    total += math.log10(live[seq[i]] / both)
                    break
                total += math.log10(len(live) / both)
                gone |= set(live)
            else:
                total -= math.log10(256 - len(gone))
        out.append(total)
    return out


def rows_for():
    r = random.Random(7)
    v = ["the", "of", "And", "zebra", "été", "x"] + [f"rare{k}" for k in range(40)]
    rows = [(i, " ".join(r.choice(v) for _ in range(r.choice([0, 1, 7, 40]))), "c") for i in range(90)]
    rows += [rows[3], rows[3], rows[4], (5, "another text of zebra rare3", "c"), (300, "the zebra " * 3000, "c")]
    return rows + [(200, None, "c"), (201, "", "c"), (202, "Qq\n\x00 \U0001f600", "c")]


@pytest.mark.parametrize("max_words, max_nodes, flush", [(1000, 10**6, 10**6), (4, 10**6, 10**6), (1000, 20, 10**6), (4, 0, 300)])
def test_scores_against_brute_force(spark, max_words, max_nodes, flush, monkeypatch):
    """Repeated rows, a doc_id with two texts and a long text; with all, some and no codes broadcast."""
    monkeypatch.setattr(ppm.ex, "FLUSH", flush)
    rows = rows_for()
    train = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 10]
    c = Counter()
    for t in train:
        c.update(WORD.findall(low(t)))
        c[None] += 1
    n, v = sum(c.values()), len(c)
    want = []
    for (i, t, _), score in zip(rows, brute_ppm(train, [t for _, t, _ in rows], 3)):
        tokens = [*WORD.findall(low(t)), None]
        base = sum(math.log10((c[k] + 0.1) / (n + 0.1 * (v + 1))) for k in tokens)
        want.append((i, zlib.crc32(str(i).encode()) % 10 == 0, len(tokens), sum(c[k] > 0 for k in tokens), n, base, score))
    df = spark.createDataFrame([*rows, (None, "x", "c")], "doc_id long, text string, score string").repartition(3)
    got = sorted(tuple(x) for x in ppm_scores(spark, df, order=3, max_words=max_words, max_nodes=max_nodes).collect())
    assert len(got) == len(rows)
    for x, y in zip(got, sorted(want)):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=1e-9)


def test_probabilities_of_a_context_sum_to_at_most_one(spark):
    """An escape from a context of one byte to shorter ones that it exhausts is coded though nothing follows, so less than one is possible."""
    text = "abracadabra abba " * 20
    rows = [(i, text[i:]) for i in range(1, 9)]
    counts = Counter()
    for _, t in rows:
        seq = bytes([PAD] * 2) + t.encode() + bytes([END])
        counts.update(seq[i - 2 : i + 1] for i in range(2, len(seq)))
    number = lambda b: int.from_bytes(b, "big")
    seen = spark.createDataFrame([(number(k), n) for k, n in counts.items()], "value long, n long")
    wanted = [(number(ctx + bytes([b])),) for ctx in (b"ab", b"zz", b"za", bytes([PAD, PAD])) for b in range(256)]
    unseen = spark.createDataFrame([w for w in wanted if w[0] not in {number(k) for k in counts}], "value long")
    p = {r.value: 10**r.w for r in ppm._logarithms(seen, 2, unseen).collect()}
    for ctx in (b"ab", b"zz", b"za", bytes([PAD, PAD])):
        total = sum(p[number(ctx + bytes([b]))] for b in range(256))
        assert 0.99 <= total <= 1 + 1e-9


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ppm_scores(spark, df).collect() == []
