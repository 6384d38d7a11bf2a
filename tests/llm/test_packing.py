import random
from collections import Counter, defaultdict

import pytest

from sessionloom.llm.packing import Bins, best_fit_packing


def test_every_word_once_and_no_conflict(spark):
    r = random.Random(3)
    texts = [" ".join(["w%d" % r.randrange(99)] * r.choice([0, 1, 5, 30, 90, 250])) for _ in range(150)]
    rows = [(i, t, None if i % 11 == 0 else ("hot" if i % 3 == 0 else f"s{i % 5}"), i) for i, t in enumerate(texts)]
    rows += [(500, None, "a", 0), (501, " \n", "a", 0), (None, "x y", "a", 0)] + [(600 + k, "copy of a text", f"z{k}", 0) for k in range(20)]
    got = best_fit_packing(spark, spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id long"), capacity=100).collect()
    source = {i: s for i, _, s, _ in rows}
    text = {i: t or "" for i, t, _, _ in rows}
    spans, bins = defaultdict(list), defaultdict(list)
    for x in got:
        spans[x.doc_id].append((x.start, x.start + x.length))
        bins[x.bin_id].append(x)
    for i, t in text.items():
        n = len(t.split())
        if n and i is not None:
            s = sorted(spans[i])
            assert s[0][0] == 0 and s[-1][1] == n and all(a[1] == b[0] for a, b in zip(s, s[1:]))
        else:
            assert i not in spans
    for held in bins.values():
        used = sum(x.length for x in held)
        assert used <= 100 and {x.left_over for x in held} == {100 - used}
        assert max(Counter(source[x.doc_id] for x in held).values()) <= 2
        assert len({text[x.doc_id] for x in held}) == len(held)
        assert sorted(x.slot for x in held) == list(range(len(held)))


def test_best_fit_against_scan_of_all_bins():
    r = random.Random(4)
    bins, mine = Bins(50, 2), []
    for _ in range(400):
        size, s, c = r.randint(1, 50), r.randrange(4), r.randrange(40)
        b = bins.place(size, 1 << s, 1 << c)
        fits = [k for k, (left, ss, cc) in enumerate(mine) if left >= size and ss.count(s) < 2 and c not in cc]
        if fits:
            assert mine[b][0] == min(mine[k][0] for k in fits) and b in fits
        else:
            assert b == len(mine)
            mine.append((50, [], set()))
        left, ss, cc = mine[b]
        mine[b] = (left - size, [*ss, s], cc | {c})


def test_no_rows(spark):
    assert best_fit_packing(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("source", ["one", None])
def test_one_source_repeated_rows_and_a_long_text(spark, source):
    rows = [(i, "w " * (40 + i % 7), source) for i in range(60)] + [(0, "w " * 40, source)] * 3 + [(99, "x " * 9_000, source), (100, "", source), (101, None, source)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, bin_id int").repartition(3)
    got = best_fit_packing(spark, df, capacity=100).collect()
    used, bins = {}, {}
    for r in got:
        used[r.doc_id] = used.get(r.doc_id, 0) + r.length
        bins.setdefault(r.bin_id, []).append(r)
    words = {}
    for i, t, _ in rows:
        if t:
            words[i] = words.get(i, 0) + len(t.split())
    assert used == words
    assert all(len(b) <= 2 and sum(r.length for r in b) <= 100 for b in bins.values())
    assert all(len({r.doc_id for r in b}) == len(b) for b in bins.values() if any(r.doc_id == 0 for r in b))
