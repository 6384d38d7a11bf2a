import random

import pytest

from sessionloom.llm import decontaminate as dc


def passages(r, vocab, n):
    return [" ".join(r.choice(vocab) for _ in range(n)) for _ in range(6)]


def test_planted_leaks_and_clean_texts(spark):
    r = random.Random(1)
    vocab = [f"w{k}" for k in range(3000)]
    items = passages(r, vocab, 30) + passages(r, vocab, 7) + [None, "", "two words"]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    rows, want = [], {}
    for i in range(80):
        t = [r.choice(vocab) for _ in range(r.choice([0, 5, 60, 200]))]
        kind = i % 4
        if kind:
            k = r.randrange(12)
            p = items[k].split()
            if kind == 2 and k < 6:  # one substitution in each seven tokens
                p = [x.upper() if j % 7 else "changed" for j, x in enumerate(p)]
            elif kind == 3 and k < 6:
                p = p[5:22]
            at = r.randint(0, len(t))
            t[at:at] = p
            want[i] = [k]
        rows.append((i, " \n".join(t), i))
    rows += [(100, None, 1), (101, "", 1), (None, items[0], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long").repartition(3)
    for block in (1_000_000, 40):
        got = {x.doc_id: x.items for x in dc.decontaminate(spark, docs, bench, block_tokens=block).collect()}
        assert len(got) == 82 and {k: v for k, v in got.items() if v} == want
    for block in (1_000_000, -1):
        assert dc.decontaminate(spark, docs.limit(0), bench, block_tokens=block).collect() == []
    assert not any(x.contaminated for x in dc.decontaminate(spark, docs, bench.limit(0)).collect())


def stretches(same, least, mismatch):
    """Tokens of all stretches within the bound, by trying each."""
    held = set()
    for a in range(len(same)):
        for b in range(a + 1, len(same) + 1):
            if same[a] and same[b - 1] and sum(same[a:b]) >= least and 100 * (b - a - sum(same[a:b])) <= mismatch * (b - a):
                held |= set(range(a, b))
    return held


@pytest.mark.parametrize("size, places", [(15, (1, 3)), (20, (11, 13, 15, 17))])
def test_overlap_whose_shorter_run_scores_higher(size, places):
    item = [f"w{k}" for k in range(size)]
    text = ["before"] * 5 + ["changed" if k in places else x for k, x in enumerate(item)] + ["after"] * 5
    index = dc.Index([0], [" ".join(item)], dc.MASKS, 12, 25)
    found = index.search(*dc._tokens([" ".join(text)]))
    assert [(t, i) for t, i, *_ in found] == [(0, 0)] and found[0][3] - found[0][2] >= 12


def test_every_overlap_within_the_bound_on_a_hit_diagonal():
    r = random.Random(3)
    items = [[f"i{k}w{j}" for j in range(r.choice([15, 16, 18, 20, 40]))] for k in range(60)]
    index = dc.Index(list(range(60)), [" ".join(x) for x in items], dc.MASKS, 12, 25)
    texts, want = [], {}
    for k, item in enumerate(items):
        places = r.sample(range(len(item)), r.choice([2, 3, 3, 4, len(item) // 4]))
        texts.append(["x"] * 4 + ["changed" if j in places else x for j, x in enumerate(item)] + ["y"] * 4)
        same = [j not in places for j in range(len(item))]
        hit = any(all(same[a + j] for j, c in enumerate(m) if c == "1") for m in dc.MASKS for a in range(len(item) - len(m) + 1))
        if hit and (held := stretches(same, 12, 25)):
            want[k] = {x + 4 for x in held}
    got = {}
    for t, i, a, b in index.search(*dc._tokens([" ".join(x) for x in texts])):
        assert t == i
        got.setdefault(t, set()).update(range(a, b))
    assert len(want) > 30 and got == want


def brute_force(rows, items, masks=dc.MASKS, least=12, mismatch=25):
    """Every row's columns from every diagonal of every item, by the rule itself."""
    out = []
    longest = max(map(len, masks))
    for doc, text in rows:
        w = [x.lower() for x in (text or "").split()]
        held, ids = set(), set()
        for item_id, item in items:
            q = [x.lower() for x in (item or "").split()]
            for shift in range(-len(q), len(w) + 1):
                same = [0 <= shift + j < len(w) and w[shift + j] == x for j, x in enumerate(q)]
                inside = [0 <= shift + j < len(w) for j in range(len(q))]
                use = masks if len(q) >= longest else ["1" * len(q)]
                hit = any(all(inside[a + j] and (c == "0" or same[a + j]) for j, c in enumerate(m)) for m in use for a in range(len(q) - len(m) + 1)) if q else False
                mine = {shift + j for j in stretches(same, min(least, len(q)), mismatch)} if hit else set()
                if mine:
                    ids.add(item_id)
                    held |= mine
        spans, places = [], sorted(held)
        for p in places:
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        out.append((doc, bool(held), len(w), len(held), sorted(ids), [tuple(x) for x in spans]))
    return sorted(out)


def test_all_columns_equal_brute_force_for_a_benchmark_of_any_size(spark):
    """Overlapping items, repeated items and rows, a doc_id with two texts, and a long text; by broadcast and by shuffle."""
    r = random.Random(5)
    vocab = [f"w{k}" for k in range(60)]
    base = [r.choice(vocab) for _ in range(80)]
    items = [(1, " ".join(base[:50])), (2, " ".join(base[30:])), (2, " ".join(base[30:])), (3, " ".join(base[10:17])), (4, "Alone"), (None, " ".join(r.choice(vocab) for _ in range(30))), (6, None), (7, " ")]
    rows = [(1, " ".join(base)), (1, " ".join(base)), (2, " ".join(base[:40])), (2, " ".join(vocab)), (3, "it is ALONE here"), (4, None), (5, ""), (6, " ".join(vocab * 30 + base[5:60] + vocab * 30)), (7, " ".join(base[:20] + ["no"] * 20 + base[40:70]))]
    for k in range(12):
        t = [x if r.random() > 0.12 else r.choice(vocab) for x in base[r.randrange(30) :]]
        rows.append((10 + k, " ".join([r.choice(vocab) for _ in range(9)] + t)))
    want = brute_force(rows, [(-1 if i is None else i, t) for i, t in items])
    assert sum(x[1] for x in want) > 8 and any(len(x[5]) > 1 for x in want)
    docs = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, n long").repartition(3)
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, tag string")
    for block in (20, 40, 60, 1_000_000):
        got = sorted((x.doc_id, x.contaminated, x.n_tokens, x.matched_tokens, x["items"], [tuple(y) for y in x.spans]) for x in dc.decontaminate(spark, docs, bench, block_tokens=block).collect())
        assert got == want, block
