import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from sessionloom.llm import jaccard
from sessionloom.llm.jaccard import ngram_jaccard


def brute(rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for i, t in rows:
        w = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    link = {i: {j for j in ids if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j])} for i in ids}
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            low = min([comp[i], *(comp[j] for j in link[i])])
            changed |= low != comp[i]
            comp[i] = low
    return sorted((i, len(sets[i]), len(link[i]), comp[i]) for i in ids)


def rows_for(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    base = [[r.choice(vocab) for _ in range(r.choice([1, 2, 3, 4, 5, 6, 8, 10, 12, 14, 20, 40, 80]))] for _ in range(12)]
    rows = []
    for i in range(n):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            t[r.randrange(len(t))] = r.choice(vocab)
        rows.append((i * 3, (" " if r.random() < 0.8 else "\n").join(w.upper() if r.random() < 0.1 else w for w in t)))
    return rows + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "é É"), (1004, "é é"), (1005, "a b c d")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = rows_for(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(None, "a b c", 1)], "doc_id long, text string, n long")
    got = sorted(tuple(r)[:4] for r in ngram_jaccard(spark, df.repartition(4)).collect())
    assert got == brute(rows)


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (3, "x")], "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in ngram_jaccard(spark, df).collect()) == [(1, 3, 1, 1), (2, 3, 1, 1), (3, 1, 0, 3)]
    assert ngram_jaccard(spark, df.limit(0)).collect() == []


def test_a_task_run_again_sends_its_rows_to_the_same_buckets():
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(50), pa.int64()), "text": [f"a b c d e f{k} g h" for k in range(50)]})
    first, again = ([r for b in jaccard._scan(3, 10)([batch]) for r in b.to_pylist()] for _ in range(2))
    assert first == again
    held = [x for r in first for x in np.frombuffer(r["info"], np.int64).reshape(-1, 5)[:, 0].tolist()]
    assert sorted(held) == list(range(50))


@pytest.mark.parametrize("kind", ["many short texts in long lists", "long texts in short lists", "long lists in blocks"])
def test_boundary_follows_the_data(spark, monkeypatch, kind):
    chosen = []
    bound = jaccard.light_bound
    monkeypatch.setattr(jaccard, "light_bound", lambda percent, sizes: chosen.append(bound(percent, sizes)) or chosen[-1])
    r = random.Random(4)
    if kind.startswith("long texts"):
        rows = [(i, " ".join(f"u{i // 2}x{k}" for k in range(40)) + (" end" if i % 2 else "")) for i in range(60)]
    else:
        rows = [(i, " ".join(r.choice("abc") for _ in range(r.choice([6, 7, 8])))) for i in range(300)]
    if kind.startswith("long lists"):
        monkeypatch.setattr(jaccard, "LIST", 20)
        monkeypatch.setattr(jaccard, "LIGHT_MAX", 0)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(x)[:4] for x in ngram_jaccard(spark, df).collect()) == brute(rows)
    assert chosen[0] > 3 if kind.startswith("many") else chosen[0] == 0


def test_components_of_a_hub_a_chain_and_loops(spark):
    from sessionloom.llm.components import connected_components

    edges = [(1000, k) for k in range(1, 300)] + [(k, k + 1) for k in range(2000, 2050)] + [(5000, 5000), (1, 2), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    want = {k: 1 for k in [*range(1, 300), 1000]} | {k: 2000 for k in range(2000, 2051)} | {5000: 5000}
    assert got == want


def test_a_very_long_text_and_its_near_copy(spark):
    r = random.Random(6)
    words = [f"w{r.randrange(9000)}" for _ in range(120_000)]
    near = [w if k % 50 else "new" for k, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, "short text of its own"), (4, " ".join(words[:40_000]))]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, copies int")
    got = sorted(tuple(x)[:4] for x in ngram_jaccard(spark, df).collect())
    sets = {i: {*zip(w, w[1:], w[2:])} for i, w in ((i, t.split()) for i, t in rows)}
    assert got == [(1, len(sets[1]), 1, 1), (2, len(sets[2]), 1, 1), (3, 3, 0, 3), (4, len(sets[4]), 0, 4)]


HELD = """
import re, resource
import numpy as np, pyarrow as pa
from sessionloom.llm import jaccard, repeats
own = lambda: int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
top = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
r = np.random.default_rng(5)
def batches(n, words=200):
    for k in range(n):
        data = r.integers(97, 123, (1000 * words, 6), dtype=np.uint8)
        data[:, 5] = 32
        off = np.arange(1001, dtype=np.int32) * (6 * words)
        text = pa.Array.from_buffers(pa.string(), 1000, [None, pa.py_buffer(off), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1000) + 1000 * k), text], ["doc_id", "text"])
run = {"scan": jaccard._scan(3, 5), "postings": jaccard._postings(3, 5, (b"", b"")), "anchors": repeats._anchors(repeats.Kind(True, 5, 2), 5)}[KIND]
sum(b.nbytes for b in run(batches(1)))
low, high = own(), top()
sum(b.nbytes for b in run(batches(17)))
print(own() - low, top() - high)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
@pytest.mark.parametrize("kind", ["scan", "postings", "anchors"])
def test_a_task_gives_its_memory_back(kind):
    """Workers live on between tasks, so what a task held would stay in an executor's memory through other stages."""
    said = subprocess.run([sys.executable, "-c", HELD.replace("KIND", repr(kind))], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True, timeout=120)
    kept, peak = map(float, said.stdout.split())
    assert kept < 10 and peak < 110
