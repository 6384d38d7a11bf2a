"""The pipeline against brute-force versions of its stages, each on its own input."""

import random

import pytest
from test_dedup import brute_bytes
from test_jaccard import brute as brute_groups
from test_quality import brute as brute_quality

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    vocab = ["the", "of", "and", "in", "is"] * 80 + [f"w{k}" for k in range(900)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    leak, shared = text(30), text(60)
    rows = [(i, text(r.randint(40, 150)), "en", "hot" if i % 3 else f"s{i}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1] + (" more" if i % 2 else ""), "en", "hot", 0) for i in range(8)]
    rows += [(200 + i, text(40) + " " + shared + " " + text(40), None, None, None) for i in range(4)]
    rows += [(300, text(50) + " " + leak + " " + text(50), "en", "x", 1), (301, "same " * 300, "en", "x", 1), (302, None, "en", "x", 1), (303, "", "en", "x", 1), (304, "a### b### " * 40, "en", "x", 1), (None, text(80), "en", "x", 1)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(7, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == cp.COLUMNS
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            after = {r.doc_id: r.text for r in docs.collect()}
            seen.append(name)
        if k == 0:
            assert set(after) == {i for i, t in before.items() if i is not None and not brute_quality(t)[5] and "#" not in t}
        elif k == 1:
            assert set(after) == {i for i, _, _, c in brute_groups(list(before.items())) if i == c}
        elif k == 2:
            want = {i: n - gone for i, n, gone, *_ in brute_bytes(list(before.items()), 100)}
            assert {i: len(t.encode()) for i, t in after.items()} == {i: n for i, n in want.items() if n}
        elif k == 3:
            assert set(before) - set(after) == {300}
        else:
            words = {i: len(t.split()) for i, t in before.items()}
            used = {}
            for r in out.collect():
                used[r.doc_id] = used.get(r.doc_id, 0) + r.length
            assert used == words
    assert len(seen) == 4


def test_run(spark, folder):
    got = cp.run(spark, folder)
    assert got.count() > 50 and 300 not in {r.doc_id for r in got.collect()}


def test_no_rows(spark, tmp_path):
    for t, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_rows_that_repeat_a_doc_id_with_another_text(spark, folder):
    """Each is judged by itself: a copy and a leak go, what else bears their id stays."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 20")
    texts = {r.doc_id: r.text for r in docs.collect()}
    leak = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    own = " ".join(f"own{k}" for k in range(70))
    extra = [(900, texts[3], "en", "x", 1), (900, own, "en", "x", 1), (901, own[::-1] + " " + leak, "en", "x", 1), (901, own[::-1], "en", "x", 1), (902, texts[4], "en", "x", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).repartition(3)
    kept = [(r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, folder).collect()]
    assert sum(t == texts[3] for _, t in kept) == 1 and (900, own) in kept and (4, texts[4]) in kept and 902 not in {i for i, _ in kept}
    clean = [(r.doc_id, r.text) for r in cp.benchmark_leaks(spark, docs, folder).collect()]
    assert (901, own[::-1]) in clean and (901, own[::-1] + " " + leak) not in clean and len(clean) == docs.count() - 1
