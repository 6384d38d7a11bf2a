import random
import re
from collections import Counter

import duckdb
import pandas as pd

from sessionloom.llm.quality import quality_rules, quality_sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cov = set()
    for i in range(len(w) - 4):
        if win[tuple(w[i : i + 5])] > 1:
            cov.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cov), len(w) < 10 or 100 * len(cov) > 20 * len(w)


def texts():
    r = random.Random(4)
    v = ["the", "of", "a", "é", "words", "x#", "|", "und", "😀", "THE!!"]
    out = [None, "", " ", "\n\t", "one", "the of and to in is a that for was", "a " * 4, "a " * 5, "a " * 6, "  lead and trail \n", "x\n\n x\nx\n", "w w   z\x0bq"]
    out += [r.choice([" ", "\n"]).join(r.choice(v) for _ in range(r.choice([5, 9, 10, 30, 200]))) for _ in range(40)]
    return out + ["\n".join(f"line {i} of this text the" for i in range(40)), "long " + " ".join(f"w{i}" for i in range(30000)) + " the"]


def test_against_brute_force_and_sql(spark):
    rows = [(i, t, i) for i, t in enumerate(texts())]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).toPandas().sort_values("doc_id")
    for r, (_, t, _) in zip(got.itertuples(), rows):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "n"])  # noqa: F841
    want = duckdb.sql(quality_sql()).df().sort_values("doc_id")
    assert [tuple(x) for x in want[list(got.columns)].itertuples(index=False)] == [tuple(x) for x in got.itertuples(index=False)]


def test_verdicts(spark):
    clean = "the rain of the day came and it was seen by all who stood in a row near the old mill that week. " * 1 + " ".join(f"also w{i} the day" for i in range(20))
    junk = " ".join(f"w{i}### the" for i in range(40))
    rows = [(1, clean), (2, junk), (3, "Same " * 100), (4, " ".join(f"Foo{i}!!" for i in range(50))), (None, clean)]
    got = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, None: True}
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []
