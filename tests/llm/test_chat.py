import hashlib
import os
import random

import pytest

from sessionloom.llm import chat

ROLES = ["user", "assistant", "tool\n", "", None]
BITS = ["</s>", "[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "[ROLE]", "[/ROLE]x", "word", "é\U0001f600", "\n", "", "<|im_end|>", "[\\ROLE]"]


def conversations():
    r = random.Random(2)
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    for c in range(12):
        n = r.choice([1, 2, 5, 30])
        for t in range(n):
            role = "system" if t == 0 and c % 2 else r.choice(ROLES)
            rows.append((c, t, role, r.choice([None, " ".join(r.choice(BITS) for _ in range(r.choice([0, 3, 12, 60])))])))
    for t in range(40):  # longer than two stretches
        rows.append((50, t, "system" if t == 0 else ["user", "assistant"][t % 2], f"text {t} " * r.choice([1, 5])))
    rows += [(60, None, "user", "no turn"), (60, 0, "user", "tie b"), (60, 0, "user", "tie a"), (60, 0, "user", "tie a"), (None, 0, "user", "x")]
    return rows


def brute(rows):
    out = {}
    for c in {r[0] for r in rows if r[0] is not None}:
        mine = sorted(((-1 if t is None else t, role or "", x or "") for k, t, role, x in rows if k == c))
        loss = "".join(x for _, role, x in mine if role == "assistant")
        out[c] = (len(mine), hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in mine).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("stretch,budget", [(4096, 60), (8, 90), (16, 20)])
def test_round_trip_and_budget(spark, monkeypatch, stretch, budget):
    monkeypatch.setattr(chat, "STRETCH", stretch)
    rows = conversations()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int").repartition(3)
    formatted = chat.chat_windows(spark, df, budget=budget, history=15)
    got = chat.read_back(formatted).collect()
    assert {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in got} == brute(rows)
    repeated = 0
    for w in formatted.collect():
        turns = chat.Template().parse(w.text)
        assert len(turns) == w.n_repeated + w.n_new
        assert w.n_tokens <= budget or w.n_new == 1
        repeated += w.n_repeated
        if w.conv_id == 50:
            assert turns[0] == ("system", next(x for c, t, _, x in rows if (c, t) == (50, 0)))
    assert repeated


def test_escape_is_reversible_and_leaves_no_control():
    r, t = random.Random(3), chat.Template()
    for _ in range(500):
        s = "".join(r.choice(BITS + list("<s>/[]\\|I")) for _ in range(r.randint(0, 9)))
        e = t.escape(s)
        assert t.unescape(e) == s and not any(c in e for c in t.controls)


def test_tokenizer_and_no_rows(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if os.path.exists(path):
        assert chat.counter(open(path, "rb").read())("the cat sat on the mat") == 6
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.chat_windows(spark, df)).collect() == []


def test_windows_do_not_depend_on_the_numbers_of_turns(spark, monkeypatch, tmp_path):
    """Dense, sparse and huge numbers, and null ones, by role and text; several stretches and partitions."""
    monkeypatch.setattr(chat, "STRETCH", 8)
    base = [(t, "system" if t == 0 else ["user", "assistant"][t % 2], f"text {t:03} " * (1 + t % 4)) for t in range(45)]
    made = {}
    for name, number in (("dense", lambda t: t), ("sparse", lambda t: 60_000 * t), ("huge", lambda t: (1 << 60) + 977 * t)):
        df = spark.createDataFrame([(c, number(t), role, text) for c in (1, 2) for t, role, text in base] + [(3, 5, "user", "alone")], "conv_id long, turn long, role string, text string").repartition(5)
        made[name] = sorted(tuple(x) for x in chat.chat_windows(spark, df, budget=60, history=15).collect())
    assert made["dense"] == made["sparse"] == made["huge"]
    assert len({x[1] for x in made["dense"] if x[0] == 1}) == 6 and any(x[4] for x in made["dense"])
    for name, number in (("one number", 7), ("no number", None)):
        rows = [(1, number, role, text) for _, role, text in base] * 2
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
        windows = chat.chat_windows(spark, df, budget=60, history=15)
        assert max(x.n_new for x in windows.collect()) <= 8
        assert [(x.n_turns, x.turns_sha256) for x in chat.read_back(windows).collect()] == [brute(rows)[1][:2]], name


def test_a_missing_tokenizer_is_an_error(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    with pytest.raises(FileNotFoundError):
        chat.chat_windows(spark, df, tokenizer="/nowhere/ranks")
