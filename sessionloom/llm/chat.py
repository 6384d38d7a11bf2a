"""Chat formatting in budgeted windows.

Conversations become windows of whole turns.  Prefix sums of the turns' tokens
give, by binary search, the furthest turn that fits the budget beside the
system turn and a limited repeated history.  Repeated turns are context only:
the loss mask covers each assistant text once.

A window does not cross a multiple of ``STRETCH`` turns.  So a conversation of any
length is worked on in stretches, with the system turn and the last turns before the
stretch copied to it, and no task holds more than a stretch.  Turns are numbered in
their order, whatever numbers they bear: those of conversations longer than a stretch
by partitions of a range, whose sizes are summed.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import groupby
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import exchange as ex

#: Turns after which a window begins anew.
STRETCH = 4096
#: Bytes of a tokenizer's rank file at most: it is broadcast.
RANK_BYTES = 64 << 20
#: Tokens of a window; tokens and turns of history that it repeats.
BUDGET, HISTORY, HISTORY_TURNS = 1024, 256, 4


@dataclass(frozen=True)
class Template:
    """Marks of a turn, and strings that are escaped inside texts."""

    begin: str = "<s>"
    role_open: str = "[ROLE]"
    role_close: str = "[/ROLE]"
    end: str = "</s>"
    others: tuple[str, ...] = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.role_open, self.role_close, self.end, *self.others)

    def escape(self, text: str) -> str:
        """Backslashes doubled, and one put inside each control string."""
        text = text.replace("\\", "\\\\")
        return re.sub("|".join(re.escape(c) for c in sorted(self.controls, key=len, reverse=True)), lambda m: m[0][0] + "\\" + m[0][1:], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def turn(self, role: str, text: str) -> tuple[str, int, int]:
        """The turn, and where its text begins and ends in it."""
        head = f"{self.begin}{self.role_open}{self.escape(role)}{self.role_close}"
        body = self.escape(text)
        return head + body + self.end, len(head), len(head) + len(body)

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of the turns of a formatted window."""
        shape = re.compile(re.escape(self.begin + self.role_open) + "(.*?)" + re.escape(self.role_close) + "(.*?)" + re.escape(self.end), re.S)
        turns, at = [], 0
        while at < len(formatted):
            m = shape.match(formatted, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            turns.append((self.unescape(m[1]), self.unescape(m[2])))
            at = m.end()
        return turns


def counter(ranks: bytes | None):
    """Tokens of a text by the content of a tokenizer's rank file, else a token for four bytes."""
    if ranks is None:
        return lambda text: -(-len(text.encode()) // 4)
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def windows(turns: list[tuple[int, str, str]], count, template: Template, budget: int, history: int, history_turns: int, system_role: str, target_role: str) -> list[dict]:
    """Windows of a stretch; ``turns``: (0 copied system turn, 1 copied history, 2 own turn; role; text)."""
    made = [template.turn(r, t) for _, r, t in turns]
    tokens = [count(m[0]) for m in made]
    prefix = [0]
    for n in tokens:
        prefix.append(prefix[-1] + n)
    own = next((i for i, t in enumerate(turns) if t[0] == 2), len(turns))
    system = 0 if turns and turns[0][1] == system_role and turns[0][0] in (0, 2) and (turns[0][0] == 0 or own == 0) else None
    out, i = [], own
    while i < len(turns):
        lead = [system] if system is not None and i > system else []
        room = budget - sum(tokens[k] for k in lead)
        # the history: the latest turns before i within its limits, and not so many that turn i finds no room
        least = tokens[i]
        limit = min(history, max(0, room - least))
        first = min(i, max(i - history_turns, 0 if system is None else system + 1))
        while first < i and prefix[i] - prefix[first] > limit:
            first += 1
        room -= prefix[i] - prefix[first]
        j = max(i + 1, bisect_right(prefix, prefix[i] + room) - 1)
        chosen = [*lead, *range(first, j)]
        text, spans = "", []
        for k in chosen:
            whole, a, b = made[k]
            if k >= i and turns[k][1] == target_role and b > a:
                spans.append((len(text) + a, len(text) + b))
            text += whole
        out.append({"text": text, "n_repeated": len(chosen) - (j - i), "n_new": j - i, "n_tokens": sum(tokens[k] for k in chosen), "loss": spans})
        i = j
    return out


_OUT = pa.schema([("conv_id", pa.int64()), ("stretch", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("n_repeated", pa.int32()), ("n_new", pa.int32()), ("n_tokens", pa.int64()), ("loss", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])
OUT = "conv_id long, stretch long, window long, text string, n_repeated int, n_new int, n_tokens long, loss array<struct<begin:long,end:long>>"


def _rows(batches, names):
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names))


_counters: list = []


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``n``, their number in their conversation from 0, without gathering a conversation."""
    start = F.substring("text", 1, 64)  # a range of whole texts would send these to the driver
    parts = ex.cut(rows.repartitionByRange("conv_id", "turn", "role", start).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("conv_id", "part").agg(F.count("*").alias("size"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    mine = F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*order))
    return parts.withColumn("mine", mine).join(sizes, ["conv_id", "part"]).select("conv_id", *order, (F.col("before") + F.col("mine") - 1).alias("n"))


def chat_windows(spark, conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS, tokenizer: str | None = None, template: Template = Template(), system_role: str = "system", target_role: str = "assistant") -> DataFrame:
    """conv_id, stretch, window, text, n_repeated, n_new, n_tokens, loss: formatted windows of turns.

    Each turn is new in one window; ``n_repeated`` turns stand before the
    ``n_new`` ones: the system turn and history.  ``loss`` gives spans of code
    points of ``text``: the escaped texts of new turns of ``target_role``.  A window
    stays within ``budget`` tokens unless a single turn (beside the system turn) is
    larger, and does not cross a multiple of ``STRETCH`` turns.  ``tokenizer`` is the
    path of a rank file, which the driver reads; without one, four bytes count as a
    token.

    Turns are ordered by turn (null first), then role, then text; null roles and
    texts count as empty; repeated rows are turns.  Rows with a null conv_id are
    left out.  Only a conversation's first turn is its system turn.  Other columns
    are ignored.
    """
    ex.prepare(spark)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["turn", "role", "text"]
    long = ex.cut(rows.groupBy("conv_id").agg(F.count("*").alias("turns")).where(F.col("turns") > STRETCH))
    short = rows.withColumn("stretch", F.lit(0).cast("long")).withColumn("kind", F.lit(2))
    every, n_long = short, long.count()
    if n_long:
        few = F.broadcast(long) if n_long <= ex.BROADCAST_ROWS else long
        many = ex.cut(_numbered(rows.join(few.select("conv_id"), "conv_id", "left_semi"), order)).join(few, "conv_id")
        last = F.floor((F.col("turns") - 1) / STRETCH)
        many = many.withColumn("stretch", F.floor(F.col("n") / STRETCH)).withColumn("kind", F.lit(2))
        again = many.where((F.pmod("n", F.lit(STRETCH)) >= STRETCH - history_turns) & (F.col("stretch") < last)).withColumn("stretch", F.col("stretch") + 1).withColumn("kind", F.lit(1))
        heads = many.where((F.col("n") == 0) & (F.col("role") == system_role)).withColumn("stretch", F.explode(F.sequence(F.lit(1).cast("long"), last))).withColumn("kind", F.lit(0))
        every = ex.anti(short, long.select("conv_id"), "conv_id", n_long)
        for part in (many, again, heads):
            every = every.unionByName(part.select(*every.columns))
    if tokenizer is not None and Path(tokenizer).stat().st_size > RANK_BYTES:
        raise ValueError(f"{tokenizer} is too large to be broadcast")
    ranks = spark.sparkContext.broadcast(None if tokenizer is None else Path(tokenizer).read_bytes())

    def run(batches):
        if not _counters or _counters[0] != ranks.value:
            _counters[:] = [ranks.value, counter(ranks.value)]
        held = []
        for (conv, stretch), g in groupby(_rows(batches, ["conv_id", "stretch", "kind", "role", "text"]), key=lambda r: r[:2]):
            turns = [r[2:] for r in g]
            for w, x in enumerate(windows(turns, _counters[1], template, budget, history, history_turns, system_role, target_role)):
                held.append({"conv_id": conv, "stretch": stretch, "window": w, **x, "loss": [{"begin": a, "end": b} for a, b in x["loss"]]})
            if len(held) >= 500:
                yield pa.RecordBatch.from_pylist(held, _OUT)
                held = []
        yield pa.RecordBatch.from_pylist(held, _OUT)

    return every.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "kind", "turn", "role", "text").mapInArrow(run, OUT)


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows, from formatted windows.

    A conversation's windows stream past a running digest, so its length does not
    matter to memory.
    """
    def run(batches):
        for conv, g in groupby(_rows(batches, ["conv_id", "text", "n_repeated", "loss"]), key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n, loss_chars, chars, n_windows = 0, 0, 0, 0
            for _, text, repeated, spans in g:
                n_windows, chars = n_windows + 1, chars + len(text)
                for role, t in template.parse(text)[repeated:]:
                    n += 1
                    turns.update(f"{role}\n{t}\n".encode())
                for s in spans:
                    t = template.unescape(text[s["begin"] : s["end"]])
                    loss_chars += len(t)
                    loss.update(t.encode())
            yield ex.batch({"conv_id": pa.array([conv], pa.int64()), "n_turns": pa.array([n], pa.int64()), "turns_sha256": [turns.hexdigest()], "loss_chars": pa.array([loss_chars], pa.int64()), "loss_sha256": [loss.hexdigest()], "formatted_chars": pa.array([chars], pa.int64()), "n_windows": pa.array([n_windows], pa.int64())})

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "window").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
