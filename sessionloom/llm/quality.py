"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, and what counts as a symbol.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
#: Function words of the languages at hand, in lower case.
STOP_WORDS = tuple(
    "the of and to in is a that for was it with as on be by this are or from at which der die und den von zu das ist mit im ein eine sich auf nicht "
    "le la de que et les des en un une est du pour dans qui pas sur au el los y se del las por con para su no".split()
)
#: Words in a window that is looked for again in its text.
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A text fails when low * n > 100 * value or 100 * value > high * n, in a text of ``least`` words or more.

    ``value`` and ``n`` name columns of counts; thresholds are in hundredths.
    """

    name: str
    value: str
    n: str
    low: int | None = None
    high: int | None = None
    least: int = 0

    def spark(self, c: dict[str, Column]) -> Column:
        bad = F.lit(False)
        if self.low is not None:
            bad = bad | (c[self.value] * 100 < c[self.n] * self.low)
        if self.high is not None:
            bad = bad | (c[self.value] * 100 > c[self.n] * self.high)
        return bad & (c["n_words"] >= self.least) if self.least else bad

    def sql(self) -> str:
        bad = [f"{self.value} * 100 < {self.n} * {self.low}"] * (self.low is not None) + [f"{self.value} * 100 > {self.n} * {self.high}"] * (self.high is not None)
        return f"(({' OR '.join(bad)}) AND n_words >= {self.least})"


#: The base rules of every text, then the others.
MIN_WORDS, MAX_REPEAT = 10, 20
RULES = (
    Rule("word length", "word_chars", "n_words", low=200, high=1200),
    Rule("symbols a word", "n_symbols", "n_words", high=20),
    Rule("exclamation marks a word", "n_exclaim", "n_words", high=30),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=50),
    Rule("stop words", "n_stop", "n_words", low=3, least=30),
)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, inside one expression."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _repeat_words(w: Column) -> Column:
    """Words in windows found twice or more: the windows' hashes are sorted with their places, never paired."""
    def covered(h: Column) -> Column:
        def spread(places: Column) -> Column:
            gaps = F.transform(places, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.try_element_at(places, i + 2) - x, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        def twice(s: Column) -> Column:
            same = lambda e, i: (F.try_element_at(s, i + 2)["h"] == e["h"]) | ((i > 0) & (F.get(s, i - 1)["h"] == e["h"]))
            return F.sort_array(F.transform(F.filter(s, lambda e, i: F.coalesce(same(e, i), F.lit(False))), lambda e: e["i"]))

        marked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(marked, twice), spread))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(w[i + k] for k in range(WINDOW))))
    return F.when(F.size(w) < WINDOW + 1, F.lit(0)).otherwise(let(hashes, covered))


def quality_measures(text: Column) -> Column:
    """A struct of the counts that rules use; a null text counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def lines(x: Column) -> list[Column]:
        full = F.filter(F.split(x, "\n"), lambda y: F.length(F.trim(y, F.lit(SPACE))) > 0)
        return let(full, lambda y: F.struct(F.size(y).cast("long").alias("n_lines"), (F.size(y) - F.size(F.array_distinct(y))).cast("long").alias("n_dup_lines")))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        )

    length = F.length(text).cast("long")
    return F.struct(
        let(_words(text), of_words).alias("w"),
        lines(text).alias("l"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        (length - F.length(F.translate(text, "!", ""))).alias("n_exclaim"),
    )


def _flat(m: Column) -> dict[str, Column]:
    return {c: m["w"][c] for c in ("n_words", "n_repeat_words", "n_stop")} | {c: m["l"][c] for c in ("n_lines", "n_dup_lines")} | {c: m[c] for c in ("word_chars", "n_symbols", "n_exclaim")}


def _verdicts(flat: dict[str, Column], rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    base = (flat["n_words"] < MIN_WORDS) | (flat["n_repeat_words"] * 100 > flat["n_words"] * MAX_REPEAT)
    failed = base
    for r in rules:
        failed = failed | r.spark(flat)
    return base, ~failed


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    # one expression: a filter on columns of a struct would compute the struct for each of them
    return docs.where(let(quality_measures(F.col("text")), lambda m: _verdicts(_flat(m), rules)[1]))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, then further counts.

    ``base_failed``: under 10 words, or more than 20 % of the words lie in
    five-word windows found again in the text.  ``kept`` is false for those and
    for texts that break a rule of the table.  One row per row of the input;
    null and empty texts have counts of 0 and are not kept; a null doc_id stays
    null.  Other columns are ignored.
    """
    m = docs.select("doc_id", quality_measures(F.col("text")).alias("m"))
    flat = _flat(F.col("m"))
    base, kept = _verdicts(flat, rules)
    return m.select("doc_id", *(flat[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base.alias("base_failed"), kept.alias("kept"), *(flat[c].alias(c) for c in ("n_lines", "n_stop", "n_exclaim")))


def quality_sql(source: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB's SQL."""
    word = "'[^\\x20\\x09-\\x0D]+'"
    space = " || ".join(f"chr({ord(c)})" for c in SPACE)
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {word}) AS ws FROM {source}),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) AS r FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM dup) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(translate(t, {space}, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclaim,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {word})) AS ls,
  CAST(len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop FROM d),
c AS (SELECT m.*, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT} AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR {' OR '.join(r.sql() for r in rules)}) AS kept, n_lines, n_stop, n_exclaim FROM b"""
