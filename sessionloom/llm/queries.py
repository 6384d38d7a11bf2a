"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .quality import quality_sql

#: The rank file that counts chat tokens; the query fails where it is missing, as its windows would differ.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import ngram_jaccard

    return ngram_jaccard(spark, _read(spark, sf_dir, "documents"))


def op2_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import ppm_scores

    return ppm_scores(spark, _read(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract_main_text

    return extract_main_text(spark, _read(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dedup import substring_dedup

    return substring_dedup(spark, _read(spark, sf_dir, "documents")).drop("kept")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_windows, read_back

    hard = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    return read_back(chat_windows(spark, rows, tokenizer=TOKENIZER))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dedup import suffix_array_dedup

    return suffix_array_dedup(spark, _read(spark, sf_dir, "documents")).drop("kept")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_packing

    return best_fit_packing(spark, _read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_ppm_scores": op2_ppm_scores,
    "op3_html_extraction": op3_html_extraction,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
}

_WORD = "'[^\\x20\\x09-\\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The documented results in DuckDB's SQL, where it can say them over whole tables.
SQL: dict[str, str] = {
    "op1_ngram_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3) UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 70 * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v, same FROM l UNION ALL SELECT b, a, same FROM l),
r(node, root) AS (SELECT u, u FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node),
c AS (SELECT node, min(root) AS comp FROM r GROUP BY node),
k AS (SELECT u, count(*) AS k, count(*) FILTER (WHERE same) AS same FROM e GROUP BY u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(k, 0) AS n_similar, coalesce(comp, d.doc_id) AS component_id, 1 + coalesce(same, 0) AS copies
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id LEFT JOIN k ON k.u = d.doc_id""",
    "op4_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
st AS (SELECT win.doc_id, i FROM win JOIN f USING (h) WHERE m < win.doc_id),
wd AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
cov AS (SELECT wd.doc_id, j, x, coalesce(max(i) OVER (PARTITION BY wd.doc_id ORDER BY j ROWS UNBOUNDED PRECEDING) >= j - 49, FALSE) AS gone FROM wd LEFT JOIN st ON st.doc_id = wd.doc_id AND st.i = j),
t AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(x, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM cov GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)""",
    "op10_quality_rules": quality_sql(),
}
