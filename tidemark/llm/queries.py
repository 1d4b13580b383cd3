"""The registered queries of the operators in this package, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, fingerprints, language, lines, mixing, neardup, pages, quality, substrings, tokens
from tidemark.llm.shared import table

#: Where the public tokenizer files are; fixed outside the repository.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Shares of expected tokens for each domain (quality and toxicity as labelled).
TARGETS = {"q1t0": 0.70, "q1t1": 0.05, "q0t0": 0.20, "q0t1": 0.05}


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"), keep=lambda text: F.sha2(text, 256))
    return out.withColumnRenamed("edited", "edited_sha256")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_language(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is counted; then its middle is overwritten and two characters are inserted a quarter in."""
    docs, n = table(spark, sf_dir, "documents"), F.length(F.coalesce("text", F.lit("")))
    edits = F.array(
        F.struct(F.floor(n / 2).cast("int").alias("at"), F.lit(20).alias("size"), F.lit(" edit 12, x").alias("new")),
        F.struct(F.floor(n / 4).cast("int").alias("at"), F.lit(0).alias("size"), F.lit("yz").alias("new")),
    )
    return tokens.count_tokens(docs.select("doc_id", "text", edits.alias("edits")), RANKS)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), domain_labels(spark, sf_dir), TARGETS)


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("domain"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_duplicates(table(spark, sf_dir, "documents"), words=5, part=85, whole=100)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_fingerprints, op2_language, op3_html, op4_token_counts, op5_substrings, op6_decontamination, op7_lines, op8_quality, op9_mixing, op10_neardup]
    return {f.__name__: f for f in found}


WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS f FROM w) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM later, (SELECT unnest(range(13)) AS o)),
l AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
k AS (SELECT l.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY l.i) FILTER (WHERE gone.i IS NULL) AS kept FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS to_id FROM d UNION SELECT r.doc_id, g.b FROM r JOIN g ON g.a = r.to_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM d JOIN (SELECT doc_id, min(to_id) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_substrings": SUBSTRINGS, "op6_decontamination": decontaminate.ORACLE, "op7_lines": lines.ORACLE, "op10_neardup": NEAR}
