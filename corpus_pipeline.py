"""A corpus pipeline: quality filter, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents. An
empty text is left to the quality filter; a document that loses all lines stays, with an
empty text. An id stands for one document: a stage that rejects it drops all rows of it. A row
with a null id is never dropped. Tables that a stage writes on its way are removed after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, lines, mixing, neardup, quality
from tidemark.llm.queries import TARGETS, domain_labels
from tidemark.llm.shared import materialise, scratch, small, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3; scores are learned from labelled rows outside the held-out fold."""
    bad = quality.score_quality(docs, table(spark, sf_dir, "labels")).where("score < 0.3").select("doc_id").distinct()
    return docs.join(small(materialise(bad, "rejected")), "doc_id", "left_anti").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines in later occurrences of three-line windows; n_chars is counted anew."""
    return lines.dedup_lines(docs, carry=("lang", "source")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near-duplicates (five words, similarity of 0.8 or more)."""
    gone = neardup.near_duplicates(docs, words=5, part=80, whole=100).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(small(materialise(gone, "copies")), "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A rate for each document, so that expected tokens of the labelled domains meet their target shares."""
    return mixing.mix_sources(docs, domain_labels(spark, sf_dir), TARGETS)


STAGES = [("quality", filter_quality), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontamination", drop_contaminated), ("mixing", mix)]

#: Training a classifier and fitting rates cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = materialise(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
