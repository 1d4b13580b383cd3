"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Trees are fitted on the driver, on about `max_train` labelled rows at most (a hash of the id
draws them); everything is scored. Null and empty texts have statistics of zero and get a score
too. Labels that are null or whose row is held out are not learned from; an id with several
labels counts as its mean. Without any label the score is 0.5. Input columns other than id
and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import learners as L
from tidemark.llm.shared import materialise, small


def held_out(column: str, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves `fold`; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def _measure(batches):
    for batch in batches:
        rows = L.statistics(batch.column("text").to_pylist())
        flat = pa.array(rows.ravel(), pa.float32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), flat)], names=["doc_id", "stats"])


def _scored(model: dict):
    def run(batches):
        for batch in batches:
            x = np.array(batch.column("stats").to_pylist(), np.float32).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(L.score_trees(model, x), pa.float64())], names=["doc_id", "score"])

    return run


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stats of each row, written to the shared folder."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(docs.mapInArrow(_measure, "doc_id long, stats array<float>"), "statistics")


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, max_train: int = 20_000) -> DataFrame:
    """doc_id, held_out, score of each row of docs (doc_id, text); labels (doc_id, quality)."""
    stats = measured(docs)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out("doc_id", folds, fold)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("quality"))
    # A hash of the id draws the rows: a sorted limit would send max_train rows of each task to the driver.
    share = min(1.0, max_train / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # The drawn ids are few whatever the input: statistics are not shuffled to meet them.
    train = stats.join(small(drawn), "doc_id").toPandas().sort_values("doc_id", ignore_index=True)
    x = np.array(train["stats"].tolist(), np.float32).reshape(len(train), -1) if len(train) else np.zeros((0, 1), np.float32)
    model = L.fit_trees(x, (train["quality"].to_numpy(float) >= 0.5).astype(float))
    return stats.mapInArrow(_scored(model), "doc_id long, score double").select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score")
