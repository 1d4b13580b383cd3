"""Line dedup by overlapping three-line windows, with DataFrame functions only.

Each run of `window` consecutive lines is hashed (two 64-bit hashes). A window that occurs
more than once in the corpus keeps its first place, the least (doc_id, line); every later
occurrence is covered, covered lines are merged and removed.

Null text is empty; an empty text is one empty line. A text of fewer than `window` lines has
no window and stays as it is. Rows with a null id take part in nothing and stay whole, each
of them. Rows that repeat an id are texts of their own: lines are addressed by id, row key
and place, and the row key is a hash of the row where an id is repeated. Of rows that are
equal in all columns the later ones are later occurrences of the first. Each row of the
input is a row of the output. Input columns other than id, text and carried ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import materialise, small


def line_windows(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, row_key, at (first line, from 0), h1, h2 of each window of each text."""
    lines = F.col("lines")
    parts = [F.get(lines, F.col("at") + i) for i in range(window)]
    spots = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "row_key", F.split("text", "\n").alias("lines")).where(F.size("lines") >= window)
    spots = spots.select("doc_id", "row_key", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - window)).alias("at"))
    return spots.select("doc_id", "row_key", "at", F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, d, copies (how many equal rows) of docs (doc_id, d) without null ids. Few ids are repeated, so the key is 0 but for them."""
    repeated = materialise(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("again")), "repeated-ids")
    key = F.when(F.col("again"), F.xxhash64(F.to_json("d"))).otherwise(F.lit(0).cast("long"))
    docs = docs.join(small(repeated), "doc_id", "left").select("doc_id", key.alias("row_key"), "d")
    return docs.groupBy("doc_id", "row_key").agg(F.min("d").alias("d"), F.count("*").alias("copies"))


def dedup_lines(docs: DataFrame, window: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_lines, n_removed and the columns `carry` of each row of docs (doc_id, text); text has the kept lines."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carry).alias("d"))
    lines = F.split("text", "\n")
    n_lines = F.size(lines).cast("long")
    whole = docs.where("doc_id IS NULL").select("doc_id", "d.*").select("doc_id", "text", *carry, n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    docs = _keyed(docs.where("doc_id IS NOT NULL")).select("doc_id", "row_key", "copies", "d.*")
    spots = line_windows(docs, window)
    # Partial sums leave one row for each window and task, so a line that is everywhere stays cheap;
    # the written table lets Spark split a hot window in the join that follows.
    place = F.struct("doc_id", "row_key", "at")
    repeated = spots.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    repeated = materialise(repeated, "line-windows")
    later = spots.join(repeated, ["h1", "h2"]).where(place != F.col("first")).select("doc_id", "row_key", "at")
    covered = later.groupBy("doc_id", "row_key").agg(F.collect_set("at").alias("starts"))
    spread = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + window - 1)))
    joined = docs.join(covered.select("doc_id", "row_key", spread.alias("gone")), ["doc_id", "row_key"], "left")
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    # All windows of a further copy are later occurrences, and they cover all its lines.
    copied = (F.col("copy") > 1) & (n_lines >= window)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(copied, F.lit("")).when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    removed = F.when(copied, n_lines).when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct("gone")))
    return joined.select("doc_id", text.alias("text"), *carry, n_lines.alias("n_lines"), removed.cast("long").alias("n_removed")).unionByName(whole)


ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i+1] || chr(10) || ls[i+2] AS k FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM d WHERE len(ls) >= 3)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM later, (SELECT unnest([0, 1, 2]) AS o)),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d)
SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id
"""
