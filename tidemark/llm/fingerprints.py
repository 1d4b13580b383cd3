"""Order MinHash document fingerprints, with DataFrame functions only.

A text is its words `[^\\x20\\x09-\\x0D]+`; its k-mers are runs of k words (fewer words: the
whole sequence is one). Equal k-mers of a text are told apart by their occurrence number.
Each of `POSITIONS` independent hash functions orders the pairs of a text anew (one 64-bit hash
gives two of them: its upper and its lower bits); the two least pairs are selected, put back in
text order and hashed together. So a position agrees between two texts if the same two k-mers
were selected and stand in the same order: moves and swaps count as well as changes, as they do
in edit distance. All k-mers take part in every position, whatever the length of the text. A
fingerprint has four hexadecimal digits for each position.

The pairs are exploded, and the minima are plain aggregates inside generated code: one pass for
the least of each position, one for the second least. Both keep the partitioning of the texts,
so neither shuffles.

A text with a single k-mer has no order to show: its positions hold that k-mer alone. Null and
empty texts, and texts without words, have `----` in all positions; their likeness is 1 to each
other and 0 to others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import lookup, materialise, small

#: Stands for a null id while rows are sorted and joined.
NO_ID = -(1 << 63)
#: Hash functions, two to a hash.
POSITIONS = 32
#: The low bits of a rank hold the place of its k-mer (an array has fewer than 2^31 elements), the upper ones come from the hash.
PLACE_BITS = 31
PLACE = (1 << PLACE_BITS) - 1


def _numbered(df: DataFrame, text: str, k: int) -> DataFrame:
    """df with __values (a hash of each k-mer and its occurrence number) and __places (where each stands; null: in text order)."""
    own = df.columns
    df = df.select(*own, F.btrim(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r")).alias("__text"))
    words = F.when(F.col("__text") == "", F.array().cast("array<string>")).otherwise(F.split("__text", "[\\x20\\x09-\\x0D]+"))
    df = df.select(*own, F.transform(words, lambda w: F.xxhash64(w)).alias("__ws"))
    n = F.size("__ws")
    grams = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[F.get("__ws", i + j) for j in range(k)]))
    df = df.select(*own, F.when(n > 0, grams).otherwise(F.array().cast("array<bigint>")).alias("__grams"))
    # Only texts that repeat a k-mer are sorted, to number its occurrences.
    again = F.size(F.array_distinct("__grams")) < F.size("__grams")
    df = df.select(*own, "__grams", F.when(again, F.sort_array(F.transform("__grams", lambda x, i: F.struct(x.alias("gram"), i.alias("at"))))).alias("__items"))
    of = lambda i: F.get("__items", i).gram
    starts = F.filter(F.sequence(F.lit(0), F.size("__items") - 1), lambda i: (i == 0) | (of(i) != of(F.greatest(i - 1, F.lit(0)))))
    df = df.select(*own, "__grams", "__items", F.when(F.col("__items").isNotNull(), starts).alias("__starts"))
    runs = F.transform("__starts", lambda s, j: F.sequence(F.lit(0), F.coalesce(F.get("__starts", j + 1), F.size("__items")) - s - 1))
    df = df.select(*own, "__grams", "__items", F.flatten(runs).alias("__occs"))
    values = F.zip_with("__items", "__occs", lambda item, occ: F.when(occ == 0, item.gram).otherwise(F.xxhash64(item.gram, occ)))
    return df.select(*own, F.coalesce(values, F.col("__grams")).alias("__values"), F.transform("__items", lambda item: item.at).alias("__places"))


def _ranks() -> list[Column]:
    """The rank of a row (value, at) under each hash function, with its place in the low bits; null without a k-mer."""
    out = []
    for i in range(POSITIONS // 2):
        h = F.xxhash64(F.col("value").bitwiseXOR(F.lit((i + 1) * 0x9E3779B97F4A7C15 % (1 << 63))))
        out += [h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(F.col("at")), F.shiftleft(h, 32).bitwiseOR(F.col("at"))]
    return out


def _spots(texts: DataFrame, key: str, k: int, *more: str) -> DataFrame:
    """key, the columns `more`, value and at (place) of each k-mer of a text; texts without words keep one row of nulls."""
    rows = _numbered(texts.select(key, *more, F.col("text").alias("__t")), "__t", k).select(key, *more, "__places", F.posexplode_outer("__values").alias("__i", "value"))
    return rows.select(key, *more, "value", F.coalesce(F.get("__places", F.col("__i")), F.col("__i")).cast("long").alias("at"))


def fingerprints(texts: DataFrame, key: str, k: int = 3) -> DataFrame:
    """key, fp (an int for each position, -1 where the text has no word) of texts (key, text), which have one row for each key."""
    names = [f"v{i}" for i in range(POSITIONS)]
    least = _spots(texts, key, k).groupBy(key).agg(*[F.min(r).alias(v) for r, v in zip(_ranks(), names, strict=True)]).select(key, F.array(*names).alias("least"))
    again = _spots(texts.select(key, "text").join(least, key), key, k, "least").groupBy(key, "least")
    second = again.agg(*[F.min(F.when(r > F.get("least", F.lit(i)), r)).alias(v) for i, (r, v) in enumerate(zip(_ranks(), names, strict=True))])
    upper, place = (lambda x: F.shiftright(x, PLACE_BITS)), (lambda x: x.bitwiseAND(F.lit(PLACE)))

    def digit(a: Column, b: Column) -> Column:
        pair = F.when(b.isNull(), F.xxhash64(upper(a))).when(place(a) < place(b), F.xxhash64(upper(a), upper(b))).otherwise(F.xxhash64(upper(b), upper(a)))
        return F.when(a.isNull(), F.lit(-1)).otherwise(pair.bitwiseAND(F.lit(0xFFFF)).cast("int"))

    # A lambda, once for each text: as columns these would make the aggregate's generated method too long.
    return second.select(key, F.zip_with("least", F.array(*names), digit).alias("fp"))


def digits(fp: Column) -> Column:
    """A fingerprint as a string."""
    return F.array_join(F.transform(fp, lambda v: F.when(v < 0, F.lit("----")).otherwise(F.lower(F.lpad(F.hex(v), 4, "0")))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal positions: 1 for two texts without words, 0 if only one has none."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.size(a)


def successors(ids: DataFrame) -> DataFrame:
    """k, next (the next lower k; the highest for the last), and the other columns of ids (k, distinct and without nulls).

    Keys are sorted in ranges; only one row for each range meets in one task.
    """
    ranged = materialise(ids.repartitionByRange(F.desc("k")).withColumn("range", F.spark_partition_id()), "ranges")
    within = ranged.withColumn("after", F.lead("k").over(W.partitionBy("range").orderBy(F.desc("k"))))
    heads = ranged.groupBy("range").agg(F.max("k").alias("head"))
    order = W.partitionBy(F.lit(0)).orderBy("range")
    heads = heads.select("range", F.lead("head").over(order).alias("head"), F.max("head").over(W.partitionBy(F.lit(0))).alias("top"))
    return within.join(F.broadcast(heads), "range").withColumn("next", F.coalesce("after", "head", "top")).drop("range", "after", "head", "top")


def fingerprint_edits(docs: DataFrame, k: int = 3, keep: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """Each document's fingerprint, and that of its text with the last third replaced by the beginning of the next document.

    Columns: doc_id, n_chars, edited (the text, or what `keep` makes of it), fingerprint, edited_fingerprint, near_edited,
    near_next. The next document is the one of the next lower id, of several rows of that id the least text. Each row has
    its fingerprints, also those that repeat an id. Null ids come last (the least long is reserved for them). A single
    document is its own next. Input columns other than id and text are ignored.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = materialise(successors(docs.groupBy("k").agg((F.floor(F.max(F.length("text")) / 3)).cast("int").alias("third"), F.count("*").alias("n"))), "order")
    # One row for each id, the least text; all that follows shares its shuffle.
    least = docs.groupBy("k").agg(F.min("text").alias("text"))
    # The next document sends no more than the beginning that its predecessor needs.
    head = F.substring("text", F.lit(1), F.col("third")).alias("head")
    edited = _edited(least.join(least.withColumnRenamed("k", "next").join(order.select("k", "next", "third"), "next").select("k", head), "k"))
    whole = edited.select("k", "n_chars", keep(F.col("edited")).alias("edited"))
    made = materialise(whole.join(fingerprints(least, "k", k), "k").join(_fingerprints_of_edited(edited, "k", k), "k"), "fingerprints")
    next_fp = made.select(F.col("k").alias("next"), F.col("fp").alias("next_fp"))
    out = _result(made.join(order.where("n = 1").select("k", "next").join(next_fp, "next").drop("next"), "k"))
    # Rows of repeated and null ids: each different text of an id is one row until the end.
    several = materialise(order.where("n > 1"), "repeated-ids")
    total = several.agg(F.sum("n").alias("n")).first().n
    if not total:
        return out
    nexts = docs.withColumnRenamed("k", "next").join(small(several.select("next")), "next", "left_semi").groupBy("next").agg(F.min("text").alias("text"))
    nexts = materialise(nexts.join(several, "next").select("k", "next", "n", head).join(next_fp, "next").drop("next"), "next-documents")
    rows = lookup(docs, several.select("k", "n"), "k", total).groupBy("k", "text").agg(F.count("*").alias("copies"))
    rows = materialise(_edited(lookup(rows, nexts, "k", total)).withColumn("row", F.xxhash64("k", "text")), "repeated-texts")
    rows = rows.join(fingerprints(rows, "row", k), "row").join(_fingerprints_of_edited(rows, "row", k), "row").withColumn("edited", keep(F.col("edited")))
    return out.unionByName(_result(rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))))


def _edited(both: DataFrame) -> DataFrame:
    """both with n_chars and edited, from text and head."""
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    return both.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring("text", F.lit(1), n - cut), F.substring("head", F.lit(1), cut))})


def _fingerprints_of_edited(rows: DataFrame, key: str, k: int) -> DataFrame:
    return fingerprints(rows.select(key, F.col("edited").alias("text")), key, k).withColumnRenamed("fp", "edited_fp")


def _result(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.nullif("k", F.lit(NO_ID)).alias("doc_id"), "n_chars", "edited", digits(F.col("fp")).alias("fingerprint"), digits(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
