"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Words are maximal runs of letters and digits, lower-cased. Fixed masks read six words of a
span and ignore the others; the two default masks together hit every run of 13 words in
which at most two are substituted. An item of fewer words than that (but no fewer than a mask)
has masks of its own, which read every third of its words: two substitutions leave one of the
three untouched. The hashes of all spans of the benchmark are joined to those of all documents. Around each hit the item and the document are compared word by word
on the hit's diagonal, and a document is contaminated by an item if some `window` words
(the whole item if it is shorter) agree in all but `substitutions` of them.

Null texts are empty. Items of fewer than ten words (shorter than a mask) must occur whole,
without substitutions. Rows with a null id are left out. Repeated rows count once. Input
columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import materialise, small

#: Bits of the filter before the join.
BITS = 1 << 20
MASKS = ("110100111", "1001101011")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _let(value: Column, use) -> Column:
    """use(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _seed(ws: Column, at: Column, k: int, mask: str) -> Column:
    return F.xxhash64(*[F.get(ws, at + j) for j, c in enumerate(mask) if c == "1"], F.lit(k))


def _each(ws: Column, length: int, hashed) -> Column:
    """(at, seed) of each run of `length` word hashes; hashed(at) is the seed."""
    spots = F.transform(F.sequence(F.lit(0), F.size(ws) - length), lambda i: F.struct(i.alias("at"), hashed(i).alias("seed")))
    return F.when(F.size(ws) >= length, spots).otherwise(F.array().cast("array<struct<at:int,seed:bigint>>"))


def _spans(ws: Column, masks: Sequence[str]) -> Column:
    """All masked spans of word hashes: an array of (at, seed)."""

    def of(k: int, mask: str) -> Column:
        return _each(ws, len(mask), lambda i: _seed(ws, i, k, mask))

    return F.concat(*[of(k, mask) for k, mask in enumerate(masks)])


def _bitmap(hashes: DataFrame):
    """A test for one-column hashes, by a bit for each value modulo BITS: what fails it is not among them. Its size does not depend on the benchmark."""
    (name,) = hashes.columns
    rows = hashes.select(F.pmod(name, F.lit(BITS)).alias("at")).groupBy((F.shiftright("at", 5)).alias("k")).agg(F.bit_or(F.expr("shiftleft(1, cast(at & 31 as int))")).alias("v")).collect()
    found = {r.k: r.v for r in rows}
    # One string that Spark folds into an array: a literal of many columns is slow to build.
    bits = F.split(F.lit(",".join(str(found.get(k, 0)) for k in range(BITS // 32))), ",").cast("array<int>")

    def test(h: Column) -> Column:
        at = F.pmod(h, F.lit(BITS)).cast("int")
        return F.getbit(F.get(bits, F.shiftright(at, 5)), at.bitwiseAND(F.lit(31))) == 1

    return test


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: Sequence[str] = MASKS, window: int = 13, substitutions: int = 2) -> DataFrame:
    """doc_id, item_id, n_words (most equal words in a window), span (its length) of each contaminated document and item."""
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), _hash_words_of("text").alias("item"))
    items = materialise(items.where(F.size("item") > 0).distinct(), "benchmark-words")
    size, longest = F.size("item"), max(map(len, masks))
    whole = items.where(size >= longest).select("item_id", F.explode(_spans(F.col("item"), masks)).alias("s")).select("item_id", "s.at", "s.seed")
    # Items shorter than a mask: all their words in a row. Items shorter than a window: every third word (in general, one more than substitutions).
    step = substitutions + 1
    sparse = lambda ws, at, n, r: F.xxhash64(*[F.get(ws, at + j) for j in range(r, n, step)], F.lit(-1 - r), F.lit(n))
    lengths = sorted(r.n for r in items.where(size < window).select(size.alias("n")).distinct().collect())
    whole = whole.select("seed", "item_id", F.col("at").alias("item_at"))
    for n in lengths:
        some = items.where(size == n)
        seeds = [F.xxhash64("item")] if n < longest else [sparse(F.col("item"), F.lit(0), n, r) for r in range(step)]
        whole = whole.unionByName(some.select(F.explode(F.array(*seeds)).alias("seed"), "item_id", F.lit(0).alias("item_at")))
    own = materialise(whole.distinct(), "benchmark-seeds")
    maybe = _bitmap(own.select("seed"))
    pairs = F.transform(F.sequence(F.lit(0), size - 2), lambda i: F.xxhash64(F.get("item", i), F.get("item", i + 1)))
    pair = _bitmap(items.where(size >= longest).select(F.explode(pairs).alias("h")))

    def seeds(ws: Column) -> Column:
        """The seeds of one document that pass. Both ends of a mask's first pair of neighbours must be neighbours in the benchmark."""
        n = F.size(ws)
        near = F.when(n >= 2, F.filter(F.sequence(F.lit(0), n - 2), lambda i: pair(F.xxhash64(F.get(ws, i), F.get(ws, i + 1))))).otherwise(F.array().cast("array<int>"))
        return _let(near, lambda spots: F.filter(F.concat(*[masked(ws, spots, k, m) for k, m in enumerate(masks)], *[x for n in lengths for x in run(ws, n)]), lambda s: s.seed.isNotNull() & maybe(s.seed)))

    def masked(ws: Column, spots: Column, k: int, mask: str) -> Column:
        lead = mask.index("11")
        return F.transform(spots, lambda b: F.struct((b - lead).alias("at"), F.when((b >= lead) & (b - lead + len(mask) <= F.size(ws)), _seed(ws, b - lead, k, mask)).alias("seed")))

    def run(ws: Column, n: int) -> list[Column]:
        if n < longest:
            return [_each(ws, n, lambda i: F.xxhash64(F.slice(ws, i + 1, n)))]
        return [_each(ws, n, lambda i, r=r: sparse(ws, i, n, r)) for r in range(step)]

    # The outer explode does not make Spark evaluate the array a second time to filter on its size.
    found = docs.select("doc_id", F.explode_outer(_let(_hash_words_of("text"), seeds)).alias("s")).where("s IS NOT NULL").select("doc_id", "s.at", "s.seed").join(small(own), "seed")
    hits = materialise(found.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "benchmark-hits")
    # On a diagonal the whole item is compared, so hits on one diagonal all say the same.
    # (_let: Spark would otherwise put the words' whole expression into the inner function and run it for every word.)
    pairs = docs.join(small(hits), "doc_id").join(small(items), "item_id")

    def equal(ws: Column) -> Column:
        at = lambda j: F.when(j + F.col("shift") >= 0, F.get(ws, j + F.col("shift")))
        return F.transform("item", lambda w, j: F.when(at(j) == w, 1).otherwise(0))

    def best(eq: Column) -> Column:
        span = F.least(size, F.lit(window))
        return F.array_max(F.transform(F.sequence(F.lit(0), size - span), lambda s: F.aggregate(F.slice(eq, s + 1, span), F.lit(0), lambda a, x: a + x)))

    agree = _let(_let(_hash_words_of("text"), equal), best)
    pairs = pairs.select("doc_id", "item_id", F.least(size, F.lit(window)).alias("span"), agree.alias("n_words"))
    # An item shorter than a mask was found whole, and may not have substitutions.
    least = F.when(F.col("span") < longest, F.col("span")).otherwise(F.col("span") - substitutions)
    pairs = pairs.where(F.col("n_words") >= least)
    return pairs.groupBy("doc_id", "item_id").agg(F.max("n_words").cast("long").alias("n_words"), F.max("span").cast("long").alias("span"))


def _hash_words_of(column: str) -> Column:
    return F.transform(words(F.col(column)), lambda w: F.xxhash64(w))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs whose text overlaps with no benchmark item; rows with a null id stay."""
    found = materialise(contaminated(docs, benchmark, **how).select("doc_id").distinct(), "contaminated")
    return docs.join(small(found), "doc_id", "left_anti")


ORACLE = """
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM documents WHERE doc_id IS NOT NULL),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM benchmark WHERE item_id IS NOT NULL),
bi AS (SELECT item_id, len(ws) AS n, least(len(ws), 13) AS span, unnest(range(len(ws))) AS j, unnest(ws) AS w FROM bw),
di AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM dw),
e AS (SELECT DISTINCT di.doc_id, bi.item_id, bi.span, bi.n, di.i - bi.j AS shift, bi.j FROM di JOIN bi ON di.w = bi.w),
s AS (SELECT doc_id, item_id, span, n, j, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) AS c FROM e)
SELECT doc_id, item_id, max(c) AS n_words, max(span) AS span FROM s GROUP BY doc_id, item_id HAVING max(c) >= max(span) - CASE WHEN max(span) < 10 THEN 0 ELSE 2 END
"""
