"""MinHash near-duplicates by an LSH forest.

Texts with equal shingle sets form one class, and only one document of each class goes on.
Its signature is one byte of each of TREES * DEPTH min-hashes. In each tree the documents
with the same `MIN_PREFIX` bytes, at a place of the tree's own, form a region, and all pairs
of a region are candidates. In a region of at most `CROWD` members pairs whose signatures are
far too unlike are dropped (over four standard deviations), the rest are confirmed on the
full sets.

A larger region is a crowd. Its depth adapts: members go on by the bytes that follow the prefix
to pieces of about `PIECE` members, sorted, so that those of the longest common prefix stand
together; all pairs of a piece are compared on full sets. That links most of a crowd, but not
surely all: a second step looks for links between members of crowds that are still in different
components. Two sets at the threshold share one of their rarest shingles: each set sends as many
of its rarest shingles as such a pair needs, those that meet (and whose sizes and places allow
the threshold) are compared on full sets. Shingles that occur in one component alone send
nothing, so a group of copies that is linked already costs no pairs, however large it is.

A pair at similarity s meets in no tree with probability (1 - s**4)**16, in crowds as
elsewhere: under 1e-5 at 0.85, 2.2e-4 at 0.80.

Null texts and texts without words have an empty set and are linked with nothing. A null id
is linked with nothing either, its component is null. Rows that repeat an id are one
document. Input columns other than id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.shared import BROADCAST_ROWS, lookup, materialise, small

TREES, DEPTH, MIN_PREFIX = 16, 6, 4
#: Members of a region that are compared by signature first; members of a piece of a crowd, about and at most; bytes of its sets.
CROWD, PIECE, REGION, REGION_BYTES = 32, 512, 1024, 64 << 20
#: How far an estimate may lie below the threshold before the pair is dropped.
SLACK = 0.19
#: Shingles that are told apart by how many sets have them; the others are about equally rare.
FREQUENT = 50_000


def _signed(words: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at, part in K.slices(texts):
                sets = K.shingle_sets(part, words)
                sig = K.sketch(sets, TREES * DEPTH)
                keys = [K.mix(s).sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(K.mix(s + np.uint64(7))).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig"])

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at, part in K.slices(texts):
                sets = K.shingle_sets(part, words)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(part)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    return run


def regions(batches, keys: int):
    """Runs of sorted rows that are equal in the first `keys` columns: the other columns as lists. A run is cut at REGION rows or REGION_BYTES of binary values. Single rows have no pairs and are left out."""
    held: list[tuple] = []
    size = 0

    def take():
        return [list(c) for c in zip(*(r[keys:] for r in held), strict=True)]

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and (row[:keys] != held[0][:keys] or len(held) >= REGION or size >= REGION_BYTES):
                if len(held) > 1:
                    yield take()
                held, size = [], 0
            held.append(row)
            size += sum(len(v) for v in row[keys:] if isinstance(v, bytes))
    if len(held) > 1:
        yield take()


def _pairs(batches_of):
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in batches_of], pa.int64()), pa.array([p[1] for p in batches_of], pa.int64())], names=["a", "b"])


def _candidates(least: float):
    """Pairs (a < b) to confirm, of regions that are no crowds."""

    def run(batches):
        out: set[tuple] = set()
        for ids, sigs in regions(batches, 2):
            sig = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(ids), -1)
            for i in range(len(ids) - 1):
                for j in np.flatnonzero((sig[i + 1 :] == sig[i]).mean(1) >= least) + i + 1:
                    if ids[i] != ids[j]:
                        out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
            if len(out) > 50_000:
                yield _pairs(list(out))
                out.clear()
        yield _pairs(list(out))

    return run


def _confirmed(part: int, whole: int):
    def run(batches):
        for batch in batches:
            out = []
            for a, b, x, y in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "x", "y")], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and whole * both >= part * (len(x) + len(y) - both):
                    out.append((a, b))
            yield _pairs(out)

    return run


def overlaps(sets: list[np.ndarray], dense: int = 32) -> np.ndarray:
    """How many values each two sets share. Values of over `dense` sets are counted by matrix products, the rarer ones pair by pair."""
    n = len(sets)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(code, kind="stable")
    owner, held = owner[order], count[code[order]]
    both = np.zeros(n * n, np.int64)
    for c in range(2, dense + 1):
        rows = owner[held == c].reshape(-1, c)
        for at in range(0, len(rows), max(1, 1_000_000 // (c * c))):
            part = rows[at : at + max(1, 1_000_000 // (c * c))]
            both += np.bincount((part[:, :, None] * n + part[:, None, :]).ravel(), minlength=n * n)
    both = both.reshape(n, n).astype(np.float64)
    often = held > dense
    owner, new = owner[often], np.cumsum(np.diff(code[order][often], prepend=-1) != 0) - 1
    for low in range(0, int(new[-1]) + 1 if len(new) else 0, 4096):
        a, b = np.searchsorted(new, (low, low + 4096))
        x = np.zeros((n, min(4096, int(new[-1]) + 1 - low)), np.float32)
        x[owner[a:b], new[a:b] - low] = 1
        both += x @ x.T
    return both.astype(np.int64)


def _crowd_links(part: int, whole: int):
    """All pairs of a piece on full sets; a link from each member to the first one of its component."""

    def run(batches):
        for ids, raw in regions(batches, 3):
            sets = [np.frombuffer(s, np.uint64) for s in raw]
            n, size, both = len(ids), np.array([len(s) for s in sets]), overlaps(sets)
            linked = (both > 0) & (whole * both >= part * (size[:, None] + size[None, :] - both))
            left, out = np.ones(n, bool), []
            for i in range(n):
                if left[i]:
                    new = np.zeros(n, bool)
                    new[i] = True
                    seen = new.copy()
                    while new.any():
                        new = linked[new].any(0) & ~seen
                        seen |= new
                    left &= ~seen
                    out += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in np.flatnonzero(seen).tolist() if ids[j] != ids[i]]
            yield _pairs(out)

    return run


def _forest(reps: DataFrame) -> DataFrame:
    """tree, prefix, order (the signature as the tree reads it), id: each row once for each tree."""
    rows = reps.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
    order = F.concat(F.expr(f"substring(sig, tree * {DEPTH} + 1)"), F.expr(f"substring(sig, 1, tree * {DEPTH})"))
    return rows.select("tree", F.expr(f"substring(sig, tree * {DEPTH} + 1, {MIN_PREFIX})").alias("prefix"), order.alias("order"), "id")


def _piece() -> Column:
    """The piece of a member (order) of a crowd of `members`: by the bytes that follow the prefix."""
    return F.pmod(F.xxhash64(F.expr(f"substring(order, {MIN_PREFIX + 1}, 2)")), F.ceil(F.col("members") / PIECE)).cast("int")


def _counted(batches):
    """How many sets of this batch have each shingle."""
    for batch in batches:
        sets = [np.frombuffer(s, np.uint64) for s in batch.column("shingles").to_pylist()]
        gram, n = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], names=["gram", "n"])


def _rarest(frequent: np.ndarray, part: int, whole: int):
    """The rarest shingles of each set: as many as a pair at the threshold needs to share one. `frequent` are shingles in order of frequency; all others come before them, in order of value.

    Of the larger set of a pair (or of equal ones, the later) all these count, of the smaller one only those `indexed`.
    """
    known = np.sort(frequent)
    rank = np.argsort(frequent, kind="stable")

    def run(batches):
        for batch in batches:
            rows = []
            for id_, comp, raw in zip(*[batch.column(c).to_pylist() for c in ("id", "comp", "shingles")], strict=True):
                s = np.frombuffer(raw, np.uint64)
                at = np.minimum(np.searchsorted(known, s), max(0, len(known) - 1))
                often = known[at] == s if len(known) else np.zeros(len(s), bool)
                later = s[often][np.argsort(rank[at[often]], kind="stable")]
                n = len(s)
                probe, index = n - -(-part * n // whole) + 1, n - -(-2 * part * n // (part + whole)) + 1
                first = np.concatenate((s[~often], later))[:probe]
                rows.append((first, np.full(len(first), id_), np.full(len(first), comp), np.full(len(first), n), np.arange(len(first)), np.arange(len(first)) < index))
            cols = [np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64) for i in range(6)]
            cols[0], cols[5] = cols[0].view(np.int64), cols[5].astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["gram", "id", "comp", "n", "at", "indexed"])

    return run


def links_between(sets: DataFrame, comps: DataFrame, part: int, whole: int) -> DataFrame | None:
    """All links (a, b) between rows of sets (id, shingles) whose components (comps: id, comp; ids without one are their own) differ; None if there can be none."""
    own = sets.join(comps, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"), "shingles")
    counts = materialise(sets.select("shingles").mapInArrow(_counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "shingle-counts")
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    often = counts.where(F.col("n") > max(32, total // FREQUENT)).collect()
    frequent = np.array([r.gram for r in sorted(often, key=lambda r: (r.n, r.gram))], np.int64).view(np.uint64)
    rows = materialise(own.mapInArrow(_rarest(frequent, part, whole), "gram long, id long, comp long, n long, at long, indexed boolean"), "rarest-shingles")
    # Shingles of one component alone are done with. In the others, pairs inside the component with most rows are left out.
    by_comp = rows.groupBy("gram", "comp").agg(F.count("*").alias("n"))
    mixed = by_comp.groupBy("gram").agg(F.max(F.struct("n", "comp")).comp.alias("top"), F.count("*").alias("comps"), F.sum("n").alias("n"))
    mixed = materialise(mixed.where("comps > 1").select("gram", "top", "n"), "mixed-shingles")
    if mixed.isEmpty():
        return None
    rows = materialise(lookup(rows, mixed, "gram", rows.count()), "meeting-shingles")
    y = rows.where("indexed").select("gram", *[F.col(c).alias(f"y_{c}") for c in ("id", "comp", "n", "at", "top")])
    smaller = "(y_n < n OR y_n = n AND y_id < id)"
    enough = f"{whole} * y_n >= {part} * n AND {part + whole} * (1 + least(n - at - 1, y_n - y_at - 1)) >= {part} * (n + y_n)"
    meet = lambda x, y: x.join(y, "gram").where(f"comp <> y_comp AND {smaller} AND {enough}").select(F.col("id").alias("a"), F.col("y_id").alias("b"))
    found = meet(rows.where("comp <> top"), y).unionByName(meet(rows.where("comp = top"), y.where("y_comp <> y_top")))
    return confirm(materialise(found.distinct(), "late-candidates"), sets, part, whole)


def confirm(pairs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """Those of pairs (a, b) that reach the threshold on sets (id, shingles). Rows that repeat an id are one document, with the union of its links."""
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return pairs.select("a", "b", "x", "y").mapInArrow(_confirmed(part, whole), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, comp (the least id reachable) of each id in links (a, b). Large-star and small-star steps until nothing changes; the rows of a hot id are not moved to one task."""

    def to_least(rows: DataFrame, n_rows: int) -> DataFrame:
        """rows (a, b) with m, the least b of a."""
        least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        return rows.join(F.broadcast(least.drop("n")), "a") if n_rows <= BROADCAST_ROWS else lookup(rows, materialise(least, "least"), "a", n_rows)

    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before, n = None, edges.count()
    while n:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = to_least(both, 2 * n).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        # `large` has no more rows than edges, and its rows point from greater to lesser ids.
        large = materialise(large, "links") if 2 * n > BROADCAST_ROWS else large
        star = to_least(large, n).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(large.groupBy("a").agg(F.min("b").alias("b"))).where("a <> b").distinct()
        edges = materialise(star, "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before, n = now, now.n
    return edges.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "id")


def near_duplicates(docs: DataFrame, words: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text): documents are linked if whole * intersection >= part * union of their sets of shingles of `words` words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = materialise(docs.mapInArrow(_signed(words), "doc_id long, n_shingles long, set_key binary, sig binary"), "signatures")
    linkable = base.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialise(linkable.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.count("*").alias("n")), "classes")
    forest = _forest(classes.select("id", "sig"))
    crowds = small(materialise(forest.groupBy("tree", "prefix").agg(F.count("*").alias("members")).where(F.col("members") > CROWD), "crowds"))
    few = forest.join(crowds, ["tree", "prefix"], "left_anti").repartition("tree", "prefix").sortWithinPartitions("tree", "prefix", "id")
    pairs = materialise(few.select("tree", "prefix", "id", "order").mapInArrow(_candidates(part / whole - SLACK), "a long, b long").distinct(), "candidates")
    crowded = materialise(forest.join(crowds, ["tree", "prefix"]).select("tree", "prefix", _piece().alias("piece"), "order", "id"), "crowded")
    crowd = crowded.select("id").distinct()
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowd).distinct(), "wanted")
    texts = docs.withColumnRenamed("doc_id", "id").join(small(wanted), "id", "left_semi")
    sets = materialise(texts.mapInArrow(_sets(words), "id long, shingles binary").where(F.octet_length("shingles") > 0), "shingles")
    links = confirm(pairs, sets, part, whole)
    anyone = not crowded.isEmpty()
    if anyone:
        pieces = crowded.join(sets, "id").repartition("tree", "prefix", "piece").sortWithinPartitions("tree", "prefix", "piece", "order", "id")
        links = links.unionByName(pieces.select("tree", "prefix", "piece", "id", "shingles").mapInArrow(_crowd_links(part, whole), "a long, b long"))
    found = materialise(components(links), "components")
    if anyone:
        late = links_between(sets.join(crowd, "id", "left_semi"), found, part, whole)
        if late is not None:
            found = materialise(components(late.unionByName(found.select(F.col("id").alias("a"), F.col("comp").alias("b")))), "components")
    known = materialise(classes.join(found, "id", "left").select("set_key", "n", F.coalesce("comp", "id").alias("component_id")), "members")
    rows = base.select("doc_id", "n_shingles", "set_key")
    joined = lookup(rows.where("n_shingles > 0 AND doc_id IS NOT NULL"), known, "set_key", linkable.count()).select("doc_id", "n_shingles", "component_id")
    return joined.unionByName(rows.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
