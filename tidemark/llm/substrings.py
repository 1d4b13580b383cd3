"""Substring dedup by level-wise doubling.

Windows are judged at growing lengths, each twice the one before, up to the length that
decides (7, then 13 words by default). At the first length every text contributes only the
windows that are the minimum of some longer window, so that equal longer windows always share
one. A window that occurs in one document alone drops out; only longer windows around survivors
are hashed at the next length, until none survive or the last length is reached. It decides: a
word goes if a window over it also starts in a document with a smaller id. The last length
compares 128 bits of hash, those before it, which only choose candidates, 64.

Rows move as packed arrays keyed by hash bucket. Each map slice sends one entry for each
distinct window (the smallest id it saw), so a passage that a third of all documents share
costs one entry for each slice. The number of buckets and of document parts follows the bytes
of the input, so that none of them grows with it. Nothing is sampled or capped.

Null text is empty. Rows with a null id keep all words, are compared with nothing and are dealt
out by their text. Repeated rows of one id do not remove each other's words. Input columns other
than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.shared import materialise, partitions

BLOB = "bucket int, part int, payload binary"
#: Bytes of text in one part, about.
PART_BYTES = 64 << 20


def doubling(first: int, length: int) -> tuple[int, ...]:
    """first, twice that, and so on; the last is length."""
    out = [first]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return tuple(out)


def _part(n: int):
    """The document partition of an id, alike in Spark and numpy."""
    return lambda ids: np.mod(ids ^ (ids >> 7) ^ (ids >> 19), n).astype(np.int64)


def _pair(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One hash for a window in a document. h: a row for each window, with one column or two."""
    return K.mix(h ^ K.mix(ids.astype(np.uint64) + np.uint64(1))[:, None])


def _hashes(h: np.ndarray, offs: np.ndarray, length: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of `length` words as rows of hashes (two at the last length), the text and the start of each."""
    one, text, start = K.windows(h, offs, length)
    return np.stack((one, K.windows(h, offs, length, K.OTHER_STEP)[0]), 1) if last else one[:, None], text, start


def _least_within(h: np.ndarray, start: np.ndarray, length: int, below: int) -> np.ndarray:
    """The least hash of the windows of `below` words in each window of `length` words, one column."""
    if not len(start):
        return np.zeros((0, 1), np.uint64)
    whole, _, _ = K.windows(h, np.array([0, len(h)]), below)
    return K.sliding_min(whole, length - below + 1)[start][:, None]


def _sorted(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """h and ids in order of both, and where a new window begins."""
    order = np.lexsort((ids, *h.T[::-1]))
    h, ids = h[order], ids[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]).any(1)
    return h, ids, new


def _emit(h: np.ndarray, ids: np.ndarray, n: int, last: bool):
    """Rows of BLOB for windows h of documents ids: one entry for each distinct window goes to its bucket, what is decided already goes on to the documents."""
    h, ids, new = _sorted(h, ids)
    fresh = new.copy()
    fresh[1:] |= ids[1:] != ids[:-1]
    h, ids, new = h[fresh], ids[fresh], new[fresh]
    if not len(h):
        return
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    settled = ~new if last else size[group] > 1
    table, local = np.unique(ids[new], return_inverse=True)
    bucket = (h[new][:, 0] % np.uint64(n)).astype(np.int64)
    for b, rows in _groups(bucket):
        used, index = np.unique(local[rows], return_inverse=True)
        head = np.array([len(used), len(rows)], np.int64).tobytes()
        yield b, -1, head + table[used].tobytes() + h[new][rows].tobytes() + index.astype(np.uint32 if len(used) > 65535 else np.uint16).tobytes()
    keys, parts = _pair(h[settled], ids[settled]), _part(n)(ids[settled])
    for p, rows in _groups(parts):
        yield p, p, keys[rows].tobytes()


def _groups(key: np.ndarray):
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(key[order])) + 1
    for rows in np.split(order, cut) if len(order) else []:
        yield int(key[rows[0]]), rows


def _batch(rows, names: tuple[str, ...] = ("bucket", "part", "payload")) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "part": pa.int32(), "payload": pa.binary()}
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[n]) for i, n in enumerate(names)], names=list(names))


def _texts(batch) -> tuple[np.ndarray, list]:
    """Ids and texts of the rows with an id."""
    ids = batch.column("doc_id")
    keep = np.asarray(ids.is_valid())
    texts = batch.column("text").to_pylist()
    values = np.asarray(ids.fill_null(0), np.int64)
    return values[keep], [t for t, k in zip(texts, keep, strict=True) if k]


def _first_level(n: int, length: int, above: int):
    def run(batches):
        for batch in batches:
            ids, texts = _texts(batch)
            for at, part in K.slices(texts):
                h, offs = K.word_hashes(part)
                _, text, start = K.windows(h, offs, above)
                yield _batch(_emit(_least_within(h, start, above, length), ids[at + text], n, False))

    return run


def _next_level(n: int, length: int, below: int, last: bool):
    """Documents and their surviving windows of `below` words: the windows of `length` words around them."""

    def run(key, docs: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        alive = _survivors(found, 1)
        if len(alive):
            for batch in docs.to_batches():
                ids, texts = _texts(batch)
                for at, part in K.slices(texts):
                    h, offs = K.word_hashes(part)
                    hashes, text, start = _hashes(h, offs, length, last)
                    keep = _isin(_pair(_least_within(h, start, length, below), ids[at + text]), alive)
                    out.append(_batch(_emit(hashes[keep], ids[at + text[keep]], n, last)))
        return pa.Table.from_batches(out, schema=_batch([]).schema)

    return run


def _survivors(found: pa.Table, width: int) -> np.ndarray:
    x = np.frombuffer(b"".join(found.column("payload").to_pylist()), np.uint64).reshape(-1, width)
    if width == 1:
        return np.unique(x[:, 0])[:, None]
    x = x[np.lexsort(x.T[::-1])]
    return x[np.concatenate(([True], (x[1:] != x[:-1]).any(1)))] if len(x) else x


def _isin(x: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Which rows of x are among the sorted rows `alive`."""
    out = np.zeros(len(x), bool)
    if not len(alive):
        return out
    at = np.searchsorted(alive[:, 0], x[:, 0])
    most = int(np.diff(np.flatnonzero(np.concatenate(([True], alive[1:, 0] != alive[:-1, 0], [True])))).max())
    for step in range(most):  # more than one only where two windows share their first hash
        out |= (alive[np.minimum(at + step, len(alive) - 1)] == x).all(1)
    return out


def _decide(n: int, last: bool):
    """One bucket: windows in several documents go on; at the last length, all of them but those of the smallest id."""
    width = 2 if last else 1

    def run(table: pa.Table) -> pa.Table:
        hs, ids, rows = [], [], []
        for part, payload in zip(table.column("part").to_pylist(), table.column("payload").to_pylist(), strict=True):
            if part >= 0:
                rows.append((part, payload))
                continue
            n_ids, n_rows = np.frombuffer(payload, np.int64, 2)
            at = 16 + 8 * n_ids
            known = np.frombuffer(payload, np.int64, n_ids, 16)
            hs.append(np.frombuffer(payload, np.uint64, n_rows * width, at).reshape(-1, width))
            ids.append(known[np.frombuffer(payload, np.uint32 if n_ids > 65535 else np.uint16, n_rows, at + 8 * n_rows * width)])
        if hs:
            h, i, new = _sorted(np.concatenate(hs), np.concatenate(ids))
            group = np.cumsum(new) - 1
            least = i[new][group]
            if last:
                keep = i > least
            else:
                most = i[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(i) - 1]))][group]
                keep = most > least
            keys, parts = _pair(h[keep], i[keep]), _part(n)(i[keep])
            rows += [(p, keys[r].tobytes()) for p, r in _groups(parts)]
        merged: dict[int, list[bytes]] = {}
        for p, payload in rows:
            merged.setdefault(p, []).append(payload)
        return pa.Table.from_batches([_batch([(p, b"".join(x)) for p, x in merged.items()], ("part", "payload"))])

    return run


def _remove(length: int):
    """Each text without its words that a removed window covers."""

    def run(key, docs: pa.Table, found: pa.Table) -> pa.Table:
        gone = _survivors(found, 2)
        out = []
        for batch in docs.to_batches():
            ids, known = np.asarray(batch.column("doc_id").fill_null(0), np.int64), np.asarray(batch.column("doc_id").is_valid())
            texts = batch.column("text").to_pylist()
            for at, part in K.slices(texts):
                h, offs = K.word_hashes(part)
                cover = np.zeros(len(h) + 1, np.int64)
                if len(gone):
                    hashes, text, start = _hashes(h, offs, length, True)
                    hit = _isin(_pair(hashes, ids[at + text]), gone) & known[at + text]
                    np.add.at(cover, start[hit], 1)
                    np.subtract.at(cover, start[hit] + length, 1)
                covered = np.cumsum(cover)[:-1] > 0
                kept, removed = [], []
                for i, t in enumerate(part):
                    own = covered[offs[i] : offs[i + 1]]
                    words = K.words(t)
                    removed.append(int(own.sum()))
                    kept.append(" ".join([w for w, c in zip(words, own.tolist(), strict=True) if not c] if removed[-1] else words))
                out.append(pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), pa.array(kept, pa.string()), pa.array(np.diff(offs), pa.int64()), pa.array(removed, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"]))
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])
        return pa.Table.from_batches(out, schema=schema)

    return run


def dedup_substrings(docs: DataFrame, lengths: Sequence[int] = doubling(7, 13)) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed of each row of docs (doc_id, text).

    lengths: window lengths in words, growing to at most about twice the one before; the last is the
    shortest repeat that is removed.
    """
    if len(lengths) < 2 or any(b > 2 * a or b <= a for a, b in zip(lengths, lengths[1:], strict=False)):
        raise ValueError("lengths must grow, each to at most twice the one before")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    n = max(partitions(docs.sparkSession), -(-size // PART_BYTES))
    x = F.coalesce("doc_id", F.xxhash64("text"))
    by_part = docs.withColumn("part", F.pmod(x.bitwiseXOR(F.shiftright(x, 7)).bitwiseXOR(F.shiftright(x, 19)), F.lit(n)).cast("int"))
    blobs = docs.mapInArrow(_first_level(n, lengths[0], lengths[1]), BLOB)
    alive = blobs.groupBy("bucket").applyInArrow(_decide(n, False), "part int, payload binary")
    for below, length in zip(lengths, lengths[1:], strict=False):
        # Survivors are written between the levels: where there are none, the longer windows are not looked at.
        alive = materialise(alive, "survivors")
        last = length == lengths[-1]
        if alive.isEmpty():
            break
        blobs = by_part.groupBy("part").cogroup(alive.groupBy("part")).applyInArrow(_next_level(n, length, below, last), BLOB)
        alive = blobs.groupBy("bucket").applyInArrow(_decide(n, last), "part int, payload binary")
    return by_part.groupBy("part").cogroup(alive.groupBy("part")).applyInArrow(_remove(lengths[-1]), "doc_id long, text string, n_words long, n_removed long")
