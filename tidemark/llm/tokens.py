"""Edit-aware token counts.

A text is cut into pre-tokens; the tokens of a pre-token do not depend on its neighbours. The
pre-tokens of a document, each with its code points and tokens, are dealt to slots of about
`SLOT`, and a segment tree over the slots sums both. `build_trees` makes these trees from texts,
a table that is kept; `apply_edits` takes such trees and edits, and gives the trees of the edited
texts. An edit goes down the tree to its place, re-reads the text from the pre-token before it
(the boundary context) until a pre-token ends where an old one did, encodes what it read, and
changes the sums on the paths from the touched slots to the root, no others. Slots grow and
shrink by edits; a tree is only built anew when one would hold over `GROWN` slots' worth. The
counts equal those of a full count.

Null text is empty and has no tokens. Repeated rows are counted each. Edits out of the
text's range are clipped to it. Input columns other than those named are ignored.
"""

from __future__ import annotations

import base64
import bisect
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import materialise

SLOT, GROWN = 32, 8
#: The usual pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose counts a worker remembers; beyond it, it begins anew.
REMEMBERED = 200_000
#: Bytes of text whose documents are held at once, about.
PIECE_BYTES = 1 << 20


class Encoder:
    """Token counts of pre-tokens under a rank file."""

    def __init__(self, ranks: bytes) -> None:
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n


class Counted:
    """A text with the segment tree over its pre-tokens.

    sizes, tokens: code points and tokens of all pre-tokens as they were counted, slot after slot, cut at `bounds`;
    `changed` has those of the slots that edits have changed. tree: two arrays of 2 * size sums (code points, tokens);
    node i has the children 2 * i and 2 * i + 1, and slot j is node size + j.
    """

    def __init__(self, encoder: Encoder, text: str | None, sizes: np.ndarray | None = None, tokens: np.ndarray | None = None, slots: np.ndarray | None = None, tree: np.ndarray | None = None) -> None:
        """Counts a text; or takes up one that was counted before, with its stored arrays."""
        self.encoder, self.text = encoder, text or ""
        self.encoded = self.updated = 0
        if tree is None:
            pieces = encoder.pattern.findall(self.text)
            self._deal(list(map(len, pieces)), list(map(encoder.count, pieces)))
            return
        self.sizes, self.tokens, self.changed = sizes, tokens, {}
        self.bounds = np.concatenate(([0], np.cumsum(slots)))
        self.tree = tree.reshape(2, -1).copy()

    def _deal(self, sizes: list[int], tokens: list[int]) -> None:
        """All pre-tokens to new slots, with a new tree."""
        self.sizes, self.tokens, self.changed = np.array(sizes, np.int32), np.array(tokens, np.int32), {}
        starts = np.arange(0, len(sizes), SLOT)
        self.bounds = np.append(starts, len(sizes)) if len(sizes) else np.zeros(2, np.int64)
        size = 1 << (len(self.bounds) - 2).bit_length()
        self.tree = np.zeros((2, 2 * size), np.int64)
        if len(sizes):
            self.tree[:, size : size + len(starts)] = np.add.reduceat(self.sizes, starts), np.add.reduceat(self.tokens, starts)
        while size > 1:
            size //= 2
            self.tree[:, size : 2 * size] = self.tree[:, 2 * size : 4 * size : 2] + self.tree[:, 2 * size + 1 : 4 * size : 2]

    def _slot(self, j: int) -> tuple[list[int], list[int]]:
        a, b = self.bounds[j : j + 2]
        return self.changed.get(j) or (self.sizes[a:b].tolist(), self.tokens[a:b].tolist())

    def _parts(self, which: int) -> list:
        """The sizes (0) or tokens (1) of all pre-tokens, in parts."""
        old, at, out = (self.sizes, self.tokens)[which], 0, []
        for j in sorted(self.changed):
            out += [old[at : self.bounds[j]], self.changed[j][which]]
            at = self.bounds[j + 1]
        return [*out, old[at:]]

    def stored(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """sizes, tokens, slots (how many pre-tokens each has) and tree, as `__init__` takes them."""
        slots = np.diff(self.bounds)
        for j, (own, _) in self.changed.items():
            slots[j] = len(own)
        return np.concatenate(self._parts(0)), np.concatenate(self._parts(1)), slots, self.tree.ravel()

    @property
    def total(self) -> int:
        return int(self.tree[1, 1])

    @property
    def n_pieces(self) -> int:
        return sum(map(len, self._parts(0)))

    @property
    def ends(self) -> np.ndarray:
        """Where each pre-token ends."""
        return np.cumsum(np.concatenate(self._parts(0)))

    def _slot_at(self, place: int) -> tuple[int, int]:
        """The slot that holds the code point before `place` (the first for 0), and where it begins."""
        node, begins, size = 1, 0, self.tree.shape[1] // 2
        while node < size:
            left = int(self.tree[0, 2 * node])
            if place > begins + left:
                begins += left
                node = 2 * node + 1
            else:
                node = 2 * node
        return min(node - size, len(self.bounds) - 2), begins

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end] by new."""
        n = int(self.tree[0, 1])
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        # The pre-token that ends at the edit may grow, and the one before it may look at that: begin with it.
        first, begins = self._slot_at(start)
        while first and bisect.bisect_left(list(accumulate(self._slot(first)[0], initial=begins))[1:], start) < 1:
            first -= 1
            begins -= sum(self._slot(first)[0])
        ends = list(accumulate(self._slot(first)[0], initial=begins))[1:]
        keep = max(0, bisect.bisect_left(ends, start) - 1)
        at = ends[keep - 1] if keep else begins
        # Old ends at and behind the edit, slot by slot, until the new cut meets one.
        last, old_end, left, gone, n_slots = first, at, self._slot(first)[0][keep:], 0, len(self.bounds) - 1
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        sizes, tokens = [], []
        met = False
        for m in self.encoder.pattern.finditer(self.text, at):
            sizes.append(m.end() - m.start())
            tokens.append(self.encoder.count(m[0]))
            if m.end() < start + len(new):
                continue
            while old_end + shift < m.end() or old_end < end:
                while gone == len(left) and last + 1 < n_slots:
                    last, left, gone = last + 1, self._slot(last + 1)[0], 0
                if gone == len(left):
                    break
                old_end += left[gone]
                gone += 1
            if old_end >= end and old_end + shift == m.end():
                met = True
                break
        if not met:  # to the end of the text
            last = n_slots - 1
            gone = len(self._slot(last)[0])
        elif last == first:
            gone += keep
        self.encoded += len(sizes)
        a, b = self._slot(first), self._slot(last)
        sizes, tokens = [*a[0][:keep], *sizes, *b[0][gone:]], [*a[1][:keep], *tokens, *b[1][gone:]]
        room = last - first + 1
        if len(sizes) > room * SLOT * GROWN:
            all_sizes, all_tokens = ([x for j in range(first) for x in self._slot(j)[i]] + own + [x for j in range(last + 1, n_slots) for x in self._slot(j)[i]] for i, own in enumerate((sizes, tokens)))
            self._deal(all_sizes, all_tokens)
            self.updated += self.tree.shape[1]
            return
        cut = [len(sizes) * i // room for i in range(room + 1)]
        size = self.tree.shape[1] // 2
        for i in range(room):
            own = self.changed[first + i] = sizes[cut[i] : cut[i + 1]], tokens[cut[i] : cut[i + 1]]
            self.tree[:, size + first + i] = sum(own[0]), sum(own[1])
        low, high = size + first, size + last
        self.updated += room
        while low > 1:
            low, high = low // 2, high // 2
            self.tree[:, low : high + 1] = self.tree[:, 2 * low : 2 * high + 2 : 2] + self.tree[:, 2 * low + 1 : 2 * high + 2 : 2]
            self.updated += high - low + 1


def encoder_of(ranks: bytes) -> Encoder:
    """One encoder for each worker process."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_tidemark", {})
    key = hash(ranks)
    if key not in kept:
        kept[key] = Encoder(ranks)
    return kept[key]


#: A document with its tree.
TREE = "doc_id long, text string, sizes array<int>, tokens array<int>, slots array<int>, tree array<int>"
KINDS = (pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 4)
NAMES = ("doc_id", "text", "sizes", "tokens", "slots", "tree")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(a) for a in arrays)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((np.concatenate(arrays) if arrays else np.zeros(0)).astype(np.int32)))


def pieces(batches):
    """Batches of about PIECE_BYTES of text: no more documents are held at once."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE_BYTES)) + 1
        for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def _stored(docs: list[Counted]) -> list[pa.Array]:
    return [pa.array([d.text for d in docs], pa.string()), *(_lists(list(c)) for c in (zip(*(d.stored() for d in docs), strict=True) if docs else [()] * 4))]


def _taken_up(encoder: Encoder, batch: pa.RecordBatch) -> list[Counted]:
    def arrays(name):
        column = batch.column(name)
        values, ends = np.asarray(column.values), np.asarray(column.offsets)
        return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    return [Counted(encoder, t, *a) for t, *a in zip(batch.column("text").to_pylist(), *map(arrays, NAMES[2:]), strict=True)]


def _built(ranks: bytes):
    def run(batches):
        encoder = encoder_of(ranks)
        for batch in pieces(batches):
            docs = [Counted(encoder, t) for t in batch.column("text").to_pylist()]
            more = [batch.column(c) for c in batch.schema.names if c not in ("doc_id", "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_stored(docs), *more], names=[*NAMES, *[c for c in batch.schema.names if c not in ("doc_id", "text")]])

    return run


def _edited(ranks: bytes, whole: bool):
    def run(batches):
        encoder = encoder_of(ranks)
        for batch in pieces(batches):
            docs, out = _taken_up(encoder, batch), []
            for doc, edits in zip(docs, batch.column("edits").to_pylist(), strict=True):
                before, n_pieces = doc.total, doc.n_pieces
                for e in edits or []:
                    at = e["at"] or 0
                    doc.edit(at, at + (e["size"] or 0), e["new"] or "")
                out.append((before, doc.total, n_pieces, doc.encoded, doc.updated))
            counts = [pa.array([r[i] for r in out], pa.int64()) for i in range(5)]
            names = ["n_tokens", "n_tokens_edited", "n_pieces", "n_encoded", "n_updated"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(_stored(docs) if whole else []), *counts], names=[*(NAMES if whole else NAMES[:1]), *names])

    return run


EDITS = "array<struct<at:int,size:int,new:string>>"
COUNTS = "n_tokens long, n_tokens_edited long, n_pieces long, n_encoded long, n_updated long"


def _ranks(path: str) -> bytes:
    """A rank file (about 1 MB), read by the driver and sent along."""
    with open(path, "rb") as f:
        return f.read()


def build_trees(docs: DataFrame, ranks_path: str) -> DataFrame:
    """TREE (a document's tree) of each row of docs (doc_id, text), and its edits if it has such a column."""
    kept = [F.col("edits").cast(EDITS).alias("edits")] if "edits" in docs.columns else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *kept)
    return docs.mapInArrow(_built(_ranks(ranks_path)), TREE + (f", edits {EDITS}" if kept else ""))


def apply_edits(trees: DataFrame, ranks_path: str, whole: bool = True) -> DataFrame:
    """The trees of the edited texts (TREE; not whole: doc_id alone), with COUNTS, of each row of trees (TREE and edits).

    n_tokens is before the edits, n_tokens_edited after; n_pieces is the number of pre-tokens before, n_encoded how many were
    encoded for the edits, n_updated how many sums were changed. edits: made in order, in code points; null is none.
    """
    return trees.select(*NAMES, "edits").mapInArrow(_edited(_ranks(ranks_path), whole), f"{TREE if whole else 'doc_id long'}, {COUNTS}")


def count_tokens(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and COUNTS of each row of docs (doc_id, text, edits): its tree is built and kept as a table, then edited."""
    return apply_edits(materialise(build_trees(docs, ranks_path), "token-trees"), ranks_path, whole=False)
