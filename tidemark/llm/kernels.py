"""Vectorised text kernels that run on executors. Only numpy and the standard library."""

from __future__ import annotations

import re

import numpy as np

U64 = np.uint64
#: Bytes of text that one vectorised step takes; a single longer text is one step.
SLICE_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_powers: dict[str, np.ndarray] = {}


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size, base = max(n, 1 << 16), 0x9E3779B97F4A7C15
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            p = np.full(size, U64(b))
            p[0] = U64(1)
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def slices(texts: list, limit: int = SLICE_BYTES):
    """Consecutive runs of texts of about `limit` characters; yields (first index, texts)."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > limit:
            yield at, texts[at:i]
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, texts[at:]


def word_hashes(texts: list, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word `[^\\x20\\x09-\\x0D]+` of all texts, and where each text's words begin (one more at the end). Null is empty."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    if lower:
        data = LOWER[data]
    gap = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([1], gap.view(np.int8)))))
    starts, ends = edge[0::2], edge[1::2]
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h = mix(h + (ends - starts).astype(np.uint64))
    begins = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    return h, np.searchsorted(starts, begins)


STEP, OTHER_STEP = U64(0xD1342543DE82EF95), U64(0xAF251AF3B0F025B5)


def windows(h: np.ndarray, offs: np.ndarray, k: int, step: np.uint64 = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each k consecutive words inside one text; the text of each; the word each starts at (index into h)."""
    counts = np.maximum(np.diff(offs) - k + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.zeros(0, np.int64)
    start = np.arange(int(counts.sum())) - np.repeat(first, counts) + np.repeat(offs[:-1], counts)
    if not len(start):
        return np.zeros(0, np.uint64), text, start
    n = len(h) - k + 1
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = acc * step + h[j : j + n]
    return mix(acc)[start], text, start


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values."""
    out, span = x, 1
    while span < w:
        jump = min(span, w - span)
        out = np.minimum(out[: len(out) - jump], out[jump:])
        span += jump
    return out


def shingle_sets(texts: list, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; fewer words: the whole sequence as one; none: empty. A-Z count as a-z."""
    out: list[np.ndarray] = []
    for _, part in slices(texts):
        h, offs = word_hashes(part, lower=True)
        w, text, _ = windows(h, offs, k)
        cut = np.searchsorted(text, np.arange(len(part) + 1))
        for i in range(len(part)):
            n = offs[i + 1] - offs[i]
            if n >= k:
                out.append(np.unique(w[cut[i] : cut[i + 1]]))
            elif n:
                acc = np.zeros(1, np.uint64)
                for x in h[offs[i] : offs[i + 1]]:
                    acc = acc * STEP + x
                out.append(mix(acc + np.full(1, n, np.uint64) * U64(0xA24BAED4963EE407)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def sketch(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n min-hash values of each set, one byte of each. Empty sets give zeros."""
    mult = mix(np.arange(1, n + 1, dtype=np.uint64) * U64(0xC2B2AE3D27D4EB4F)) | U64(1)
    out = np.zeros((len(sets), n), np.uint8)
    for i, s in enumerate(sets):
        if len(s):
            low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
            for at in range(0, len(s), 2048):
                part = s[at : at + 2048, None] * mult[None, :]
                part ^= part >> U64(29)
                part *= U64(0xBF58476D1CE4E5B9)
                np.minimum(low, part.min(0), out=low)
            out[i] = (mix(low) >> U64(56)).astype(np.uint8)
    return out
