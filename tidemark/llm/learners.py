"""Small numpy learners: histogram gradient boosting and FTRL multinomial regression, with their text features."""

from __future__ import annotations

import numpy as np

from tidemark.llm import kernels as K

# ---- document statistics -------------------------------------------------------------

MARKS = b"#|!%$&*.,"


def statistics(texts: list) -> np.ndarray:
    """One row of numbers for each whole text. Null and empty texts give zeros."""
    rows = np.zeros((len(texts), 12 + len(MARKS)), np.float32)
    for at, part in K.slices(texts):
        h, offs = K.word_hashes(part)
        five, text, _ = K.windows(h, offs, 5)
        cut = np.searchsorted(text, np.arange(len(part) + 1))
        for i, t in enumerate(part):
            if not t:
                continue
            data = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
            c = np.bincount(data, minlength=256)
            n, w = len(data), h[offs[i] : offs[i + 1]]
            lines = t.split("\n")
            grams = five[cut[i] : cut[i + 1]]
            rows[at + i] = [
                np.log1p(n), np.log1p(len(w)), c[65:91].sum() / n, c[97:123].sum() / n, c[48:58].sum() / n, c[128:].sum() / n, (c[32] + c[9:14].sum()) / n,
                n / max(1, len(w)), len(np.unique(w)) / max(1, len(w)), (w[1:] == w[:-1]).mean() if len(w) > 1 else 0,
                len(np.unique(grams)) / max(1, len(grams)) if len(grams) else 1, len(set(lines)) / len(lines),
                *(c[m] / max(1, len(w)) for m in MARKS),
            ]
    return rows


# ---- histogram gradient-boosted trees ------------------------------------------------


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 5.0) -> dict:
    """Logistic boosting on binned features. Complete trees of `depth` levels in flat arrays: node i has children 2i+1 and 2i+2; a node that is not split sends all rows left."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], 1) if n else np.zeros((0, m), int)
    prior = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = np.log(prior / (1 - prior))
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, value = np.zeros((rounds, inner), np.int32), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves))
    score = np.full(n, base)
    for r in range(rounds if n else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            total_g, total_h = np.bincount(node, g, width), np.bincount(node, h, width)
            whole = total_g**2 / (total_h + l2)
            for j in range(m):
                if not len(edges[j]):
                    continue
                at = node * bins + code[:, j]
                gl = np.bincount(at, g, width * bins).reshape(width, bins).cumsum(1)[:, :-1]
                hl = np.bincount(at, h, width * bins).reshape(width, bins).cumsum(1)[:, :-1]
                gr, hr = total_g[:, None] - gl, total_h[:, None] - hl
                gain = np.where((hl * 4 >= least) & (hr * 4 >= least) | (np.minimum(hl, hr) > 0.5), gl**2 / (hl + l2) + gr**2 / (hr + l2) - whole[:, None], 0)[:, : len(edges[j])]
                top = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(width), top] > best):
                    best[k] = gain[k, top[k]]
                    feature[r, first + k], cut[r, first + k] = j, edges[j][top[k]]
            at = first + node
            node = node * 2 + (x[np.arange(n), feature[r, at]] > cut[r, at])
        value[r] = -rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + l2)
        score += value[r][node]
    return {"feature": feature, "cut": cut, "value": value, "base": base, "depth": depth}


def score_trees(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities, walking all rows down one level of a tree at a time."""
    total = np.full(len(x), model["base"])
    rows = np.arange(len(x))
    for feature, cut, value in zip(model["feature"], model["cut"], model["value"], strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(model["depth"]):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        total += value[node - len(feature)]
    return 1 / (1 + np.exp(-total))


# ---- hashed features -------------------------------------------------------------------

BITS = 14
_letters: list[np.ndarray] = []


def letter_codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, with each run of other characters than letters as one space."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(_letters[0][code], code, 32).astype(np.uint64)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    return code[keep]


def _hash(x: np.ndarray) -> np.ndarray:
    return (K.mix(x) >> np.uint64(64 - BITS)).astype(np.int64)


def char_grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 3-grams of letters: indexes and counts. Texts without letters have none."""
    c = letter_codes(text)
    if not (c != 32).any():
        return np.zeros(0, np.int64), np.zeros(0)
    step = np.uint64(0x110001)
    two = c[:-1] * step + c[1:] + np.uint64(1 << 50)
    three = (two[:-1] * step + c[2:]) if len(c) > 2 else np.zeros(0, np.uint64)
    counts = np.bincount(_hash(np.concatenate((c, two, three))), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(float)


def word_counts(texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed words of each text: indexes and counts."""
    out = []
    for _, part in K.slices(texts):
        h, offs = K.word_hashes(part, lower=True)
        code = (h >> np.uint64(64 - BITS)).astype(np.int64)
        out += [np.unique(code[offs[i] : offs[i + 1]], return_counts=True) for i in range(len(part))]
    return out


# ---- follow the regularised leader -----------------------------------------------------


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, width: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights (classes, width) of a sparse multinomial logistic regression; proximal updates with elastic-net penalties."""
    z, q = np.zeros((classes, width)), np.zeros((classes, width))
    rng = np.random.default_rng(seed)

    def weights(at):
        zz = z[:, at]
        return np.where(np.abs(zz) <= l1, 0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(q[:, at])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            p = softmax(w @ x)
            p[y[i]] -= 1
            g = p[:, None] * x[None, :]
            s = (np.sqrt(q[:, at] + g * g) - np.sqrt(q[:, at])) / alpha
            z[:, at] += g - s * w
            q[:, at] += g * g
    return weights(slice(None))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss on held-back rows, by golden-section search."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(scores / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    a, b, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))
