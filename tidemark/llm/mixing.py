"""Soft-membership mixing of sources to target weights.

A domain is a combination of values in a labelled table. Multinomial regression (FTRL, fitted
on at most `max_train` labelled rows) on hashed words and document statistics gives each
document a posterior over domains. Rates r >= 0 are then fitted so that the expected tokens
of each domain, sum of r * tokens * posterior, come to its target share, with the least change
from 1 (sum of tokens * (r - 1)**2). Then r = max(0, 1 + x . posterior) with a number in x for
each domain, found by projected Newton steps, each one distributed sum; they go on until the
shares are met. Targets that no rates meet are approached, and a warning names what is missing.

Null and empty texts have no tokens and keep the rate that their posterior gives. Ids with
several labels count with each; null labels are not learned from. Without labels there is
one domain, `all`. Targets without mass anywhere cannot be met and are left out of the sum
of shares. Input columns other than id and text are ignored.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import learners as L
from tidemark.llm.shared import materialise, small


def _features(texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed words with square-root weights of length one, then the statistics and a constant."""
    stats, rows = L.statistics(texts), []
    width = stats.shape[1]
    for (at, n), s in zip(L.word_counts(texts), stats, strict=True):
        x = np.log1p(n) / max(np.sqrt((np.log1p(n) ** 2).sum()), 1e-12) * 3
        rows.append((np.concatenate((at, (1 << L.BITS) + np.arange(width + 1))), np.concatenate((x, np.tanh(s), [1.0]))))
    return rows


def _vectors(batches):
    for batch in batches:
        rows = _features(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("domain"), pa.array([a.astype(np.uint16).tobytes() for a, _ in rows], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in rows], pa.binary())], names=["doc_id", "domain", "at", "x"])


def _posteriors(w: np.ndarray):
    def run(batches):
        by_feature = np.ascontiguousarray(w.T)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            p = [L.softmax(x @ by_feature[at]) for at, x in _features(texts)]
            n = [len(L.K.words(t)) for t in texts]
            flat = np.array(p).reshape(len(texts), -1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * w.shape[0], pa.int32()), pa.array(flat.ravel(), pa.float64()))], names=["doc_id", "n_tokens", "posterior"])

    return run


def posteriors(docs: DataFrame, labels: DataFrame, max_train: int = 2_000) -> tuple[DataFrame, list[str]]:
    """(doc_id, n_tokens, posterior) of each row of docs (doc_id, text), and the domains in the order of the posterior; labels (doc_id, domain)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.where("doc_id IS NOT NULL AND domain IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "domain")
    sizes = {r.domain: r.n for r in labels.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(sizes)
    # About as many rows of each domain; a hash of the id draws them.
    share = [F.lit(min(1.0, max_train / max(1, len(domains)) / sizes[d])) for d in domains]
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    drawn = labels.where(draw < F.create_map(*[x for d, s in zip(domains, share, strict=True) for x in (F.lit(d), s)])[F.col("domain")]) if domains else labels
    # The drawn ids are few whatever the input: texts are not shuffled to meet them.
    sample = docs.join(small(drawn), "doc_id").select("doc_id", "domain", "text").mapInArrow(_vectors, "doc_id long, domain string, at binary, x binary").collect() if domains else []
    sample.sort(key=lambda r: (r.doc_id, r.domain))
    domains = sorted({r.domain for r in sample}) or ["all"]
    rows = [(np.frombuffer(r.at, np.uint16).astype(int), np.frombuffer(r.x, np.float32).astype(float)) for r in sample]
    width = (1 << L.BITS) + L.statistics([""]).shape[1] + 1
    w = L.fit_ftrl(rows, np.array([domains.index(r.domain) for r in sample], int), len(domains), width, epochs=8)
    # Rows were drawn evenly; the constant's weights take the domains' shares among all labels.
    if sample:
        drawn_n = np.array([sum(r.domain == d for r in sample) for d in domains], float)
        w[:, -1] += np.log(np.array([sizes[d] for d in domains]) / drawn_n)
    return docs.mapInArrow(_posteriors(w), "doc_id long, n_tokens long, posterior array<double>"), domains


def fit_rates(weighted: DataFrame, targets: list[float], steps: int = 200, near: float = 1e-4) -> DataFrame:
    """weighted (n_tokens, posterior, ...) with a column rate: expected domain totals come to `targets` shares of all tokens, within `near`. Warns if they don't."""
    k = len(targets)
    p = [F.col("posterior")[i] for i in range(k)]
    n = F.col("n_tokens")
    total = float(weighted.agg(F.sum(n).alias("n")).first().n or 0)
    if not total:
        return weighted.withColumn("rate", F.lit(1.0))

    def rates(x):
        return F.greatest(F.lit(0.0), sum((p[i] * float(x[i]) for i in range(k)), F.lit(1.0)))

    def sums(x):
        """Totals of the domains, half the squared rates, and the second moments of the posteriors of rows with a rate over 0, each over all tokens."""
        now = weighted.select(n, "posterior", rates(x).alias("r"))
        cells = [F.sum(n * p[i] * p[j] * (F.col("r") > 0).cast("int")) for i in range(k) for j in range(i, k)]
        got = np.array(now.agg(*[F.sum(n * F.col("r") * q) for q in p], F.sum(n * F.col("r") * F.col("r")) / 2, *cells).first(), float) / total
        m = np.zeros((k, k))
        m[np.triu_indices(k)] = got[k + 1 :]
        return got[:k], got[k], np.maximum(m, m.T)

    # Convex in x, with totals - goal as its slope; so small a ridge only matters if no rates meet the targets.
    ridge = 1e-8
    x = np.zeros(k)
    totals, half, m = sums(x)
    goal = np.where(np.diag(m) > 1e-9, np.array(targets, float), 0)
    goal /= max(goal.sum(), 1e-12)
    for _ in range(steps):
        slope = totals - goal + ridge * x
        if np.abs(slope).max() < near / 10:
            break
        step, size = -np.linalg.solve(m + ridge * np.eye(k), slope), 1.0
        value = half - goal @ x + ridge * (x @ x) / 2
        while size > 1e-6:
            to = x + size * step
            new = sums(to)
            if new[1] - goal @ to + ridge * (to @ to) / 2 <= value + 1e-4 * size * (slope @ step):
                break
            size /= 2
        else:
            break
        x, (totals, half, m) = to, new
    if np.abs(totals - goal).max() >= near:
        warnings.warn(f"domain shares {totals.round(5).tolist()} instead of {goal.round(5).tolist()}", stacklevel=2)
    return weighted.withColumn("rate", rates(x))


def mix_sources(docs: DataFrame, labels: DataFrame, targets: dict[str, float], max_train: int = 2_000) -> DataFrame:
    """doc_id, n_tokens, domain (likeliest), posterior, rate of each row of docs; targets gives domains their shares (others: 0)."""
    weighted, domains = posteriors(docs, labels, max_train)
    weighted = materialise(weighted, "posteriors")
    shares = [targets.get(d, 0.0) for d in domains]
    out = fit_rates(weighted, shares if sum(shares) > 0 else [1.0] * len(domains))
    best = F.array(*[F.lit(d) for d in domains])[(F.array_position("posterior", F.array_max("posterior")) - 1).cast("int")]
    return out.select("doc_id", "n_tokens", best.alias("domain"), "posterior", "rate")
