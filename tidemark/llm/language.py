"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Document frequencies count every learnable document. The regression is fitted on the driver
by follow-the-regularised-leader with elastic-net penalties, on about `per_lang` rows of
each language (a hash of the id decides), a fifth of which is held back to calibrate a
temperature. Every whole text is predicted.

Texts that are null or without letters are `und` with score 0. Without a learnable row all
are. Input columns other than id, text and lang are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import learners as L
from tidemark.llm.quality import held_out


def _frequencies(batches):
    """In how many texts of this task each n-gram occurs; one row (-1) with the number of texts."""
    total, n = np.zeros(1 << L.BITS, np.int64), 0
    for batch in batches:
        for t in batch.column("text").to_pylist():
            at, _ = L.char_grams(t)
            total[at] += 1
            n += len(at) > 0
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([n, *total[at]], pa.int64())], names=["gram", "n"])


def _vectors(batches):
    for batch in batches:
        rows = [L.char_grams(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([a.astype(np.uint16).tobytes() for a, _ in rows], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in rows], pa.binary())], names=["lang", "grams", "counts"])


def _weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def _predicted(langs: list[str], w: np.ndarray, idf: np.ndarray, temperature: float):
    def run(batches):
        w_by_gram = np.ascontiguousarray(w.T)
        for batch in batches:
            pred, score = [], []
            for t in batch.column("text").to_pylist():
                at, counts = L.char_grams(t)
                if not len(at) or not langs:
                    pred.append("und")
                    score.append(0.0)
                    continue
                p = L.softmax(_weighted(at, counts, idf) @ w_by_gram[at] / temperature)
                pred.append(langs[int(p.argmax())])
                score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify_language(docs: DataFrame, folds: int = 3, fold: int = 1, per_lang: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs (doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out("doc_id", folds, fold))
    counted = {r.gram: r.n for r in known.select("text").mapInArrow(_frequencies, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    n = counted.pop(-1, 0)
    df = np.zeros(1 << L.BITS)
    df[list(counted)] = list(counted.values())
    idf = np.log((1 + n) / (1 + df)) + 1
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if langs:
        share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, per_lang / sizes[lang])))])
        draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000
        sample = known.where(draw < share[F.col("lang")]).select("lang", "text").mapInArrow(_vectors, "lang string, grams binary, counts binary").collect()
        rows = [(np.frombuffer(r.grams, np.uint16).astype(np.int64), np.frombuffer(r.counts, np.uint32).astype(float)) for r in sample]
        rows = [(at, _weighted(at, c, idf)) for at, c in rows]
        y = np.array([langs.index(r.lang) for r in sample], int)
        order = np.array(sorted(range(len(y)), key=lambda i: (sample[i].grams, sample[i].counts, y[i])), int)
        order = np.random.default_rng(11).permutation(order)
        back = order[: len(order) // 5]
        w = L.fit_ftrl([rows[i] for i in order[len(back) :]], y[order[len(back) :]], len(langs), 1 << L.BITS)
        scores = np.array([w[:, rows[i][0]] @ rows[i][1] for i in back]).reshape(len(back), len(langs))
        fit = L.fit_temperature(scores, y[back])
        # Too few rows held back say nothing about confidence.
        temperature = fit if len(back) >= 20 else 1.0
    else:
        w, temperature = np.zeros((1, 1 << L.BITS)), 1.0
    out = docs.select("doc_id", "text").mapInArrow(_predicted(langs, w, idf, temperature), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "lang_pred", "score")
