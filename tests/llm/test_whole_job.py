"""Cases in which an operator once did less than the whole job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import fingerprints, lines, mixing, neardup, queries


def test_lines_keep_rows_of_null_and_repeated_ids(spark):
    three = "a\nb\nc"
    rows = [(None, three, "x"), (None, three, "x"), (None, "q", "y"), (1, three, "x"), (2, "d\ne\nf", "x"), (2, three + "\ng", "y"), (3, "h\ni\nj", "x"), (3, "h\ni\nj", "x"), (3, "k", None), (3, "k", "x"), (3, "k", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = sorted(((r.doc_id or 0, r.text, r.lang or "", r.n_lines, r.n_removed) for r in lines.dedup_lines(d, carry=("lang",)).collect()))
    want = [(0, three, "x", 3, 0), (0, three, "x", 3, 0), (0, "q", "y", 1, 0), (1, three, "x", 3, 0), (2, "d\ne\nf", "x", 3, 0), (2, "g", "y", 4, 3), (3, "h\ni\nj", "x", 3, 0), (3, "", "x", 3, 3), (3, "k", "", 1, 0), (3, "k", "x", 1, 0), (3, "k", "x", 1, 0)]
    assert got == sorted(want)


def test_fingerprints_of_null_and_repeated_ids(spark):
    say = lambda s, n: " ".join(f"{s}{i}" for i in range(n))
    rows = [(None, say("a", 40)), (None, say("b", 50)), (5, say("c", 60)), (4, say("d", 70)), (4, say("e", 80)), (4, say("e", 80)), (3, say("f", 90))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = {r.text: r.f for r in fingerprints.fingerprints(d.select("text").distinct().withColumn("key", F.col("text")), "key").select(F.col("key").alias("text"), fingerprints.digits(F.col("fp")).alias("f")).collect()}
    after = {5: say("d", 70), 4: say("f", 90), 3: min(say("a", 40), say("b", 50)), None: say("c", 60)}
    want = sorted((i or 0, (t[: len(t) - len(t) // 3] + after[i][: len(t) // 3]), plain[t]) for i, t in rows)
    assert sorted((r.doc_id or 0, r.edited, r.fingerprint) for r in fingerprints.fingerprint_edits(d).collect()) == want




def test_near_duplicates_in_a_large_crowd(spark):
    """1,600 texts, each alike to one other at 0.86 and to the rest at 0.83."""
    base = " ".join(f"c{i}" for i in range(124))
    # Five-word windows: 120 in all texts, 2 of the pair, 10 of the text.
    rows = [(i, f"{base} p{i // 2} q{i // 2} " + " ".join(f"u{i}x{j}" for j in range(10))) for i in range(1600)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(d, part=85).collect()}
    assert got == {i: i - i % 2 for i in range(1600)}


def shares(rated, k):
    got = rated.agg(F.sum("n_tokens"), *[F.sum(F.col("n_tokens") * F.col("rate") * F.col("posterior")[i]) for i in range(k)], F.min("rate")).first()
    assert got[-1] >= 0
    return [x / got[0] for x in got[1:-1]]


def test_rates_meet_targets_of_rare_domains(spark):
    rng = np.random.default_rng(1)
    prior = np.array([0.945, 0.045, 0.008, 0.002])
    kind = rng.choice(4, 4000, p=prior)
    p = np.exp(np.log(prior) + 4 * np.eye(4)[kind] + rng.normal(size=(4000, 4)))
    p /= p.sum(1, keepdims=True)
    d = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(rng.integers(1, 900, 4000), p, strict=True)], "n_tokens long, posterior array<double>").cache()
    target = [0.70, 0.20, 0.05, 0.05]
    assert shares(mixing.fit_rates(d, target), 4) == pytest.approx(target, abs=1e-4)


def test_rates_report_targets_out_of_reach(spark):
    d = spark.createDataFrame([(9, [0.5, 0.5]), (5, [0.6, 0.4])], "n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="instead of"):
        mixing.fit_rates(d, [0.0, 1.0])


def test_mixing_meets_targets_after_the_quality_filter(spark):
    sf = "/root/testdata/sf0.01"
    docs = corpus_pipeline.filter_quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    found = queries.domain_labels(spark, sf).join(docs, "doc_id").where("domain IS NOT NULL").select("domain").distinct().collect()
    target = np.array([queries.TARGETS[d] for d in sorted(r.domain for r in found)])
    assert shares(corpus_pipeline.mix(spark, docs, sf).cache(), len(target)) == pytest.approx(list(target / target.sum()), abs=1e-4)
