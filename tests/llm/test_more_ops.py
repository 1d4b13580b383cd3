"""Pages, token counts, mixing and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import learners, mixing, pages, queries, tokens

RANKS = open(queries.RANKS, "rb").read()


def test_blocks_of_awkward_html():
    html = """<!doctype html><title>x</title><nav><ul><li>Menu<li>Home</ul></nav><script>var a="</p><p>no";</script>
    <main><h1>Head &amp; more</h1><p>One <b>bold</b><br>two&nbsp;three<p>Four<div class="ad">buy</div><ul><li>a<li>b</ul>
    <form><p>mail</form><section class="comments"><p>first!</p></section><!-- <p>gone</p> --><p>a &lt; b</main><footer>(c)</footer>"""
    assert [t for _, t, aside in pages.blocks(html)[0] if not aside] == ["Head & more", "One bold two three", "Four", "a", "b", "a < b"]
    for odd in (None, "", "<", "</p>", "<p", "plain", "<script>never closed", "<b>" * 3000 + "deep"):
        pages.blocks(odd)


def site(n, host, body):
    return [(f"https://{host}/p{i}", f"<html><body><div class='top'><div>Welcome to {host}</div><div>About us</div></div><div class='x1'>{body(i)}</div><div class='x2'>All rights of {host}</div></body></html>") for i in range(n)]


def test_template_is_deduced(spark):
    rng = random.Random(1)
    body = lambda i: f"<p>Text {i} {rng.random()}</p><p>Shared passage</p>" if i % 2 else f"<p>Other {i} {rng.random()} long words here</p>"
    rows = [(i, u, h, "m") for i, (u, h) in enumerate(site(12, "a.example", body) + site(2, "small.example", body))] + [(100, None, None, "m"), (101, "https://a.example/e", "", "m")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, main string")
    got = {r.page_id: r.text for r in pages.extract_main_text(d).collect()}
    for i in range(12):
        assert "Welcome" not in got[i] and "rights" not in got[i] and got[i].startswith("Text" if i % 2 else "Other")
        assert ("Shared passage" in got[i]) == bool(i % 2)
    assert "Text 1" in got[13] and got[100] == "" == got[101]
    assert pages.extract_main_text(d.limit(0)).count() == 0


def test_pages_of_the_table(spark):
    import html
    import re

    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in pages.extract_main_text(table).collect()}
    for r in table.collect():
        parts = re.split(r"</?(?:p|h1|article)>", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", x))).strip() for x in parts]
        assert got[r.page_id] == "\n".join(x for x in want if x)


def test_edits_equal_full_counts():
    rng = random.Random(2)
    encoder = tokens.Encoder(RANKS)
    pieces = ["Hello", " ", "  ", "\n\n", "it's", "'ll", "12", "é", "日本", ".", "!!", " world", "x" * 30, "\t"]
    for _ in range(150):
        doc = tokens.Counted(encoder, "".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 5, 300]))))
        for _ in range(6):
            at = rng.randint(0, len(doc.text) + 2)
            text, new = doc.text, "".join(rng.choice(pieces) for _ in range(rng.choice([0, 0, 1, 3, 200])))
            end = min(len(text), at + rng.choice([0, 1, 5, 100]))
            doc.edit(at, end, new)
            assert doc.text == text[:at] + new + text[max(at, end) :]
            assert doc.total == len(encoder.encoding.encode_ordinary(doc.text))
            assert doc.ends.tolist() == tokens.Counted(encoder, doc.text).ends.tolist()


def test_an_edit_reads_little():
    encoder = tokens.Encoder(RANKS)
    doc = tokens.Counted(encoder, " ".join(f"w{i}" for i in range(5000)))
    doc.edit(9000, 9003, "zz z")
    assert doc.encoded < 12


def test_count_tokens_odd_rows(spark):
    d = spark.createDataFrame([(1, None, None), (2, "", [(5, 1, "ab")]), (2, "Hi there", [(0, 2, None)])], "doc_id long, text string, edits array<struct<at:int,size:int,new:string>>")
    assert sorted(tuple(r)[:3] for r in tokens.count_tokens(d, queries.RANKS).collect()) == [(1, 0, 0), (2, 0, 1), (2, 2, 1)]


def test_trees_and_ftrl_learn():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0.6)).astype(float)
    assert (((learners.score_trees(learners.fit_trees(x, y), x)) > 0.5) == y).mean() > 0.97
    rows = [(np.array([int(k), 5]), np.ones(2)) for k in y]
    w = learners.fit_ftrl(rows[:500], y[:500].astype(int), 2, 6)
    assert all((w[:, at] @ v).argmax() == k for (at, v), k in zip(rows[:50], y[:50], strict=True))
    assert learners.fit_temperature(np.array([[4.0, 0], [4, 0], [0, 4], [4, 0]]), np.array([0, 0, 1, 1])) > 1.5


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    d = spark.createDataFrame([(i, int(rng.integers(0, 500)), x.tolist()) for i, x in enumerate(p)], "doc_id long, n_tokens long, posterior array<double>")
    out = mixing.fit_rates(d, [0.6, 0.3, 0.1]).toPandas()
    assert (out.rate >= 0).all()
    assert np.allclose((out.n_tokens * out.rate).to_numpy() @ np.stack(out.posterior) / out.n_tokens.sum(), [0.6, 0.3, 0.1], atol=1e-3)
    assert mixing.fit_rates(d.limit(0), [1.0, 0, 0]).count() == 0


def test_mixing_without_labels(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert {(r.doc_id, r.domain, r.n_tokens) for r in mixing.mix_sources(d, none, {}).collect()} == {(1, "all", 2), (2, "all", 0)}


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, sf_dir).cache()
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept[name] <= before
        if name != "mixing":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(bad & kept["quality"]) <= 0.1 * len(bad) and kept["line_dedup"] == kept["quality"]
    assert docs.where("rate < 0").count() == 0 and set(docs.columns) == {"doc_id", "n_tokens", "domain", "posterior", "rate"}


@pytest.mark.parametrize("name", ["op2_language", "op3_html", "op4_token_counts", "op8_quality", "op9_mixing"])
def test_query_returns_every_row(spark, sf_dir, name):
    source = "pages" if name == "op3_html" else "documents"
    assert queries.queries()[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{source}.parquet").count()
