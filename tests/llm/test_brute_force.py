"""Operators and pipeline stages against plain Python, and awkward tables."""

import hashlib
import random
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, fingerprints, kernels, language, learners, lines, mixing, neardup, pages, quality, queries, shared, substrings, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def say(rng, n, words=400, mark="w"):
    return " ".join(f"{mark}{rng.randrange(words)}" for _ in range(n))


# ---- op1 -------------------------------------------------------------------------------


def signed(x):
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def spark_hash(*values):
    """xxhash64 of strings, longs, and ints (given as 1-tuples)."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return signed(seed)


def brute_fingerprint(text, k=3):
    w = [spark_hash(x) for x in WORD.findall(text or "")]
    seen, values = Counter(), []
    for i in range(max(1, len(w) - k + 1) if w else 0):
        g = spark_hash(*w[i : i + k])
        values.append(spark_hash(g, (seen[g],)) if seen[g] else g)
        seen[g] += 1
    out = []
    for i in range(fingerprints.POSITIONS // 2):
        hashes = [spark_hash(signed(v ^ ((i + 1) * 0x9E3779B97F4A7C15 % (1 << 63)))) for v in values]
        for rank in (lambda h: signed(h) >> 31, lambda h: signed(h << 32) >> 31):
            least = sorted((rank(h), at) for at, h in enumerate(hashes))[:2]
            out.append(spark_hash(*[r for r, _ in sorted(least, key=lambda x: x[1])]) & 0xFFFF if least else -1)
    return out


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "a", "a b c", "x " * 50, "é\x0b日本 é 日本 é 日本"] + [say(rng, n, 200) for n in (3, 20, 100, 600, 9000)]
    d = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(3)
    got = {r.key: r.fp for r in fingerprints.fingerprints(d, "key").collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("n", [20, 50])
def test_fingerprints_of_swapped_halves(spark, n):
    """Likeness comes near the definition's: the chance that the two least of all k-mers of either text are the same ones, in one order."""
    rng = random.Random(n)
    pairs, expected = [], []
    for _ in range(40):
        a = say(rng, n, 10_000).split()
        b = a[n // 2 :] + a[: n // 2]
        pairs.append((" ".join(a), " ".join(b)))
        x, y = ([tuple(t[i : i + 3]) for i in range(n - 2)] for t in (a, b))
        hits = 0
        for _ in range(200):
            order = {g: rng.random() for g in {*x, *y}}
            hits += [g for g in x if g in sorted(x, key=order.get)[:2]] == [g for g in y if g in sorted(y, key=order.get)[:2]]
        expected.append(hits / 200)
    d = spark.createDataFrame([(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "key long, text string")
    fp = {r.key: r.fp for r in fingerprints.fingerprints(d, "key").collect()}
    got = [np.mean(np.array(fp[2 * i]) == np.array(fp[2 * i + 1])) for i in range(len(pairs))]
    assert np.mean(got) == pytest.approx(np.mean(expected), abs=0.06)


# ---- op2, op8, op9: plain loops --------------------------------------------------------


def brute_grams(text):
    t = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    code = [ord(c) for c in re.sub(" +", " ", t)]
    if all(c == 32 for c in code):
        return {}
    one = lambda x: int(learners._hash(np.array([x % (1 << 64)], np.uint64))[0])
    two = [a * 0x110001 + b + (1 << 50) for a, b in zip(code, code[1:], strict=False)]
    three = [a * 0x110001 + c for a, c in zip(two, code[2:], strict=False)]
    return Counter(one(x) for x in code + two + three)


def brute_ftrl(rows, y, classes, epochs, alpha=0.5, beta=1.0, l1=1e-4, l2=1e-4, seed=7):
    z, q = ([Counter() for _ in range(classes)] for _ in range(2))

    def weight(k, j):
        v = z[k][j]
        return 0.0 if abs(v) <= l1 else -(v - (l1 if v > 0 else -l1)) / ((beta + q[k][j] ** 0.5) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            w = [{j: weight(k, j) for j in rows[i]} for k in range(classes)]
            s = np.array([sum(w[k][j] * x for j, x in rows[i].items()) for k in range(classes)])
            p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            for k in range(classes):
                for j, x in rows[i].items():
                    g = (p[k] - (y[i] == k)) * x
                    z[k][j] += g - ((q[k][j] + g * g) ** 0.5 - q[k][j] ** 0.5) / alpha * w[k][j]
                    q[k][j] += g * g
    return weight


def test_language_equals_brute_force(spark):
    rng = random.Random(1)
    letters = {"aa": "abcdé", "bb": "defgh"}
    rows = [(i, "".join(rng.choice(letters[lang] + " ") for _ in range(rng.randint(1, 60))), lang) for i, lang in enumerate(["aa", "bb"] * 14)]
    rows += [(90, None, "aa"), (91, "12 !", "aa"), (92, "abc", None), (None, "dé", "aa"), (1, "dé", "bb"), (1, "dé", "bb")]
    d = spark.createDataFrame([(*r, 0.5, True) for r in rows], "doc_id long, text string, lang string, score double, held_out boolean")
    out = lambda i: i is not None and __import__("zlib").crc32(str(i).encode()) % 3 == 1
    known = [(t, lang) for i, t, lang in rows if not out(i) and t is not None and lang]
    grams = [brute_grams(t) for t, _ in known]
    df, n = Counter(j for g in grams for j in g), sum(bool(g) for g in grams)

    def weighted(g):
        x = {j: (1 + np.log(c)) * (np.log((1 + n) / (1 + df[j])) + 1) for j, c in sorted(g.items())}
        return {j: v / max(sum(u * u for u in x.values()) ** 0.5, 1e-12) for j, v in x.items()}

    key = lambda i: (np.array(sorted(grams[i]), np.uint16).tobytes(), np.array([grams[i][j] for j in sorted(grams[i])], np.uint32).tobytes(), known[i][1])
    order = np.random.default_rng(11).permutation(np.array(sorted(range(len(known)), key=key)))
    fit = order[len(order) // 5 :]
    weight = brute_ftrl([weighted(grams[i]) for i in fit], [["aa", "bb"].index(known[i][1]) for i in fit], 2, 4)
    want = []
    for i, t, _ in rows:
        x = weighted(brute_grams(t))
        s = np.array([sum(weight(k, j) * v for j, v in x.items()) for k in range(2)])
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        want.append((i or -1, out(i), "ab"[int(p.argmax())] * 2 if x else "und", round(float(p.max()), 6) if x else 0.0))
    got = language.identify_language(d).collect()
    assert sorted((r.doc_id or -1, r.held_out, r.lang_pred, round(r.score, 6)) for r in got) == sorted(want)


def brute_statistics(t):
    if not t:
        return [0.0] * 21
    data, w, ls = t.encode(), WORD.findall(t), t.split("\n")
    n, share = len(data), lambda f: sum(map(f, data)) / len(data)
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    return [
        np.log1p(n), np.log1p(len(w)), share(lambda c: 65 <= c < 91), share(lambda c: 97 <= c < 123), share(lambda c: 48 <= c < 58), share(lambda c: c > 127), share(lambda c: c == 32 or 9 <= c < 14),
        n / max(1, len(w)), len(set(w)) / max(1, len(w)), np.mean([a == b for a, b in zip(w, w[1:], strict=False)]) if len(w) > 1 else 0,
        len(set(five)) / len(five) if five else 1, len(set(ls)) / len(ls), *(data.count(m) / max(1, len(w)) for m in b"#|!%$&*.,"),
    ]


def brute_trees(model, x):
    s = model["base"]
    for feature, cut, value in zip(model["feature"], model["cut"], model["value"], strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + (x[feature[node]] > cut[node])
        s += value[node - len(feature)]
    return 1 / (1 + np.exp(-s))


def test_quality_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, say(rng, rng.randint(1, 60)) + ("" if i % 2 else " ### !!! ###" * 3)) for i in range(120)] + [(200, None), (201, ""), (202, "\n" * 9), (None, "a b"), (3, "x " * 3000), (3, "same")]
    labels = [(i, i % 2, 0) for i in range(100)] + [(4, 1, 0), (5, None, 0), (None, 1, 1)]
    d = spark.createDataFrame([(*r, 1.0, 1) for r in rows], "doc_id long, text string, score double, quality int")
    k = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = lambda i: i is not None and __import__("zlib").crc32(str(i).encode()) % 5 == 0
    stats = [np.array(brute_statistics(t), np.float32) for _, t in rows]
    marks = {}
    for i, y, _ in labels:
        if i is not None and y is not None and not out(i):
            marks.setdefault(i, []).append(y)
    train = sorted(((i, j) for j, (i, _) in enumerate(rows) if i in marks), key=lambda x: x[0])
    got_stats = {(r.doc_id, r.text): r.stats for r in d.select("doc_id", "text").distinct().mapInArrow(lambda b: _with_text(b), "doc_id long, text string, stats array<float>").collect()}
    assert all(np.allclose(got_stats[r], s, rtol=1e-5, atol=1e-6) for r, s in zip(rows, stats, strict=True))
    model = learners.fit_trees(np.array([stats[j] for _, j in train]), np.array([np.mean(marks[i]) >= 0.5 for i, _ in train], float))
    want = sorted((i or -1, out(i), round(float(brute_trees(model, s)), 4)) for (i, _), s in zip(rows, stats, strict=True))
    got = sorted((r.doc_id or -1, r.held_out, round(r.score, 4)) for r in quality.score_quality(d, k).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=0.02)


def _with_text(batches):
    for b in batches:
        s = learners.statistics(b.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(s.tolist(), pa.list_(pa.float32()))], names=["doc_id", "text", "stats"])


def test_first_split_is_the_best():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, (300, 3)).astype(np.float32), rng.integers(0, 2, 300).astype(float)
    y[x[:, 1] > 5] = 1
    model = learners.fit_trees(x, y, rounds=1, depth=1)
    p = y.mean()
    g, h = p - y, np.full(300, p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max((gain(x[:, j] <= c) + gain(x[:, j] > c), j, c) for j in range(3) for c in range(8))
    assert model["feature"][0, 0] == best[1] and best[2] <= model["cut"][0, 0] < best[2] + 1


def brute_rates(p, n, goal):
    """Projected gradient steps on the rates' dual, with tiny steps, until the totals stand still."""
    x = np.zeros(p.shape[1])
    for _ in range(60_000):
        r = np.maximum(0, 1 + p @ x)
        slope = (n * r) @ p / n.sum() - goal
        x -= slope
        if np.abs(slope).max() < 1e-7:
            break
    return np.maximum(0, 1 + p @ x)


def test_mixing_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, say(rng, rng.randint(3, 40), 30, "abc"[i % 3])) for i in range(90)] + [(95, None), (96, ""), (None, "a1 a2"), (4, "b1 b2 b3"), (4, "b1 b2 b3")]
    labels = [(i, "abc"[i % 3]) for i in range(60)] + [(1, "a"), (2, None), (None, "b")]
    d = spark.createDataFrame([(*r, "z", 0.5) for r in rows], "doc_id long, text string, domain string, rate double")
    k = spark.createDataFrame(labels, "doc_id long, domain string")
    out = mixing.mix_sources(d, k, {"a": 0.5, "b": 0.3, "c": 0.2}, max_train=3_000).toPandas()
    assert len(out) == len(rows)
    p, n = np.stack(out.posterior), out.n_tokens.to_numpy(float)
    assert np.allclose(p.sum(1), 1) and sorted(out.n_tokens) == sorted(len(WORD.findall(t or "")) for _, t in rows)
    assert np.allclose(out.rate, brute_rates(p, n, np.array([0.5, 0.3, 0.2])), atol=2e-3)
    assert list(out.domain) == ["abc"[i] for i in p.argmax(1)]
    # Posteriors by plain loops: hashed words with log counts, statistics, a constant.
    drawn = [(i, t, dom) for i, t in rows for j, dom in labels if i is not None and i == j and dom]

    def features(t):
        words = Counter(int(h >> np.uint64(64 - learners.BITS)) for h in kernels.word_hashes([t], lower=True)[0])
        size = max(sum(np.log1p(c) ** 2 for c in words.values()) ** 0.5, 1e-12)
        x = {j: np.log1p(c) / size * 3 for j, c in sorted(words.items())}
        stats = np.tanh(np.array(brute_statistics(t), np.float32))
        return {**{j: float(np.float32(v)) for j, v in x.items()}, **{(1 << learners.BITS) + j: float(v) for j, v in enumerate(stats)}, (1 << learners.BITS) + len(stats): 1.0}

    drawn.sort(key=lambda r: (r[0], r[2]))
    weight = brute_ftrl([features(t) for _, t, _ in drawn], ["abc".index(dom) for *_, dom in drawn], 3, 8)
    sizes = Counter(dom for i, dom in labels if i is not None and dom)
    shift = np.log(np.array([sizes[c] / sum(dom == c for *_, dom in drawn) for c in "abc"]))
    for r in out.where(out.doc_id.notna()).dropna(subset=["doc_id"]).itertuples():
        texts = [t for i, t in rows if i == r.doc_id]
        if len(texts) == 1:
            x = features(texts[0])
            s = np.array([sum(weight(c, j) * v for j, v in x.items()) for c in range(3)]) + shift
            want = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            assert np.allclose(r.posterior, want, atol=0.01)


# ---- op3 -------------------------------------------------------------------------------


def table_of(spark, rows):
    """PARSED rows made in this process, whose lists of names a test may change."""
    batch = pa.record_batch({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": pa.array([r[1] for r in rows], pa.string()), "html": pa.array([r[2] for r in rows], pa.string()), "key": pa.array([spark_hash(str(r)) for r in rows], pa.int64())})
    return spark.createDataFrame(pa.Table.from_batches(list(pages._parsed([batch]))), pages.PARSED)


def test_templates_alone_find_the_article(spark, monkeypatch):
    """Without lists of names, and with article elements as plain ones, hosts with a template give the same texts."""
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    want = {r.page_id: r.text for r in pages.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    monkeypatch.setattr(pages, "NAMED", re.compile("(?!)"))
    monkeypatch.setattr(pages, "ASIDE", {"head"})
    monkeypatch.setattr(pages, "ROLES", set())
    plain = [(i, u, re.sub(r"(</?)(?:article|main)\b", r"\1div", h)) for i, u, h in rows]
    got = {r.page_id: r.text for r in pages.extract_parsed(table_of(spark, plain)).collect()}
    hosts = Counter(pages.host_of(u) for _, u, _ in rows)
    large = [i for i, u, _ in rows if hosts[pages.host_of(u)] >= pages.SUPPORT]
    assert len(large) > 200 and [i for i in large if got[i] != want[i]] == []


def page(i, body, more=""):
    return f"<html><body><div class='a0'>Site of things</div>{more}<div class='a1'>{body}</div><div class='a2'>All rights</div></body></html>"


def extract(spark, rows):
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, key int").repartition(3)
    return sorted((-1 if r.page_id is None else r.page_id, r.text) for r in pages.extract_main_text(d).collect())


@pytest.mark.parametrize("n", [3, 9, 10, 30])
def test_pages_of_hosts_of_any_size(spark, n):
    """What the whole host says once a page is template; what a page says is not, nor what only some pages share."""
    rows = [(i, "https://h.example/x", page(i, f"<p>Own text {i} of this page</p><p>Subscribe now</p>" + ("<p>Said by some</p>" if i % 3 else ""))) for i in range(n)]
    assert extract(spark, rows) == [(i, f"Own text {i} of this page" + ("\nSaid by some" if i % 3 else "")) for i in range(n)]


def test_repeated_pages_and_null_ids(spark):
    one = [(i or None, "https://h.example/x", page(i, f"<p>Own text {i}</p>")) for i in range(6)]
    want = sorted((-1 if i is None else i, f"Own text {i or 0}") for i, *_ in one)
    assert extract(spark, one) == want and extract(spark, one * 2) == sorted(want * 2)


def test_slots_beside_the_article(spark):
    """Title and lead stand in containers of their own; a list of links beside them is left out."""
    links = lambda i: "<div class='a7'>" + "".join(f"<a href='/{j}'>see also {i * j}</a> " for j in range(30)) + "</div>"
    rows = [(i, "https://h.example/x", f"<html><body><div class='a0'>Site</div><div class='b1'><h1>Title {i}</h1></div><div class='b2'>Lead of {i}</div><div class='b3'><p>Body {i} with rather more words</p></div>{links(i)}<div class='a2'>All rights</div></body></html>") for i in range(5)]
    assert extract(spark, rows) == [(i, f"Title {i}\nLead of {i}\nBody {i} with rather more words") for i in range(5)]


def test_article_in_a_part_with_a_misleading_name(spark):
    rows = [(i, "https://h.example/x", f"<html><body><div class='a0'>Site</div><div class='notice'><p>Text number {i}</p></div><div class='a2'>All rights</div></body></html>") for i in range(4)]
    assert extract(spark, rows) == [(i, f"Text number {i}") for i in range(4)]


def test_awkward_pages(spark):
    long = page(0, "".join(f"<p>Par {j} of many</p>" for j in range(30_000)))
    tie = [(i, "https://t.example", f"<html><body><div class='x'>s</div><div class='p'>ab {i}</div><div class='q'>cd {i}</div></body></html>") for i in range(3)]
    rows = [(1, None, None), (2, "", ""), (3, "https://l.example", long), *[(10 + i, u, h) for i, u, h in tie], (20, "https://e.example", "<p></p>")]
    got = dict(extract(spark, rows))
    assert got[1] == got[2] == got[20] == "" and got[3].count("\n") >= 29_999
    assert [got[10 + i] for i in range(3)] == [f"ab {i}\ncd {i}" for i in range(3)]
    assert extract(spark, []) == []


# ---- op4 -------------------------------------------------------------------------------


def test_stored_trees_take_edits(spark):
    rng = random.Random(6)
    ranks = queries.RANKS
    full = lambda t: len(tokens.encoder_of(open(ranks, "rb").read()).encoding.encode_ordinary(t or ""))
    texts = [None, "", "a", say(rng, 30), say(rng, 4000), "it's 'r " * 40, "  \n\n x" * 200, say(rng, 4000)]
    schema = "doc_id long, text string, edits array<struct<at:int,size:int,new:string>>, tree string, slots int"
    plan = [[None, [(0, 0, "new ")], [(0, 1, None)], [(5, 9, "e"), (40, 0, " is 12 ")], [(9000, 30, say(rng, 900)), (100, 4, "")], [(7, 0, "e"), (8, 1, "'")], [(3, 500, "y")], None][i] for i in range(len(texts))]
    d = spark.createDataFrame([(i, t, e, "x", 1) for i, (t, e) in enumerate(zip(texts, plan, strict=True))], schema)

    def edited(t, edits):
        t = t or ""
        for at, size, new in edits or []:
            t = t[:at] + (new or "") + t[at + size :]
        return t

    once = tokens.apply_edits(shared.materialise(tokens.build_trees(d, ranks), "trees"), ranks)
    once = shared.materialise(once, "trees")
    for r in once.collect():
        want = edited(texts[r.doc_id], plan[r.doc_id])
        assert r.text == want and (r.n_tokens, r.n_tokens_edited) == (full(texts[r.doc_id]), full(want)) and sum(r.tokens) == full(want)
        assert sum(r.slots) == len(r.sizes) == len(r.tokens) and sum(r.sizes) == len(want)
    # The kept trees are edited again; little is encoded, and only sums on the paths change.
    again = once.select(*tokens.NAMES, F.expr("array(named_struct('at', 11, 'size', 3, 'new', 'q q'))").alias("edits"))
    for r in tokens.apply_edits(again, ranks).collect():
        want = edited(edited(texts[r.doc_id], plan[r.doc_id]), [(11, 3, "q q")])
        assert r.text == want and r.n_tokens_edited == full(want) and r.n_encoded < 12 and r.n_updated <= 4 + 2 * len(r.tree).bit_length()
    assert tokens.count_tokens(d.limit(0), ranks).count() == 0


def test_counts_of_the_query(spark, sf_dir):
    """op4 against a full count of the texts that its edits make."""
    encoder = tokens.Encoder(open(queries.RANKS, "rb").read())
    full = lambda t: len(encoder.encoding.encode_ordinary(t))
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        t = r.text or ""
        n = len(t)
        e = t[: n // 2] + " edit 12, x" + t[n // 2 + 20 :]
        want[r.doc_id] = (full(t), full(e[: n // 4] + "yz" + e[n // 4 :]), len(encoder.pattern.findall(t)))
    assert {r.doc_id: (r.n_tokens, r.n_tokens_edited, r.n_pieces) for r in queries.op4_token_counts(spark, sf_dir).collect()} == want


# ---- op5, op6, op10 --------------------------------------------------------------------


def test_substrings_stop_where_nothing_repeats(spark):
    rng = random.Random(7)
    d = spark.createDataFrame([(i, say(rng, 40, 100_000)) for i in range(20)], "doc_id long, text string")
    assert substrings.doubling(4, 13) == (4, 8, 13) and substrings.doubling(7, 13) == (7, 13)
    assert substrings.dedup_substrings(d, substrings.doubling(3, 13)).where("n_removed > 0 OR n_words <> 40").count() == 0


def test_windows_are_told_apart_by_both_hashes():
    a = np.array([[5, 1], [5, 2], [9, 9]], np.uint64)
    assert substrings._isin(np.array([[5, 2], [5, 3], [5, 1], [9, 9], [1, 1]], np.uint64), a).tolist() == [True, False, True, True, False]


def test_short_items_with_substitutions(spark):
    from itertools import combinations

    items, docs = {n: [f"k{n}x{j}" for j in range(n)] for n in range(8, 15)}, []
    for n, item in items.items():
        for bad in [(), *combinations(range(n), 1), *combinations(range(n), 2), *list(combinations(range(n), 3))[::7]]:
            docs.append((len(docs), n, ["pre"] * (len(docs) % 3) + [w + "x" if j in bad else w for j, w in enumerate(item)] + ["post", f"k{n}x3"]))
    d = spark.createDataFrame([(i, " ".join(words)) for i, _, words in docs], "doc_id long, text string").repartition(2)
    b = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")

    def hit(n, words):
        window, item = min(n, 13), items[n]
        return any(sum(words[s + a + j] == item[a + j] for j in range(window) if 0 <= s + a + j < len(words)) >= window - (2 if n >= 10 else 0) for s in range(-n, len(words)) for a in range(n - window + 1))

    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()} == {(i, n) for i, n, words in docs if hit(n, words)}


def test_long_texts_and_frequent_seeds(spark):
    rng = random.Random(8)
    common = say(rng, 15, 5_000)
    items = [(i, common + " " + say(rng, 5, 5_000, "i")) for i in range(30)]
    docs = [(1, say(rng, 30_000, 5_000, "d") + " " + common), (2, common), (3, say(rng, 100, 5_000, "d"))]
    d, b = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()} == {(i, j) for i in (1, 2) for j in range(30)}


def crowd_of(n, seed=9):
    """One base text with edits: some pairs are close to each other only, some texts to many."""
    rng = random.Random(seed)
    base = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(n):
        t = base[:]
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            t[rng.randrange(60)] = f"p{i // 2 if rng.random() < 0.5 else 'x%d' % i}"
        rows.append((i, " ".join(t)))
    return rows


def brute_components(rows, part, words=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    grams = {g: k for k, g in enumerate({g for s in sets.values() for g in s})}
    ids = sorted(sets)
    x = np.zeros((len(ids), len(grams)), np.float32)
    for k, i in enumerate(ids):
        x[k, [grams[g] for g in sets[i]]] = 1
    both, size = x @ x.T, x.sum(1)
    linked = (both > 0) & (100 * both >= part * (size[:, None] + size[None, :] - both))
    out = {}
    for k, i in enumerate(ids):
        if i not in out:
            seen, new = np.zeros(len(ids), bool), np.arange(len(ids)) == k
            while new.any():
                seen |= new
                new = linked[new].any(0) & ~seen
            out |= {ids[j]: i for j in np.flatnonzero(seen)}
            out[i] = i
    return out


@pytest.mark.parametrize(("piece", "region"), [(512, 1024), (16, 20)])
def test_crowds_equal_brute_force(spark, monkeypatch, piece, region):
    """Also where the pieces of a crowd are so small that most links have to be found late."""
    rows = crowd_of(400)
    monkeypatch.setattr(neardup, "PIECE", piece)
    want = brute_components(rows, 85)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(d, part=85).collect()}
    assert got == want and 20 < len(set(want.values())) < 350


def test_late_links_alone(spark):
    """links_between finds every link by itself, without any component known before."""
    rows = crowd_of(300, 10)
    want = brute_components(rows, 85)
    sets = spark.createDataFrame([(i, kernels.shingle_sets([t], 5)[0].tobytes()) for i, t in rows], "id long, shingles binary")
    links = neardup.links_between(sets, spark.createDataFrame([], "id long, comp long"), 85, 100)
    comps = {r.id: r.comp for r in neardup.components(links).collect()}
    assert {i: comps.get(i, i) for i, _ in rows} == want


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(70)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for dense in (1, 5, 32):
        got = neardup.overlaps(sets, dense)
        np.fill_diagonal(got, 0)
        assert (got == np.array(want) - np.diag(np.diag(want))).all()


def test_lookup_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(shared, "HOT_KEYS", 2)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 12_000), (2, 5), (3, 1), (4, 2)) for i in range(n)], "k long, i long")
    found = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 4").withColumn("x", F.col("k") * 10)
    got = shared.lookup(rows, found.unionByName(spark.createDataFrame([(8, 0, 1), (9, 0, 1)], "k long, n long, x long")), "k", 12_008)
    assert {(r.k, r.x): r["count"] for r in got.groupBy("k", "x").count().collect()} == {(1, 10): 12_000, (2, 20): 5, (3, 30): 1}


def test_scratch_tables_go(spark):
    import os

    with shared.scratch():
        path = shared.materialise(spark.range(3), "gone").inputFiles()[0].removeprefix("file:").removeprefix("//").rpartition("/")[0]
        assert os.path.exists(path)
    assert not os.path.exists(path)


# ---- pipeline --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents (copies, shared lines, benchmark passages, junk, null and repeated ids), labels and benchmark."""
    rng = random.Random(11)
    items = [say(rng, 20, 3_000, "q") for _ in range(4)]
    shared_lines = "\n".join(say(rng, 6) for _ in range(4))
    docs = []
    for i in range(160):
        t = "\n".join(say(rng, rng.randint(5, 12), 2_000) for _ in range(rng.randint(3, 8)))
        if i % 8 == 1:
            t = docs[-1][1] if i % 16 == 1 else docs[-1][1] + " tail"
        elif i % 8 == 3:
            t += "\n" + shared_lines
        elif i % 8 == 5:
            t += "\n" + items[i % 4]
        elif i % 8 == 6:
            t = "### !!! $$$ " * rng.randint(5, 30)
        docs.append((i, t))
    docs += [(None, shared_lines), (None, items[0]), (170, None), (171, ""), (5, "\n".join(say(rng, 9) for _ in range(4))), (7, docs[7][1]), (172, say(rng, 9_000))]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "s%d" % k, 1) for k, (i, t) in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 6), int(i % 40 == 0)) for i in range(0, 160)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)) + [(9, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def rows_of(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text or "", r.lang, r.source) for r in df.collect())


def brute_lines(rows, window=3):
    """Rows in order of id; equal ids in order of nothing in particular, so tests give them different texts."""
    seen, out = {}, []
    texts = [(i, t.split("\n"), lang, s) for i, t, lang, s in rows]
    for i, ls, *_ in sorted((r for r in texts if r[0] != -1), key=lambda r: r[0]):
        for j in range(len(ls) - window + 1):
            seen.setdefault(tuple(ls[j : j + window]), (i, j))
    for i, ls, lang, s in texts:
        gone = set()
        for j in range(len(ls) - window + 1):
            if i != -1 and seen[tuple(ls[j : j + window])] != (i, j):
                gone |= set(range(j, j + window))
        out.append((i, "\n".join(x for j, x in enumerate(ls) if j not in gone), lang, s))
    return sorted(out)


def brute_contaminated(text, items):
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    for item in items:
        w = item.split()
        span = min(13, len(w))
        for s in range(-len(w), len(words)):
            eq = [0 <= s + j < len(words) and words[s + j] == w[j] for j in range(len(w))]
            if any(sum(eq[a : a + span]) >= span - 2 for a in range(len(w) - span + 1)):
                return True
    return False


def test_pipeline_stages_equal_brute_force(spark, corpus):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    before = rows_of(docs)
    score = {(r.doc_id, round(r.score, 9)) for r in quality.score_quality(docs, spark.read.parquet(f"{corpus}/labels.parquet")).collect()}
    bad = {i for i, s in score if s < 0.3 and i is not None}
    kept = shared.materialise(stages["quality"](spark, docs, corpus), "stage")
    assert rows_of(kept) == [r for r in before if r[0] not in bad] and {i for i in range(160) if i % 8 == 6} <= bad and len(bad) < 40
    # A row that repeats an id and a text is a later occurrence of itself; leave that case to the test of the operator.
    once = kept.where("NOT (doc_id = 7 AND source <> 's7')")
    lined = shared.materialise(stages["line_dedup"](spark, once, corpus), "stage")
    assert rows_of(lined) == brute_lines(rows_of(once))
    assert lined.where("n_chars <> length(text)").count() == 0
    near = shared.materialise(stages["near_dedup"](spark, lined, corpus), "stage")
    known = [r for r in rows_of(lined) if r[0] != -1]
    comps = brute_components(list({r[0]: r[1] for r in known if [x[0] for x in known].count(r[0]) == 1}.items()), 80)
    twice = {r[0] for r in known if [x[0] for x in known].count(r[0]) > 1}
    assert rows_of(near) == [r for r in rows_of(lined) if r[0] == -1 or r[0] in twice or comps[r[0]] == r[0]]
    clean = shared.materialise(stages["decontamination"](spark, near, corpus), "stage")
    items = [r.text for r in spark.read.parquet(f"{corpus}/benchmark.parquet").where("text IS NOT NULL").collect()]
    dirty = {r[0] for r in rows_of(near) if r[0] != -1 and brute_contaminated(r[1], items)}
    assert rows_of(clean) == [r for r in rows_of(near) if r[0] not in dirty] and len(dirty) > 5
    mixed = stages["mixing"](spark, clean, corpus).toPandas()
    assert sorted(mixed.n_tokens) == sorted(len(WORD.findall(r[1])) for r in rows_of(clean))
    p, n = np.stack(mixed.posterior), mixed.n_tokens.to_numpy(float)
    names = sorted(set(mixed.domain) | {"q1t0", "q1t1"})[: p.shape[1]]
    goal = np.array([queries.TARGETS[d] for d in names])
    if p.shape[1] == 2:
        assert np.allclose(mixed.rate, brute_rates(p, n, goal / goal.sum()), atol=2e-3)
    assert (mixed.rate >= 0).all()
    assert corpus_pipeline.run(spark, corpus).count() >= len(mixed) - 2


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, corpus, name):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, corpus).count() == 0


def test_operators_ignore_extra_columns(spark):
    rng = random.Random(12)
    rows = [(i, say(rng, 30)) for i in range(12)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["k", "fp", "n", "part", "bucket", "h1", "at", "row_key", "lines", "seed", "domain", "stats", "sig", "id", "next", "copies", "edited"]
    more = plain.withColumns({c: F.lit(1) for c in names})
    labels = spark.createDataFrame([(i, i % 2, 0, "d%d" % (i % 2)) for i in range(12)], "doc_id long, quality int, toxic int, domain string")
    items = spark.createDataFrame([(1, rows[3][1])], "item_id long, text string")
    same = lambda f: sorted(map(str, f(plain).collect())) == sorted(map(str, f(more).collect()))
    mixed = lambda d: mixing.mix_sources(d, labels, {"d0": 0.5, "d1": 0.5}).select("doc_id", "n_tokens", "domain", F.round("rate", 4))
    for f in (substrings.dedup_substrings, lines.dedup_lines, lambda d: decontaminate.contaminated(d, items), lambda d: quality.score_quality(d, labels), mixed):
        assert same(f), f(more).columns


def test_digest_columns(spark, sf_dir):
    """op1's digest of the edited text, from brute force."""
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    want = {i: hashlib.sha256((t[: len(t) - len(t) // 3] + rows[(k + 1) % len(rows)][1][: len(t) // 3]).encode()).hexdigest() for k, (i, t) in enumerate(rows)}
    got = queries.op1_fingerprints(spark, sf_dir).collect()
    assert {r.doc_id: r.edited_sha256 for r in got} == want
    sample = rng_sample(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t in sample:
        assert by_id[i].fingerprint == "".join("----" if v < 0 else f"{v:04x}" for v in brute_fingerprint(t))


def rng_sample(rows):
    return [r for r in random.Random(1).sample(rows, 25) if len(r[1]) < 20_000]
