"""The operators over texts against brute force, with awkward rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.oracle import compare
from tidemark.llm import decontaminate, fingerprints, language, lines, neardup, queries, quality, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string"


def corpus(seed=3):
    """Copies, near copies, shared passages, nulls, empties, short and long texts, odd characters; `part` clashes with an inner name."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ÀB", "Abc", "日本", "😀x"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, texts = say(60), [None, "", " \t\n", "one", "one two three four", "ONE two three four", "same " * 700]
    base = say(120).split()
    for i in range(40):
        t = base[:]
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = "x%d" % rng.randint(0, 9)
        texts += [" ".join(t), say(rng.randint(1, 80)) + ("\n" + passage + "\n" if i % 4 == 0 else " ") + say(rng.randint(1, 60))]
    texts += texts[8:20] + [say(9000)]
    return [(i * 7 % 1009, t, "en", "s", 1, "p") for i, t in enumerate(texts)] + [(None, passage, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


def test_substrings(docs):
    got = {r.doc_id: r for r in substrings.dedup_substrings(docs).collect()}
    rows = {r[0]: WORD.findall(r[1] or "") for r in corpus()}
    first = {}
    for i in sorted(k for k in rows if k is not None):
        for j in range(len(rows[i]) - 12):
            first.setdefault(tuple(rows[i][j : j + 13]), i)
    assert set(got) == set(rows)
    for i, w in rows.items():
        gone = set()
        for j in range(len(w) - 12):
            if i is not None and first[tuple(w[j : j + 13])] < i:
                gone |= set(range(j, j + 13))
        assert got[i].n_words == len(w) and got[i].n_removed == len(gone)
        assert got[i].text == " ".join(x for j, x in enumerate(w) if j not in gone)
    assert sum(r.n_removed for r in got.values()) > 1000


def test_substring_levels_agree(docs):
    a, b = (substrings.dedup_substrings(docs, x).orderBy("doc_id", "text").collect() for x in ((7, 13), (4, 7, 13)))
    assert a == b
    with pytest.raises(ValueError):
        substrings.dedup_substrings(docs, (3, 13))


def brute_components(part):
    sets = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t, *_ in corpus():
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(up)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


@pytest.mark.parametrize("crowd", [32, 4])
def test_near_duplicates(docs, monkeypatch, crowd):
    monkeypatch.setattr(neardup, "CROWD", crowd)
    want, sets = brute_components(85)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, part=85).collect()}
    assert got[None].component_id is None
    assert {i: got[i].component_id for i in want} == want
    assert all(got[i].n_shingles == len(s) for i, s in sets.items())


def test_regions_cut_large_runs(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(neardup, "REGION", 10)
    batch = pa.record_batch({"tree": pa.array([0] * 40 + [1] * 55), "id": pa.array(range(95)), "sig": pa.array([b"x"] * 95)})
    found = [ids for ids, _ in neardup.regions([batch.slice(0, 50), batch.slice(50)], 1)]
    assert sum(found, []) == list(range(95)) and all(len(x) <= 10 for x in found)
    assert all({i < 40 for i in x} in ({True}, {False}) for x in found)


def test_lines(docs):
    text = lambda *x: "\n".join(x)
    d = docs.sparkSession.createDataFrame([(1, text("a", "b", "c", "d"), "q"), (2, text("x", "a", "b", "c", "d", "y"), "q"), (3, text("a", "b"), "q"), (4, None, "q"), (5, "", "q"), (6, text(*["z"] * 6), "q"), (None, text("a", "b", "c"), "q")], "doc_id long, text string, at string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(d).collect()}
    assert got == {1: ("a\nb\nc\nd", 4, 0), 2: ("x\ny", 6, 4), 3: ("a\nb", 2, 0), 4: ("", 1, 0), 5: ("", 1, 0), 6: ("z", 6, 5), None: ("a\nb\nc", 3, 0)}


def test_masks_hit_all_windows():
    from itertools import combinations

    for bad in combinations(range(13), 2):
        assert any(not any(s + i in bad for i, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for s in range(14 - len(m)))


def test_contamination(spark):
    rng = random.Random(5)
    say = lambda n: [f"v{rng.randrange(4000)}" for _ in range(n)]
    items = {1: say(30), 2: say(13), 3: say(6), 4: [], 5: say(40)}
    one, two = items[1][:], items[2][:]
    two[3], two[8] = "changed", "other"
    docs = [(1, say(20) + one + say(5)), (2, two), (3, say(5) + items[3] + say(5)), (4, say(50)), (5, items[1][:12] + say(9)), (6, say(5) + items[5][20:33]), (7, [x.upper() + "," for x in items[2]]), (8, items[2][:10] + ["a", "b", "c"])]
    d = spark.createDataFrame([(i, " ".join(t), 0) for i, t in docs] + [(None, " ".join(one), 0), (9, None, 0)], "doc_id long, text string, seed int")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()] + [(6, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (5, 1), (6, 5), (7, 2)}
    assert {r.doc_id for r in decontaminate.decontaminate(d, b).collect()} == {4, 8, 9, None}
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 == decontaminate.contaminated(d, b.limit(0)).count()


def brute_fingerprint(text, k=3):
    """Which (k-mer, occurrence) pairs there are, in order."""
    w = WORD.findall(text or "")
    seen, out = {}, []
    for i in range(max(1, len(w) - k + 1) if w else 0):
        g = tuple(w[i : i + k])
        out.append((g, seen.setdefault(g, 0)))
        seen[g] += 1
    return out


def test_fingerprints(docs):
    rows = sorted(((i, t or "") for i, t, *_ in corpus() if i is not None), reverse=True) + [(None, [t for i, t, *_ in corpus() if i is None][0])]
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    by_text = {}
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        cut = len(t) // 3
        edited, r = t[: len(t) - cut] + after[:cut], got[i]
        assert (r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest()) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint and by_text.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        parts = lambda s: [s[j : j + 4] for j in range(0, len(s), 4)]
        a, b = parts(r.fingerprint), parts(r.edited_fingerprint)
        assert r.near_edited == pytest.approx(sum(x == y for x, y in zip(a, b, strict=True)) / len(a))
        assert ("----" in a) == (not brute_fingerprint(t))


def test_fingerprints_see_order(spark):
    a = [f"w{i}" for i in range(400)]
    moved = a[200:] + a[:200]
    cut = a[:380]
    d = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(moved)), (3, " ".join(cut))], "doc_id long, text string")
    f = {r.doc_id: r.fp for r in fingerprints.fingerprints(d, "doc_id").collect()}
    like = lambda x, y: sum(p == q for p, q in zip(x, y, strict=True)) / len(x)
    # The same k-mers in another order are less alike than a small cut.
    assert like(f[1], f[3]) > 0.8 > like(f[1], f[2]) > 0.2


def test_language_and_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = language.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.98
    q = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out")
    assert q.agg(F.avg(((F.col("score") >= 0.3) == (F.col("quality") == 1)).cast("int"))).first()[0] > 0.95


def test_language_and_quality_odd_rows(docs):
    spark = docs.sparkSession
    rows = {r.doc_id: r for r in language.identify_language(docs).collect()}
    assert rows[0].lang_pred == "und" and rows[0].score == 0 and rows[7].lang_pred == "und"
    assert {r.lang_pred for r in language.identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert language.identify_language(docs.limit(0)).count() == 0 == quality.score_quality(docs.limit(0), none).count()


@pytest.mark.parametrize("f", [substrings.dedup_substrings, neardup.near_duplicates, lines.dedup_lines, fingerprints.fingerprint_edits])
def test_empty_table(docs, f):
    assert f(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    compare(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])
