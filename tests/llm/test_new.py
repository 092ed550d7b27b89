"""Exact dedup, hard negatives and phrases against plain versions on small tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidline.llm import exact_dedup, hard_negatives, phrases
from braidline.llm.exact_dedup import DigestIndex, dedup_exact

LOWER = {c: c + 32 for c in range(65, 91)}
plain = lambda text: re.sub("[\x20\x09-\x0d]", "", text or "")

DOCS = [
    (7, "a b\tc"), (3, "ab c"), (9, " a b  c\n"), (4, " a b  c\n"), (1, None), (2, ""), (5, " \n"), (None, "abc"), (8, "ABC"), (6, "a bc"), (6, "a bc"), (6, "a bc"),
    (10, "long " * 30_000), (11, "long" * 30_000), (12, "\U0001f600 x"), (13, "\U0001f600x"),
]


def groups_by_hand(rows):
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(plain(t), []).append((-len(t or ""), d is None, d, i))
    out = Counter()
    for text, members in groups.items():
        first = min(members, key=lambda m: (m[0], m[1], m[2] or 0, m[3]))
        for m in members:
            out[m[2], first[2], len(members), m is first, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def test_exact_dedup_by_hand(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = Counter(tuple(r) for r in dedup_exact(docs.repartition(3), keep=["doc_id"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == groups_by_hand(DOCS)


def test_exact_dedup_hot_groups(spark, monkeypatch):
    """A text that a third of all rows share goes the way of broadcast keys, and the results are the same."""
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 20)
    rows = [(i, "the same text" + " " * (i % 5) if i % 3 == 0 else f"text {i % 150}") for i in range(600)]
    got = Counter(tuple(r) for r in dedup_exact(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == groups_by_hand(rows)


def test_exact_dedup_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "x", 1, 2), ("a", "x", 3, 4)], "doc_id string, text string, digest int, Keep_Id int").withColumn("own.row", F.lit(5))
    rows = dedup_exact(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r.digest, r["own.row"], r.keep_id, r.kept) for r in rows] == [("a", "x", 3, 5, "a", True), ("b", "x", 1, 5, "a", False)]
    assert dedup_exact(docs.limit(0)).collect() == []


def test_digest_index_lasts(spark, tmp_path, monkeypatch):
    """A second call over an index that was opened anew drops what the first one kept; merging changes nothing; half a segment is ignored."""
    path = str(tmp_path / "index")
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = dedup_exact(table([(1, "a"), (2, "b b"), (3, "bb")]), index=DigestIndex(spark, path, 3)).collect()
    assert {(r.doc_id, r.kept) for r in first} == {(1, True), (2, True), (3, False)}
    (tmp_path / "index" / "segment-90-3").mkdir()
    again = DigestIndex(spark, path)
    assert again.buckets == 3 and again.rows().count() == 2
    monkeypatch.setattr(exact_dedup, "SEGMENTS", 2)
    second = dedup_exact(table([(4, "   b b   "), (5, "c"), (6, "a")]), index=again).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in second} == {(4, 2, 1, False), (5, 5, 1, True), (6, 1, 1, False)}
    assert len(again.segments) == 1 and DigestIndex(spark, path).rows().count() == 3


def test_digest_index_joins_without_exchange_or_sort(spark, tmp_path):
    """Batches and segments meet bucket by bucket, in their stored order."""
    index = DigestIndex(spark, str(tmp_path / "index"), 4)
    batch = lambda a, b: spark.range(a, b).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("digest"), F.lit(1).alias("load"), F.col("id").alias("keep_row"), F.col("id").alias("keep_id"), F.lit(1).alias("chars"), F.lit(1).alias("n"))
    index.add(batch(0, 50))
    met = index.add(batch(30, 90))
    with exact_dedup._sorted_scans(spark):
        joined = met.join(index.segments[0][1].select("digest").hint("merge"), "digest", "left_anti")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 40
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert index.rows().count() == 90


def negatives_by_hand(rows, positives=5, negatives=10):
    """rows: (vec_id, label, vector), those that take part; the anchor is a row."""
    made = [(i, d, label, [int(np.floor(256 * float(x))) for x in v]) for i, (d, label, v) in enumerate(rows)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = Counter()
    for i, d, label, v in made:
        if d % 100:
            continue
        scored = sorted(((-dot(v, w), e, j, lab) for j, e, lab, w in made), key=lambda x: x[:3])
        for s, p, _, _ in [x for x in scored if x[3] == label and x[1] != d][:positives]:
            fits = [x for x in scored if x[3] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            for rank, (t, e, _, _) in enumerate(fits, 1):
                out[d, p, rank, e, -s, -t] += 1
    return out


def mined(spark, rows):
    table = spark.createDataFrame([(d, label, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for d, label, v in rows], "vec_id long, label int, embedding array<float>, score string, cluster int")
    return Counter(tuple(r) for r in hard_negatives.mine(table, F.col("vec_id") % 100 == 0).collect())


def vectors(n, width=6, seed=1, around=None):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(around, width)) if around else np.zeros((1, width))
    v = base[draw.integers(0, len(base), n)] + draw.normal(size=(n, width)) * (0.05 if around else 1)
    return [(i, int(x), [float(np.float32(c)) for c in w]) for i, (x, w) in enumerate(zip(draw.integers(0, 4, n), v, strict=True))]


@pytest.mark.parametrize("rows", [vectors(900), vectors(1200, around=12, seed=2), vectors(40, seed=3)], ids=["spread", "clustered", "few"])
def test_hard_negatives_by_hand(spark, rows):
    assert mined(spark, rows) == negatives_by_hand(rows)


def test_hard_negatives_ties_repeats_and_hot_vectors(spark, monkeypatch):
    """A third of the rows are one vector, another third two; blocks and groups are small, so lists and anchors are split."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 32)
    monkeypatch.setattr(hard_negatives, "GROUP", 4)
    monkeypatch.setattr(hard_negatives, "FIRST", 1)
    monkeypatch.setattr(hard_negatives, "GROWTH", 2)
    rows = [(i, i % 3, [1.0, 0.5] if i % 3 else v[2][:2]) for i, v in enumerate(vectors(700, seed=4))]
    rows += [(i + 1000, i % 2, [0.8, 0.1]) for i in range(300)] + [(500, 1, [0.9, 0.9]), (500, 1, [0.9, 0.9]), (650, 0, [1.0, 1.0]), (650, 0, [1.0, 1.0])]
    assert mined(spark, rows) == negatives_by_hand(rows)


def test_hard_negatives_odd_rows(spark):
    odd = [(200, None, [1.0]), (300, 1, None), (400, 1, [float("nan"), 1.0]), (500, 1, [float("inf")]), (600, 1, [None, 1.0]), (None, 1, [1.0])]
    fine = [(0, 1, [1.0, 1.0]), (1, 1, [1.0]), (2, 2, [0.5, 0.5, 3.0]), (3, 2, []), (4, 1, [-1.0, -1.0]), (100, 3, [0.0, 0.0]), (101, 3, [9.0, 0.0]), (700, 4, [1.0, 2.0]), (5, 2, [0.9, 0.1])]
    assert mined(spark, odd + fine) == negatives_by_hand(fine)
    assert mined(spark, odd) == mined(spark, []) == Counter()


def test_hard_negatives_skip_lists(spark):
    """With clusters far apart an anchor reads few lists: bounds and not the sizes of the table decide."""
    rows = vectors(2000, around=20, seed=5)
    table = spark.createDataFrame([(i, d, label, [int(np.floor(256 * x)) for x in v]) for i, (d, label, v) in enumerate(rows)], "row long, vec_id long, label long, vector array<long>")
    lists, blocks, centers, radius = hard_negatives.build(table)
    at = {d: v for d, _, v in rows}
    q = np.array([int(np.floor(256 * x)) for x in at[0]], float)
    for r in lists.collect():
        assert abs(float(q @ np.array(r.vector)) - float(q @ centers[r.cluster])) <= np.sqrt(q @ q) * radius[r.cluster] + 1e-3
    best = np.sort(q @ np.array([r.vector for r in lists.collect()], float).T)[-5]
    assert ((q @ centers.T + np.sqrt(q @ q) * radius) >= best).sum() < len(centers) / 2


def collocations_by_hand(rows, least, first=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for i in range(len(w)):
                for k in range(1, min(5, len(w) - i) + 1):
                    f.setdefault(lang or "und", Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        rows = []
        for p, a in some.items():
            if any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in some.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:first], 1)]
    return sorted(out)


TEXTS = [
    ("en", "a a a a a. A\ta  a"), ("en", "x y z, x y z; x y z! x y\nz x\x0by"), ("de", "Über den Fluß über den Fluß Über den"), (None, "x y x y x y x y"), ("und", "x y"), ("en", None), (None, None), ("de", ""),
    ("en", "a b c a b c d"), ("en", "tail of a text\r\ntail of a text"), ("fr", "水 火 水 火 \U0001f600 水 火"), ("en", "a b c d e f " * 400), ("en", "w" * 100_000 + " x y z"), ("it", "\x1c \x1f \x1c \x1f"),
]


@pytest.mark.parametrize("least", [1, 2, 5])
def test_phrases_by_hand(spark, least):
    table = spark.createDataFrame([(*r, 1, "p") for r in TEXTS], "lang string, text string, n int, Phrase string").repartition(3)
    assert sorted(tuple(r) for r in phrases.mine(table, least).collect()) == collocations_by_hand(TEXTS, least)


def test_phrases_many_shards_and_false_candidates(spark, monkeypatch):
    """Tiny shards and sketches so small that nearly every phrase passes: counts still are exact."""
    draw = np.random.default_rng(6)
    rows = [(("en", "de")[i % 2], " ".join(f"w{x}" for x in draw.zipf(1.5, 60) % 50)) for i in range(200)]
    monkeypatch.setattr(phrases, "FEW", 5)
    assert sorted(tuple(r) for r in phrases.mine(spark.createDataFrame(rows, "lang string, text string"), 8, 40).collect()) == collocations_by_hand(rows, 8, 40)


def test_phrases_of_nothing(spark):
    assert phrases.mine(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert phrases.mine(spark.createDataFrame([(None, None)], "lang string, text string")).collect() == []


def test_sketches_never_fall_short(spark):
    docs = spark.createDataFrame([(r[0] or "und", r[1] or "") for r in TEXTS], "lang string, text string")
    full = phrases.phrase_counts(docs, 3)[0]
    assert {(r.lang, r.phrase): r.f for r in full.where("k = 1").collect()}["en", "a"] >= 400
