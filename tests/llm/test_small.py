"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, brute force."""

import hashlib
import re
import zlib
from collections import Counter
from math import log, log10, sqrt

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from braidline.llm import decontaminate, hmm, html_text, language, licenses, line_dedup, packing, quality, simhash, token_counts
from braidline.llm.common import byte_text, components, words_of

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
#: Names that operators use inside.
CLASHING = ["row", "ROW2", "marks", "w", "g", "k0", "set", "h1", "pos", "gated", "at", "near", "a.b", "tick`s", "window", "m", "owner", "gone", "group"]
TEXTS = [
    None,
    "",
    " \n\t ",
    "One short line.\nA line that is long enough\nOne short line.\nÄpfel und Öl für alle",
    "A LINE that is long enough  \nsomething else that is long\nx",
    "a line that is long enough",
    "a line that is long enough",
    "Licensed under CC BY-NC 4.0. All rights reserved. cc by cc by",
    LONG,
    LONG + " tail",
    "the quick brown fox jumps over the lazy dog and runs away from it all",
    "é É \x0b ÀB ab\x0cCD K ﬁ 日本語 テスト",
    "general public\tLICENSE; gnu General-Public license v3",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "h" if i % 3 else None, None) for i, t in enumerate(TEXTS)]
    rows += [(None, "A line that is long enough\nmine", "fr", None, 1), (4, TEXTS[4], "de", "h", 2), (3, "other text under the same id that is long", "en", "g", 3)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_byte_text_keeps_what_ascii_lowering_keeps(spark):
    rows = ["É", "é", "Ã©", "ã©", "AB", "ab", "K", "k", "İ", "ı", "ß", "SS", "Ã©", "À", "à", "Ǆ", "ǆ"]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select("t", byte_text(F.col("t")).alias("b"), words_of(F.col("t")).alias("w")).collect()
    for x in df:
        assert len(x.w) == len(words(x.t))
        for y in df:
            assert (x.b == y.b) == (x.t.translate(LOWER) == y.t.translate(LOWER)), (x.t, y.t)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 300), (7, 7)] + [(500, 600 + i) for i in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 200: 100, 300: 100, 500: 500} | {600 + i: 500 for i in range(50)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_line_dedup(spark, docs, empty):
    assert line_dedup.dedup_lines(empty).count() == 0
    owner = {}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10 and d is not None:
                owner[key(line)] = min(d, owner.get(key(line), d))
    want = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner.get(key(x), d) == d]
        want.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    clash = docs.withColumns({c: F.lit("x") for c in CLASHING}).withColumn("n_lines", F.lit("x"))
    for df, batches in ((docs, 1), (clash, 3), (docs.withColumn("n", F.lit(1)), 40)):
        out = line_dedup.dedup_lines(df, batches=batches)
        assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_lines, r.n_dropped, r.text)) for r in out.collect())


@pytest.mark.parametrize("kind", ["string", "date", "decimal(20,2)", "double"])
def test_line_dedup_takes_ids_of_any_order(spark, kind):
    rows = [(f"2024-01-{d + 10}" if kind == "date" else str(d + 10), f"own line number {d}\na line that all of them share") for d in range(20)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    out = sorted((str(r.doc_id), r.n_dropped) for r in line_dedup.dedup_lines(df).collect())
    assert [n for _, n in out] == [0, *[1] * 19]


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, "quick brown fox JUMPS over the lazy dog and runs away from nothing"), (12, "quick brown fox jumps over the lazy dog and runs"), (2, "lazy dog"), (3, None), (4, "..."), (5, " ".join(f"w{i % 977}x{i % 31}" for i in range(400, 460))), (6, "K")], "item_id bigint, text string")
    windows = {}
    for r in bench.collect():
        w = words(r.text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(r.item_id)

    def want(text):
        w = words(text)
        hit, items = set(), set()
        for win, found in windows.items():
            n = len(win)
            for i in range(len(w) - n + 1):
                if w[i : i + n] == list(win):
                    hit |= set(range(i, i + n))
                    items |= found
        return len(w), len(hit), sorted(map(str, items))

    clash = docs.withColumns({c: F.lit("x") for c in CLASHING}).withColumns({"n_words": F.lit("x"), "n_hit": F.lit("x")})
    found = decontaminate.decontaminate(clash, bench)
    assert set(CLASHING) <= set(found.columns)
    out = found.collect()
    assert all(r[c] == "x" for r in out for c in CLASHING)
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in out) == sorted(str((r.doc_id, *want(r.text))) for r in docs.collect())
    assert decontaminate.decontaminate(empty, bench).count() == 0
    clean = decontaminate.decontaminate(docs, bench.where("item_id < 0")).collect()
    assert all(r.n_hit == 0 for r in clean) and len(clean) == docs.count()


def test_license_base_places(docs, empty):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    out = {str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)): r for r in licenses.scan_licenses(docs.withColumns({c: F.lit("x") for c in [*CLASHING, "n_base", "labels", "score"]})).collect()}
    assert all(r[c] == "x" for r in out.values() for c in CLASHING)
    for r in docs.collect():
        w = words(r.text)
        places = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        want = str((r.doc_id, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
        assert want in out, want
        assert set(out[want].base_labels.split(",")) - {""} <= set(out[want].labels.split(","))
    assert licenses.scan_licenses(empty).count() == 0


def sample_of(pattern):
    """A text that a rule's pattern matches: first alternatives, optional parts left out, any word where any may stand."""
    pattern = pattern.replace("(?:[^ ]+ ){0,5}?", "any ")
    while (new := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", lambda m: "" if m.group().endswith("?") else m.group(1), pattern)) != pattern:
        pattern = new
    pattern = re.sub(r"\[(.)[^]]*\](\?)?", lambda m: "" if m.group(2) else m.group(1), pattern)
    return re.sub(r"\\d", "9", re.sub(r"(.)\?", "", pattern)).replace("  ", " ").strip()


def test_every_rule_is_found_through_the_gate(spark):
    rules = licenses.signature_rules()
    assert len(rules) > 300 and len({r[4] for r in rules}) > 300
    rows = [(i, sample_of(r[4]), r[5]) for i, r in enumerate(rules)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label string")
    found = {r.doc_id: r.labels for r in licenses.scan_licenses(df.drop("label")).collect()}
    missed = [(t, label, found[i]) for i, t, label in rows if not found[i]]
    assert not missed


def test_license_suppression(spark):
    df = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0."), (2, "mit und mit"), (3, "GNU General Public License, version 3")], "doc_id bigint, text string")
    labels = {r.doc_id: r.labels for r in licenses.scan_licenses(df).collect()}
    assert labels == {1: "apache-2.0", 2: "", 3: "gpl,gpl-3"}  # base labels stay


def brute_components(fps, r):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= r:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def brute_fingerprint(text, k):
    w = tokens(text)
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, empty, sf_dir):
    more = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang", "source", "n_chars")
    rows = docs.union(more)
    data = rows.collect()
    fps = [brute_fingerprint(r.text, 4) for r in data]
    group = brute_components(fps, 4)
    first = {}
    for r, g in zip(data, group, strict=True):
        if r.doc_id is not None:
            first[g] = min(r.doc_id, first.get(g, r.doc_id))
    want = sorted(str((r.doc_id, f"{f:016x}", first.get(g))) for r, f, g in zip(data, fps, group, strict=True))
    assert want == sorted(str(tuple(r)) for r in simhash.simhash_classes(rows).collect())
    assert simhash.simhash_classes(empty).count() == 0


@pytest.mark.parametrize("n, hot", [(3000, 4096), (40, 4096), (900, 60)])
def test_fingerprint_links_are_complete(spark, n, hot):
    rng = np.random.default_rng(n)
    fps = {int(x) for x in rng.integers(0, 1 << 64, n, dtype=np.uint64)}
    for x in list(fps)[: n // 10]:  # chains and dense balls
        for _ in range(8):
            x ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
            fps.add(x)
    centre = next(iter(fps))
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp bigint")
    links = simhash.link_fingerprints(nodes, 4, hot)
    assert links.count() < (60 if hot > 100 else 500) * len(fps)
    roots = {r.node: r.root for r in components(links).collect()}
    group = brute_components(fps, 4)
    mine = [roots.get(simhash._signed(x), simhash._signed(x)) for x in fps]
    assert len(set(zip(mine, group, strict=True))) == len(set(mine)) == len(set(group))


def shingle_set(text, k=5):
    w = tokens(text)
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or ({" ".join(w)} if w else set())


def test_near_documents(spark, empty, sf_dir):
    data = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rng = np.random.default_rng(1)
    rows = [(r.doc_id, r.text) for r in data]
    for r in data[:60]:
        w = r.text.split(" ")
        for i in rng.integers(0, len(w), max(1, len(w) // 150)):
            w[i] = "edited"
        rows.append((r.doc_id + 10_000, " ".join(w)))
    rows += [(20_000, None), (20_001, "")]
    sets = [shingle_set(t) for _, t in rows]
    got = {r.doc_id: r.component_id for r in simhash.near_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = {d: min(rows[k][0] for k in range(len(rows)) if find(k) == find(i)) for i, (d, _) in enumerate(rows)}
    assert got == want
    assert simhash.near_documents(empty).count() == 0


def test_repeated_phrases_do_not_part_copies(spark):
    """Shingles that are repeated inside a text count once: all pairs of a band are verified but those whose sizes are too unlike."""
    base, rows = [f"w{i}" for i in range(800)], []
    for d in range(6):
        phrase = " ".join([" ".join(f"r{d}x{i}" for i in range(5))] * 40)
        rows.append((d, " ".join(base) + (" " + phrase if d else "")))
    sets = [shingle_set(t) for _, t in rows]
    assert all(len(a & b) >= 0.95 * len(a | b) for a in sets for b in sets)
    got = {r.doc_id: r.component_id for r in simhash.near_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(got.values()) == {0}


def test_drop_copies_keeps_one_row_of_each_class(spark, empty):
    """Repeated rows, copies under one id, classes without any id."""
    texts = [" ".join(f"t{n}x{i}" for i in range(200)) for n in range(5)]
    near = texts[0].replace("t0x7 ", "edited ")
    rows = [(1, texts[0], "en", "b", 1), (1, texts[0], "en", "a", 1), (1, near, "en", "a", 1), (2, texts[0], "en", "a", 1), (1, texts[1], "en", "a", 1)]
    rows += [(None, texts[2], "en", "a", 1), (None, texts[2], "en", "a", 1), (None, texts[3], "en", "a", 1), (None, texts[4], "en", "a", 1), (7, texts[4], "en", "a", 1)]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()]
    of = {texts[0]: 0, near: 0} | {t: n for n, t in enumerate(texts) if n}
    assert sorted(((of[t], d) for d, t in got), key=str) == [(0, 1), (1, 1), (2, None), (3, None), (4, 7)]
    assert corpus_pipeline.drop_copies(spark, empty, "").count() == 0


def test_drop_copies_links_by_simhash(spark):
    """Copies whose fingerprints agree are one class, also where their sets are less alike than 0.8: here what repeats outweighs what differs."""
    body = " ".join([" ".join(f"r{i}" for i in range(41))] * 60)
    rows = [(d, body + " " + " ".join(f"d{d}x{i}" for i in range(30)), "en", "a", 1) for d in range(3)]
    rows.append((3, " ".join(f"o{i}" for i in range(900)), "en", "a", 1))
    sets = [shingle_set(r[1]) for r in rows]
    assert all(len(a & b) < 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    fps = [simhash.fingerprint(simhash.hashes(r[1], 4)) for r in rows]
    assert all((fps[0] ^ x).bit_count() <= 4 for x in fps[:3]) and all((fps[3] ^ x).bit_count() > 4 for x in fps[:3])
    docs = spark.createDataFrame(rows, DOCS)
    want = {r.component_id for r in simhash.simhash_classes(docs).collect()}
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()) == sorted(want) == [0, 3]


def band_classes(rows):
    """The smallest doc_id of each row's class, by comparing every pair that shares a min-hash band."""
    sets = [np.unique(simhash.hashes(t, 5)) for _, t in rows]
    bands = [simhash._bands(s)[0] if len(s) else [0] for s in sets]
    keys = {}
    for i, b in enumerate(bands):
        for k in b:
            keys.setdefault(k, []).append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in {(i, j) for m in keys.values() for n, j in enumerate(m) for i in m[:n]}:
        if find(i) != find(j):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= 0.8 * max(1, len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    first = {}
    for i, (d, _) in enumerate(rows):
        first[find(i)] = min(d, first.get(find(i), d))
    return {d: first[find(i)] for i, (d, _) in enumerate(rows)}


def test_documents_of_shared_chapters(spark, monkeypatch):
    """All choices of 15 of 18 chapters: each is alike to 45 others, hardly any two to one centre, and all share their bands."""
    from itertools import combinations

    monkeypatch.setattr(simhash, "CUT", 128)
    chapters = [" ".join(f"c{c}w{i}" for i in range(30)) for c in range(18)]
    rows = [(d, " ".join(chapters[c] for c in chosen)) for d, chosen in enumerate(combinations(range(18), 15))]
    got = {r.component_id for r in simhash.near_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {0}


@pytest.mark.parametrize("edits, back", [(4, 1), (6, 600)])
def test_chains_and_trees_of_copies(spark, monkeypatch, edits, back):
    """Each copy is edited from one of the `back` before it: few are alike to a common centre, and no link is lost."""
    monkeypatch.setattr(simhash, "CUT", 64)
    rng = np.random.default_rng(edits)
    texts = [[f"w{i}" for i in range(300)]]
    for d in range(1, 600):
        w = list(texts[rng.integers(max(0, d - back), d)])
        for i in rng.choice(300, edits, replace=False):
            w[i] = f"e{d}x{i}"
        texts.append(w)
    rows = [(d, " ".join(w)) for d, w in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in simhash.near_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == band_classes(rows)


def test_many_edited_copies_of_one_document(spark):
    """Copies that are alike to their original, hardly to each other, in keys of many members."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(300)]
    rows = [(500, " ".join(base))]
    for d in range(400):
        w = list(base)
        for i in rng.choice(300, 5, replace=False):
            w[i] = f"e{d}x{i}"
        rows.append((d, " ".join(w)))
    rows += [(1000 + d, " ".join(f"o{d}y{i}" for i in range(100))) for d in range(50)]
    near = {d for d, t in rows if len(shingle_set(t) & shingle_set(rows[0][1])) >= 0.8 * len(shingle_set(t) | shingle_set(rows[0][1]))}
    got = {r.doc_id: r.component_id for r in simhash.near_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(near) > 300 and sum(got[d] == got[500] for d in near) >= 0.99 * len(near)
    assert all(got[d] == d for d in range(1000, 1050))


def repeated_by_hand(w):
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return len({j for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})


def test_quality(docs, empty):
    assert quality.quality_rules(empty).count() == 0
    out = quality.quality_rules(docs.withColumn("kept", F.lit(1)).withColumn("host__x", F.lit(1)), keep=["doc_id", "text"]).collect()
    assert len(out) == docs.count()
    for r in out:
        w = re.findall("[^\x20\x09-\x0d]+", r.text or "")
        wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = {j for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (r.text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(rep), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 10 or 100 * len(rep) > 20 * len(w))


def test_host_verdict_reaches_documents(spark):
    good = " ".join(f"good{i}" for i in range(40))
    rows = [(i, good + str(i), "en", "fine", 1) for i in range(60)] + [(100 + i, "bad", "en", "awful", 1) for i in range(200)] + [(400, good, "en", "awful", 1), (401, good, "en", "new", 1)]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, DOCS), keep=["doc_id"]).collect()}
    assert kept[0] and kept[401] and not kept[400] and not kept[100]


def test_hmm(docs, empty):
    assert hmm.hmm_scores(empty).count() == 0
    out = hmm.hmm_scores(docs.withColumn("row", F.lit(1))).collect()
    rows = docs.collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(t for r in rows if not held(r.doc_id) for t in [*tokens(r.text), "\n"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        ts = [*tokens(r.text), "\n"]
        want.append(str((r.doc_id, held(r.doc_id), len(ts), sum(counts[t] > 0 for t in ts), n, round(sum(log10((counts[t] + 1) / (n + v + 1)) for t in ts), 4))))
    assert sorted(want) == sorted(str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))) for r in out)
    assert all(r.score < 0 and np.isfinite(r.score) for r in out)


def test_hmm_scores_end_to_end(spark, monkeypatch):
    """The score of a text is the model's probability of its buckets and of each word in its bucket, listed or not."""
    monkeypatch.setattr(hmm, "LISTED", 40)
    monkeypatch.setattr(hmm, "OWN", 16)
    monkeypatch.setattr(hmm, "BUCKETS", 16 + hmm.SPELLED)
    monkeypatch.setattr(hmm, "spelled", lambda w: 16 + zlib.crc32(w[:2] + b"\0" + w[-3:]) % hmm.SPELLED)
    kept = []
    fit = hmm.baum_welch
    monkeypatch.setattr(hmm, "baum_welch", lambda rows, model, shares: kept.append(fit(rows, model, shares)) or kept[-1])
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 40)))) for i in range(60)] + [(900, "unheard words w1 here")]
    out = hmm.hmm_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(t for d, x in rows if not held(d) for t in hmm.tokens(x))
    listed = [w for w, _, _ in hmm.listed_words(spark.createDataFrame([(w, hmm.spelled(w), c) for w, c in counts.items()], "word binary, bucket int, c bigint"), 40)]
    own = {bytes(w): i for i, w in enumerate(listed[:16])}
    mass, types = Counter(), Counter()
    for w, c in counts.items():
        if w not in own:
            mass[hmm.spelled(w)] += c
            types[hmm.spelled(w)] += 1
    model = kept[-1]
    for r in out:
        seq = hmm.tokens(dict(rows)[r.doc_id])
        buckets = np.array([own[w] if w in own else hmm.spelled(w) for w in seq])
        a, total = model.first.astype(float), 0.0
        for i, b in enumerate(buckets):
            a = (a @ model.move if i else a) * model.emit[b]
            total += log10(a.sum())
            a = a / a.sum()
        for w, b in zip(seq, buckets, strict=True):
            if w not in own:
                total += log10((counts[w] - hmm.DISCOUNT if w in counts else hmm.DISCOUNT * types[b] + 1) / (mass[b] + 1))
        assert abs(total - r.score) < 1e-3 * max(1, len(seq)), (r.doc_id, total, r.score)


def test_hmm_counts_against_brute_force():
    rng = np.random.default_rng(0)
    seqs = [rng.integers(0, hmm.BUCKETS, n).astype(np.uint16) for n in (1, 2, 5, 9, 9, 3)]
    m = hmm.Model.start(4, np.full(hmm.BUCKETS, 1 / hmm.BUCKETS))
    first, move, emit = np.zeros(4), np.zeros((4, 4)), np.zeros((hmm.BUCKETS + 1, 4))
    scores = {}
    for some, obs in hmm._blocks(seqs):
        m.expect(obs, first, move, emit)
        scores |= dict(zip(some, m.score(obs), strict=True))
    f, mv = np.zeros(4), np.zeros((4, 4))
    for i, s in enumerate(seqs):
        a = [m.first * m.emit[s[0]].astype(float)]
        for o in s[1:]:
            a.append((a[-1] @ m.move) * m.emit[o])
        b = [np.ones(4)]
        for o in s[:0:-1]:
            b.insert(0, m.move @ (m.emit[o] * b[0]))
        z = a[-1].sum()
        assert abs(log10(z) - scores[i]) < 1e-3
        f += a[0] * b[0] / z
        for t in range(1, len(s)):
            mv += a[t - 1][:, None] * m.move * (m.emit[s[t]] * b[t])[None] / z
    assert np.allclose(f, first, atol=1e-4) and np.allclose(mv, move, atol=1e-4)
    assert abs(emit[:-1].sum() - sum(map(len, seqs))) < 1e-3


def test_hmm_chunks_of_long_sequences_give_the_same_counts(monkeypatch):
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, hmm.BUCKETS, n).astype(np.uint16) for n in (50, 41, 40, 7, 1)]
    m = hmm.Model.start(4, np.full(hmm.BUCKETS, 1 / hmm.BUCKETS))
    made = []
    for chunk in (1 << 16, 8, 1):
        monkeypatch.setattr(hmm, "CHUNK", chunk)
        first, move, emit = np.zeros(4), np.zeros((4, 4)), np.zeros((hmm.BUCKETS + 1, 4))
        for _, obs in hmm._blocks(seqs):
            m.expect(obs, first, move, emit)
        made.append((first, move, emit[:-1]))
    for other in made[1:]:
        assert all(np.allclose(x, y, atol=1e-4) for x, y in zip(made[0], other, strict=True))


def test_hmm_words_of_a_bucket_sum_to_one(docs):
    counts = {bytes(r.word): (r.bucket, r.c) for r in hmm.word_counts(docs).collect()}
    assert all(b == hmm.spelled(w) for w, (b, _) in counts.items())
    assert {w: c for w, (_, c) in counts.items()} == Counter(t for r in docs.collect() for t in hmm.tokens(r.text))
    mass, types = Counter(), Counter()
    for b, c in counts.values():
        mass[b] += c
        types[b] += 1
    for b in mass:
        known = sum((c - hmm.DISCOUNT) / (mass[b] + 1) for x, c in counts.values() if x == b)
        assert abs(known + (hmm.DISCOUNT * types[b] + 1) / (mass[b] + 1) - 1) < 1e-9


def test_language(docs, empty, spark, sf_dir):
    assert language.identify_languages(empty).count() == 0
    out = {r.doc_id: r for r in language.identify_languages(docs).collect() if r.doc_id is not None}
    assert out[0].lang_pred == out[1].lang_pred == out[2].lang_pred == "und" and out[0].score == 0
    assert all(r.lang_pred != "und" and 0 <= r.score <= 1 for i, r in out.items() if i > 2)
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pred = language.identify_languages(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in pred) >= 0.95 * len(pred)


def test_language_against_sets(spark, sf_dir):
    """The filters decide as exact sets of n-grams do, but for near ties."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    counts = {}
    for r in docs:
        if r.lang is not None and not held(r.doc_id):
            low = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else " " for c in r.text or "")
            flat = " " + " ".join(low.split()) + " "
            counts.setdefault(r.lang, Counter()).update(flat[i : i + 3] for i in range(len(flat) - 2) if flat[i + 1] != " ")
    total = {x: sum(c.values()) for x, c in counts.items()}
    rate = {x: {g: n / total[x] for g, n in c.items() if n > 1} for x, c in counts.items()}
    top = Counter()
    for r in rate.values():
        for g, x in r.items():
            top[g] = max(top[g], x)
    own = {x: {g for g, v in r.items() if v >= language.SHARE * top[g]} for x, r in rate.items()}
    got = {r.doc_id: r.lang_pred for r in language.identify_languages(spark.createDataFrame(docs)).collect()}
    for r in docs:
        low = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else " " for c in r.text or "")
        if not low.strip():
            assert got[r.doc_id] == "und"
            continue
        flat = " " + " ".join(low.split()) + " "
        hits = {x: sum(flat[i : i + 3] in s for i in range(len(flat) - 2) if flat[i + 1] != " ") for x, s in own.items()}
        assert hits[got[r.doc_id]] >= max(hits.values()) - max(1, 0.02 * len(flat)), r.doc_id


def test_tables_follow_the_members():
    assert language.shape_of(0) == (language.SMALLEST, 4) and language.shape_of(1 << 16) == (1 << 20, 4)
    size, hashes = language.shape_of(6_000_000)
    assert size == language.LARGEST and hashes == 1  # a large language leaves room: fill is 1 - exp(-6 / 8)
    rng = np.random.default_rng(4)
    table = np.zeros((1 << 16, 1), np.uint64)
    table[:] = 1  # the first of two filters is full
    word = language.grams(["hallo"])[1]
    for s in language.slots(word, 1 << 16, 4):
        table[s, 0] |= np.uint64(2)
    got = language.Filters(["full", "real"], table).decide(["hallo hallo", "xyz"])
    assert got[0][0] == "real" and all(np.isfinite(x) for _, x in got) and rng is not None


def test_bloom_filters_have_no_false_negatives():
    rng = np.random.default_rng(2)
    size, hashes = language.shape_of(500)
    table = np.zeros((size, 2), np.uint64)
    keys = {i: rng.integers(0, 1 << 62, 500) for i in (0, 3, 70)}
    for i, k in keys.items():
        for s in language.slots(k, size, hashes):
            table[s, i // 64] |= np.uint64(1) << np.uint64(i % 64)
    f = language.Filters([f"l{i}" for i in range(71)], table)
    for i, k in keys.items():
        assert ((f.masks(k)[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()


ODD = [None, "", "  ", "it's don't WE'LL İstanbul İx ΟΔΟΣ ς K Å ﬁ", "<|startoftext|> a<|ENDOFTEXT|>b <|endoftext|>", "x\x1cy z q …. a….", "1234 5a6, a1. é. ñ,, 's 'S, n't. --- foo'### A.B.C. ½ x²", "日本語 テスト。", "á, ́. Ǆ ß ẞ", LONG]


def test_packing_round_trip(spark, empty):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(TOKENIZER)
    rows = [(i % 8, t) for i, t in enumerate(ODD)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), TOKENIZER).collect()
    want = Counter((d, tuple([*reference.encode(t or "", add_special_tokens=False).ids, 1])) for d, t in rows)
    pieces, got = {}, Counter()
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, tuple(r.ids)))
    for (d, n), parts in pieces.items():
        parts.sort()
        if sum(len(p) for _, p in parts) == n:
            assert [s for s, _ in parts] == [sum(len(p) for _, p in parts[:i]) for i in range(len(parts))]
            got[d, sum((p for _, p in parts), ())] += 1
        else:
            for _, p in parts:
                got[d, p] += 1
    assert got == want
    for s in {r.sequence_id for r in out}:
        mine = sorted((r.offset, r.length) for r in out if r.sequence_id == s)
        assert [o for o, _ in mine] == [sum(n for _, n in mine[:i]) for i in range(len(mine))] and sum(n for _, n in mine) <= 2048
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_bm25_against_brute_force():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 300, rng.integers(5, 60)).astype(np.uint16) for _ in range(80)]
    df = np.zeros(1 << 16, np.int64)
    for d in docs:
        df[np.unique(d)] += 1
    mean = sum(map(len, docs)) / len(docs)
    index = packing.Index(docs, df, len(docs), mean)
    idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
    weight = lambda t, d: idf[t] * (tf := int((d == t).sum())) * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) if (d == t).any() else 0.0
    for seed in (0, 7, 50):
        score = [sum(weight(t, d) for t in set(docs[seed].tolist())) for d in docs]
        unused = np.ones(len(docs), np.float32)
        unused[seed] = 0
        got = list(index.neighbours(seed, unused))
        best = sorted((s for i, s in enumerate(score) if i != seed and s > 0), reverse=True)
        assert len(set(got)) == len(got) == len(best) and np.allclose([score[i] for i in got], best, rtol=1e-3)


def brute_pieces(docs, scores, window):
    """The greedy fill, word for word: a seed, then its best unused neighbours until the window is full."""
    unused, pieces, sequence, filled = set(range(len(docs))), [], 0, 0

    def put(i):
        nonlocal sequence, filled
        unused.discard(i)
        start = 0
        while start < len(docs[i]):
            n = min(len(docs[i]) - start, window - filled)
            pieces.append((i, start, n, sequence, filled))
            start, filled = start + n, filled + n
            if filled == window:
                sequence, filled = sequence + 1, 0

    while unused:
        seed = min(unused)
        put(seed)
        while filled and (near := [i for i in unused if scores[seed][i] > 0]):
            best = min(near, key=lambda i: (-scores[seed][i], i))
            before = sequence
            put(best)
            if sequence != before:
                seed = best
    return pieces


@pytest.mark.parametrize("vocabulary, longest, window", [(400, 60, 128), (4000, 30, 64), (60, 300, 100)])
def test_pack_shard_against_brute_force(vocabulary, longest, window):
    rng = np.random.default_rng(vocabulary)
    docs = [rng.integers(2, vocabulary, rng.integers(1, longest)).astype(np.uint16) for _ in range(150)]
    docs += docs[:20]
    df = np.zeros(1 << 16, np.int64)
    for d in docs:
        df[np.unique(d)] += 1
    mean = sum(map(len, docs)) / len(docs)
    index = packing.Index(docs, df, len(docs), mean)
    scores = [index.scores(i) for i in range(len(docs))]  # held to BM25 above; equal ones tie alike here
    assert packing.pack_shard(docs, df, len(docs), mean, window) == brute_pieces(docs, scores, window)


def test_cells_fill_shards_whatever_repeats(spark):
    """A row that is most of the table spreads over shards; texts about one thing meet in one."""
    about = ["astronomy telescope galaxy", "bakery flour oven", "football stadium goalkeeper", "violin orchestra conductor", "volcano lava eruption", "submarine harbour sailor"]
    topics = [" ".join([x] * 14) for x in about]
    rows = [(1, topics[0])] * 600 + [(10 + i, topics[1 + i % 5] + f" and more {i}") for i in range(100)]
    encoded = packing.encode_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), TOKENIZER)
    total = sum(r.n for r in encoded.where("ids is not null").select((F.octet_length("ids") / 2).alias("n")).collect())
    dealt = packing.deal(packing.save(encoded, "test-ids"), int(total // 10)).collect()
    sizes = Counter()
    for r in dealt:
        sizes[r.shard] += len(r.ids) // 2
    assert len(dealt) == 700 and len(sizes) >= 10 and max(sizes.values()) < 2 * total / 10
    of = Counter(((r.doc_id - 10) % 5, r.shard) for r in dealt if r.doc_id > 1)
    assert len(of) <= 10  # each topic is in one shard, or in two where a shard ends
    df = packing.document_frequencies(packing.save(encoded, "test-ids"))
    want = Counter(t for r in dealt for t in set(np.frombuffer(r.ids, np.uint16).tolist()))
    assert {int(t): int(df[t]) for t in np.flatnonzero(df)} == dict(want)


def test_windows_take_all_neighbours_by_all_terms():
    """Neighbours fill a window however short they are, and any common term makes one."""
    rng = np.random.default_rng(6)
    docs = [(rng.integers(0, 40, 10) + 100 * (i % 2) + 10).astype(np.uint16) for i in range(200)]
    docs += [np.arange(1000, 1040).astype(np.uint16), np.array([1039, *[2000] * 30], np.uint16)]
    df = np.zeros(1 << 16, np.int64)
    for d in docs:
        df[np.unique(d)] += 1
    df[1039] = 150  # the seed's lightest term
    mean = sum(map(len, docs)) / len(docs)
    assert list(packing.Index(docs, df, len(docs), mean).neighbours(200, np.arange(202) != 200)) == [201]
    pieces = packing.pack_shard(docs[:200], df, 200, 10.0, 500)
    topics = [{d % 2 for d, _, _, s, _ in pieces if s == n} for n in range(4)]
    assert sorted(map(list, topics)) == [[0], [0], [1], [1]]


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, docs, empty, rule):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    more = spark.createDataFrame([(900 + i, t, "en", "s", 1) for i, t in enumerate(["a\n\n\n  b\n", "\n\n", "x \n \n y<|endoftext|>", "日本\n語 😀\n\n😀"])], DOCS)
    rows = docs.union(more)
    want = []
    for r in rows.collect():
        text = r.text or ""
        lines = text.split("\n")
        starts = [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))] if len(lines) < 50 else None
        owner = [i for i, x in enumerate(lines) for _ in range(len(x) + (i < len(lines) - 1))]
        tokens, crossing = Counter(), Counter()
        offsets = reference.encode(text, add_special_tokens=False).offsets
        for a, b in offsets:
            held = Counter(owner[a : max(b, a + 1)])
            to = {"first": min(held), "last": max(held), "largest": min(held, key=lambda s: (-held[s], s))}[rule]
            tokens[to] += 1
            crossing[to] += len(held) > 1
        want += [str((r.doc_id, i, starts[i], tokens[i], crossing[i], len(offsets))) for i in range(len(lines))]
    out = token_counts.count_tokens(rows.withColumn("section", F.lit(1)), RANKS, public_tokenizers.PATTERN, rule=rule).collect()
    assert sorted(want) == sorted(str((r.doc_id, r.section, r.start, r.n_tokens, r.n_crossing, r.doc_tokens)) for r in out)
    assert sum(r.n_crossing for r in out) > 0
    assert token_counts.count_tokens(empty, RANKS, public_tokenizers.PATTERN).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy now</div>
<article><h1>Head &amp; Title</h1><p><b>First<br>line<br><p>One   two&nbsp;three.</p><ul><li>x<li>y</ul><p>Last</article>
<div class="comments"><p>Nice post</p></div><footer>&copy; all</footer></body></html>"""


def test_blocks_and_teacher():
    page = html_text.blocks(PAGE)
    assert [b.text for b in page] == ["A", "Buy now", "Head & Title", "First line", "One two three.", "x", "y", "Last", "Nice post", "© all"]
    assert html_text.teach(page) == [0, 0, 1, 1, 1, 1, 1, 1, 0, 0]
    assert html_text.blocks(None) == html_text.blocks("") == html_text.blocks("<p> </p><!-- x") == []
    assert [b.text for b in html_text.blocks("a < b <b>c</b><script>x")] == ["a < b c"]


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    pages = [[([1, 2], [3, 4], (0.1, 0.0, 0.2)), ([2], [5], (0.3, 1.0, 0.0))], [([7], [8, 3, 3], (0.5, 0.5, 0.5))]]
    labels = [[1, 0], [1]]
    model = html_text.Labeller()

    def loss():
        y = model.forward(pages)[0]
        flat = [(y[t, j], labels[j][t]) for j in range(2) for t in range(len(labels[j]))]
        return -sum(np.log(p if l else 1 - p) for p, l in flat) / len(flat)

    g = model.gradients(pages, labels)
    for k in model.p:
        for i in rng.choice(np.flatnonzero(g[k]) if g[k].any() else [0], 4):
            at = np.unravel_index(i, model.p[k].shape)
            old = model.p[k][at]
            model.p[k][at] = old + 1e-5
            up = loss()
            model.p[k][at] = old - 1e-5
            down = loss()
            model.p[k][at] = old
            assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6, k


def test_hostile_pages_cost_their_length():
    import time

    start = time.time()
    for page in ('<a x="' * 100_000, '<a x="' * 100_000 + ">", "<a x='y>" * 100_001, "<div>x" * 40_000, "<li><ul>" + "<b>" * 40_000 + "<li>x" * 40_000, "<b>x</b> " * 100_000, "<" * 500_000, "<!" * 300_000, "&#" + "9" * 100_000 + ";", "<script>" + "</script " * 100_000, "".join(f'<div class="c{i}">x' for i in range(20_000)), "<a x=\"<a y='" * 100_000 + ">"):
        found = html_text.blocks(page)
        assert all(len(b.path) <= html_text.DEPTH for b in found)
    assert time.time() - start < 60
    assert [b.text for b in html_text.blocks('<p title="a > b">x</p><p data="open>y</p><p>z</p>')] == ["x", "y", "z"]
    model = html_text.Labeller()
    marks = model.label([html_text.features(html_text.blocks("<div>x y" * 30_000), {})])
    assert len(marks[0]) == 30_000


def test_pages_without_anything_to_learn_from(spark):
    assert html_text.train(["<p> </p>", ""]) is None
    long = "<html><body><nav>" + "menu " * 50_000 + "</nav><article><p>" + "word " * 50_000 + "</p></article></body></html>"
    schema = "page_id bigint, url string, html string"
    out = html_text.extract_text(spark.createDataFrame([(1, "u", long), (2, "u", "<p>short</p>")], schema)).collect()
    assert len(out) == 2  # every page is longer than what is learned from, or has nothing to learn from
    bare = html_text.extract_text(spark.createDataFrame([(1, "u", " "), (2, None, None)], schema)).collect()
    assert [r.text for r in bare] == ["", ""]


#: Pages without an article element, with their main text by hand.
FOREIGN = [
    ('<html><body><div id="header"><a href="/">Home</a> <a href="/x">News</a></div><div class="main-content"><h1>Rain ahead</h1><p>It will rain all day, the office said.</p><p>Winds turn north by night.</p></div><div class="sidebar"><ul><li><a href="/1">Most read</a></li></ul></div><div class="footer">Imprint</div></body></html>', "Rain ahead\n\nIt will rain all day, the office said.\n\nWinds turn north by night."),
    ('<html><body><nav><a href="/">Start</a></nav><main><h2>Bread</h2><p>Mix flour and water, then wait.</p><ul><li>500 g flour</li><li>300 g water</li></ul></main><section class="comments"><p>Lovely recipe!</p></section><footer>2024</footer></body></html>', "Bread\n\nMix flour and water, then wait.\n\n500 g flour\n\n300 g water"),
    ('<html><body><div class="cookie-notice"><p>We use cookies.</p><button>Accept</button></div><div class="post-body"><p>The first bridge was of wood, built by hand.</p><blockquote>It swayed in the wind.</blockquote><p>Stone came later.</p></div><form><label>Mail</label><input name="m"></form></body></html>', "The first bridge was of wood, built by hand.\n\nIt swayed in the wind.\n\nStone came later."),
]


def test_pages_without_an_article_element(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = spark.createDataFrame([(9100 + i, "u", html) for i, (html, _) in enumerate(FOREIGN)], pages.schema)
    out = {r.page_id: r.text for r in html_text.extract_text(pages.union(rows)).where("page_id >= 9100").collect()}
    blocks = [(set(out[9100 + i].split("\n\n")), set(want.split("\n\n"))) for i, (_, want) in enumerate(FOREIGN)]
    hit, said, true = (sum(n) for n in zip(*[(len(a & b), len(a), len(b)) for a, b in blocks], strict=True))
    assert hit >= 0.9 * said and hit >= 0.9 * true


def test_main_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = spark.createDataFrame([(9001, "u", PAGE), (9002, None, None), (9003, "u", ""), (None, "u", PAGE)], pages.schema).withColumn("text", F.lit("clash"))
    out = {r.page_id: r for r in html_text.extract_text(pages.withColumn("text", F.lit("clash")).union(rows)).collect()}
    assert out[9002].text == out[9003].text == "" and out[9002].n_chars == 0
    assert out[9001].text == "Head & Title\n\nFirst line\n\nOne two three.\n\nx\n\ny\n\nLast" == out[None].text
    wrong = 0
    for r in pages.collect():
        want = "\n\n".join(b.text for b in html_text.blocks(r.html) if any(t == "article" for t, _ in b.path))
        wrong += out[r.page_id].text != want
    assert wrong == 0
    assert html_text.extract_text(pages.where("false")).count() == 0


def test_kept_digest(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id bigint, text string")
    assert line_dedup.dedup_lines(df).select(F.sha2("text", 256)).first()[0] == hashlib.sha256(b"a\nb").hexdigest()


def test_cells_of_many_documents_are_those_of_each():
    """Sorted as one, documents have the cells and held ids that each has by itself; of equal weights the smaller id comes first."""
    rng = np.random.default_rng(5)
    ids = [np.append(rng.zipf(1.3, rng.integers(0, 60)) % 300, packing.END).astype(np.uint16) for _ in range(200)] + [np.array(x, np.uint16) for x in ([1], [1, 1], [0, 1], [7, 7, 7, 7, 79, 1])]
    held = np.zeros(1 << 16, np.int64)
    want = []
    for x in ids:
        used, counts = np.unique(x, return_counts=True)
        held[used] += 1
        order = sorted((-sqrt(c) * log(i + 2.0) if i != packing.END else 0.0, i) for i, c in zip(used.tolist(), counts.tolist(), strict=True))
        second = zlib.crc32(order[1][1].to_bytes(2, "little")) % packing.SECOND if len(order) > 2 else 0
        want.append(order[0][1] * packing.SECOND + second)
    cells, df = packing.cells_of(ids)
    assert cells.tolist() == want and (df == held).all()
    assert packing.cells_of([])[0].tolist() == []
