"""The queries against their SQL, and the pipeline stage by stage, on the smallest tables."""

import re
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from braidline.llm.queries import ORACLES, QUERIES

sys.path.insert(0, str(Path(__file__).parent))
from test_small import LOWER, repeated_by_hand, shingle_set, words  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, sf_dir, oracle, same_rows):
    same_rows(QUERIES[name](spark, sf_dir), oracle, ORACLES[name])


def by_rules(rows):
    return [r for r in rows if len(w := re.findall("[^\x20\x09-\x0d]+", r.text or "")) >= 10 and 100 * repeated_by_hand(w) <= 20 * len(w)]


def by_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    owner = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        for line in (r.text or "").split("\n"):
            if len(key(line)) >= 10:
                owner.setdefault(key(line), r.doc_id)
    return {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if len(key(x)) < 10 or owner[key(x)] == r.doc_id) for r in rows}


def by_classes(rows):
    sets = {r.doc_id: shingle_set(r.text) for r in rows}
    kept, root = sorted(sets), {}
    find = lambda d: d if root.get(d, d) == d else find(root[d])
    for i, a in enumerate(kept):
        for b in kept[:i]:
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d for d in kept if find(d) == d}


def by_windows(rows, bench):
    held = {tuple(w[i : i + min(10, len(w))]) for r in bench if (w := words(r.text)) for i in range(len(w) - min(10, len(w)) + 1)}
    lengths = {len(x) for x in held}
    return {r.doc_id for r in rows if not any(tuple(w[i : i + n]) in held for n in lengths for w in [words(r.text)] for i in range(len(w) - n + 1))}


def test_stages_against_brute_force(spark, sf_dir):
    """Each filtering stage on what the one before kept; hosts of these tables all stay below the bound."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir).collect()
        ids = sorted(r.doc_id for r in kept)
        if name == "quality rules":
            assert ids == sorted(r.doc_id for r in by_rules(rows))
        elif name == "line dedup":
            assert {r.doc_id: r.text for r in kept} == by_lines(rows)
        elif name == "simhash near-dedup":
            assert ids == sorted(by_classes(rows))
        else:
            assert ids == sorted(by_windows(rows, bench))
        rows, docs = kept, spark.createDataFrame(kept, docs.schema)
    packed = Counter()
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect():
        packed[r.doc_id, r.doc_tokens] += r.length
    assert {d for d, _ in packed} == {r.doc_id for r in rows} and all(n == total for (_, total), n in packed.items())


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = docs.count()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert docs.where(F.char_length("text") != F.col("n_chars")).isEmpty()
    counts = list(kept.values())[:-1]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert docs.select("doc_id").distinct().count() == counts[-1]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.createDataFrame([], spark.read.parquet(f"{sf_dir}/documents.parquet").schema), sf_dir).count() == 0, name
