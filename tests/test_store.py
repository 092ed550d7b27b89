"""The artifact store: one writer a version, nothing lost, nothing half written."""

import hashlib
import json
import threading

import pytest
from pyspark.sql import functions as F

from braidline.sources.store import ArtifactStore, Conflict, evaluation_faults, merge_evaluation, summary

NEW = "id string, kind string, payload string"
sha = lambda v: hashlib.sha256(json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def table(spark, rows):
    return spark.createDataFrame([(i, "generation", json.dumps(p)) for i, p in rows], NEW)


def test_concurrent_writers(spark, tmp_path):
    """Six writers at once: six versions, all rows of all of them, each version holding the one before."""
    path, done, errors = str(tmp_path / "store"), [], []

    def write(n):
        try:
            done.append(ArtifactStore(spark, path).commit(table(spark, [(f"{n}-{i}", {"n": n}) for i in range(5)] + [("shared", {"same": True})])))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(240)
    store = ArtifactStore(spark, path)
    assert not errors and sorted(done) == [1, 2, 3, 4, 5, 6] and store.version() == 6
    assert store.read().count() == 31 and store.read().select("id").distinct().count() == 31
    for v in range(1, 6):
        assert set(store.folders(v)) < set(store.folders(v + 1))


def test_a_version_is_given_once(spark, tmp_path):
    """A writer that was overtaken between its check and its claim checks again, and sees the other's conflict."""
    store = ArtifactStore(spark, str(tmp_path / "store"))
    slow, claim = ArtifactStore(spark, store.path), ArtifactStore._claim
    calls = []

    def overtaken(version, folders):
        if not calls:
            store.commit(table(spark, [("a", {"by": "other"})]))
        calls.append(version)
        return claim(slow, version, folders)

    slow._claim = overtaken
    assert slow.commit(table(spark, [("b", {})])) == 2 and calls == [1, 2]
    assert {r.id for r in store.read().collect()} == {"a", "b"}
    calls.clear()
    store.commit(table(spark, [("c", {"v": 1})]))
    slow._claim = lambda version, folders: claim(slow, version, folders)
    with pytest.raises(Conflict, match="cannot change"):
        slow.commit(table(spark, [("c", {"v": 2}), ("d", {})]))
    assert store.version() == 3 and store.read().where("id = 'd'").isEmpty()
    assert store.commit(table(spark, [("c", {"v": 1})])) == 3  # nothing new, no version
    assert store.vacuum() > 0 and store.read().count() == 3


def test_what_a_lost_writer_staged_counts_for_nothing(spark, tmp_path):
    store = ArtifactStore(spark, str(tmp_path / "store"))
    store._claim = lambda *_: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        store.commit(table(spark, [("a", {})]))
    again = ArtifactStore(spark, store.path)
    assert again.version() == 0 and again.read().isEmpty()
    for rows in ([("a", {"x": 1}), ("a", {"x": 2})], [(None, {})]):
        with pytest.raises(Conflict):
            again.commit(table(spark, rows))


def test_evaluations(spark, tmp_path):
    store = ArtifactStore(spark, str(tmp_path / "store"))
    generation = {"id": "s1", "messages": [{"role": "user", "content": "hé \"q\" ] x"}], "we[ird]\"k": 1, "reward_info": None}
    store.commit(table(spark, [("s1", generation), ("s2", {"id": "s2"})]))
    good = {"status": "evaluation_complete", "evaluation": {"reward_info": {"reward": 0.5, "parts": [1]}}}
    rows = lambda *r: spark.createDataFrame([(i, g, sha(p) if h is None else h, json.dumps(p)) for i, g, h, p in r], "id string, generation_hash string, hash string, payload string")
    at = sha(generation)
    bad = [("s1", at, None, good | {"status": "evaluation_error"}), ("s1", "0", None, good), ("none", at, None, good), ("s1", at, "0", good), ("s1", at, None, good | {"evaluation": {}})]
    faults = evaluation_faults(store.read(), rows(*bad)).collect()
    assert sorted(f.fault for f in faults) == ["evaluation does not match generation"] * 2 + ["evaluation has another hash", "only a complete evaluation can be merged", "reward_info is missing"]
    with pytest.raises(ValueError, match="cannot be merged"):
        merge_evaluation(store, rows(*bad[:1]))
    assert merge_evaluation(store, rows(("s1", at, None, good))) == 2
    held = json.loads(store.read().where("kind = 'merged'").first().payload)
    assert held == {"status": "merged", "generation_sha256": at, "evaluation_sha256": sha(good), "simulation": generation | {"reward_info": good["evaluation"]["reward_info"]}}
    assert merge_evaluation(store, rows(("s1", at, None, good))) == 2
    other = good | {"evaluation": {"reward_info": {"reward": 1}}}
    with pytest.raises(Conflict):
        merge_evaluation(store, rows(("s1", at, None, other)))
    assert {r.kind: r.n for r in summary(store).collect()} == {"generation": 2, "merged": 1}
    assert store.read().where(F.col("kind") == "generation").where(F.col("id") == "s1").first().hash == at


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """100,000 links in a row, a circle and a branch beside them: under 20 tables, and the same depths as a search."""
    from braidline.operators import graph

    rounds, plain = [], graph.table
    monkeypatch.setattr(graph, "table", lambda df, name: rounds.append(name) or plain(df, name))
    chain = spark.range(100_000).select(F.lit(1).cast("long").alias("session_id"), F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target"))
    more = spark.createDataFrame([(2, "a", "b"), (2, "b", "c"), (2, "c", "a"), (2, "c", "d"), (2, "a", "e"), (2, "e", "d"), (2, "d", "d"), (3, "x", "y"), (3, "y", "z"), (3, "z", "x")], chain.schema)
    edges = chain.union(more).withColumn("edge_type", F.lit("leads_to"))
    starts = spark.createDataFrame([(1, "0"), (1, "99990"), (2, "a"), (3, "y"), (3, "nowhere")], "session_id long, start string")
    found = graph.reachable(edges, starts, whole=0)
    assert sum(n in ("jumps", "reached") for n in rounds) < 20, rounds
    assert found.where("session_id = 1 AND start = '0' AND depth <> CAST(node AS int)").isEmpty()
    assert found.groupBy("start").count().collect() and {r.start: r["count"] for r in found.groupBy("start").count().collect()} == {"0": 100_001, "99990": 11, "a": 5, "y": 3, "nowhere": 1}
    small = lambda whole: {tuple(r) for r in graph.reachable(edges.where("session_id > 1"), starts.where("session_id > 1"), whole=whole).collect()}
    assert small(0) == small(4) == small(100)
