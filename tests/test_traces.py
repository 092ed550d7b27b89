"""Trajectories, archive and streams."""

import json

import pytest
from pyspark.sql import functions as F

from braidline.operators import context, lifecycle
from braidline.operators.trace_fold import TraceFold, completes, operation_key
from braidline.sources import archive, trajectories
from braidline.streaming.traces import stream_traces, windowed_failures


def call(i, name, **arguments):
    return {"role": "assistant", "content": None, "tool_calls": [{"id": i, "name": name, "arguments": arguments}]}


def result(i, content, error=False):
    return {"role": "tool", "id": i, "content": content, "error": error}


STORY = [
    {"role": "system", "content": "Lend nothing to strangers."},
    {"role": "user", "content": "Send the ladder back to the depot"},
    call("a", "send_parcel", number=31),
    result("a", "the van has timed out", True),
    {"role": "assistant", "content": "Another van?"},
    {"role": "user", "content": "Please"},
    call("b", "send_parcel", number=31),
    result("b", '{"state": "completed"}'),
    {"role": "assistant", "content": "It is on its way."},
]


@pytest.fixture
def saved(tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "results.json").write_text(json.dumps({"tasks": [{"id": 1, "instruction": "send it back"}], "simulations": [{"id": "s1", "task_id": 1, "trial": 0, "reward_info": {"reward": 1.0}, "messages": STORY}]}))
    (tmp_path / "two.json").write_text(json.dumps([{"id": "s2", "traj": [STORY[1], {"tool_messages": [result("x", "late")]}]}]))
    return str(tmp_path)


@pytest.mark.parametrize("text", ["{", "3", '{"a": 1}'])
def test_files_that_are_no_trajectories_are_errors(spark, saved, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="bad.json"):
        trajectories.read_messages(spark, saved).count()


def test_simulations_beside_their_tasks(spark, tmp_path):
    (tmp_path / "run" / "simulations").mkdir(parents=True)
    (tmp_path / "run" / "results.json").write_text(json.dumps({"tasks": [{"id": "t", "user_scenario": {"a": 1}}], "simulations": []}))
    (tmp_path / "run" / "simulations" / "x.json").write_text(json.dumps({"id": "s", "task_id": "t", "messages": STORY}))
    rows = trajectories.read_messages(spark, str(tmp_path)).collect()
    assert len(rows) == 9 and {r.instruction for r in rows} == {'{"a": 1}'}


def test_story(spark, saved):
    messages = trajectories.read_messages(spark, saved)
    assert {(r.session_id, r["count"]) for r in messages.groupBy("session_id").count().collect()} == {("s1", 9), ("s2", 2)}
    assert {(r.session_id, r.instruction) for r in messages.collect()} == {("s1", "send it back"), ("s2", None)}
    trace = trajectories.traces(messages).cache()
    edges = [r for r in trajectories.edges_of(trace).collect() if r.session_id == "s1"]
    retried = [r for r in edges if r.edge_type == "retried_by"]
    assert [(r.match_type, r.confidence) for r in retried] == [("exact_signature", 1.0)]
    assert len([r for r in edges if r.edge_type == "resolved_by"]) == 1
    assert {r.edge_type for r in edges if r.confidence == 0.5} == {"blocks", "supports"}
    nodes = trajectories.nodes_of(trace)
    assert nodes.where("session_id = 's1' and final").first().content == "It is on its way."
    assert nodes.where("session_id = 's2' and node_type = 'tool_call'").first().tool_name == "unknown_tool"
    labels = {r.node_id: r.lifecycle for r in lifecycle.infer_profiles(context.completed(nodes).withColumn("arguments", F.lit(None).cast("map<string,string>")), trajectories.edges_of(trace)).collect()}
    assert labels["s1:4:error:0"] == "resolved_failure"


def test_argument_completion():
    fold, edges = TraceFold("s"), []
    for i, (m, failed, meaning) in enumerate([(call("a", "find_parcel", depot="north", shelf=""), False, ""), (result("a", "shelf is empty", True), True, "negative"), (call("b", "find_parcel", depot="north", shelf="C4"), False, ""), (result("b", "ok"), False, "positive")], 1):
        edges += fold.feed(i, m, failed, meaning)[1]
    assert [e[4] for e in edges if e[2] == "retried_by"] == ["argument_completion"]
    assert not completes({"a": 1, "b": ""}, {"a": 1}) and not completes({"a": 1, "b": "x"}, {"a": 1, "b": "y", "c": 2})
    assert completes({"a": 1, "b": ""}, {"a": 1, "b": 2}) and not completes({"b": ""}, {"b": 2}) and not completes({"a": 1, "b": 0}, {"a": 1, "b": 2})
    assert operation_key("T", {"id": 1, "confirm": True}) == operation_key("t", {"id": 1})


def test_state_of_a_fold_is_bounded():
    """Answered calls go beyond the horizon; what is open stays."""
    fold, sizes = TraceFold("s", horizon=64), []
    for i in range(400):
        m, r = call(f"c{i}", "look", page=i, text="x" * 200), result(f"c{i}", "ok")
        fold.feed(2 * i + 1, m)
        fold.feed(2 * i + 2, r, i % 7 == 0, "negative" if i % 7 == 0 else "positive")
        sizes.append(fold.s.size())
    assert len(fold.s.maps["calls"]) <= 64 and len(fold.s.maps["failed"]) <= 64 + len(fold.s.maps["open"])
    assert len(fold.s.maps["open"]) == 1  # each page is another try of one operation


def test_outcomes(spark):
    from braidline.functions.text import semantic_outcome, stop_intent

    want = {
        '{"status":"weird","state":"denied"}': "negative",
        '{"status":"pending","state":"completed"}': "positive",
        '{"success":"false"}': "inconclusive",
        '{"success":false}': "negative",
        '{"error":0.0}': "inconclusive",
        '{"error":[]}': "inconclusive",
        '{"error":{}}': "negative",
        '{"error":"","ok":true}': "positive",
        '{"error":null,"outcome":"Not Found"}': "negative",
        "all tests failed": "test_failed",
        "Permission   DENIED": "policy_denied",
        "Completed": "positive",
        "12": "inconclusive",
        "[1]": "inconclusive",
        "": "inconclusive",
    }
    rows = spark.createDataFrame([(k,) for k in want], "p string")
    got = {r.p: r.o for r in rows.select("p", semantic_outcome(F.col("p"), F.lit(False)).alias("o")).collect()}
    assert got == want
    both = rows.limit(1).select(semantic_outcome(F.col("p"), F.lit(True)).alias("f"), semantic_outcome(F.col("p"), F.lit(False), F.lit(True)).alias("h")).first()
    assert tuple(both) == ("negative", "inconclusive")
    said = {"I don't  need anything else": True, "That's all for today.": True, "Is that all?": False, "Do you need more help": False, "ok. i am all set": True, "Nothing else\nfor now": False, "###STOP###": True, None: False}
    talk = spark.createDataFrame([(k,) for k in said], "t string").select("t", stop_intent(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in talk} == said


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, i, json.dumps(m)) for s in ("p", "q") for i, m in enumerate(STORY, 1)]
    schema = "session_id string, ordinal bigint, message string"
    whole = spark.createDataFrame(rows, schema)
    source = str(tmp_path / "in")
    for cut in (F.col("ordinal") <= 4, F.col("ordinal") > 4):
        whole.where(cut).coalesce(1).write.mode("append").json(source)
    query = stream_traces(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)).writeStream.format("memory").queryName("traced").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: tuple(map(str, r))
    assert sorted(spark.table("traced").collect(), key=key) == sorted(trajectories.traces(whole).collect(), key=key)


def test_windowed_failures(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "in")
    events.coalesce(1).write.parquet(source)
    query = windowed_failures(spark.readStream.schema(events.schema).parquet(source), "1 day").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("counted").agg(F.sum("n")).first()[0] == events.count()


def test_archive(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([('{"köl":[1,2],"b":null}',), ('{ "b" : null, "köl":[1, 2] }',), ("not JSON",)], "payload string")
    archive.put(rows, path)
    archive.put(rows, path)
    held = spark.read.parquet(path)
    assert held.count() == 1 and archive.broken(spark, path).isEmpty()
    assert archive.get(spark, path, held.select("digest")).count() == 1
    with pytest.raises(ValueError, match="several payloads"):
        archive.merge(held, held.withColumn("payload", F.lit("x")))
    stored = spark.createDataFrame([("a", "1", "p")], "id string, hash string, payload string")
    assert archive.insert_artifacts(spark.createDataFrame([("a", "1", "p"), ("b", "2", "q")], stored.schema), stored).count() == 1
    with pytest.raises(ValueError, match="cannot change"):
        archive.insert_artifacts(spark.createDataFrame([("a", "2", "p")], stored.schema), stored)


def test_label_sheets(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("﻿id,label\n1,active\n2,consumed\n", encoding="utf-8")
    bad.write_text("id,label\n1,active\n1,unheard\n")
    read = lambda p: archive.read_labels(spark, str(p), spark.read.option("header", "true").csv(str(p)).columns[0], "label", ("active", "consumed"))
    assert read(good).count() == 2
    with pytest.raises(ValueError, match="cannot be read"):
        read(bad)
    crossed = {"consumed_is_two": "label <> 'consumed' or id = 2"}
    assert archive.read_labels(spark, str(good), "id", "label", ("active", "consumed"), crossed).count() == 2
    with pytest.raises(ValueError, match="consumed_is_two"):
        archive.read_labels(spark, str(good), "id", "label", ("active", "consumed"), {"consumed_is_two": "label <> 'consumed' or id = 3"})
