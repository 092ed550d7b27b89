"""User code behind columns, SQL names and the table function."""

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from braidline.functions import extension
from braidline.operators import context, liveness
from braidline.schema import EDGES

NODES = "session_id bigint, node_id string, node_type string, ordinal bigint"


def test_kinds(spark):
    df = spark.createDataFrame([("a b", 1), (None, 2), ("c", None), ("a b", 3)], "text string, n int")
    seen = []

    def count(texts):
        seen.extend(texts)
        return texts.str.split(" ").str.len()

    assert [r[0] for r in df.select(extension.vectorised("counter", count)("text")).collect()] == [2, None, 1, 2]
    count(pd.Series(["x"]))
    assert [r[0] for r in df.select(extension.vectorised("scorer", lambda rows: rows["n"] * 2)("n")).collect()] == [2.0, 4.0, None, 6.0]
    assert [r[0] for r in df.select(extension.vectorised("relevance", lambda rows: rows["n"] > 1)("n", "text")).collect()] == [False, True, False, True]
    extension.register(spark, "shout", "backend", lambda prompts: prompts.str.upper())
    df.createOrReplaceTempView("prompts")
    assert [r[0] for r in spark.sql("SELECT shout(text) FROM prompts").collect()] == ["A B", None, "C", "A B"]
    with pytest.raises(Exception, match="gave 1 values for 2 rows"):
        df.coalesce(1).select(extension.vectorised("counter", lambda texts: [1])("text")).collect()


def test_archive_readers(spark):
    store = {f"sha256:{hashlib.sha256(p.encode()).hexdigest()}": p for p in ("x", "y")}
    store["sha256:00"] = "harmed"
    read = extension.vectorised("archive", lambda digests: digests.map(store))
    asked = spark.createDataFrame([(d,) for d in [*store, "sha256:none"]], "digest string")
    assert {r.digest for r in extension.readable(asked, read).collect()} == {d for d, p in store.items() if p != "harmed"}


def test_policies():
    @extension.policy("keeps_nothing_at_all")
    def nothing(nodes, budget):
        return nodes.where("false")

    assert extension.policies()["keeps_nothing_at_all"] is nothing and set(context.POLICIES) < set(extension.policies())
    with pytest.raises(ValueError, match="there already"):
        extension.policy("last_k")(nothing)
    del extension._POLICIES["keeps_nothing_at_all"]


def test_span_table_function_equals_the_operator(spark):
    """Shared messages, results before their call or without a message, calls without a message, nodes of no message."""
    rows = [
        (1, "g", "goal", 1), (1, "d", "decision", 2), (1, "c1", "tool_call", 2), (1, "c2", "tool_call", 2), (1, "r1", "observation", 3), (1, "r2", "error", 4), (1, "x", "decision", 5), (1, "y", "observation", 5),
        (1, "early", "observation", 6), (1, "mate", "decision", 6), (1, "c3", "tool_call", 7), (1, "loose", "tool_call", None), (1, "of_loose", "observation", 8), (1, "homeless", "observation", None), (1, "alone", "summary", None),
        (2, "c1", "mcp_call", 1), (2, "r1", "observation", 1),
    ]
    links = [(1, "c1", "r1"), (1, "c2", "r2"), (1, "c3", "early"), (1, "loose", "of_loose"), (1, "c1", "homeless"), (2, "c1", "r1")]
    nodes = spark.createDataFrame(rows, NODES)
    edges = spark.createDataFrame([(s, a, b, "produces", 1.0, None) for s, a, b in links], EDGES)
    want = {tuple(r) for r in liveness.spans(nodes, edges).select("session_id", "span_id", "span_type", "node_id").collect()}
    extension.register_span_groups(spark, "spans_of")
    nodes.join(edges.select("session_id", F.col("target").alias("node_id"), F.col("source").alias("call")), ["session_id", "node_id"], "left").createOrReplaceTempView("placed")
    got = [tuple(r) for r in spark.sql("SELECT * FROM spans_of(TABLE(placed) PARTITION BY session_id ORDER BY ordinal)").collect()]
    assert set(got) == want and len(got) == len(want)
