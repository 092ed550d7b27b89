"""Folds of traces run once, whatever reads them, and give out only what is asked for."""

import json

import pytest
from pyspark.sql import functions as F

from braidline.functions.text import semantic_outcome
from braidline.plans import QUERIES
from braidline.sources import trajectories


@pytest.mark.parametrize(("name", "folds"), [("trace_fold_nodes", 1), ("trace_fold_edges", 1), ("tool_spans", 0)])
def test_folds_run_once(name, folds, spark, sf_dir):
    """What tool_spans reads lies in a table."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("FlatMapGroupsIn") == folds


def test_kinds(spark):
    story = [{"role": "user", "content": "go"}, {"role": "assistant", "content": "yes", "tool_calls": [{"id": "a", "name": "op", "arguments": {"id": 1}}]}, {"role": "tool", "id": "a", "content": "ok"}]
    messages = spark.createDataFrame([("s", i, json.dumps(m)) for i, m in enumerate(story, 1)][::-1], "session_id string, ordinal bigint, message string")
    every = trajectories.traces(messages).collect()
    for kind in ("node", "edge"):
        key = lambda r: str(tuple(r))
        assert sorted(trajectories.traces(messages, kind=kind).collect(), key=key) == sorted((r for r in every if r.kind == kind), key=key) != []


def test_plain_results_are_not_parsed(spark):
    """Only what may be an object is parsed, and phrases are one pattern: the text is normalized four times at most."""
    rows = spark.createDataFrame([('{"status": "Not Found"}',), (' {"ok": true}',), ("Tests  FAILED",), ("[1]",), ('"{"',), (None,)], "payload string")
    out = rows.select(semantic_outcome(F.col("payload"), F.lit(False)).alias("o"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.lower().count("regexp_replace") <= 4
    assert [r.o for r in out.collect()] == ["negative", "positive", "test_failed", "inconclusive", "inconclusive", "inconclusive"]


def test_selected_forms_lie_by_session(spark, sf_dir):
    """The union that all checks of compilation_checks read is a table: only the faults of provenance, a union of their own, are exchanged."""
    plan = QUERIES["compilation_checks"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
