"""Rows of a session stay together: what is kept of stories is not exchanged again."""

from collections import Counter

import pytest

from braidline import scratch
from braidline.operators import liveness
from braidline.plans import QUERIES, states


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["reduced_edges", "lifecycle_records", "liveness_roots", "omission_mask"])
def test_state_is_not_exchanged(name, spark, sf_dir):
    assert exchanges(QUERIES[name](spark, sf_dir)) == 0


def test_forms_are_searched_once(spark, sf_dir):
    """All checks of a compilation read one table of choices: none of them searches again."""
    assert "FlatMapGroupsInPandas" not in QUERIES["compiled_verified"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_waiting_nodes_are_made_once(spark, sf_dir):
    """Edges are looked up in the table of nodes, which nothing makes again: the only generator left is that of the edges."""
    edges = states.waiting(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))[1]
    assert edges._jdf.queryExecution().executedPlan().toString().count("Generate explode") == 1


def test_settings_come_back(spark, sf_dir):
    scratch.apart(spark)
    before = {k: spark.conf.get(k) for k in scratch.TOGETHER}
    QUERIES["reduced_edges"](spark, sf_dir)
    assert {k: spark.conf.get(k) for k in scratch.TOGETHER} == scratch.TOGETHER
    QUERIES["exchanges"](spark, sf_dir)
    assert {k: spark.conf.get(k) for k in scratch.TOGETHER} == before and spark.conf.get(scratch.PARTS, None) is None


@pytest.mark.parametrize("name", ["liveness_recall", "projected_spans", "reactivation_audit"])
def test_spans_and_closures_are_made_once(name, spark, sf_dir, monkeypatch):
    """What spans are judged by is a table: nothing makes stories, spans or what is live again."""
    calls = Counter()
    for module, function in ((liveness, "spans"), (liveness, "live_atoms"), (states, "waiting")):
        real = getattr(module, function)
        monkeypatch.setattr(module, function, lambda *a, real=real, function=function, **k: calls.update([function]) or real(*a, **k))
    QUERIES[name](spark, sf_dir)
    assert calls == {"spans": 1, "live_atoms": 1, "waiting": 1}


def test_rows_are_made_without_lambdas(spark, sf_dir):
    """What explodes is not filtered by a lambda first, which no generated code runs."""
    _, edges = states.waiting(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    assert "lambda" not in edges._jdf.queryExecution().executedPlan().toString()
