"""Operators on small literal traces."""

import random

import pytest
from pyspark.sql import functions as F

from braidline.functions.identity import canonical_json, hash_share, opaque_names
from braidline.functions.text import estimate_tokens, semantic_outcome, shrunk, stop_intent, truncated
from braidline.operators import context, failures, graph, lifecycle, stats
from braidline.sources.adapters import event_exchanges, exchange_edges, exchange_nodes


def fold(costs, budget):
    kept, total = [], 0
    for c in costs:
        if total + c <= budget:
            kept.append(True)
            total += c
        else:
            kept.append(False)
    return kept


def nodes(spark, rows):
    return spark.createDataFrame(rows, "session_id bigint, ordinal bigint, step_id bigint, node_id string, node_type string, content string, token_count bigint, final boolean")


@pytest.mark.parametrize("parts", [1, 13])
def test_greedy_skips_and_goes_on(spark, parts):
    rng = random.Random(4)
    costs = {s: [rng.randrange(1, 60) for _ in range(rng.randrange(1, 40))] for s in range(12)}
    rows = [(s, i, i, f"{i:03d}", "decision", "x", c, False) for s, cs in costs.items() for i, c in enumerate(cs)]
    df = nodes(spark, rows).repartition(parts)
    out = context.greedy(df, [F.col("ordinal")], F.col("token_count"), 100).collect()
    for s, cs in costs.items():
        assert [r.kept for r in sorted((r for r in out if r.session_id == s), key=lambda r: r.ordinal)] == fold(cs, 100)


def test_greedy_mandatory_may_exceed(spark):
    rows = [(1, 1, 1, "a", "goal", "g", 90, False), (1, 2, 2, "b", "constraint", "c", 30, False), (1, 3, 3, "c", "decision", "d", 1, False)]
    few = nodes(spark, rows)
    kept = {r.node_id: r.kept for r in context.POLICIES["full_ours"](few, 100).collect()}
    assert kept == {"a": True, "b": True, "c": False}


def test_greedy_is_the_loop_that_it_says(spark):
    """Runs of the fold join seamlessly: sessions of any length, with what is mandatory and what is already spent."""
    import random

    rng = random.Random(3)
    rows = [(s, i, i, f"{i:04}", "decision", "x", rng.randrange(1, 30), False) for s, n in ((1, 1), (2, 2), (3, 17), (4, 400)) for i in range(n)]
    must = {(s, i) for s, i, *_ in rows if rng.random() < 0.05}
    marked = nodes(spark, rows).withColumn("m", F.concat_ws("-", "session_id", "ordinal").isin([f"{s}-{i}" for s, i in must] or [""]))
    got = {(r.session_id, r.ordinal): r.kept for r in context.greedy(marked, [F.col("step_id").desc()], F.col("token_count"), 300, mandatory=F.col("m"), spent=F.lit(20)).collect()}
    for s in (1, 2, 3, 4):
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: -r[2])
        total = 20 + sum(r[6] for r in mine if (s, r[1]) in must)
        for r in mine:
            keep = (s, r[1]) in must
            if not keep and total + r[6] <= 300:
                total, keep = total + r[6], True
            assert got[s, r[1]] == keep


def test_policies_on_empty_nodes(spark):
    empty = nodes(spark, [])
    for name, policy in context.POLICIES.items():
        assert policy(empty, 10).count() == 0, name


def test_later_rows_do_not_change_a_prefix(spark):
    rows = [(1, i, i, f"{i:03d}", "decision", "x", 10 + i, False) for i in range(1, 9)]
    cut = spark.createDataFrame([(1, 4)], "session_id bigint, cutoff bigint")
    now = context.prefixes(nodes(spark, rows[:5]), cut).drop("final").collect()
    then = context.prefixes(nodes(spark, rows), cut).drop("final").collect()
    assert sorted(now) == sorted(then)


EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def events(spark, kinds):
    import datetime

    base = datetime.datetime(2024, 1, 1)
    rows = [(i, base + datetime.timedelta(seconds=i), u, kind, 1.0, f'{{"k": {k}}}') for i, (u, k, kind) in enumerate(kinds)]
    return event_exchanges(spark.createDataFrame(rows, EVENTS))


def test_retry_is_superseded_then_resolved(spark):
    ex = events(spark, [(1, 5, "error"), (1, 5, "error"), (1, 6, "click"), (1, 5, "click")])
    found = {(r.edge_type, r.source, r.target) for r in exchange_edges(ex).collect()}
    assert ("retried_by", "1:1:c", "1:2:c") in found
    assert ("superseded_by", "1:1:r", "1:2:r") in found
    assert ("resolved_by", "1:2:r", "1:4:r") in found
    assert ("failed_with", "1:1:c", "1:1:r") in found
    labels = {r.node_id: r.lifecycle for r in lifecycle.infer_profiles(context.completed(exchange_nodes(ex)), exchange_edges(ex)).collect()}
    assert labels["1:1:r"] == "superseded"
    assert labels["1:2:r"] == "resolved_failure"
    assert labels["1:4:c"] == "consumed"


def test_windows_and_cards(spark):
    ex = events(spark, [(1, 5, "error"), (1, 5, "error"), (1, 5, "click"), (2, 1, "error")])
    w = {(r.session_id, r.ordinal): r for r in failures.post_failure_windows(ex).collect()}
    assert w[1, 1].repeated_invalid == 1 and not w[1, 1].resolved_within_window and w[1, 1].window_censored
    assert w[1, 2].recovery_action_index == 1
    assert w[2, 1].observed_actions == 0
    cards = {(r.session_id, r.k): r for r in failures.operation_failures(ex).collect()}
    assert cards[1, 5].expiry_trigger == "resolved" and cards[1, 5].chain == 2
    assert cards[2, 1].active


def test_card_expires_after_its_time(spark):
    ex = events(spark, [(1, 5, "error")] + [(1, 100 + i, "click") for i in range(9)])
    assert failures.operation_failures(ex).first().expiry_trigger == "ttl_expired"


def test_reachability_has_no_greatest_depth(spark):
    e = spark.range(205).select(F.lit(1).alias("session_id"), F.col("id").alias("source"), (F.col("id") + 1).alias("target"), F.lit("e").alias("edge_type"))
    starts = spark.createDataFrame([(1, 0)], "session_id int, start bigint")
    for whole in (graph.WHOLE, 0):
        assert graph.reachable(e, starts, whole=whole).agg(F.count("*"), F.max("depth")).first() == (206, 205)


def test_reachability_ends_in_cycles(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "d", "a"), (2, "a", "z")], "session_id bigint, source string, target string")
    starts = spark.createDataFrame([(1, "a")], "session_id bigint, start string")
    for whole in (graph.WHOLE, 0):
        assert {(r.node, r.depth) for r in graph.reachable(e, starts, whole=whole).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    typed = e.withColumn("edge_type", F.when(F.col("target") == "c", "no").otherwise("yes"))
    assert {r.node for r in graph.reachable(typed, starts, ("yes",)).collect()} == {"a", "b"}
    pairs = spark.createDataFrame([(1, "a", "c"), (1, "a", "d")], "session_id bigint, start string, target string")
    assert {(r.target, r.found) for r in graph.has_path(typed, pairs).collect()} == {("c", True), ("d", False)}
    out = spark.createDataFrame([(1, "b")], "session_id bigint, node string")
    assert {(r.target, r.found) for r in graph.has_path(typed, pairs, excluded=out).collect()} == {("c", False), ("d", False)}


MESSAGES = "session_id bigint, ordinal bigint, role string, call_ids array<string>, result_id string"


def test_protocol_closure(spark):
    m = spark.createDataFrame([(1, 1, "user", None, None), (1, 2, "assistant", ["x", "y"], None), (1, 3, "tool", None, "x"), (1, 4, "tool", None, "y"), (1, 5, "assistant", None, None)], MESSAGES)
    closed = graph.protocol_closure(m, spark.createDataFrame([(1, 3)], "session_id bigint, ordinal bigint")).collect()
    assert {(r.ordinal, r.reason) for r in closed} == {(3, "selected"), (2, "call_of_result"), (4, "result_of_call"), (1, "leading_user_anchor")}


def test_protocol_errors(spark):
    m = spark.createDataFrame([(1, 1, "tool", None, "x"), (1, 2, "assistant", ["x", "y"], None), (1, 3, "tool", None, "z"), (1, 4, "tool", None, "z")], MESSAGES)
    assert {(r.id, r.kind) for r in graph.protocol_errors(m).collect()} == {("x", "result_before_call"), ("y", "call_without_result"), ("z", "result_without_call"), ("z", "result_repeated")}


def test_violations(spark):
    n = spark.createDataFrame([(1, "a", "tool_call", 1, True, None), (1, "b", "observation", 2, False, None), (1, "c", "observation", 1, False, None)], "session_id bigint, node_id string, node_type string, step_id bigint, side_effect boolean, raw_ref string")
    e = spark.createDataFrame([(1, "a", "b", "produces"), (1, "b", "a", "produces"), (1, "a", "q", "produces"), (1, "b", "c", "superseded_by")], "session_id bigint, source string, target string, edge_type string")
    assert {(r.kind, r.subject) for r in graph.violations(n, e).collect()} == {("signature", "b>produces>a"), ("dangling", "a>produces"), ("dangling", "a>produces>q"), ("temporal", "b>superseded_by>c"), ("raw_ref", "a")} - {("dangling", "a>produces")}


def test_statistics(spark):
    from math import comb

    df = spark.createDataFrame([(a, b) for a, b in [(0, 0), (3, 1), (10, 2), (30, 45)]], "a bigint, b bigint")
    for r in df.withColumn("p", stats.mcnemar(F.col("a"), F.col("b"))).collect():
        n = r.a + r.b
        want = None if n == 0 else min(1.0, 2 * sum(comb(n, i) for i in range(min(r.a, r.b) + 1)) / 2**n)
        assert (r.p is None) == (want is None) and (want is None or abs(r.p - want) < 1e-9)
    p = spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.03), ("n", None)], "name string, p double")
    assert {r.name: r.holm_p and round(r.holm_p, 6) for r in stats.holm(p).collect()} == {"x": 0.03, "z": 0.06, "y": 0.06, "n": None}
    trials = spark.createDataFrame([("t", True), ("t", True), ("t", False), ("u", False), ("u", False)], "task string, ok boolean")
    assert {r.k: round(r.pass_hat_k, 6) for r in stats.pass_hat_k(trials, ["task"], "ok").collect()} == {1: 0.333333, 2: 0.166667}


def test_gates_fail_closed(spark):
    m = spark.createDataFrame([("a", 0.5)], "metric string, value double")
    t = spark.createDataFrame([("g", "a", "at_least", 0.5), ("h", "b", "at_least", 0.0)], "gate string, metric string, comparator string, threshold double")
    assert {r.gate: r.passed for r in stats.gates(m, t).collect()} == {"g": True, "h": False}


def test_text_functions(spark):
    df = spark.createDataFrame([("é证",), ("",), (None,), ("x" * 200,)], "t string")
    assert [r[0] for r in df.select(estimate_tokens(F.col("t"))).collect()] == [2, 0, 0, 50]
    assert [r[0] and len(r[0]) for r in df.select(truncated(F.col("t"), 4)).collect()] == [2, "", None, 16]
    cut = [r[0] for r in df.select(shrunk(F.col("t"), F.lit(5))).collect()]
    assert all(c is None or (len(c.encode()) + 3) // 4 <= 5 for c in cut)
    said = spark.createDataFrame([("Thanks. That is all.",), ("Is that all?",), (None,)], "t string").select(stop_intent(F.col("t")))
    assert [r[0] for r in said.collect()] == [True, False, False]
    out = spark.createDataFrame([('{"success": false}',), ('{"status": "Not Found"}',), ("Permission denied",), ("tests failed: 3",), ("ok",), ("hello",)], "t string").select(semantic_outcome(F.col("t"), F.lit(False)))
    assert [r[0] for r in out.collect()] == ["negative", "negative", "policy_denied", "test_failed", "positive", "inconclusive"]


def test_identities(spark):
    df = spark.createDataFrame([('{"b": 1, "a": [2, "é"]}',), ('{"a":[2,"é"],"b":1}',), ("no",), (None,)], "j string")
    assert [r[0] for r in df.select(canonical_json("j")).collect()] == ['{"a":[2,"é"],"b":1}'] * 2 + [None, None]
    names = opaque_names(spark.range(50).withColumnRenamed("id", "v"), "v", "s").collect()
    assert sorted(r.opaque for r in names) == [f"item_{i:06d}" for i in range(1, 51)]
    share = spark.range(200).select(hash_share(F.lit("d"), F.col("id")).alias("s")).collect()
    assert all(0 <= r.s < 1 for r in share)
