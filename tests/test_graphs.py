"""Stored graphs, records, bundles, checks of configuration, labels and representations."""

import json

import pytest
from pyspark.sql import functions as F

from braidline.operators import cards, checks, context, graph, lifecycle, projection
from braidline.sources import graphs


def test_synthetic_trace(spark):
    nodes, edges = graphs.synthetic_trace(spark)
    assert graph.violations(nodes, edges).count() == 0
    profiled = lifecycle.infer_profiles(nodes, edges)
    labels = {r.node_id: r.lifecycle for r in profiled.collect()}
    assert labels["old"] == "superseded" and labels["open"] == "unresolved_failure" and labels["fail"] == "resolved_failure" and labels["act"] == "audit_required" and labels["new"] == "critical_evidence"
    found = cards.failure_cards(profiled, edges).collect()
    assert {(c.operation_scope, c.event, c.expiry_trigger) for c in found} == {("return_order", "expired", "resolved"), ("find_refund", "created", None)}
    safe = {r.node_id: r.removable for r in lifecycle.safety_decisions(profiled, edges).collect()}
    assert safe["old"] and not safe["open"] and not safe["new"] and not safe["goal"]
    view, items = context.full_ours(nodes, edges, 400)
    assert {r.node_id for r in items.collect()} == {"open"} and {r.node_id for r in view.where("hard").collect()} >= {"goal", "rule"}
    chain = {(r.node_id, r.edge, r.other) for r in projection.later_chain(nodes, edges, spark.createDataFrame([("synthetic", "fail")], "session_id string, node_id string")).collect()}
    assert chain == {("fail", "resolved_by", "done"), ("fail", "retried_by", "again")}


def test_scopes_expire_cards_and_events_are_recorded_once(spark):
    nodes, edges = graphs.synthetic_trace(spark)
    profiled = lifecycle.infer_profiles(nodes, edges)
    told = spark.createDataFrame([("synthetic", "find_refund", "user_abandoned")], "session_id string, operation_scope string, expiry_trigger string")
    assert {c.expiry_trigger for c in cards.failure_cards(profiled, edges, scopes=told).collect()} == {"resolved", "user_abandoned"}
    doubted = profiled.withColumn("card_confidence", F.lit(0.5))
    assert {c.event for c in cards.failure_cards(doubted, edges).collect()} == {"expired", "downgraded"}
    found = cards.failure_cards(profiled, edges)
    assert cards.new_events(found, found.where("event = 'expired'")).count() == 1 and cards.new_events(found, found).count() == 0
    valid = profiled.withColumns({"malformed_call": F.col("node_id") == "open", "arguments_valid": F.lit(False)})
    assert "malformed" in {c.failure_class for c in cards.failure_cards(valid, edges).collect()}


def test_entities_and_diffs(spark):
    rows = spark.createDataFrame([('{"identity": [["a", "x"], ["b", ["y", "x"]], ["c", 3]], "tool_name": "t"}',), ("plain",), ('{"identity": 3}',)], "s string")
    assert [r.e for r in rows.select(cards.entity_ids(F.col("s")).alias("e")).collect()] == [["x", "y", "3"], [], []]
    m = spark.sql("select map('a', '1', 'b', '2') as x, map('b', '3', 'c', '4') as y").select(cards.argument_diff(F.col("x"), F.col("y")).alias("d")).first().d
    assert {k: tuple(v) for k, v in m.items()} == {"a": ("1", None), "b": ("2", "3"), "c": (None, "4")}


def test_graphs_round_trip(spark, tmp_path):
    nodes, edges = graphs.synthetic_trace(spark)
    path = str(tmp_path / "saved")
    graphs.save_graphs(graphs.graph_documents(nodes, edges), path)
    with pytest.raises(Exception, match="exists"):
        graphs.save_graphs(graphs.graph_documents(nodes, edges), path)
    back = graphs.load_graphs(spark, path)
    key = ["node_id", "node_type", "content", "step_id", "token_count", "raw_ref"]
    assert sorted(map(tuple, graphs.graph_nodes(back).select(*key).collect()), key=str) == sorted(map(tuple, nodes.select(*key).collect()), key=str)
    assert graphs.graph_edges(back).count() == edges.count()
    runs = spark.createDataFrame([("synthetic", "run7", "full_ours")], "session_id string, run_id string, condition string")
    row = graphs.materialized(nodes, edges, runs).first()
    assert row.name == "run7__synthetic__trace.json" and json.loads(row.document)["metadata"] == {"run_id": "run7", "condition": "full_ours"}


def test_read_graphs(spark, tmp_path):
    nodes, edges = graphs.synthetic_trace(spark)
    good = graphs.graph_documents(nodes, edges).first().document
    place = tmp_path / "run_Retail-t9" / "x"
    place.mkdir(parents=True)
    (place / "trace.json").write_text(good)
    (tmp_path / "other.json").write_text("[1]")
    (tmp_path / "broken.json").write_text("{")
    found = graphs.read_graphs(spark, str(tmp_path), recursive=True)
    assert [(r.domain, r.task, r.session_id) for r in found.collect()] == [("retail", "t9", "synthetic")]
    assert graphs.valid_graphs(found).count() == 1
    with pytest.raises(ValueError, match="no graphs"):
        graphs.read_graphs(spark, str(tmp_path))
    (tmp_path / "bad.json").write_text(json.dumps({"schema_version": "2.0", "session_id": "b", "nodes": {"a": {"node_id": "a", "node_type": "goal", "step_id": 0}}, "edges": [{"source": "a", "target": "z", "edge_type": "supports"}]}))
    with pytest.raises(ValueError, match="dangling"):
        graphs.valid_graphs(graphs.read_graphs(spark, str(tmp_path)))


def test_records_and_writers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"x": 1}\n\nnot json\n{"x": 2}\n')
    (tmp_path / "in" / "b.json").write_text('{"rows": [{"x": 3}, {"x": 4}]}')
    (tmp_path / "in" / "c.json").write_text("[{\"x\": 5}]")
    assert sorted(json.loads(r.value)["x"] for r in graphs.read_records(spark, str(tmp_path / "in")).collect()) == [1, 2, 3, 4, 5]
    both = graphs.union_by_name(spark.sql("select 1 as a, array(1, 2) as b"), spark.sql("select 2 as a, 'x' as c"))
    graphs.write_new(both, str(tmp_path / "csv"), "csv")
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert back.columns == ["a", "b", "c"] and {r.b for r in back.collect()} == {"[1,2]", None}
    graphs.write_new(both, str(tmp_path / "json"))
    with pytest.raises(Exception, match="exists"):
        graphs.write_new(both, str(tmp_path / "json"))


def test_bundles(spark):
    payload = '{"b": 1, "a": [1]}'
    digest = spark.createDataFrame([(payload,)], "p string").select(graphs.hashed(F.col("p"))).first()[0]
    artifacts = spark.createDataFrame([("x", '{"a": [1], "b": 1}'), ("half", "{}")], "id string, payload string")
    marked = spark.createDataFrame([("x", digest)], "id string, hash string")
    assert [r.id for r in graphs.load_generations(artifacts, marked).collect()] == ["x"]
    with pytest.raises(ValueError, match="not what"):
        graphs.load_generations(artifacts, spark.createDataFrame([("half", digest)], marked.schema))
    frozen = spark.createDataFrame([("p", digest, payload)], "prefix_id string, prefix_hash string, payload string")
    assert graphs.load_prefixes(frozen).count() == 1
    for wrong in (frozen.union(frozen), frozen.withColumn("payload", F.lit("{}"))):
        with pytest.raises(ValueError, match="prefixes"):
            graphs.load_prefixes(wrong)
    stored = spark.createDataFrame([("x", 2, digest)], "id string, attempt bigint, hash string")
    rows = graphs.next_attempts(artifacts.union(spark.createDataFrame([("x", "{}")], artifacts.schema)), stored).collect()
    assert sorted((r.id, r.attempt, r["name"]) for r in rows) == [("half", 1, "attempt_0001"), ("x", 3, "attempt_0003")]


def test_retokenized(spark):
    nodes, _ = graphs.synthetic_trace(spark)
    fresh, report = graphs.retokenized(nodes.withColumn("token_count", F.when(F.col("node_id") == "goal", 99).otherwise(F.col("token_count"))))
    assert report.first().changed == 1 and fresh.where("node_id = 'goal'").first().token_count == 5


def test_configuration_fails_closed(spark):
    good = {"seeds": [1, 2], "trials": 3, "matrix_id": "a-1"}
    rules = {"positive": ("trials",), "patterns": {"matrix_id": r"[A-Za-z0-9][\w.-]*"}, "unique": ("seeds",)}
    assert checks.require(good, **rules) == good
    for change in ({"trials": 0}, {"trials": True}, {"matrix_id": "../x"}, {"seeds": [1, 1]}, {"seeds": []}, {"nested": [{"my_api_key": "k"}]}):
        with pytest.raises(ValueError):
            checks.require(good | change, **rules)
    clean = spark.sql("select 1 as a, named_struct('structural_features', named_struct('side_effect', 1)) as b")
    assert checks.reject_outcomes(clean) is clean
    with pytest.raises(ValueError, match="reward"):
        checks.reject_outcomes(spark.sql("select array(named_struct('reward', 1)) as a"))


def test_complete_scalars(spark):
    rows = spark.createDataFrame([("3",), ('"x"',), ('{"id": 7}',), ('{"id": {"a": 1}}',), ('{"a": 1, "b": 2}',), ("true",), ("[1]",), ("bad",), (None,)], "c string")
    got = [r.s and tuple(r.s) for r in rows.select(checks.complete_scalar(F.col("c")).alias("s")).collect()]
    assert got == [("number", "3"), ("string", "x"), ("number", "7"), None, None, ("boolean", "true"), None, None, None]
    strict = [r.s and tuple(r.s) for r in rows.select(checks.complete_scalar(F.col("c"), "value", False).alias("s")).collect()]
    assert strict == [("number", "3"), ("string", "x"), None, None, None, None, None, None, None]


def test_label_errors(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    labels = spark.createDataFrame([(1, "yes"), (1, "no"), (2, "perhaps"), (9, "yes")], "id int, keep string")
    assert {(r.id, r.error) for r in checks.label_errors(labels, items, "id", {"keep": ("yes", "no")}).collect()} == {(1, "repeated"), (3, "missing"), (9, "unknown_item"), (2, "value:keep")}


def test_commands(spark, tmp_path, capsys):
    from braidline import cli

    def run(*argv):
        code = cli.main(list(argv), spark)
        return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    assert run("list-managers")[1] == sorted(context.POLICIES) and len(context.POLICIES) == 13
    made = str(tmp_path / "made")
    assert run("make-synthetic", "--output", made) == (0, {"output": made, "session_id": "synthetic"})
    story = [{"role": "user", "content": "mend it"}, {"role": "assistant", "content": None, "tool_calls": [{"id": "a", "name": "update_part", "arguments": {"id": 1}}]}, {"role": "tool", "id": "a", "content": "part not found", "error": True}, {"role": "assistant", "content": "it is not there"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text(json.dumps({"id": "s1", "messages": story}))
    out, store = str(tmp_path / "graphs"), str(tmp_path / "store")
    assert run("import-trajectories", "--input", str(tmp_path / "in"), "--output", out, "--archive", store)[1]["imported"] == 1
    assert run("verify-archive", store) == (0, {"valid": True, "failures": []})
    single = tmp_path / "one"
    single.mkdir()
    (single / "g.json").write_text(spark.read.text(out).first().value)
    assert run("validate-trace", str(single)) == (0, {"valid": True, "errors": []})
    report = run("run-offline", "--input", out, "--output", str(tmp_path / "report"), "--budget", "64", "--manager", "full_ours", "--manager", "last_k", "--manager", "raw_hard_failure_retention")[1]
    assert [m["manager"] for m in report["managers"]] == ["full_ours", "last_k", "raw_hard_failure_retention"]
    assert spark.read.option("header", "true").csv(str(tmp_path / "report" / "sessions")).count() == 3
    assert run("run-interventions", "--output", str(tmp_path / "runs"), "--tasks-per-kind", "5")[1]["runs"] == 80


def test_beam_is_the_best_of_all_combinations(spark):
    import itertools
    import random

    from braidline.operators import decisions

    rng = random.Random(4)
    options = {(s, p): [(f"{n}{i}", rng.randrange(1, 40), rng.random() / 20) for i, n in enumerate("abc")] for s in range(4) for p in range(5)}
    rows = [(s, p, o) for (s, p), o in options.items()]
    atoms = spark.createDataFrame(rows, "session_id bigint, place bigint, candidates array<struct<name:string,cost:bigint,risk:double>>")
    for budget in (30, 60, 1000):
        got = {}
        for r in decisions.compile_beam(atoms, budget, width=3**5).collect():
            got.setdefault(r.session_id, []).append((r.place, r.choice, r.feasible))
        for s in range(4):
            combos = [(sum(c[1] for c in pick), sum(c[2] for c in pick), tuple(c[0] for c in pick)) for pick in itertools.product(*[options[s, p] for p in range(5)])]
            fits = [c for c in combos if c[0] <= budget]
            best = min(fits, key=lambda c: (c[0] + 512 * c[1], c[0], c[1], c[2])) if fits else min(combos, key=lambda c: (c[1], c[0], c[2]))
            assert tuple(n for _, n, _ in sorted(got[s])) == best[2] and {f for *_, f in got[s]} == {bool(fits)}
    with pytest.raises(Exception, match="no candidate"):
        decisions.compile_beam(atoms.withColumn("candidates", F.slice("candidates", 1, 0)), 9).count()


def test_logistic_risk_needs_its_metrics(spark):
    atoms = spark.createDataFrame([(1, "a", "slot_value", "current", False, False, True, 2.0), (1, "b", "active_goal", "current", True, False, True, 0.0)], "session_id int, atom_id string, atom_type string, status string, hard boolean, blocking boolean, archived boolean, x double")
    masked = checks.risk_mask(atoms, F.lit("omit"), spark.createDataFrame([], "session_id int, atom_id string"))
    good = {"harm_positives": 20, "recall": 0.95, "ece": 0.05, "brier": 0.1, "constant_brier": 0.2}
    rows = {r.atom_id: r for r in checks.logistic_risk(masked, -3.0, {"x": 1.0}, 0.5, good).collect()}
    assert abs(rows["a"].probability - 1 / (1 + 2.718281828459045)) < 1e-9 and rows["a"].omit_allowed and rows["a"].reasons == ["calibrated_logistic_prediction"]
    assert rows["b"].probability == 1.0 and not rows["b"].omit_allowed
    weak = {r.atom_id: r for r in checks.logistic_risk(masked, -3.0, {"x": 1.0}, 0.5, good | {"recall": 0.5}).collect()}
    assert weak["a"].reasons == ["statistical_model_gate_failed"] and weak["a"].probability == 0.05


def test_projections_that_only_measure_are_not_sent(spark):
    from braidline.operators import annotation

    rows = spark.sql("select 1 as id, true as send_eligible")
    assert annotation.sendable(rows) is rows
    with pytest.raises(ValueError, match="only measures"):
        annotation.sendable(annotation.withheld(rows))
