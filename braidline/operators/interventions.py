"""Controlled interventions: four kinds of failure, each for a few fixed tasks, under four policies, with known outcomes.

A controller that sees the failure in its context corrects it at once; one that does not repeats the failed call first and is then told. The matrix is fixed
and small by design (five to ten tasks a kind), so its traces are made on the driver; policies, cards and measures are those of the library.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidline.functions.text import estimate_tokens
from braidline.operators import cards, context, graph, lifecycle, projection
from braidline.operators.trace_fold import operation_key
from braidline.scratch import table

# The kinds, what ends their failure, the policies, the first seed.
KINDS = ("argument_correction", "latest_failure_only", "alternative_tool_completion", "malformed_then_valid")
EXPIRY = dict(zip(KINDS, ("resolved", "resolved", "alternative_completed", "corrected_syntax"), strict=True))
MANAGERS = ("full_trajectory", "ours_without_failure_retention", "raw_hard_failure_retention", "full_ours")
BASE_SEED, TASKS, BUDGET = 4100, 8, 512

NODE = "session_id string, node_id string, node_type string, content string, step_id bigint, ordinal bigint, tool_name string, operation_key string, call_id string, semantic_outcome string, side_effect boolean, final boolean, active boolean, raw_ref string, arguments map<string,string>, failure_class string, malformed_call boolean, arguments_valid boolean"
EDGE = "session_id string, source string, target string, edge_type string, confidence double"


def specs(tasks: int = TASKS, seed: int = BASE_SEED) -> list[dict]:
    """(intervention_id, kind, task, seed, entity) of the matrix, in order."""
    if not 5 <= tasks <= 10:
        raise ValueError("five to ten tasks a kind")
    return [{"intervention_id": f"p1_{k}_{t:02d}", "kind": k, "task": t, "seed": seed + i * tasks + t, "entity": f"E-{t:03d}"} for i, k in enumerate(KINDS) for t in range(tasks)]


class _Trace:
    """Nodes and edges of one run as rows."""

    def __init__(self, spec: dict, session: str) -> None:
        self.spec, self.session, self.nodes, self.edges, self.messages = spec, session, [], [], 1
        self.failed: list[tuple[str, str, str, dict]] = []  # call, result, key, arguments
        self.add("goal", "goal", f"Complete {spec['kind']} for {spec['entity']}.", 0, 1)

    def add(self, name: str, kind: str, content: str, step: int, ordinal: int, **more: object) -> str:
        row = {"session_id": self.session, "node_id": name, "node_type": kind, "content": content, "step_id": step, "ordinal": ordinal, "side_effect": False, "final": False, "active": True} | more
        self.nodes.append(tuple(row.get(c.split()[0]) for c in NODE.split(", ")))
        return name

    def exchange(self, step: int, tool: str, arguments: dict, error: str | None, **flags: object) -> None:
        key = operation_key(tool, arguments)
        acts = tool.startswith("update")
        call = self.add(f"c{step}", "tool_call", json.dumps({"arguments": arguments, "tool_name": tool}), step, self.messages + 1, tool_name=tool, operation_key=key, call_id=f"c{step}", side_effect=acts, raw_ref=f"sha256:{self.session}:c{step}", arguments={k: str(v) for k, v in arguments.items()}, arguments_valid=flags.get("valid"))
        # The diagnostic is long, so that keeping the raw result costs more than a card.
        content = json.dumps({"diagnostic_blob": f"{self.spec['intervention_id']}:" + "x" * (720 + 8 * self.spec["task"]), "error": error} if error else {"entity_id": self.spec["entity"], "status": "completed"}, sort_keys=True)
        result = self.add(f"r{step}", "error" if error else "observation", content, step, self.messages + 2, tool_name=tool, operation_key=key, call_id=f"c{step}", semantic_outcome="negative" if error else "positive", raw_ref=f"sha256:{self.session}:r{step}", failure_class=flags.get("failure_class"), malformed_call=flags.get("malformed"))
        self.messages += 2
        self.edge(call, result, "failed_with" if error else "produces")
        before = next(((c, r, 1.0 if a == arguments else 0.8) for c, r, k, a in reversed(self.failed) if k == key), None)
        if before:
            self.edge(before[0], call, "retried_by", before[2])
            self.edge(before[1], result, "superseded_by" if error else "resolved_by")
            self.failed = [f for f in self.failed if f[0] != before[0]]
        if error:
            self.failed.append((call, result, key, arguments))

    def edge(self, source: str, target: str, kind: str, confidence: float = 1.0) -> None:
        self.edges.append((self.session, source, target, kind, confidence))


def _story(spec: dict, session: str) -> tuple[_Trace, dict, tuple[str, dict]]:
    """(the trace up to its failure, the arguments that fail again, the tool and arguments that succeed)."""
    t, who = _Trace(spec, session), {"record_id": spec["entity"]}
    kind = spec["kind"]
    if kind == "argument_correction":
        t.exchange(1, "update_record", who | {"page": 0}, "page 0 is invalid; use page 1")
        return t, who | {"page": 0}, ("update_record", who | {"page": 1})
    if kind == "latest_failure_only":
        t.exchange(1, "update_record", who | {"page": 0}, "page 0 is invalid; try page 1")
        t.exchange(2, "update_record", who | {"page": 1}, "page 1 is stale; use page 2")
        return t, who | {"page": 0}, ("update_record", who | {"page": 2})
    if kind == "alternative_tool_completion":
        t.exchange(1, "primary_fetch", who, "primary service unavailable; use fallback_fetch")
        return t, who, ("fallback_fetch", who)
    t.exchange(1, "update_record", {"record": spec["entity"]}, "invalid argument: missing record_id and format", failure_class="malformed", malformed=True, valid=False)
    return t, {"record": spec["entity"]}, ("update_record", who | {"format": "json"})


def _frames(spark: SparkSession, traces: list[_Trace]) -> tuple[DataFrame, DataFrame]:
    nodes = spark.createDataFrame([n for t in traces for n in t.nodes], NODE)
    edges = spark.createDataFrame([e for t in traces for e in t.edges], EDGE)
    return table(nodes.withColumn("token_count", estimate_tokens(F.col("content"))), "intervention-nodes"), table(edges, "intervention-edges")


def _seen(spark: SparkSession, by_manager: dict[str, list[_Trace]], budget: int) -> DataFrame:
    """(session_id, visible, selected_tokens, message_tokens, cards, card_latest) of each run's context."""
    out = None
    for name, traces in by_manager.items():
        if not traces:
            continue
        nodes, edges = _frames(spark, traces)
        items = None
        if name in context.FLAGSHIP:
            view, items = context.full_ours(nodes, edges, budget, **context.FLAGSHIP[name])
        elif name == "full_trajectory":
            view = context.profiled_view(context.full_trajectory(nodes), nodes, edges).withColumn("form", F.lit("whole"))
        else:
            view = context.raw_hard_failures(nodes, edges, budget)
        view = table(view, "intervention-view")
        own = view.groupBy("session_id").agg(F.sum(F.when(F.col("kept"), F.col("cost")).otherwise(0)).alias("own"), F.max((F.col("node_type") == "error") & F.col("kept") & (F.col("form") == "whole")).alias("raw"))
        chosen, _ = projection.chosen_messages(view, projection.messages_of(nodes))
        said = nodes.join(chosen, ["session_id", "ordinal"], "left_semi").groupBy("session_id").agg(F.sum("token_count").alias("message_tokens"))
        rows = own.join(said, "session_id", "left")
        if items is not None:
            held = items.groupBy("session_id").agg(F.count("*").alias("cards"), F.sum("cost").alias("card_tokens"), F.max("node_id").alias("card_latest"))
            rows = rows.join(held, "session_id", "left")
        else:
            rows = rows.withColumns({"cards": F.lit(None).cast("bigint"), "card_tokens": F.lit(None).cast("bigint"), "card_latest": F.lit(None).cast("string")})
        rows = rows.select("session_id", (F.col("raw") | (F.coalesce("cards", F.lit(0)) > 0)).alias("visible"), (F.col("own") + F.coalesce("card_tokens", F.lit(0))).alias("selected_tokens"), "message_tokens", F.coalesce("cards", F.lit(0)).alias("cards"), "card_latest")
        out = rows if out is None else out.union(rows)
    return out


def run(spark: SparkSession, tasks: int = TASKS, seed: int = BASE_SEED, budget: int = BUDGET) -> DataFrame:
    """One row for each specification and policy: whether its context showed the failure, what that cost, and what became of the cards."""
    matrix = [(s, m, f"{s['intervention_id']}__{m}") for s in specs(tasks, seed) for m in MANAGERS]
    stories = {name: _story(s, name) for s, _, name in matrix}
    by = {m: [stories[name][0] for _, mm, name in matrix if mm == m] for m in MANAGERS}
    first = {r.session_id: r for r in _seen(spark, by, budget).collect()}  # a row a run
    again: dict[str, list[_Trace]] = {m: [] for m in MANAGERS}
    for spec, manager, name in matrix:
        trace, wrong, _ = stories[name]
        if not first[name].visible:
            bad = {"failure_class": "malformed", "malformed": True} if spec["kind"] == "malformed_then_valid" else {}
            tool = "primary_fetch" if spec["kind"] == "alternative_tool_completion" else "update_record"
            trace.exchange(max(n[4] for n in trace.nodes) + 1, tool, wrong, "repeated invalid action", **bad)
            again[manager].append(trace)
    second = {r.session_id: r for r in _seen(spark, again, budget).collect()} if any(again.values()) else {}
    told = []
    for spec, _, name in matrix:
        trace, _, (tool, arguments) = stories[name]
        trace.exchange(max(n[4] for n in trace.nodes) + 1, tool, arguments, None, valid=True if spec["kind"] == "malformed_then_valid" else None)
        if spec["kind"] == "alternative_tool_completion":
            told.append((name, operation_key("primary_fetch", {"record_id": spec["entity"]}), "alternative_completed"))
    nodes, edges = _frames(spark, [stories[name][0] for _, _, name in matrix])
    scopes = spark.createDataFrame(told, "session_id string, operation_scope string, expiry_trigger string")
    after = cards.failure_cards(lifecycle.infer_profiles(nodes, edges), edges, scopes=scopes)
    ended = after.groupBy("session_id").agg(F.sum(F.col("active").cast("bigint")).alias("active_cards"), F.array_sort(F.collect_set("expiry_trigger")).alias("expiry_triggers"))
    broken = graph.violations(nodes, edges).groupBy("session_id").agg(F.count("*").alias("violations"))
    rows = []
    for spec, manager, name in matrix:
        a, b = first[name], second.get(name)
        right = spec["kind"] == "latest_failure_only" and "r2" or "r1"
        precision = float(a.cards == 1 and a.card_latest == right) if manager == "full_ours" else None
        rows.append((name, spec["intervention_id"], spec["kind"], spec["task"], spec["seed"], manager, a.visible, int(not a.visible), 1 + int(not a.visible), a.selected_tokens + (b.selected_tokens if b else 0), a.message_tokens + (b.message_tokens if b else 0), precision, EXPIRY[spec["kind"]]))
    made = spark.createDataFrame(rows, "session_id string, intervention_id string, kind string, task bigint, seed bigint, manager string, failure_visible boolean, repeated_invalid_action bigint, recovery_steps bigint, selected_tokens bigint, message_tokens bigint, card_precision double, expected_expiry string")
    joined = made.join(ended, "session_id", "left").join(broken, "session_id", "left").fillna(0, ["violations"])
    correct = (F.col("active_cards") == 0) & F.array_contains("expiry_triggers", F.col("expected_expiry"))
    return joined.withColumns({"expiry_correct": F.when(F.col("manager") == "full_ours", correct.cast("double")), "expiry_triggers": F.array_join("expiry_triggers", ",")})


def mechanism(rows: DataFrame) -> DataFrame:
    """One row: whether cards show what they should, expire as they should, and do better than removing failures and cost less than keeping them raw, for every kind."""
    wide = rows.groupBy("intervention_id", "kind").agg(*[F.max(F.when(F.col("manager") == m, F.col(c))).alias(f"{n}_{c}") for m, n in zip(MANAGERS, ("full", "none", "raw", "ours"), strict=True) for c in ("repeated_invalid_action", "recovery_steps", "message_tokens", "selected_tokens", "card_precision", "expiry_correct")])
    less = lambda c, than: F.avg(F.col(f"ours_{c}") - F.col(f"{than}_{c}")) < 0
    by_kind = wide.groupBy("kind").agg((less("repeated_invalid_action", "none") & less("message_tokens", "raw")).alias("consistent"))
    return wide.agg(
        F.avg("ours_card_precision").alias("card_precision"),
        F.avg("ours_expiry_correct").alias("expiry_correctness"),
        less("repeated_invalid_action", "none").alias("fewer_repeats"),
        less("recovery_steps", "none").alias("faster_recovery"),
        less("message_tokens", "raw").alias("fewer_message_tokens"),
    ).join(F.broadcast(by_kind.agg(F.min("consistent").alias("failure_types_consistent")))).join(F.broadcast(rows.agg((F.sum("violations") == 0).alias("graphs_valid"))))
