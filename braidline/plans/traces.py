"""Queries of the exact trace fold, over messages made of the flat tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidline.operators import graph, interventions
from braidline.plans.contexts import NODES
from braidline.plans.exchanges import EX, GRAPH
from braidline.plans.registry import Registry
from braidline.scratch import table
from braidline.sources.adapters import event_exchanges
from braidline.sources.trajectories import edges_of, nodes_of, traces

R = Registry()


def _conversation_messages(t):
    return t("conversations").select(F.col("conv_id").cast("string").alias("session_id"), (F.col("turn") + 1).alias("ordinal"), F.to_json(F.struct("role", F.col("text").alias("content"))).alias("message"))


def _exchange_messages(t):
    """Each exchange as a calling message and its result: one tool, whose argument is the operation's key."""
    ex = event_exchanges(t("events"))
    name = F.concat_ws("-", "session_id", "ordinal")
    call = F.struct(F.lit("assistant").alias("role"), F.array(F.struct(name.alias("id"), F.lit("op").alias("name"), F.struct(F.col("k").alias("id")).alias("arguments"))).alias("tool_calls"))
    result = F.struct(F.lit("tool").alias("role"), name.alias("id"), F.when(F.col("err"), "no").otherwise("ok").alias("content"), F.col("err").alias("error"))
    pair = F.array(F.struct((F.col("ordinal") * 2 - 1).alias("ordinal"), F.to_json(call).alias("message")), F.struct((F.col("ordinal") * 2).alias("ordinal"), F.to_json(result).alias("message")))
    return ex.select(F.col("session_id").cast("string").alias("session_id"), F.explode(pair).alias("m")).select("session_id", "m.*")


@R.add("trace_fold_nodes", f"WITH {NODES} SELECT CAST(session_id AS VARCHAR) AS session_id, node_type, count(*) AS n, CAST(sum(token_count) AS BIGINT) AS tokens, max(CASE WHEN final THEN ordinal END) AS final_at FROM n GROUP BY session_id, node_type")
def trace_fold_nodes(t):
    n = nodes_of(traces(_conversation_messages(t), kind="node"))
    return n.groupBy("session_id", "node_type").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"), F.max(F.when(F.col("final"), F.col("ordinal"))).alias("final_at"))


@R.add(
    "trace_fold_edges",
    f"""WITH {GRAPH}, al AS (SELECT session_id, edge_type FROM edges UNION ALL SELECT session_id, 'leads_to' FROM ex UNION ALL SELECT session_id, CASE WHEN lag(err) OVER (PARTITION BY session_id ORDER BY ordinal) THEN 'blocks' ELSE 'supports' END FROM ex QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ordinal) > 1)
SELECT CAST(session_id AS VARCHAR) AS session_id, edge_type, count(*) AS n FROM al GROUP BY session_id, edge_type""",
)
def trace_fold_edges(t):
    """The state machine's relations are those of the window form, and those of decisions."""
    return edges_of(traces(_exchange_messages(t), kind="edge")).groupBy("session_id", "edge_type").agg(F.count("*").alias("n"))


@R.add(
    "tool_spans",
    f"WITH {EX} SELECT CAST(session_id AS VARCHAR) AS session_id, count(*) AS spans, CAST(max(3) AS BIGINT) AS largest, count(*) FILTER (side_effect) AS acting FROM ex GROUP BY session_id",
)
def tool_spans(t):
    """A span is what a calling message and its results gave: the decision, its call, the result."""
    ex = event_exchanges(t("events")).select(F.col("session_id").cast("string").alias("session_id"), (F.col("ordinal") * 2 - 1).alias("call_at"), "side_effect")
    # Four parts read it, and a fold runs again for each part that reads it: so a table, of the columns that they ask for.
    trace = table(traces(_exchange_messages(t)).select("session_id", "kind", "node_id", "node_type", "ordinal", "source", "target", "edge_type"), "trace")
    n = trace.where("kind = 'node'")
    calls = n.where("node_type = 'tool_call'").select("session_id", F.col("node_id").alias("call"), F.col("ordinal").alias("call_at"))
    results = trace.where("kind = 'edge' and edge_type in ('produces', 'failed_with')").select("session_id", F.col("source").alias("call"), F.col("target").alias("node_id"))
    same = n.select("session_id", F.col("ordinal").alias("call_at"), "node_id").join(calls, ["session_id", "call_at"])
    members = same.select("session_id", "call_at", "node_id").union(results.join(calls, ["session_id", "call"]).select("session_id", "call_at", "node_id"))
    spans = members.groupBy("session_id", "call_at").agg(F.count("*").alias("size")).join(ex, ["session_id", "call_at"])
    return spans.groupBy("session_id").agg(F.count("*").alias("spans"), F.max("size").alias("largest"), F.sum(F.col("side_effect").cast("bigint")).alias("acting"))


@R.add("protocol_errors", f"WITH {EX}, e AS (SELECT session_id, CASE WHEN ordinal % 7 = 0 THEN 'call_without_result' WHEN ordinal % 7 = 3 THEN 'result_without_call' END AS kind FROM ex) SELECT kind, count(*) AS n FROM e WHERE kind IS NOT NULL GROUP BY kind")
def protocol_errors(t):
    """Messages of exchanges, of which every seventh has lost its result and another its call."""
    ex = event_exchanges(t("events"))
    name = F.col("ordinal").cast("string")
    call = ex.where("ordinal % 7 <> 3").select("session_id", (F.col("ordinal") * 2 - 1).alias("ordinal"), F.lit("assistant").alias("role"), F.array(name).alias("call_ids"), F.lit(None).cast("string").alias("result_id"))
    result = ex.where("ordinal % 7 <> 0").select("session_id", (F.col("ordinal") * 2).alias("ordinal"), F.lit("tool").alias("role"), F.lit(None).cast("array<string>").alias("call_ids"), name.alias("result_id"))
    return graph.protocol_errors(call.union(result)).groupBy("kind").agg(F.count("*").alias("n"))


@R.add("intervention_specs", "WITH k AS (SELECT unnest(range(4)) AS i, unnest(['argument_correction', 'latest_failure_only', 'alternative_tool_completion', 'malformed_then_valid']) AS kind) SELECT concat('p1_', kind, '_', lpad(CAST(t AS VARCHAR), 2, '0')) AS intervention_id, kind, t AS task, 4100 + 8 * i + t AS seed, concat('E-', lpad(CAST(t AS VARCHAR), 3, '0')) AS entity FROM k, unnest(range(0, 8)) AS r(t)")
def intervention_specs(t):
    return t("region").sparkSession.createDataFrame([tuple(s.values()) for s in interventions.specs()], "intervention_id string, kind string, task bigint, seed bigint, entity string")


_MANAGERS = ", ".join(f"'{m}'" for m in interventions.MANAGERS)


@R.add(
    "intervention_runs",
    f"""WITH k AS (SELECT unnest(range(4)) AS i, unnest(['argument_correction', 'latest_failure_only', 'alternative_tool_completion', 'malformed_then_valid']) AS kind, unnest(['resolved', 'resolved', 'alternative_completed', 'corrected_syntax']) AS expiry), m AS (SELECT unnest([{_MANAGERS}]) AS manager)
SELECT concat('p1_', kind, '_', lpad(CAST(t AS VARCHAR), 2, '0')) AS intervention_id, manager, 4100 + 8 * i + t AS seed, manager <> 'ours_without_failure_retention' AS failure_visible, CASE WHEN manager = 'ours_without_failure_retention' THEN 1 ELSE 0 END AS repeated_invalid_action, CASE WHEN manager = 'ours_without_failure_retention' THEN 2 ELSE 1 END AS recovery_steps, CASE WHEN manager = 'full_ours' THEN 1.0::DOUBLE END AS card_precision, CASE WHEN manager = 'full_ours' THEN 1.0::DOUBLE END AS expiry_correct, expiry AS expected_expiry, 0 AS violations FROM k, m, unnest(range(0, 8)) AS r(t)""",
)
def intervention_runs(t):
    """The whole matrix, run: what contexts show follows from the policies, and cards end as they should."""
    rows = interventions.run(t("region").sparkSession)
    return rows.select("intervention_id", "manager", "seed", "failure_visible", "repeated_invalid_action", "recovery_steps", "card_precision", "expiry_correct", "expected_expiry", "violations")


@R.add("intervention_mechanism", "SELECT 1.0::DOUBLE AS card_precision, 1.0::DOUBLE AS expiry_correctness, true AS fewer_repeats, true AS faster_recovery, true AS fewer_message_tokens, true AS failure_types_consistent, true AS graphs_valid")
def intervention_mechanism(t):
    return interventions.mechanism(table(interventions.run(t("region").sparkSession), "interventions"))
