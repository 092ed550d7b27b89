"""Lifecycle of nodes: relevance, validity, storage, obligations and triggers from relations, labels, safety.

Nodes are those of a trace (session_id, node_id, node_type, step_id, semantic_outcome, side_effect, final, active, raw_ref);
relevance, validity, storage and lifecycle may be there from before and are then what inference starts from.
Edges are forward ones (see graph.normalize_legacy). What the edges of a node say is gathered once for each node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidline.schema import CALLS, NEGATIVE_OUTCOMES, RESULTS

#: Relations whose targets a node's profile names, in the order of its triggers.
ENDINGS = ("resolved_by", "superseded_by", "summarized_by")


def negative(outcome: Column, node_type: Column) -> Column:
    """Whether a result is negative: an error, or an outcome that says so."""
    return (node_type == "error") | F.coalesce(outcome.isin(*NEGATIVE_OUTCOMES), F.lit(False))


def _with_defaults(nodes: DataFrame) -> DataFrame:
    defaults = {"relevance": "unclassified", "validity": "unknown", "storage": "raw_in_context", "lifecycle": "active"}
    return nodes.withColumns({f"{c}_before": F.coalesce(F.col(c), F.lit(v)) if c in nodes.columns else F.lit(v) for c, v in defaults.items()}).drop(*defaults)


def relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id, node_id, what its outgoing edges are): flags by type, the targets of endings, and the final decisions it supports."""
    finals = nodes.where((F.col("node_type") == "decision") & F.col("final")).select("session_id", F.col("node_id").alias("target"), F.lit(True).alias("to_final"))
    marked = edges.join(finals, ["session_id", "target"], "left")
    types = ("produces", "failed_with", "supports", "leads_to", "blocks")
    supports = (F.col("edge_type") == "supports") & F.col("to_final")
    return marked.groupBy("session_id", F.col("source").alias("node_id")).agg(
        *[F.max((F.col("edge_type") == t).cast("int")).alias(f"has_{t}") for t in types],
        *[F.array_sort(F.collect_set(F.when(F.col("edge_type") == t, F.col("target")))).alias(t) for t in ENDINGS],
        F.array_sort(F.collect_set(F.when(supports, F.col("target")))).alias("finals"),
    )


def infer_profiles(nodes: DataFrame, edges: DataFrame, relevant: Column | None = None) -> DataFrame:
    """nodes with relevance, validity, storage, obligations, triggers, confidence, lifecycle (the one label they project to),
    active_after, and what relations() says. relevant: further nodes that stay active, by any rule over their columns."""
    found = relations(nodes, edges)
    rows = _with_defaults(nodes).join(found, ["session_id", "node_id"], "left")
    empty = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, empty) for c in (*ENDINGS, "finals")} | {c: F.coalesce(c, F.lit(0)) == 1 for c in found.columns if c.startswith("has_")})
    kind = F.col("node_type")
    later = F.max(F.when(kind == "decision", F.col("step_id"))).over(Window.partitionBy("session_id")) > F.col("step_id")
    has = lambda c: F.size(c) > 0
    relevance = (
        F.when(kind.isin(*CALLS) & (F.col("has_produces") | F.col("has_failed_with")), "consumed")
        .when((kind == "decision") & ~F.col("final"), F.when(F.col("has_leads_to") | later, "consumed").otherwise(F.col("relevance_before")))
        .when((kind == "observation") & F.col("has_supports"), "consumed")
        .when(~F.col("active"), "consumed")
    )
    if relevant is not None:
        relevance = relevance.when(relevant, "active")
    relevance = relevance.when(F.col("relevance_before") == "unclassified", "active").otherwise(F.col("relevance_before"))
    validity = (
        F.when(has("superseded_by"), "superseded")
        .when(negative(F.col("semantic_outcome"), kind), F.when(has("resolved_by"), "negative_resolved").otherwise("negative_unresolved"))
        .when((F.col("semantic_outcome") == "positive") | (kind == "summary"), "valid")
        .when((F.col("validity_before") == "unknown") & (kind == "observation"), "valid")
        .otherwise(F.col("validity_before"))
    )
    kept = F.col("raw_ref").isNotNull()
    stored = has("summarized_by") | (F.col("lifecycle_before") == "archived") | (F.col("storage_before") == "evicted")
    rows = rows.withColumns({"relevance": relevance, "validity": validity, "storage": F.when(stored & kept, "archived").otherwise(F.col("storage_before"))})
    obligations = F.array(
        F.when(F.col("side_effect"), "audit_required"),
        F.when((kind == "constraint") & F.col("active"), "active_constraint"),
        F.when(F.col("validity") == "negative_unresolved", "retain_until_action_complete"),
        F.when(has("finals") | (F.col("lifecycle_before") == "critical_evidence"), "critical_evidence"),
    )
    rows = rows.withColumns(
        {
            "obligations": F.filter(obligations, lambda x: x.isNotNull()),
            "triggers": F.array_distinct(F.concat(*[F.col(c) for c in ENDINGS], F.col("finals"))),
            "confidence": F.when(F.col("semantic_outcome").isNotNull(), 1.0).otherwise(0.8),
        }
    )
    rows = rows.withColumn("lifecycle", legacy_label())
    return rows.withColumn("active_after", (F.col("relevance") != "consumed") & (F.col("storage") == "raw_in_context"))


def legacy_label() -> Column:
    """The one label that a profile projects to."""
    obliged = lambda x: F.array_contains("obligations", x)
    error = F.col("node_type") == "error"
    return (
        F.when(obliged("audit_required"), "audit_required")
        .when(error & (F.col("validity") == "negative_unresolved"), "unresolved_failure")
        .when(error & (F.col("validity") == "negative_resolved"), "resolved_failure")
        .when(obliged("critical_evidence"), "critical_evidence")
        .when(F.col("validity") == "superseded", "superseded")
        .when(F.col("storage") == "archived", "archived")
        .when(F.col("relevance") == "consumed", "consumed")
        .otherwise("active")
    )


def apply_profiles(profiled: DataFrame) -> DataFrame:
    """Nodes as they are after their label has changed: active where relevant and in context; the others stay as they were."""
    changed = F.col("lifecycle") != F.col("lifecycle_before")
    return profiled.withColumn("active", F.when(changed, F.col("active_after")).otherwise(F.col("active")))


def transitions(profiled: DataFrame) -> DataFrame:
    """(session_id, node_id, before, after, triggers) of every node whose label changes."""
    return profiled.where("lifecycle_before <> lifecycle").select("session_id", "node_id", F.col("lifecycle_before").alias("before"), F.col("lifecycle").alias("after"), "triggers")


def sole_supporters(nodes: DataFrame, edges: DataFrame, only_active: bool) -> DataFrame:
    """(session_id, node_id): the one supporter of a final decision that has no other."""
    finals = nodes.where((F.col("node_type") == "decision") & F.col("final")).select("session_id", F.col("node_id").alias("target"))
    sources = nodes.where("active") if only_active else nodes
    found = edges.where("edge_type = 'supports'").join(finals, ["session_id", "target"], "left_semi")
    found = found.join(sources.select("session_id", F.col("node_id").alias("source")), ["session_id", "source"], "left_semi")
    return found.groupBy("session_id", "target").agg(F.count("*").alias("n"), F.min("source").alias("node_id")).where("n = 1").select("session_id", "node_id").distinct()


def safety_decisions(profiled: DataFrame, edges: DataFrame) -> DataFrame:
    """profiled with removable and reasons: what forbids that a node leaves the context, in order."""
    sole = sole_supporters(profiled, edges, True).withColumn("sole_active", F.lit(True))
    rows = profiled.join(sole, ["session_id", "node_id"], "left")
    kind = F.col("node_type")
    obliged = lambda x: F.array_contains("obligations", x)
    reasons = F.filter(
        F.array(
            F.when(kind.isin("goal", "subgoal") & F.col("active"), "active_goal"),
            F.when((kind == "constraint") & F.col("active"), "active_constraint"),
            F.when(F.col("validity") == "negative_unresolved", "unresolved_negative_evidence"),
            F.when(obliged("critical_evidence"), "critical_evidence"),
            F.when(obliged("active_constraint"), "active_constraint_obligation"),
            F.when(F.size("finals") > 0, "supports_final_decision"),
            F.when(F.col("sole_active"), "unique_final_evidence"),
        ),
        lambda x: x.isNotNull(),
    )
    rows = rows.withColumn("reasons", reasons).drop("sole_active")
    lost = F.col("raw_ref").isNull() & kind.isin(*CALLS, *RESULTS)
    bare = F.size("reasons") == 0
    one = lambda x: F.array(F.lit(x))
    return rows.withColumns({"removable": bare & ~lost, "reasons": F.when(~bare, F.col("reasons")).when(lost, one("missing_recoverable_raw_ref")).otherwise(one("safe_to_remove_from_active_context"))})
