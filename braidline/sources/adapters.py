"""Nodes and edges from flat tables: conversations become decision traces, events become tool exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidline.functions.text import estimate_tokens


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """A node for each turn: system is a constraint, the first user turn the goal, later ones subgoals, assistant turns decisions; the last decision is final."""
    turns = conversations.select(
        F.col("conv_id").alias("session_id"),
        (F.col("turn") + 1).alias("ordinal"),
        "role",
        F.col("text").alias("content"),
    )
    asked = F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("session_id").orderBy("ordinal"))
    kind = F.when(F.col("role") == "system", "constraint").when(F.col("role") == "user", F.when(asked == 1, "goal").otherwise("subgoal")).otherwise("decision")
    last = F.max(F.when(F.col("role") == "assistant", F.col("ordinal"))).over(Window.partitionBy("session_id"))
    return turns.select(
        "session_id",
        "ordinal",
        F.col("ordinal").alias("step_id"),
        F.concat_ws(":", "session_id", "ordinal").alias("node_id"),
        kind.alias("node_type"),
        "content",
        estimate_tokens(F.col("content")).alias("token_count"),
        ((F.col("role") == "assistant") & F.col("ordinal").eqNullSafe(last)).alias("final"),
    )


def event_exchanges(events: DataFrame) -> DataFrame:
    """One call and its result for each event: the session is the user, the operation the key k, an error event a failure.

    prev_err and prev_ordinal are those of the previous exchange of the same operation, prev_ok the ordinal of
    the latest success before. A failure is answered or replaced by the next exchange of its operation, so they are
    all that retries, resolutions and supersessions need.
    """
    named = events.select(
        F.col("user_id").alias("session_id"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("ordinal"),
        "event_id",
        F.col("event_type").alias("tool_name"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        (F.col("event_type") == "error").alias("err"),
        F.col("event_type").isin("purchase", "signup").alias("side_effect"),
        "value",
    )
    same = Window.partitionBy("session_id", "k").orderBy("ordinal")
    before = same.rowsBetween(Window.unboundedPreceding, -1)
    return named.select("*", F.lag("err").over(same).alias("prev_err"), F.lag("ordinal").over(same).alias("prev_ordinal"), F.max(F.when(~F.col("err"), F.col("ordinal"))).over(before).alias("prev_ok"))


def exchange_nodes(ex: DataFrame) -> DataFrame:
    """A call and a result node for each exchange; results of errors are errors."""
    call = F.struct(F.lit("c").alias("side"), F.lit("tool_call").alias("node_type"))
    result = F.struct(F.lit("r").alias("side"), F.when(F.col("err"), "error").otherwise("observation").alias("node_type"))
    return ex.select("*", F.explode(F.array(call, result)).alias("n")).select(
        "session_id",
        F.concat_ws(":", F.col("session_id"), F.col("ordinal"), F.col("n.side")).alias("node_id"),
        F.col("n.node_type").alias("node_type"),
        "ordinal",
        F.col("ordinal").alias("step_id"),
        "tool_name",
        F.col("k").alias("operation_key"),
        (F.col("side_effect") & (F.col("n.side") == "c")).alias("side_effect"),
        (F.col("err") & (F.col("n.side") == "r")).alias("negative"),
    )


def exchange_edges(ex: DataFrame) -> DataFrame:
    """produces and failed_with within an exchange; retried_by, resolved_by and superseded_by between exchanges of an operation."""

    def edge(kind: str, source: str, left: str, target: str, match: str | None = None):
        name = lambda side, at: F.concat_ws(":", F.col("session_id"), F.col(at), F.lit(side))
        return F.struct(F.lit(kind).alias("edge_type"), name(left, source).alias("source"), name(target, "ordinal").alias("target"), F.lit(match).cast("string").alias("match_type"))

    again = F.coalesce("prev_err", F.lit(False))
    made = F.array(
        F.when(~F.col("err"), edge("produces", "ordinal", "c", "r")),
        F.when(F.col("err"), edge("failed_with", "ordinal", "c", "r")),
        F.when(again, edge("retried_by", "prev_ordinal", "c", "c", "structural_operation")),
        F.when(again & ~F.col("err"), edge("resolved_by", "prev_ordinal", "r", "r")),
        F.when(again & F.col("err"), edge("superseded_by", "prev_ordinal", "r", "r")),
        F.when(~F.col("err") & F.col("prev_ok").isNotNull(), edge("superseded_by", "prev_ok", "r", "r")),
    )
    return ex.select("session_id", F.explode(F.filter(made, lambda e: e.isNotNull())).alias("e")).select("session_id", "e.*").withColumn("confidence", F.lit(1.0))
