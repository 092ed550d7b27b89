"""Complete traces from events: users, constraints, decisions, calls and results, with all relations between them.

An event is one exchange of its user's session: a decision, the call that it makes and the result. Every tenth step
begins with a user's turn, and each session has one constraint. Results of the type error are failures; views of every third key are
negative observations. What the tables do not say (texts, archive references, flags) follows from ordinals and keys by rule, so that
SQL can say it too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidline.functions.text import estimate_tokens
from braidline.sources.adapters import event_exchanges

REASONS = ("permission denied", "missing required parameter", "record not found", "timed out")


def story_exchanges(events: DataFrame) -> DataFrame:
    """Exchanges with neg (the result is negative), pos (it is positive) and what the same key's exchange before was."""
    ex = event_exchanges(events).drop("prev_err", "prev_ordinal", "prev_ok")
    neg = F.col("err") | (F.col("tool_name") == "view") & (F.col("k") % 3 == 0)
    same = Window.partitionBy("session_id", "k").orderBy("ordinal")
    before = same.rowsBetween(Window.unboundedPreceding, -1)
    ex = ex.withColumn("neg", neg).withColumn("pos", F.col("side_effect") & ~F.col("neg"))
    last = F.max("ordinal").over(Window.partitionBy("session_id"))
    of_previous = {"prev": F.lag("ordinal").over(same), "prev_neg": F.lag("neg").over(same), "prev_err": F.lag("err").over(same)}
    return ex.withColumns(of_previous | {"prev_ok": F.max(F.when(~F.col("neg"), F.col("ordinal"))).over(before), "last": last})


def _id(kind: str, at: Column | str = "ordinal") -> Column:
    return F.concat_ws(":", F.col("session_id"), F.col(at) if isinstance(at, str) else at, F.lit(kind))


def story_nodes(ex: DataFrame) -> DataFrame:
    """The nodes of exchanges."""
    o, k = F.col("ordinal"), F.col("k")
    reason = F.element_at(F.array(*[F.lit(r) for r in REASONS]), (k % 4 + 1).cast("int"))
    result = F.when(F.col("err"), F.concat(F.lit("error: "), reason, F.lit(" for key "), k.cast("string"))).otherwise(F.concat(F.lit("record "), F.col("event_id").cast("string"), F.lit(" of key "), k.cast("string"), F.repeat(F.lit(" field"), (o % 30).cast("int"))))
    call = F.concat(F.lit('{"arguments":{"id":'), k.cast("string"), F.lit(',"note":'), (o % 3).cast("string"), F.lit('},"tool_name":"op"}'))
    outcome = F.when(F.col("err") & (k % 4 == 0), "policy_denied").when(F.col("neg"), "negative").when(F.col("pos"), "positive").otherwise("inconclusive")
    false, none = F.lit(False), F.lit(None).cast("string")

    def node(kind: str, node_type: Column | str, content: Column, message: Column, outcome: Column = none, acts: Column = false) -> Column:
        tool = kind in "cr"
        return F.struct(
            _id(kind).alias("node_id"),
            (F.lit(node_type) if isinstance(node_type, str) else node_type).alias("node_type"),
            content.alias("content"),
            o.alias("step_id"),
            message.alias("ordinal"),
            (F.col("tool_name") if tool else none).alias("tool_name"),
            (k.cast("string") if tool else none).alias("operation_key"),
            (_id("c") if tool else none).alias("call_id"),
            outcome.alias("semantic_outcome"),
            acts.alias("side_effect"),
            (o == F.col("last") if kind == "d" else false).alias("final"),
            (o % 17 != 0 if kind == "r" else F.lit(True)).alias("active"),
            (F.when(o % 5 != 0, F.concat(F.lit("sha256:"), F.sha2(_id(kind), 256))) if tool else none).alias("raw_ref"),
            (F.create_map(F.lit("id"), k.cast("string"), F.lit("note"), (o % 3).cast("string")) if kind == "c" else F.lit(None).cast("map<string,string>")).alias("arguments"),
            (F.col("err") & (k % 8 == 7) if kind == "r" else false).alias("terminal"),
            (F.col("err") & (k % 8 == 5) if kind == "r" else false).alias("stale"),
        )

    made = [
        F.when(o % 10 == 1, node("u", F.when(o == 1, "goal").otherwise("subgoal"), F.concat(F.lit("task "), o.cast("string"), F.repeat(F.lit(" detail"), (o % 7).cast("int"))), o * 3 - 2)),
        node("d", "decision", F.concat(F.lit("decide step "), o.cast("string")), o * 3 - 1),
        node("c", "tool_call", call, o * 3 - 1, acts=F.col("side_effect")),
        node("r", F.when(F.col("err"), "error").otherwise("observation"), result, o * 3, outcome),
        F.when(o == 1, node("s", "constraint", F.lit("never act twice on one key"), F.lit(0).cast("bigint"))),
    ]
    rows = ex.select("session_id", F.explode(F.array(*made)).alias("n")).where("n is not null").select("session_id", "n.*")
    return rows.withColumn("token_count", estimate_tokens(F.col("content")))


def story_edges(ex: DataFrame) -> DataFrame:
    """The edges of exchanges: (session_id, source, target, edge_type, confidence)."""
    o = F.col("ordinal")

    def edge(kind: Column | str, source: Column, target: Column, confidence: Column | float = 1.0) -> Column:
        return F.struct(source.alias("source"), target.alias("target"), (F.lit(kind) if isinstance(kind, str) else kind).alias("edge_type"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"))

    again = F.coalesce("prev_neg", F.lit(False))
    made = [
        edge("leads_to", _id("d"), _id("c")),
        edge(F.when(F.col("err"), "failed_with").otherwise("produces"), _id("c"), _id("r")),
        F.when(o < F.col("last"), edge(F.when(F.col("neg"), "blocks").otherwise("supports"), _id("r"), _id("d", o + 1), 0.5)),
        F.when(~F.col("neg") & (o % 9 == 0) & (o + 1 < F.col("last")), edge("supports", _id("r"), _id("d", "last"), 0.5)),
        F.when(~F.col("neg") & (o % 6 == 0) & (o < F.col("last")), edge("provides_input", _id("r"), _id("d", o + 1), F.when(o % 12 == 0, 1.0).otherwise(0.8))),
        F.when(F.col("side_effect"), edge("blocks", _id("s", F.lit(1)), _id("c"), 0.5)),
        F.when(again, edge("retried_by", _id("c", "prev"), _id("c"), 0.8)),
        F.when(again & F.col("neg"), edge("superseded_by", _id("r", "prev"), _id("r"))),
        F.when(again & ~F.col("neg") & (F.col("prev_err") | F.col("pos")), edge("resolved_by", _id("r", "prev"), _id("r"))),
        F.when(~F.col("neg") & F.col("prev_ok").isNotNull(), edge("superseded_by", _id("r", "prev_ok"), _id("r"))),
    ]
    return ex.select("session_id", F.explode(F.array(*made)).alias("e")).where("e is not null").select("session_id", "e.*")
