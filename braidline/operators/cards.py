"""Failure cards: one compact record for each operation scope of a session, its class, expiry and guidance.

Nodes are profiled ones (see lifecycle.infer_profiles); calls have arguments (a map). A scope is the operation key of a
negative result, or its tool and node where there is none.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from braidline.functions.text import correction, estimate_tokens, failure_class, shrink, truncated
from braidline.operators.lifecycle import negative
from braidline.schema import CALLS

TTL_STEPS, CONFIDENCE = 8, 0.75
#: Edges by which a later node depends on a failure.
DEPENDING = ("blocks", "provides_input", "supports")
CARD_CLASSES = ("actionable", "terminal", "policy_denied", "malformed", "stale")


def _flag(nodes: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in nodes.columns else F.lit(False)


def producers(edges: DataFrame) -> DataFrame:
    """(session_id, node_id, call): the call that gave each result; one that produced it comes before one that failed with it."""
    made = edges.where(F.col("edge_type").isin("produces", "failed_with"))
    return made.groupBy("session_id", F.col("target").alias("node_id")).agg(F.max_by("source", F.struct((F.col("edge_type") == "produces").cast("int"), "source")).alias("call"))


def entity_ids(scope: Column) -> Column:
    """The values of a scope that is JSON with pairs under identity, each once, in order; none for any other scope."""
    pairs = F.from_json(F.get_json_object(scope, "$.identity"), "array<array<string>>")
    values = F.transform(pairs, lambda p: F.when(F.size(p) == 2, F.coalesce(F.from_json(F.get(p, 1), "array<string>"), F.array(F.get(p, 1)))))
    return F.coalesce(F.array_distinct(F.filter(F.flatten(F.filter(values, lambda v: v.isNotNull())), lambda v: v.isNotNull())), F.array().cast("array<string>"))


def argument_diff(before: Column, after: Column) -> Column:
    """A map of the arguments that differ: key to (before, after), null where absent."""
    zipped = F.map_zip_with(before, after, lambda k, x, y: F.struct(x.alias("before"), y.alias("after")))
    return F.map_filter(zipped, lambda k, v: ~v["before"].eqNullSafe(v["after"]))


def chains(profiled: DataFrame, edges: DataFrame) -> DataFrame:
    """Negative results with scope, family, the arguments of their call, its place in the scope's chain from the latest, and whether a later node depends on it."""
    calls = profiled.where(F.col("node_type").isin(*CALLS)).select("session_id", F.col("node_id").alias("call"), F.col("tool_name").alias("call_tool"), F.col("operation_key").alias("call_key"), F.col("arguments").alias("call_arguments"))
    made = producers(edges).join(calls, ["session_id", "call"], "left")
    steps = profiled.select("session_id", F.col("node_id").alias("target"), F.col("step_id").alias("at"))
    used = edges.where(F.col("edge_type").isin(*DEPENDING)).join(steps, ["session_id", "target"]).groupBy("session_id", F.col("source").alias("node_id")).agg(F.max("at").alias("used_at"))
    last = F.max("step_id").over(Window.partitionBy("session_id"))
    rows = profiled.withColumn("last_step", last).where(F.col("node_type").isin("error", "observation") & negative(F.col("semantic_outcome"), F.col("node_type")))
    rows = rows.join(made.select("session_id", "node_id", "call_tool", "call_key", "call_arguments"), ["session_id", "node_id"], "left").join(used, ["session_id", "node_id"], "left")
    tool = F.coalesce("tool_name", "call_tool", F.lit("unknown_tool"))
    scope = F.coalesce(F.col("call_key"), F.col("operation_key"), F.concat(tool, F.lit(":node:"), F.col("node_id")))
    rows = rows.withColumns({"operation_scope": scope, "action_family": tool})
    newest = Window.partitionBy("session_id", "operation_scope").orderBy(F.col("step_id").desc(), F.col("node_id").desc())
    return rows.withColumn("age", F.row_number().over(newest))


def failure_cards(profiled: DataFrame, edges: DataFrame, ttl_steps: int | None = TTL_STEPS, threshold: float = CONFIDENCE, scopes: DataFrame | None = None) -> DataFrame:
    """One row for each scope with a negative result: the card, its event (created, updated, expired, downgraded) and place among the active ones.

    scopes: (session_id, operation_scope, expiry_trigger) of operations that were completed otherwise, abandoned, or whose
    constraint has changed, as their session says.
    """
    rows = chains(profiled, edges)
    kind = failure_class(
        F.coalesce("content", F.lit("")),
        F.col("semantic_outcome"),
        explicit=F.when(F.col("failure_class").isin(*CARD_CLASSES), F.col("failure_class")) if "failure_class" in rows.columns else None,
        terminal=_flag(rows, "terminal"),
        stale=_flag(rows, "stale"),
        malformed=_flag(rows, "malformed_call"),
    )
    sure = F.coalesce(F.col("card_confidence"), F.lit(1.0)) if "card_confidence" in rows.columns else F.lit(1.0)
    latest = F.struct("step_id", "node_id", "content", "validity", "resolved_by", "superseded_by", "used_at", "last_step", "action_family", "raw_ref", "call_arguments", (F.col("next_admissible_correction") if "next_admissible_correction" in rows.columns else F.lit(None).cast("string")).alias("advice"), kind.alias("kind"), sure.alias("confidence"), _flag(rows, "final_accepted").alias("accepted"))
    cards = rows.groupBy("session_id", "operation_scope").agg(
        F.first(F.when(F.col("age") == 1, latest), ignorenulls=True).alias("l"),
        F.first(F.when(F.col("age") == 2, F.col("call_arguments")), ignorenulls=True).alias("before"),
        F.min("step_id").alias("created_step"),
        F.transform(F.array_sort(F.collect_list(F.struct("step_id", "node_id", "raw_ref"))), lambda x: F.struct(x["node_id"].alias("node_id"), x["raw_ref"].alias("raw_ref"))).alias("chain"),
    )
    cards = cards.select("session_id", "operation_scope", "created_step", "before", "chain", "l.*")
    fixed = _corrected_syntax(profiled, cards)
    told = scopes if scopes is not None else cards.sparkSession.createDataFrame([], f"session_id {cards.schema['session_id'].dataType.simpleString()}, operation_scope string, expiry_trigger string")
    cards = cards.join(fixed, ["session_id", "operation_scope"], "left").join(told.withColumnRenamed("expiry_trigger", "told"), ["session_id", "operation_scope"], "left")
    trigger = (
        F.when((F.size("resolved_by") > 0) | (F.col("validity") == "negative_resolved"), "resolved")
        .when((F.size("superseded_by") > 0) | (F.col("validity") == "superseded"), "superseded")
        .when(F.col("told").isNotNull(), F.col("told"))
        .when(F.col("accepted"), "final_accepted")
        .when((F.col("kind") == "malformed") & F.coalesce("fixed", F.lit(False)), "corrected_syntax")
        .when(F.col("kind") == "terminal", "terminal")
        .when(F.col("kind") == "stale", "stale")
    )
    if ttl_steps is not None and ttl_steps >= 0:
        cutoff = F.col("last_step") - ttl_steps
        trigger = trigger.when((F.col("step_id") < cutoff) & ~F.coalesce(F.col("used_at") >= cutoff, F.lit(False)), "ttl_expired")
    cards = cards.withColumn("expiry_trigger", trigger)
    live = F.col("expiry_trigger").isNull() & ~F.col("kind").isin("terminal", "stale")
    cards = cards.withColumn("active", live & (F.col("confidence") >= threshold))
    event = F.when(F.col("active"), F.when(F.size("chain") == 1, "created").otherwise("updated")).when(F.col("expiry_trigger").isNotNull(), "expired").otherwise("downgraded")
    first = F.col("kind").isin("actionable", "policy_denied").cast("int")
    order = Window.partitionBy("session_id", "active").orderBy(first.desc(), F.col("confidence").desc(), F.col("step_id").desc(), "operation_scope")
    return cards.select(
        "session_id",
        F.concat(F.lit("failure_card_"), F.substring(F.sha2("operation_scope", 256), 1, 16)).alias("card_id"),
        "operation_scope",
        "action_family",
        entity_ids(F.col("operation_scope")).alias("entity_ids"),
        F.col("kind").alias("failure_class"),
        F.col("content").alias("latest_failure_cause"),
        F.when(F.size("chain") > 1, argument_diff(F.coalesce("before", F.create_map().cast("map<string,string>")), F.coalesce("call_arguments", F.create_map().cast("map<string,string>")))).alias("failed_argument_diff"),
        F.coalesce("advice", correction(F.col("kind"))).alias("next_admissible_correction"),
        "confidence",
        "created_step",
        F.col("step_id").alias("last_relevant_step"),
        "expiry_trigger",
        F.array_distinct(F.filter(F.transform("chain", lambda x: x["raw_ref"]), lambda x: x.isNotNull())).alias("raw_archive_refs"),
        F.transform("chain", lambda x: x["node_id"]).alias("source_node_ids"),
        "active",
        event.alias("event"),
        F.when(F.col("active"), F.row_number().over(order)).alias("place"),
    )


def _corrected_syntax(profiled: DataFrame, cards: DataFrame) -> DataFrame:
    """(session_id, operation_scope, fixed): whether a later call of the family has valid arguments."""
    if "arguments_valid" not in profiled.columns:
        return cards.select("session_id", "operation_scope", F.lit(False).alias("fixed"))
    valid = profiled.where(F.col("node_type").isin(*CALLS) & F.col("arguments_valid")).groupBy("session_id", F.col("tool_name").alias("action_family")).agg(F.max("step_id").alias("valid_at"))
    return cards.join(valid, ["session_id", "action_family"], "left").select("session_id", "operation_scope", F.coalesce(F.col("valid_at") > F.col("step_id"), F.lit(False)).alias("fixed"))


def new_events(cards: DataFrame, recorded: DataFrame) -> DataFrame:
    """The events of cards that the audit (session_id, event, card_id, expiry_trigger, source_node_ids) lacks, each once."""
    key = ["session_id", "event", "card_id", "expiry_trigger", "source_node_ids"]
    rows = cards.select(*key, "operation_scope", "failure_class", "last_relevant_step").dropDuplicates(key)
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"r.{c}"))
    return rows.alias("n").join(recorded.select(*key).alias("r"), same, "left_anti")


def json_string(text: Column) -> Column:
    """A text as JSON has it, with its quotes; null where there is none."""
    quoted = F.to_json(F.array(text))
    return F.when(text.isNull(), "null").otherwise(F.substr(quoted, F.lit(2), F.length(quoted) - 2))


def json_strings(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(texts, json_string), ", "), F.lit("]"))


def json_object(**fields: Column) -> Column:
    """JSON as it is stored and counted: a space behind each comma and colon, fields in this order."""
    parts = [F.concat(F.lit(f'"{k}": '), v) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def full_payload() -> Column:
    """The whole of an active card: what it costs in a context."""
    entries = F.array_sort(F.map_entries(F.coalesce("failed_argument_diff", F.create_map().cast("map<string,struct<before:string,after:string>>"))))
    diff = F.transform(entries, lambda e: F.concat(json_string(e["key"]), F.lit(': {"before": '), json_string(e["value"]["before"]), F.lit(', "after": '), json_string(e["value"]["after"]), F.lit("}")))
    text = {c: json_string(F.col(c)) for c in ("card_id", "operation_scope", "action_family", "failure_class", "latest_failure_cause", "next_admissible_correction")}
    return json_object(
        card_id=text["card_id"],
        operation_scope=text["operation_scope"],
        action_family=text["action_family"],
        entity_ids=json_strings(F.col("entity_ids")),
        failure_class=text["failure_class"],
        latest_failure_cause=text["latest_failure_cause"],
        failed_argument_diff=F.concat(F.lit("{"), F.array_join(diff, ", "), F.lit("}")),
        next_admissible_correction=text["next_admissible_correction"],
        confidence=F.col("confidence").cast("string"),
        created_step=F.col("created_step").cast("string"),
        last_relevant_step=F.col("last_relevant_step").cast("string"),
        expiry_trigger=F.lit("null"),
        raw_archive_refs=json_strings(F.col("raw_archive_refs")),
        source_node_ids=json_strings(F.col("source_node_ids")),
        kind=json_string(F.lit("failure_card")),
    )


def last_ref() -> Column:
    return F.when(F.size("raw_archive_refs") > 0, F.get("raw_archive_refs", F.size("raw_archive_refs") - 1))


def compact_payload() -> Column:
    return json_object(
        kind=json_string(F.lit("failure_card")),
        action_family=json_string(F.col("action_family")),
        failure_class=json_string(F.col("failure_class")),
        latest_failure_cause=json_string(truncated(F.col("latest_failure_cause"), 24)),
        next_admissible_correction=json_string(truncated(F.col("next_admissible_correction"), 20)),
        raw_archive_ref=json_string(last_ref()),
    )


@F.pandas_udf(ArrayType(StructType([StructField("form", StringType()), StructField("cost", LongType())])))
def _ladder(cards: pd.Series, budget: pd.Series) -> pd.Series:
    def fit(left: int, card: dict) -> tuple[str, int]:
        if left <= 0:
            return "none", 0
        for form in ("full", "compact"):
            if card[form] <= left:
                return form, card[form]
        cut = shrink(card["minimal"], left)
        if cut:
            return "minimal", (len(cut.encode()) + 3) // 4
        return ("handle", card["handle"]) if card["handle"] is not None and card["handle"] <= left else ("none", 0)

    def run(some: list[dict], left: int) -> list[dict]:
        out = []
        for card in some:
            form, cost = fit(left, card)
            left -= cost
            out.append({"form": form, "cost": cost})
        return out

    return pd.Series([run(list(c), int(b)) for c, b in zip(cards, budget, strict=True)])


def card_ladder(cards: DataFrame, budgets: DataFrame) -> DataFrame:
    """(session_id, card_id, node_id, source_node_ids, form, cost): the form that each active card takes in what earlier ones leave of its
    session's budget (session_id, card_budget): full, compact, minimal, handle or none.

    A minimal card is a text cut to what is left, again and again, so a session's few cards are one row of an Arrow batch.
    """
    costed = cards.where("active").select(
        "session_id",
        F.struct(
            "place",
            "card_id",
            F.get("source_node_ids", F.size("source_node_ids") - 1).alias("node_id"),
            "source_node_ids",
            estimate_tokens(full_payload()).alias("full"),
            estimate_tokens(compact_payload()).alias("compact"),
            F.concat(F.lit("failure["), "action_family", F.lit("]: "), "latest_failure_cause").alias("minimal"),
            F.when(last_ref().isNotNull(), estimate_tokens(last_ref())).alias("handle"),
        ).alias("c"),
    )
    held = costed.groupBy("session_id").agg(F.array_sort(F.collect_list("c")).alias("c")).join(budgets, "session_id")
    formed = held.withColumn("f", _ladder(F.transform("c", lambda x: F.struct(x["full"].alias("full"), x["compact"].alias("compact"), x["minimal"].alias("minimal"), x["handle"].alias("handle"))), F.col("card_budget")))
    rows = formed.select("session_id", F.explode(F.arrays_zip("c", "f")).alias("x"))
    return rows.select("session_id", "x.c.card_id", "x.c.node_id", "x.c.source_node_ids", "x.f.form", "x.f.cost")
