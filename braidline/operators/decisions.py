"""Decisions: object classes, representations, policy checks, the lifecycle machine, forms within a budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidline.operators.compiler import BEAM, RISK_WEIGHT, candidates_of, compile_beam, sweep  # noqa: F401 - what compiles decisions is found here too
from braidline.operators.context import fold_flags


def find_nodes(nodes: DataFrame, types: tuple[str, ...] | None = None, lifecycle: tuple[str, ...] | None = None, active: bool | None = None) -> DataFrame:
    """Nodes that meet every condition that is given."""
    for column, values in (("node_type", types), ("lifecycle", lifecycle)):
        if values is not None:
            nodes = nodes.where(F.col(column).isin(*values))
    return nodes if active is None else nodes.where(F.col("active") == active)


def object_class(node_type: Column, validity: Column, lifecycle: Column, tokens: Column, content: Column) -> Column:
    """One of six classes of what a context may hold; the first that fits."""
    confirms = F.lower(F.coalesce(content, F.lit(""))).rlike("confirm|explicit user consent")
    large = (tokens >= 128) | node_type.isin("summary", "archive_handle")
    return (
        F.when((node_type == "error") | (validity == "negative_unresolved"), "failure_negative_guard")
        .when((validity == "superseded") | (lifecycle == "superseded"), "superseded_conflicting_expired_state")
        .when((node_type == "constraint") | confirms, "policy_constraint_confirmation")
        .when(node_type.isin("goal", "subgoal"), "goal_subgoal")
        .when(node_type.isin("observation", "summary", "archive_handle") & large, "evidence_large_observation")
        .otherwise("entity_state_slot")
    )


def representations(kind: Column, verified: Column, archived: Column) -> Column:
    """The ways to show an object of a class, in order: never one that nothing verifies."""
    delta = kind.isin("entity_state_slot", "evidence_large_observation", "superseded_conflicting_expired_state")
    guard = (kind == "failure_negative_guard") & verified
    parts = F.array(F.lit("raw_message"), F.when(delta, "structured_state_delta"), F.when(verified, "verified_summary"), F.when(guard, "negative_guard"), F.when(archived, "archive_handle"), F.lit("omit"))
    return F.filter(parts, lambda x: x.isNotNull())


def check_actions(actions: DataFrame, rules: DataFrame) -> DataFrame:
    """actions (action_id, tool_name, arguments map, confirmed) with allowed, violations and missing, after all rules that apply.

    rules: (rule_id, trigger_tools, denied_tools, required_fields arrays, requires_confirmation); no trigger means every tool.
    A rule book is short, so its rows fold over each action as one array instead of a join.
    """
    book = rules.agg(F.array_sort(F.collect_list(F.struct("rule_id", "trigger_tools", "denied_tools", "required_fields", "requires_confirmation"))).alias("book"))
    rows = actions.join(F.broadcast(book))  # one row
    applies = F.filter("book", lambda r: (F.size(r["trigger_tools"]) == 0) | F.array_contains(r["trigger_tools"], F.col("tool_name")))
    rows = rows.withColumn("book", applies)
    denied = F.transform(F.filter("book", lambda r: F.array_contains(r["denied_tools"], F.col("tool_name"))), lambda r: F.concat(r["rule_id"], F.lit(":tool_denied")))
    needed = F.array_sort(F.array_distinct(F.flatten(F.transform("book", lambda r: r["required_fields"]))))
    missing = F.filter(needed, lambda f: F.coalesce(F.element_at(F.col("arguments"), f), F.lit("")) == "")
    unsure = F.exists("book", lambda r: r["requires_confirmation"]) & ~F.col("confirmed")
    rows = rows.withColumns({"missing": missing, "denied": denied, "unsure": unsure})
    violations = F.concat("denied", F.when(F.size("missing") > 0, F.array(F.lit("missing_required_policy_fields"))).otherwise(F.array().cast("array<string>")), F.when(F.col("unsure"), F.array(F.lit("confirmation_required"))).otherwise(F.array().cast("array<string>")))
    return rows.withColumn("violations", violations).withColumn("allowed", F.size("violations") == 0).drop("book", "denied", "unsure")


def lifecycle_machine(ex: DataFrame, effects: DataFrame) -> DataFrame:
    """The disposition of each exchange (session_id, ordinal, tool_name, entity, err) and its reason, from what comes later in its session.

    effects: (tool_name, effect, snapshot, receipt) for each tool. A first later event of a kind is a minimum
    over the frame that follows, so nothing is joined to what follows it. Unknown tools stay uncertain.
    """
    rows = ex.join(F.broadcast(effects), "tool_name", "left")  # a registry of tools
    entity = Window.partitionBy("session_id", "entity").orderBy("ordinal").rowsBetween(1, Window.unboundedFollowing)
    same = Window.partitionBy("session_id", "entity", "tool_name").orderBy("ordinal").rowsBetween(1, Window.unboundedFollowing)
    first = lambda c, w: F.min(F.when(c, F.col("ordinal"))).over(w)
    rows = rows.withColumns(
        {
            "retry": first(~F.col("err"), entity),
            "replacement": first(~F.col("err") & (F.col("snapshot") == "complete"), same),
            "invalidator": first(~F.col("err") & (F.col("effect") == "write"), entity),
        }
    )
    nothing = F.lit(None).cast("bigint")
    rule = lambda disposition, reason, target=nothing: F.struct(F.lit(disposition).alias("disposition"), F.lit(reason).alias("reason"), target.alias("target"))
    ruled = (
        F.when(F.col("effect").isNull(), rule("uncertain", "unknown"))
        .when(F.col("receipt"), rule("live_critical", "audit_required"))
        .when(F.col("err") & F.col("retry").isNull(), rule("live_critical", "active"))
        .when(F.col("err"), rule("safe_to_evict", "resolved", F.col("retry")))
        .when((F.col("snapshot") == "complete") & F.col("replacement").isNotNull(), rule("safe_to_evict", "superseded", F.col("replacement")))
        .when(F.col("invalidator").isNotNull(), rule("safe_to_evict", "invalidated", F.col("invalidator")))
        .otherwise(rule("live_noncritical", "active"))
    )
    return rows.select("session_id", "ordinal", ruled.alias("d")).select("session_id", "ordinal", "d.*")


# Reasons after which nothing depends on an event any more.
ENDED = ("consumed", "superseded", "invalidated", "resolved", "duplicate")


def relation_boolean(reason: Column, needed: Column, unsure: Column, obliged: Column, risky: Column) -> Column:
    """A disposition from yes-or-no evidence, failing closed: whether the current target needs the event, and whether that is uncertain."""
    return (
        F.when(obliged | (reason == "audit_required") | needed, "live_critical")
        .when(unsure | risky | (reason == "unknown"), "uncertain")
        .when(reason.isin(*ENDED), "safe_to_evict")
        .when(reason == "active", "live_noncritical")
        .otherwise("uncertain")
    )


def relation_first(reason: Column, need: Column, obliged: Column, risky: Column) -> Column:
    """A disposition from evidence, failing closed. need: required, useful, not_needed or uncertain."""
    ended = reason.isin(*ENDED)
    by_need = F.when(need == "required", "live_critical").when(need == "useful", "live_noncritical")
    return (
        F.when(obliged | (reason == "audit_required"), "live_critical")
        .when(risky | (reason == "unknown"), "uncertain")
        .when(ended, F.when(need == "not_needed", "safe_to_evict").otherwise(F.coalesce(by_need, F.lit("uncertain"))))
        .when(reason == "active", F.coalesce(by_need, F.lit("uncertain")))
        .otherwise("uncertain")
    )


def consensus(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, agreed, fields): a field's value where both passes agree on all fields, else uncertain. Unlike keys are an error."""
    both = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    lone = both.where(F.col(f"a.{key}").isNull() | F.col(f"b.{key}").isNull()).limit(1).count()
    if lone:
        raise ValueError("the passes do not cover the same items")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    return both.select(F.col(f"a.{key}").alias(key), same.alias("agreed"), *[F.when(same, F.col(f"a.{f}").cast("string")).otherwise("uncertain").alias(f) for f in fields])


def form_ladder(cards: DataFrame, order: list[Column], budget: int) -> DataFrame:
    """cards (session_id, full, compact: costs) with the form each takes in what is left of the budget: full, compact, minimal, or none.

    A minimal form is taken to be cut to what is left (cards.card_ladder cuts the text itself). A fold over each session's cards.
    """
    placed = cards.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(*order)))
    steps = F.array_sort(F.collect_list(F.struct("place", "full", "compact")))

    def form(a: Column, x: Column) -> Column:
        left = F.lit(budget) - a["used"]
        return F.when(left <= 0, "n").when(x["full"] <= left, "f").when(x["compact"] <= left, "c").otherwise("m")

    def used(a: Column, x: Column) -> Column:
        left = F.lit(budget) - a["used"]
        cost = F.when(left <= 0, 0).when(x["full"] <= left, x["full"]).when(x["compact"] <= left, x["compact"]).otherwise(left)
        return F.struct((a["used"] + cost).cast("bigint").alias("used"))

    held = placed.groupBy("session_id").agg(steps.alias("steps"))
    forms = held.select("session_id", fold_flags(F.col("steps"), F.struct(F.lit(0).cast("bigint").alias("used")), used, form).alias("forms"))
    names = F.create_map(*[F.lit(x) for x in ("f", "full", "c", "compact", "m", "minimal", "n", "none")])
    return placed.join(forms, "session_id").withColumn("form", names[F.substring(F.col("forms"), F.col("place"), F.lit(1))]).drop("forms")


def compress(labelled: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries, archived): chosen nodes (session_id, node_id) replaced by one summary a session. An unsafe one is an error."""
    rows = labelled.join(chosen, ["session_id", "node_id"], "left_semi")
    unsafe = rows.where("not removable").limit(3).collect()
    if unsafe:
        raise ValueError(f"not safe to compress: {[r.node_id for r in unsafe]}")
    archived = rows.select("session_id", "node_id", F.lit("archived").alias("lifecycle"))
    summary = rows.groupBy("session_id").agg(F.max("step_id").alias("step_id"), F.array_sort(F.collect_list("node_id")).alias("sources"))
    return summary.withColumn("node_type", F.lit("summary")), archived


def align_views(views: DataFrame, responses: DataFrame) -> DataFrame:
    """(session_id, view, ordinal): each view with the first response after what it selected and after the last one taken.

    views: (session_id, view, last_selected); responses: (session_id, ordinal). Each match depends on the one before, so a
    session is one fold.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ordinals, used, rows = sorted(right["ordinal"]), 0, []
        for view, last in left.sort_values("view")[["view", "last_selected"]].itertuples(index=False):
            later = [o for o in ordinals if o > used]
            found = next((o for o in later if o > last), next(iter(later), None))
            if found is not None:
                used = found
            rows.append((key[0], view, found))
        return pd.DataFrame(rows, columns=["session_id", "view", "ordinal"]).astype({"ordinal": "Int64"})

    kind = views.schema["session_id"].dataType.simpleString()
    return views.groupBy("session_id").cogroup(responses.groupBy("session_id")).applyInPandas(run, f"session_id {kind}, view bigint, ordinal bigint")


def fork_harm(rows: DataFrame) -> DataFrame:
    """(prefix_id, replicate) with the harm and tokens of each treatment side by side, and what they say about it."""
    wide = rows.groupBy("prefix_id", "replicate").pivot("treatment", ["raw_message", "compiled", "drop"]).agg(F.max("harm").alias("harm"), F.max("tokens").alias("tokens"))
    raw, comp, drop = F.col("raw_message_harm"), F.col("compiled_harm"), F.col("drop_harm")
    complete = raw.isNotNull() & comp.isNotNull() & drop.isNotNull()
    return wide.select(
        "prefix_id",
        "replicate",
        complete.alias("complete"),
        F.coalesce(complete & comp & ~raw, F.lit(False)).alias("unique_harm"),
        F.coalesce(complete & (comp != drop), F.lit(False)).alias("discordant"),
        F.when(complete & (F.col("raw_message_tokens") > 0), (F.col("raw_message_tokens") - F.col("compiled_tokens")) / F.col("raw_message_tokens")).alias("reduction"),
    )
