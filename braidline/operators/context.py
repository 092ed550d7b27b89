"""Context selection: policies that choose nodes of a session under a token budget, and measures of what they chose.

Nodes are (session_id, ordinal, step_id, node_id, node_type, content, token_count, final). A policy
returns one row for each node with kept, the tokens that it costs in the context, and whether it still stands for its source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from braidline.functions.text import estimate_tokens, truncated
from braidline.operators import cards, lifecycle
from braidline.schema import CALLS, RESULTS
from braidline.scratch import table


def by_session() -> WindowSpec:
    return Window.partitionBy("session_id")


def fold_flags(steps: Column, start: Column, state: Callable[[Column, Column], Column], flag: Callable[[Column, Column], Column]) -> Column:
    """One flag (a character) for each of the steps, from a fold whose state is a struct.

    A fold that appends copies what it has at every step. So steps are folded in runs of about the root of their number,
    whose flags are appended as one: n steps copy n ** 1.5 characters, not their square.
    """
    size = F.size(steps)
    run = F.greatest(F.lit(1), F.ceil(F.sqrt(size.cast("double"))).cast("int"))
    one = lambda a, x: F.struct(state(a["s"], x).alias("s"), F.concat(a["f"], flag(a["s"], x)).alias("f"))

    def some(a: Column, i: Column) -> Column:
        inner = F.aggregate(F.slice(steps, i * run + 1, run), F.struct(a["s"].alias("s"), F.lit("").alias("f")), one)
        return F.get(F.transform(F.array(inner), lambda x: F.struct(x["s"].alias("s"), F.concat(a["f"], x["f"]).alias("f"))), 0)

    runs = F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / run).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(runs, F.struct(start.alias("s"), F.lit("").alias("f")), some)["f"]


def greedy(nodes: DataFrame, order: list[Column], cost: Column, budget: int | Column | None, group: list[str] | None = None, mandatory: Column | None = None, spent: Column | None = None) -> DataFrame:
    """nodes with cost and kept: in order, a node is kept if it still fits; one that does not is skipped.

    A running sum cannot say that, as what is skipped does not count: a fold over each session's sorted
    costs can. Only places and costs are folded, to a character a node; the rows stay where they are. mandatory: what is kept
    first, whatever it costs; spent: what else counts against the budget, equal in all rows of a group; a null budget keeps all.
    """
    group = group or ["session_id"]
    place = Window.partitionBy(*group).orderBy(*order)
    costed = nodes.withColumns({"cost": cost, "place": F.row_number().over(place), "must": F.lit(False) if mandatory is None else mandatory})
    if budget is None:
        return costed.withColumn("kept", F.lit(True)).drop("place", "must")
    limit = F.lit(budget) if isinstance(budget, int) else budget
    costed = costed.withColumns({"limit_": limit.cast("bigint"), "spent_": F.lit(0).cast("bigint") if spent is None else spent.cast("bigint")})
    steps = F.array_sort(F.collect_list(F.struct("place", "cost", "must")))
    base = F.sum(F.when(F.col("must"), F.col("cost")).otherwise(0)) + F.max("spent_")
    held = costed.groupBy(*group).agg(steps.alias("steps"), base.cast("bigint").alias("base"), F.max("limit_").alias("limit_"))
    fits = lambda a, x: ~x["must"] & (F.col("limit_").isNull() | (a["total"] + x["cost"] <= F.col("limit_")))
    flags = fold_flags(
        F.col("steps"),
        F.struct(F.col("base").alias("total")),
        lambda a, x: F.struct((a["total"] + F.when(fits(a, x), x["cost"]).otherwise(F.lit(0))).cast("bigint").alias("total")),
        lambda a, x: F.when(x["must"] | fits(a, x), "1").otherwise("0"),
    )
    flagged = held.select(*group, flags.alias("flags"))
    return costed.join(flagged, group).withColumn("kept", F.substring(F.col("flags"), F.col("place"), F.lit(1)) == "1").drop("place", "flags", "must", "limit_", "spent_")


def greedy_many(nodes: DataFrame, order: list[Column], cost: Column, plans: dict[str, tuple[int, Column | None]]) -> DataFrame:
    """nodes with place, cost and, for each plan (budget, what is mandatory), kept_<name>: one sort, one fold a plan over the same sorted costs, one join."""
    group = ["session_id"]
    musts = {f"must_{n}": F.lit(False) if m is None else m for n, (_, m) in plans.items()}
    costed = nodes.withColumns({"cost": cost, "place": F.row_number().over(Window.partitionBy(*group).orderBy(*order))} | musts)
    steps = F.array_sort(F.collect_list(F.struct("place", "cost", *musts)))
    base = [F.sum(F.when(F.col(f"must_{n}"), F.col("cost")).otherwise(0)).cast("bigint").alias(f"base_{n}") for n in plans]
    held = costed.groupBy(*group).agg(steps.alias("steps"), *base)

    def flags(name: str, budget: int) -> Column:
        fits = lambda a, x: ~x[f"must_{name}"] & (a["total"] + x["cost"] <= budget)
        return fold_flags(F.col("steps"), F.struct(F.col(f"base_{name}").alias("total")), lambda a, x: F.struct((a["total"] + F.when(fits(a, x), x["cost"]).otherwise(F.lit(0))).cast("bigint").alias("total")), lambda a, x: F.when(x[f"must_{name}"] | fits(a, x), "1").otherwise("0"))

    flagged = held.select(*group, *[flags(n, b).alias(f"flags_{n}") for n, (b, _) in plans.items()])
    joined = costed.join(flagged, group)
    return joined.withColumns({f"kept_{n}": F.substring(F.col(f"flags_{n}"), F.col("place"), F.lit(1)) == "1" for n in plans}).drop(*musts, *[f"flags_{n}" for n in plans])


def _view(chosen: DataFrame, stands: Column | None = None) -> DataFrame:
    return chosen.withColumn("stands", F.col("kept") & (F.lit(True) if stands is None else stands))


def full_trajectory(nodes: DataFrame, budget: int | None = None) -> DataFrame:
    return _view(nodes.withColumns({"cost": F.col("token_count"), "kept": F.lit(True)}))


def last_k(nodes: DataFrame, budget: int | None = None, k: int = 8) -> DataFrame:
    """The newest k nodes, whatever they cost."""
    return _view(nodes.withColumns({"cost": F.col("token_count"), "kept": F.row_number().over(by_session().orderBy(F.col("step_id").desc(), F.col("node_id").desc())) <= k}))


def newest_first(nodes: DataFrame, budget: int | None = 2048) -> DataFrame:
    return _view(greedy(nodes, [F.col("step_id").desc(), F.col("node_id").desc()], F.col("token_count"), 2048 if budget is None else budget))


def summary_only(nodes: DataFrame, budget: int | None = None, tokens: int = 24) -> DataFrame:
    """Every node as a cut summary, which does not stand for its source."""
    return _view(greedy(nodes, [F.col("step_id"), F.col("node_id")], estimate_tokens(truncated(F.col("content"), tokens)), budget), F.lit(False))


def scored(nodes: DataFrame, budget: int | None = None, score: Column | None = None) -> DataFrame:
    """By score: place in the session, and one more for errors, constraints and decisions. score replaces it."""
    if score is None:
        last = F.max("step_id").over(by_session())
        score = F.col("step_id") / F.greatest(F.lit(1), last) + F.col("node_type").isin("error", "constraint", "decision").cast("double")
    ranked = nodes.withColumn("score", score)
    return _view(greedy(ranked, [F.col("score").desc(), F.col("step_id"), F.col("node_id")], F.col("token_count"), budget)).drop("score")


def nonredundant(nodes: DataFrame, budget: int | None = None) -> DataFrame:
    """Only the newest of equal contents; superseded and archived nodes go first. What does not fit still counts as seen."""
    waste = F.col("lifecycle").isin("superseded", "archived") if "lifecycle" in nodes.columns else F.lit(False)
    newest = Window.partitionBy("session_id", F.sha2(F.coalesce("content", F.lit("")), 256), "waste").orderBy(F.col("step_id").desc(), F.col("node_id").desc())
    marked = nodes.withColumn("waste", waste).withColumn("candidate", ~F.col("waste") & (F.row_number().over(newest) == 1)).drop("waste")
    order = [F.col("step_id").desc(), F.col("node_id").desc()]
    chosen = greedy(marked.where("candidate"), order, F.col("token_count"), budget)
    rest = marked.where("not candidate").withColumns({"cost": F.col("token_count"), "kept": F.lit(False)})
    return _view(chosen.unionByName(rest).drop("candidate"))


def truncated_history(nodes: DataFrame, budget: int | None = None, tokens: int = 20) -> DataFrame:
    """Tool nodes are cut, the others stay whole."""
    tool = F.col("node_type").isin("observation", "error", "tool_call")
    cost = F.when(tool, estimate_tokens(truncated(F.col("content"), tokens))).otherwise(F.col("token_count"))
    return _view(greedy(nodes, [F.col("step_id"), F.col("node_id")], cost, budget), ~tool)


#: Columns that policies over graphs read, and what they are where a table lacks them.
DEFAULTS = {"tool_name": "cast(null as string)", "operation_key": "cast(null as string)", "semantic_outcome": "cast(null as string)", "raw_ref": "cast(null as string)", "side_effect": "false", "final": "false", "active": "true", "arguments": "cast(null as map<string,string>)"}
EDGES = "source string, target string, edge_type string, confidence double"


def completed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({c: F.expr(v) for c, v in DEFAULTS.items() if c not in nodes.columns})


def no_edges(nodes: DataFrame) -> DataFrame:
    return nodes.sparkSession.createDataFrame([], f"session_id {nodes.schema['session_id'].dataType.simpleString()}, {EDGES}")


def _profiled(nodes: DataFrame, edges: DataFrame, use_lifecycle: bool) -> DataFrame:
    """Nodes with profiles, as they are after these have been applied; without lifecycle use, with the profile of a node that has none."""
    rows = table(lifecycle.infer_profiles(completed(nodes), edges), "profiles")  # several parts of a policy read them
    if use_lifecycle:
        return lifecycle.apply_profiles(rows)
    plain = {"relevance": F.lit("unclassified"), "validity": F.lit("unknown"), "storage": F.lit("raw_in_context"), "lifecycle": F.col("lifecycle_before"), "obligations": F.array().cast("array<string>")}
    return rows.withColumns(plain)


def _joined_reasons(*reasons: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(F.array(*reasons), lambda x: x.isNotNull())), ",")


def _form(*rules: tuple[Column, str]) -> Column:
    out = F.when(F.lit(False), "")
    for test, name in rules:
        out = out.when(test, name)
    return out


def _cost() -> Column:
    """What a node costs in its form: whole, as a short summary, or as the handle of its archived record."""
    return F.when(F.col("form") == "summary", estimate_tokens(truncated(F.col("content"), 16))).when(F.col("form") == "handle", estimate_tokens(F.col("raw_ref"))).otherwise(F.col("token_count"))


def raw_hard_failures(nodes: DataFrame, edges: DataFrame, budget: int | None = None, use_graph_edges: bool = True, use_lifecycle: bool = True, retain_failures: bool = True, retain_constraints: bool = True) -> DataFrame:
    """Whatever has a reason to stay does, beyond the budget if need be: goals, constraints, open failures, audits, active and critical nodes, what supports
    the end or blocks an action. The rest fits newest first, ended failures as summaries before it."""
    rows = _profiled(nodes, edges, use_lifecycle)
    kind, validity = F.col("node_type"), F.col("validity")
    yes = lambda on, test, name: F.when(test, name) if on else F.lit(None).cast("string")
    obliged = lambda x: F.array_contains("obligations", x)
    reasons = _joined_reasons(
        F.when(kind.isin("goal", "subgoal") & F.col("active"), "active_goal"),
        F.when((kind == "constraint") & F.col("active"), "active_constraint"),
        yes(retain_failures, validity == "negative_unresolved", F.when(kind == "error", "unresolved_failure").otherwise("unresolved_negative_evidence")),
        F.when(obliged("audit_required") | F.col("side_effect"), "audit_required"),
        yes(use_lifecycle, F.col("relevance") == "active", "lifecycle:active"),
        yes(use_lifecycle, obliged("critical_evidence"), "obligation:critical_evidence"),
        yes(use_lifecycle, obliged("active_constraint"), "obligation:active_constraint"),
        yes(use_lifecycle and retain_failures, obliged("retain_until_action_complete"), "obligation:retain_until_action_complete"),
        yes(use_graph_edges, F.size("finals") > 0, "supports_final_decision"),
        yes(use_graph_edges, F.col("has_blocks"), "blocks_action"),
    )
    bare = F.lit(False)
    if not retain_constraints:
        bare = bare | (kind == "constraint")
    if not retain_failures:
        bare = bare | (kind == "error") | validity.isin("negative_unresolved", "negative_resolved")
    rows = rows.withColumn("reason", F.when(bare, "").otherwise(reasons)).withColumn("hard", F.col("reason") != "")
    ended = validity.isin("negative_resolved", "superseded") | F.col("lifecycle").isin("resolved_failure", "superseded")
    archived = (F.col("storage") == "archived") | (F.col("lifecycle") == "archived")
    rows = rows.withColumn("form", _form((F.col("hard"), "whole"), (ended, "summary"), (archived & F.col("raw_ref").isNull(), "left out"), (archived, "handle"), (F.lit(True), "whole")))
    rows = rows.withColumn("priority", F.col("step_id") + F.when(F.col("form") == "summary", 10_000).otherwise(0))
    return _select(rows, budget)


def _select(rows: DataFrame, budget: int | None, spent: Column | None = None) -> DataFrame:
    """Hard nodes and, by priority, what of the others fits. What is left out has no item of its own."""
    order = [(F.col("form") == "left out").cast("int"), F.col("priority").desc(), F.col("step_id"), F.col("node_id")]
    out = F.col("form") == "left out"
    limit = F.lit(budget).cast("bigint")
    cost = F.when(out, F.lit(None).cast("bigint")).otherwise(_cost())  # no cost fits no budget
    chosen = greedy(rows, order, cost, limit, mandatory=F.col("hard"), spent=spent)
    chosen = chosen.withColumns({"kept": F.col("kept") & ~out, "cost": F.coalesce("cost", F.lit(0).cast("bigint"))})
    return _view(chosen, F.col("form") == "whole")


def full_ours(nodes: DataFrame, edges: DataFrame, budget: int | None = None, use_graph_edges: bool = True, use_lifecycle: bool = True, retain_failures: bool = True, retain_constraints: bool = True, fraction: float = 0.125, threshold: float = cards.CONFIDENCE, ttl_steps: int | None = cards.TTL_STEPS) -> tuple[DataFrame, DataFrame]:
    """(view, card items). Goals, the current subgoal, constraints, pending confirmations and evidence that nothing else has stay, whatever they cost.
    Open failures are cards within a fraction of the budget; ended ones are summaries before all others, recoverable critical
    evidence before these, and the rest fits newest first. Failed calls and acts leave, as the archive has them."""
    rows = _profiled(nodes, edges, use_lifecycle)
    kind, validity = F.col("node_type"), F.col("validity")
    bad = (kind == "error") | validity.isin("negative_unresolved", "negative_resolved", "superseded")
    rows = rows.withColumn("bad", bad)
    calls = cards_calls(rows, edges)
    sole = lifecycle.sole_supporters(rows, edges, False).withColumn("sole", F.lit(True))
    rows = rows.join(calls, ["session_id", "node_id"], "left").join(sole, ["session_id", "node_id"], "left")
    current = F.max(F.when((kind == "subgoal") & F.col("active"), F.struct("step_id", "node_id"))).over(by_session())["node_id"]
    critical = F.array_contains("obligations", "critical_evidence")
    lost = F.col("raw_ref").isNull()
    pending = F.col("pending_confirmation") if "pending_confirmation" in rows.columns else F.lit(False)
    none = F.lit(None).cast("string")
    reason = _joined_reasons(
        F.when((kind == "goal") & F.col("active"), "current_goal"),
        F.when((kind == "subgoal") & (F.col("node_id") == current), "current_subgoal"),
        F.when((kind == "constraint") & F.col("active"), "active_constraint") if retain_constraints else none,
        F.when(pending, "pending_irreversible_confirmation"),
        F.when(lost & critical, "unique_unrecoverable_critical_evidence") if use_lifecycle else none,
        F.when(lost & F.col("sole"), "unique_unrecoverable_final_evidence") if use_graph_edges else none,
    )
    rows = rows.withColumn("reason", reason).withColumn("hard", F.col("reason") != "")
    ended = validity.isin("negative_resolved", "superseded")
    archived = (F.col("storage") == "archived") | (F.col("lifecycle") == "archived")
    audited = F.col("side_effect") | F.array_contains("obligations", "audit_required")
    form = _form(
        (F.col("hard"), "whole"),
        (F.col("bad") & ended, "summary" if retain_failures else "left out"),
        (F.col("bad") | F.coalesce("failed_call", F.lit(False)) | audited, "left out"),
        (critical, "critical"),
        (archived & lost, "left out"),
        (archived, "handle"),
        (F.lit(True), "whole"),
    )
    rows = rows.withColumn("form", form)
    rows = rows.withColumn("priority", F.col("step_id") + F.when(F.col("form") == "summary", 10_000).when(F.col("form") == "critical", 20_000).otherwise(0))
    rows = rows.withColumn("form", F.when(F.col("form") == "critical", "whole").otherwise(F.col("form")))
    sums = rows.groupBy("session_id").agg(F.sum(F.when(F.col("hard"), F.col("token_count")).otherwise(0)).alias("hard_tokens"), F.sum("token_count").alias("original"))
    whole = F.lit(budget).cast("bigint") if budget is not None else F.col("original")
    room = F.least(F.floor(whole * F.lit(float(fraction))), F.greatest(F.lit(0), whole - F.col("hard_tokens"))).cast("bigint")
    budgets = sums.select("session_id", room.alias("card_budget"))
    if retain_failures and use_lifecycle:
        active = table(cards.failure_cards(rows, edges, ttl_steps, threshold).where("active"), "cards")
        items = table(cards.card_ladder(active, budgets), "card-items")
    else:
        items = rows.sparkSession.createDataFrame([], f"session_id {rows.schema['session_id'].dataType.simpleString()}, card_id string, node_id string, source_node_ids array<string>, form string, cost bigint")
    items = items.where("form <> 'none'")
    spent = items.groupBy("session_id").agg(F.sum("cost").alias("card_tokens"))
    rows = rows.join(spent, "session_id", "left")
    return _select(rows, budget, F.coalesce("card_tokens", F.lit(0))), items


def cards_calls(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id, node_id, failed_call): calls that gave a bad result (column bad)."""
    made = edges.where(F.col("edge_type").isin("produces", "failed_with"))
    bad = rows.where("bad").select("session_id", F.col("node_id").alias("target"))
    return made.join(bad, ["session_id", "target"], "left_semi").select("session_id", F.col("source").alias("node_id"), F.lit(True).alias("failed_call")).distinct()


def upper_bound(nodes: DataFrame, edges: DataFrame, budget: int | None = None) -> DataFrame:
    """What may not be removed, and nothing else, whatever the budget: no policy can lose less."""
    rows = lifecycle.safety_decisions(_profiled(nodes, edges, True), edges)
    chosen = rows.withColumns({"cost": F.col("token_count"), "kept": ~F.col("removable"), "reason": F.array_join("reasons", ",")})
    return _view(chosen)


def covered_by(view: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """view with covered: the node stands for itself, or a card that is no mere handle has it among its sources."""
    if items is None:
        return view.withColumn("covered", F.col("stands"))
    sources = items.where("form <> 'handle'").select("session_id", F.explode("source_node_ids").alias("node_id"), F.lit(True).alias("in_card")).distinct()
    return view.join(sources, ["session_id", "node_id"], "left").withColumn("covered", F.col("stands") | F.coalesce("in_card", F.lit(False))).drop("in_card")


def evaluate_view(view: DataFrame, edges: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """One row a session of how a policy did: tokens, compression, what it retains of evidence, open failures, constraints and paths to final
    decisions, what is recoverable, retries, and how many nodes it removed unsafely. A rate without a denominator is one."""
    rows = table(lifecycle.safety_decisions(covered_by(view, items), edges), "judged-view")
    kind = F.col("node_type")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    sets = {
        "evidence": (F.col("lifecycle") == "critical_evidence") | F.array_contains("obligations", "critical_evidence") | (F.size("finals") > 0),
        "unresolved_failure": (F.col("validity") == "negative_unresolved") | (kind == "error") & (F.size("resolved_by") == 0),
        "constraint": (kind == "constraint") & F.col("active"),
    }
    archived = kind.isin(*CALLS, *RESULTS) & F.col("raw_ref").isNotNull()
    sums = rows.groupBy("session_id").agg(
        F.sum("token_count").alias("original_tokens"),
        F.sum(F.when(F.col("kept"), F.col("cost")).otherwise(0)).alias("own_tokens"),
        *[x for name, test in sets.items() for x in (n(test).alias(f"all_{name}"), n(test & F.col("covered")).alias(f"kept_{name}"))],
        n(archived).alias("archived"),
        n(~F.col("covered") & ~F.col("removable")).alias("unsafe_removal_count"),
        n((kind == "decision") & F.col("final")).alias("finals"),
    )
    held = rows.where("covered").select("session_id", "node_id", F.explode("finals").alias("final_id"))
    paths = held.groupBy("session_id", "final_id").agg(F.lit(1).alias("x")).groupBy("session_id").agg(F.count("*").alias("paths"))
    retries = edges.where(F.col("edge_type") == "retried_by").groupBy("session_id").agg(F.count("*").alias("retries"))
    out = sums.join(paths, "session_id", "left").join(retries, "session_id", "left")
    spent = F.lit(0).cast("bigint")
    if items is not None:
        out = out.join(items.groupBy("session_id").agg(F.sum("cost").alias("card_tokens")), "session_id", "left")
        spent = F.coalesce("card_tokens", F.lit(0))
    rate = lambda a, b: F.when(b == 0, 1.0).otherwise(a / b)
    tokens = F.col("own_tokens") + spent
    return out.select(
        "session_id",
        tokens.alias("input_tokens"),
        "original_tokens",
        F.when(F.col("original_tokens") <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - tokens / F.col("original_tokens"))).alias("compression_ratio"),
        *[rate(F.col(f"kept_{x}"), F.col(f"all_{x}")).alias(f"{x}_retention") for x in sets],
        rate(F.coalesce("paths", F.lit(0)), F.col("finals")).alias("evidence_path_preservation"),
        rate(F.col("archived"), F.col("archived")).alias("archive_recoverability"),
        F.coalesce("retries", F.lit(0)).cast("bigint").alias("repeated_failed_tool_calls"),
        "unsafe_removal_count",
    )


def profiled_view(view: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What a policy that reads no relations chose, with the profiles that evaluate_view() needs."""
    rows = _profiled(nodes, edges, True)
    return rows.join(view.select("session_id", "node_id", "cost", "kept", "stands"), ["session_id", "node_id"])


#: The flagship policy and its ablations: options of full_ours().
FLAGSHIP: dict[str, dict[str, bool]] = {
    "full_ours": {},
    "ours_without_graph_edges": {"use_graph_edges": False},
    "ours_without_lifecycle_states": {"use_lifecycle": False},
    "ours_without_failure_retention": {"retain_failures": False},
    "ours_without_constraint_retention": {"retain_constraints": False},
}


def _view_of(**options: bool) -> Callable[..., DataFrame]:
    return lambda nodes, budget=None, edges=None: full_ours(nodes, no_edges(nodes) if edges is None else edges, budget, **options)[0]


#: Policies by name: functions of nodes, budget and, for those that read relations, edges.
POLICIES: dict[str, Callable[..., DataFrame]] = {
    "full_trajectory": full_trajectory,
    "last_k": last_k,
    "token_length_pruning": newest_first,
    "summary_only": summary_only,
    "llm_only_pruning": scored,
    "agentdiet_style": nonredundant,
    "acon_style": truncated_history,
    "raw_hard_failure_retention": lambda nodes, budget=None, edges=None: raw_hard_failures(nodes, no_edges(nodes) if edges is None else edges, budget),
    **{name: _view_of(**options) for name, options in FLAGSHIP.items()},
}


def view_metrics(view: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row a session: tokens before and after, compression, and the share of constraints that are still covered."""
    constraint = F.col("node_type") == "constraint"
    sums = view.groupBy(*(by or ["session_id"])).agg(
        F.sum("token_count").alias("original_tokens"),
        F.sum(F.when(F.col("kept"), F.col("cost")).otherwise(0)).alias("selected_tokens"),
        F.sum(F.col("kept").cast("bigint")).alias("kept"),
        F.sum((~F.col("kept")).cast("bigint")).alias("dropped"),
        F.sum(constraint.cast("bigint")).alias("constraints"),
        F.sum((constraint & F.col("stands")).cast("bigint")).alias("covered"),
    )
    ratio = F.when(F.col("original_tokens") <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("selected_tokens") / F.col("original_tokens")))
    return sums.withColumns({"compression_ratio": ratio, "constraint_retention": F.when(F.col("constraints") == 0, 1.0).otherwise(F.col("covered") / F.col("constraints"))}).drop("constraints", "covered")


def prefixes(nodes: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The nodes that each cutoff (session_id, cutoff) sees: those up to it. Rows grow with the square of a session's length."""
    return nodes.join(cutoffs, "session_id").where("step_id <= cutoff")


def strict_prefixes(nodes: DataFrame, decisions: DataFrame) -> DataFrame:
    """The nodes before each decision (session_id, decision_id, decision_ordinal, decision_step), itself excluded."""
    seen = F.when(F.col("ordinal").isNotNull() & F.col("decision_ordinal").isNotNull(), F.col("ordinal") < F.col("decision_ordinal")).otherwise(F.col("step_id") < F.col("decision_step"))
    return nodes.join(decisions, "session_id").where(seen)
