"""Decision state: what a prefix of a trace says, as atoms and edges between them, and the query that the next decision asks.

Everything follows from the nodes and edges that a cutoff sees, never from a stored profile, so that later rows change nothing.
Sources are node ids. An atom's id hashes its type, key, value and sources.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidline.functions.identity import stable_id
from braidline.operators.lifecycle import negative
from braidline.schema import CALLS
from braidline.scratch import table

#: Edges of traces and the edges of states that they become.
RELATIONS = {"resolved_by": "resolves", "superseded_by": "supersedes", "blocks": "blocks", "supports": "supports"}
COLUMNS = ("session_id", "atom_id", "atom_type", "key", "tool_name", "slot", "value", "status", "hard", "verified", "confidence", "step_id", "side_effect", "sources")


def visible(nodes: DataFrame, edges: DataFrame, cutoffs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes up to each session's cutoff (session_id, cutoff) and the edges between them."""
    if cutoffs is not None:
        nodes = nodes.join(cutoffs, "session_id").where("step_id <= cutoff").drop("cutoff")
    ids = nodes.select("session_id", "node_id")
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("node_id", end), ["session_id", end], "left_semi")
    return nodes, edges


def _atoms(rows: DataFrame, kind: Column | str, key: Column, value: Column, sources: Column, hard: Column | bool, *, status: Column | str = "current", tool: Column | None = None, slot: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    made = rows.select("session_id", lit(kind).alias("atom_type"), key.alias("key"), (none if tool is None else tool).alias("tool_name"), (none if slot is None else slot).alias("slot"), value.alias("value"), lit(status).alias("status"), lit(hard).alias("hard"), F.lit(True).alias("verified"), F.lit(1.0).alias("confidence"), "step_id", "side_effect", F.sort_array(F.array_distinct(sources)).alias("sources"))
    return made.select(*[stable_id("atom", F.col("session_id"), F.col("atom_type"), F.col("key"), F.coalesce("value", F.lit("")), F.array_join("sources", ",")).alias(c) if c == "atom_id" else F.col(c) for c in COLUMNS])


def operations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each call with its latest result: what state is reduced from."""
    results = nodes.select("session_id", F.col("node_id").alias("target"), F.struct("step_id", "node_id", "semantic_outcome", "node_type", "content").alias("r"))
    made = edges.where(F.col("edge_type").isin("produces", "failed_with")).join(results, ["session_id", "target"])
    last = made.groupBy("session_id", F.col("source").alias("node_id")).agg(F.max("r").alias("r"))
    calls = nodes.where(F.col("node_type").isin(*CALLS)).join(last, ["session_id", "node_id"], "left")
    bad = F.coalesce(negative(F.col("r.semantic_outcome"), F.col("r.node_type")), F.lit(False))
    state = F.when(F.col("r").isNull(), "pending").when(F.col("bad"), "failed").otherwise("completed")
    return calls.withColumn("bad", bad).withColumns({"state": state, "operation": F.coalesce("operation_key", "node_id"), "result": F.col("r.node_id")})


def reduce_state(nodes: DataFrame, edges: DataFrame, schemas: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(atoms, state edges (session_id, source, target, edge_type, confidence)) of what is visible.

    schemas: (tool_name, required array): arguments that a tool needs; a registry, so it is broadcast.
    """
    ops = table(operations(nodes, edges), "operations")  # most kinds of atoms come from them
    at = lambda *c: F.array(*[F.col(x) for x in c])
    done = ops.where("result is not null")
    parts, links = [], []
    ahead = []  # links of kinds that trace edges become as well
    last = lambda kind: nodes.where(F.col("node_type") == kind).groupBy("session_id").agg(F.max(F.struct("step_id", "node_id", "content")).alias("l")).select("session_id", "l.*", F.lit(False).alias("side_effect"))
    for kind, name in (("goal", "active_goal"), ("subgoal", "open_subgoal")):
        parts.append(_atoms(last(kind), name, F.lit(name), F.col("content"), at("node_id"), True))

    both = F.when(F.col("result").isNull(), at("node_id")).otherwise(at("node_id", "result"))
    known = {"tool": F.col("tool_name")}
    operation = _atoms(ops, F.when(F.col("result").isNull(), "pending_operation").otherwise("completed_operation"), F.concat(F.lit("operation:"), F.col("operation")), F.col("state"), both, F.col("result").isNull() | F.col("bad") | F.col("side_effect"), **known)
    parts.append(operation)
    of_call = operation.select("session_id", F.explode("sources").alias("call"), F.col("atom_id").alias("op")).join(ops.select("session_id", F.col("node_id").alias("call")), ["session_id", "call"], "left_semi")

    def linked(atoms: DataFrame, kind: Column | str) -> DataFrame:
        """Atoms whose sources hold one call, with an edge to its operation."""
        mine = atoms.select("session_id", "atom_id", "atom_type", F.explode("sources").alias("call")).join(of_call, ["session_id", "call"])
        return mine.select("session_id", F.col("atom_id").alias("source"), F.col("op").alias("target"), (F.lit(kind) if isinstance(kind, str) else kind).alias("edge_type"), F.lit(1.0).alias("confidence"))

    if schemas is not None:
        asked = ops.join(F.broadcast(schemas), "tool_name").withColumn("slot", F.explode("required"))
        asked = asked.where(F.coalesce(F.element_at("arguments", F.col("slot")), F.lit("")) == "")
        unknown = _atoms(asked, "unknown_slot", F.concat_ws(":", F.lit("slot"), "tool_name", "slot"), F.lit("required"), at("node_id"), True, slot=F.col("slot"), **known)
        parts.append(unknown)
        links.append(linked(unknown, "required_for"))
    waiting = ops.where("side_effect and result is null")
    confirmation = _atoms(waiting, "confirmation_requirement", F.concat(F.lit("confirmation:operation:"), F.col("operation")), F.lit("unconfirmed"), at("node_id"), True, **known)
    fact = _atoms(done, F.when(F.col("bad"), "conflicting_fact").otherwise("known_fact"), F.concat(F.lit("result:"), F.col("operation")), F.col("r.content"), both, F.col("bad") | F.col("side_effect"), **known)
    delta = _atoms(done, "state_delta", F.concat(F.lit("delta:"), F.col("result")), F.concat(F.lit("pending->"), F.col("state")), both, False, **known)
    receipt = _atoms(done.where("side_effect and not bad"), "side_effect_receipt", F.concat(F.lit("receipt:"), F.col("operation")), F.col("r.content"), both, True, **known)
    parts += [confirmation, fact, delta, receipt]
    ahead += [linked(fact, F.when(F.col("atom_type") == "conflicting_fact", "blocks").otherwise("supports")), linked(delta, "resolves")]
    links += [linked(confirmation, "required_for"), linked(receipt, "satisfies")]

    given = ops.where("arguments is not null").select("session_id", "node_id", "step_id", "side_effect", "tool_name", F.explode("arguments").alias("slot", "given"))
    slot = Window.partitionBy("session_id", "tool_name", "slot")
    given = given.withColumn("latest", F.max("step_id").over(slot))
    many = F.size(F.collect_set(F.when(F.col("step_id") == F.col("latest"), F.col("given"))).over(slot)) > 1
    given = given.withColumn("conflict", many).withColumn("slot_status", F.when(F.col("step_id") < F.col("latest"), "superseded").when(F.col("conflict"), "conflicting").otherwise("current"))
    kind = F.when(F.col("slot_status") == "superseded", "superseded_fact").when(F.col("slot_status") == "conflicting", "conflicting_fact").otherwise("slot_value")
    slots = _atoms(given, kind, F.concat_ws(":", F.lit("slot"), "tool_name", "slot"), F.col("given"), at("node_id"), F.col("slot_status") == "conflicting", status=F.col("slot_status"), slot=F.col("slot"), **known)
    parts.append(slots)
    links.append(linked(slots, "fills"))
    new = slots.where("status <> 'superseded'").select("session_id", "key", F.col("atom_id").alias("source"), F.col("status").alias("new_status"))
    old = slots.where("status = 'superseded'").select("session_id", "key", F.col("atom_id").alias("target"))
    ahead.append(new.join(old, ["session_id", "key"]).select("session_id", "source", "target", F.lit("supersedes").alias("edge_type"), F.lit(1.0).alias("confidence")))
    peers = new.where("new_status = 'conflicting'").select("session_id", "key", "source")
    links.append(peers.join(peers.withColumnRenamed("source", "target"), ["session_id", "key"]).where("source < target").select("session_id", "source", "target", F.lit("conflicts_with").alias("edge_type"), F.lit(1.0).alias("confidence")))

    rules = nodes.where("node_type = 'constraint'")
    parts.append(_atoms(rules, "global_policy_rule", F.concat(F.lit("policy:"), F.substring(F.sha2("content", 256), 1, 24)), F.col("content"), at("node_id"), True))
    # Types and keys of one part are never those of another, nor are links, so each is made distinct where it lies.
    atoms = table(reduce(DataFrame.unionByName, [p.dropDuplicates(["session_id", "atom_id"]) for p in parts]), "atoms", lies=True)
    ends = ["session_id", "source", "target", "edge_type"]
    made = [x.dropDuplicates(ends) for x in ahead + links]
    return atoms, reduce(DataFrame.unionByName, made + [translated(edges, atoms, made[: len(ahead)])])


def translated(edges: DataFrame, atoms: DataFrame, existing: list[DataFrame]) -> DataFrame:
    """Trace edges as edges between the atoms of their ends, but those that one of existing has."""
    names = F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])
    of = atoms.select("session_id", "atom_id", F.explode("sources").alias("event"))
    rows = edges.where(F.col("edge_type").isin(*RELATIONS)).select("session_id", F.col("source").alias("from"), F.col("target").alias("to"), names[F.col("edge_type")].alias("edge_type"), "confidence")
    rows = rows.join(of.select("session_id", F.col("event").alias("from"), F.col("atom_id").alias("source")), ["session_id", "from"])
    rows = rows.join(of.select("session_id", F.col("event").alias("to"), F.col("atom_id").alias("target")), ["session_id", "to"]).where("source <> target")
    rows = rows.groupBy("session_id", "source", "target", "edge_type").agg(F.max("confidence").alias("confidence"))
    for there in existing:
        rows = rows.join(there, ["session_id", "source", "target", "edge_type"], "left_anti")
    return rows.select("session_id", "source", "target", "edge_type", "confidence")


def find_atoms(atoms: DataFrame, *types: str, status: str | None = None) -> DataFrame:
    """Atoms of the types, of any if none is named, with a status if one is asked for."""
    rows = atoms.where(F.col("atom_type").isin(*types)) if types else atoms
    return rows if status is None else rows.where(F.col("status") == status)


def decision_query(sessions: DataFrame, atoms: DataFrame, schemas: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """One row for each of sessions (session_id): goal, subgoal, candidate tools, required slots, entities, confirmations, side effect, policy
    scope, transitions and what is uncertain; sets are sorted arrays.

    schemas: (tool_name, required); rules: (trigger_tools, scope). Tools with a schema always stay candidates.
    """
    current = F.col("status") == "current"
    of = lambda *kinds: current & F.col("atom_type").isin(*kinds)
    some = lambda test, c: F.array_sort(F.collect_set(F.when(test, c)))
    pending = of("pending_operation")
    per = atoms.groupBy("session_id").agg(
        F.max(F.when(of("active_goal"), F.col("atom_id"))).alias("goal_id"),
        F.max(F.when(of("open_subgoal"), F.col("atom_id"))).alias("subgoal_id"),
        some(pending, F.col("tool_name")).alias("pending_tools"),
        some(of("unknown_slot"), F.col("slot")).alias("slots"),
        some(of("entity", "slot_value"), F.col("atom_id")).alias("known_entities"),
        some(of("confirmation_requirement"), F.col("atom_id")).alias("pending_confirmation"),
        F.max(F.coalesce(pending & F.col("side_effect"), F.lit(False))).alias("acts"),
        F.array_sort(F.collect_list(F.when(pending & F.col("tool_name").isNotNull(), F.concat(F.lit("complete:"), F.col("tool_name"))))).alias("expected_environment_transition"),
    )
    rows = sessions.select("session_id").distinct().join(per, "session_id", "left")
    none = F.array().cast("array<string>")
    for c in ("pending_tools", "slots", "known_entities", "pending_confirmation", "expected_environment_transition"):
        rows = rows.withColumn(c, F.coalesce(c, none))
    known = schemas.collect() if schemas is not None else []  # a registry of tools
    book = rules.collect() if rules is not None else []  # a rule book
    tools = F.array(*[F.lit(r.tool_name) for r in known]).cast("array<string>")
    rows = rows.withColumn("candidate_tools", F.array_sort(F.array_union("pending_tools", tools)))
    needed = F.array(*[F.lit(s) for r in known for s in r.required]).cast("array<string>")
    scope = F.array(F.lit("global"))
    for r in book:
        applies = F.lit(True) if not r.trigger_tools else F.arrays_overlap("candidate_tools", F.array(*[F.lit(x) for x in r.trigger_tools]))
        scope = F.array_union(scope, F.when(applies, F.array(*[F.lit(x) for x in r.scope]).cast("array<string>")).otherwise(none))
    uncertain = F.array(F.when(F.size("pending_tools") == 0, "no_pending_operation"), F.when(F.size("candidate_tools") == 0, "no_tool_schema"))
    return rows.select(
        "session_id",
        "goal_id",
        "subgoal_id",
        "candidate_tools",
        F.array_sort(F.array_union("slots", needed)).alias("required_slots"),
        "known_entities",
        "pending_confirmation",
        F.when(F.coalesce("acts", F.lit(False)), "irreversible").otherwise("none").alias("side_effect_level"),
        F.array_sort(scope).alias("applicable_policy_scope"),
        "expected_environment_transition",
        F.filter(uncertain, lambda x: x.isNotNull()).alias("uncertainty_reasons"),
    )
