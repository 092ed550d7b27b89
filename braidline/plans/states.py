"""Queries of decision state and liveness, over stories in which every second session still waits for its last result."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidline.operators import compiler, liveness, state
from braidline.plans.registry import Registry
from braidline.plans.stories import STORY, exchanges
from braidline.scratch import table
from braidline.sources.stories import story_edges, story_nodes

R = Registry()

#: Arguments that tools need, and rules with the tools that trigger them.
SCHEMAS = (("purchase", ("id", "amount")), ("view", ("id",)))
RULES = ((("purchase",), ("payments",)), (("transfer",), ("transfers",)))


def _id(kind: str, key: str, value: str, sources: str) -> str:
    return f"concat('atom_', substr(sha256(concat_ws(chr(31), session_id, {kind}, {key}, {value}, array_to_string({sources}, ','))), 1, 24))"


def _atom(source: str, kind: str, key: str, value: str, sources: str, hard: str, status: str = "'current'", tool: str = "tool_name", slot: str = "CAST(NULL AS VARCHAR)", where: str = "true") -> str:
    return f"SELECT session_id, {_id(kind, key, value, sources)} AS atom_id, {kind} AS atom_type, {key} AS key, {tool} AS tool_name, {slot} AS slot, {value} AS value, {status} AS status, {hard} AS hard, step_id, side_effect, {sources} AS sources FROM {source} WHERE {where}"


_ONE, _BOTH = "[node_id]", "CASE WHEN result IS NULL THEN [node_id] ELSE [node_id, result] END"
_NONE = "CAST(NULL AS VARCHAR)"
_ATOMS = {
    "operation": _atom("ops", "CASE WHEN result IS NULL THEN 'pending_operation' ELSE 'completed_operation' END", "concat('operation:', operation)", "state", _BOTH, "result IS NULL OR bad OR side_effect"),
    "unknown": _atom("ops", "'unknown_slot'", "concat('slot:', tool_name, ':amount')", "'required'", _ONE, "true", slot="'amount'", where="tool_name = 'purchase'"),
    "confirmation": _atom("ops", "'confirmation_requirement'", "concat('confirmation:operation:', operation)", "'unconfirmed'", _ONE, "true", where="side_effect AND result IS NULL"),
    "fact": _atom("ops", "CASE WHEN bad THEN 'conflicting_fact' ELSE 'known_fact' END", "concat('result:', operation)", "rc", _BOTH, "bad OR side_effect", where="result IS NOT NULL"),
    "delta": _atom("ops", "'state_delta'", "concat('delta:', result)", "concat('pending->', state)", _BOTH, "false", where="result IS NOT NULL"),
    "receipt": _atom("ops", "'side_effect_receipt'", "concat('receipt:', operation)", "rc", _BOTH, "true", where="result IS NOT NULL AND side_effect AND NOT bad"),
    "slots": _atom("giv", "CASE WHEN step_id < latest THEN 'superseded_fact' ELSE 'slot_value' END", "concat('slot:', tool_name, ':', slot)", "given", _ONE, "false", status="CASE WHEN step_id < latest THEN 'superseded' ELSE 'current' END", slot="slot"),
}
_LATEST = "(SELECT session_id, max_by(node_id, step_id) AS node_id, max_by(content, step_id) AS content, max(step_id) AS step_id, false AS side_effect FROM vn WHERE node_type = '{0}' GROUP BY session_id)"
#: vn, ve: what is visible; ops: calls with their results; atm: atoms; ae: state edges.
STATE = f"""{STORY},
vn AS (SELECT *, node_type = 'error' OR coalesce(semantic_outcome IN ('negative', 'policy_denied', 'test_failed'), false) AS negative FROM (SELECT *, max(step_id) OVER (PARTITION BY session_id) AS last FROM sn) WHERE NOT (session_id % 2 = 0 AND step_id = last AND node_type IN ('observation', 'error'))),
ve AS (SELECT e.* FROM se e SEMI JOIN vn a ON a.session_id = e.session_id AND a.node_id = e.source SEMI JOIN vn b ON b.session_id = e.session_id AND b.node_id = e.target),
ops AS (SELECT n.session_id, n.node_id, n.step_id, n.tool_name, n.operation_key AS operation, n.side_effect, n.note, r.node_id AS result, coalesce(r.negative, false) AS bad, r.content AS rc, CASE WHEN r.node_id IS NULL THEN 'pending' WHEN r.negative THEN 'failed' ELSE 'completed' END AS state FROM vn n LEFT JOIN vn r ON r.session_id = n.session_id AND r.step_id = n.step_id AND r.node_type IN ('observation', 'error') WHERE n.node_type = 'tool_call'),
giv AS (SELECT *, max(step_id) OVER (PARTITION BY session_id, tool_name, slot) AS latest FROM (SELECT session_id, node_id, step_id, tool_name, side_effect, 'id' AS slot, operation AS given FROM ops UNION ALL SELECT session_id, node_id, step_id, tool_name, side_effect, 'note', CAST(note AS VARCHAR) FROM ops)),
{", ".join(f"at_{name} AS ({sql})" for name, sql in _ATOMS.items())},
atm AS ({_atom(_LATEST.format('goal'), "'active_goal'", "'active_goal'", "content", _ONE, "true", tool=_NONE)} UNION ALL {_atom(_LATEST.format('subgoal'), "'open_subgoal'", "'open_subgoal'", "content", _ONE, "true", tool=_NONE)}
  UNION ALL {_atom("vn", "'global_policy_rule'", "concat('policy:', substr(sha256(content), 1, 24))", "content", _ONE, "true", tool=_NONE, where="node_type = 'constraint'")} {" ".join(f"UNION ALL SELECT * FROM at_{name}" for name in _ATOMS)}),
oc AS (SELECT session_id, atom_id AS op, sources[1] AS call FROM at_operation),
lk AS ({" UNION ALL ".join(f"SELECT a.session_id, a.atom_id AS source, oc.op AS target, {kind} AS edge_type FROM at_{name} a JOIN oc ON oc.session_id = a.session_id AND oc.call = a.sources[1]" for name, kind in (("unknown", "'required_for'"), ("confirmation", "'required_for'"), ("fact", "CASE WHEN a.atom_type = 'conflicting_fact' THEN 'blocks' ELSE 'supports' END"), ("delta", "'resolves'"), ("receipt", "'satisfies'"), ("slots", "'fills'")))}
  UNION ALL SELECT n.session_id, n.atom_id, o.atom_id, 'supersedes' FROM at_slots n JOIN at_slots o ON o.session_id = n.session_id AND o.key = n.key AND o.status = 'superseded' WHERE n.status <> 'superseded'),
ev_at AS (SELECT session_id, atom_id, unnest(sources) AS event FROM atm),
tr AS (SELECT e.session_id, a.atom_id AS source, b.atom_id AS target, CASE e.edge_type WHEN 'resolved_by' THEN 'resolves' WHEN 'superseded_by' THEN 'supersedes' ELSE e.edge_type END AS edge_type, max(e.confidence) AS confidence FROM ve e JOIN ev_at a ON a.session_id = e.session_id AND a.event = e.source JOIN ev_at b ON b.session_id = e.session_id AND b.event = e.target WHERE e.edge_type IN ('resolved_by', 'superseded_by', 'blocks', 'supports') AND a.atom_id <> b.atom_id GROUP BY ALL),
ae AS (SELECT DISTINCT session_id, source, target, edge_type, 1.0::DOUBLE AS confidence FROM lk UNION ALL SELECT tr.* FROM tr ANTI JOIN lk ON lk.session_id = tr.session_id AND lk.source = tr.source AND lk.target = tr.target AND lk.edge_type = tr.edge_type)"""


def waiting(t):
    """The visible part of stories: even sessions lack their last result. Nodes are a table, as edges and more are looked up in them."""
    ex = exchanges(t)
    last = ex.where("ordinal = last").select("session_id", "last")  # a step is its exchange's ordinal
    gone = (F.col("session_id") % 2 == 0) & (F.col("step_id") == F.col("last")) & F.col("node_type").isin("observation", "error")
    return state.visible(table(story_nodes(ex).join(last, "session_id").where(~gone).drop("last"), "visible-nodes"), story_edges(ex))


def _schemas(t):
    return t("events").sparkSession.createDataFrame([(a, list(b)) for a, b in SCHEMAS], "tool_name string, required array<string>")


def reduced(t):
    n, e = waiting(t)
    e = table(e, "visible-edges")
    return n, e, *state.reduce_state(n, e, _schemas(t))


def _queries(t, n, atoms):
    rules = n.sparkSession.createDataFrame([(list(a), list(b)) for a, b in RULES], "trigger_tools array<string>, scope array<string>")
    return state.decision_query(n.select("session_id"), atoms, _schemas(t), rules)


@R.add("reduced_atoms", f"WITH {STATE} SELECT session_id, atom_id, atom_type, key, tool_name, slot, value, status, hard, step_id, array_to_string(sources, ',') AS sources FROM atm")
def reduced_atoms(t):
    return reduced(t)[2].select("session_id", "atom_id", "atom_type", "key", "tool_name", "slot", "value", "status", "hard", "step_id", F.array_join("sources", ",").alias("sources"))


@R.add("reduced_edges", f"WITH {STATE} SELECT session_id, source, target, edge_type, confidence FROM ae")
def reduced_edges(t):
    return reduced(t)[3]


_SET = "array_to_string(list_sort(list(DISTINCT {0}) FILTER ({1})), ',')"
QUERY = f"""{STATE},
dq AS (SELECT session_id, max(CASE WHEN atom_type = 'active_goal' THEN atom_id END) AS goal_id, max(CASE WHEN atom_type = 'open_subgoal' THEN atom_id END) AS subgoal_id, list_sort(list_distinct(list_concat(['purchase', 'view'], coalesce(list(tool_name) FILTER (atom_type = 'pending_operation'), []::VARCHAR[])))) AS candidate_tools,
  coalesce(list(atom_id) FILTER (atom_type = 'slot_value'), []::VARCHAR[]) AS known, coalesce(list(atom_id) FILTER (atom_type = 'confirmation_requirement'), []::VARCHAR[]) AS confirm, bool_or(atom_type = 'pending_operation' AND side_effect) AS acts, count(*) FILTER (atom_type = 'pending_operation') AS pend, list(tool_name) FILTER (atom_type = 'pending_operation') AS ptools FROM atm GROUP BY session_id)"""


@R.add(
    "decision_queries",
    f"""WITH {QUERY} SELECT session_id, goal_id, subgoal_id, array_to_string(candidate_tools, ',') AS candidate_tools, 'amount,id' AS required_slots, array_to_string(list_sort(known), ',') AS known_entities, array_to_string(list_sort(confirm), ',') AS pending_confirmation, CASE WHEN acts THEN 'irreversible' ELSE 'none' END AS side_effect_level, 'global,payments' AS applicable_policy_scope, coalesce(array_to_string(list_transform(list_sort(ptools), lambda x: concat('complete:', x)), ','), '') AS expected_environment_transition, CASE WHEN pend = 0 THEN 'no_pending_operation' ELSE '' END AS uncertainty_reasons FROM dq""",
)
def decision_queries(t):
    n, _, atoms, _ = reduced(t)
    q = _queries(t, n, atoms)
    lists = ("candidate_tools", "required_slots", "known_entities", "pending_confirmation", "applicable_policy_scope", "expected_environment_transition", "uncertainty_reasons")
    return q.select("session_id", "goal_id", "subgoal_id", "side_effect_level", *[F.array_join(c, ",").alias(c) for c in lists])


#: rc0, rec: the records of events; ro: roots; lv: live atoms; sp: spans judged.
RECORDS = f"""{QUERY},
en AS (SELECT session_id, source AS node_id, bool_or(edge_type = 'superseded_by') AS sup, bool_or(edge_type = 'resolved_by') AS res, bool_or(edge_type = 'provides_input') AS used FROM ve WHERE confidence = 1.0 GROUP BY session_id, source),
ol AS (SELECT session_id, unnest(sources) AS node_id, bool_or(status = 'superseded') AS old FROM atm GROUP BY 1, 2),
bd AS (SELECT session_id, node_id, bad, result FROM ops),
rc0 AS (SELECT n.*, CASE WHEN side_effect THEN 'audit_required' WHEN coalesce(sup, false) OR coalesce(old, false) THEN 'superseded' WHEN coalesce(res, false) THEN 'resolved' WHEN coalesce(used, false) THEN 'consumed' WHEN node_type = 'tool_call' THEN CASE WHEN bd.result IS NULL THEN 'pending' WHEN bd.bad THEN 'unresolved_failure' ELSE 'completed_uncertain' END WHEN node_type IN ('observation', 'error') THEN CASE WHEN negative THEN 'unresolved_failure' ELSE 'current_evidence' END ELSE 'active' END AS s0
  FROM vn n LEFT JOIN en USING (session_id, node_id) LEFT JOIN ol USING (session_id, node_id) LEFT JOIN bd USING (session_id, node_id)),
rec AS (SELECT a.session_id, a.node_id, a.node_type, a.ordinal, a.raw_ref, a.step_id, a.token_count, a.node_type = 'tool_call' AND NOT a.side_effect AND coalesce(b.s0 IN ('superseded', 'resolved', 'consumed'), false) AS inherits, CASE WHEN a.node_type = 'tool_call' AND NOT a.side_effect AND b.s0 IN ('superseded', 'resolved', 'consumed') THEN b.s0 ELSE a.s0 END AS status FROM rc0 a LEFT JOIN rc0 b ON b.session_id = a.session_id AND b.step_id = a.step_id AND b.node_type IN ('observation', 'error')),
rect AS (SELECT *, status IN ('superseded', 'resolved', 'consumed') AS terminal FROM rec),
et AS (SELECT a.session_id, a.atom_id, bool_and(r.terminal) AS ended FROM ev_at a JOIN rect r ON r.session_id = a.session_id AND r.node_id = a.event GROUP BY ALL),
ra AS (SELECT atm.*, NOT coalesce(ended, false) AS open, dq.* EXCLUDE (session_id) FROM atm LEFT JOIN et USING (session_id, atom_id) LEFT JOIN dq USING (session_id)),
ro AS (SELECT session_id, atom_id, 'explicit_decision_query_reference' AS reason, true AS hard, sources FROM ra WHERE atom_id = goal_id OR atom_id = subgoal_id OR list_contains(confirm, atom_id)
  UNION ALL SELECT session_id, atom_id, 'state_hard_obligation', true, sources FROM ra WHERE hard AND open
  UNION ALL SELECT session_id, atom_id, concat('root_type:', atom_type), hard, sources FROM ra WHERE open AND atom_type IN ({", ".join(repr(x) for x in liveness.ROOT_TYPES)})
  UNION ALL SELECT session_id, atom_id, concat('nonterminal_status:', status), hard, sources FROM ra WHERE open AND status IN ('pending', 'failed', 'conflicting')
  UNION ALL SELECT session_id, atom_id, 'current_candidate_tool_slot', hard, sources FROM ra WHERE open AND atom_type = 'slot_value' AND (slot IN ('amount', 'id') OR list_contains(candidate_tools, tool_name))
  UNION ALL SELECT session_id, atom_id, 'current_known_entity', hard, sources FROM ra WHERE open AND list_contains(known, atom_id))"""


def analysed(t):
    n, e, atoms, links = reduced(t)
    links = table(links, "state-edges", lies=True)
    records = table(liveness.event_records(n, e, atoms), "event-records")
    return n, e, atoms, links, records, table(liveness.derive_roots(atoms, records, _queries(t, n, atoms)), "roots")


@R.add("lifecycle_records", f"WITH {RECORDS} SELECT session_id, node_id, status, terminal, inherits AS inherited FROM rect")
def lifecycle_records(t):
    n, e, atoms, _ = reduced(t)
    return liveness.event_records(n, e, atoms).select("session_id", "node_id", "status", "terminal", (F.col("reason") == "producer_inherits_explicit_terminal_result").alias("inherited"))


@R.add("liveness_roots", f"WITH {RECORDS} SELECT session_id, atom_id, reason, hard FROM ro")
def liveness_roots(t):
    return analysed(t)[5].select("session_id", "atom_id", "reason", "hard")


LIVE = f"""{RECORDS},
li AS (SELECT session_id, target AS a, source AS b FROM ae UNION SELECT session_id, source, target FROM ae WHERE edge_type = 'conflicts_with'),
lv AS (SELECT DISTINCT session_id, atom_id FROM ro UNION SELECT lv.session_id, li.b FROM lv JOIN li ON li.session_id = lv.session_id AND li.a = lv.atom_id),
le AS (SELECT DISTINCT e.session_id, e.event AS node_id FROM ev_at e SEMI JOIN lv ON lv.session_id = e.session_id AND lv.atom_id = e.atom_id UNION SELECT DISTINCT session_id, unnest(sources) FROM ro),
me AS (SELECT session_id, step_id AS pos, node_id FROM rect WHERE node_type IN ('decision', 'tool_call', 'observation', 'error')),
sp AS (SELECT session_id, pos, concat('span_', substr(sha256(concat_ws(chr(31), 'tool_exchange', session_id, 3 * pos - 1)), 1, 24)) AS span_id, count(*) AS members, CASE WHEN bool_or(le.node_id IS NOT NULL) THEN 'span_contains_live_event' WHEN NOT bool_and(terminal) THEN 'span_has_nonterminal_or_uncertain_event'
  WHEN bool_or(node_type IN ('tool_call', 'observation', 'error') AND raw_ref IS NULL) THEN 'tool_span_missing_archive_reference' WHEN bool_or(node_type IN ('tool_call', 'observation', 'error') AND step_id % 7 = 0) THEN 'archive_round_trip_failed' ELSE 'outside_live_closure_with_explicit_terminal_lifecycle' END AS reason FROM me JOIN rect USING (session_id, node_id) LEFT JOIN le USING (session_id, node_id) GROUP BY session_id, pos)"""


@R.add("live_state", f"WITH RECURSIVE {LIVE} SELECT session_id, atom_id FROM lv")
def live_state(t):
    _, _, _, links, _, roots = analysed(t)
    return liveness.live_atoms(links, roots)


@R.add("span_groups", f"WITH {STATE}, g AS (SELECT session_id, CASE WHEN node_type IN ('decision', 'tool_call', 'observation', 'error') THEN 'tool_exchange' ELSE 'message' END AS span_type, step_id, ordinal, node_type FROM vn), s AS (SELECT session_id, span_type, CASE WHEN span_type = 'message' THEN ordinal ELSE step_id END AS pos, count(*) AS members FROM g GROUP BY ALL) SELECT session_id, span_type, count(*) AS spans, max(members) AS largest, min(members) AS smallest, CAST(sum(members) AS BIGINT) AS nodes FROM s GROUP BY session_id, span_type")
def span_groups(t):
    """Exchanges, of which the last may still wait for its result, and the messages between them."""
    n, e = waiting(t)
    per = liveness.spans(n, e).groupBy("session_id", "span_type", "span_id").agg(F.count("*").alias("members"))
    return per.groupBy("session_id", "span_type").agg(F.count("*").alias("spans"), F.max("members").alias("largest"), F.min("members").alias("smallest"), F.sum("members").alias("nodes"))


def _archive(n):
    """All but the records of every seventh step can be read back."""
    return n.where((F.col("step_id") % 7 != 0) & F.col("raw_ref").isNotNull()).select(F.col("raw_ref").alias("digest")).distinct()


def _judged(t):
    """(nodes, atoms, roots, span members, spans judged). Decisions never end, so an exchange that may leave is its call and result: spans are those of tool nodes alone."""
    n, e, atoms, links, records, roots = analysed(t)
    tools = table(n.withColumn("ordinal", F.when(F.col("node_type") != "decision", F.col("ordinal"))), "tool-messages")
    held = liveness.span_members(tools, e, atoms, links, records, roots)
    return n, atoms, roots, held, table(liveness.judge(held, _archive(tools)), "judged")


@R.add("liveness_analysis", f"WITH RECURSIVE {LIVE.replace(chr(39) + 'decision' + chr(39) + ', ' + chr(39) + 'tool_call', chr(39) + 'tool_call')} SELECT session_id, span_id, members, reason, reason <> 'outside_live_closure_with_explicit_terminal_lifecycle' AS live FROM sp")
def liveness_analysis(t):
    return _judged(t)[4].where("span_type = 'tool_exchange'").select("session_id", "span_id", "members", "reason", "live")


_GONE = LIVE.replace("'decision', 'tool_call'", "'tool_call'") + """, go AS (SELECT session_id, node_id FROM me JOIN sp USING (session_id, pos) WHERE reason = 'outside_live_closure_with_explicit_terminal_lifecycle')"""


@R.add("reactivation_audit", f"WITH RECURSIVE {_GONE} SELECT session_id, count(DISTINCT pos) AS evicted, count(DISTINCT pos) AS reactivated FROM go JOIN me USING (session_id, node_id) GROUP BY session_id")
def reactivation_audit(t):
    n, _, _, held, judged = _judged(t)
    back = liveness.reactivation(held, judged, _archive(n))
    return back.groupBy("session_id").agg(F.count("*").alias("evicted"), F.sum(F.col("reactivated").cast("bigint")).alias("reactivated"))


def _recall(name: str, source: str) -> str:
    return f"(SELECT session_id, count(*) AS {name}_events, count(go.node_id) AS {name}_lost FROM (SELECT DISTINCT session_id, unnest(sources) AS node_id FROM {source}) LEFT JOIN go USING (session_id, node_id) GROUP BY session_id)"


_KINDS = {"root": "ro", "policy": "(SELECT * FROM atm WHERE atom_type = 'global_policy_rule')", "confirmation": "(SELECT * FROM atm WHERE atom_type = 'confirmation_requirement')", "receipt": "(SELECT * FROM atm WHERE atom_type = 'side_effect_receipt')"}


@R.add(
    "liveness_recall",
    f"""WITH RECURSIVE {_GONE}, tk AS (SELECT session_id, sum(CASE WHEN go.node_id IS NULL THEN token_count ELSE 0 END) AS l, sum(CASE WHEN go.node_id IS NOT NULL THEN token_count ELSE 0 END) AS g FROM vn LEFT JOIN go USING (session_id, node_id) GROUP BY session_id)
SELECT session_id, CAST(l AS BIGINT) AS live_tokens, CAST(g AS BIGINT) AS evicted_tokens, {", ".join(f"coalesce({k}_events, 0) AS {k}_events, coalesce({k}_lost, 0) AS {k}_lost" for k in _KINDS)} FROM tk {" ".join(f"LEFT JOIN {_recall(k, s)} USING (session_id)" for k, s in _KINDS.items())}""",
)
def liveness_recall(t):
    n, atoms, roots, held, judged = _judged(t)
    return liveness.safety_recall(n, atoms, roots, held, judged)


def _masked(t):
    from braidline.operators import checks

    n, _, atoms, _ = reduced(t)
    awaited = _queries(t, n, atoms).select("session_id", F.explode("pending_confirmation").alias("atom_id"))
    rows = atoms.withColumns({"blocking": F.col("atom_type") == "conflicting_fact", "archived": F.col("step_id") % 3 == 0})
    return n, checks.risk_mask(rows, F.lit("omit"), awaited)


_TEXT = "concat_ws(' ', key, value)"
_COSTS = "CAST((strlen({0}) + 3) // 4 AS BIGINT)"


def _cut(most: int) -> str:
    return f"CASE WHEN length({_TEXT}) > {most} THEN concat(substr({_TEXT}, 1, {most - 1}), '…') ELSE {_TEXT} END"


_OPTIONS = (
    ("'raw_message'", f"{_COSTS.format(_TEXT)} + 8", "0.0", "true"),
    ("'structured_state_delta'", _COSTS.format(_TEXT), "0.0", "atom_type IN ('slot_value', 'superseded_fact', 'state_delta', 'known_fact', 'completed_operation')"),
    ("'verified_summary'", _COSTS.format(_cut(32)), "CASE WHEN hard THEN 0.02 ELSE 0.01 END", "true"),
    ("'negative_guard'", _COSTS.format(_cut(24)), "0.015", "atom_type = 'conflicting_fact'"),
    ("'archive_handle'", "18", "CASE WHEN hard THEN 0.2 ELSE 0.03 END", "step_id % 3 = 0"),
    ("'omit'", "0", "CASE WHEN status = 'superseded' THEN 0.01 WHEN step_id % 3 <> 0 THEN 0.1 ELSE 0.05 END", "free"),
)
_NEVER = "('active_goal', 'open_subgoal', 'unknown_slot', 'confirmation_requirement', 'global_policy_rule', 'applicable_policy_rule', 'critical_evidence', 'side_effect_receipt', 'pending_operation')"


#: Beam search said again: prefixes of choices for each place, the 16 best kept, ties by what was chosen before.
def beam_sql(options: str = "op") -> str:
    return f"""bm AS (SELECT DISTINCT session_id, 0::BIGINT AS place, 1::BIGINT AS turn, 0::BIGINT AS back, '' AS name, 0::BIGINT AS cost, 0::DOUBLE AS risk FROM {options}
UNION ALL SELECT session_id, place, row_number() OVER (PARTITION BY session_id ORDER BY back, name) AS turn, back, name, cost, risk FROM
(SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY cost + 512::DOUBLE * risk, cost, risk, back, name) AS best FROM
(SELECT b.session_id, b.place + 1 AS place, b.turn AS back, o.name, b.cost + o.cost AS cost, b.risk + o.risk AS risk FROM bm b JOIN {options} o ON o.session_id = b.session_id AND o.place = b.place + 1)) WHERE best <= 16)"""


def chosen_sql(budgets: tuple[int, ...]) -> str:
    """ch: the end that wins under each budget; of those that fit the best, else the one of least risk."""
    return f"""en AS (SELECT bm.*, budget, cost <= budget AS fits FROM bm SEMI JOIN (SELECT session_id, max(place) AS place FROM bm GROUP BY session_id) l ON l.session_id = bm.session_id AND l.place = bm.place, (SELECT unnest({list(budgets)})::BIGINT AS budget)),
ch AS (SELECT * FROM en QUALIFY row_number() OVER (PARTITION BY session_id, budget ORDER BY fits DESC, CASE WHEN fits THEN cost + 512::DOUBLE * risk ELSE risk END, cost, risk, turn) = 1)"""


#: The way back from the ends that won.
BACK = """bk AS (SELECT session_id, budget, fits, place, turn FROM ch UNION ALL SELECT b.session_id, b.budget, b.fits, b.place - 1, m.back FROM bk b JOIN bm m ON m.session_id = b.session_id AND m.place = b.place AND m.turn = b.turn WHERE b.place > 1),
pk AS (SELECT b.session_id, b.budget, b.fits, b.place, m.name FROM bk b JOIN bm m ON m.session_id = b.session_id AND m.place = b.place AND m.turn = b.turn WHERE b.place > 0)"""

#: About half of the states of stories fit into it.
TIGHT = 2600


def _options(where: str = "true") -> str:
    return f"""fr AS (SELECT *, NOT hard AND atom_type NOT IN {_NEVER} AND atom_type <> 'conflicting_fact' AS free, row_number() OVER (PARTITION BY session_id ORDER BY step_id, atom_id) AS place FROM atm),
op AS ({" UNION ALL ".join(f"SELECT session_id, place, {n} AS name, CAST({c} AS BIGINT) AS cost, ({r})::DOUBLE AS risk, hard FROM fr WHERE {w} AND ({where.format(name=n)})" for n, c, r, w in _OPTIONS)})"""


@R.add(
    "compiled_states",
    f"WITH RECURSIVE {STATE}, {_options()}, {beam_sql()}, {chosen_sql((TIGHT,))}, {BACK} SELECT session_id, place, name AS choice, o.cost, o.risk, fits AS feasible FROM pk JOIN op o USING (session_id, place, name)",
)
def compiled_states(t):
    """Beam search over the state of each story in a budget that binds: some fit, of some another end than the best fits, others fall back to the least risk."""
    return compiler.compile_beam(compiler.candidates_of(_masked(t)[1]), TIGHT)


_SWEPT = (2300, 2600, 3200, 4000)


@R.add(
    "compiled_sweep",
    f"""WITH RECURSIVE {STATE}, {_options()}, {beam_sql()}, {chosen_sql(_SWEPT)}, {BACK},
pr AS (SELECT session_id, budget, any_value(fits) AS feasible, sum(o.cost) AS cost, bool_and(NOT o.hard OR name <> 'omit') AS covered FROM pk JOIN op o USING (session_id, place, name) GROUP BY session_id, budget),
rw AS (SELECT session_id, sum(token_count) AS raw FROM vn GROUP BY session_id),
rt AS (SELECT budget, count(*) AS points, avg(covered::INT) AS hard_coverage_rate, avg((NOT feasible)::INT) AS fallback_rate, median(cost)::DOUBLE AS median_cost, median((raw - cost)::DOUBLE / raw) AS median_reduction FROM pr JOIN rw USING (session_id) GROUP BY budget)
SELECT * REPLACE (round(hard_coverage_rate, 9) AS hard_coverage_rate, round(fallback_rate, 9) AS fallback_rate, round(median_reduction, 9) AS median_reduction), coalesce(budget = min(CASE WHEN hard_coverage_rate = 1 AND fallback_rate <= 0.05 THEN budget END) OVER (), false) AS "primary" FROM rt""",
)
def compiled_sweep(t):
    """Four budgets, of which each state is compiled under in one search; the least that covers all and hardly ever falls back is the primary one."""
    n, masked = _masked(t)
    atoms = table(compiler.candidates_of(masked).join(masked.select("session_id", "atom_id", "hard"), ["session_id", "atom_id"]), "candidates")
    swept = compiler.sweep(atoms, _SWEPT, n.groupBy("session_id").agg(F.sum("token_count").alias("raw_tokens")))
    return swept.withColumns({c: F.round(c, 9) for c in ("hard_coverage_rate", "fallback_rate", "median_reduction")})


#: Handles of atoms whose content the archive has lost do not pass, nor claims of what no event shows.
_LOST = "{name} <> 'archive_handle' OR step_id % 2 = 0"


@R.add(
    "compiled_verified",
    f"""WITH RECURSIVE {STATE}, {_options(_LOST)}, {beam_sql()}, {chosen_sql((TIGHT,))}, {BACK},
dr AS (SELECT session_id, count(*) AS rejected FROM fr WHERE step_id % 3 = 0 AND step_id % 2 <> 0 GROUP BY session_id),
pr AS (SELECT session_id, any_value(fits) AS feasible, sum(o.cost) AS cost, sum(CASE WHEN name = 'omit' THEN 1 ELSE 0 END) AS omitted, sum(CASE WHEN name = 'archive_handle' THEN 1 ELSE 0 END) AS handles, sum(CASE WHEN o.hard AND name = 'omit' THEN 1 ELSE 0 END) AS uncovered, round(sum(o.risk), 6) AS risk FROM pk JOIN op o USING (session_id, place, name) GROUP BY session_id)
SELECT session_id, CAST(cost AS BIGINT) AS cost, risk, feasible, NOT feasible AS fallback, cost > {TIGHT + 150} AS hard_exceeded, coalesce(rejected, 0) AS rejected, CAST(omitted AS BIGINT) AS omitted, CAST(handles AS BIGINT) AS handles, CAST(uncovered AS BIGINT) AS hard_coverage_errors, 0::BIGINT AS provenance_errors, CASE WHEN cost > {TIGHT + 150} THEN 1 ELSE 0 END::BIGINT AS budget_errors FROM pr LEFT JOIN dr USING (session_id)""",
)
def compiled_verified(t):
    """Candidates verified against events and an archive that has lost odd steps; the compilation checked as a whole."""
    n, masked = _masked(t)
    masked = masked.withColumn("raw_ref", F.when(F.col("archived"), F.sha2(F.col("atom_id"), 256)))
    archive = masked.where("archived and step_id % 2 = 0").select(F.col("raw_ref").alias("digest"))
    return compiler.compile_state(masked, n.select("session_id", "node_id"), archive, TIGHT, TIGHT + 150)
