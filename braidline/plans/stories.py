"""Queries over complete traces made of events: profiles, safety, failure cards, policies that read relations, and how they did."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidline.functions.text import CORRECTIONS, MALFORMED_PHRASES, OTHER_CORRECTION, estimate_tokens
from braidline.operators import cards, context, lifecycle
from braidline.plans.exchanges import EX
from braidline.plans.registry import Registry
from braidline.scratch import table, together
from braidline.sources.stories import REASONS, story_edges, story_exchanges, story_nodes

R = Registry()

_TOOL = "tool_name, CAST(k AS VARCHAR) AS operation_key"
_REF = "CASE WHEN o % 5 <> 0 THEN concat('sha256:', sha256(concat(session_id, ':', o, ':{0}'))) END AS raw_ref"


def _node(kind: str, node_type: str, content: str, ordinal: str, where: str = "true", outcome: str = "NULL", acts: str = "false", final: str = "false", active: str = "true") -> str:
    tool = _TOOL if kind in "cr" else "NULL AS tool_name, NULL AS operation_key"
    ref = _REF.format(kind) if kind in "cr" else "NULL AS raw_ref"
    flags = "err AND k % 8 = 7 AS terminal, err AND k % 8 = 5 AS stale" if kind == "r" else "false AS terminal, false AS stale"
    return f"SELECT session_id, concat(session_id, ':', o, ':{kind}') AS node_id, {node_type} AS node_type, {content} AS content, o AS step_id, {ordinal} AS ordinal, {tool}, {outcome} AS semantic_outcome, {acts} AS side_effect, {final} AS final, {active} AS active, {ref}, o % 3 AS note, {flags} FROM sx WHERE {where}"


def _edge(kind: str, source: str, target: str, where: str = "true", confidence: float | str = 1.0) -> str:
    name = lambda x: f"concat(session_id, ':', {x[0]}, ':{x[1]}')"
    return f"SELECT session_id, {name(source.split())} AS source, {name(target.split())} AS target, {kind} AS edge_type, ({confidence})::DOUBLE AS confidence FROM sx WHERE {where}"


_REASON = "CASE k % 4 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REASONS)) + " END"
_RESULT = f"CASE WHEN err THEN concat('error: ', {_REASON}, ' for key ', k) ELSE concat('record ', event_id, ' of key ', k, repeat(' field', CAST(o % 30 AS INTEGER))) END"
_OUTCOME = "CASE WHEN err AND k % 4 = 0 THEN 'policy_denied' WHEN neg THEN 'negative' WHEN pos THEN 'positive' ELSE 'inconclusive' END"
#: Nodes (sn) and edges (se) of stories.
STORY = f"""{EX},
s0 AS (SELECT session_id, ordinal AS o, event_id, tool_name, k, err, side_effect, err OR tool_name = 'view' AND k % 3 = 0 AS neg, max(ordinal) OVER (PARTITION BY session_id) AS last FROM ev),
sx AS (SELECT *, side_effect AND NOT neg AS pos, lag(o) OVER w AS prev, lag(neg) OVER w AS prev_neg, lag(err) OVER w AS prev_err, max(CASE WHEN NOT neg THEN o END) OVER (PARTITION BY session_id, k ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_ok FROM s0 WINDOW w AS (PARTITION BY session_id, k ORDER BY o)),
sn0 AS ({" UNION ALL ".join([
    _node("u", "CASE WHEN o = 1 THEN 'goal' ELSE 'subgoal' END", "concat('task ', o, repeat(' detail', CAST(o % 7 AS INTEGER)))", "3 * o - 2", "o % 10 = 1"),
    _node("d", "'decision'", "concat('decide step ', o)", "3 * o - 1", final="o = last"),
    _node("c", "'tool_call'", """concat('{"arguments":{"id":', k, ',"note":', o % 3, '},"tool_name":"op"}')""", "3 * o - 1", acts="side_effect"),
    _node("r", "CASE WHEN err THEN 'error' ELSE 'observation' END", _RESULT, "3 * o", outcome=_OUTCOME, active="o % 17 <> 0"),
    _node("s", "'constraint'", "'never act twice on one key'", "0", "o = 1"),
])}),
sn AS (SELECT *, CAST((strlen(content) + 3) // 4 AS BIGINT) AS token_count FROM sn0),
se AS ({" UNION ALL ".join([
    _edge("'leads_to'", "o d", "o c"),
    _edge("CASE WHEN err THEN 'failed_with' ELSE 'produces' END", "o c", "o r"),
    _edge("CASE WHEN neg THEN 'blocks' ELSE 'supports' END", "o r", "o+1 d", "o < last", 0.5),
    _edge("'supports'", "o r", "last d", "NOT neg AND o % 9 = 0 AND o + 1 < last", 0.5),
    _edge("'provides_input'", "o r", "o+1 d", "NOT neg AND o % 6 = 0 AND o < last", "CASE WHEN o % 12 = 0 THEN 1.0 ELSE 0.8 END"),
    _edge("'blocks'", "1 s", "o c", "side_effect", 0.5),
    _edge("'retried_by'", "prev c", "o c", "prev_neg", 0.8),
    _edge("'superseded_by'", "prev r", "o r", "prev_neg AND neg"),
    _edge("'resolved_by'", "prev r", "o r", "prev_neg AND NOT neg AND (prev_err OR pos)"),
    _edge("'superseded_by'", "prev_ok r", "o r", "NOT neg AND prev_ok IS NOT NULL"),
])})"""

_EMPTY = "[]::VARCHAR[]"


def _targets(kind: str, extra: str = "") -> str:
    return f"coalesce(list_sort(list(DISTINCT e.target) FILTER (e.edge_type = '{kind}'{extra})), {_EMPTY})"


#: Profiles (pf): obligations are the flags o_*; active2 is what applying them leaves.
PROFILES = f"""{STORY},
fin AS (SELECT session_id, node_id FROM sn WHERE node_type = 'decision' AND final),
rl AS (SELECT e.session_id, e.source AS node_id, bool_or(edge_type IN ('produces', 'failed_with')) AS gave, bool_or(edge_type = 'supports') AS supports, bool_or(edge_type = 'leads_to') AS leads, bool_or(edge_type = 'blocks') AS blocks,
  {_targets('resolved_by')} AS resolved, {_targets('superseded_by')} AS superseded, {_targets('supports', ' AND f.node_id IS NOT NULL')} AS finals FROM se e LEFT JOIN fin f ON f.session_id = e.session_id AND f.node_id = e.target GROUP BY e.session_id, e.source),
p0 AS (SELECT n.*, coalesce(gave, false) AS gave, coalesce(supports, false) AS supports, coalesce(leads, false) AS leads, coalesce(blocks, false) AS blocks, coalesce(resolved, {_EMPTY}) AS resolved, coalesce(superseded, {_EMPTY}) AS superseded, coalesce(finals, {_EMPTY}) AS finals,
  node_type = 'error' OR coalesce(semantic_outcome IN ('negative', 'policy_denied', 'test_failed'), false) AS negative, max(CASE WHEN node_type = 'decision' THEN step_id END) OVER (PARTITION BY n.session_id) > step_id AS later
  FROM sn n LEFT JOIN rl USING (session_id, node_id)),
p1 AS (SELECT *, CASE WHEN node_type = 'tool_call' AND gave THEN 'consumed' WHEN node_type = 'decision' AND NOT final THEN CASE WHEN leads OR later THEN 'consumed' ELSE 'unclassified' END WHEN node_type = 'observation' AND supports THEN 'consumed' WHEN NOT active THEN 'consumed' ELSE 'active' END AS relevance,
  CASE WHEN len(superseded) > 0 THEN 'superseded' WHEN negative THEN CASE WHEN len(resolved) > 0 THEN 'negative_resolved' ELSE 'negative_unresolved' END WHEN semantic_outcome = 'positive' OR node_type = 'observation' THEN 'valid' ELSE 'unknown' END AS validity FROM p0),
p2 AS (SELECT *, side_effect AS o_audit, node_type = 'constraint' AND active AS o_constraint, validity = 'negative_unresolved' AS o_retain, len(finals) > 0 AS o_critical FROM p1),
p3 AS (SELECT *, CASE WHEN o_audit THEN 'audit_required' WHEN node_type = 'error' AND validity = 'negative_unresolved' THEN 'unresolved_failure' WHEN node_type = 'error' AND validity = 'negative_resolved' THEN 'resolved_failure' WHEN o_critical THEN 'critical_evidence' WHEN validity = 'superseded' THEN 'superseded' WHEN relevance = 'consumed' THEN 'consumed' ELSE 'active' END AS lifecycle FROM p2),
pf AS (SELECT *, CASE WHEN lifecycle <> 'active' THEN relevance <> 'consumed' ELSE active END AS active2 FROM p3)"""

_OBLIGATIONS = "concat_ws(',', CASE WHEN o_audit THEN 'audit_required' END, CASE WHEN o_constraint THEN 'active_constraint' END, CASE WHEN o_retain THEN 'retain_until_action_complete' END, CASE WHEN o_critical THEN 'critical_evidence' END)"


def _sole(name: str, active: str) -> str:
    return f"""{name} AS (SELECT DISTINCT session_id, node_id FROM (SELECT e.session_id, e.target, count(*) AS n, min(e.source) AS node_id FROM se e JOIN fin f ON f.session_id = e.session_id AND f.node_id = e.target JOIN pf p ON p.session_id = e.session_id AND p.node_id = e.source WHERE e.edge_type = 'supports' AND {active} GROUP BY e.session_id, e.target) WHERE n = 1)"""


def _safety(active: str) -> str:
    """sf: pf with reasons and removable, for the activity that nodes have."""
    return f"""{_sole('so', f'p.{active}')},
sf AS (SELECT *, CASE WHEN against <> '' THEN against WHEN lost THEN 'missing_recoverable_raw_ref' ELSE 'safe_to_remove_from_active_context' END AS reasons, against = '' AND NOT lost AS removable FROM (SELECT pf.*, concat_ws(',', CASE WHEN node_type IN ('goal', 'subgoal') AND {active} THEN 'active_goal' END, CASE WHEN node_type = 'constraint' AND {active} THEN 'active_constraint' END, CASE WHEN o_retain THEN 'unresolved_negative_evidence' END, CASE WHEN o_critical THEN 'critical_evidence' END, CASE WHEN o_constraint THEN 'active_constraint_obligation' END, CASE WHEN len(finals) > 0 THEN 'supports_final_decision' END, CASE WHEN so.node_id IS NOT NULL THEN 'unique_final_evidence' END) AS against,
  raw_ref IS NULL AND node_type IN ('tool_call', 'observation', 'error') AS lost FROM pf LEFT JOIN so USING (session_id, node_id)))"""


def exchanges(t):
    """The exchanges of stories, as a table; from here on the rows of a session stay together."""
    return table(story_exchanges(together(t("events"), "user_id")), "story-exchanges")


def graph(t):
    """The nodes and edges of stories, as tables: what follows reads the edges several times."""
    ex = exchanges(t)
    return table(story_nodes(ex), "story-nodes"), table(story_edges(ex), "story-edges")


def profiled(t):
    n, e = graph(t)
    return lifecycle.infer_profiles(n, e), e


@R.add("story_nodes", f"WITH {STORY} SELECT session_id, node_type, count(*) AS n, CAST(sum(token_count) AS BIGINT) AS tokens, count(*) FILTER (final) AS finals, count(*) FILTER (NOT active) AS inactive, count(raw_ref) AS archived, count(DISTINCT operation_key) AS keys, min(content) AS least, max(raw_ref) AS greatest FROM sn GROUP BY session_id, node_type")
def nodes_of_stories(t):
    n = graph(t)[0]
    c = lambda x: F.sum(x.cast("bigint"))
    return n.groupBy("session_id", "node_type").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"), c(F.col("final")).alias("finals"), c(~F.col("active")).alias("inactive"), F.count("raw_ref").alias("archived"), F.countDistinct("operation_key").alias("keys"), F.min("content").alias("least"), F.max("raw_ref").alias("greatest"))


@R.add("story_edges", f"WITH {STORY} SELECT session_id, source, target, edge_type, confidence FROM se")
def edges_of_stories(t):
    return graph(t)[1]


@R.add("lifecycle_profiles", f"WITH {PROFILES} SELECT session_id, node_id, relevance, validity, 'raw_in_context' AS storage, {_OBLIGATIONS} AS obligations, array_to_string(list_concat(resolved, list_concat(list_filter(superseded, lambda x: NOT list_contains(resolved, x)), finals)), ',') AS triggers, CASE WHEN semantic_outcome IS NOT NULL THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS confidence, lifecycle, active2 AS active FROM pf")
def lifecycle_profiles(t):
    p = lifecycle.apply_profiles(profiled(t)[0])
    return p.select("session_id", "node_id", "relevance", "validity", "storage", F.array_join("obligations", ",").alias("obligations"), F.array_join("triggers", ",").alias("triggers"), "confidence", "lifecycle", "active")


@R.add("profile_transitions", f"WITH {PROFILES} SELECT session_id, concat('active->', lifecycle) AS transition, count(*) AS n FROM pf WHERE lifecycle <> 'active' GROUP BY session_id, lifecycle")
def profile_transitions(t):
    found = lifecycle.transitions(profiled(t)[0])
    return found.groupBy("session_id", F.concat_ws("->", "before", "after").alias("transition")).agg(F.count("*").alias("n"))


@R.add("safety_reasons", f"WITH {PROFILES}, {_safety('active')} SELECT session_id, node_id, removable, reasons FROM sf")
def safety_reasons(t):
    p, e = profiled(t)
    return lifecycle.safety_decisions(p, e).select("session_id", "node_id", "removable", F.array_join("reasons", ",").alias("reasons"))


@R.add("producers", f"WITH {STORY} SELECT session_id, target AS node_id, coalesce(max(CASE WHEN edge_type = 'produces' THEN source END), max(source)) AS call FROM se WHERE edge_type IN ('produces', 'failed_with') GROUP BY session_id, target")
def producers(t):
    return cards.producers(graph(t)[1])


_MALFORMED = " OR ".join(f"contains(lower(content), '{p}')" for p in MALFORMED_PHRASES)
_KIND = f"CASE WHEN terminal THEN 'terminal' WHEN stale THEN 'stale' WHEN semantic_outcome = 'policy_denied' THEN 'policy_denied' WHEN {_MALFORMED} THEN 'malformed' ELSE 'actionable' END"
_CORRECTION = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CORRECTIONS.items()) + f" ELSE '{OTHER_CORRECTION}' END"
#: Cards (cd) of profiles.
CARDS = f"""
neg AS (SELECT p.*, max(step_id) OVER (PARTITION BY p.session_id) AS last_step FROM pf p),
us AS (SELECT e.session_id, e.source AS node_id, max(n.step_id) AS used_at FROM se e JOIN sn n ON n.session_id = e.session_id AND n.node_id = e.target WHERE e.edge_type IN ('blocks', 'provides_input', 'supports') GROUP BY e.session_id, e.source),
ch AS (SELECT neg.*, used_at, {_KIND} AS kind, row_number() OVER (PARTITION BY session_id, operation_key ORDER BY step_id DESC, node_id DESC) AS age FROM neg LEFT JOIN us USING (session_id, node_id) WHERE negative AND node_type IN ('error', 'observation')),
cg AS (SELECT session_id, operation_key, min(step_id) AS created_step, list(node_id ORDER BY step_id, node_id) AS source_node_ids, list_distinct(list(raw_ref ORDER BY step_id, node_id) FILTER (raw_ref IS NOT NULL)) AS refs0, list(raw_ref ORDER BY step_id, node_id) FILTER (raw_ref IS NOT NULL) AS refs, max(CASE WHEN age = 2 THEN note END) AS before_note, count(*) AS chain FROM ch GROUP BY session_id, operation_key),
c0 AS (SELECT cg.*, concat('failure_card_', substr(sha256(operation_key), 1, 16)) AS card_id, tool_name AS action_family, kind, content, note, step_id AS last_relevant_step, {_CORRECTION} AS correction, coalesce(refs, {_EMPTY}) AS rr,
  CASE WHEN len(resolved) > 0 OR validity = 'negative_resolved' THEN 'resolved' WHEN len(superseded) > 0 OR validity = 'superseded' THEN 'superseded' WHEN kind = 'terminal' THEN 'terminal' WHEN kind = 'stale' THEN 'stale' WHEN step_id < last_step - 8 AND NOT coalesce(used_at >= last_step - 8, false) THEN 'ttl_expired' END AS expiry_trigger
  FROM cg JOIN (SELECT * FROM ch WHERE age = 1) USING (session_id, operation_key)),
c1 AS (SELECT *, expiry_trigger IS NULL AND kind NOT IN ('terminal', 'stale') AS active FROM c0),
cd AS (SELECT *, CASE WHEN active THEN CASE WHEN chain = 1 THEN 'created' ELSE 'updated' END WHEN expiry_trigger IS NOT NULL THEN 'expired' ELSE 'downgraded' END AS event,
  CASE WHEN active THEN row_number() OVER (PARTITION BY session_id, active ORDER BY CASE WHEN kind IN ('actionable', 'policy_denied') THEN 1 ELSE 0 END DESC, last_relevant_step DESC, operation_key) END AS place,
  CASE WHEN chain > 1 AND before_note <> note THEN concat('"note": {{"before": "', before_note, '", "after": "', note, '"}}') ELSE '' END AS diff FROM c1)""".replace("{{", "{").replace("}}", "}")


def _strings(x: str) -> str:
    return f"""concat('[', array_to_string(list_transform({x}, lambda s: concat('"', s, '"')), ', '), ']')"""


_FULL = f"""concat('{{"card_id": "', card_id, '", "operation_scope": "', operation_key, '", "action_family": "', action_family, '", "entity_ids": [], "failure_class": "', kind, '", "latest_failure_cause": "', content, '", "failed_argument_diff": {{', diff, '}}, "next_admissible_correction": ', to_json(correction)::VARCHAR, ', "confidence": 1.0, "created_step": ', created_step, ', "last_relevant_step": ', last_relevant_step, ', "expiry_trigger": null, "raw_archive_refs": ', {_strings('rr')}, ', "source_node_ids": ', {_strings('source_node_ids')}, ', "kind": "failure_card"}}')"""


def _cut(text: str, most: int) -> str:
    return f"CASE WHEN length({text}) > {most} THEN concat(substr({text}, 1, {most - 1}), '…') ELSE {text} END"


_REFLAST = """CASE WHEN len(rr) > 0 THEN concat('"', rr[-1], '"') ELSE 'null' END"""
_COMPACT = f"""concat('{{"kind": "failure_card", "action_family": "', action_family, '", "failure_class": "', kind, '", "latest_failure_cause": "', {_cut('content', 96)}, '", "next_admissible_correction": ', to_json({_cut('correction', 80)})::VARCHAR, ', "raw_archive_ref": ', {_REFLAST}, '}}')"""
CARDS += f""",
ck AS (SELECT session_id, card_id, place, source_node_ids, source_node_ids[-1] AS node_id, CAST((strlen({_FULL}) + 3) // 4 AS BIGINT) AS full_cost, CAST((strlen({_COMPACT}) + 3) // 4 AS BIGINT) AS compact_cost, concat('failure[', action_family, ']: ', content) AS minimal, CASE WHEN len(rr) > 0 THEN CAST((strlen(rr[-1]) + 3) // 4 AS BIGINT) END AS handle_cost FROM cd WHERE active)"""


@R.add("story_cards", f"WITH {PROFILES}, {CARDS} SELECT session_id, card_id, operation_key AS operation_scope, action_family, kind AS failure_class, content AS latest_failure_cause, diff AS failed_argument_diff, correction AS next_admissible_correction, created_step, last_relevant_step, expiry_trigger, array_to_string(rr, ',') AS raw_archive_refs, array_to_string(source_node_ids, ',') AS source_node_ids, active, event, place FROM cd")
def story_cards(t):
    p, e = profiled(t)
    c = cards.failure_cards(p, e)
    changed = F.array_sort(F.map_entries(F.coalesce("failed_argument_diff", F.create_map().cast("map<string,struct<before:string,after:string>>"))))
    diff = F.array_join(F.transform(changed, lambda x: F.concat(F.lit('"'), x["key"], F.lit('": {"before": "'), x["value"]["before"], F.lit('", "after": "'), x["value"]["after"], F.lit('"}'))), ", ")
    return c.select("session_id", "card_id", "operation_scope", "action_family", "failure_class", "latest_failure_cause", diff.alias("failed_argument_diff"), "next_admissible_correction", "created_step", "last_relevant_step", "expiry_trigger", F.array_join("raw_archive_refs", ",").alias("raw_archive_refs"), F.array_join("source_node_ids", ",").alias("source_node_ids"), "active", "event", F.col("place").cast("bigint").alias("place"))


@R.add("card_payloads", f"WITH {PROFILES}, {CARDS} SELECT session_id, card_id, full_cost, compact_cost, handle_cost FROM ck")
def card_payloads(t):
    p, e = profiled(t)
    c = cards.failure_cards(p, e).where("active")
    return c.select("session_id", "card_id", estimate_tokens(cards.full_payload()).alias("full_cost"), estimate_tokens(cards.compact_payload()).alias("compact_cost"), F.when(F.size("raw_archive_refs") > 0, estimate_tokens(cards.last_ref())).alias("handle_cost"))


def _shrink(text: str, left: str) -> str:
    size = f"((strlen({text}) + 3) // 4)"
    return f"CASE WHEN {size} <= {left} THEN {text} ELSE concat(rtrim(substr({text}, 1, greatest(1, CAST(floor(length({text}) * {left} / {size}::DOUBLE) AS BIGINT) - 1))), '…') END"


def _ladder(budgets: str) -> str:
    """li: the form and cost of each active card in the budgets (session_id, card_budget), by a recursion over places; texts shrink up to four times."""
    steps, text = [], "p.minimal"
    for i in range(4):
        steps.append(f"LATERAL (SELECT {_shrink(text, 'lf.room')} AS m{i}) l{i}")
        text = f"l{i}.m{i}"
    form = lambda f, c, m, h, n: f"CASE WHEN lf.room <= 0 THEN {n} WHEN p.full_cost <= lf.room THEN {f} WHEN p.compact_cost <= lf.room THEN {c} WHEN {text} <> '' THEN {m} WHEN p.handle_cost <= lf.room THEN {h} ELSE {n} END"
    return f"""lr AS (SELECT session_id, card_budget AS room, CAST(0 AS BIGINT) AS place, '' AS form, CAST(0 AS BIGINT) AS cost FROM {budgets}
UNION ALL SELECT lf.session_id, lf.room - {form('p.full_cost', 'p.compact_cost', f'((strlen({text}) + 3) // 4)', 'p.handle_cost', '0')}, p.place, {form("'full'", "'compact'", "'minimal'", "'handle'", "'none'")}, CAST({form('p.full_cost', 'p.compact_cost', f'((strlen({text}) + 3) // 4)', 'p.handle_cost', '0')} AS BIGINT)
FROM lr lf JOIN ck p ON p.session_id = lf.session_id AND p.place = lf.place + 1, {', '.join(steps)}),
li AS (SELECT lr.session_id, card_id, node_id, source_node_ids, form, cost FROM lr JOIN ck USING (session_id, place) WHERE form <> 'none')"""


CARD_BUDGET = 48


@R.add("card_forms", f"WITH RECURSIVE {PROFILES}, {CARDS}, bu AS (SELECT DISTINCT session_id, CAST({CARD_BUDGET} AS BIGINT) AS card_budget FROM sn), {_ladder('bu')} SELECT session_id, card_id, node_id, form, cost FROM li")
def card_forms(t):
    p, e = profiled(t)
    budgets = p.select("session_id").distinct().withColumn("card_budget", F.lit(CARD_BUDGET).cast("bigint"))
    return cards.card_ladder(cards.failure_cards(p, e), budgets).where("form <> 'none'").select("session_id", "card_id", "node_id", "form", "cost")


#: Tokens of the contexts that story policies choose.
BUDGET = 512
_FIT = "CASE form WHEN 'summary' THEN CAST((strlen({0}) + 3) // 4 AS BIGINT) WHEN 'handle' THEN CAST((strlen(raw_ref) + 3) // 4 AS BIGINT) ELSE token_count END".format(_cut("content", 64))


def _greedy(budget: int | None, source: str, spent: str = "0") -> str:
    """v: source (form, priority, hard) with cost, kept and covered, by a recursion over places."""
    limit = "true" if budget is None else f"f.total + r.cost <= {budget}"
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY form = 'left out', priority DESC, step_id, node_id) AS place, CASE WHEN form = 'left out' THEN 0 ELSE {_FIT} END AS cost FROM {source}),
f AS (SELECT session_id, CAST(0 AS BIGINT) AS place, CAST(sum(CASE WHEN hard THEN cost ELSE 0 END) + max({spent}) AS BIGINT) AS total, false AS kept FROM r GROUP BY session_id
      UNION ALL SELECT r.session_id, r.place, CASE WHEN NOT r.hard AND r.form <> 'left out' AND {limit} THEN f.total + r.cost ELSE f.total END, r.hard OR r.form <> 'left out' AND {limit} FROM f JOIN r ON r.session_id = f.session_id AND r.place = f.place + 1),
v0 AS (SELECT r.*, f.kept FROM r JOIN f USING (session_id, place)),
v AS (SELECT *, kept AND form = 'whole' AS stands FROM v0)"""


def _raw_sql(budget: int) -> str:
    return f"""{PROFILES.replace('WITH ', '')},
h0 AS (SELECT pf.* EXCLUDE (active), active2 AS active, concat_ws(',', CASE WHEN node_type IN ('goal', 'subgoal') AND active2 THEN 'active_goal' END, CASE WHEN node_type = 'constraint' AND active2 THEN 'active_constraint' END, CASE WHEN o_retain THEN CASE WHEN node_type = 'error' THEN 'unresolved_failure' ELSE 'unresolved_negative_evidence' END END, CASE WHEN o_audit THEN 'audit_required' END, CASE WHEN relevance = 'active' THEN 'lifecycle:active' END, CASE WHEN o_critical THEN 'obligation:critical_evidence' END, CASE WHEN o_constraint THEN 'obligation:active_constraint' END, CASE WHEN o_retain THEN 'obligation:retain_until_action_complete' END, CASE WHEN len(finals) > 0 THEN 'supports_final_decision' END, CASE WHEN blocks THEN 'blocks_action' END) AS reason FROM pf),
h AS (SELECT *, reason <> '' AS hard, CASE WHEN reason <> '' THEN 'whole' WHEN validity IN ('negative_resolved', 'superseded') OR lifecycle IN ('resolved_failure', 'superseded') THEN 'summary' ELSE 'whole' END AS form, step_id + CASE WHEN reason = '' AND (validity IN ('negative_resolved', 'superseded') OR lifecycle IN ('resolved_failure', 'superseded')) THEN 10000 ELSE 0 END AS priority FROM h0),
{_greedy(budget, 'h')}"""


@R.add("raw_hard_view", f"WITH RECURSIVE {_raw_sql(BUDGET)} SELECT session_id, node_id, reason, form, cost, kept FROM v")
def raw_hard_view(t):
    return context.raw_hard_failures(*graph(t), BUDGET).select("session_id", "node_id", "reason", "form", "cost", "kept")


def _ours_sql(budget: int, graph_edges: bool = True, use_lifecycle: bool = True, failures: bool = True, constraints: bool = True) -> str:
    """CTEs of the flagship policy and its ablations; pf is replaced where lifecycle is not used."""
    says = lambda on, x: x if on else "NULL"
    plain = "" if use_lifecycle else ",\npl AS (SELECT * REPLACE ('unclassified' AS relevance, 'unknown' AS validity, 'active' AS lifecycle, false AS o_audit, false AS o_constraint, false AS o_retain, false AS o_critical, active AS active2) FROM pf)"
    pf = "pf" if use_lifecycle else "pl"
    card = f"""{CARDS},
sm AS (SELECT session_id, CAST(least(floor({budget} * 0.125), greatest(0, {budget} - sum(CASE WHEN hard THEN token_count ELSE 0 END))) AS BIGINT) AS card_budget FROM h GROUP BY session_id),
{_ladder('sm')}, sp AS (SELECT session_id, CAST(sum(cost) AS BIGINT) AS card_tokens FROM li GROUP BY session_id)"""
    none = "li AS (SELECT session_id, '' AS card_id, node_id, [node_id] AS source_node_ids, '' AS form, CAST(0 AS BIGINT) AS cost FROM pf WHERE false), sp AS (SELECT session_id, CAST(0 AS BIGINT) AS card_tokens FROM pf WHERE false)"
    return f"""{PROFILES}{plain}, {_sole('so', 'true')},
b0 AS (SELECT x.* EXCLUDE (active), active2 AS active, node_type = 'error' OR validity IN ('negative_unresolved', 'negative_resolved', 'superseded') AS bad FROM {pf} x),
fc AS (SELECT DISTINCT e.session_id, e.source AS node_id FROM se e JOIN b0 b ON b.session_id = e.session_id AND b.node_id = e.target WHERE b.bad AND e.edge_type IN ('produces', 'failed_with')),
b1 AS (SELECT b0.*, fc.node_id IS NOT NULL AS failed_call, so.node_id IS NOT NULL AS sole, max(CASE WHEN node_type = 'subgoal' AND active THEN step_id END) OVER (PARTITION BY b0.session_id) AS current FROM b0 LEFT JOIN fc USING (session_id, node_id) LEFT JOIN so USING (session_id, node_id)),
b2 AS (SELECT *, concat_ws(',', CASE WHEN node_type = 'goal' AND active THEN 'current_goal' END, CASE WHEN node_type = 'subgoal' AND step_id = current THEN 'current_subgoal' END, {says(constraints, "CASE WHEN node_type = 'constraint' AND active THEN 'active_constraint' END")}, {says(use_lifecycle, "CASE WHEN raw_ref IS NULL AND o_critical THEN 'unique_unrecoverable_critical_evidence' END")}, {says(graph_edges, "CASE WHEN raw_ref IS NULL AND sole THEN 'unique_unrecoverable_final_evidence' END")}) AS reason FROM b1),
b3 AS (SELECT *, reason <> '' AS hard, CASE WHEN reason <> '' THEN 'whole' WHEN bad AND validity IN ('negative_resolved', 'superseded') THEN '{'summary' if failures else 'left out'}' WHEN bad OR failed_call OR side_effect OR o_audit THEN 'left out' WHEN o_critical THEN 'critical' ELSE 'whole' END AS form0 FROM b2),
h AS (SELECT *, CASE form0 WHEN 'critical' THEN 'whole' ELSE form0 END AS form, step_id + CASE form0 WHEN 'summary' THEN 10000 WHEN 'critical' THEN 20000 ELSE 0 END AS priority FROM b3),
{card if failures and use_lifecycle else none},
hs AS (SELECT h.*, coalesce(card_tokens, 0) AS card_tokens FROM h LEFT JOIN sp USING (session_id)),
{_greedy(budget, 'hs', 'card_tokens')}"""


def _view_query(name: str, policy: str, **options: bool) -> None:
    names = {"use_graph_edges": "graph_edges", "use_lifecycle": "use_lifecycle", "retain_failures": "failures", "retain_constraints": "constraints"}

    @R.add(name, f"WITH RECURSIVE {_ours_sql(BUDGET, **{names[k]: v for k, v in options.items()})} SELECT session_id, node_id, reason, form, cost, kept FROM v")
    def query(t):
        n, e = graph(t)
        return context.POLICIES[policy](n, BUDGET, e).select("session_id", "node_id", "reason", "form", "cost", "kept")


_view_query("full_ours_view", "full_ours")
_view_query("without_graph_edges_view", "ours_without_graph_edges", use_graph_edges=False)
_view_query("without_lifecycle_view", "ours_without_lifecycle_states", use_lifecycle=False)
_view_query("without_failures_view", "ours_without_failure_retention", retain_failures=False)
_view_query("without_constraints_view", "ours_without_constraint_retention", retain_constraints=False)


@R.add("upper_bound", f"WITH {PROFILES}, {_safety('active2')} SELECT session_id, CAST(sum(token_count) AS BIGINT) AS original_tokens, CAST(sum(CASE WHEN NOT removable THEN token_count ELSE 0 END) AS BIGINT) AS selected_tokens, count(*) FILTER (NOT removable) AS kept FROM sf GROUP BY session_id")
def upper_bound(t):
    """The least context that loses nothing: all that may not be removed."""
    v = context.upper_bound(*graph(t))
    return v.groupBy("session_id").agg(F.sum("token_count").alias("original_tokens"), F.sum(F.when(F.col("kept"), F.col("cost")).otherwise(0)).alias("selected_tokens"), F.sum(F.col("kept").cast("bigint")).alias("kept"))


_MEASURES = ("input_tokens", "original_tokens", "compression_ratio", "evidence_retention", "unresolved_failure_retention", "constraint_retention", "evidence_path_preservation", "archive_recoverability", "repeated_failed_tool_calls", "unsafe_removal_count")


def _evaluated_sql(with_: str, cards_: bool) -> str:
    covered = "stands OR ca.node_id IS NOT NULL" if cards_ else "stands"
    own = "SELECT DISTINCT session_id, unnest(source_node_ids) AS node_id FROM li WHERE form <> 'handle'" if cards_ else "SELECT session_id, node_id FROM v WHERE false"
    tokens = "(SELECT session_id, sum(cost) AS c FROM li GROUP BY session_id)" if cards_ else "(SELECT session_id, 0 AS c FROM v WHERE false)"
    rate = lambda a, b: f"round(CASE WHEN {b} = 0 THEN 1 ELSE {a} / {b}::DOUBLE END, 9)"
    evidence, open_, rule = "(lifecycle = 'critical_evidence' OR o_critical)", "(validity = 'negative_unresolved' OR node_type = 'error' AND len(resolved) = 0)", "(node_type = 'constraint' AND active)"
    return f"""WITH RECURSIVE {with_}, ca AS ({own}), {_safety('active2').replace('so AS', 'so2 AS').replace('LEFT JOIN so USING', 'LEFT JOIN so2 USING').replace('so.node_id', 'so2.node_id')},
w AS (SELECT v.*, {covered} AS covered, sf.removable FROM v LEFT JOIN ca USING (session_id, node_id) JOIN (SELECT session_id, node_id, removable FROM sf) sf USING (session_id, node_id)),
g AS (SELECT session_id, sum(CASE WHEN kept THEN cost ELSE 0 END) AS own, sum(token_count) AS original, count(*) FILTER {'(WHERE ' + evidence + ')'} AS ea, count(*) FILTER (WHERE {evidence} AND covered) AS ec, count(*) FILTER (WHERE {open_}) AS ua, count(*) FILTER (WHERE {open_} AND covered) AS uc, count(*) FILTER (WHERE {rule}) AS ka, count(*) FILTER (WHERE {rule} AND covered) AS kc, count(*) FILTER (WHERE NOT covered AND NOT removable) AS unsafe, count(*) FILTER (WHERE node_type = 'decision' AND final) AS fa, count(DISTINCT CASE WHEN covered AND len(finals) > 0 THEN finals[1] END) AS fc FROM w GROUP BY session_id),
x AS (SELECT g.*, own + coalesce(k.c, 0) AS input, coalesce(q.n, 0) AS retries FROM g LEFT JOIN {tokens} k USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS n FROM se WHERE edge_type = 'retried_by' GROUP BY session_id) q USING (session_id))
SELECT session_id, CAST(input AS BIGINT) AS input_tokens, CAST(original AS BIGINT) AS original_tokens, round(greatest(0, 1 - input / original::DOUBLE), 9) AS compression_ratio, {rate('ec', 'ea')} AS evidence_retention, {rate('uc', 'ua')} AS unresolved_failure_retention, {rate('kc', 'ka')} AS constraint_retention, {rate('fc', 'fa')} AS evidence_path_preservation, 1.0::DOUBLE AS archive_recoverability, CAST(retries AS BIGINT) AS repeated_failed_tool_calls, unsafe AS unsafe_removal_count FROM x"""


def _rounded(df):
    return df.select("session_id", *[F.round(c, 9).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in _MEASURES])


@R.add("full_ours_metrics", _evaluated_sql(_ours_sql(BUDGET), True))
def full_ours_metrics(t):
    n, e = graph(t)
    view, items = context.full_ours(n, e, BUDGET)
    return _rounded(context.evaluate_view(view, e, items))


@R.add("raw_hard_metrics", _evaluated_sql(_raw_sql(BUDGET), False))
def raw_hard_metrics(t):
    n, e = graph(t)
    return _rounded(context.evaluate_view(context.raw_hard_failures(n, e, BUDGET), e))
