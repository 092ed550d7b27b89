"""Queries of messages, projections, evidence, checks, labels and small text functions over stories and flat tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidline.functions.text import CORRECTIONS, OTHER_CORRECTION, correction, estimate_tokens, has_side_effect, shrunk, stop_intent
from braidline.operators import checks, context, decisions, graph, lifecycle, liveness, projection
from braidline.plans.exchanges import EX
from braidline.plans.registry import Registry
from braidline.plans.states import _GONE, RECORDS, _archive, _judged, _queries, reduced
from braidline.plans.stories import BUDGET, PROFILES, STORY, _ours_sql, _shrink
from braidline.plans.stories import graph as story
from braidline.scratch import table
from braidline.sources.adapters import conversation_nodes, event_exchanges

R = Registry()


@R.add("rebuilt_messages", f"WITH {STORY} SELECT session_id, ordinal, CASE WHEN max(CASE WHEN node_type IN ('observation', 'error') THEN 1 ELSE 0 END) = 1 THEN 'tool' WHEN max(CASE WHEN node_type = 'decision' THEN 1 ELSE 0 END) = 1 THEN 'assistant' WHEN max(CASE WHEN node_type IN ('goal', 'subgoal') THEN 1 ELSE 0 END) = 1 THEN 'user' ELSE 'system' END AS role, coalesce(max(CASE WHEN node_type = 'tool_call' THEN concat(session_id, ':', step_id, ':c') END), '') AS calls, max(CASE WHEN node_type IN ('observation', 'error') THEN concat(session_id, ':', step_id, ':c') END) AS result_id, max(CASE WHEN node_type <> 'tool_call' THEN content END) AS content FROM sn GROUP BY session_id, ordinal")
def rebuilt_messages(t):
    m = projection.messages_of(story(t)[0])
    return m.select("session_id", "ordinal", "role", F.array_join("call_ids", ",").alias("calls"), "result_id", "content")


def _broken(t):
    """Messages of stories, of which some have lost or doubled their result, or have another message put in."""
    m = projection.messages_of(story(t)[0])
    step = F.floor((F.col("ordinal") + 1) / 3)
    result = F.col("role") == "tool"
    kept = m.where(~(result & (step % 11 == 5)))
    more = kept.where(result & (step % 13 == 6)).withColumn("ordinal", F.col("ordinal") + F.lit(0.25))
    between = kept.where(result & (step % 17 == 7)).select("session_id", (F.col("ordinal") - F.lit(0.5)).alias("ordinal"), F.lit("user").alias("role"), F.array().cast("array<string>").alias("call_ids"), F.lit(None).cast("string").alias("result_id"), F.lit("wait").alias("content"))
    lost = F.when((F.col("role") == "assistant") & (step % 19 == 8), F.array().cast("array<string>")).otherwise(F.col("call_ids"))
    return kept.withColumn("ordinal", F.col("ordinal").cast("double")).unionByName(more.withColumn("ordinal", F.col("ordinal").cast("double"))).unionByName(between.withColumn("ordinal", F.col("ordinal").cast("double"))).withColumn("call_ids", lost)


@R.add(
    "strict_protocol",
    f"""WITH {EX}, x AS (SELECT session_id, ordinal AS o, concat(session_id, ':', ordinal, ':c') AS id, CASE WHEN ordinal % 11 = 5 THEN 0 WHEN ordinal % 13 = 6 THEN 2 ELSE 1 END AS results, CASE WHEN ordinal % 19 = 8 THEN 0 ELSE 1 END AS calls, ordinal % 17 = 7 AND ordinal % 11 <> 5 AS between_ FROM ex)
SELECT session_id, id, unnest(list_filter([CASE WHEN calls = 1 AND results = 0 THEN 'call_without_result' END, CASE WHEN calls = 1 AND results > 1 THEN 'call_with_several_results' END, CASE WHEN calls = 1 AND results = 1 AND between_ THEN 'other_message_between' END, CASE WHEN calls = 0 AND results > 0 THEN 'result_without_call' END, CASE WHEN results > 1 THEN 'result_repeated' END], lambda z: z IS NOT NULL)) AS kind FROM x""",
)
def strict_protocol(t):
    return projection.strict_errors(_broken(t))


@R.add(
    "context_messages",
    f"""WITH RECURSIVE {_ours_sql(BUDGET)}, lm AS (SELECT session_id, max(ordinal) AS ordinal FROM sn GROUP BY session_id), cmm AS (SELECT session_id, ordinal FROM v WHERE kept AND form = 'whole' UNION SELECT session_id, ordinal FROM lm), fr AS (SELECT session_id, count(*) AS fragments FROM v WHERE kept AND form <> 'whole' GROUP BY session_id)
SELECT cmm.session_id, count(*) AS messages, CAST(sum(ordinal) AS BIGINT) AS ordinals, coalesce(any_value(fragments), 0) AS fragments FROM cmm LEFT JOIN fr USING (session_id) GROUP BY cmm.session_id""",
)
def context_messages(t):
    """The messages that the flagship policy's view asks for, and how much stays a fragment."""
    n, e = story(t)
    view = table(context.POLICIES["full_ours"](n, BUDGET, e), "view")
    chosen, fragments = projection.chosen_messages(view, projection.messages_of(n))
    per = chosen.groupBy("session_id").agg(F.count("*").alias("messages"), F.sum("ordinal").alias("ordinals"))
    return per.join(fragments.groupBy("session_id").agg(F.count("*").alias("fragments")), "session_id", "left").fillna(0, ["fragments"])


@R.add(
    "projected_spans",
    f"""WITH RECURSIVE {_GONE}, ev_sp AS (SELECT session_id, pos, span_id FROM sp WHERE reason = 'outside_live_closure_with_explicit_terminal_lifecycle')
SELECT session_id, span_id, CASE WHEN pos % 4 = 0 THEN 'assistant_tool_message_contains_non_tool_content' END AS restored FROM ev_sp""",
)
def projected_spans(t):
    """Evicted spans as messages: those whose calling message says more than its call come back, at every fourth step."""
    n, _, _, held, judged = _judged(t)
    members = held.where("span_type = 'tool_exchange'").select("session_id", "span_id", "ordinal").distinct()
    m = projection.messages_of(n)
    step = F.floor((F.col("ordinal") + 1) / 3)
    only = ~((F.col("role") == "assistant") & (step % 4 == 0))
    m = table(m.withColumn("tool_only", only), "messages")
    evicted = judged.where("not live").select("session_id", "span_id")
    _, back = projection.project(m, members, evicted)
    return evicted.join(back, ["session_id", "span_id"], "left").select("session_id", "span_id", F.col("reason").alias("restored"))


@R.add(
    "later_chains",
    f"""WITH {STORY}, fl AS (SELECT session_id, node_id, step_id FROM sn WHERE node_type = 'error'),
a AS (SELECT f.session_id, f.node_id, e.edge_type AS edge, e.target AS other, NULL AS result FROM fl f JOIN se e ON e.session_id = f.session_id AND e.source = f.node_id WHERE e.edge_type IN ('resolved_by', 'superseded_by') UNION ALL SELECT f.session_id, f.node_id, 'retried_by', e.target, replace(e.target, ':c', ':r') FROM fl f JOIN se e ON e.session_id = f.session_id AND e.source = concat(f.session_id, ':', f.step_id, ':c') WHERE e.edge_type = 'retried_by')
SELECT a.session_id, a.node_id, edge, n.step_id, other, result FROM a JOIN sn n ON n.session_id = a.session_id AND n.node_id = a.other""",
)
def later_chains(t):
    n, e = story(t)
    return projection.later_chain(n, e, n.where("node_type = 'error'").select("session_id", "node_id"))


@R.add("graph_neighbours", f"WITH {STORY} SELECT session_id, node_id, direction, edge_type, count(*) AS n FROM (SELECT session_id, source AS node_id, 'out' AS direction, edge_type FROM se UNION ALL SELECT session_id, target, 'in', edge_type FROM se) GROUP BY ALL")
def graph_neighbours(t):
    return graph.neighbours(story(t)[1]).groupBy("session_id", "node_id", "direction", "edge_type").agg(F.count("*").alias("n"))


@R.add(
    "typed_paths",
    f"""WITH RECURSIVE {STORY}, st AS (SELECT session_id, concat(session_id, ':1:d') AS start, concat(session_id, ':', last, ':d') AS target, last FROM (SELECT DISTINCT session_id, last FROM sx)), lk AS (SELECT session_id, source, target FROM se WHERE edge_type IN ('leads_to', 'produces', 'supports') AND split_part(target, ':', 2)::INT % 9 <> 4),
re AS (SELECT session_id, start AS node FROM st UNION SELECT re.session_id, lk.target FROM re JOIN lk ON lk.session_id = re.session_id AND lk.source = re.node) SELECT st.session_id, start, st.target, re.node IS NOT NULL AS found FROM st LEFT JOIN re ON re.session_id = st.session_id AND re.node = st.target""",
)
def typed_paths(t):
    """From the first decision to the last along three kinds of edges, without the nodes of every ninth step from the fourth."""
    n, e = story(t)
    last = n.groupBy("session_id").agg(F.max("step_id").alias("last"))
    pairs = last.select("session_id", F.concat_ws(":", "session_id", F.lit("1:d")).alias("start"), F.concat_ws(":", "session_id", "last", F.lit("d")).alias("target"))
    out = n.where("step_id % 9 = 4").select("session_id", F.col("node_id").alias("node"))
    return graph.has_path(e, pairs, ("leads_to", "produces", "supports"), out)


@R.add("evidence_overlay", f"WITH {STORY}, w AS (SELECT session_id, source, target FROM se WHERE edge_type = 'supports') SELECT session_id, count(*) AS edges, count(*) FILTER (edge_type = 'provides_input') AS inputs, count(*) FILTER (edge_type = 'provides_input' AND confidence = 1.0) AS sure FROM (SELECT * FROM se UNION ALL SELECT w.session_id, w.source, w.target, 'provides_input', 1.0 FROM w ANTI JOIN se ON se.session_id = w.session_id AND se.source = w.source AND se.target = w.target AND se.edge_type = 'provides_input') GROUP BY session_id")
def evidence_overlay(t):
    """As if each supporting result had been consumed whole; candidates of grade B add nothing."""
    _, e = story(t)
    sure = e.where("edge_type = 'supports'").select("session_id", "source", "target", F.lit("complete_scalar_consumption").alias("relation"), F.lit("A").alias("grade"))
    weak = e.where("edge_type = 'blocks'").select("session_id", "source", "target", F.lit("exact_entity_flow_candidate").alias("relation"), F.lit("B").alias("grade"))
    o = projection.overlay(e, sure.union(weak))
    inputs = F.col("edge_type") == "provides_input"
    return o.groupBy("session_id").agg(F.count("*").alias("edges"), F.sum(inputs.cast("bigint")).alias("inputs"), F.sum((inputs & (F.col("confidence") == 1.0)).cast("bigint")).alias("sure"))


@R.add(
    "identifier_overlap",
    f"""WITH {EX}, so AS (SELECT session_id, concat(ordinal, 'r') AS source, ordinal, 'number' AS kind, CAST(k AS VARCHAR) AS value FROM ex WHERE NOT err UNION ALL SELECT session_id, concat(ordinal, 'r'), ordinal, 'string', tool_name FROM ex WHERE NOT err), us AS (SELECT session_id, concat(ordinal, 'c') AS consumer, ordinal, 'number' AS kind, CAST(k AS VARCHAR) AS value FROM ex UNION ALL SELECT session_id, concat(ordinal, 'c'), ordinal, 'string', CAST(k AS VARCHAR) FROM ex)
SELECT so.session_id, source, consumer, so.kind, so.value, bool_or(ex.side_effect AND NOT ex.err) AS mutation FROM so JOIN us ON us.session_id = so.session_id AND us.kind = so.kind AND us.value = so.value AND us.ordinal > so.ordinal JOIN ex ON ex.session_id = us.session_id AND ex.ordinal = us.ordinal GROUP BY ALL""",
)
def identifier_overlap(t):
    """Keys of results in the arguments of later calls; a key as text is not the key as a number."""
    ex = event_exchanges(t("events"))
    k, o = F.col("k").cast("string"), F.col("ordinal").cast("string")
    pair = lambda n, s: F.explode(F.array(F.struct(F.lit("a").alias("path"), F.lit("number").alias("kind"), n.alias("value")), F.struct(F.lit("b").alias("path"), F.lit("string").alias("kind"), s.alias("value")))).alias("p")
    sources = ex.where("not err").select("session_id", F.concat(o, F.lit("r")).alias("source"), "ordinal", pair(k, F.col("tool_name"))).select("session_id", "source", "ordinal", "p.*")
    uses = ex.select("session_id", F.concat(o, F.lit("c")).alias("consumer"), "ordinal", pair(k, k)).select("session_id", "consumer", "ordinal", "p.*")
    writes = ex.where("side_effect and not err").select("session_id", F.concat(o, F.lit("c")).alias("consumer"))
    return projection.identifier_overlap(sources, uses, writes)


@R.add("structural_features", f"""WITH {STORY}, ar AS (SELECT session_id, step_id, bool_and(raw_ref IS NOT NULL AND step_id % 7 <> 0) AS stored FROM sn WHERE node_type IN ('tool_call', 'observation', 'error') GROUP BY session_id, step_id), n AS (SELECT session_id, count(*) AS prefix_node_count, count(*) FILTER (node_type = 'tool_call') AS tool_call_count, count(*) FILTER (side_effect) AS side_effect_node_count, count(*) FILTER (node_type = 'constraint') AS constraint_node_count, count(DISTINCT ordinal) AS message_count FROM sn GROUP BY session_id),
e AS (SELECT session_id, count(*) AS prefix_edge_count, count(*) FILTER (edge_type IN ('resolved_by', 'superseded_by', 'provides_input') AND confidence = 1.0) AS explicit_terminal_relation_count FROM se GROUP BY session_id), s AS (SELECT session_id, count(*) AS complete_tool_span_count, count(*) FILTER (stored) AS archived_complete_tool_span_count FROM ar GROUP BY session_id)
SELECT *, archived_complete_tool_span_count > 0 AND message_count > 0 AS cost_analysis_eligible, archived_complete_tool_span_count > 0 AND explicit_terminal_relation_count > 0 AS reactivation_candidate FROM n JOIN e USING (session_id) JOIN s USING (session_id)""")
def structural_features(t):
    n, e = story(t)
    return projection.structural_features(n, e, _archive(n))


@R.add("prefix_endpoints", f"WITH {STORY}, c AS (SELECT session_id, last // 2 AS cutoff FROM (SELECT DISTINCT session_id, last FROM sx)), vn AS (SELECT n.* FROM sn n JOIN c USING (session_id) WHERE step_id <= cutoff) SELECT session_id, count(*) AS edges, (SELECT count(*) FROM vn WHERE vn.session_id = se.session_id) AS nodes FROM se SEMI JOIN vn a ON a.session_id = se.session_id AND a.node_id = se.source SEMI JOIN vn b ON b.session_id = se.session_id AND b.node_id = se.target GROUP BY session_id")
def prefix_endpoints(t):
    """Half of each story: edges count if both ends are seen."""
    from braidline.operators import state

    n, e = story(t)
    half = n.groupBy("session_id").agg(F.floor(F.max("step_id") / 2).alias("cutoff"))
    vn, ve = state.visible(n, e, half)
    return ve.groupBy("session_id").agg(F.count("*").alias("edges")).join(vn.groupBy("session_id").agg(F.count("*").alias("nodes")), "session_id")


@R.add("future_independence", f"WITH {STORY} SELECT DISTINCT session_id, true AS same FROM sn")
def future_independence(t):
    """Whether the state of half of each story is the same with and without the rest."""
    from braidline.operators import state

    n, e = story(t)
    half = n.groupBy("session_id").agg(F.floor(F.max("step_id") / 2).alias("cutoff"))
    digest = lambda atoms: atoms.groupBy("session_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "atom_id", "status", "hard"))), ";"), 256).alias("h"))
    seen = digest(state.reduce_state(*state.visible(n, e, half))[0])
    cut = n.join(half, "session_id").where("step_id <= cutoff").drop("cutoff")
    mine = e.join(half, "session_id").where((F.element_at(F.split("source", ":"), 2).cast("bigint") <= F.col("cutoff")) & (F.element_at(F.split("target", ":"), 2).cast("bigint") <= F.col("cutoff"))).drop("cutoff")
    return seen.join(digest(state.reduce_state(cut, mine)[0]).withColumnRenamed("h", "g"), "session_id").select("session_id", (F.col("h") == F.col("g")).alias("same"))


_MASK = "concat_ws(',', CASE WHEN hard THEN 'hard_atom' END, CASE WHEN awaited THEN 'pending_confirmation' END, CASE WHEN guarded THEN concat('protected_type:', atom_type) END, CASE WHEN lost THEN 'unrecoverable_archive' END, CASE WHEN blocking THEN 'unresolved_blocking_state' END)"


@R.add(
    "omission_mask",
    f"""WITH {RECORDS}, m AS (SELECT *, list_contains((SELECT confirm FROM dq WHERE dq.session_id = atm.session_id), atom_id) AS awaited, atom_type IN ({", ".join(repr(x) for x in checks.NEVER_OMIT)}) AS guarded, step_id % 3 = 0 AS archived, NOT step_id % 3 = 0 AS lost, atom_type = 'conflicting_fact' AS blocking FROM atm), q AS (SELECT *, {_MASK} AS reasons FROM m)
SELECT session_id, atom_id, reasons, reasons = '' AS omit_allowed, CASE WHEN reasons <> '' THEN 1.0::DOUBLE WHEN status = 'conflicting' THEN 0.9::DOUBLE WHEN status = 'superseded' THEN 0.01::DOUBLE WHEN NOT archived THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END AS probability FROM q""",
)
def omission_mask(t):
    n, _, atoms, _ = reduced(t)
    awaited = _queries(t, n, atoms).select("session_id", F.explode("pending_confirmation").alias("atom_id"))
    rows = atoms.withColumns({"blocking": F.col("atom_type") == "conflicting_fact", "archived": F.col("step_id") % 3 == 0})
    return checks.risk_mask(rows, F.lit("archive_handle"), awaited).select("session_id", "atom_id", F.array_join("reasons", ",").alias("reasons"), "omit_allowed", "probability")


@R.add("guard_checks", f"""WITH g AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' ELSE 'p' END AS predicate, CASE event_id % 4 WHEN 0 THEN 'guess:x' ELSE 'schema:x' END AS verifier, event_id % 3 AS alt, event_id % 7 = 0 AS nosource FROM events)
SELECT event_id AS guard_id, concat_ws(',', CASE WHEN nosource THEN 'no_source' END, CASE WHEN predicate = '' THEN 'no_predicate' END, CASE WHEN verifier = 'guess:x' THEN 'verifier_not_allowed' END, CASE WHEN alt = 1 THEN 'generic_alternative' END, CASE WHEN alt = 2 THEN 'nothing_admissible' END) AS errors FROM g""")
def guard_checks(t):
    e = F.col("event_id")
    none = F.array().cast("array<string>")
    g = t("events").select(e.alias("guard_id"), F.when(e % 5 == 0, "").otherwise("p").alias("predicate"), F.when(e % 4 == 0, "guess:x").otherwise("schema:x").alias("verifier"), F.when(e % 3 == 0, F.array(F.lit("use the other depot"))).when(e % 3 == 1, F.array(F.lit(" Try AGAIN "))).otherwise(none).alias("alternatives"), none.alias("evidence"), F.when(e % 7 == 0, none).otherwise(F.array(F.lit("s"))).alias("sources"))
    return checks.guard_errors(g).select("guard_id", F.array_join("errors", ",").alias("errors"))


_FORMS = ("verified_summary", "archive_handle", "omit", "structured_state_delta")


@R.add("representation_checks", f"""WITH {RECORDS}, c AS (SELECT session_id, atom_id, step_id, CASE step_id % 4 WHEN 0 THEN 'verified_summary' WHEN 1 THEN 'archive_handle' WHEN 2 THEN 'omit' ELSE 'structured_state_delta' END AS form FROM atm)
SELECT session_id, form, CASE WHEN form IN ('verified_summary', 'structured_state_delta') AND step_id % 5 = 0 THEN 'unknown_atom' WHEN form IN ('verified_summary', 'structured_state_delta') AND step_id % 3 = 0 THEN 'claim_mismatch' WHEN form = 'archive_handle' AND step_id % 3 <> 0 THEN 'archive_round_trip_failed' WHEN form = 'omit' AND step_id % 3 <> 0 THEN 'omission_without_reason' ELSE '' END AS errors, count(*) AS n FROM c GROUP BY ALL""")
def representation_checks(t):
    """Candidates made of atoms, some about unknown atoms, some with other values, handles and omissions without what they need."""
    _, _, atoms, _ = reduced(t)
    s = F.col("step_id")
    made = atoms.select("session_id", F.col("atom_id").alias("candidate_id"), F.when(s % 4 == 0, _FORMS[0]).when(s % 4 == 1, _FORMS[1]).when(s % 4 == 2, _FORMS[2]).otherwise(_FORMS[3]).alias("form"), F.when(s % 5 == 0, "none").otherwise(F.col("atom_id")).alias("atom_id"), F.col("key").alias("claimed_key"), F.when(s % 3 == 0, "other").otherwise(F.col("value")).alias("claimed_value"), F.when(s % 3 == 0, "held").otherwise("lost").alias("raw_ref"), F.when(s % 3 == 0, "done").alias("reason"))
    archive = atoms.sparkSession.createDataFrame([("held",)], "digest string")
    checked = checks.representation_errors(made, atoms, archive)
    return checked.groupBy("session_id", "form", F.array_join("errors", ",").alias("errors")).agg(F.count("*").alias("n"))


@R.add("compilation_checks", f"""WITH {RECORDS}, h AS (SELECT session_id, count(*) FILTER (hard AND step_id % 2 = 1) AS missing, count(*) AS n FROM atm GROUP BY session_id)
SELECT session_id, c.name AS "check", CASE c.name WHEN 'hard_coverage' THEN missing = 0 WHEN 'provenance' THEN session_id % 3 <> 0 WHEN 'protocol' THEN session_id % 4 <> 0 ELSE session_id % 5 NOT IN (0, 1) END AS ok, CASE c.name WHEN 'hard_coverage' THEN missing WHEN 'provenance' THEN CASE WHEN session_id % 3 = 0 THEN 1 ELSE 0 END WHEN 'protocol' THEN CASE WHEN session_id % 4 = 0 THEN 1 ELSE 0 END ELSE CASE WHEN session_id % 5 IN (0, 1) THEN 1 ELSE 0 END END AS errors FROM h, (SELECT unnest(['hard_coverage', 'provenance', 'protocol', 'budget']) AS name) c""")
def compilation_checks(t):
    n, _, atoms, _ = reduced(t)
    form = F.when(F.col("hard") & (F.col("step_id") % 2 == 1), "omit").otherwise("raw_message")
    sessions = table(n.select("session_id").distinct(), "sessions")
    s = F.col("session_id")
    odd = sessions.where("session_id % 3 = 0").select("session_id", F.lit("raw_message").alias("form"), F.lit(None).cast("string").alias("atom_id"), F.array(F.lit("nowhere")).alias("sources"))
    made = atoms.select("session_id", form.alias("form"), "atom_id", "sources").unionByName(odd.join(atoms.groupBy("session_id").agg(F.min("atom_id").alias("a")), "session_id").select("session_id", "form", F.col("a").alias("atom_id"), "sources").withColumn("form", F.lit("omit")))
    # All checks read the union, of which Spark does not know that its rows lie by session: as it is, each would exchange it.
    selected = table(made, "selected", lies=True)
    costs = sessions.select("session_id", F.when(s % 5 == 0, 20).when(s % 5 <= 2, 9).otherwise(1).alias("cost"), F.lit(8).alias("soft"), F.lit(10).alias("hard"), (s % 5 == 2).alias("infeasible"))
    return checks.compilation_checks(atoms, selected, n.select("session_id", "node_id"), sessions.where("session_id % 4 = 0"), costs)


@R.add("converted_labels", """WITH l AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'still_active' WHEN 1 THEN 'resolved' WHEN 2 THEN 'stale' WHEN 3 THEN 'odd' ELSE 'unclear' END AS e, CASE doc_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'not_applicable' ELSE 'odd' END AS s, CASE doc_id % 3 WHEN 0 THEN 'corrected_syntax' ELSE 'other' END AS r FROM labels),
c AS (SELECT doc_id, CASE e WHEN 'still_active' THEN 'yes' WHEN 'unclear' THEN 'unclear' ELSE 'no' END AS keep, CASE WHEN e IN ('still_active', 'resolved', 'unclear') THEN e WHEN e = 'stale' THEN 'other' ELSE 'unclear' END AS cause, CASE s WHEN 'yes' THEN 'same_operation' WHEN 'no' THEN 'different_operation' ELSE CASE WHEN r = 'corrected_syntax' THEN 'syntax_correction' WHEN s = 'not_applicable' THEN 'not_applicable' END END AS rel, e IN ('stale', 'odd') AS lossy_e FROM l)
SELECT doc_id, keep AS should_card_remain_active, cause AS expiry_cause, coalesce(rel, 'unclear') AS scope_relation, concat_ws(',', CASE WHEN lossy_e THEN 'expiry_cause' END, CASE WHEN rel IS NULL THEN 'scope_relation' END) AS lossy FROM c""")
def converted_labels(t):
    d = F.col("doc_id")
    rows = t("labels").select("doc_id", F.when(d % 5 == 0, "still_active").when(d % 5 == 1, "resolved").when(d % 5 == 2, "stale").when(d % 5 == 3, "odd").otherwise("unclear").alias("expiry_trigger"), F.when(d % 4 == 0, "yes").when(d % 4 == 1, "no").when(d % 4 == 2, "not_applicable").otherwise("odd").alias("same_operation_scope"), F.when(d % 3 == 0, "corrected_syntax").otherwise("other").alias("relation"))
    c = checks.converted_labels(rows)
    return c.select("doc_id", "should_card_remain_active", "expiry_cause", "scope_relation", F.array_join("lossy", ",").alias("lossy"))


@R.add("label_checks", "WITH l AS (SELECT doc_id, quality FROM labels), d AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) SELECT doc_id, 'missing' AS error FROM d ANTI JOIN l USING (doc_id) UNION ALL SELECT doc_id, 'unknown_item' FROM l ANTI JOIN d USING (doc_id) UNION ALL SELECT doc_id, 'value:quality' FROM l WHERE quality <> 1")
def label_checks(t):
    return checks.label_errors(t("labels").select("doc_id", "quality"), t("documents").where("doc_id % 2 = 0").select("doc_id"), "doc_id", {"quality": (1,)})


@R.add("complete_scalars", f"WITH {EX} SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'number' WHEN 1 THEN 'string' WHEN 2 THEN 'number' WHEN 3 THEN 'boolean' END AS kind, CASE event_id % 6 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN tool_name WHEN 2 THEN CAST(k AS VARCHAR) WHEN 3 THEN 'true' END AS value FROM ex")
def complete_scalars(t):
    """Results that are a number, a text, a number under one key, a flag, or more than one thing."""
    e, k = F.col("event_id") % 6, F.col("k").cast("string")
    content = F.when(e == 0, k).when(e == 1, F.concat(F.lit('"'), "tool_name", F.lit('"'))).when(e == 2, F.concat(F.lit('{"id":'), k, F.lit("}"))).when(e == 3, "true").when(e == 4, F.concat(F.lit('{"id":'), k, F.lit(',"b":1}'))).otherwise("[1]")
    s = checks.complete_scalar(F.col("c"))
    return event_exchanges(t("events")).select("event_id", content.alias("c")).select("event_id", s["kind"].alias("kind"), s["value"].alias("value"))


_STOPS = ("I do not  need anything else, thanks.", "That's all? I wonder", "please go on", "ok. I am all set", "###STOP###")


@R.add("text_rules", f"""WITH e AS (SELECT event_id, event_type, event_id % 5 AS x FROM events) SELECT event_id, x IN (0, 3, 4) AS stops, event_type IN ('view') AND false OR starts_with(event_type, 'purchase') AND false AS acts, CASE event_type {" ".join(f"WHEN '{a}' THEN '{CORRECTIONS[b]}'" for a, b in (("click", "terminal"), ("view", "malformed"), ("signup", "policy_denied")))} ELSE '{OTHER_CORRECTION}' END AS guidance, CASE x WHEN 1 THEN true WHEN 3 THEN true ELSE false END AS writes FROM e""")
def text_rules(t):
    """Closings, guidance by class, and verbs that act."""
    x = F.col("event_id") % 5
    said = F.element_at(F.array(*[F.lit(s) for s in _STOPS]), (x + 1).cast("int"))
    kind = F.when(F.col("event_type") == "click", "terminal").when(F.col("event_type") == "view", "malformed").when(F.col("event_type") == "signup", "policy_denied").otherwise("actionable")
    tool = F.when(x == 1, "Cancel_order").when(x == 3, "update_flight").otherwise("get_update")
    return t("events").select("event_id", stop_intent(said).alias("stops"), has_side_effect(F.col("event_type")).alias("acts"), correction(kind).alias("guidance"), has_side_effect(tool).alias("writes"))


@R.add("shrunk_texts", f"""WITH {STORY}, s AS (SELECT session_id, node_id, content, CAST(1 + step_id % 9 AS BIGINT) AS room FROM sn WHERE node_type IN ('observation', 'error')) SELECT session_id, node_id, m4 AS text FROM s, LATERAL (SELECT {_shrink('content', 'room')} AS m0) a, LATERAL (SELECT {_shrink('m0', 'room')} AS m1) b, LATERAL (SELECT {_shrink('m1', 'room')} AS m2) c, LATERAL (SELECT {_shrink('m2', 'room')} AS m3) d, LATERAL (SELECT {_shrink('m3', 'room')} AS m4) e""")
def shrunk_texts(t):
    n = story(t)[0].where("node_type in ('observation', 'error')")
    return n.select("session_id", "node_id", shrunk(F.col("content"), (F.col("step_id") % 9 + 1).cast("bigint")).alias("text"))


@R.add("view_alignment", """WITH RECURSIVE v AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS view, CASE WHEN turn % 3 = 0 THEN turn + 3 ELSE turn END AS last FROM conversations WHERE role = 'user'), r AS (SELECT conv_id, turn + 1 AS ordinal FROM conversations WHERE role = 'assistant'),
f AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS view, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS got FROM v UNION ALL SELECT v.conv_id, v.view, coalesce(x.o, f.used), x.o FROM f JOIN v ON v.conv_id = f.conv_id AND v.view = f.view + 1, LATERAL (SELECT coalesce(min(CASE WHEN r.ordinal > greatest(f.used, v.last) THEN r.ordinal END), min(CASE WHEN r.ordinal > f.used THEN r.ordinal END)) AS o FROM r WHERE r.conv_id = v.conv_id) x)
SELECT conv_id, view, got AS ordinal FROM f WHERE view > 0""")
def view_alignment(t):
    """Views made of user turns, with the first assistant turn after what they selected."""
    from pyspark.sql import Window

    c = t("conversations")
    views = c.where("role = 'user'").select(F.col("conv_id").alias("session_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("bigint").alias("view"), F.when(F.col("turn") % 3 == 0, F.col("turn") + 3).otherwise(F.col("turn")).cast("bigint").alias("last_selected"))
    replies = c.where("role = 'assistant'").select(F.col("conv_id").alias("session_id"), (F.col("turn") + 1).cast("bigint").alias("ordinal"))
    return decisions.align_views(views, replies).select(F.col("session_id").alias("conv_id"), "view", "ordinal")


@R.add("ordered_distinct", f"WITH {EX} SELECT session_id, array_to_string(list(k ORDER BY first), ',') AS keys FROM (SELECT session_id, k, min(ordinal) AS first FROM ex GROUP BY session_id, k) GROUP BY session_id")
def ordered_distinct(t):
    """The operations of each session in the order in which they first occur."""
    first = event_exchanges(t("events")).groupBy("session_id", "k").agg(F.min("ordinal").alias("first"))
    return first.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "k"))), lambda x: x["k"].cast("string")), ",").alias("keys"))


@R.add("compressed_nodes", f"WITH {PROFILES} SELECT session_id, count(*) AS archived, max(step_id) AS step_id FROM pf WHERE node_type = 'observation' AND validity = 'superseded' AND len(finals) = 0 AND raw_ref IS NOT NULL GROUP BY session_id")
def compressed_nodes(t):
    """Superseded observations that may leave, replaced by one summary a session."""
    n, e = story(t)
    safe = table(lifecycle.safety_decisions(lifecycle.infer_profiles(n, e), e), "safe")
    chosen = safe.where("node_type = 'observation' and validity = 'superseded' and removable").select("session_id", "node_id")
    summaries, archived = decisions.compress(safe, chosen)
    return summaries.select("session_id", "step_id").join(archived.groupBy("session_id").agg(F.count("*").alias("archived")), "session_id")


@R.add("found_nodes", f"WITH {STORY} SELECT session_id, node_id, step_id FROM sn WHERE node_type IN ('error', 'decision') AND active AND step_id BETWEEN 3 AND 9")
def found_nodes(t):
    from braidline.operators.decisions import find_nodes

    return find_nodes(story(t)[0], types=("error", "decision"), active=True).where("step_id between 3 and 9").select("session_id", "node_id", "step_id")


@R.add("retokenized", "SELECT conv_id, count(*) AS nodes, count(*) FILTER (turn % 3 = 0) AS changed, CAST(sum(CASE WHEN turn % 3 = 0 THEN 0 ELSE (strlen(text) + 3) // 4 END) AS BIGINT) AS old_total, CAST(sum((strlen(text) + 3) // 4) AS BIGINT) AS new_total FROM conversations GROUP BY conv_id")
def retokenized(t):
    from braidline.sources.graphs import retokenized as rewrite

    n = conversation_nodes(t("conversations"))
    old = n.withColumn("token_count", F.when((F.col("ordinal") - 1) % 3 == 0, 0).otherwise(estimate_tokens(F.col("content"))))
    return rewrite(old)[1].withColumnRenamed("session_id", "conv_id")


