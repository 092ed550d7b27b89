"""Queries over event exchanges: relations, failures, windows, lifecycle, graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidline.functions.text import failure_class, normalized, semantic_outcome
from braidline.operators import context, failures, graph, lifecycle
from braidline.plans.registry import Registry
from braidline.sources.adapters import event_exchanges, exchange_edges, exchange_nodes

R = Registry()

#: The exchanges of events in SQL: ev has one row each, ex adds what came before in the same operation, nx what comes after.
EX = """
ev AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal, event_id, event_type AS tool_name, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       event_type = 'error' AS err, event_type IN ('purchase', 'signup') AS side_effect, value FROM events),
ex AS (SELECT *, lag(err) OVER w AS prev_err, lag(ordinal) OVER w AS prev_ordinal, lead(ordinal) OVER w AS next_ordinal, lead(err) OVER w AS next_err,
       max(CASE WHEN NOT err THEN ordinal END) OVER (PARTITION BY session_id, k ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_ok,
       max(ordinal) OVER (PARTITION BY session_id) AS last_step FROM ev WINDOW w AS (PARTITION BY session_id, k ORDER BY ordinal))"""
#: Its nodes and edges.
GRAPH = EX + """,
nodes AS (SELECT session_id, concat(session_id, ':', ordinal, ':c') AS node_id, 'tool_call' AS node_type, ordinal, k, side_effect, false AS negative FROM ex
          UNION ALL SELECT session_id, concat(session_id, ':', ordinal, ':r'), CASE WHEN err THEN 'error' ELSE 'observation' END, ordinal, k, false, err FROM ex),
edges AS (SELECT session_id, concat(session_id, ':', ordinal, ':c') AS source, concat(session_id, ':', ordinal, ':r') AS target, CASE WHEN err THEN 'failed_with' ELSE 'produces' END AS edge_type FROM ex
          UNION ALL SELECT session_id, concat(session_id, ':', prev_ordinal, ':c'), concat(session_id, ':', ordinal, ':c'), 'retried_by' FROM ex WHERE prev_err
          UNION ALL SELECT session_id, concat(session_id, ':', prev_ordinal, ':r'), concat(session_id, ':', ordinal, ':r'), CASE WHEN err THEN 'superseded_by' ELSE 'resolved_by' END FROM ex WHERE prev_err
          UNION ALL SELECT session_id, concat(session_id, ':', prev_ok, ':r'), concat(session_id, ':', ordinal, ':r'), 'superseded_by' FROM ex WHERE NOT err AND prev_ok IS NOT NULL),
flags AS (SELECT session_id, source AS node_id, bool_or(edge_type IN ('produces', 'failed_with')) AS gave, bool_or(edge_type = 'resolved_by') AS resolved, bool_or(edge_type = 'superseded_by') AS superseded FROM edges GROUP BY session_id, source),
lab AS (SELECT n.*, CASE WHEN n.node_type = 'tool_call' AND coalesce(gave, false) THEN 'consumed' ELSE 'active' END AS relevance,
        CASE WHEN coalesce(superseded, false) THEN 'superseded' WHEN negative THEN CASE WHEN coalesce(resolved, false) THEN 'negative_resolved' ELSE 'negative_unresolved' END WHEN node_type = 'observation' THEN 'valid' ELSE 'unknown' END AS validity
        FROM nodes n LEFT JOIN flags f USING (session_id, node_id)),
life AS (SELECT *, CASE WHEN side_effect THEN 'audit_required' WHEN node_type = 'error' AND validity = 'negative_unresolved' THEN 'unresolved_failure' WHEN node_type = 'error' AND validity = 'negative_resolved' THEN 'resolved_failure'
         WHEN validity = 'superseded' THEN 'superseded' WHEN relevance = 'consumed' THEN 'consumed' ELSE 'active' END AS lifecycle FROM lab)"""


def _graph(t):
    ex = event_exchanges(t("events"))
    return exchange_nodes(ex), exchange_edges(ex)


def _profiled(t):
    n, e = _graph(t)
    return lifecycle.infer_profiles(context.completed(n), e)


@R.add("exchanges", f"WITH {EX} SELECT session_id, ordinal, event_id, tool_name, k, err, side_effect, prev_err, prev_ordinal, prev_ok FROM ex")
def exchanges(t):
    return event_exchanges(t("events")).select("session_id", "ordinal", "event_id", "tool_name", "k", "err", "side_effect", "prev_err", "prev_ordinal", "prev_ok")


def _edge_query(name: str, kind: str) -> None:
    @R.add(name, f"WITH {GRAPH} SELECT session_id, source, target FROM edges WHERE edge_type = '{kind}'")
    def query(t):
        return _graph(t)[1].where(F.col("edge_type") == kind).select("session_id", "source", "target")


_edge_query("retry_edges", "retried_by")
_edge_query("resolution_edges", "resolved_by")
_edge_query("supersession_edges", "superseded_by")


@R.add("edge_census", f"WITH {GRAPH} SELECT edge_type, count(*) AS n, count(DISTINCT session_id) AS sessions FROM edges GROUP BY edge_type")
def edge_census(t):
    # Two counts that combine before the shuffle, instead of a distinct over all edges.
    per = _graph(t)[1].groupBy("edge_type", "session_id").agg(F.count("*").alias("c"))
    return per.groupBy("edge_type").agg(F.sum("c").alias("n"), F.count("*").alias("sessions"))


@R.add("unresolved_failures", f"WITH {EX} SELECT session_id, ordinal, k FROM ex WHERE err AND next_ordinal IS NULL")
def unresolved_failures(t):
    return failures.unresolved(event_exchanges(t("events"))).select("session_id", "ordinal", "k")


CARDS = f"""{EX}, c AS (SELECT session_id, k, min(ordinal) AS created_step, max(ordinal) AS last_relevant_step, count(*) AS chain FROM ex WHERE err GROUP BY session_id, k),
cards AS (SELECT c.*, concat('failure_card_', substr(sha256(concat(c.session_id, ':', c.k)), 1, 16)) AS card_id, ex.tool_name AS action_family,
          CASE WHEN NOT ex.next_err THEN 'resolved' WHEN ex.next_err THEN 'superseded' WHEN c.last_relevant_step < ex.last_step - 8 THEN 'ttl_expired' END AS expiry_trigger
          FROM c JOIN ex ON ex.session_id = c.session_id AND ex.ordinal = c.last_relevant_step)"""


@R.add("failure_cards", f"WITH {CARDS} SELECT session_id, k, card_id, action_family, created_step, last_relevant_step, chain, expiry_trigger, expiry_trigger IS NULL AS active FROM cards")
def cards(t):
    return failures.operation_failures(event_exchanges(t("events")))


@R.add("card_expiry", f"WITH {CARDS} SELECT coalesce(expiry_trigger, 'active') AS state, count(*) AS n, CAST(sum(chain) AS BIGINT) AS failures, max(last_relevant_step - created_step) AS longest FROM cards GROUP BY 1")
def card_expiry(t):
    c = failures.operation_failures(event_exchanges(t("events")))
    return c.groupBy(F.coalesce("expiry_trigger", F.lit("active")).alias("state")).agg(F.count("*").alias("n"), F.sum("chain").alias("failures"), F.max(F.col("last_relevant_step") - F.col("created_step")).alias("longest"))


WINDOWS = f"""{EX}, pf AS (SELECT session_id, ordinal, k, least(3, last_step - ordinal) AS observed_actions, last_step - ordinal < 3 AS window_censored,
  (SELECT count(*) FROM ex b WHERE b.session_id = a.session_id AND b.ordinal > a.ordinal AND b.ordinal <= a.ordinal + 3 AND b.k = a.k AND b.err) AS repeated_invalid,
  coalesce(next_ordinal <= ordinal + 3 AND NOT next_err, false) AS resolved_within_window, CASE WHEN next_ordinal <= ordinal + 3 AND NOT next_err THEN next_ordinal - ordinal END AS recovery_action_index FROM ex a WHERE err)"""


@R.add("post_failure_windows", f"WITH {WINDOWS} SELECT * FROM pf")
def post_failure_windows(t):
    return failures.post_failure_windows(event_exchanges(t("events")))


@R.add("post_failure_by_condition", f"WITH {WINDOWS} SELECT session_id % 2 AS condition, count(*) AS failures, count(*) FILTER (window_censored) AS censored, count(*) FILTER (repeated_invalid > 0) AS repeated, count(*) FILTER (resolved_within_window) AS resolved, CAST(sum(observed_actions) AS BIGINT) AS actions, round(avg(recovery_action_index::DOUBLE), 6) AS mean_recovery FROM pf GROUP BY 1")
def post_failure_by_condition(t):
    n = lambda c: F.sum(c.cast("bigint"))
    w = failures.post_failure_windows(event_exchanges(t("events")))
    return w.groupBy((F.col("session_id") % 2).alias("condition")).agg(F.count("*").alias("failures"), n(F.col("window_censored")).alias("censored"), n(F.col("repeated_invalid") > 0).alias("repeated"), n(F.col("resolved_within_window")).alias("resolved"), F.sum("observed_actions").alias("actions"), F.round(F.avg("recovery_action_index"), 6).alias("mean_recovery"))


@R.add("recovery_distance", f"WITH {EX} SELECT tool_name, count(*) AS recoveries, round(avg((ordinal - prev_ordinal)::DOUBLE), 6) AS mean_distance, max(ordinal - prev_ordinal) AS longest FROM ex WHERE prev_err AND NOT err GROUP BY tool_name")
def recovery_distance(t):
    gap = F.col("ordinal") - F.col("prev_ordinal")
    return event_exchanges(t("events")).where("prev_err and not err").groupBy("tool_name").agg(F.count("*").alias("recoveries"), F.round(F.avg(gap), 6).alias("mean_distance"), F.max(gap).alias("longest"))


@R.add("trace_windows", f"WITH {EX} SELECT session_id, ordinal, (SELECT count(*) FROM ex b WHERE b.session_id = a.session_id AND b.ordinal BETWEEN a.ordinal - 2 AND a.ordinal + 5) AS seen, (SELECT count(*) FILTER (b.err) FROM ex b WHERE b.session_id = a.session_id AND b.ordinal BETWEEN a.ordinal - 2 AND a.ordinal + 5) AS failures FROM ex a WHERE err")
def trace_windows(t):
    return failures.trace_window(event_exchanges(t("events")))


SESSIONS = f"""{EX}, sf AS (SELECT session_id, count(*) AS actions, count(*) FILTER (err) AS failures, count(*) FILTER (prev_err) AS retries, count(*) FILTER (prev_err AND NOT err) AS resolved, count(*) FILTER (prev_err AND err) AS repeated_failures FROM ex GROUP BY session_id)"""


@R.add("session_failures", f"WITH {SESSIONS} SELECT * FROM sf")
def session_failures(t):
    return failures.session_failures(event_exchanges(t("events")))


@R.add("failure_rich_topk", f"WITH {SESSIONS}, r AS (SELECT session_id % 4 AS domain, session_id, failures, retries, repeated_failures, row_number() OVER (PARTITION BY session_id % 4 ORDER BY failures DESC, repeated_failures DESC, retries DESC, session_id) AS place FROM sf) SELECT * FROM r WHERE place <= 5")
def failure_rich_topk(t):
    from pyspark.sql import Window

    s = failures.session_failures(event_exchanges(t("events"))).withColumn("domain", F.col("session_id") % 4)
    order = Window.partitionBy("domain").orderBy(F.col("failures").desc(), F.col("repeated_failures").desc(), F.col("retries").desc(), "session_id")
    best = s.withColumn("place", F.row_number().over(order)).where("place <= 5")  # the window keeps five a task before it shuffles
    return best.select("domain", "session_id", "failures", "retries", "repeated_failures", F.col("place").cast("bigint").alias("place"))


@R.add("repeat_invalid_actions", f"WITH {EX} SELECT session_id, k, count(*) AS repeats, max(ordinal - prev_ordinal) AS longest FROM ex WHERE prev_err AND err GROUP BY session_id, k")
def repeat_invalid_actions(t):
    return event_exchanges(t("events")).where("prev_err and err").groupBy("session_id", "k").agg(F.count("*").alias("repeats"), F.max(F.col("ordinal") - F.col("prev_ordinal")).alias("longest"))


@R.add("lifecycle_labels", f"WITH {GRAPH} SELECT session_id, node_id, node_type, relevance, validity, lifecycle FROM life")
def lifecycle_labels(t):
    return _profiled(t).select("session_id", "node_id", "node_type", "relevance", "validity", "lifecycle")


@R.add("lifecycle_transitions", f"WITH {GRAPH} SELECT concat('active->', lifecycle) AS transition, count(*) AS n FROM life WHERE lifecycle <> 'active' GROUP BY 1")
def lifecycle_transitions(t):
    return _profiled(t).where("lifecycle <> 'active'").groupBy(F.concat(F.lit("active->"), F.col("lifecycle")).alias("transition")).agg(F.count("*").alias("n"))


@R.add(
    "safety_decisions",
    f"""WITH {GRAPH} SELECT session_id, node_id, validity <> 'negative_unresolved' AND NOT (node_type = 'tool_call' AND ordinal % 5 = 0) AS removable,
CASE WHEN validity = 'negative_unresolved' THEN 'unresolved_negative_evidence' WHEN node_type = 'tool_call' AND ordinal % 5 = 0 THEN 'missing_recoverable_raw_ref' ELSE 'safe_to_remove_from_active_context' END AS reasons FROM life""",
)
def safety_decisions(t):
    """Calls at every fifth step have no archived record here, so that both kinds of reasons occur."""
    n, e = _graph(t)
    n = n.withColumn("raw_ref", F.when(~((F.col("node_type") == "tool_call") & (F.col("ordinal") % 5 == 0)), F.col("node_id")))
    rows = lifecycle.safety_decisions(lifecycle.infer_profiles(context.completed(n), e), e)
    return rows.select("session_id", "node_id", "removable", F.array_join("reasons", ",").alias("reasons"))


@R.add("slot_state", f"WITH {EX}, o AS (SELECT *, max(ordinal) OVER (PARTITION BY session_id, tool_name) AS latest FROM ex WHERE NOT err) SELECT session_id, tool_name, ordinal, k, CASE WHEN ordinal < latest THEN 'superseded' ELSE 'current' END AS status FROM o")
def slot_state(t):
    return failures.slot_state(event_exchanges(t("events")))


@R.add("field_versions", f"WITH {EX} SELECT session_id, k, ordinal, CAST(sum(CASE WHEN NOT err AND side_effect THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, k ORDER BY ordinal) AS BIGINT) AS version FROM ex")
def field_versions(t):
    return failures.field_versions(event_exchanges(t("events")))


@R.add("graph_validation", f"WITH {GRAPH} SELECT 'raw_ref' AS kind, count(*) AS n FROM nodes WHERE side_effect HAVING count(*) > 0")
def graph_validation(t):
    """Exchanges have no archive here, so every side effect lacks its record; nothing else is wrong with them."""
    n, e = _graph(t)
    return graph.violations(n.withColumn("raw_ref", F.lit(None).cast("string")), e).groupBy("kind").agg(F.count("*").alias("n"))


@R.add("legacy_edges", f"WITH {GRAPH}, old AS (SELECT session_id, target AS source, source AS target, CASE edge_type WHEN 'retried_by' THEN 'retries' WHEN 'resolved_by' THEN 'resolves' ELSE 'supersedes' END AS edge_type FROM edges WHERE edge_type IN ('retried_by', 'resolved_by', 'superseded_by')), al AS (SELECT * FROM old UNION SELECT session_id, source, target, edge_type FROM edges) SELECT edge_type, count(*) AS n FROM al GROUP BY edge_type")
def legacy_edges(t):
    """Older edges made of the forward ones, normalized: each gains its forward twin."""
    e = _graph(t)[1]
    old = F.create_map(F.lit("retried_by"), F.lit("retries"), F.lit("resolved_by"), F.lit("resolves"), F.lit("superseded_by"), F.lit("supersedes"))
    forward = ("retried_by", "resolved_by", "superseded_by")
    legacy = e.where(F.col("edge_type").isin(*forward)).select("session_id", F.col("target").alias("source"), F.col("source").alias("target"), old[F.col("edge_type")].alias("edge_type"))
    kept = e.where(~F.col("edge_type").isin(*forward)).select("session_id", "source", "target", "edge_type")
    return graph.normalize_legacy(legacy.union(kept)).groupBy("edge_type").agg(F.count("*").alias("n"))


@R.add(
    "reachability",
    f"""WITH RECURSIVE {GRAPH}, st AS (SELECT session_id, concat(session_id, ':', min(ordinal), ':c') AS start FROM ex WHERE err GROUP BY session_id),
re AS (SELECT session_id, start, start AS node FROM st UNION SELECT re.session_id, re.start, e.target FROM re JOIN edges e ON e.session_id = re.session_id AND e.source = re.node)
SELECT session_id, start, count(*) AS nodes FROM re GROUP BY session_id, start""",
)
def reachability(t):
    """From the call of each session's first failure, over all edges."""
    ex = event_exchanges(t("events"))
    starts = ex.where("err").groupBy("session_id").agg(F.min("ordinal").alias("o")).select("session_id", F.concat_ws(":", "session_id", "o", F.lit("c")).alias("start"))
    return graph.reachable(exchange_edges(ex), starts).groupBy("session_id", "start").agg(F.count("*").alias("nodes"))


@R.add(
    "protocol_closure",
    f"""WITH {EX}, m AS (SELECT session_id, 2 * ordinal - 1 AS ordinal, 'assistant' AS role, ordinal AS id FROM ex UNION ALL SELECT session_id, 2 * ordinal, 'tool', ordinal FROM ex)
SELECT session_id, count(*) AS messages, count(*) FILTER (ordinal % 2 = 0) AS selected FROM m WHERE id % 7 = 0 GROUP BY session_id""",
)
def protocol_closure(t):
    """Results of every seventh exchange are chosen; their calls come back with them."""
    ex = event_exchanges(t("events"))
    call = ex.select("session_id", (F.col("ordinal") * 2 - 1).alias("ordinal"), F.lit("assistant").alias("role"), F.array(F.col("ordinal").cast("string")).alias("call_ids"), F.lit(None).cast("string").alias("result_id"))
    result = ex.select("session_id", (F.col("ordinal") * 2).alias("ordinal"), F.lit("tool").alias("role"), F.lit(None).cast("array<string>").alias("call_ids"), F.col("ordinal").cast("string").alias("result_id"))
    closed = graph.protocol_closure(call.union(result), ex.where("ordinal % 7 = 0").select("session_id", (F.col("ordinal") * 2).alias("ordinal")))
    return closed.groupBy("session_id").agg(F.count("*").alias("messages"), F.sum((F.col("reason") == "selected").cast("bigint")).alias("selected"))


@R.add("first_use", f"WITH {EX} SELECT session_id, k, ordinal, (SELECT min(b.ordinal) FROM ex b WHERE b.session_id = a.session_id AND b.k = a.k AND b.ordinal > a.ordinal AND b.side_effect) AS used_at FROM ex a WHERE NOT err")
def first_use(t):
    """Where the key that a success gave is first used by a side effect."""
    ex = event_exchanges(t("events")).select("session_id", F.lit("number").alias("kind"), F.col("k").alias("value"), "ordinal", "err", "side_effect")
    return graph.first_use(ex.where("not err"), ex.where("side_effect")).select("session_id", F.col("value").alias("k"), "ordinal", "used_at")


@R.add("result_outcomes", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'negative' WHEN event_type = 'purchase' THEN 'positive' WHEN event_type = 'signup' THEN 'policy_denied' ELSE 'inconclusive' END AS outcome, CASE WHEN event_type = 'signup' THEN 'policy_denied' WHEN event_type = 'error' THEN 'malformed' ELSE 'actionable' END AS failure_class FROM events")
def result_outcomes(t):
    """Payloads made of events, as text and as JSON, through the outcome and failure rules."""
    payload = F.when(F.col("event_type") == "error", '{"error": "Missing  required field"}').when(F.col("event_type") == "purchase", '{"status": "Completed"}').when(F.col("event_type") == "signup", "Permission   DENIED for this user").otherwise("nothing to report")
    rows = t("events").select("event_id", payload.alias("payload")).withColumn("outcome", semantic_outcome(F.col("payload"), F.lit(False)))
    return rows.select("event_id", "outcome", failure_class(normalized(F.col("payload")), F.col("outcome")).alias("failure_class"))
