"""Queries of decision state, policy checks, the lifecycle machine, compilation, planning and costs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from braidline.functions.text import estimate_tokens, truncated
from braidline.operators import compiler, context, decisions, graph, lifecycle
from braidline.operators.ranges import numbered
from braidline.plans.contexts import NODES, cut
from braidline.plans.exchanges import EX, GRAPH
from braidline.plans.registry import Registry
from braidline.plans.states import BACK, beam_sql, chosen_sql
from braidline.plans.stories import PROFILES
from braidline.plans.stories import graph as graph_of
from braidline.sources.adapters import conversation_nodes, event_exchanges, exchange_edges, exchange_nodes

R = Registry()


def _labelled(t):
    ex = event_exchanges(t("events"))
    return lifecycle.infer_profiles(context.completed(exchange_nodes(ex)), exchange_edges(ex))


_LARGE = "node_type IN ('observation', 'summary', 'archive_handle') AND (token_count * 8 >= 128 OR node_type IN ('summary', 'archive_handle'))"


@R.add(
    "candidate_objects",
    f"""WITH {PROFILES}, c AS (SELECT *, CASE WHEN node_type = 'error' OR validity = 'negative_unresolved' THEN 'failure_negative_guard' WHEN validity = 'superseded' OR lifecycle = 'superseded' THEN 'superseded_conflicting_expired_state' WHEN node_type = 'constraint' OR regexp_matches(lower(content), 'confirm|explicit user consent') THEN 'policy_constraint_confirmation' WHEN node_type IN ('goal', 'subgoal') THEN 'goal_subgoal' WHEN {_LARGE} THEN 'evidence_large_observation' ELSE 'entity_state_slot' END AS object_class FROM pf)
SELECT object_class, validity, count(*) AS n, concat_ws(',', 'raw_message', CASE WHEN object_class IN ('entity_state_slot', 'evidence_large_observation', 'superseded_conflicting_expired_state') THEN 'structured_state_delta' END, CASE WHEN validity = 'valid' THEN 'verified_summary' END, CASE WHEN object_class = 'failure_negative_guard' AND validity = 'valid' THEN 'negative_guard' END, 'omit') AS forms FROM c GROUP BY object_class, validity""",
)
def candidate_objects(t):
    """Over complete stories, with the tokens and texts of their nodes."""
    rows = lifecycle.infer_profiles(*graph_of(t))
    kind = decisions.object_class(F.col("node_type"), F.col("validity"), F.col("lifecycle"), F.col("token_count") * 8, F.col("content"))
    rows = rows.withColumn("object_class", kind)
    forms = F.array_join(decisions.representations(F.col("object_class"), F.col("validity") == "valid", F.lit(False)), ",")
    return rows.groupBy("object_class", "validity").agg(F.count("*").alias("n")).withColumn("forms", forms)


RULES = [("r1", [], [], ["k"], False), ("r2", ["purchase"], [], [], True), ("r3", ["signup", "click"], ["signup"], ["value"], False)]


@R.add(
    "policy_checks",
    """WITH a AS (SELECT event_id, event_type, value > 50 AS confirmed, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'x' END AS v FROM events),
c AS (SELECT event_id, concat_ws(',', CASE WHEN event_type = 'signup' THEN 'r3:tool_denied' END, CASE WHEN event_type IN ('signup', 'click') AND v = '' THEN 'missing_required_policy_fields' END, CASE WHEN event_type = 'purchase' AND NOT confirmed THEN 'confirmation_required' END) AS violations FROM a)
SELECT event_id, violations, violations = '' AS allowed FROM c""",
)
def policy_checks(t):
    e = t("events")
    actions = e.select("event_id", F.col("event_type").alias("tool_name"), F.create_map(F.lit("k"), F.lit("1"), F.lit("value"), F.when(F.col("event_id") % 3 == 0, "").otherwise("x")).alias("arguments"), (F.col("value") > 50).alias("confirmed"))
    rules = e.sparkSession.createDataFrame(RULES, "rule_id string, trigger_tools array<string>, denied_tools array<string>, required_fields array<string>, requires_confirmation boolean")
    return decisions.check_actions(actions, rules).select("event_id", F.array_join("violations", ",").alias("violations"), "allowed")


EFFECTS = [("click", "read", "complete", False), ("view", "read", "partial", False), ("purchase", "write", "none", True), ("signup", "write", "none", False), ("error", "read", "none", False)]


@R.add(
    "lifecycle_machine",
    f"""WITH {EX}, ef(tool_name, effect, snapshot, receipt) AS (VALUES {', '.join(f"('{a}', '{b}', '{c}', {str(d).lower()})" for a, b, c, d in EFFECTS)}),
m AS (SELECT ex.session_id, ex.ordinal, ex.err, ef.*, (SELECT min(b.ordinal) FROM ex b WHERE b.session_id = ex.session_id AND b.k = ex.k AND b.ordinal > ex.ordinal AND NOT b.err) AS retry,
 (SELECT min(b.ordinal) FROM ex b WHERE b.session_id = ex.session_id AND b.k = ex.k AND b.tool_name = ex.tool_name AND b.ordinal > ex.ordinal AND NOT b.err) AS repl,
 (SELECT min(b.ordinal) FROM ex b WHERE b.session_id = ex.session_id AND b.k = ex.k AND b.ordinal > ex.ordinal AND NOT b.err AND b.tool_name IN ('purchase', 'signup')) AS inval FROM ex LEFT JOIN ef ON ef.tool_name = ex.tool_name)
SELECT session_id, ordinal, CASE WHEN effect IS NULL THEN 'uncertain' WHEN receipt THEN 'live_critical' WHEN err AND retry IS NULL THEN 'live_critical' WHEN err THEN 'safe_to_evict' WHEN snapshot = 'complete' AND repl IS NOT NULL THEN 'safe_to_evict' WHEN inval IS NOT NULL THEN 'safe_to_evict' ELSE 'live_noncritical' END AS disposition,
CASE WHEN effect IS NULL THEN 'unknown' WHEN receipt THEN 'audit_required' WHEN err AND retry IS NULL THEN 'active' WHEN err THEN 'resolved' WHEN snapshot = 'complete' AND repl IS NOT NULL THEN 'superseded' WHEN inval IS NOT NULL THEN 'invalidated' ELSE 'active' END AS reason,
CASE WHEN effect IS NULL OR receipt THEN NULL WHEN err THEN retry WHEN snapshot = 'complete' AND repl IS NOT NULL THEN repl ELSE inval END AS target FROM m""",
)
def lifecycle_machine(t):
    ex = event_exchanges(t("events")).withColumn("entity", F.col("k"))
    effects = ex.sparkSession.createDataFrame(EFFECTS, "tool_name string, effect string, snapshot string, receipt boolean")
    return decisions.lifecycle_machine(ex.select("session_id", "ordinal", "tool_name", "entity", "err"), effects)


@R.add(
    "relation_dispositions",
    f"""WITH {GRAPH}, i AS (SELECT *, CASE WHEN side_effect THEN 'audit_required' WHEN validity = 'superseded' THEN 'superseded' WHEN validity = 'negative_resolved' THEN 'resolved' WHEN validity = 'negative_unresolved' THEN 'active' ELSE 'unknown' END AS reason, CASE ordinal % 4 WHEN 0 THEN 'required' WHEN 1 THEN 'useful' WHEN 2 THEN 'not_needed' ELSE 'uncertain' END AS need, ordinal % 11 = 0 AS risky FROM life)
SELECT reason, need, risky, CASE WHEN reason = 'audit_required' THEN 'live_critical' WHEN risky OR reason = 'unknown' THEN 'uncertain' WHEN need = 'required' THEN 'live_critical' WHEN need = 'useful' THEN 'live_noncritical' WHEN need = 'not_needed' AND reason <> 'active' THEN 'safe_to_evict' ELSE 'uncertain' END AS disposition, count(*) AS n FROM i GROUP BY 1, 2, 3, 4""",
)
def relation_dispositions(t):
    reason = F.when(F.col("side_effect"), "audit_required").when(F.col("validity") == "superseded", "superseded").when(F.col("validity") == "negative_resolved", "resolved").when(F.col("validity") == "negative_unresolved", "active").otherwise("unknown")
    turn = F.col("ordinal") % 4
    need = F.when(turn == 0, "required").when(turn == 1, "useful").when(turn == 2, "not_needed").otherwise("uncertain")
    rows = _labelled(t).withColumns({"reason": reason, "need": need, "risky": F.col("ordinal") % 11 == 0})
    return rows.groupBy("reason", "need", "risky", decisions.relation_first(F.col("reason"), F.col("need"), F.lit(False), F.col("risky")).alias("disposition")).agg(F.count("*").alias("n"))


@R.add("consensus", "SELECT doc_id, quality = toxic AS agreed, CASE WHEN quality = toxic THEN CAST(quality AS VARCHAR) ELSE 'uncertain' END AS disposition FROM labels")
def consensus(t):
    k = t("labels")
    return decisions.consensus(k.select("doc_id", F.col("quality").alias("disposition")), k.select("doc_id", F.col("toxic").alias("disposition")), "doc_id", ["disposition"])


#: Turns shown whole, cut to 24 tokens, or left out; goals and constraints are never left out.
_TURNS = f"""{NODES},
pt AS (SELECT *, node_type IN ('goal', 'subgoal', 'constraint') AS guarded FROM n),
op AS (SELECT session_id, ordinal AS place, 'raw' AS name, token_count AS cost, 0::DOUBLE AS risk FROM pt
  UNION ALL SELECT session_id, ordinal, 'summary', CAST((strlen({cut(24)}) + 3) // 4 AS BIGINT), CASE WHEN guarded THEN 0.2 ELSE 0.05 END::DOUBLE FROM pt
  UNION ALL SELECT session_id, ordinal, 'omit', 0, 0.1::DOUBLE FROM pt WHERE NOT guarded)"""
#: Between what some conversations need at least and what others would take.
_BINDING = 96


def _turns(t):
    n = conversation_nodes(t("conversations"))
    guarded = F.col("node_type").isin("goal", "subgoal", "constraint")
    option = lambda name, cost, risk: F.struct(F.lit(name).alias("name"), cost.cast("bigint").alias("cost"), risk.cast("double").alias("risk"))
    short = estimate_tokens(truncated(F.col("content"), 24))
    options = F.filter(F.array(option("raw", F.col("token_count"), F.lit(0.0)), option("summary", short, F.when(guarded, 0.2).otherwise(0.05)), F.when(~guarded, option("omit", F.lit(0), F.lit(0.1)))), lambda x: x.isNotNull())
    return n.select("session_id", F.col("ordinal").alias("place"), options.alias("candidates"))


@R.add("compiled_context", f"WITH RECURSIVE {_TURNS}, {beam_sql()}, {chosen_sql((_BINDING,))}, {BACK} SELECT session_id, place, name AS choice, o.cost, o.risk, fits AS feasible FROM pk JOIN op o USING (session_id, place, name)")
def compiled_context(t):
    """Beam search over each conversation's turns: whole, cut, or left out at a risk that follows the turn's kind."""
    return compiler.compile_beam(_turns(t), _BINDING)


@R.add(
    "compiled_optimum",
    f"""WITH RECURSIVE {_TURNS}, {beam_sql()}, {chosen_sql((_BINDING,))},
oi AS (SELECT *, CAST(round(risk * 1000000) AS BIGINT) AS micro FROM op),
dp AS (SELECT DISTINCT session_id, 0::BIGINT AS place, 0::BIGINT AS cost, 0::BIGINT AS micro FROM oi
  UNION ALL SELECT session_id, place, cost, CAST(min(micro) AS BIGINT) FROM (SELECT d.session_id, d.place + 1 AS place, d.cost + o.cost AS cost, d.micro + o.micro AS micro FROM dp d JOIN oi o ON o.session_id = d.session_id AND o.place = d.place + 1 WHERE d.cost + o.cost <= {_BINDING}) GROUP BY session_id, place, cost),
ls AS (SELECT session_id, max(place) AS place FROM oi GROUP BY session_id),
ft AS (SELECT d.session_id, d.cost, d.micro FROM dp d JOIN ls USING (session_id, place) QUALIFY row_number() OVER (PARTITION BY d.session_id ORDER BY d.cost * 1000000 + 512 * d.micro, d.cost) = 1),
fb AS (SELECT session_id, CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(micro) AS BIGINT) AS micro FROM (SELECT * FROM oi QUALIFY row_number() OVER (PARTITION BY session_id, place ORDER BY micro, cost, name) = 1) GROUP BY session_id)
SELECT session_id, ft.session_id IS NOT NULL AS feasible, coalesce(ft.cost, fb.cost) AS cost, coalesce(ft.micro, fb.micro) AS risk_millionths, ch.fits AS beam_feasible, ch.cost AS beam_cost, CASE WHEN ch.fits THEN ch.cost * 1000000 + 512 * CAST(round(ch.risk * 1000000) AS BIGINT) - ft.cost * 1000000 - 512 * ft.micro END AS regret
FROM fb LEFT JOIN ft USING (session_id) JOIN ch USING (session_id)""",
)
def compiled_optimum(t):
    """The best of all choices that fit, by dynamic programming, and what the beam loses against it (in millionths); both fall back alike."""
    turns = _turns(t)
    micro = F.round(F.col("risk") * 1e6).cast("bigint")
    totals = lambda df: df.groupBy("session_id").agg(F.min("feasible").alias("feasible"), F.sum("cost").alias("cost"), F.sum(micro).alias("micro"))
    beam = totals(compiler.compile_beam(turns, _BINDING)).select("session_id", F.col("feasible").alias("beam_feasible"), F.col("cost").alias("beam_cost"), F.col("micro").alias("beam_micro"))
    value = lambda cost, risk: F.col(cost) * 1_000_000 + F.col(risk) * 512
    both = totals(compiler.compile_exact(turns, _BINDING)).join(beam, "session_id")
    return both.select("session_id", "feasible", "cost", F.col("micro").alias("risk_millionths"), "beam_feasible", "beam_cost", F.when(F.col("beam_feasible"), value("beam_cost", "beam_micro") - value("cost", "micro")).alias("regret"))


@R.add(
    "card_ladder",
    f"""WITH RECURSIVE {EX}, c AS (SELECT session_id, k, count(*) AS chain, max(ordinal) AS last FROM ex WHERE err GROUP BY session_id, k), p AS (SELECT *, 20 + 5 * chain AS full_cost, 8 + chain AS compact_cost, row_number() OVER (PARTITION BY session_id ORDER BY last DESC) AS place FROM c),
f AS (SELECT session_id, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS used, '' AS form FROM p GROUP BY session_id
UNION ALL SELECT p.session_id, p.place, CAST(CASE WHEN 64 - used <= 0 THEN used WHEN full_cost <= 64 - used THEN used + full_cost WHEN compact_cost <= 64 - used THEN used + compact_cost ELSE 64 END AS BIGINT),
CASE WHEN 64 - used <= 0 THEN 'none' WHEN full_cost <= 64 - used THEN 'full' WHEN compact_cost <= 64 - used THEN 'compact' ELSE 'minimal' END FROM f JOIN p ON p.session_id = f.session_id AND p.place = f.place + 1)
SELECT f.session_id, p.k, f.form FROM f JOIN p USING (session_id, place)""",
)
def card_ladder(t):
    """Cards of each session, newest first, in 64 tokens."""
    cards = event_exchanges(t("events")).where("err").groupBy("session_id", "k").agg(F.count("*").alias("chain"), F.max("ordinal").alias("last"))
    costs = cards.withColumns({"full": 20 + 5 * F.col("chain"), "compact": 8 + F.col("chain")})
    return decisions.form_ladder(costs, [F.col("last").desc()], 64).select("session_id", "k", "form")


@R.add(
    "fork_harm",
    f"""WITH {EX}, r AS (SELECT session_id AS prefix_id, (ordinal - 1) // 3 + 1 AS replicate, CASE (ordinal - 1) % 3 WHEN 0 THEN 'raw_message' WHEN 1 THEN 'compiled' ELSE 'drop' END AS treatment, err AS harm, 100 + k AS tokens FROM ex),
w AS (SELECT prefix_id, replicate, bool_or(harm) FILTER (treatment = 'raw_message') AS rh, bool_or(harm) FILTER (treatment = 'compiled') AS ch, bool_or(harm) FILTER (treatment = 'drop') AS dh, max(tokens) FILTER (treatment = 'raw_message') AS rt, max(tokens) FILTER (treatment = 'compiled') AS ct FROM r GROUP BY prefix_id, replicate)
SELECT prefix_id, replicate, rh IS NOT NULL AND ch IS NOT NULL AND dh IS NOT NULL AS complete, coalesce(ch AND NOT rh AND dh IS NOT NULL, false) AS unique_harm, coalesce(ch <> dh AND rh IS NOT NULL, false) AS discordant, CASE WHEN rh IS NOT NULL AND ch IS NOT NULL AND dh IS NOT NULL THEN round((rt - ct) / rt::DOUBLE, 9) END AS reduction FROM w""",
)
def fork_harm(t):
    turn = (F.col("ordinal") - 1) % 3
    rows = event_exchanges(t("events")).select(F.col("session_id").alias("prefix_id"), (F.floor((F.col("ordinal") - 1) / 3) + 1).alias("replicate"), F.when(turn == 0, "raw_message").when(turn == 1, "compiled").otherwise("drop").alias("treatment"), F.col("err").alias("harm"), (F.col("k") + 100).alias("tokens"))
    return decisions.fork_harm(rows).withColumn("reduction", F.round("reduction", 9))


@R.add("cost_attribution", f"WITH {NODES}, c AS (SELECT session_id, sum(token_count) AS total, sum(CASE WHEN node_type = 'constraint' THEN token_count ELSE 0 END) AS policy, sum(CASE WHEN node_type IN ('goal', 'subgoal') THEN token_count ELSE 0 END) AS users, sum(CASE WHEN node_type = 'decision' THEN token_count ELSE 0 END) AS state FROM n GROUP BY session_id) SELECT session_id AS conv_id, CAST(total AS BIGINT) AS total, CAST(policy AS BIGINT) AS policy, CAST(users AS BIGINT) AS users, CAST(state AS BIGINT) AS state, CAST(floor(0.7 * total) AS BIGINT) AS target, policy + users <= floor(0.7 * total) AS reachable FROM c")
def cost_attribution(t):
    """What each component adds to a conversation's cost, and whether its fixed part leaves room for a cut by three tenths."""
    of = lambda *kinds: F.sum(F.when(F.col("node_type").isin(*kinds), F.col("token_count")).otherwise(0))
    c = conversation_nodes(t("conversations")).groupBy(F.col("session_id").alias("conv_id")).agg(F.sum("token_count").alias("total"), of("constraint").alias("policy"), of("goal", "subgoal").alias("users"), of("decision").alias("state"))
    target = F.floor(F.lit(7).cast("decimal(2,0)") * F.col("total") / 10).cast("bigint")
    return c.withColumn("target", target).withColumn("reachable", F.col("policy") + F.col("users") <= F.col("target"))


@R.add("eligibility", f"WITH {EX}, d AS (SELECT k % 4 AS domain, count(DISTINCT k) AS tasks, count(*) FILTER (err) AS failures, count(*) FILTER (side_effect) AS actions, CASE WHEN count(value) = count(*) THEN median(value) END AS median_value FROM ex GROUP BY 1) SELECT domain, tasks, failures, actions, round(median_value, 6) AS median_value, tasks >= 20 AND failures >= 30 AND actions >= 30 AND median_value IS NOT NULL AS eligible FROM d")
def eligibility(t):
    """A median over a column with a gap is none: missing evidence is not eligible."""
    ex = event_exchanges(t("events")).withColumn("domain", F.col("k") % 4)
    n = lambda c: F.sum(c.cast("bigint"))
    d = ex.groupBy("domain").agg(F.countDistinct("k").alias("tasks"), n(F.col("err")).alias("failures"), n(F.col("side_effect")).alias("actions"), F.round(F.when(F.count("value") == F.count("*"), F.median("value")), 6).alias("median_value"))
    return d.withColumn("eligible", (F.col("tasks") >= 20) & (F.col("failures") >= 30) & (F.col("actions") >= 30) & F.col("median_value").isNotNull())


@R.add("positional_zip", "WITH a AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place, lang FROM documents), b AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END AS lang, row_number() OVER (PARTITION BY page_id % 4 ORDER BY page_id) AS place FROM pages) SELECT lang, place, doc_id, page_id FROM a JOIN b USING (lang, place)")
def positional_zip(t):
    """The i-th document with the i-th page of the same language: places are global, less what comes before a language."""
    turn = F.col("page_id") % 4
    pages = t("pages").select("page_id", F.when(turn == 0, "en").when(turn == 1, "de").when(turn == 2, "fr").otherwise("es").alias("lang"))

    def placed(rows, key):
        rows = numbered(rows, "lang", key)
        first = rows.groupBy("lang").agg(F.min("place").alias("first"))
        return rows.join(F.broadcast(first), "lang").withColumn("place", F.col("place") - F.col("first") + 1).drop("first")  # some languages

    return placed(t("documents").select("lang", "doc_id"), "doc_id").join(placed(pages, "page_id"), ["lang", "place"])


@R.add("fork_plan", "WITH p AS (SELECT DISTINCT conv_id FROM conversations), q AS (SELECT conv_id, row_number() OVER (ORDER BY sha256(concat('plan', chr(0), conv_id)), conv_id) AS place FROM p), x AS (SELECT conv_id, place FROM q WHERE place <= 10) SELECT conv_id, t.treatment, r.replicate, concat('fork_', substr(sha256(concat_ws(chr(31), conv_id, t.treatment, r.replicate)), 1, 24)) AS fork_id FROM x, (SELECT unnest(['raw_message', 'compiled', 'drop']) AS treatment) t, (SELECT unnest([1, 2]) AS replicate) r")
def fork_plan(t):
    """Two replicates of each treatment for ten conversations: the cap is the plan's."""
    from braidline.functions.identity import stable_id

    ranked = t("conversations").select("conv_id").distinct().withColumn("rank", F.sha2(F.concat(F.lit("plan\0"), F.col("conv_id").cast("string")), 256))
    ten = ranked.orderBy("rank", "conv_id").limit(10).select("conv_id")
    runs = ten.withColumn("treatment", F.explode(F.array(*[F.lit(x) for x in ("raw_message", "compiled", "drop")]))).withColumn("replicate", F.explode(F.array(F.lit(1), F.lit(2))))
    return runs.withColumn("fork_id", stable_id("fork", F.col("conv_id"), F.col("treatment"), F.col("replicate")))


@R.add(
    "state_closure",
    f"""WITH RECURSIVE {GRAPH}, root AS (SELECT session_id, concat(session_id, ':', max(ordinal), ':r') AS start FROM ex GROUP BY session_id),
ln AS (SELECT session_id, target AS a, source AS b FROM edges WHERE edge_type IN ('retried_by', 'produces', 'failed_with') UNION SELECT session_id, source, target FROM edges WHERE edge_type = 'superseded_by'),
re AS (SELECT session_id, start AS node FROM root UNION SELECT re.session_id, ln.b FROM re JOIN ln ON ln.session_id = re.session_id AND ln.a = re.node)
SELECT session_id, count(*) AS live FROM re GROUP BY session_id""",
)
def state_closure(t):
    """What the latest result of each session depends on: dependencies are followed backwards, and who is superseded brings its superseder."""
    ex = event_exchanges(t("events"))
    e = exchange_edges(ex)
    back = e.where(F.col("edge_type").isin("retried_by", "produces", "failed_with")).select("session_id", F.col("target").alias("source"), F.col("source").alias("target"))
    links = back.union(e.where("edge_type = 'superseded_by'").select("session_id", "source", "target"))
    roots = ex.groupBy("session_id").agg(F.max("ordinal").alias("o")).select("session_id", F.concat_ws(":", "session_id", "o", F.lit("r")).alias("start"))
    return graph.reachable(links, roots).groupBy("session_id").agg(F.count("*").alias("live"))
