"""Queries over conversations: censuses, selection policies, budgets, prefixes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from braidline.functions.text import estimate_tokens, truncated
from braidline.operators import context
from braidline.operators.stats import nearest_rank
from braidline.plans.registry import Registry
from braidline.sources.adapters import conversation_nodes

R = Registry()
BUDGET = 512

#: The nodes of conversations in SQL.
NODES = """
n AS (SELECT conv_id AS session_id, turn + 1 AS ordinal, concat(conv_id, ':', turn + 1) AS node_id, text AS content,
      CASE role WHEN 'system' THEN 'constraint' WHEN 'user' THEN CASE WHEN sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 'goal' ELSE 'subgoal' END ELSE 'decision' END AS node_type,
      CAST((strlen(text) + 3) // 4 AS BIGINT) AS token_count,
      role = 'assistant' AND turn = max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS final FROM conversations)"""


def cut(tokens: int) -> str:
    most = max(16, 4 * tokens)
    return f"CASE WHEN length(content) > {most} THEN concat(substr(content, 1, {most - 1}), '…') ELSE content END"


def fold(source: str, order: str, cost: str, budget: int | None, must: str = "false") -> str:
    """CTEs r (rows in order, with cost and must) and v (kept): the greedy fold as a recursion over places."""
    if budget is None:
        return f"v AS (SELECT *, {cost} AS cost, true AS kept FROM {source})"
    return f"""
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {order}) AS place, CAST({cost} AS BIGINT) AS cost, {must} AS must FROM {source}),
f AS (SELECT session_id, CAST(0 AS BIGINT) AS place, CAST(sum(CASE WHEN must THEN cost ELSE 0 END) AS BIGINT) AS total, false AS kept FROM r GROUP BY session_id
      UNION ALL SELECT r.session_id, r.place, CASE WHEN NOT r.must AND f.total + r.cost <= {budget} THEN f.total + r.cost ELSE f.total END, r.must OR f.total + r.cost <= {budget}
      FROM f JOIN r ON r.session_id = f.session_id AND r.place = f.place + 1),
v AS (SELECT r.*, f.kept FROM r JOIN f USING (session_id, place))"""


METRICS = """sum(token_count) AS original_tokens, sum(CASE WHEN kept THEN cost ELSE 0 END) AS selected_tokens, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped,
CASE WHEN sum(token_count) <= 0 THEN 0 ELSE greatest(0, 1 - sum(CASE WHEN kept THEN cost ELSE 0 END) / sum(token_count)::DOUBLE) END AS ratio,
count(*) FILTER (node_type = 'constraint') AS cons, count(*) FILTER (node_type = 'constraint' AND kept AND {stands}) AS cov"""


def metrics_sql(with_: str, source: str = "v", stands: str = "true", extra: str = "") -> str:
    return f"""WITH RECURSIVE {with_}, m AS (SELECT session_id, {METRICS.format(stands=stands)} FROM {source} GROUP BY session_id)
SELECT session_id AS conv_id, CAST(original_tokens AS BIGINT) AS original_tokens, CAST(selected_tokens AS BIGINT) AS selected_tokens, kept, dropped, round(ratio, 9) AS compression_ratio,
       round(CASE WHEN cons = 0 THEN 1 ELSE cov / cons::DOUBLE END, 9) AS constraint_retention{extra} FROM m"""


def measured(view):
    m = context.view_metrics(view)
    return m.select(F.col("session_id").alias("conv_id"), "original_tokens", "selected_tokens", "kept", "dropped", F.round("compression_ratio", 9).alias("compression_ratio"), F.round("constraint_retention", 9).alias("constraint_retention"))


@R.add("node_census", f"WITH {NODES} SELECT node_type, count(*) AS n, CAST(sum(token_count) AS BIGINT) AS tokens, count(*) FILTER (final) AS finals FROM n GROUP BY node_type")
def node_census(t):
    n = conversation_nodes(t("conversations"))
    return n.groupBy("node_type").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"), F.sum(F.col("final").cast("bigint")).alias("finals"))


@R.add(
    "token_census",
    " UNION ALL ".join(f"SELECT '{x}' AS source, count(*) AS n, CAST(sum((strlen({c}) + 3) // 4) AS BIGINT) AS tokens, CAST(max((strlen({c}) + 3) // 4) AS BIGINT) AS longest FROM {x}" for x, c in (("conversations", "text"), ("documents", "text"), ("benchmark", "text"), ("pages", "html"))),
)
def token_census(t):
    out = None
    for x, c in (("conversations", "text"), ("documents", "text"), ("benchmark", "text"), ("pages", "html")):
        size = estimate_tokens(F.col(c))
        part = t(x).agg(F.lit(x).alias("source"), F.count("*").alias("n"), F.sum(size).alias("tokens"), F.max(size).alias("longest"))
        out = part if out is None else out.union(part)
    return out


def _policy(name: str, policy: str, with_: str, stands: str = "true", budget: int | None = BUDGET) -> None:
    @R.add(name, metrics_sql(f"{NODES}, {with_}", stands=stands))
    def query(t):
        return measured(context.POLICIES[policy](conversation_nodes(t("conversations")), budget))


_policy("policy_full", "full_trajectory", "v AS (SELECT *, token_count AS cost, true AS kept FROM n)")
_policy("policy_last_k", "last_k", "v AS (SELECT *, token_count AS cost, row_number() OVER (PARTITION BY session_id ORDER BY ordinal DESC) <= 8 AS kept FROM n)")
_policy("policy_newest_budget", "token_length_pruning", fold("n", "ordinal DESC", "token_count", BUDGET))
_policy("policy_oldest_summary", "summary_only", fold("n", "ordinal", f"(strlen({cut(24)}) + 3) // 4", 128), "false", 128)
_policy("policy_truncated_oldest", "acon_style", fold("n", "ordinal", "token_count", BUDGET))
SCORED = "s AS (SELECT *, ordinal / greatest(1, max(ordinal) OVER (PARTITION BY session_id))::DOUBLE + CASE WHEN node_type IN ('constraint', 'decision') THEN 1.0 ELSE 0.0 END AS score FROM n)"
_policy("policy_score_rank", "llm_only_pruning", f"{SCORED}, {fold('s', 'score DESC, ordinal', 'token_count', BUDGET)}")
MUST = "node_type IN ('goal', 'constraint') OR node_type = 'subgoal' AND ordinal = max(CASE WHEN node_type = 'subgoal' THEN ordinal END) OVER (PARTITION BY session_id)"
_policy("policy_full_ours", "full_ours", f"h AS (SELECT *, coalesce({MUST}, false) AS hard FROM n), {fold('h', 'ordinal DESC', 'token_count', BUDGET, 'hard')}")
_policy("policy_without_constraints", "ours_without_constraint_retention", f"h AS (SELECT *, coalesce({MUST.replace(chr(39) + 'goal' + chr(39) + ', ' + chr(39) + 'constraint' + chr(39), chr(39) + 'goal' + chr(39))}, false) AS hard FROM n), {fold('h', 'ordinal DESC', 'token_count', BUDGET, 'hard')}")
_policy("policy_raw_hard", "raw_hard_failure_retention", f"h AS (SELECT *, node_type IN ('goal', 'subgoal', 'constraint') OR final AS hard FROM n), {fold('h', 'ordinal DESC', 'token_count', BUDGET, 'hard')}")


@R.add(
    "policy_dedup_newest",
    metrics_sql(
        f"""{NODES}, c AS (SELECT *, row_number() OVER (PARTITION BY session_id, content ORDER BY ordinal DESC) = 1 AS cand FROM n), k AS (SELECT * FROM c WHERE cand), {fold('k', 'ordinal DESC', 'token_count', BUDGET)},
a AS (SELECT session_id, node_type, token_count, cost, kept FROM v UNION ALL SELECT session_id, node_type, token_count, token_count, false FROM c WHERE NOT cand)""",
        "a",
    ),
)
def policy_dedup_newest(t):
    return measured(context.nonredundant(conversation_nodes(t("conversations")), BUDGET))


@R.add("policy_kept_nodes", f"WITH RECURSIVE {NODES}, {fold('n', 'ordinal DESC', 'token_count', BUDGET)} SELECT session_id AS conv_id, ordinal, node_type, token_count, kept FROM v")
def policy_kept_nodes(t):
    return context.newest_first(conversation_nodes(t("conversations")), BUDGET).select(F.col("session_id").alias("conv_id"), "ordinal", "node_type", "token_count", "kept")


SWEEP = (256, 512, 768, 1024, 2048)


def _matrix(nodes, budgets=(256, 512)):
    """Four policies under each budget as columns over one sort of the nodes, then a row for each."""
    last = F.max(F.when(F.col("node_type") == "subgoal", F.struct("step_id", "node_id"))).over(context.by_session())["node_id"]
    hard = F.col("node_type").isin("goal", "constraint") | (F.col("node_type") == "subgoal") & (F.col("node_id") == last)
    marked = nodes.withColumn("hard", F.coalesce(hard, F.lit(False)))
    plans = {f"{name}_{b}": (b, must) for b in budgets for name, must in (("newest", None), ("ours", F.col("hard")))}
    rows = context.greedy_many(marked, [F.col("step_id").desc(), F.col("node_id")], F.col("token_count"), plans)
    kept = {(policy, b): c for b in budgets for policy, c in (("full_trajectory", F.lit(True)), ("last_k", F.col("place") <= 8), ("token_length_pruning", F.col(f"kept_newest_{b}")), ("full_ours", F.col(f"kept_ours_{b}")))}
    constraint = F.col("node_type") == "constraint"
    sums = rows.groupBy("session_id").agg(
        F.sum("token_count").alias("original_tokens"),
        F.sum(constraint.cast("bigint")).alias("constraints"),
        *[x for i, c in enumerate(kept.values()) for x in (F.sum(F.when(c, F.col("cost")).otherwise(0)).alias(f"s{i}"), F.sum((c & constraint).cast("bigint")).alias(f"c{i}"))],
    )
    each = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(b).alias("budget"), F.col(f"s{i}").alias("selected_tokens"), F.col(f"c{i}").alias("covered")) for i, (p, b) in enumerate(kept)])
    long = sums.select("session_id", "original_tokens", "constraints", F.explode(each).alias("e")).select("session_id", "original_tokens", "constraints", "e.*")
    ratio = F.when(F.col("original_tokens") <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("selected_tokens") / F.col("original_tokens")))
    return long.withColumns({"compression_ratio": ratio, "constraint_retention": F.when(F.col("constraints") == 0, 1.0).otherwise(F.col("covered") / F.col("constraints"))})


def _matrix_sql() -> str:
    parts, ctes = [], [NODES, f"h AS (SELECT *, coalesce({MUST}, false) AS hard FROM n)"]
    rename = lambda x, i: x.replace("\nr AS", f"\nr{i} AS").replace("\nf AS", f"\nf{i} AS").replace("\nv AS", f"\nv{i} AS").replace("FROM r JOIN f ", f"FROM r{i} AS r JOIN f{i} AS f ").replace("FROM r GROUP", f"FROM r{i} GROUP").replace("FROM f JOIN r ", f"FROM f{i} AS f JOIN r{i} AS r ")
    i = 0
    for budget in (256, 512):
        for name, source, order, must in (("token_length_pruning", "n", "ordinal DESC", "false"), ("full_ours", "h", "ordinal DESC", "hard")):
            i += 1
            ctes.append(rename(fold(source, order, "token_count", budget, must), i))
            parts.append(f"SELECT '{name}' AS policy, {budget} AS budget, session_id, node_type, token_count, cost, kept FROM v{i}")
        parts.append(f"SELECT 'full_trajectory', {budget}, session_id, node_type, token_count, token_count, true FROM n")
        parts.append(f"SELECT 'last_k', {budget}, session_id, node_type, token_count, token_count, row_number() OVER (PARTITION BY session_id ORDER BY ordinal DESC) <= 8 FROM n")
    return f"""WITH RECURSIVE {', '.join(ctes)}, a AS ({' UNION ALL '.join(parts)}), m AS (SELECT policy, budget, session_id, {METRICS.format(stands='true')} FROM a GROUP BY policy, budget, session_id)
SELECT policy, budget, count(*) AS sessions, round(avg(selected_tokens::DOUBLE), 6) AS mean_tokens, round(CASE WHEN count(*) > 1 THEN stddev_samp(selected_tokens::DOUBLE) ELSE 0 END, 6) AS std_tokens,
       round(avg(ratio), 6) AS mean_compression, round(avg(CASE WHEN cons = 0 THEN 1 ELSE cov / cons::DOUBLE END), 6) AS mean_constraints FROM m GROUP BY policy, budget"""


@R.add("policy_matrix_metrics", _matrix_sql())
def policy_matrix_metrics(t):
    spread = F.when(F.count("*") > 1, F.stddev_samp("selected_tokens")).otherwise(0.0)
    return (
        _matrix(conversation_nodes(t("conversations")))
        .groupBy("policy", "budget")
        .agg(F.count("*").alias("sessions"), F.round(F.avg("selected_tokens"), 6).alias("mean_tokens"), F.round(spread, 6).alias("std_tokens"), F.round(F.avg("compression_ratio"), 6).alias("mean_compression"), F.round(F.avg("constraint_retention"), 6).alias("mean_constraints"))
    )


def _sweep(nodes):
    """Mandatory tokens of each session against each budget of the sweep: five budgets, so five rows a session."""
    last = F.max(F.when(F.col("node_type") == "subgoal", F.col("ordinal"))).over(context.by_session())
    must = F.col("node_type").isin("goal", "constraint") | (F.col("node_type") == "subgoal") & (F.col("ordinal") == last)
    per = nodes.withColumn("must", F.coalesce(must, F.lit(False))).groupBy("session_id").agg(F.sum(F.when(F.col("must"), F.col("token_count")).otherwise(0)).alias("mandatory"))
    return per.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in SWEEP])))


SWEEP_SQL = f"""{NODES}, p AS (SELECT session_id, sum(CASE WHEN hard THEN token_count ELSE 0 END) AS mandatory FROM (SELECT *, coalesce({MUST}, false) AS hard FROM n) GROUP BY session_id),
s AS (SELECT budget, count(*) AS sessions, CAST(min(mandatory) AS BIGINT) AS minimum, CAST(median(mandatory) AS DOUBLE) AS median, CAST(quantile_disc(mandatory, 0.95) AS BIGINT) AS p95, CAST(max(mandatory) AS BIGINT) AS maximum,
      count(*) FILTER (mandatory > budget) AS overflows FROM p, (SELECT unnest([{', '.join(map(str, SWEEP))}]) AS budget) GROUP BY budget)"""


def _summary(nodes):
    s = _sweep(nodes).groupBy("budget").agg(F.count("*").alias("sessions"), F.min("mandatory").alias("minimum"), F.median("mandatory").alias("median"), F.expr("percentile_disc(0.95) within group (order by mandatory)").cast("bigint").alias("p95"), F.max("mandatory").alias("maximum"), F.sum((F.col("mandatory") > F.col("budget")).cast("bigint")).alias("overflows"))
    return s.withColumn("feasible", F.col("overflows") <= 0.34 * F.col("sessions"))


@R.add("budget_sweep", f"WITH {SWEEP_SQL} SELECT *, overflows <= 0.34 * sessions AS feasible FROM s")
def budget_sweep(t):
    return _summary(conversation_nodes(t("conversations")))


@R.add("choose_budget", f"WITH {SWEEP_SQL} SELECT min(CASE WHEN overflows <= 0.34 * sessions THEN budget END) AS budget FROM s")
def choose_budget(t):
    return _summary(conversation_nodes(t("conversations"))).agg(F.min(F.when(F.col("feasible"), F.col("budget"))).alias("budget"))


@R.add("prefix_replay", f"WITH {NODES}, p AS (SELECT a.session_id, a.ordinal AS cutoff, b.* EXCLUDE (session_id), row_number() OVER (PARTITION BY a.session_id, a.ordinal ORDER BY b.ordinal DESC) AS place FROM n a JOIN n b ON a.session_id = b.session_id AND b.ordinal <= a.ordinal) SELECT session_id AS conv_id, cutoff, count(*) AS visible, CAST(sum(token_count) AS BIGINT) AS original_tokens, CAST(sum(CASE WHEN place <= 8 THEN token_count ELSE 0 END) AS BIGINT) AS selected_tokens FROM p GROUP BY session_id, cutoff")
def prefix_replay(t):
    """Every step of every session under the last-k policy. Cumulative frames say it without a row for each pair."""
    n = conversation_nodes(t("conversations"))
    upto = context.by_session().orderBy("ordinal")
    return n.select(F.col("session_id").alias("conv_id"), F.col("ordinal").alias("cutoff"), F.count("*").over(upto).alias("visible"), F.sum("token_count").over(upto).alias("original_tokens"), F.sum("token_count").over(upto.rowsBetween(-7, 0)).alias("selected_tokens"))


@R.add("decision_points", f"WITH {NODES} SELECT d.session_id AS conv_id, d.ordinal AS decision_ordinal, count(b.node_id) AS visible, CAST(coalesce(sum(b.token_count), 0) AS BIGINT) AS tokens, count(b.node_id) FILTER (b.node_type = 'constraint') AS constraints, count(b.node_id) FILTER (b.node_type IN ('goal', 'subgoal')) AS goals FROM n d LEFT JOIN n b ON b.session_id = d.session_id AND b.ordinal < d.ordinal WHERE d.node_type = 'decision' GROUP BY d.session_id, d.ordinal")
def decision_points(t):
    """What each decision could see, itself excluded."""
    n = conversation_nodes(t("conversations"))
    before = context.by_session().orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.sum(c.cast("bigint")).over(before)
    rows = n.withColumns({"visible": F.count("*").over(before), "tokens": F.coalesce(F.sum("token_count").over(before), F.lit(0)), "constraints": F.coalesce(count(F.col("node_type") == "constraint"), F.lit(0)), "goals": F.coalesce(count(F.col("node_type").isin("goal", "subgoal")), F.lit(0))})
    return rows.where("node_type = 'decision'").select(F.col("session_id").alias("conv_id"), F.col("ordinal").alias("decision_ordinal"), "visible", "tokens", "constraints", "goals")


@R.add("current_goal", f"WITH {NODES} SELECT session_id AS conv_id, max(CASE WHEN node_type = 'goal' THEN ordinal END) AS goal, max(CASE WHEN node_type = 'subgoal' THEN ordinal END) AS subgoal, count(*) FILTER (node_type IN ('goal', 'subgoal')) AS user_turns, max(CASE WHEN final THEN ordinal END) AS final_decision FROM n GROUP BY session_id")
def current_goal(t):
    n = conversation_nodes(t("conversations"))
    of = lambda kind: F.max(F.when(F.col("node_type") == kind, F.col("ordinal")))
    return n.groupBy(F.col("session_id").alias("conv_id")).agg(of("goal").alias("goal"), of("subgoal").alias("subgoal"), F.sum(F.col("node_type").isin("goal", "subgoal").cast("bigint")).alias("user_turns"), F.max(F.when(F.col("final"), F.col("ordinal"))).alias("final_decision"))


@R.add("oracle_tokens", f"WITH {NODES} SELECT session_id AS conv_id, CAST(sum(token_count) AS BIGINT) AS original_tokens, CAST(sum(CASE WHEN node_type IN ('goal', 'subgoal', 'constraint') THEN token_count ELSE 0 END) AS BIGINT) AS mandatory_tokens FROM n GROUP BY session_id")
def oracle_tokens(t):
    """The least context that loses nothing: what may not be removed."""
    n = conversation_nodes(t("conversations"))
    return n.groupBy(F.col("session_id").alias("conv_id")).agg(F.sum("token_count").alias("original_tokens"), F.sum(F.when(F.col("node_type").isin("goal", "subgoal", "constraint"), F.col("token_count")).otherwise(0)).alias("mandatory_tokens"))


@R.add("truncated_documents", f"SELECT doc_id, length({cut(24).replace('content', 'text')}) AS chars, CAST((strlen({cut(24).replace('content', 'text')}) + 3) // 4 AS BIGINT) AS tokens FROM documents")
def truncated_documents(t):
    short = truncated(F.col("text"), 24)
    return t("documents").select("doc_id", F.char_length(short).cast("bigint").alias("chars"), estimate_tokens(short).alias("tokens"))


@R.add("nearest_rank", f"WITH {NODES} SELECT node_type, quantile_disc(token_count, 0.5) AS p50, quantile_disc(token_count, 0.95) AS p95, quantile_disc(token_count, 0.99) AS p99 FROM n GROUP BY node_type")
def ranks(t):
    return nearest_rank(conversation_nodes(t("conversations")), ["node_type"], "token_count", [0.5, 0.95, 0.99])
