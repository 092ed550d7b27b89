"""Queries over runs made of events: rewards, conditions, pairs, alignment, cost layers, attribution and the named gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from braidline.functions.text import estimate_tokens
from braidline.operators import annotation, gates, runs, stats
from braidline.plans.exchanges import EX
from braidline.plans.registry import Registry
from braidline.scratch import table
from braidline.sources.adapters import event_exchanges

R = Registry()
CONDITIONS = ("full_trajectory", "last_k", "full_ours")

#: Runs in SQL: one for each (session, key); the condition follows from the session, the rest from the exchanges.
RUNS = f"""{EX},
r0 AS (SELECT session_id, k, count(*) AS calls, count(*) FILTER (err) AS errors, count(*) FILTER (prev_err) AS retries, count(*) FILTER (prev_err AND err) AS repeats, max_by(err, ordinal) AS last_err, max_by(tool_name, ordinal) AS last_tool, min(CASE WHEN prev_err AND NOT err THEN ordinal - prev_ordinal END) AS recovery, max_by(event_id, ordinal) AS event_id, CAST(sum(floor(value)) AS BIGINT) AS cost, count(*) FILTER (side_effect) AS acts FROM ex GROUP BY session_id, k),
rn AS (SELECT k % 4 AS domain, k AS task, session_id // 3 AS trial, CASE session_id % 3 WHEN 0 THEN 'full_trajectory' WHEN 1 THEN 'last_k' ELSE 'full_ours' END AS condition, CASE WHEN last_err THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS reward,
  CASE WHEN event_id % 19 = 0 THEN 'timeout' WHEN event_id % 23 = 0 THEN 'infrastructure_error' WHEN last_tool = 'view' THEN 'max_steps' ELSE 'user_stop' END AS termination, calls AS tool_calls, CASE WHEN event_id % 7 <> 0 THEN 100 * calls + cost END AS provider_input_tokens, CASE WHEN event_id % 7 <> 0 THEN calls END AS generation_calls, CASE WHEN event_id % 5 <> 0 THEN 10 * calls END AS provider_output_tokens,
  40 * calls + k AS trajectory_tokens, CASE WHEN event_id % 11 <> 0 THEN 20 * calls + k END AS selected_tokens, recovery AS recovery_steps, repeats AS repeated_invalid_actions, retries AS repeated_failed_actions, errors AS failure_card_turns, CASE WHEN calls > 2 THEN 1 ELSE 0 END AS budget_infeasible_turns, CASE WHEN errors > 1 THEN 1 ELSE 0 END AS raw_failures_selected, cost AS cost_usd, event_id, acts, errors FROM r0),
rj AS (SELECT *, reward = 1 AS success, termination IN ('user_stop', 'agent_stop') AS normal_stop, termination IN ('infrastructure_error', 'timeout') AS infra FROM rn)"""


def run_rows(t):
    ex = event_exchanges(t("events"))
    again = F.coalesce("prev_err", F.lit(False))
    n = lambda c: F.sum(c.cast("bigint"))
    last = lambda c: F.max_by(c, "ordinal")
    r = ex.groupBy("session_id", "k").agg(F.count("*").alias("calls"), n(F.col("err")).alias("errors"), n(again).alias("retries"), n(again & F.col("err")).alias("repeats"), last("err").alias("last_err"), last("tool_name").alias("last_tool"), F.min(F.when(again & ~F.col("err"), F.col("ordinal") - F.col("prev_ordinal"))).alias("recovery"), last("event_id").alias("event_id"), F.sum(F.floor("value")).cast("bigint").alias("cost"), n(F.col("side_effect")).alias("acts"))
    e, s = F.col("event_id"), F.col("session_id") % 3
    calls = F.col("calls")
    none = F.lit(None).cast("double")
    rows = r.select(
        (F.col("k") % 4).alias("domain"),
        F.col("k").alias("task"),
        F.floor(F.col("session_id") / 3).alias("trial"),
        F.when(s == 0, CONDITIONS[0]).when(s == 1, CONDITIONS[1]).otherwise(CONDITIONS[2]).alias("condition"),
        F.when(F.col("last_err"), 0.0).otherwise(1.0).alias("reward"),
        F.when(e % 19 == 0, "timeout").when(e % 23 == 0, "infrastructure_error").when(F.col("last_tool") == "view", "max_steps").otherwise("user_stop").alias("termination"),
        calls.alias("tool_calls"),
        F.when(e % 7 != 0, calls * 100 + F.col("cost")).alias("provider_input_tokens"),
        F.when(e % 7 != 0, calls).alias("generation_calls"),
        F.when(e % 5 != 0, calls * 10).alias("provider_output_tokens"),
        (calls * 40 + F.col("k")).alias("trajectory_tokens"),
        F.when(e % 11 != 0, calls * 20 + F.col("k")).alias("selected_tokens"),
        F.col("recovery").alias("recovery_steps"),
        F.col("repeats").alias("repeated_invalid_actions"),
        F.col("retries").alias("repeated_failed_actions"),
        F.col("errors").alias("failure_card_turns"),
        F.when(calls > 2, 1).otherwise(0).alias("budget_infeasible_turns"),
        F.when(F.col("errors") > 1, 1).otherwise(0).alias("raw_failures_selected"),
        F.col("cost").alias("cost_usd"),
        *[none.alias(c) for c in ("turn_selected_tokens", "compression_ratio", "graph_selected_tokens", "protocol_closed_tokens")],
        "event_id",
        "acts",
        "errors",
    )
    return runs.judged(rows)


_EVAL = "FILTER (NOT infra)"
_METRICS = f"""count(rj.domain) AS sessions, count(rj.domain) {_EVAL} AS evaluated_sessions, count(rj.domain) FILTER (NOT infra AND success) AS successes, count(rj.domain) FILTER (NOT infra AND normal_stop) AS normal_stops, count(rj.domain) FILTER (infra) AS infrastructure_errors, count(provider_input_tokens) {_EVAL} AS usage_sessions,
median(tool_calls) {_EVAL} AS median_tool_calls, avg(trajectory_tokens) AS mean_trajectory_tokens, median(trajectory_tokens) AS median_trajectory_tokens, avg(selected_tokens) AS mean_selected_tokens, median(selected_tokens) AS median_selected_tokens, avg(provider_input_tokens) {_EVAL} AS mean_provider_input_tokens, median(provider_input_tokens) {_EVAL} AS median_provider_input_tokens,
avg(provider_output_tokens) {_EVAL} AS mean_provider_output_tokens, avg(repeated_failed_actions) AS mean_repeated_failed_actions, avg(repeated_invalid_actions) AS mean_repeated_invalid_actions, avg(recovery_steps) AS mean_recovery_steps, avg(raw_failures_selected) AS mean_raw_failures_selected, count(recovery_steps) AS resolved_failure_sessions, count(*) FILTER (failure_card_turns > 0) AS failure_card_sessions, count(*) FILTER (budget_infeasible_turns > 0) AS budget_infeasible_sessions,
sum(provider_input_tokens) {_EVAL} / nullif(sum(generation_calls) FILTER (NOT infra AND provider_input_tokens IS NOT NULL), 0)::DOUBLE AS mean_input_tokens_per_call, coalesce(sum(cost_usd), 0)::DOUBLE AS total_cost_usd,
count(rj.domain) FILTER (NOT infra AND success) / nullif(count(rj.domain) {_EVAL}, 0)::DOUBLE AS success_rate, count(rj.domain) FILTER (NOT infra AND normal_stop) / nullif(count(rj.domain) {_EVAL}, 0)::DOUBLE AS normal_stop_rate, count(rj.domain) FILTER (infra) / nullif(count(rj.domain), 0)::DOUBLE AS infrastructure_error_rate, count(provider_input_tokens) {_EVAL} / nullif(count(rj.domain) {_EVAL}, 0)::DOUBLE AS usage_coverage"""
_COLUMNS = [x.rsplit(" AS ", 1)[1].strip() for x in __import__("re").split(r",\s(?=count|median|avg|sum|coalesce)", _METRICS)]


def _rounded(df, by):
    kinds = dict(df.dtypes)
    return df.select(*by, *[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in _COLUMNS])


def _rounded_sql(by: str) -> str:
    whole = ("sessions", "successes", "stops", "errors")
    return by + ", " + ", ".join(c if c.endswith(whole) else f"round({c}::DOUBLE, 6) AS {c}" for c in _COLUMNS)


@R.add("run_conditions", f"WITH {RUNS}, m AS (SELECT condition, {_METRICS} FROM rj GROUP BY condition) SELECT {_rounded_sql('condition')} FROM m")
def run_conditions(t):
    return _rounded(runs.condition_metrics(run_rows(t), ["condition"]), ["condition"])


@R.add(
    "run_domain_conditions",
    f"WITH {RUNS}, sp AS (SELECT c.condition, d.domain FROM (SELECT unnest({list(CONDITIONS)}) AS condition) c, (SELECT unnest([0, 1, 2, 3, 9]) AS domain) d), m AS (SELECT sp.condition, sp.domain AS group_domain, {_METRICS} FROM sp LEFT JOIN rj ON rj.condition = sp.condition AND rj.domain = sp.domain GROUP BY ALL) SELECT {_rounded_sql('condition, group_domain AS domain')} FROM m",
)
def run_domain_conditions(t):
    """Every condition in every planned domain, one of which has no runs."""
    rows = run_rows(t)
    spine = rows.sparkSession.createDataFrame([(c, d) for c in CONDITIONS for d in (0, 1, 2, 3, 9)], "condition string, domain bigint")
    return _rounded(runs.condition_metrics(rows, ["condition", "domain"], spine), ["condition", "domain"])


_PASS = ("provider_input_tokens", "repeated_invalid_actions", "recovery_steps")
PAIRED = f"""{RUNS}, one AS (SELECT domain, task, trial, condition, infra, success, {", ".join(_PASS)} FROM rj),
pp AS (SELECT a.domain, a.task, a.trial, c.condition, b.infra IS NULL OR a.infra OR b.infra AS excluded, a.success AS rs, b.success AS cs, {", ".join(f"CASE WHEN NOT (b.infra IS NULL OR a.infra OR b.infra) THEN b.{m}::DOUBLE - a.{m} END AS d_{m}" for m in _PASS)} FROM one a JOIN (SELECT unnest(['last_k', 'full_ours']) AS condition) c ON true LEFT JOIN one b ON b.domain = a.domain AND b.task = a.task AND b.trial = a.trial AND b.condition = c.condition WHERE a.condition = 'full_trajectory')"""


@R.add("run_pairs", f"WITH {PAIRED} SELECT domain, task, trial, condition, excluded, rs AS reference_success, cs AS success, {', '.join(f'd_{m} AS delta_{m}' for m in _PASS)} FROM pp")
def run_pairs(t):
    return runs.pairs(table(run_rows(t), "runs"), CONDITIONS[0], _PASS)


@R.add(
    "run_comparisons",
    f"""WITH {PAIRED} SELECT condition, count(*) FILTER (NOT excluded) AS pairs, count(*) FILTER (excluded) AS excluded_pairs, count(*) FILTER (NOT excluded AND rs AND NOT cs) AS reference_only, count(*) FILTER (NOT excluded AND cs AND NOT rs) AS comparator_only, count(*) FILTER (NOT excluded AND rs AND cs) AS both_success, count(*) FILTER (NOT excluded AND NOT rs AND NOT cs) AS neither_success,
round(avg(CASE WHEN NOT excluded THEN cs::INT - rs::INT END), 6) AS success_delta, {", ".join(f"count(d_{m}) AS n_{m}, round(avg(d_{m}), 6) AS delta_{m}" for m in _PASS)} FROM pp GROUP BY condition""",
)
def run_comparisons(t):
    c = runs.comparisons(runs.pairs(table(run_rows(t), "runs"), CONDITIONS[0], _PASS), _PASS)
    return c.withColumns({x: F.round(x, 6) for x in ("success_delta", *[f"delta_{m}" for m in _PASS])})


@R.add("run_dominance", f"WITH {RUNS}, m AS (SELECT condition AS name, avg(trajectory_tokens) AS c, avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS g FROM rj GROUP BY condition UNION ALL SELECT concat('domain ', domain), avg(trajectory_tokens), avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) FROM rj GROUP BY domain), q AS (SELECT name, round(c::DOUBLE, 6) AS c, round(g::DOUBLE, 6) AS g FROM m) SELECT a.name, b.name AS by FROM q a JOIN q b ON b.c <= a.c AND b.g >= a.g AND (b.c < a.c OR b.g > a.g)")
def run_dominance(t):
    """Which conditions and domains cost no more than others and succeed as often."""
    rows = run_rows(t)
    cost, gain = F.round(F.avg("trajectory_tokens"), 6).alias("cost"), F.round(F.avg(F.col("success").cast("double")), 6).alias("gain")
    m = rows.groupBy(F.col("condition").alias("name")).agg(cost, gain).union(rows.groupBy(F.concat(F.lit("domain "), F.col("domain").cast("string")).alias("name")).agg(cost, gain))
    return runs.dominance(m, "cost", "gain", "name")


_INFO = """concat('{{"reward": ', CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, ', "db_check": {{"db_reward": ', CASE WHEN event_id % 3 = 0 THEN '0.5' ELSE '1.0' END, '}}, "action_checks": [{{"tool_type": "read", "action_match": ', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, '}}, {{"tool_type": "write", "action_match": true}}], "nl_assertions": [{{"met": ', CASE WHEN event_id % 5 = 0 THEN 'false' ELSE 'true' END, '}}]}}')""".replace("{{", "{").replace("}}", "}")


def _infos(t):
    e = F.col("event_id")
    flag = lambda c: F.when(c, "true").otherwise("false")
    info = F.concat(F.lit('{"reward": '), F.when(F.col("event_type") == "error", "0").otherwise("1"), F.lit(', "db_check": {"db_reward": '), F.when(e % 3 == 0, "0.5").otherwise("1.0"), F.lit('}, "action_checks": [{"tool_type": "read", "action_match": '), flag(e % 2 == 0), F.lit('}, {"tool_type": "write", "action_match": true}], "nl_assertions": [{"met": '), flag(e % 5 != 0), F.lit("}]}"))
    usage = F.when(e % 4 == 0, F.concat(F.lit('{"prompt_tokens": "12", "input_tokens": '), e.cast("string"), F.lit("}"))).when(e % 4 == 1, F.concat(F.lit('{"input_token_count": '), e.cast("string"), F.lit("}"))).when(e % 4 == 2, F.concat(F.lit('{"prompt_tokens": '), e.cast("string"), F.lit(', "input_tokens": 1}')))
    return t("events").select("event_id", "event_type", info.alias("info"), usage.alias("usage"))


@R.add(
    "reward_reasons",
    """WITH d AS (SELECT event_id, event_type <> 'error' AS success, event_id % 13 = 0 AS infra, event_id % 4 <> 0 AS normal_stop, event_id % 2 = 0 AS read_ok, event_id % 3 = 0 AS db_bad, event_id % 5 = 0 AS said_not, CASE event_id % 4 WHEN 3 THEN NULL ELSE event_id::DOUBLE END AS tokens FROM events)
SELECT event_id, success, CASE WHEN read_ok THEN 1 ELSE 0 END AS correct_reads, tokens AS input_tokens, CASE WHEN success THEN '' WHEN concat_ws(',', CASE WHEN infra THEN 'infrastructure_error' WHEN NOT normal_stop THEN 'abnormal_termination' END, CASE WHEN NOT read_ok THEN 'read_action_mismatch' END, CASE WHEN db_bad THEN 'database_mismatch' END, CASE WHEN said_not THEN 'natural_language_assertion_mismatch' END) = '' THEN 'other_official_reward_failure'
ELSE concat_ws(',', CASE WHEN infra THEN 'infrastructure_error' WHEN NOT normal_stop THEN 'abnormal_termination' END, CASE WHEN NOT read_ok THEN 'read_action_mismatch' END, CASE WHEN db_bad THEN 'database_mismatch' END, CASE WHEN said_not THEN 'natural_language_assertion_mismatch' END) END AS reasons FROM d""",
)
def reward_reasons(t):
    """Rewards as JSON: diagnostics, success, the first numeric usage field, and why a run failed."""
    rows = _infos(t).withColumns(runs.reward_diagnostics(F.col("info")))
    rows = rows.withColumns({"success": runs.task_success(F.get_json_object("info", "$.reward").cast("double")), "infrastructure_error": F.col("event_id") % 13 == 0, "normal_stop": F.col("event_id") % 4 != 0})
    return rows.select("event_id", "success", F.col("correct_read_actions").cast("int").alias("correct_reads"), runs.first_number(F.col("usage"), runs.INPUT_KEYS).alias("input_tokens"), F.array_join(runs.failure_reasons(), ",").alias("reasons"))


@R.add(
    "run_alignment",
    f"""WITH {EX}, si AS (SELECT session_id, ordinal AS place, concat('s', session_id, '-', ordinal) AS sim FROM ex), tr AS (SELECT session_id, ordinal AS place, concat('t', session_id, '-', ordinal) AS trace, CASE WHEN ordinal % 3 = 0 THEN concat('s', session_id, '-', ordinal) WHEN ordinal % 3 = 1 AND ordinal % 2 = 0 THEN 'gone' END AS src FROM ex WHERE ordinal % 5 <> 0 OR ordinal % 3 = 0),
di AS (SELECT si.session_id, sim, min_by(trace, tr.place) AS trace FROM si JOIN tr ON tr.session_id = si.session_id AND tr.src = si.sim GROUP BY si.session_id, sim),
ls AS (SELECT session_id, sim, row_number() OVER (PARTITION BY session_id ORDER BY place) AS turn FROM si ANTI JOIN di USING (session_id, sim)), lt AS (SELECT session_id, trace, row_number() OVER (PARTITION BY session_id ORDER BY place) AS turn FROM tr ANTI JOIN di USING (session_id, trace))
SELECT session_id, sim AS simulation_id, trace AS trace_id, 'id' AS how FROM di UNION ALL SELECT ls.session_id, sim, trace, CASE WHEN trace IS NULL THEN 'none' ELSE 'order' END FROM ls LEFT JOIN lt USING (session_id, turn)""",
)
def run_alignment(t):
    """Every third trace names its simulation; some name one that is not there; some are missing."""
    ex = event_exchanges(t("events"))
    o = F.col("ordinal")
    name = lambda p: F.concat(F.lit(p), F.col("session_id").cast("string"), F.lit("-"), o.cast("string"))
    sims = ex.select("session_id", o.alias("place"), name("s").alias("simulation_id"))
    made = ex.where((o % 5 != 0) | (o % 3 == 0)).select("session_id", o.alias("place"), name("t").alias("trace_id"), F.when(o % 3 == 0, name("s")).when((o % 3 == 1) & (o % 2 == 0), "gone").alias("source_simulation_id"))
    return runs.aligned(sims, made, ["session_id"])


@R.add(
    "prompt_cost_layers",
    """WITH c AS (SELECT conv_id, turn, CAST((strlen(text) + 3) // 4 AS BIGINT) AS k FROM conversations),
l AS (SELECT concat('r', conv_id, '-', turn) AS record_id, CASE turn % 4 WHEN 0 THEN k WHEN 1 THEN k + 5 WHEN 2 THEN NULL ELSE NULL END AS graph_selected, CASE turn % 4 WHEN 0 THEN k - 1 WHEN 1 THEN k + 5 END AS compiled, CASE turn % 4 WHEN 0 THEN 2 * k WHEN 1 THEN k + 9 END AS protocol_closed, CASE turn % 4 WHEN 0 THEN 3 * k WHEN 2 THEN 5 END AS serialized_request, CASE turn % 4 WHEN 0 THEN 3 * k + 1 END AS provider_actual, CASE turn % 4 WHEN 1 THEN 0.25::DOUBLE WHEN 2 THEN 0.5::DOUBLE END AS headroom, CASE turn % 4 WHEN 0 THEN 'declared' WHEN 1 THEN 'legacy_graph_proxy' ELSE 'deterministic_serialization_estimate' END AS accounting_provenance, turn FROM c WHERE turn % 4 < 3)
SELECT record_id, graph_selected, compiled, protocol_closed, serialized_request, provider_actual, round((protocol_closed - graph_selected) / nullif(protocol_closed, 0)::DOUBLE, 9) AS closed_mismatch, round((serialized_request - graph_selected) / nullif(serialized_request, 0)::DOUBLE, 9) AS serialized_mismatch, headroom, accounting_provenance FROM l""",
)
def prompt_cost_layers(t):
    """Cost records of four shapes made of turns: declared layers, items with a headroom, a whole request, and none."""
    c = t("conversations")
    k, turn = estimate_tokens(F.col("text")), F.col("turn") % 4
    s = lambda x: x.cast("string")
    name = F.concat(F.lit('"request_hash":"r'), s(F.col("conv_id")), F.lit("-"), s(F.col("turn")), F.lit('"'))
    shapes = (
        F.concat(F.lit("{"), name, F.lit(',"costs":{"graph_selected":'), s(k), F.lit(',"compiled":'), s(k - 1), F.lit(',"protocol_closed_tokens":'), s(k * 2), F.lit(',"serialized_request":'), s(k * 3), F.lit(',"input_tokens":'), s(k * 3 + 1), F.lit("}}")),
        F.concat(F.lit("{"), name, F.lit(',"items":[{"token_count":'), s(k), F.lit('},{"token_count":5},{"x":1}],"metadata":{"protocol_closed_message_tokens":'), s(k + 9), F.lit('},"provider_token_oracle_headroom_bps":2500}')),
        F.concat(F.lit("{"), name, F.lit(',"request":{"messages":[1,2,3]},"raw_serialized_request_tokens":10,"oracle_serialized_request_tokens":5}')),
        F.concat(F.lit("{"), name, F.lit("}")),
    )
    records = c.select(F.when(turn == 0, shapes[0]).when(turn == 1, shapes[1]).when(turn == 2, shapes[2]).otherwise(shapes[3]).alias("value"))
    return runs.cost_layers(records).withColumns({x: F.round(x, 9) for x in ("closed_mismatch", "serialized_mismatch")})


_POINTS = f"""{EX}, pt AS (SELECT event_id AS point_id, k % 4 AS domain, 1000 + 10 * ordinal AS raw, 900 + 8 * ordinal AS compiled, 300 + k AS policy, 200 AS tools, 500 + 10 * ordinal - k AS history, 650 + 2 * ordinal AS hard_floor FROM ex),
pa AS (SELECT *, raw - policy AS without_policy, raw - tools AS without_tools, raw - history AS without_history, policy + tools AS fixed_floor, (raw - policy - tools) / raw::DOUBLE AS fixed_floor_max_reduction, (raw - hard_floor) / raw::DOUBLE AS hard_floor_reduction, (raw - compiled) / raw::DOUBLE AS current_reduction, CAST(floor(raw * 0.7::DOUBLE) AS BIGINT) AS target FROM pt)"""


def _points(t):
    o, k = F.col("ordinal"), F.col("k")
    p = event_exchanges(t("events")).select(F.col("event_id").alias("point_id"), (k % 4).alias("domain"), (o * 10 + 1000).alias("raw"), (o * 8 + 900).alias("compiled"), (k + 300).alias("policy"), F.lit(200).cast("bigint").alias("tools"), (o * 10 + 500 - k).alias("history"), (o * 2 + 650).alias("hard_floor"))
    return runs.leave_one_out(p, ("policy", "tools", "history"))


@R.add("cost_marginals", f"WITH {_POINTS} SELECT point_id, without_policy, without_tools, without_history, fixed_floor, round(fixed_floor_max_reduction, 9) AS fixed_floor_max_reduction, round(hard_floor_reduction, 9) AS hard_floor_reduction, round(current_reduction, 9) AS current_reduction, target FROM pa")
def cost_marginals(t):
    p = _points(t)
    return p.select("point_id", "without_policy", "without_tools", "without_history", "fixed_floor", *[F.round(c, 9).alias(c) for c in ("fixed_floor_max_reduction", "hard_floor_reduction", "current_reduction")], "target")


@R.add("attribution_summary", f"WITH {_POINTS}, sm AS (SELECT domain, count(*) AS points, median(raw) AS raw, median(fixed_floor) AS ff, median(fixed_floor_max_reduction) AS fr, median(hard_floor_reduction) AS hr, grouping(domain) AS top FROM pa GROUP BY GROUPING SETS ((), (domain))) SELECT domain, points, raw::DOUBLE AS median_raw, ff::DOUBLE AS median_fixed_floor, round(fr, 9) AS median_fixed_floor_max_reduction, round(hr, 9) AS median_hard_floor_reduction, CASE WHEN top = 1 THEN CASE WHEN fr < 0.3 THEN 'unreachable_under_frozen_fixed_cost' WHEN hr >= 0.3 THEN 'reachable_with_verified_constructive_request' ELSE 'indeterminate_stop' END END AS decision FROM sm")
def attribution_summary(t):
    flags = ("request_matches", "runtime_matches", "raw_matches", "compiled_matches", "policy_once", "tools_exact", "hard_covered")
    s = runs.attribution_summary(_points(t).withColumns({f: F.lit(True) for f in flags}))
    return s.select("domain", "points", "median_raw", "median_fixed_floor", F.round("median_fixed_floor_max_reduction", 9).alias("median_fixed_floor_max_reduction"), F.round("median_hard_floor_reduction", 9).alias("median_hard_floor_reduction"), "decision")


@R.add(
    "stage_one_gates",
    f"""WITH {RUNS}, m AS (SELECT {_METRICS} FROM rj), g(gate, metric, comparator, threshold) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}', {x}::DOUBLE)" for a, b, c, x in gates.STAGE_ONE)}), v AS (SELECT 'task_success_rate' AS metric, success_rate AS value FROM m UNION ALL SELECT 'normal_stop_rate', normal_stop_rate FROM m UNION ALL SELECT 'median_tool_calls', median_tool_calls FROM m UNION ALL SELECT 'infrastructure_error_rate', infrastructure_error_rate FROM m)
SELECT gate, metric, comparator, threshold, round(value, 9) AS value, coalesce(CASE comparator WHEN 'at_least' THEN value >= threshold ELSE value <= threshold END, false) AS passed FROM g LEFT JOIN v USING (metric)""",
)
def stage_one_gates(t):
    """Trajectory tokens are left out, so their gate fails."""
    m = runs.condition_metrics(run_rows(t).withColumn("all", F.lit(1)), ["all"]).withColumnRenamed("success_rate", "task_success_rate").drop("median_trajectory_tokens")
    return gates.report(m, "stage_one").withColumn("value", F.round("value", 9))


@R.add("gate_sets", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST({len(v)} AS BIGINT), '{','.join(sorted(x[0] for x in v))}')" for n, v in gates.SETS.items()) + ") t(name, gates, blockers)")
def gate_sets(t):
    """Every named set over a row without evidence: all of its gates block."""
    nothing = t("region").limit(1).select(F.lit(1).alias("unrelated"))
    out = None
    for name in gates.SETS:
        verdicts = gates.report(nothing, name)
        row = verdicts.agg(F.lit(name).alias("name"), F.count("*").alias("gates"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("gate")))), ",").alias("blockers"))
        out = row if out is None else out.union(row)
    return out


@R.add(
    "harm_gate",
    f"""WITH {EX}, r AS (SELECT session_id AS p, (ordinal - 1) // 3 + 1 AS rep, (ordinal - 1) % 3 AS x, err AS h, side_effect AS pol, 100 + k AS tok FROM ex), w AS (SELECT p, rep, bool_or(h) FILTER (x = 0) AS rh, bool_or(h) FILTER (x = 1) AS ch, bool_or(h) FILTER (x = 2) AS dh, bool_or(pol AND h) FILTER (x = 0) AS rp, bool_or(pol AND h) FILTER (x = 1) AS cp, max(tok) FILTER (x = 0) AS rt, max(tok) FILTER (x = 1) AS ct FROM r GROUP BY p, rep),
c AS (SELECT * FROM w WHERE rh IS NOT NULL AND ch IS NOT NULL AND dh IS NOT NULL)
SELECT (SELECT count(*) FROM w) = (SELECT count(*) FROM c) AS complete_branches, count(DISTINCT p) FILTER (ch AND NOT rh) AS unique_harm_prefixes, count(DISTINCT p) FILTER (cp AND NOT rp) AS unique_policy_prefixes, count(DISTINCT p) FILTER (ch <> dh) AS discordant_prefixes, round(count(DISTINCT p) FILTER (NOT ch AND dh) / nullif(count(DISTINCT p) FILTER (ch <> dh), 0)::DOUBLE, 9) AS compiled_better_share, round(median((rt - ct) / rt::DOUBLE), 9) AS median_input_reduction FROM c""",
)
def harm_gate(t):
    """Branches made of exchanges in turn, scored."""
    turn = (F.col("ordinal") - 1) % 3
    rows = event_exchanges(t("events")).select(F.col("session_id").alias("prefix_id"), (F.floor((F.col("ordinal") - 1) / 3) + 1).alias("replicate"), F.when(turn == 0, "raw_message").when(turn == 1, "compiled").otherwise("drop").alias("treatment"), F.col("err").alias("harm"), (F.col("side_effect") & F.col("err")).alias("policy"), (F.col("k") + 100).alias("tokens"))
    return stats.representation_harm(rows).withColumns({c: F.round(c, 9) for c in ("compiled_better_share", "median_input_reduction")})


@R.add("attempts", f"WITH {EX} SELECT session_id, k, ordinal, row_number() OVER (PARTITION BY session_id, k ORDER BY ordinal) AS attempt, concat('attempt_', lpad(CAST(row_number() OVER (PARTITION BY session_id, k ORDER BY ordinal) AS VARCHAR), 4, '0')) AS name FROM ex")
def attempts(t):
    """Attempts of an operation, numbered as stored artifacts are."""
    w = Window.partitionBy("session_id", "k").orderBy("ordinal")
    n = F.row_number().over(w).cast("bigint")
    return event_exchanges(t("events")).select("session_id", "k", "ordinal", n.alias("attempt"), F.concat(F.lit("attempt_"), F.lpad(n.cast("string"), 4, "0")).alias("name"))


@R.add("split_members", "WITH s AS (SELECT o_orderkey AS task, o_orderstatus AS domain FROM orders) SELECT domain, task, CASE WHEN task % 10 < 5 AND task % 3 = 0 THEN 'train' WHEN task % 10 < 5 THEN 'validation' END AS split FROM s")
def split_members(t):
    """The first split that holds each order; some are in two, some in none."""
    o = t("orders").select(F.col("o_orderkey").alias("task"), F.col("o_orderstatus").alias("domain"))
    low = o.where("task % 10 < 5")
    train = low.where("task % 3 = 0").agg(F.lit("train").alias("split"), F.lit(1).alias("place"), F.collect_list("task").alias("members"))
    valid = low.agg(F.lit("validation").alias("split"), F.lit(2).alias("place"), F.collect_list("task").alias("members"))
    return runs.split_members(o, train.union(valid)).select("domain", "task", "split")


@R.add(
    "blind_packages",
    """WITH i AS (SELECT doc_id, quality, row_number() OVER (ORDER BY sha256(concat('s', chr(0), doc_id)), doc_id) AS n FROM labels), k AS (SELECT *, concat('item_', lpad(CAST(n AS VARCHAR), 6, '0')) AS annotation_id FROM i)
SELECT a.annotator, annotation_id, quality, doc_id, row_number() OVER (PARTITION BY a.annotator ORDER BY sha256(concat('s', chr(0), a.annotator, chr(0), annotation_id)), annotation_id) AS place FROM k, (SELECT unnest(['a', 'b']) AS annotator) a""",
)
def blind_packages(t):
    sheets, key = annotation.packages(t("labels").select("doc_id", "quality"), "doc_id", "s")
    return sheets.join(key, "annotation_id").select("annotator", "annotation_id", "quality", "doc_id", "place")


_LABELS = "WITH a AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'keep' ELSE 'drop' END AS x, toxic AS y FROM labels), b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'keep' ELSE 'drop' END AS x, toxic AS y FROM labels)"


def _annotators(t):
    k = t("labels")
    a = k.select("doc_id", F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("x"), F.col("toxic").alias("y"))
    b = k.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "keep").otherwise("drop").alias("x"), F.col("toxic").alias("y"))
    return a, b


@R.add("adjudicated_labels", f"{_LABELS} SELECT a.doc_id, a.x AS x_a, b.x AS x_b, a.y AS y_a, b.y AS y_b, CASE WHEN a.x = b.x THEN a.x WHEN a.doc_id % 2 = 0 THEN 'settled' END AS x_gold, CAST(a.y AS VARCHAR) AS y_gold, CASE WHEN a.x <> b.x AND a.doc_id % 2 = 1 THEN 1 ELSE 0 END AS unresolved FROM a JOIN b USING (doc_id)")
def adjudicated_labels(t):
    """Two annotators, and an adjudicator for every other item."""
    a, b = _annotators(t)
    settled = t("labels").where("doc_id % 2 = 0").select("doc_id", F.lit("x").alias("field"), F.lit("settled").alias("value"))
    return annotation.adjudicated(a, b, "doc_id", ["x", "y"], settled)


@R.add("pass_agreement", f"{_LABELS}, j AS (SELECT a.doc_id % 4 AS part, a.x = b.x AS sx, a.y = b.y AS sy, a.x = 'keep' AS ka, b.x = 'keep' AS kb FROM a JOIN b USING (doc_id)) SELECT part, count(*) AS units, round(avg(CASE WHEN sx THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS agree_x, round(avg(CASE WHEN sy THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS agree_y, count(*) FILTER (sx AND sy) AS full_consensus, count(*) FILTER (sx AND sy AND ka) AS consensus_safe, count(*) FILTER (ka) AS a_safe, count(*) FILTER (kb) AS b_safe, round(avg(CASE WHEN ka = kb THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS safe_agreement FROM j GROUP BY GROUPING SETS ((), (part))")
def pass_agreement(t):
    a, b = (x.withColumn("part", F.col("doc_id") % 4) for x in _annotators(t))
    p = annotation.pass_agreement(a, b, ["part", "doc_id"], ["x", "y"], "x", "keep")
    return p.withColumns({c: F.round(c, 9) for c in ("agree_x", "agree_y", "safe_agreement")})


@R.add(
    "run_disagreements",
    f"""WITH {RUNS}, a AS (SELECT * FROM rj WHERE condition = 'full_trajectory'), b AS (SELECT * FROM rj WHERE condition = 'full_ours'),
d AS (SELECT a.domain, a.task, a.trial, b.success IS NOT NULL AS here, CASE WHEN a.success AND b.success THEN 'both_success' WHEN a.success THEN 'reference_only_success' WHEN b.success THEN 'comparator_only_success' ELSE 'neither_success' END AS dir, a.success <> b.success AS apart, a.errors + b.errors AS signals, b.selected_tokens::DOUBLE - a.selected_tokens AS token_delta FROM a LEFT JOIN b ON b.domain = a.domain AND b.task = a.task AND b.trial = a.trial),
q AS (SELECT *, CASE WHEN NOT here THEN 4 WHEN apart AND signals > 0 THEN 0 WHEN apart THEN 1 WHEN signals > 0 THEN 2 ELSE 3 END AS rank FROM d)
SELECT domain, task, trial, CASE WHEN here THEN dir END AS direction, CASE rank WHEN 0 THEN 'disagreement_with_failure' WHEN 1 THEN 'disagreement' WHEN 2 THEN 'agreement_with_failure' WHEN 3 THEN 'agreement' END AS tier, token_delta, signals, row_number() OVER (PARTITION BY domain ORDER BY rank, signals DESC NULLS LAST, task, trial) AS place FROM q""",
)
def run_disagreements(t):
    return annotation.disagreements(table(run_rows(t).withColumn("failure_signals", F.col("errors")), "runs"), "full_trajectory", "full_ours")


@R.add(
    "intervention_means",
    f"""WITH {RUNS}, sp AS (SELECT c.condition, d.domain FROM (SELECT unnest({list(CONDITIONS)}) AS condition) c, (SELECT unnest([0, 1, 2, 3, 9]) AS domain) d)
SELECT sp.condition, sp.domain, count(rj.condition) AS n, round(avg(rj.repeated_invalid_actions)::DOUBLE, 9) AS mean_repeated_invalid_actions, round(avg(rj.recovery_steps)::DOUBLE, 9) AS mean_recovery_steps FROM sp LEFT JOIN rj ON rj.condition = sp.condition AND rj.domain = sp.domain GROUP BY sp.condition, sp.domain
UNION ALL SELECT condition, NULL, count(*), round(avg(repeated_invalid_actions)::DOUBLE, 9), round(avg(recovery_steps)::DOUBLE, 9) FROM rj GROUP BY condition""",
)
def intervention_means(t):
    rows = run_rows(t)
    spine = rows.sparkSession.createDataFrame([(c, d) for c in CONDITIONS for d in (0, 1, 2, 3, 9)], "condition string, domain bigint")
    m = ["repeated_invalid_actions", "recovery_steps"]
    return annotation.spined(table(rows, "runs"), spine, ["condition", "domain"], m).withColumns({f"mean_{c}": F.round(f"mean_{c}", 9) for c in m})


@R.add("prefix_manifest", """WITH p AS (SELECT concat(conv_id, ':', turn) AS prefix_id, conv_id AS session_id, conv_id % 4 AS domain, conv_id AS task, sha256(text) AS prefix_hash FROM conversations WHERE role = 'assistant'), f AS (SELECT conv_id AS session_id, count(*) AS prefix_node_count FROM conversations GROUP BY conv_id), h AS (SELECT *, cast(concat('0x', substr(sha256(concat('["', domain, '","', task, '"]')), 1, 12)) AS BIGINT) / power(16, 12) AS share FROM p)
SELECT prefix_id, h.session_id, domain, task, prefix_hash, prefix_node_count, CASE WHEN share < 0.6 THEN 'train' WHEN share < 0.8 THEN 'validation' ELSE 'test' END AS split, concat('prefix_', substr(sha256(concat(prefix_id, chr(31), prefix_hash)), 1, 24)) AS manifest_id FROM h JOIN f USING (session_id)""")
def prefix_manifest(t):
    """A frozen point for each assistant turn."""
    c = t("conversations")
    points = c.where("role = 'assistant'").select(F.concat_ws(":", "conv_id", "turn").alias("prefix_id"), F.col("conv_id").alias("session_id"), (F.col("conv_id") % 4).alias("domain"), F.col("conv_id").alias("task"), F.col("text").alias("payload"))
    features = c.groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("prefix_node_count"))
    return annotation.manifest(points, features, points.select("prefix_id", F.sha2("payload", 256).alias("prefix_hash")))
