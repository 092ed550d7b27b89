"""Runs of tasks under conditions: what a result says, metrics of conditions, pairs of runs, and how one condition compares with another.

A run is (domain, task, trial, condition, reward, termination, and measures that may be null). Missing measures are not zero: means and
medians are over what was observed, rates without a denominator are null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidline.functions.identity import stable_id

KEY = ["domain", "task", "trial"]
# How runs end, and where a provider's usage is found.
INFRASTRUCTURE_ENDS = ("infrastructure_error", "timeout")
NORMAL_ENDS = ("user_stop", "agent_stop")
INPUT_KEYS, OUTPUT_KEYS = ("prompt_tokens", "input_tokens", "input_token_count"), ("completion_tokens", "output_tokens", "output_token_count")


def first_number(usage: Column, keys: tuple[str, ...]) -> Column:
    """The first of the fields of a JSON object that is a number; a text with digits is none."""
    value = F.try_parse_json(usage)

    def number(k: str) -> Column:
        found = F.try_variant_get(value, f"$.{k}", "variant")
        return F.when(F.schema_of_variant(found).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, f"$.{k}", "double"))

    return F.coalesce(*[number(k) for k in keys])


def task_success(reward: Column) -> Column:
    """A reward of one, but for rounding; no reward is no success."""
    return F.coalesce(F.abs(reward - 1.0) <= F.greatest(F.lit(1e-6), 1e-9 * F.greatest(F.abs(reward), F.lit(1.0))), F.lit(False))


def reward_diagnostics(info: Column) -> dict[str, Column]:
    """Counts over the checks of a reward (JSON): expected and correct reads and writes, assertions, communication, and the database's reward."""
    checks = F.from_json(F.get_json_object(info, "$.action_checks"), "array<struct<tool_type:string,action_match:boolean>>")
    of = lambda c: F.from_json(F.get_json_object(info, f"$.{c}"), "array<struct<met:boolean>>")
    size = lambda a: F.coalesce(F.size(a), F.lit(0)).cast("bigint")
    some = lambda a, f: F.greatest(F.lit(0), size(F.filter(a, f)))
    out = {}
    kind = lambda t: lambda x: x["tool_type"] == t
    right = lambda t: lambda x: (x["tool_type"] == t) & x["action_match"]
    for t in ("read", "write"):
        out[f"expected_{t}_actions"] = some(checks, kind(t))
        out[f"correct_{t}_actions"] = some(checks, right(t))
    out["db_reward"] = F.get_json_object(info, "$.db_check.db_reward").cast("double")
    for c, name in (("nl_assertions", "nl_assertions"), ("communicate_checks", "communication_checks")):
        out[f"expected_{name}"] = some(of(c), lambda x: x.isNotNull())
        out[f"met_{name}"] = some(of(c), lambda x: x["met"])
    return out


def failure_reasons() -> Column:
    """Why a run (with diagnostics, success, infrastructure_error and normal_stop) did not succeed, in order; none for a success."""
    less = lambda a, b: F.col(a) < F.col(b)
    reasons = F.filter(
        F.array(
            F.when(F.col("infrastructure_error"), "infrastructure_error").when(~F.col("normal_stop"), "abnormal_termination"),
            F.when(less("correct_read_actions", "expected_read_actions"), "read_action_mismatch"),
            F.when(less("correct_write_actions", "expected_write_actions"), "write_action_mismatch"),
            F.when(F.col("db_reward") < 1.0, "database_mismatch"),
            F.when(less("met_nl_assertions", "expected_nl_assertions"), "natural_language_assertion_mismatch"),
            F.when(less("met_communication_checks", "expected_communication_checks"), "communication_mismatch"),
        ),
        lambda x: x.isNotNull(),
    )
    none = F.array().cast("array<string>")
    return F.when(F.col("success"), none).when(F.size(reasons) == 0, F.array(F.lit("other_official_reward_failure"))).otherwise(reasons)


def judged(runs: DataFrame) -> DataFrame:
    """runs with success, normal_stop and infrastructure_error."""
    return runs.withColumns({"success": task_success(F.col("reward")), "normal_stop": F.col("termination").isin(*NORMAL_ENDS), "infrastructure_error": F.col("termination").isin(*INFRASTRUCTURE_ENDS)})


#: Measures of which conditions report mean and median, and those of which only the mean.
BOTH = ("trajectory_tokens", "selected_tokens", "provider_input_tokens")
MEANS = ("turn_selected_tokens", "compression_ratio", "graph_selected_tokens", "protocol_closed_tokens", "repeated_failed_actions", "repeated_invalid_actions", "recovery_steps", "raw_failures_selected", "provider_output_tokens")


def condition_metrics(runs: DataFrame, by: list[str], spine: DataFrame | None = None) -> DataFrame:
    """One row for each group of by: counts, rates, means and medians. Runs that failed by infrastructure count only where they can say something.

    spine: the groups to report, empty ones too.
    """
    ok = ~F.col("infrastructure_error")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    over = lambda f, test, c: f(F.when(test, F.col(c).cast("double")))
    usage = ok & F.col("provider_input_tokens").isNotNull()
    sums = runs.groupBy(*by).agg(
        F.count("*").alias("sessions"),
        n(ok).alias("evaluated_sessions"),
        n(ok & F.col("success")).alias("successes"),
        n(ok & F.col("normal_stop")).alias("normal_stops"),
        n(~ok).alias("infrastructure_errors"),
        n(usage).alias("usage_sessions"),
        over(F.median, ok, "tool_calls").alias("median_tool_calls"),
        *[f(F.when(ok, F.col(c).cast("double")) if c.startswith("provider") else F.col(c).cast("double")).alias(f"{w}_{c}") for c in BOTH for w, f in (("mean", F.avg), ("median", F.median))],
        *[(over(F.avg, ok, c) if c.startswith("provider") else F.avg(F.col(c).cast("double"))).alias(f"mean_{c}") for c in MEANS],
        F.count("recovery_steps").alias("resolved_failure_sessions"),
        n(F.col("failure_card_turns") > 0).alias("failure_card_sessions"),
        n(F.col("budget_infeasible_turns") > 0).alias("budget_infeasible_sessions"),
        F.sum(F.when(usage, F.col("provider_input_tokens").cast("double"))).alias("input_sum"),
        F.sum(F.when(usage, F.col("generation_calls"))).alias("call_sum"),
        F.sum("cost_usd").alias("cost"),
    )
    if spine is not None:
        sums = spine.join(sums, by, "left").fillna(0, [c for c, t in sums.dtypes if t == "bigint" and c not in by and c != "call_sum"])
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return sums.withColumns(
        {
            "success_rate": rate("successes", "evaluated_sessions"),
            "normal_stop_rate": rate("normal_stops", "evaluated_sessions"),
            "infrastructure_error_rate": rate("infrastructure_errors", "sessions"),
            "usage_coverage": rate("usage_sessions", "evaluated_sessions"),
            "mean_input_tokens_per_call": rate("input_sum", "call_sum"),
            "total_cost_usd": F.round(F.coalesce("cost", F.lit(0.0)), 8),
        }
    ).drop("input_sum", "call_sum", "cost")


def pairs(runs: DataFrame, reference: str, measures: tuple[str, ...]) -> DataFrame:
    """(domain, task, trial, condition, excluded, reference_success, success, and the delta of each measure) of each reference run with each other condition.

    A pair is excluded if a side is missing or failed by infrastructure. A delta is null where a side was not measured.
    """
    left = runs.where(F.col("condition") == reference).select(*KEY, F.col("infrastructure_error").alias("r_infra"), F.col("success").alias("r_success"), *[F.col(m).alias(f"r_{m}") for m in measures])
    others = runs.where(F.col("condition") != reference)
    names = others.select("condition").distinct()
    spine = left.join(F.broadcast(names))  # a handful of conditions
    both = spine.join(others.select(*KEY, "condition", "infrastructure_error", "success", *measures), [*KEY, "condition"], "left")
    excluded = F.col("infrastructure_error").isNull() | F.col("r_infra") | F.col("infrastructure_error")
    return both.select(*KEY, "condition", excluded.alias("excluded"), F.col("r_success").alias("reference_success"), "success", *[F.when(~excluded, F.col(m).cast("double") - F.col(f"r_{m}")).alias(f"delta_{m}") for m in measures])


def comparisons(paired: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """One row a condition: how many pairs, who succeeded alone, and the mean delta of each measure with its count."""
    here = ~F.col("excluded")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    a, b = F.col("reference_success"), F.col("success")
    return paired.groupBy("condition").agg(
        n(here).alias("pairs"),
        n(~here).alias("excluded_pairs"),
        n(here & a & ~b).alias("reference_only"),
        n(here & b & ~a).alias("comparator_only"),
        n(here & a & b).alias("both_success"),
        n(here & ~a & ~b).alias("neither_success"),
        F.avg(F.when(here, b.cast("double") - a.cast("double"))).alias("success_delta"),
        *[x for m in measures for x in (F.count(f"delta_{m}").alias(f"n_{m}"), F.avg(f"delta_{m}").alias(f"delta_{m}"))],
    )


def aligned(simulations: DataFrame, traces: DataFrame, group: list[str]) -> DataFrame:
    """(group, simulation_id, trace_id, how): traces by the simulation they name, the earliest of several; what is left over on both sides in order.

    simulations: (group, simulation_id, place); traces: (group, trace_id, source_simulation_id, place). Groups are runs of some sessions.
    """
    named = traces.where("source_simulation_id is not null").join(simulations.select(*group, F.col("simulation_id").alias("source_simulation_id")).distinct(), [*group, "source_simulation_id"], "left_semi")
    first = named.groupBy(*group, F.col("source_simulation_id").alias("simulation_id")).agg(F.min(F.struct("place", "trace_id")).alias("t"))
    direct = first.select(*group, "simulation_id", F.col("t.trace_id").alias("trace_id"))
    from pyspark.sql import Window

    turn = lambda: F.row_number().over(Window.partitionBy(*group).orderBy("place"))
    left = simulations.join(direct.select(*group, "simulation_id"), [*group, "simulation_id"], "left_anti").withColumn("turn", turn())
    over = traces.join(direct.select(*group, "trace_id"), [*group, "trace_id"], "left_anti").withColumn("turn", turn())
    zipped = left.select(*group, "simulation_id", "turn").join(over.select(*group, "trace_id", "turn"), [*group, "turn"], "left")
    return direct.withColumn("how", F.lit("id")).unionByName(zipped.select(*group, "simulation_id", "trace_id", F.when(F.col("trace_id").isNotNull(), "order").otherwise("none").alias("how")))


def dominance(metrics: DataFrame, cost: str, gain: str, name: str, most: int = 10_000) -> DataFrame:
    """(name, by): every pair of which the second costs no more, gains no less, and one of both strictly. For reports: over `most` rows is an error."""
    if metrics.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows to compare with each other")
    a, b = metrics.select(F.col(name), F.col(cost).alias("c"), F.col(gain).alias("g")), metrics.select(F.col(name).alias("by"), F.col(cost).alias("bc"), F.col(gain).alias("bg"))
    return a.join(F.broadcast(b), (F.col("bc") <= F.col("c")) & (F.col("bg") >= F.col("g")) & ((F.col("bc") < F.col("c")) | (F.col("bg") > F.col("g")))).select(name, "by")


def merge_rewards(results: DataFrame, rewards: DataFrame) -> DataFrame:
    """results (id, hash) with their reward. Each result needs one reward of its hash; anything else is an error."""
    joined = results.alias("r").join(rewards.alias("w"), "id", "full")
    bad = joined.where(F.col("r.hash").isNull() | F.col("w.hash").isNull() | (F.col("r.hash") != F.col("w.hash"))).select("id").limit(3).collect()
    twice = rewards.groupBy("id").count().where("count > 1").limit(3).collect()
    if bad or twice:
        raise ValueError(f"results and rewards do not meet: {[r.id for r in bad]}, rewards that occur again: {[r.id for r in twice]}")
    return joined.select("id", F.col("r.hash").alias("hash"), "reward")


def split_members(tasks: DataFrame, splits: DataFrame) -> DataFrame:
    """tasks (domain, task) with the first split (split, place, members array) that holds them; null if none does."""
    held = splits.select("split", "place", F.explode("members").alias("task"))
    first = held.groupBy("task").agg(F.min(F.struct("place", "split")).alias("s")).select("task", F.col("s.split").alias("split"))
    return tasks.join(first, "task", "left")


def cost_layers(records: DataFrame) -> DataFrame:
    """(record_id, five cost layers, mismatch ratios, headroom, provenance) of JSON records (column value), whatever shape they have.

    Layers: graph_selected, compiled, protocol_closed, serialized_request, provider_actual. What is not declared is taken from the parts; a
    record without any layer is left out.
    """
    at = lambda path: F.get_json_object("value", f"$.{path}").cast("bigint")
    nested = F.get_json_object("value", "$.costs").isNotNull()

    def declared(*names: str) -> Column:
        return F.when(nested, F.coalesce(*[at(f"costs.{x}") for x in names])).otherwise(F.coalesce(*[at(x) for x in names]))

    size = lambda path: F.when(F.get_json_object("value", f"$.{path}").isNotNull(), F.floor((F.octet_length(F.get_json_object("value", f"$.{path}")) + 3) / 4))
    items = F.from_json(F.get_json_object("value", "$.items"), "array<struct<token_count:bigint>>")
    summed = F.when(items.isNotNull(), F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["token_count"], F.lit(0))))
    graph = F.coalesce(declared("graph_selected", "graph_selected_tokens", "selected_tokens"), summed)
    told = declared("compiled", "compiled_tokens")
    closed = F.coalesce(declared("protocol_closed", "protocol_closed_tokens"), size("protocol_closed_messages"), at("metadata.protocol_closed_message_tokens"), at("metadata.protocol_closed_tokens"))
    said = declared("serialized_request", "serialized_request_tokens")
    estimated = F.coalesce(size("request"), size("serialized_request_payload"))
    rows = records.select(
        F.coalesce(F.get_json_object("value", "$.request_hash"), F.get_json_object("value", "$.branch_id"), F.substring(F.sha2("value", 256), 1, 24)).alias("record_id"),
        graph.alias("graph_selected"),
        F.coalesce(told, graph).alias("compiled"),
        closed.alias("protocol_closed"),
        F.coalesce(said, estimated).alias("serialized_request"),
        declared("provider_actual", "provider_actual_tokens", "prompt_tokens", "input_tokens").alias("provider_actual"),
        at("provider_token_oracle_headroom_bps").alias("bps"),
        F.coalesce(at("raw_serialized_request_tokens"), at("full_serialized_request_tokens")).alias("raw"),
        at("oracle_serialized_request_tokens").alias("oracle"),
        F.when(said.isNull() & estimated.isNotNull(), "deterministic_serialization_estimate").when(told.isNull() & graph.isNotNull(), "legacy_graph_proxy").otherwise("declared").alias("accounting_provenance"),
    )
    layers = ("graph_selected", "compiled", "protocol_closed", "serialized_request", "provider_actual")
    share = lambda a, b: F.when((F.col(b) != 0) & F.col(a).isNotNull(), (F.col(b) - F.col(a)) / F.col(b))
    headroom = F.when(F.col("bps").isNotNull(), F.col("bps") / 10_000).otherwise(share("oracle", "raw"))
    some = reduce(lambda x, y: x | y, [F.col(c).isNotNull() for c in layers])
    return rows.where(some).select("record_id", *layers, share("graph_selected", "protocol_closed").alias("closed_mismatch"), share("graph_selected", "serialized_request").alias("serialized_mismatch"), headroom.alias("headroom"), "accounting_provenance")


def leave_one_out(costs: DataFrame, parts: tuple[str, ...], keep: float = 0.7) -> DataFrame:
    """costs (point_id, domain, raw, compiled, hard_floor, a column for each part) with the marginal of each part, the fixed floor (policy and tools), and
    how far each could go: what raw costs without it, and the reductions that floors allow."""
    fixed = F.col("policy") + F.col("tools")
    share = lambda x: F.try_divide((F.col("raw") - x).cast("double"), F.col("raw"))
    return costs.withColumns({f"without_{p}": F.col("raw") - F.col(p) for p in parts} | {"fixed_floor": fixed, "fixed_floor_max_reduction": share(fixed), "hard_floor_reduction": share(F.col("hard_floor")), "current_reduction": share(F.col("compiled")), "target": F.floor(F.col("raw") * F.lit(keep)).cast("bigint")})


def attribution_summary(rows: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row overall and one a domain (null: overall): medians, rates of what must match, and, overall, whether the threshold can be reached.

    Any mismatch makes the measurement invalid; a floor that misses the threshold makes it unreachable; it is reachable only with a constructed
    request that covers all hard state. Points that occur again are an error.
    """
    if rows.groupBy("point_id").count().where("count > 1 or point_id is null").limit(1).count():
        raise ValueError("points must have ids of their own")
    flags = ("request_matches", "runtime_matches", "raw_matches", "compiled_matches", "policy_once", "tools_exact", "hard_covered")
    medians = ("raw", "compiled", "fixed_floor", "fixed_floor_max_reduction", "hard_floor", "hard_floor_reduction", "current_reduction")
    grouped = rows.groupingSets([[], ["domain"]], "domain").agg(F.grouping("domain").alias("overall"), F.count("*").alias("points"), *[F.median(F.col(c).cast("double")).alias(f"median_{c}") for c in medians], *[F.avg(F.coalesce(F.col(f), F.lit(False)).cast("double")).alias(f"{f}_rate") for f in flags])
    valid = reduce(lambda x, y: x & y, [F.col(f"{f}_rate") == 1.0 for f in flags[:-1]])
    decision = (
        F.when(~valid, "measurement_invalid")
        .when(F.col("median_fixed_floor_max_reduction") < threshold, "unreachable_under_frozen_fixed_cost")
        .when((F.col("median_hard_floor_reduction") >= threshold) & (F.col("hard_covered_rate") == 1.0), "reachable_with_verified_constructive_request")
        .otherwise("indeterminate_stop")
    )
    return grouped.withColumn("decision", F.when(F.col("overall") == 1, decision)).drop("overall")


def manifest_ids(rows: DataFrame, prefix: str, *parts: str) -> DataFrame:
    return rows.withColumn("manifest_id", stable_id(prefix, *[F.col(p) for p in parts]))
