"""Named sets of gates over one row of metrics. A gate passes only on evidence: a metric that is missing or null fails.

A set is a tuple of (gate, metric, comparator, threshold); metrics are columns of one row, booleans counting as 0 and 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidline.operators.stats import gates as adjudicate

Gates = tuple[tuple[str, str, str, float], ...]


def _all(names: str, comparator: str, threshold: float) -> Gates:
    return tuple((n, n, comparator, threshold) for n in names.split())


# The thresholds that reports are judged by.
STAGE_ONE: Gates = (
    ("minimum_task_success_rate", "task_success_rate", "at_least", 0.5),
    ("minimum_normal_stop_rate", "normal_stop_rate", "at_least", 0.9),
    ("minimum_median_tool_calls", "median_tool_calls", "at_least", 5.0),
    ("minimum_median_estimated_tokens", "median_trajectory_tokens", "at_least", 4096.0),
    ("maximum_infrastructure_error_rate", "infrastructure_error_rate", "at_most", 0.05),
)
PRUNE_OFFLINE: Gates = (
    _all("all_frozen_prefixes_included", "equal", 1.0)
    + _all("source_load_determinism_rate frozen_prefix_hash_match_rate deterministic_artifact_rate future_suffix_independence_rate protocol_valid_rate root_event_recall critical_event_recall archive_reactivation_rate request_hash_match_rate", "at_least", 1.0)
    + _all("policy_false_dead confirmation_false_dead side_effect_receipt_false_dead", "at_most", 0.0)
    + _all("cost_analysis_eligible reduced_prefix_count", "at_least", 1.0)
    + _all("paired_median_serialized_token_delta", "below", 0.0)
    + _all("external_provider_generations", "at_most", 0.0)
)
CHAIN_CONSTRUCT: Gates = (
    *_all("complete human_independent_annotations", "equal", 1.0),
    ("chains", "chain_count", "at_least", 60.0),
    ("agreement", "cohen_kappa", "at_least", 0.7),
    ("actionable_precision", "actionable_precision", "at_least", 0.75),
    ("actionable_recall", "actionable_recall", "at_least", 0.75),
    ("expiry_precision", "expiry_precision", "at_least", 0.9),
    ("scope_error", "operation_scope_aggregation_error_rate", "at_most", 0.1),
)
CARD_MECHANISM: Gates = (
    *_all("engineering_passed construct_passed matrix_complete failure_types_consistent", "equal", 1.0),
    ("usage_complete", "usage_coverage", "equal", 1.0),
    ("cards_bounded", "budget_infeasible_sessions", "equal", 0.0),
    ("no_raw_replay", "mean_raw_failures_selected", "equal", 0.0),
    ("input_falls", "raw_input_ci_high", "below", 0.0),
    ("protocol_falls", "raw_protocol_ci_high", "below", 0.0),
    ("repeats_do_not_rise", "raw_repeat_ci_high", "at_most", 0.0),
    ("mechanism_improves", "remove_repeat_or_recovery_ci_high", "below", 0.0),
    ("success_not_inferior_to_raw", "raw_success_ci_low", "at_least", -0.05),
    ("success_not_inferior_to_removal", "remove_success_ci_low", "at_least", -0.05),
)
REPLAY_ENGINEERING: Gates = (
    *_all("inputs_immutable construct_complete provenance_stated protocol_faults_found replay_complete", "equal", 1.0),
    ("migrated", "migrated_key_count", "equal", 60.0),
    ("clean_sheets", "clean_sheet_count", "equal", 60.0),
    ("adjudicated", "unresolved_adjudications", "equal", 0.0),
    ("sessions", "session_count", "equal", 60.0),
    ("events", "event_count", "at_least", 1.0),
    ("views_aligned", "views_missing", "equal", 0.0),
    ("usage_events", "usage_missing", "equal", 0.0),
    ("cards_seen", "card_visible_actions", "at_least", 1.0),
    ("replay_observed", "raw_replay_observed", "at_least", 1.0),
    ("no_raw_replay", "raw_replay_actions", "equal", 0.0),
)
REPLAY_CLAIM: Gates = _all("engineering_passed human_gold fork_complete mechanism_identified safety_passed type_robust", "equal", 1.0)
REPRESENTATION_HARM: Gates = (
    *_all("complete_branches treatment_injection snapshot_and_hashes", "equal", 1.0),
    ("compiled_input_reduction", "median_input_reduction", "at_least", 0.15),
    ("no_unique_policy_or_side_effect", "unique_policy_prefixes", "equal", 0.0),
    ("harm_at_most_one_prefix", "unique_harm_prefixes", "at_most", 1.0),
    ("discordance_identifiable", "discordant_prefixes", "at_least", 5.0),
    ("majority_supports_compiled", "compiled_better_share", "above", 0.5),
)
POSITIVE_EVIDENCE: Gates = (
    *_all("matrix_complete measurements_complete", "equal", 1.0),
    ("input_reduction", "input_reduction", "at_least", 0.15),
    ("input_ci_below_zero", "input_ci_high", "below", 0.0),
    ("net_cost_falls", "net_cost_delta", "below", 0.0),
    ("success_not_inferior", "success_ci_low", "at_least", -0.05),
    ("policy_not_worse", "policy_delta", "at_most", 0.0),
    ("behaviour_not_worse", "behaviour_delta", "at_most", 0.0),
    ("beats_baseline", "matched_advantage", "equal", 1.0),
    ("domains_agree", "domains_agreeing_share", "equal", 1.0),
)
PREFLIGHT: Gates = _all("registry_complete registry_unique prefixes_hashed protocol_valid", "equal", 1.0) + _all("outcome_leaks secret_leaks", "equal", 0.0)
PSEUDO_LABELS: Gates = _all("schema_valid_rate pass_alignment_rate provenance_rate", "at_least", 1.0) + (("safe_agreement", "safe_agreement", "at_least", 0.9), ("safe_kappa", "safe_kappa", "at_least", 0.7), ("false_safe", "false_safe", "equal", 0.0))
SETS: dict[str, Gates] = {name.lower(): value for name, value in list(globals().items()) if name.isupper() and isinstance(value, tuple)}


def report(metrics: DataFrame, name: str) -> DataFrame:
    """(gate, metric, comparator, threshold, value, passed) of a named set over one row of metrics."""
    rules = SETS[name]
    spark = metrics.sparkSession
    there = {c.lower(): c for c in metrics.columns}
    used = {m for _, m, _, _ in rules}
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(there[m.lower()]).cast("double").alias("value")) for m in sorted(used) if m.lower() in there]
    values = metrics.limit(1).select(F.explode(F.array(*pairs)).alias("p")).select("p.*") if pairs else spark.createDataFrame([], "metric string, value double")
    return adjudicate(values, spark.createDataFrame(list(rules), "gate string, metric string, comparator string, threshold double"))


def decision(verdicts: DataFrame) -> DataFrame:
    """One row: whether all gates passed, and the blockers in order."""
    return verdicts.agg(F.min("passed").alias("passed"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("gate")))), ",").alias("blockers"))
