"""Checks that fail closed: risk of omissions, representations, negative guards, compilations, labels, and keys that may not be there."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

# Names and words that checks look for.
NEVER_OMIT = ("active_goal", "open_subgoal", "unknown_slot", "confirmation_requirement", "global_policy_rule", "applicable_policy_rule", "critical_evidence", "side_effect_receipt", "pending_operation")
GENERIC_ALTERNATIVES = ("change arguments", "change arguments or use alternative path", "retry with different arguments", "use alternative path", "try again")
VERIFIERS = ("schema:", "policy:", "environment:", "successful_path:")
SECRET_PARTS = ("api_key", "secret", "credential", "password", "access_token")
OUTCOME_KEYS = frozenset("outcome reward task_success tool_names side_effect tool_call_count".split())


def risk_mask(atoms: DataFrame, form: Column, pending: DataFrame) -> DataFrame:
    """atoms with probability, omit_allowed and reasons: what is hard, protected, blocking, awaited or not recoverable is never left out.

    form: how the atom would be shown; pending: (session_id, atom_id) that the query awaits. blocking and archived are columns of atoms.
    """
    rows = atoms.join(pending.distinct().withColumn("awaited", F.lit(True)), ["session_id", "atom_id"], "left")
    reasons = F.sort_array(
        F.filter(
            F.array(
                F.when(F.col("hard"), "hard_atom"),
                F.when(F.col("atom_type").isin(*NEVER_OMIT), F.concat(F.lit("protected_type:"), F.col("atom_type"))),
                F.when(F.col("blocking"), "unresolved_blocking_state"),
                F.when(F.col("awaited"), "pending_confirmation"),
                F.when((form == "archive_handle") & ~F.col("archived"), "unrecoverable_archive"),
            ),
            lambda x: x.isNotNull(),
        )
    )
    rows = rows.withColumn("reasons", reasons).drop("awaited")
    soft = F.when(F.col("status") == "conflicting", 0.9).when(F.col("status") == "superseded", 0.01).when(~F.col("archived"), 0.1).otherwise(0.05)
    return rows.withColumns({"omit_allowed": F.size("reasons") == 0, "probability": F.when(F.size("reasons") > 0, 1.0).otherwise(soft)})


def logistic_risk(masked: DataFrame, intercept: float, weights: dict[str, float], threshold: float, metrics: dict[str, float]) -> DataFrame:
    """masked with the risk of a fitted model where the mask allows an omission, and the mask's own if the model has not earned its place."""
    trusted = metrics.get("harm_positives", 0) >= 20 and metrics.get("recall", 0) >= 0.9 and metrics.get("ece", 1) <= 0.1 and metrics.get("brier", 1) < metrics.get("constant_brier", 0)
    if not trusted:
        return masked.withColumn("reasons", F.when(F.col("omit_allowed"), F.array_append("reasons", F.lit("statistical_model_gate_failed"))).otherwise(F.col("reasons")))
    z = F.lit(float(intercept))
    for name, w in weights.items():
        z = z + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * float(w)
    p = F.when(F.col("omit_allowed"), 1 / (1 + F.exp(-z))).otherwise(F.col("probability"))
    return masked.withColumn("probability", p).withColumns({"reasons": F.when(F.col("omit_allowed"), F.array(F.lit("calibrated_logistic_prediction"))).otherwise(F.col("reasons")), "omit_allowed": F.col("omit_allowed") & (F.col("probability") < threshold)})


def guard_errors(guards: DataFrame) -> DataFrame:
    """guards (guard_id, predicate, verifier, alternatives, evidence, sources) with errors: what makes a negative guard unfit."""
    plain = F.transform("alternatives", lambda x: F.lower(F.trim(x)))
    known = F.lit(False)
    for v in VERIFIERS:
        known = known | F.col("verifier").startswith(v)
    errors = F.array(
        F.when(F.size("sources") == 0, "no_source"),
        F.when(F.coalesce("predicate", F.lit("")) == "", "no_predicate"),
        F.when(~F.coalesce(known, F.lit(False)), "verifier_not_allowed"),
        F.when(F.arrays_overlap(plain, F.array(*[F.lit(x) for x in GENERIC_ALTERNATIVES])), "generic_alternative"),
        F.when((F.size("alternatives") == 0) & (F.size("evidence") == 0), "nothing_admissible"),
    )
    return guards.withColumn("errors", F.filter(errors, lambda x: x.isNotNull()))


def representation_errors(candidates: DataFrame, atoms: DataFrame, archive: DataFrame) -> DataFrame:
    """candidates (session_id, candidate_id, form, atom_id, claimed_key, claimed_value, raw_ref, reason) with errors: claims must equal verified atoms, handles must be in the archive, omissions need a reason."""
    known = atoms.select("session_id", "atom_id", F.col("key").alias("a_key"), F.col("value").alias("a_value"), F.col("verified").alias("a_verified"))
    # Only what handles name is looked up, once a session, however many candidates share a digest.
    asked = candidates.where("form = 'archive_handle' and raw_ref is not null").select("session_id", "raw_ref").distinct()
    stored = asked.join(archive.select(F.col("digest").alias("raw_ref")), "raw_ref", "left_semi").withColumn("stored", F.lit(True))
    rows = candidates.join(known, ["session_id", "atom_id"], "left").join(stored, ["session_id", "raw_ref"], "left")
    claims = F.col("form").isin("verified_summary", "structured_state_delta")
    errors = F.array(
        F.when(claims & F.col("a_key").isNull(), "unknown_atom"),
        F.when(claims & ~F.col("a_verified"), "unverified_atom"),
        F.when(claims & (~F.col("claimed_key").eqNullSafe(F.col("a_key")) | ~F.col("claimed_value").eqNullSafe(F.col("a_value"))) & F.col("a_key").isNotNull(), "claim_mismatch"),
        F.when((F.col("form") == "archive_handle") & F.col("stored").isNull(), "archive_round_trip_failed"),
        F.when((F.col("form") == "omit") & (F.coalesce("reason", F.lit("")) == ""), "omission_without_reason"),
    )
    return rows.withColumn("errors", F.filter(errors, lambda x: x.isNotNull())).drop("a_key", "a_value", "a_verified", "stored")


def compilation_checks(atoms: DataFrame, selected: DataFrame, events: DataFrame, protocol: DataFrame, costs: DataFrame) -> DataFrame:
    """(session_id, check, ok, errors): hard coverage, provenance, protocol and budget of each compiled context.

    selected: (session_id, form, atom_id, sources); events: (session_id, node_id); protocol: (session_id) with errors; costs: (session_id, cost, soft, hard, infeasible).
    """
    sessions = costs.select("session_id")
    shown = selected.where("form <> 'omit'").select("session_id", "atom_id").distinct()
    uncovered = atoms.where("hard").select("session_id", "atom_id").distinct().join(shown, ["session_id", "atom_id"], "left_anti")
    sources = selected.select("session_id", F.explode("sources").alias("node_id")).distinct().join(events, ["session_id", "node_id"], "left_anti")
    unknown = selected.select("session_id", "atom_id").distinct().join(atoms, ["session_id", "atom_id"], "left_anti")
    over = costs.where("cost > hard or (cost > soft and not infeasible)")
    found = None
    for name, bad in (("hard_coverage", uncovered), ("provenance", sources.select("session_id").unionAll(unknown.select("session_id"))), ("protocol", protocol), ("budget", over)):
        counts = sessions.join(bad.groupBy("session_id").agg(F.count("*").alias("errors")), "session_id", "left").fillna(0, ["errors"])
        rows = counts.select("session_id", F.lit(name).alias("check"), (F.col("errors") == 0).alias("ok"), "errors")
        found = rows if found is None else found.union(rows)
    return found


def label_errors(labels: DataFrame, items: DataFrame, key: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, error): labels for unknown items, items without a label or with several, and values that a field does not allow."""
    twice = labels.groupBy(key).count().where("count > 1").select(key, F.lit("repeated").alias("error"))
    missing = items.select(key).join(labels.select(key), key, "left_anti").select(key, F.lit("missing").alias("error"))
    unknown = labels.select(key).join(items.select(key), key, "left_anti").select(key, F.lit("unknown_item").alias("error"))
    wrong = F.array(*[F.when(~F.coalesce(F.col(f).isin(*v), F.lit(False)), f"value:{f}") for f, v in allowed.items()])
    values = labels.select(key, F.explode(F.filter(wrong, lambda x: x.isNotNull())).alias("error"))
    return twice.union(missing).union(unknown).union(values)


def converted_labels(labels: DataFrame) -> DataFrame:
    """Labels of the first scheme (expiry_trigger, same_operation_scope, relation, failure_class, card_covers_next_step) in the second, with the fields that lose something."""
    expiry = F.coalesce("expiry_trigger", F.lit("unclear"))
    scope, relation = F.coalesce("same_operation_scope", F.lit("unclear")), F.coalesce("relation", F.lit("unclear"))
    kept = expiry.isin(*CAUSES)
    related = F.when(scope == "yes", "same_operation").when(scope == "no", "different_operation").when(scope == "unclear", "unclear").when(relation == "alternative_completed", "alternative_completion").when(relation == "corrected_syntax", "syntax_correction").when(scope == "not_applicable", "not_applicable")
    return labels.select(
        "*",
        F.when(expiry == "still_active", "yes").when(expiry == "unclear", "unclear").otherwise("no").alias("should_card_remain_active"),
        F.when(kept, expiry).when(expiry.isin("terminal", "stale"), "other").otherwise("unclear").alias("expiry_cause"),
        F.coalesce(related, F.lit("unclear")).alias("scope_relation"),
        F.filter(F.array(F.when(~kept, "expiry_cause"), F.when(related.isNull(), "scope_relation")), lambda x: x.isNotNull()).alias("lossy"),
    )


# What a card may end by, in the second scheme of labels.
CAUSES = ("still_active", "resolved", "superseded", "alternative_completed", "user_abandoned", "constraint_changed", "final_accepted", "corrected_syntax", "ttl_expired", "other", "unclear")


def complete_scalar(content: Column, wrapper: str = ".*", booleans: bool = True) -> Column:
    """The one scalar of a JSON text, bare or under a single key that matches wrapper, as (kind, value); null if there is more. booleans: whether they count."""
    value = F.try_parse_json(content)
    kinds = "BIGINT|DECIMAL|DOUBLE|FLOAT|STRING" + ("|BOOLEAN" if booleans else "")

    def scalar(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        name = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").otherwise(F.lower(kind))
        return F.when(kind.rlike(f"^({kinds})"), F.struct(name.alias("kind"), x.cast("string").alias("value")))

    keys = F.json_object_keys(content)
    inner = F.try_variant_get(value, "$", "map<string,variant>")
    alone = F.when((F.size(keys) == 1) & F.get(keys, 0).rlike(f"^(?:{wrapper})$"), scalar(F.get(F.map_values(inner), 0)))
    return F.coalesce(scalar(value), alone)


def reject_secrets(value: Any, path: str = "config") -> None:
    """Configuration may hold no key that names a secret."""
    for key, child in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        if isinstance(key, str) and any(part in key.lower() for part in SECRET_PARTS):
            raise ValueError(f"a secret may not be in {path}.{key}")
        reject_secrets(child, f"{path}.{key}")


def reject_outcomes(df: DataFrame, forbidden: frozenset[str] = OUTCOME_KEYS, exempt: str = "structural_features") -> DataFrame:
    """df, if no column or field at any depth tells how a run ended; what lies right under exempt may have such names."""

    def visit(kind: DataType, path: str) -> None:
        if isinstance(kind, StructType):
            for field in kind.fields:
                if field.name in forbidden and not path.endswith(f".{exempt}"):
                    raise ValueError(f"an outcome may not be in {path}.{field.name}")
                visit(field.dataType, f"{path}.{field.name}")
        elif isinstance(kind, ArrayType):
            visit(kind.elementType, f"{path}[]")
        elif isinstance(kind, MapType):
            visit(kind.valueType, f"{path}{{}}")

    visit(df.schema, "manifest")
    return df


def require(config: dict[str, Any], positive: tuple[str, ...] = (), patterns: dict[str, str] | None = None, unique: tuple[str, ...] = ()) -> dict[str, Any]:
    """config, if it holds no secret, the named numbers are positive, the named texts match, and the named lists repeat nothing."""
    reject_secrets(config)
    for name in positive:
        if not isinstance(config.get(name), int) or isinstance(config[name], bool) or config[name] <= 0:
            raise ValueError(f"{name} must be a positive integer")
    for name, pattern in (patterns or {}).items():
        if not isinstance(config.get(name), str) or not re.fullmatch(pattern, config[name]):
            raise ValueError(f"{name} must match {pattern}")
    for name in unique:
        items = config.get(name)
        if not isinstance(items, list) or not items or len(items) != len({repr(x) for x in items}):
            raise ValueError(f"{name} must be a list without repetitions")
    return config
