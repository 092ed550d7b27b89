"""Labels that a model answers with, checked against what it was asked: three schemes, every fault of a response by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidline.operators.decisions import relation_boolean, relation_first
from braidline.sources.checked import Checked

# What a label may say.
DISPOSITIONS = ("live_critical", "live_noncritical", "safe_to_evict", "uncertain")
REASONS = ("active", "consumed", "superseded", "invalidated", "resolved", "duplicate", "audit_required", "unknown")
OBLIGATIONS = ("policy", "confirmation", "retry", "receipt", "audit")
NEEDS = ("required", "useful", "not_needed", "uncertain")
#: The fields of all schemes, and those of each.
FIELDS = ("span_id", "terminal_reason", "relation_target_ids", "obligations", "evidence_event_ids", "reactivation_risk")
SCHEMES = {"machine": ("disposition",), "relation": ("current_target_need",), "boolean": ("required_for_current_target", "requirement_uncertain")}


def read_labels(responses: DataFrame, expected: DataFrame, scheme: str) -> Checked:
    """Labels of responses (package_id, response: JSON text) that answer packages (package_id, span_ids, event_ids).

    A response is an object of one key, `labels`, a list with exactly one label for each span; a label has the fields of its scheme and no
    others, values that they allow, and names only spans and events of its package. One fault and the package has no rows. Where the scheme has no
    disposition, it follows from the label. Lists are sorted and repeat nothing. faults: (file: the package, fault, record: the label).
    """
    fields = sorted({*FIELDS, *SCHEMES[scheme]})
    lists = [f for f in ("relation_target_ids", "obligations", "evidence_event_ids") if f in fields]
    flags = [f for f in ("reactivation_risk", "required_for_current_target", "requirement_uncertain") if f in fields]
    body = F.try_parse_json("response").try_cast("map<string,variant>")
    both = expected.join(responses, "package_id", "left").withColumn("body", body)
    labels = F.try_element_at("body", F.lit("labels")).try_cast("array<variant>")
    shape = F.when(F.col("response").isNull(), "no response").when(F.col("body").isNull(), "no object").when((F.size("body") != 1) | ~F.map_contains_key("body", "labels"), "not labels alone").when(labels.isNull(), "labels are no list")
    both = both.withColumn("shape", shape).withColumn("labels", F.when(F.col("shape").isNull(), labels))
    rows = both.where("shape IS NULL").select("package_id", "span_ids", "event_ids", F.explode("labels").alias("raw")).withColumn("m", F.col("raw").try_cast("map<string,variant>"))
    value = lambda f: F.try_element_at("m", F.lit(f))
    rows = rows.withColumns({f: value(f).try_cast("string") for f in fields if f not in (*lists, *flags)} | {f: F.array_sort(F.array_distinct(value(f).try_cast("array<string>"))) for f in lists} | {f: F.when(F.schema_of_variant(value(f)) == "BOOLEAN", value(f).try_cast("boolean")) for f in flags})
    among = lambda c, allowed: F.coalesce(c.isin(*allowed), F.lit(False))
    inside = lambda f, all_: F.size(F.array_except(f, all_)) == 0
    strange: list[Column] = [
        F.when(F.col("m").isNull() | (F.array_sort(F.map_keys("m")) != F.array(*[F.lit(f) for f in fields])), "missing or further fields"),
        F.when(~F.coalesce(F.array_contains("span_ids", F.col("span_id")), F.lit(False)), "unknown span"),
        F.when(~among(F.col("terminal_reason"), REASONS), "unknown reason"),
        *[F.when(F.col(f).isNull(), f"no list: {f}") for f in lists],
        *[F.when(F.col(f).isNull(), f"not true or false: {f}") for f in flags],
        F.when(~inside("relation_target_ids", F.col("span_ids")), "unknown target"),
        F.when(~inside("obligations", F.array(*[F.lit(o) for o in OBLIGATIONS])), "unknown obligation"),
        F.when(~inside("evidence_event_ids", F.col("event_ids")), "unknown evidence"),
    ]
    if scheme == "machine":
        strange.append(F.when(~among(F.col("disposition"), DISPOSITIONS), "unknown disposition"))
    if scheme == "relation":
        strange.append(F.when(~among(F.col("current_target_need"), NEEDS), "unknown need"))
    rows = rows.withColumn("strange", F.filter(F.array(*strange), lambda s: s.isNotNull()))
    of_labels = rows.select(F.col("package_id").cast("string").alias("file"), F.explode("strange").alias("fault"), F.to_json("raw").alias("record"))
    named = F.transform("labels", lambda label: F.try_element_at(label.try_cast("map<string,variant>"), F.lit("span_id")).try_cast("string"))
    cover = F.when(F.array_sort(named) != F.array_sort(F.array_distinct("span_ids")), "missing or repeated spans")
    of_packages = both.select(F.col("package_id").cast("string").alias("file"), F.coalesce("shape", cover).alias("fault"), F.col("response").alias("record")).where("fault IS NOT NULL")
    faults = of_labels.unionByName(of_packages).withColumn("record", F.substring("record", 1, 1000))
    good = rows.join(faults.select(F.col("file").alias("bad")).distinct(), F.col("package_id").cast("string") == F.col("bad"), "left_anti")
    obliged = F.size("obligations") > 0
    if scheme == "relation":
        good = good.withColumn("disposition", relation_first(F.col("terminal_reason"), F.col("current_target_need"), obliged, F.col("reactivation_risk")))
    if scheme == "boolean":
        good = good.withColumn("disposition", relation_boolean(F.col("terminal_reason"), F.col("required_for_current_target"), F.col("requirement_uncertain"), obliged, F.col("reactivation_risk")))
    return Checked(good.select("package_id", *sorted({*fields, "disposition"})), faults)
