"""Annotation and reports: blind packages, two annotators and an adjudicator, two passes, disagreements of runs, spines and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidline.functions.identity import hash_share, numbered, split_name, stable_id


def packages(items: DataFrame, key: str, seed: str, annotators: tuple[str, ...] = ("a", "b")) -> tuple[DataFrame, DataFrame]:
    """(sheets (annotator, place, annotation_id, and the columns of items but the key), key (annotation_id, key)).

    Ids tell nothing: they follow the order of a hash of seed and key. Every annotator has an order of their own.
    """
    ranked = items.withColumn("rank_", F.sha2(F.concat(F.lit(seed + "\0"), F.col(key).cast("string")), 256))
    named = numbered(ranked, "rank_", key).withColumn("annotation_id", F.concat(F.lit("item_"), F.lpad(F.col("n").cast("string"), 6, "0"))).drop("n", "rank_")
    sheets = None
    for a in annotators:
        mine = named.drop(key).withColumn("order_", F.sha2(F.concat(F.lit(f"{seed}\0{a}\0"), F.col("annotation_id")), 256))
        mine = numbered(mine, "order_", "annotation_id").withColumnRenamed("n", "place").withColumn("annotator", F.lit(a)).drop("order_")
        sheets = mine if sheets is None else sheets.unionByName(mine)
    return sheets, named.select("annotation_id", key)


def adjudicated(a: DataFrame, b: DataFrame, key: str, fields: list[str], decisions: DataFrame | None = None) -> DataFrame:
    """(key, for each field what a and b say and the gold), of two annotators of the same items; unlike items are an error.

    gold is what both say, else what decisions (key, field, value) says; unresolved tells how many fields of an item have none.
    """
    both = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    lone = both.where(F.col(f"a.{key}").isNull() | F.col(f"b.{key}").isNull()).limit(1).count()
    if lone:
        raise ValueError("the annotators do not have the same items")
    rows = both.select(F.col(f"a.{key}").alias(key), *[F.col(f"{s}.{f}").alias(f"{f}_{s}") for f in fields for s in "ab"])
    if decisions is not None:
        wide = decisions.groupBy(key).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"{f}_decided") for f in fields])
        rows = rows.join(wide, key, "left")
    else:
        rows = rows.withColumns({f"{f}_decided": F.lit(None).cast("string") for f in fields})
    gold = {f: F.when(F.col(f"{f}_a").eqNullSafe(F.col(f"{f}_b")), F.col(f"{f}_a").cast("string")).otherwise(F.col(f"{f}_decided")) for f in fields}
    rows = rows.withColumns({f"{f}_gold": c for f, c in gold.items()}).drop(*[f"{f}_decided" for f in fields])
    return rows.withColumn("unresolved", reduce(lambda x, y: x + y, [F.col(f"{f}_gold").isNull().cast("int") for f in fields]))


def pass_agreement(a: DataFrame, b: DataFrame, key: list[str], fields: list[str], safe: str, value: str) -> DataFrame:
    """One row overall and one for each first column of key (null: overall): units, how often the passes agree on each field, on all, and on whether `safe` is value."""
    both = a.alias("a").join(b.alias("b"), key)
    same = {f: (F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))) for f in fields}
    rows = both.select(*key, *[c.alias(f"same_{f}") for f, c in same.items()], (F.col(f"a.{safe}") == value).alias("a_safe"), (F.col(f"b.{safe}") == value).alias("b_safe"), reduce(lambda x, y: x & y, same.values()).alias("all_same"))
    n = lambda c: F.sum(c.cast("bigint"))
    return rows.groupingSets([[], [key[0]]], key[0]).agg(
        F.count("*").alias("units"),
        *[F.avg(F.col(f"same_{f}").cast("double")).alias(f"agree_{f}") for f in fields],
        n(F.col("all_same")).alias("full_consensus"),
        n(F.col("all_same") & F.col("a_safe")).alias("consensus_safe"),
        n(F.col("a_safe")).alias("a_safe"),
        n(F.col("b_safe")).alias("b_safe"),
        F.avg((F.col("a_safe") == F.col("b_safe")).cast("double")).alias("safe_agreement"),
    )


#: Pairs of runs by what is to be looked at first.
TIERS = ("disagreement_with_failure", "disagreement", "agreement_with_failure", "agreement")


def direction(reference: Column, other: Column) -> Column:
    return F.when(reference & other, "both_success").when(reference, "reference_only_success").when(other, "comparator_only_success").otherwise("neither_success")


def tier(apart: Column, failing: Column) -> Column:
    return F.when(apart & failing, TIERS[0]).when(apart, TIERS[1]).when(failing, TIERS[2]).otherwise(TIERS[3])


def disagreements(runs: DataFrame, reference: str, comparator: str) -> DataFrame:
    """(domain, task, trial, direction, tier, token_delta, signals, place) of the pairs of two conditions, in the order in which they are to be looked at.

    runs: (domain, task, trial, condition, success, selected_tokens, failure_signals). Pairs without the comparator have no direction.
    """
    key = ["domain", "task", "trial"]
    left = runs.where(F.col("condition") == reference).select(*key, F.col("success").alias("r"), F.col("selected_tokens").alias("rt"), F.col("failure_signals").alias("rs"))
    right = runs.where(F.col("condition") == comparator).select(*key, F.col("success").alias("c"), F.col("selected_tokens").alias("ct"), F.col("failure_signals").alias("cs"))
    both = left.join(right, key, "left")
    signals = F.col("rs") + F.col("cs")
    here = F.col("c").isNotNull()
    rows = both.select(*key, F.when(here, direction(F.col("r"), F.col("c"))).alias("direction"), F.when(here, tier(F.col("r") != F.col("c"), signals > 0)).alias("tier"), (F.col("ct").cast("double") - F.col("rt")).alias("token_delta"), signals.alias("signals"))
    rank = reduce(lambda c, i: c.when(F.col("tier") == TIERS[i], i), range(1, len(TIERS)), F.when(F.col("tier") == TIERS[0], 0)).otherwise(len(TIERS))
    order = Window.partitionBy("domain").orderBy(rank, F.col("signals").desc_nulls_last(), "task", "trial")
    return rows.withColumn("place", F.row_number().over(order).cast("bigint"))


def spined(rows: DataFrame, spine: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """(by, n, mean of each measure) for every group of a spine, and for every value of its first column (the second is null): empty groups are rows without means."""
    first, second = by
    agg = [F.count(first).alias("n"), *[F.avg(F.col(m).cast("double")).alias(f"mean_{m}") for m in measures]]
    here = spine.join(rows.groupBy(*by).agg(*agg), by, "left")
    upper = spine.select(first).distinct().join(rows.groupBy(first).agg(*agg), first, "left").withColumn(second, F.lit(None).cast(spine.schema[second].dataType))
    return here.unionByName(upper).fillna(0, ["n"])


def manifest(points: DataFrame, features: DataFrame, declared: DataFrame) -> DataFrame:
    """(prefix_id, session_id, domain, task, split, prefix_hash, manifest_id, and the features) of every decision point, without any outcome.

    points: (prefix_id, session_id, domain, task, payload); declared: (prefix_id, prefix_hash). A hash that differs, or points that occur again, are errors.
    """
    hashed = points.withColumn("actual", F.sha2("payload", 256)).join(declared, "prefix_id", "left")
    bad = hashed.where(~F.col("actual").eqNullSafe(F.col("prefix_hash"))).select("prefix_id").limit(3).collect()
    twice = points.groupBy("prefix_id").count().where("count > 1").limit(3).collect()
    if bad or twice:
        raise ValueError(f"prefixes that were changed: {[r.prefix_id for r in bad]}, points that occur again: {[r.prefix_id for r in twice]}")
    rows = hashed.join(features, "session_id", "left").drop("payload", "actual")
    split = split_name(hash_share(F.col("domain"), F.col("task")))
    return rows.withColumns({"split": split, "manifest_id": stable_id("prefix", F.col("prefix_id"), F.col("prefix_hash"))})


def withheld(projections: DataFrame) -> DataFrame:
    """Projections that only measure how far a cut could go: marked so that nothing sends them."""
    return projections.withColumns({"offline_only": F.lit(True), "send_eligible": F.lit(False)})


def sendable(projections: DataFrame) -> DataFrame:
    """projections, if none is marked as measured only."""
    if "offline_only" in projections.columns and projections.where("offline_only or not send_eligible").limit(1).count():
        raise ValueError("a projection that only measures may not be sent")
    return projections
