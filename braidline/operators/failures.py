"""Failures of exchanges: chains and expiry, windows after a failure, slots and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_session() -> WindowSpec:
    return Window.partitionBy("session_id")


def by_key() -> WindowSpec:
    return Window.partitionBy("session_id", "k").orderBy("ordinal")


def unresolved(ex: DataFrame) -> DataFrame:
    """Failures that no later exchange of their operation follows."""
    return ex.withColumn("next", F.lead("ordinal").over(by_key())).where("err and next is null").drop("next")


def operation_failures(ex: DataFrame, ttl_steps: int = 8) -> DataFrame:
    """The chain of failures of each operation of a session, from the exchanges alone (cards.failure_cards has the whole cards): the latest one's place and expiry, the first one's step.

    A card is resolved or superseded if a later exchange of the operation succeeded or failed; else it expires
    when the session has gone on for more than ttl_steps.
    """
    last_step = F.max("ordinal").over(by_session())
    rows = ex.withColumns({"next_err": F.lead("err").over(by_key()), "last_step": last_step}).where("err")
    cards = rows.groupBy("session_id", "k").agg(
        F.max_by(F.struct("ordinal", "next_err", "last_step", "tool_name"), "ordinal").alias("l"),
        F.min("ordinal").alias("created_step"),
        F.count("*").alias("chain"),
    )
    cards = cards.select("session_id", "k", "created_step", "chain", F.col("l.ordinal").alias("last_step"), F.col("l.next_err").alias("next_err"), F.col("l.last_step").alias("session_step"), F.col("l.tool_name").alias("action_family"))
    trigger = F.when(~F.col("next_err"), "resolved").when(F.col("next_err"), "superseded").when(F.col("last_step") < F.col("session_step") - ttl_steps, "ttl_expired")
    return cards.select(
        "session_id",
        "k",
        F.concat(F.lit("failure_card_"), F.substring(F.sha2(F.concat_ws(":", F.col("session_id"), F.col("k")), 256), 1, 16)).alias("card_id"),
        "action_family",
        "created_step",
        F.col("last_step").alias("last_relevant_step"),
        F.col("chain"),
        trigger.alias("expiry_trigger"),
        trigger.isNull().alias("active"),
    )


def post_failure_windows(ex: DataFrame, horizon: int = 3) -> DataFrame:
    """For each failure, the next horizon exchanges: how many were seen, and at which one its operation was tried again and recovered.

    Ordinals of a session have no gaps, so the windows are frames over it: no join, and one sort.
    """
    ahead = Window.partitionBy("session_id").orderBy("ordinal").rowsBetween(1, horizon)
    following = F.collect_list(F.struct("ordinal", "k", "err")).over(ahead)
    rows = ex.withColumns({"window": following, "next_same": F.lead("ordinal").over(by_key()), "next_same_err": F.lead("err").over(by_key())}).where("err")
    near = F.col("next_same") <= F.col("ordinal") + horizon
    recovered = F.coalesce(near & ~F.col("next_same_err"), F.lit(False))
    return rows.select(
        "session_id",
        "ordinal",
        "k",
        F.size("window").cast("bigint").alias("observed_actions"),
        (F.size("window") < horizon).alias("window_censored"),
        F.size(F.filter("window", lambda x: (x["k"] == F.col("k")) & x["err"])).cast("bigint").alias("repeated_invalid"),
        recovered.alias("resolved_within_window"),
        F.when(recovered, F.col("next_same") - F.col("ordinal")).alias("recovery_action_index"),
    )


def trace_window(ex: DataFrame, before: int = 2, after: int = 5) -> DataFrame:
    """How many exchanges and failures lie around each failure, in steps."""
    around = Window.partitionBy("session_id").orderBy("ordinal").rangeBetween(-before, after)
    return ex.withColumns({"seen": F.count("*").over(around), "failures": F.sum(F.col("err").cast("bigint")).over(around)}).where("err").select("session_id", "ordinal", "seen", "failures")


def slot_state(ex: DataFrame) -> DataFrame:
    """The value of each slot (session, tool): what is not from its latest step is superseded, several values there are conflicting."""
    slot = Window.partitionBy("session_id", "tool_name")
    ok = ex.where("not err").withColumn("latest", F.max("ordinal").over(slot))
    at_latest = F.size(F.collect_set(F.when(F.col("ordinal") == F.col("latest"), F.col("k"))).over(slot))
    return ok.select("session_id", "tool_name", "ordinal", "k", F.when(F.col("ordinal") < F.col("latest"), "superseded").when(at_latest > 1, "conflicting").otherwise("current").alias("status"))


def field_versions(ex: DataFrame) -> DataFrame:
    """Running count of successful writes for each (session, operation)."""
    upto = by_key().rowsBetween(Window.unboundedPreceding, 0)
    return ex.select("session_id", "k", "ordinal", F.sum((~F.col("err") & F.col("side_effect")).cast("bigint")).over(upto).alias("version"))


def session_failures(ex: DataFrame) -> DataFrame:
    """Failures, retries, recoveries and repeated failures of each session."""
    again = F.coalesce("prev_err", F.lit(False))
    return ex.groupBy("session_id").agg(
        F.count("*").alias("actions"),
        F.sum(F.col("err").cast("bigint")).alias("failures"),
        F.sum(again.cast("bigint")).alias("retries"),
        F.sum((again & ~F.col("err")).cast("bigint")).alias("resolved"),
        F.sum((again & F.col("err")).cast("bigint")).alias("repeated_failures"),
    )
