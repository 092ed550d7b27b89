"""Queries whose work is done by functions registered with the session and named in SQL text."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidline.functions import extension
from braidline.operators import context
from braidline.plans import states
from braidline.plans.contexts import NODES
from braidline.plans.registry import Registry
from braidline.sources.adapters import conversation_nodes

R = Registry()


def _view(df: DataFrame) -> str:
    name = f"v_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return name


@R.add("span_groups_sql", states.R.oracles["span_groups"])
def span_groups_sql(t):
    """The spans of waiting stories by the table function, a partition for each session."""
    n, e = states.waiting(t)
    spark = n.sparkSession
    extension.register_span_groups(spark)
    nodes, edges = _view(n), _view(e.where("edge_type IN ('produces', 'failed_with')"))
    return spark.sql(
        f"""WITH placed AS (SELECT n.session_id, n.node_id, n.node_type, n.ordinal, e.source AS call FROM {nodes} n LEFT JOIN {edges} e ON e.session_id = n.session_id AND e.target = n.node_id),
        spans AS (SELECT * FROM span_groups(TABLE(SELECT * FROM placed) PARTITION BY session_id ORDER BY ordinal)),
        sized AS (SELECT session_id, span_type, span_id, count(*) AS members FROM spans GROUP BY ALL)
        SELECT session_id, span_type, count(*) AS spans, max(members) AS largest, min(members) AS smallest, sum(members) AS nodes FROM sized GROUP BY session_id, span_type"""
    )


def words(texts: pd.Series) -> pd.Series:
    return texts.str.count(r"[^ ]+")


@R.add("registered_counter", f"WITH {NODES} SELECT session_id AS conv_id, CAST(sum(len(list_filter(string_split(content, ' '), lambda x: x <> ''))) AS BIGINT) AS words, CAST(sum(token_count) AS BIGINT) AS estimate FROM n GROUP BY session_id")
def registered_counter(t):
    """A user's own token counter beside the library's estimate."""
    n = conversation_nodes(t("conversations"))
    extension.register(n.sparkSession, "user_words", "counter", words)
    return n.sparkSession.sql(f"SELECT session_id AS conv_id, sum(user_words(content)) AS words, sum(token_count) AS estimate FROM {_view(n)} GROUP BY session_id")


def favour(rows: pd.DataFrame) -> pd.Series:
    return rows["step_id"] * 3 % 7 + (rows["node_type"] == "decision") * 2


@R.add("registered_scorer", f"WITH RECURSIVE {NODES}, s AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ordinal * 3 % 7 + CASE WHEN node_type = 'decision' THEN 2 ELSE 0 END DESC, ordinal, node_id) AS place FROM n), f AS (SELECT session_id, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS kept FROM n GROUP BY session_id UNION ALL SELECT s.session_id, s.place, CASE WHEN used + token_count <= 256 THEN used + token_count ELSE used END, CASE WHEN used + token_count <= 256 THEN kept + 1 ELSE kept END FROM f JOIN s ON s.session_id = f.session_id AND s.place = f.place + 1) SELECT session_id AS conv_id, max(kept) AS kept, CAST(max(used) AS BIGINT) AS used FROM f GROUP BY session_id")
def registered_scorer(t):
    """The scored policy under a user's scorer, 256 tokens for each conversation."""
    score = extension.vectorised("scorer", favour)
    view = context.scored(conversation_nodes(t("conversations")), 256, score("step_id", "node_type"))
    return view.groupBy(F.col("session_id").alias("conv_id")).agg(F.sum(F.col("kept").cast("bigint")).alias("kept"), F.sum(F.when(F.col("kept"), F.col("cost")).otherwise(0)).alias("used"))
