"""Queries of the artifact store: commits that overlap, and evaluations merged on top."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from braidline.plans.exchanges import EX
from braidline.plans.registry import Registry
from braidline.scratch import root
from braidline.sources.adapters import event_exchanges
from braidline.sources.graphs import hashed
from braidline.sources.store import ArtifactStore, merge_evaluation

R = Registry()

_GENERATION = """'{"id":"s' || session_id || '","messages":[' || n || ',{"last":' || last || '}]}'"""
_EVALUATION = """'{"evaluation":{"reward_info":{"reward":' || bad || '}},"status":"evaluation_complete"}'"""
_MERGED = """'{"evaluation_sha256":"' || e || '","generation_sha256":"' || g || '","simulation":{"id":"s' || session_id || '","messages":[' || n || ',{"last":' || last || '}],"reward_info":{"reward":' || bad || '}},"status":"merged"}'"""


@R.add(
    "artifact_versions",
    f"""WITH {EX}, s AS (SELECT session_id, count(*) AS n, max(k) AS last, count(*) FILTER (err) AS bad FROM ex GROUP BY session_id), h AS (SELECT *, sha256({_GENERATION}) AS g, sha256({_EVALUATION}) AS e FROM s)
SELECT 's' || session_id AS id, 'generation' AS kind, g AS hash FROM h UNION ALL SELECT 's' || session_id, 'merged', sha256({_MERGED}) FROM h WHERE session_id % 2 = 0""",
)
def artifact_versions(t):
    """Generations of sessions in two commits that share a third of them, then rewards for every second one: three versions, each artifact once."""
    s = event_exchanges(t("events")).groupBy("session_id").agg(F.count("*").alias("n"), F.max("k").alias("last"), F.sum(F.col("err").cast("bigint")).alias("bad"))
    made = s.selectExpr("session_id", "'s' || session_id AS id", "'generation' AS kind", f"{_GENERATION} AS payload", f"{_EVALUATION} AS evaluation")
    store = ArtifactStore(s.sparkSession, f"{root(s.sparkSession)}/artifacts-{uuid.uuid4().hex}")
    store.commit(made.where("session_id % 3 < 2").select("id", "kind", "payload"))
    store.commit(made.where("session_id % 3 > 0").select("id", "kind", "payload"))
    judged = made.where("session_id % 2 = 0").select("id", hashed(F.col("payload")).alias("generation_hash"), hashed(F.col("evaluation")).alias("hash"), F.col("evaluation").alias("payload"))
    merge_evaluation(store, judged)
    return store.read().select("id", "kind", "hash")
