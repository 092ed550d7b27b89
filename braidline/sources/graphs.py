"""Stored graphs, records, bundles and reports: readers that raise on what is wrong, and writers that never overwrite.

A graph is one JSON document: {schema_version, session_id, metadata, nodes: {id: node} or [node], edges: {id: edge} or [edge]}.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from braidline.functions.identity import canonical_json
from braidline.functions.text import estimate_tokens
from braidline.operators import graph
from braidline.sources.checked import Checked, json_fault, split

_NODE = "struct<node_id:string, node_type:string, content:string, step_id:bigint, lifecycle:string, token_count:bigint, raw_ref:string, side_effect:boolean, active:boolean, metadata:string>"
_EDGE = "struct<edge_id:string, source:string, target:string, edge_type:string, confidence:double, metadata:string>"
GRAPH = f"session_id string, metadata string, nodes array<{_NODE}>, edges array<{_EDGE}>"
#: Domains that the names of runs' folders begin with, the task behind them: retail_12, airline-7.
DOMAINS = ("retail", "airline")


@F.pandas_udf(StringType())
def _listed(text: pd.Series) -> pd.Series:
    """Graphs with their nodes and edges as lists, their open fields as JSON text; null for what is no graph."""

    def plain(items: Any, fields: tuple[str, ...]) -> list[dict]:
        rows = items.values() if isinstance(items, dict) else items if isinstance(items, list) else []
        return [{k: v if k not in fields or isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False, sort_keys=True) for k, v in r.items()} for r in rows if isinstance(r, dict)]

    def one(x: str | None) -> str | None:
        try:
            g = json.loads(x or "")
        except ValueError:
            return None
        if not isinstance(g, dict) or "schema_version" not in g:
            return None
        return json.dumps({"session_id": g.get("session_id"), "metadata": json.dumps(g.get("metadata") or {}, ensure_ascii=False, sort_keys=True), "nodes": plain(g.get("nodes"), ("content", "metadata")), "edges": plain(g.get("edges"), ("metadata",))}, ensure_ascii=False)

    return text.map(one)


def checked_graphs(spark: SparkSession, path: str, recursive: bool = False, domains: tuple[str, ...] = DOMAINS) -> Checked:
    """read_graphs() beside the files that hold no graph: `not JSON` or `no graph`."""
    reader = spark.read.option("pathGlobFilter", "trace.json" if recursive else "*.json")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    files = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value", _listed("value").alias("g"))
    fault = F.when(F.col("g").isNull(), F.when(F.try_parse_json("value").isNull(), "not JSON").otherwise("no graph"))
    found = split(files, fault, F.col("value"), "file", "g")
    parsed = found.rows.withColumn("g", F.from_json("g", GRAPH))
    place = rf"(?i)(?:^|[_/\\-])({'|'.join(domains)})[_-]([^_/\\-]+)"
    part = lambda i: F.nullif(F.regexp_extract("file", place, i), F.lit(""))
    said = lambda k: F.nullif(F.get_json_object("g.metadata", f"$.{k}"), F.lit(""))
    named = F.when(~said("task_id").rlike("^[0-9a-f]{24,}$"), said("task_id"))
    rows = parsed.select("file", F.coalesce(said("domain"), F.lower(part(1)), F.lit("unknown")).alias("domain"), F.coalesce(named, part(2), said("task_id"), F.col("g.session_id")).alias("task"), F.try_to_number(said("trial"), F.lit("999999999")).cast("bigint").alias("trial"), "g.*")
    return Checked(rows, found.faults)


def read_graphs(spark: SparkSession, path: str, recursive: bool = False, domains: tuple[str, ...] = DOMAINS, mode: str = "permissive") -> DataFrame:
    """(file, domain, task, trial, session_id, metadata, nodes, edges) of every graph under path; what is none is counted in a warning, or an error under `failfast`. None at all is an error.

    Domain and task are those of the metadata, else of the path; a task that is only a long hash gives way to the path's. Unknown ones are `unknown` and the session.
    """
    rows = checked_graphs(spark, path, recursive, domains).under(mode)
    if rows.isEmpty():
        raise ValueError(f"no graphs in {path}")
    return rows


def graph_nodes(graphs: DataFrame) -> DataFrame:
    return graphs.select("session_id", F.explode("nodes").alias("n")).select("session_id", "n.*").fillna({"active": True, "side_effect": False})


def graph_edges(graphs: DataFrame) -> DataFrame:
    return graphs.select("session_id", F.explode("edges").alias("e")).select("session_id", "e.*").fillna({"confidence": 1.0})


def valid_graphs(graphs: DataFrame) -> DataFrame:
    """graphs, if none breaks the model; else an error that names the first few violations."""
    bad = graph.violations(graph_nodes(graphs), graph_edges(graphs)).limit(5).collect()
    if bad:
        raise ValueError(f"invalid graphs: {[tuple(r) for r in bad]}")
    return graphs


def graph_documents(nodes: DataFrame, edges: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(session_id, document): the JSON document of each session's graph; metadata: (session_id, metadata as a JSON object)."""
    listed = lambda df, key: df.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(key, *[c for c in df.columns if c not in ("session_id", key)]))).alias("x"))
    n = listed(nodes.select([c for c in nodes.columns if not nodes.schema[c].dataType.typeName() == "map"]), "node_id").withColumnRenamed("x", "nodes")
    e = listed(edges.withColumn("edge_id", F.concat(F.lit("edge_"), F.substring(F.sha2(F.concat_ws(chr(31), "session_id", "source", "edge_type", "target"), 256), 1, 24))), "edge_id").withColumnRenamed("x", "edges")
    rows = n.join(e, "session_id", "left")
    rows = rows.join(metadata, "session_id", "left") if metadata is not None else rows.withColumn("metadata", F.lit(None).cast("string"))
    body = F.to_json(F.struct(F.lit("2.0").alias("schema_version"), F.col("session_id").cast("string").alias("session_id"), "nodes", F.coalesce("edges", F.array()).alias("edges")))
    # The metadata is JSON already, so it is put in as it is.
    return rows.select("session_id", F.concat(F.substr(body, F.lit(1), F.length(body) - 1), F.lit(',"metadata":'), F.coalesce("metadata", F.lit("{}")), F.lit("}")).alias("document"))


def save_graphs(documents: DataFrame, path: str) -> None:
    """One line of JSON a graph, in a new folder: there is no partly written one, as a folder without _SUCCESS does not count."""
    documents.select("document").write.mode("errorifexists").text(path)


def load_graphs(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, metadata, nodes, edges) of what save_graphs() wrote."""
    kept = spark.read.text(path).select(_listed("value").alias("g"))
    return kept.select(F.from_json("g", GRAPH).alias("g")).select("g.*")


def materialized(nodes: DataFrame, edges: DataFrame, runs: DataFrame) -> DataFrame:
    """(session_id, name, document): graphs stamped with the columns of their run (session_id, run_id, ...), under flat names."""
    stamp = runs.select("session_id", F.to_json(F.struct(*[c for c in runs.columns if c != "session_id"])).alias("metadata"), F.concat_ws("__", "run_id", F.col("session_id").cast("string"), F.lit("trace.json")).alias("name"))
    made = graph_documents(nodes, edges, stamp.select("session_id", "metadata"))
    return made.join(stamp.select("session_id", "name"), "session_id").select("session_id", "name", "document")


def retokenized(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with the estimate of their content as token_count, and a report of each session: changed nodes, old and new totals)."""
    fresh = nodes.withColumns({"old": F.coalesce("token_count", F.lit(0)), "token_count": estimate_tokens(F.col("content"))})
    report = fresh.groupBy("session_id").agg(F.count("*").alias("nodes"), F.sum((F.col("old") != F.col("token_count")).cast("bigint")).alias("changed"), F.sum("old").alias("old_total"), F.sum("token_count").alias("new_total"))
    return fresh.drop("old"), report


def write_new(df: DataFrame, path: str, kind: str = "json") -> None:
    """Write results where nothing is yet: JSON lines, or CSV with a header, where whatever is nested becomes JSON text."""
    if kind == "json":
        df.write.mode("errorifexists").json(path)
        return
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("errorifexists").option("header", "true").csv(path)


def union_by_name(*parts: DataFrame) -> DataFrame:
    """Rows of all parts under the union of their columns, as reports with further columns are put together."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def checked_records(spark: SparkSession, path: str) -> Checked:
    """(value): JSON objects of every .json and .jsonl file under path, as text; lists and objects with rows give their members. Beside them what is no JSON or no object."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,jsonl}").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lined = F.when(F.col("file").endswith(".jsonl"), F.split("value", r"\r?\n")).otherwise(F.array("value"))
    docs = text.select("file", F.explode(lined).alias("value")).withColumn("value", F.trim("value")).where("value <> ''")
    inner = F.coalesce(F.get_json_object("value", "$.rows"), F.when(F.col("value").startswith("["), F.col("value")))
    members = docs.select("file", F.explode(F.coalesce(F.from_json(inner, "array<string>"), F.array("value"))).alias("value"))
    return split(members, json_fault(F.col("value")), F.col("value"), "value")


def read_records(spark: SparkSession, path: str, mode: str = "permissive") -> DataFrame:
    """The rows of checked_records(); what is left out is counted in a warning, or an error under `failfast`."""
    return checked_records(spark, path).under(mode)


def hashed(payload: Column) -> Column:
    """The SHA-256 of a JSON payload in canonical form."""
    return F.sha2(canonical_json(payload), 256)


def load_generations(artifacts: DataFrame, markers: DataFrame) -> DataFrame:
    """Artifacts (id, payload) that a marker (id, hash) says are complete; one whose payload has another hash, or a marker without an artifact, is an error."""
    both = artifacts.join(markers, "id", "right").withColumn("actual", hashed(F.col("payload")))
    bad = both.where("actual is null or actual <> hash").select("id").limit(3).collect()
    if bad:
        raise ValueError(f"artifacts that are not what their marker says: {[r.id for r in bad]}")
    return both.select("id", "payload", "hash")


def load_prefixes(bundles: DataFrame) -> DataFrame:
    """Frozen prefixes (prefix_id, prefix_hash, payload), if every payload has its hash and no id occurs again."""
    checked = bundles.withColumn("actual", hashed(F.col("payload")))
    bad = checked.where("actual is null or actual <> prefix_hash").select("prefix_id").limit(3).collect()
    twice = bundles.groupBy("prefix_id").count().where("count > 1").limit(3).collect()
    if bad or twice:
        raise ValueError(f"prefixes that were changed: {[r.prefix_id for r in bad]}, ids that occur again: {[r.prefix_id for r in twice]}")
    return checked.drop("actual")


def next_attempts(new: DataFrame, stored: DataFrame) -> DataFrame:
    """new (id, payload) with hash, attempt and name: attempts go on from the highest that stored (id, attempt, hash) has; an equal payload is no new attempt."""
    from pyspark.sql import Window

    fresh = new.withColumn("hash", hashed(F.col("payload"))).dropDuplicates(["id", "hash"]).join(stored.select("id", "hash"), ["id", "hash"], "left_anti")
    last = stored.groupBy("id").agg(F.max("attempt").alias("last"))
    rows = fresh.join(last, "id", "left")
    attempt = (F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("id").orderBy("hash"))).cast("bigint")
    return rows.withColumn("attempt", attempt).withColumn("name", F.concat(F.lit("attempt_"), F.lpad(F.col("attempt").cast("string"), 4, "0"))).drop("last")


def synthetic_trace(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A small graph with one of everything: a stale observation, an open failure, a failed act and its retry, a constraint that blocks, two supporters of the end."""
    rows = (
        ("goal", "goal", "return the bicycle", 0, None, False),
        ("rule", "constraint", "ask before any act", 0, None, False),
        ("first", "decision", "look the order up", 1, None, False),
        ("read", "tool_call", "find_order", 1, None, False),
        ("old", "observation", "order is packed", 1, "inconclusive", False),
        ("read2", "tool_call", "find_order", 2, None, False),
        ("new", "observation", "order is sent", 2, "inconclusive", False),
        ("act", "tool_call", "return_order", 3, None, True),
        ("fail", "error", "confirmation required", 3, "negative", False),
        ("again", "tool_call", "return_order", 4, None, True),
        ("done", "observation", "returned", 4, "positive", False),
        ("side", "tool_call", "find_refund", 5, None, False),
        ("open", "error", "refund not found", 5, "negative", False),
        ("end", "decision", "the bicycle is returned", 6, None, False),
    )
    tools = {"read": "find_order", "read2": "find_order", "act": "return_order", "again": "return_order", "side": "find_refund"}
    made = [("synthetic", i, t, c, s, s * 3 if t not in ("goal", "constraint") else 0, o, a, i == "end", True, f"sha256:{i}" if t in ("tool_call", "observation", "error") else None, tools.get(i), tools.get(i)) for i, t, c, s, o, a in rows]
    nodes = spark.createDataFrame(made, "session_id string, node_id string, node_type string, content string, step_id bigint, ordinal bigint, semantic_outcome string, side_effect boolean, final boolean, active boolean, raw_ref string, tool_name string, operation_key string")
    pairs = (("first", "read", "leads_to"), ("read", "old", "produces"), ("read2", "new", "produces"), ("old", "new", "superseded_by"), ("act", "fail", "failed_with"), ("again", "done", "produces"), ("act", "again", "retried_by"), ("fail", "done", "resolved_by"), ("side", "open", "failed_with"), ("rule", "act", "blocks"), ("new", "end", "supports"), ("done", "end", "supports"))
    edges = spark.createDataFrame([("synthetic", a, b, t, 1.0) for a, b, t in pairs], "session_id string, source string, target string, edge_type string, confidence double")
    return nodes.withColumns({"token_count": estimate_tokens(F.col("content")), "arguments": F.lit(None).cast("map<string,string>")}), edges
