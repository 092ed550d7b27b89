"""Saved trajectories: result containers in JSON, their messages, and the traces derived from them."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidline.functions.text import semantic_outcome
from braidline.operators.trace_fold import EDGE_FIELDS, NODE_FIELDS, TraceFold
from braidline.scratch import table

MESSAGES = "session_id string, task_id string, trial bigint, reward double, ordinal bigint, role string, message string"
TRACE = "session_id string, kind string, node_id string, node_type string, content string, step_id bigint, ordinal bigint, token_count bigint, tool_name string, operation_key string, call_id string, semantic_outcome string, side_effect boolean, source string, target string, edge_type string, confidence double, match_type string"


def simulations(payload: Any) -> list[dict[str, Any]]:
    """Simulations of a file: a container, a list, or a single one."""
    if isinstance(payload, list):
        return [x for x in payload if isinstance(x, dict)]
    if not isinstance(payload, dict):
        return []
    inner = payload.get("simulations")
    if isinstance(inner, list):
        return [x for x in inner if isinstance(x, dict)]
    return [payload] if any(k in payload for k in ("messages", "trajectory", "traj")) else []


def flat_messages(simulation: dict[str, Any]) -> list[dict[str, Any]]:
    """Messages under whichever name they are stored, with grouped tool messages unnested."""
    found = next((simulation[k] for k in ("messages", "trajectory", "traj") if simulation.get(k) is not None), [])
    out = []
    for m in found:
        if isinstance(m, dict):
            inner = m.get("tool_messages")
            out += [x for x in inner if isinstance(x, dict)] if isinstance(inner, list) else [m]
    return out


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """One row for each message of every simulation under path, with the instruction of its task.

    Layouts: a folder with results.json, which names tasks and domain and holds the simulations, or has them in simulations/*.json beside it; a
    container; a list; a single simulation. A file that is no JSON, or none of these, is an error, as is a path without a simulation. A file is parsed whole by
    one task, as a JSON document must be; corpora are many files.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for file, text in zip(part["file"], part["value"], strict=True):
                try:
                    payload = json.loads(text)
                except ValueError as e:
                    raise ValueError(f"{file} is no JSON: {e}") from e
                found = simulations(payload)
                known = payload.get("tasks") if isinstance(payload, dict) else None
                if not found and not isinstance(known, list) and not (isinstance(payload, dict) and payload.get("simulations") == []):
                    raise ValueError(f"{file} holds no simulations")
                base = file.rsplit("/", 2 if "/simulations/" in file else 1)[0]
                for task in known or []:
                    if isinstance(task, dict) and task.get("id") is not None:
                        rows.append((base, "task", None, str(task["id"]), None, None, None, "", next((x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for k in ("instruction", "user_scenario", "description") if (x := task.get(k)) is not None), None)))
                for sim in found:
                    reward = (sim.get("reward_info") or {}).get("reward")
                    for i, m in enumerate(flat_messages(sim), 1):
                        rows.append((base, "message", str(sim.get("id")), None if sim.get("task_id") is None else str(sim["task_id"]), sim.get("trial"), reward, i, str(m.get("role") or m.get("speaker") or "").lower(), json.dumps(m, ensure_ascii=False)))
            yield pd.DataFrame(rows, columns=["base", "kind", "session_id", "task_id", "trial", "reward", "ordinal", "role", "message"])

    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = table(files.mapInPandas(run, f"base string, kind string, {MESSAGES}"), "trajectories")
    found = rows.where("kind = 'message'").drop("kind")
    if found.isEmpty():
        raise ValueError(f"no simulations in {path}")
    tasks = rows.where("kind = 'task'").select("base", "task_id", F.col("message").alias("instruction")).dropDuplicates(["base", "task_id"])
    return found.join(tasks, ["base", "task_id"], "left").select(*[c.split()[0] for c in MESSAGES.split(", ")], "instruction")


def fold_rows(fold: TraceFold, messages: Iterable[tuple], kind: str | None = None) -> list[tuple]:
    """The TRACE rows, or only those of a kind, of a session's further messages (ordinal, message, failed, meaning), in order of ordinal."""
    rows = []
    no_node, no_edge = (None,) * len(NODE_FIELDS), (None,) * len(EDGE_FIELDS)
    for ordinal, text, failed, meaning in sorted(messages, key=lambda m: m[0]):
        nodes, edges = fold.feed(int(ordinal), json.loads(text), bool(failed), meaning)
        if kind != "edge":
            rows += [(fold.session, "node", *n, *no_edge) for n in nodes]
        if kind != "node":
            rows += [(fold.session, "edge", *no_node, *e) for e in edges]
    return rows


def judged(messages: DataFrame) -> DataFrame:
    """messages with failed and meaning of results: by their flag, by a text that begins with error, or by an error in their JSON."""
    content, flag = F.get_json_object("message", "$.content"), F.get_json_object("message", "$.error")
    truthy = lambda x: F.coalesce(~x.isin("false", "0", "0.0", "", "[]", "{}", "null"), F.lit(False))
    inner = F.when(content.startswith("{"), F.get_json_object(content, "$.error"))
    says = F.coalesce(F.lower(F.ltrim(content)).rlike("^error[: ]"), F.lit(False))
    failed = truthy(flag) | says | truthy(inner)
    return messages.withColumn("failed", failed).withColumn("meaning", semantic_outcome(F.coalesce(content, F.lit("")), F.col("failed")))


COLUMNS = ["session_id", "kind", *NODE_FIELDS, *EDGE_FIELDS]
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
TYPES = [_ARROW[c.split()[1]] for c in TRACE.split(", ")]


def traces(messages: DataFrame, horizon: int | None = None, kind: str | None = None) -> DataFrame:
    """Nodes and edges (TRACE) of every session, or only the rows of a kind; a session is folded by one task, each time the plan is read. horizon: see TraceFold."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        messages = zip(*[part[c].to_pylist() for c in ("ordinal", "message", "failed", "meaning")], strict=True)
        rows = fold_rows(TraceFold(key[0].as_py(), horizon=horizon), messages, kind)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(COLUMNS), TYPES, strict=True)], COLUMNS)

    return judged(messages).select("session_id", "ordinal", "message", "failed", "meaning").groupBy("session_id").applyInArrow(run, TRACE)


def nodes_of(trace: DataFrame) -> DataFrame:
    """The nodes of a trace with final and negative. A window and no join: the trace, which may be a fold yet to run, is read once."""
    rows = trace.where("kind = 'node'").select("session_id", *NODE_FIELDS)
    last = F.max(F.when(F.col("node_type") == "decision", F.col("ordinal"))).over(Window.partitionBy("session_id"))
    return rows.withColumn("last", last).withColumn("final", (F.col("node_type") == "decision") & (F.col("ordinal") == F.col("last"))).drop("last").withColumn("negative", F.coalesce(F.col("semantic_outcome").isin("negative", "policy_denied", "test_failed"), F.lit(False)))


def edges_of(trace: DataFrame) -> DataFrame:
    return trace.where("kind = 'edge'").select("session_id", *EDGE_FIELDS)
