"""Commands over saved graphs and trajectories: python -m braidline.cli COMMAND. Each prints one JSON object; 0 if all is well, 1 if something is invalid."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidline.operators import context, graph, interventions
from braidline.scratch import table
from braidline.session import session
from braidline.sources import archive, graphs, trajectories


def _completed(nodes: DataFrame) -> DataFrame:
    """Nodes of stored graphs with what their metadata says in columns."""
    said = lambda k: F.get_json_object("metadata", f"$.{k}")
    names = {c: said(c) for c in ("tool_name", "operation_key", "semantic_outcome", "call_id")}
    return nodes.withColumns(names | {"final": F.coalesce(said("final") == "true", F.lit(False)), "ordinal": said("source_message_ordinal").cast("bigint"), "arguments": F.from_json(F.get_json_object("content", "$.arguments"), "map<string,string>")})


def validate(spark: SparkSession, path: str) -> tuple[dict, int]:
    found = graphs.read_graphs(spark, path)
    bad = graph.violations(graphs.graph_nodes(found), graphs.graph_edges(found)).limit(100).collect()
    return {"valid": not bad, "errors": [r.asDict() for r in bad]}, int(bool(bad))


def verify_archive(spark: SparkSession, path: str) -> tuple[dict, int]:
    bad = [r.digest for r in archive.broken(spark, path).limit(100).collect()]
    return {"valid": not bad, "failures": bad}, int(bool(bad))


def make_synthetic(spark: SparkSession, output: str) -> tuple[dict, int]:
    graphs.save_graphs(graphs.graph_documents(*graphs.synthetic_trace(spark)), output)
    return {"output": output, "session_id": "synthetic"}, 0


def import_trajectories(spark: SparkSession, source: str, output: str, store: str) -> tuple[dict, int]:
    """Every result's content goes to the archive, and its node refers to it there."""
    trace = table(trajectories.traces(trajectories.read_messages(spark, source)), "traces")
    tool = F.col("node_type").isin("tool_call", "observation", "error")
    raw = F.to_json(F.struct("session_id", "node_id", "content"))
    nodes = trajectories.nodes_of(trace).withColumn("raw", F.when(tool, raw))
    archive.put(nodes.where("raw is not null").select(F.col("raw").alias("payload")), store)
    known = F.concat(F.lit("sha256:"), F.sha2(graphs.canonical_json(F.col("raw")), 256))
    nodes = nodes.withColumns({"raw_ref": F.when(F.col("raw").isNotNull(), known), "metadata": F.to_json(F.struct("tool_name", "operation_key", "semantic_outcome", "call_id", "final", F.col("ordinal").alias("source_message_ordinal")))})
    kept = nodes.select("session_id", "node_id", "node_type", "content", "step_id", "token_count", "raw_ref", "side_effect", F.lit(True).alias("active"), "metadata")
    graphs.save_graphs(graphs.graph_documents(kept, trajectories.edges_of(trace)), output)
    return {"imported": kept.select("session_id").distinct().count(), "output": output}, 0


def run_offline(spark: SparkSession, source: str, output: str, budget: int, managers: list[str]) -> tuple[dict, int]:
    """Every policy over every graph: measures of each session, and their means."""
    loaded = graphs.valid_graphs(graphs.load_graphs(spark, source))
    nodes, edges = table(_completed(graphs.graph_nodes(loaded)), "nodes"), table(graph.normalize_legacy(graphs.graph_edges(loaded)).withColumn("confidence", F.lit(1.0)), "edges")
    rows = None
    for name in managers or sorted(context.POLICIES):
        items = None
        if name in context.FLAGSHIP:
            view, items = context.full_ours(nodes, edges, budget, **context.FLAGSHIP[name])
        elif name == "raw_hard_failure_retention":
            view = context.raw_hard_failures(nodes, edges, budget)
        else:
            view = context.profiled_view(context.POLICIES[name](nodes, budget), nodes, edges)
        measured = context.evaluate_view(view, edges, items).withColumn("manager", F.lit(name))
        rows = measured if rows is None else rows.unionByName(measured)
    graphs.write_new(rows, f"{output}/sessions", "csv")
    means = rows.groupBy("manager").agg(F.count("*").alias("sessions"), *[F.avg(c).alias(f"mean_{c}") for c, t in rows.dtypes if t in ("double", "bigint") and c != "session_id"])
    graphs.write_new(means, f"{output}/managers")
    return {"output": output, "managers": [r.asDict() for r in means.orderBy("manager").collect()]}, 0


def run_interventions(spark: SparkSession, output: str, tasks: int, seed: int, budget: int) -> tuple[dict, int]:
    """The controlled matrix, run: a row a run, and whether the mechanism holds."""
    rows = table(interventions.run(spark, tasks, seed, budget), "interventions")
    graphs.write_new(rows, f"{output}/runs")
    verdict = interventions.mechanism(rows).first().asDict()
    return {"output": output, "runs": rows.count(), "mechanism": verdict}, 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="braidline")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("validate-trace", "verify-archive"):
        commands.add_parser(name).add_argument("path")
    commands.add_parser("list-managers")
    commands.add_parser("make-synthetic").add_argument("--output", required=True)
    imported = commands.add_parser("import-trajectories")
    for option in ("--input", "--output", "--archive"):
        imported.add_argument(option, required=True)
    offline = commands.add_parser("run-offline")
    offline.add_argument("--input", required=True)
    offline.add_argument("--output", required=True)
    offline.add_argument("--budget", type=int, default=2048)
    offline.add_argument("--manager", action="append", default=[])
    controlled = commands.add_parser("run-interventions")
    controlled.add_argument("--output", required=True)
    controlled.add_argument("--tasks-per-kind", type=int, default=8)
    controlled.add_argument("--base-seed", type=int, default=4100)
    controlled.add_argument("--budget", type=int, default=512)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "list-managers":
        print(json.dumps(sorted(context.POLICIES)))
        return 0
    spark = spark or session()
    if a.command == "validate-trace":
        said, code = validate(spark, a.path)
    elif a.command == "verify-archive":
        said, code = verify_archive(spark, a.path)
    elif a.command == "make-synthetic":
        said, code = make_synthetic(spark, a.output)
    elif a.command == "import-trajectories":
        said, code = import_trajectories(spark, a.input, a.output, a.archive)
    elif a.command == "run-offline":
        said, code = run_offline(spark, a.input, a.output, a.budget, a.manager)
    else:
        said, code = run_interventions(spark, a.output, a.tasks_per_kind, a.base_seed, a.budget)
    print(json.dumps(said, ensure_ascii=False, default=str))
    return code


if __name__ == "__main__":
    raise SystemExit(main())
