"""Graph operators over (session_id, source, target, edge_type): normalization, validation, reachability, closures, protocol.

Fixed points iterate over frontiers: each round joins the frontier to the edges and keeps what is new. Unbranched runs are
passed in jumps, so that rounds follow the logarithm of a run's length. Rounds end in tables of the shared folder, so plans stay
short and a lost executor costs one round.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidline.schema import EDGE_SIGNATURES, FORWARD_EDGES, LEGACY_EDGES
from braidline.scratch import table

#: Edges of a session that is searched by one call (about 200 bytes each); larger ones are searched by joins.
WHOLE = 50_000
#: How many jumps of one width make one of the next.
RADIX = 8


def normalize_legacy(edges: DataFrame) -> DataFrame:
    """Edges with the forward edge of each older one, unless it is there."""
    forward = F.create_map(*[F.lit(x) for pair in LEGACY_EDGES.items() for x in pair])
    turned = edges.where(F.col("edge_type").isin(*LEGACY_EDGES)).select("session_id", F.col("target").alias("source"), F.col("source").alias("target"), forward[F.col("edge_type")].alias("edge_type"))
    return edges.select("session_id", "source", "target", "edge_type").union(turned).distinct()


def signatures(spark: SparkSession) -> DataFrame:
    rows = [(t, s, d) for t, (sources, targets) in EDGE_SIGNATURES.items() for s in sources for d in targets]
    return spark.createDataFrame(rows, "edge_type string, source_type string, target_type string")


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id, kind, subject) of everything that breaks the model: dangling ends, unlike types, edges back in time, side effects without a raw record."""
    n = nodes.select("session_id", "node_id", "node_type", "step_id")
    both = edges.join(n.select("session_id", F.col("node_id").alias("source"), F.col("node_type").alias("source_type"), F.col("step_id").alias("source_step")), ["session_id", "source"], "left")
    both = both.join(n.select("session_id", F.col("node_id").alias("target"), F.col("node_type").alias("target_type"), F.col("step_id").alias("target_step")), ["session_id", "target"], "left")
    known = F.broadcast(signatures(nodes.sparkSession)).withColumn("fits", F.lit(True))  # a table of the model, under 200 rows
    both = both.join(known, ["edge_type", "source_type", "target_type"], "left")
    kind = (
        F.when(F.col("source_type").isNull() | F.col("target_type").isNull(), "dangling")
        .when(F.col("fits").isNull(), "signature")
        .when(F.col("edge_type").isin(*FORWARD_EDGES) & (F.col("source_step") > F.col("target_step")), "temporal")
    )
    subject = F.concat_ws(">", "source", "edge_type", "target")
    raw = nodes.where("side_effect and raw_ref is null").select("session_id", F.lit("raw_ref").alias("kind"), F.col("node_id").alias("subject"))
    return both.select("session_id", kind.alias("kind"), subject.alias("subject")).where("kind is not null").union(raw)


def reachable(edges: DataFrame, starts: DataFrame, edge_types: tuple[str, ...] | None = None, excluded: DataFrame | None = None, whole: int = WHOLE, stored: bool = False) -> DataFrame:
    """(session_id, start, node, depth): the nodes that lie on a path from each start (session_id, start), at their least depth.

    edge_types: the only edges to follow; excluded: (session_id, node) that no path may enter. No edge leaves its session, so sessions of up to
    `whole` edges are searched by one call each; larger ones, and only those, by joins over all tasks. stored: edges are a table of
    distinct rows already and need not be written again.
    """
    links = edges if edge_types is None else edges.where(F.col("edge_type").isin(*edge_types))
    links = links.select("session_id", F.col("source").alias("node"), F.col("target").alias("next"))
    links = links if stored else links.distinct()
    if excluded is not None:
        links = links.join(excluded.select("session_id", F.col("node").alias("next")), ["session_id", "next"], "left_anti")
    links = links.select("session_id", "node", "next")
    links = links if stored and excluded is None else table(links, "links")
    large = table(links.groupBy("session_id").count().where(F.col("count") > whole).select("session_id"), "large-sessions")
    starts = starts.select("session_id", "start").distinct()
    if large.isEmpty():
        return _searched(links, starts)
    of = lambda df, how: df.join(large, "session_id", how)
    return _searched(of(links, "left_anti"), of(starts, "left_anti")).unionByName(_jumped(of(links, "left_semi"), of(starts, "left_semi")))


def _searched(links: DataFrame, starts: DataFrame) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        # Names become numbers, which dictionaries hold one of for each name, not for each link.
        node = right["start"].type
        chunks = [c for column in (left["node"], left["next"], right["start"]) for c in column.cast(node).chunks]
        names = pa.chunked_array(chunks, node).combine_chunks().dictionary_encode("encode")
        at = names.indices.to_numpy().tolist()
        n = left.num_rows
        after: list[list[int]] = [[] for _ in range(len(names.dictionary))]
        for one, then in zip(at[:n], at[n : 2 * n], strict=True):
            after[one].append(then)
        begun, found, depth = [], [], []
        for start in at[2 * n :]:
            seen, todo = {start: 0}, deque([start])
            while todo:
                one = todo.popleft()
                for then in after[one]:
                    if then not in seen:
                        seen[then] = seen[one] + 1
                        todo.append(then)
            begun += [start] * len(seen)
            found += seen
            depth += seen.values()
        session = pa.array([right["session_id"][0].as_py()] * len(found), right["session_id"].type) if right.num_rows else pa.array([], right["session_id"].type)
        named = lambda x: names.dictionary.take(pa.array(x, pa.int32()))
        return pa.table({"session_id": session, "start": named(begun), "node": named(found), "depth": pa.array(depth, pa.int32())})

    kind, node = (starts.schema[c].dataType.simpleString() for c in ("session_id", "start"))
    return links.groupBy("session_id").cogroup(starts.groupBy("session_id")).applyInArrow(run, f"session_id {kind}, start {node}, node {node}, depth int")


def _jumps(links: DataFrame) -> DataFrame:
    """(session_id, node, next, width): the links, and jumps along nodes that have one way on: of 2 to RADIX - 1 steps, of RADIX to RADIX - 1 times as many, and so on.

    RADIX jumps of a width in a row are one of the next width, so a run of n nodes takes log n rounds and n log n rows. A round ends in one
    table. Going round a circle for longer than its session has nodes leads nowhere new, so widths end there.
    """
    most = links.groupBy("session_id").count().agg(F.max("count")).first()[0] or 0
    single = links.groupBy("session_id", "node").agg(F.count("*").alias("n"), F.first("next").alias("next")).where("n = 1").drop("n")
    level, width, made = table(single, "jumps"), 1, [links.withColumn("width", F.lit(1).cast("bigint"))]
    while width <= most and not level.isEmpty():
        on = level.select("session_id", F.col("node").alias("end"), F.col("next").alias("after"))
        rows = level.withColumn("to", F.array("next")).withColumnRenamed("next", "end")
        for _ in range(RADIX - 1):
            step = rows.join(on, ["session_id", "end"], "left")
            # Where a run ends there is no further place: the end is null from there on and meets nothing.
            rows = step.select("session_id", "node", F.when(F.col("after").isNotNull(), F.array_append("to", F.col("after"))).otherwise(F.col("to")).alias("to"), F.col("after").alias("end"))
        found = table(rows.select("session_id", "node", F.posexplode("to").alias("i", "next")), "jumps")
        made.append(found.where(F.col("i").between(0 if width > 1 else 1, RADIX - 2)).select("session_id", "node", "next", ((F.col("i") + 1) * width).alias("width")))
        level, width = found.where(F.col("i") == RADIX - 1).select("session_id", "node", "next"), width * RADIX
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def _jumped(links: DataFrame, starts: DataFrame) -> DataFrame:
    """By frontiers over links and jumps. A round is one table of all that is reached at its least depth so far; nodes whose depth a round has
    made or lowered are the next frontier, and none ends the search, so circles end too."""
    ways = _jumps(links)
    seen = starts.select("session_id", "start", F.col("start").alias("node"), F.lit(0).cast("bigint").alias("depth"), F.lit(True).alias("fresh"))
    while True:
        step = seen.where("fresh").join(ways, ["session_id", "node"]).select("session_id", "start", F.col("next").alias("node"), (F.col("depth") + F.col("width")).alias("depth"), F.lit(None).cast("bigint").alias("before"))
        both = seen.select("session_id", "start", "node", "depth", F.col("depth").alias("before")).unionByName(step)
        least = both.groupBy("session_id", "start", "node").agg(F.min("depth").alias("depth"), F.min("before").alias("before"))
        seen = table(least.select("session_id", "start", "node", "depth", (F.col("before").isNull() | (F.col("depth") < F.col("before"))).alias("fresh")), "reached")
        if seen.where("fresh").isEmpty():
            return seen.select("session_id", "start", "node", F.col("depth").cast("int").alias("depth"))


def has_path(edges: DataFrame, pairs: DataFrame, edge_types: tuple[str, ...] | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """pairs (session_id, start, target) with found."""
    reached = reachable(edges, pairs.select("session_id", "start"), edge_types, excluded).select("session_id", "start", F.col("node").alias("target"), F.lit(True).alias("found"))
    return pairs.join(reached, ["session_id", "start", "target"], "left").fillna(False, ["found"])


def neighbours(edges: DataFrame) -> DataFrame:
    """(session_id, node_id, other, edge_type, direction): the incoming and outgoing edges of each node."""
    ends = F.array(*[F.struct(F.col(a).alias("node_id"), F.col(b).alias("other"), F.lit(d).alias("direction")) for a, b, d in (("source", "target", "out"), ("target", "source", "in"))])
    return edges.select("session_id", "edge_type", F.explode(ends).alias("e")).select("session_id", "e.node_id", "e.other", "edge_type", "e.direction")


def protocol_links(messages: DataFrame) -> DataFrame:
    """(session_id, ordinal, to, reason): from each calling message to its results and back."""
    calls = messages.select("session_id", F.col("ordinal").alias("call"), F.explode("call_ids").alias("id"))
    calls = calls.groupBy("session_id", "id").agg(F.max("call").alias("call"))
    results = messages.where("result_id is not null").groupBy("session_id", F.col("result_id").alias("id")).agg(F.max("ordinal").alias("result"))
    pairs = calls.join(results, ["session_id", "id"])
    return pairs.select("session_id", F.explode(F.array(F.struct(F.col("call").alias("ordinal"), F.col("result").alias("to"), F.lit("result_of_call").alias("reason")), F.struct(F.col("result").alias("ordinal"), F.col("call").alias("to"), F.lit("call_of_result").alias("reason")))).alias("l")).select("session_id", "l.*")


def protocol_closure(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """(session_id, ordinal, reason): chosen messages, the calls and results that belong to them, and a leading user turn.

    messages: (session_id, ordinal, role, call_ids array of a calling message, result_id of a result).
    chosen: (session_id, ordinal). Only what a round adds is followed in the next; none added ends it.
    """
    links = table(protocol_links(messages), "protocol-links")
    closed = chosen.join(messages.select("session_id", "ordinal"), ["session_id", "ordinal"], "left_semi").distinct().withColumn("reason", F.lit("selected"))
    frontier = closed
    while True:
        step = frontier.drop("reason").join(links, ["session_id", "ordinal"]).groupBy("session_id", F.col("to").alias("ordinal")).agg(F.min("reason").alias("reason"))
        frontier = table(step.join(closed, ["session_id", "ordinal"], "left_anti"), "closure")
        if frontier.isEmpty():
            break
        closed = closed.unionByName(frontier)
    first = closed.groupBy("session_id").agg(F.min("ordinal").alias("first"))
    users = messages.where("role = 'user'").select("session_id", F.col("ordinal").alias("user"))
    role = messages.select("session_id", F.col("ordinal").alias("first"), "role")
    anchor = first.join(role, ["session_id", "first"]).where("role <> 'user'").join(users, "session_id").where("user < first").groupBy("session_id").agg(F.max("user").alias("ordinal"))
    return closed.unionByName(anchor.join(closed, ["session_id", "ordinal"], "left_anti").withColumn("reason", F.lit("leading_user_anchor")))


def protocol_errors(messages: DataFrame) -> DataFrame:
    """(session_id, id, kind): calls without a result, results without a call, several results, results before their call."""
    calls = messages.select("session_id", F.col("ordinal").alias("call"), F.explode("call_ids").alias("id"))
    results = messages.where("result_id is not null").select("session_id", F.col("result_id").alias("id"), F.col("ordinal").alias("result"))
    c = calls.groupBy("session_id", "id").agg(F.max("call").alias("call"), F.count("*").alias("calls"))
    r = results.groupBy("session_id", "id").agg(F.min("result").alias("result"), F.count("*").alias("results"))
    kind = F.filter(
        F.array(
            F.when(F.col("result").isNull(), "call_without_result"),
            F.when(F.col("call").isNull(), "result_without_call"),
            F.when(F.col("calls") > 1, "call_repeated"),
            F.when(F.col("results") > 1, "result_repeated"),
            F.when(F.col("result") < F.col("call"), "result_before_call"),
        ),
        lambda x: x.isNotNull(),
    )
    return c.join(r, ["session_id", "id"], "full").select("session_id", "id", F.explode(kind).alias("kind"))


def first_use(values: DataFrame, uses: DataFrame) -> DataFrame:
    """Use and definition: for each defined value (session_id, kind, value, ordinal), the first later use (same columns) of equal kind and value.

    An as-of join by one sort over the union of both sides, not a range join: hot values cost no more than their rows.
    """
    from pyspark.sql import Window

    both = values.select("session_id", "kind", "value", "ordinal", F.lit(0).alias("is_use")).union(uses.select("session_id", "kind", "value", "ordinal", F.lit(1).alias("is_use")))
    later = Window.partitionBy("session_id", "kind", "value").orderBy("ordinal").rangeBetween(1, Window.unboundedFollowing)
    return both.withColumn("used_at", F.min(F.when(F.col("is_use") == 1, F.col("ordinal"))).over(later)).where("is_use = 0").drop("is_use")
