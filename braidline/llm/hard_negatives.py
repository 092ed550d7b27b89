"""Hard negatives from inverted lists of k-means clusters, by exact integer inner products.

Every row lies in the list of its nearest centroid; a list knows its radius, the largest distance of a row to the centroid. For an
anchor q no row of a list scores above q.c + |q| r or below q.c - |q| r (Cauchy-Schwarz). An anchor visits lists from the highest
upper bound down, in rounds that grow: lists whose bounds lie outside its windows are skipped, and an anchor stops as
soon as the next bound falls strictly below the k-th score of every window, so the results are those of a whole search, ties included.

Positives are one such search (one window without limits among rows of the anchor's label); negatives are a second one, with a window for
each positive. Lists lie in blocks of about BLOCK rows and anchors in groups of about GROUP, so that one call multiplies one block by one group and a
list that holds a third of all rows is many calls. Only centroids and radii are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidline.llm.common import hash_sample, save

#: Centroids are fitted on so many rows at most, and there are so many of them at most.
SAMPLE, CLUSTERS = 16_384, 1024
#: Rows of a block of a list, anchors of a group, and lists that an anchor visits in the first round; each round takes GROWTH times as many.
BLOCK, GROUP, FIRST, GROWTH = 2048, 4096, 8, 8
#: The windows of negatives: 30 * positive <= 100 * negative <= 90 * positive.
LOW, HIGH = 30, 90


def _matrix(column: pd.Series, width: int | None = None) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    rows = [np.asarray(v, np.int64) for v in column]
    out = np.zeros((len(rows), width or max(map(len, rows), default=0)), np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: floats where every partial sum is an exact one, integers otherwise."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(width, 1)
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T if most < 2**63 else (a.astype(object) @ b.astype(object).T)


def fit(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's iterations from evenly spaced distinct rows."""
    distinct = np.unique(rows, axis=0)
    centers = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)].astype(float)
    for _ in range(rounds):
        near = np.argmin((centers**2).sum(1) - 2 * rows @ centers.T, axis=1)
        count = np.bincount(near, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, near, rows)
        centers[count > 0] = total[count > 0] / count[count > 0, None]
    return centers


def _search(lists: DataFrame, blocks: dict[int, int], centers: np.ndarray, radius: np.ndarray, anchors: DataFrame, groups: int, k: int, same: bool) -> DataFrame:
    """The first k rows of each window (anchor, slot) of anchors (anchor, anchor_id, label, vector, lows, highs).

    same: among rows of the anchor's label, the anchor's own id left out; otherwise among rows of other labels.
    """
    spark = anchors.sparkSession
    shared = spark.sparkContext.broadcast((centers, radius, np.array([blocks.get(i, 0) for i in range(len(centers))])))
    found, start, take = None, 0, FIRST

    def wanted(batches: Iterator[pd.DataFrame], start: int, end: int) -> Iterator[pd.DataFrame]:
        """A row for each block of each list that an anchor has to visit at the places start to end of its order."""
        centers, radius, blocks = shared.value
        for part in (b.iloc[i : i + 1024] for b in batches for i in range(0, len(b), 1024)):
            q = _matrix(part["vector"], centers.shape[1]).astype(float)
            dot, reach = q @ centers.T, np.sqrt((q**2).sum(1))[:, None] * radius
            slack = 1e-9 * (np.abs(dot) + reach) + 1e-3
            up, down = dot + reach + slack, dot - reach - slack
            up[:, blocks == 0] = -np.inf
            order = np.argsort(-up, axis=1, kind="stable")[:, start:end]
            for i, row in enumerate(part.itertuples(index=False)):
                lows, highs = np.asarray(row.lows, float), np.asarray(row.highs, float)
                kth = np.array([-np.inf if x is None or x != x else x for x in row.kth], float) if row.kth is not None else np.full(len(lows), -np.inf)
                mine = order[i]
                mine = mine[np.isfinite(up[i, mine])]
                need = (up[i, mine][:, None] >= np.maximum(lows, kth)) & (down[i, mine][:, None] <= highs)
                visit = mine[need.any(1)]
                where = [(c, b) for c in visit.tolist() for b in range(blocks[c])]
                if where:
                    yield pd.DataFrame({"cluster": [c for c, _ in where], "block": [b for _, b in where]}).assign(
                        group=row.group, anchor=row.anchor, anchor_id=row.anchor_id, label=row.label, vector=[row.vector] * len(where), lows=[row.lows] * len(where), highs=[row.highs] * len(where), kth=[np.where(np.isfinite(kth), kth, -(2.0**62)).astype(np.int64)] * len(where)
                    )

    def meet(block: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        """What a block has for a group of anchors: the first k rows of each window, none below the k-th score so far."""
        if block.empty or asks.empty:
            return pd.DataFrame({c: [] for c in ("anchor", "slot", "score", "vec_id", "row")})
        block = block.sort_values("vec_id", kind="stable")
        ids, labels, rows = (block[c].to_numpy() for c in ("vec_id", "label", "row"))
        vectors, out = _matrix(block["vector"]), []
        for begin in range(0, len(asks), 512):
            part = asks.iloc[begin : begin + 512]
            scores = products(_matrix(part["vector"]), vectors)
            for i, a in enumerate(part.itertuples(index=False)):
                mask = (labels == a.label) & (ids != a.anchor_id) if same else labels != a.label
                at = np.flatnonzero(mask)
                own = scores[i, at]
                for slot, (low, high, kth) in enumerate(zip(a.lows, a.highs, a.kth, strict=True)):
                    fits = np.flatnonzero((own >= max(low, kth)) & (own <= high))
                    if len(fits) > 4 * k:
                        edge = np.partition(own[fits], len(fits) - k)[len(fits) - k]
                        fits = fits[own[fits] >= edge]
                    fits = fits[np.argsort(-own[fits], kind="stable")][:k]  # ids rise, so ties stay in their order
                    out += [(a.anchor, slot, int(own[x]), ids[at[x]], rows[at[x]]) for x in fits.tolist()]
        return pd.DataFrame(out, columns=["anchor", "slot", "score", "vec_id", "row"])

    fields = "anchor long, slot int, score long, vec_id long, row long"
    asked = "cluster int, block int, group int, anchor long, anchor_id long, label long, vector array<long>, lows array<long>, highs array<long>, kth array<long>"
    anchors = anchors.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int"))
    place = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    while start < len(centers):
        if found is None:
            state = anchors.withColumn("kth", F.lit(None).cast("array<long>"))
        else:
            last = found.where(F.col("place") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("last"))
            kth = F.transform("lows", lambda _, slot: F.col("last")[slot.cast("int")])
            state = anchors.join(last, "anchor", "left").withColumn("kth", kth).drop("last")
        asks = save(state.mapInPandas(lambda b, s=start, e=start + take: wanted(b, s, e), asked), "negative-asks")
        start, take = start + take, take * GROWTH
        if asks.isEmpty():
            continue
        copies = lists.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        keys = ("cluster", "block", "group")
        new = copies.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(meet, fields)
        both = new if found is None else new.unionByName(found.drop("place"))
        found = save(both.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k), "negative-found")
    return found if found is not None else spark.createDataFrame([], f"{fields}, place int")


def build(rows: DataFrame) -> tuple[DataFrame, dict[int, int], np.ndarray, np.ndarray]:
    """Lists (cluster, block, row, vec_id, label, vector), the blocks of each list, centroids and radii, over all rows."""
    count = rows.count()
    k = max(1, min(CLUSTERS, round(count**0.5)))
    sample = hash_sample(rows.select("row", "vector"), SAMPLE, "row").select("vector").toPandas()
    centers = fit(_matrix(sample["vector"], rows.agg(F.max(F.size("vector"))).first()[0]).astype(float), k)
    shared = rows.sparkSession.sparkContext.broadcast(centers)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centers = shared.value
        for part in batches:
            v = _matrix(part["vector"], centers.shape[1]).astype(float)
            best = np.argmin((centers**2).sum(1) - 2 * v @ centers.T, axis=1)
            far = np.sqrt(((v - centers[best]) ** 2).sum(1))
            yield part.assign(cluster=best.astype(np.int32), far=far * (1 + 1e-9) + 1e-6)

    dealt = save(rows.mapInPandas(near, "row long, vec_id long, label long, vector array<long>, cluster int, far double"), "negative-lists")
    sizes = dealt.groupBy("cluster").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # a row for each centroid
    radius = np.zeros(len(centers))
    for r in sizes:
        radius[r.cluster] = r.far
    blocks = {r.cluster: -(-r.n // BLOCK) for r in sizes}
    many = F.broadcast(rows.sparkSession.createDataFrame(list(blocks.items()) or [(0, 1)], "cluster int, blocks int"))
    lists = dealt.join(many, "cluster").select("cluster", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), "row", "vec_id", "label", "vector")
    return lists, blocks, centers, radius


def mine(embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows where is_anchor holds.

    embeddings has vec_id, label and embedding; other columns play no part. Rows with a null id or label, a null vector, or a null or
    non-finite component take no part. Components become floor(256 x); scores are integer inner products (they must fit 64 bits), vectors of other lengths
    meet as if filled with zeros. Higher scores come first, then smaller ids. Rows that repeat an id are searched for and found
    each by itself, but an anchor's positives have other ids than its own. Anchors without positives, positives without negatives in
    their window (as all with a negative score) and empty tables give no rows.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    some = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    rows = save(some.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks")), "negative-rows")
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    anchors = rows.where("asks").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "vector")
    asking = anchors.count()
    if not asking:
        return embeddings.sparkSession.createDataFrame([], out)
    lists, blocks, centers, radius = build(rows.drop("asks"))
    groups = -(-asking // GROUP)
    none = 2**62
    whole = anchors.withColumn("lows", F.array(F.lit(-none))).withColumn("highs", F.array(F.lit(none)))
    best = _search(lists, blocks, centers, radius, whole, groups, positives, same=True)
    best = best.select("anchor", (F.col("place") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("p"))
    low = F.transform("p", lambda p: F.ceil(p["positive_score"].cast("decimal(20,0)") * LOW / 100).cast("long"))
    high = F.transform("p", lambda p: F.floor(p["positive_score"].cast("decimal(20,0)") * HIGH / 100).cast("long"))
    asks = save(anchors.join(windows, "anchor").withColumn("lows", low).withColumn("highs", high).drop("p"), "negative-windows")
    hard = _search(lists, blocks, centers, radius, asks, groups, negatives, same=False)
    named = hard.join(best, ["anchor", "slot"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    return named.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
