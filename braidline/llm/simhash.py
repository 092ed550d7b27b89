"""SimHash near-duplicates with pivot distance tables.

Texts become 64-bit fingerprints of their word shingles. Equal fingerprints are one node. Which nodes
to compare comes from keys: the 64 bits are cut into blocks, and two fingerprints that differ in at
most r bits agree in all but r of the blocks, so each choice of blocks - r of them is a key. The number of blocks
follows the number of nodes, so that a key has few members by chance. Within a key's members, the
distances to PIVOTS reference fingerprints are at hand for every node; a pair whose distances to some
pivot differ by more than r is discarded, survivors are verified. A member that is linked is not compared
again, so that a key emits a spanning forest of its members' links, and dense groups of
near copies cost about their size. A key of more than HOT members is compared in blocks, each two of which are a key of
their own, so that no task holds more than two blocks. Components over the links of all keys give the classes.

near_documents() serves documents by the similarity of their shingle sets instead, which few bits cannot
reach: there, min-hash bands are the keys, the sizes of the sets discard pairs that cannot be alike, and the
shingle sets verify all others. near_classes() with bits joins both: what the fingerprints link is one class, and so is what
the shingle sets link beyond them.

Defined results: null and empty texts have fingerprint zero and are linked like any other; fewer words than a
shingle has are one shingle; rows with equal ids stay rows of their own; null ids are never the
smallest; an empty table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidline.llm.common import broadcast_if_small, components, save

#: Reference fingerprints: the hashes of these many numbers.
PIVOTS = 24
SEED = 42
#: Rows that a task compares at a time, and the largest block of distances.
BLOCK = 1 << 18
#: Members of a key that are compared by one task, at most.
HOT = 1 << 12
#: Rows of keys with many members that are broadcast, at most (16 bytes each).
BROADCAST_ROWS = 200_000


def pivots() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(i), seed=SEED) for i in range(PIVOTS)], np.uint64)


def shingles(text: str | None, k: int) -> list[bytes]:
    """The k-word shingles of a text, repeats included."""
    words = (text or "").encode().lower().split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    return [line[starts[i] : ends[i + k - 1] - 1] for i in range(len(words) - k + 1)]


def hashes(text: str | None, k: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles(text, k)], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """A bit is one if more than half of the hashes have it."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for part in np.array_split(h, len(h) // 65536 + 1):
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(hashes(x.as_py(), k))) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp bigint")


def blocks_for(nodes: int, r: int) -> int:
    """Blocks to cut 64 bits into, so that a key's bits tell about as many nodes apart as there are; fewer blocks make fewer keys."""
    b = r + 1
    while b < 2 * r + 4 and (b - r) * (64 // b) < math.log2(max(nodes, 2)) - 1:
        b += 1
    return b


def block_keys(nodes: DataFrame, r: int, blocks: int) -> DataFrame:
    """(key, fp): all nodes under each choice of blocks - r blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - r):
        m = 0
        for i in chosen:
            m |= ((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i]
        masks.append(_signed(m))
    table = F.array(*[F.lit(m) for m in masks])
    keys = nodes.select("fp", F.posexplode(table).alias("i", "mask"))
    return keys.select(F.xxhash64("i", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")


def spread(fps: np.ndarray) -> np.ndarray:
    """The pivot distance table: a row for each fingerprint."""
    return np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)


def near(table: np.ndarray, fps: np.ndarray, i: np.ndarray, j: np.ndarray, r: int) -> np.ndarray:
    """Which pairs (i, j) are within r bits: pivots discard, the fingerprints verify."""
    at = np.arange(len(i))
    for p in range(table.shape[1]):
        at = at[np.abs(table[i[at], p] - table[j[at], p]) <= r]
    at = at[np.bitwise_count(fps[i[at]] ^ fps[j[at]]) <= r]
    stay = np.zeros(len(i), bool)
    stay[at] = True
    return stay


def forest(fps: np.ndarray, r: int) -> list[tuple[int, int]]:
    """Links within r bits that connect whatever is connected among fps: each member is taken up once."""
    table, links = spread(fps), []
    left = np.arange(len(fps))
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = []
            for a in front:
                if not len(left):
                    break
                hit = near(table, fps, np.full(len(left), a), left, r)
                if hit.any():
                    links += [(int(a), int(x)) for x in left[hit]]
                    reached.append(left[hit])
                    left = left[~hit]
            front = np.concatenate(reached) if reached else np.array([], np.int64)
    return links


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Runs of equal key of sorted batches, as the columns of many whole runs at a time."""
    held: list[np.ndarray] | None = None
    for b in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on
        if cut:
            yield [c[:cut] for c in now]
        held = [c[cut:] for c in now]
    if held is not None and len(held[0]):
        yield held


def link_members(keyed: DataFrame, r: int, linker: Callable[[np.ndarray, int], list[tuple[int, int]]] = forest) -> DataFrame:
    """(a, b): links among the members fp of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in _members(batches):
            fps = fp.view(np.uint64)
            edge = np.flatnonzero(np.diff(key)) + 1
            start, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
            size = end - start
            a, b = [], []
            two = start[size == 2]  # most keys by far
            if len(two):
                both, n = fps[np.concatenate([two, two + 1])], len(two)
                hit = near(spread(both), both, np.arange(n), np.arange(n, 2 * n), r)
                a.append(fp[two[hit]])
                b.append(fp[two[hit] + 1])
            for s, e in zip(start[size > 2], end[size > 2], strict=True):
                links = linker(fps[s:e], r)
                if links:
                    x = np.array(links)
                    a.append(fp[s:e][x[:, 0]])
                    b.append(fp[s:e][x[:, 1]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])

    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(parts, "key").sortWithinPartitions("key", "fp")
    return dealt.select("key", "fp").mapInArrow(run, "a bigint, b bigint")


def split_hot(keyed: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(key, fp) of keys with up to `most` members, and of the others once for each two of their blocks, under a key of those."""
    hot = save(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most), "hot-keys")
    few = broadcast_if_small(hot, BROADCAST_ROWS)
    blocks = F.ceil(F.col("n") / most).cast("int")
    dealt = keyed.join(few, "key").withColumn("mine", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    pair = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    return keyed.join(few, "key", "left_anti"), dealt.select(pair.alias("key"), "fp")


def link_fingerprints(nodes: DataFrame, r: int = 4, most: int = HOT) -> DataFrame:
    """(a, b) over the distinct fingerprints (column fp): links of at most r bits that connect all that is connected."""
    light, hot = split_hot(block_keys(nodes, r, blocks_for(nodes.count(), r)), most)
    return link_members(light.union(hot), r).distinct()


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, r: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: component_id is the smallest doc_id reachable over links of at most r bits."""
    rows = save(fingerprints(docs, id_col, text_col, k), "fingerprints")
    nodes = save(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp-nodes")
    links = save(link_fingerprints(nodes.select("fp"), r), "fp-links")
    roots = components(links, "fp-components")
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = save(named.join(smallest, "root").select("fp", "component_id"), "fp-classes")
    return rows.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Documents by the similarity of their shingle sets.

#: Min-hash values to a band and bands: at similarity 0.8 a pair shares a band with probability 1 - (1 - 0.8 ** 4) ** 14 = 0.9994.
BAND, BANDS = 4, 14
#: Members of a key whose pairs are all verified at once; of larger ones, each member is first verified against the
#: centres of its neighbourhood, then against all members that it is not connected with.
SMALL = 24
#: Share of min-hash values that a member must have in common with a centre to be verified against it.
ALIKE = 0.64
#: Members and shingles of a block of a large key: a task compares two blocks at a time.
CUT, CUT_SHINGLES = 256, 1 << 19
#: Shingles whose occurrences are multiplied at a time.
COLUMNS = 4096


def _bands(h: np.ndarray) -> tuple[list[int], bytes]:
    """Of the distinct shingle hashes h: a key for each band of min-hash values, and a byte of each value."""
    rng = np.random.default_rng(SEED)
    mul = rng.integers(1, 1 << 63, BAND * BANDS, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 63, BAND * BANDS, dtype=np.uint64)
    low = np.full(BAND * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for part in np.array_split(h, len(h) // 8192 + 1):
        if len(part):
            x = part[:, None] * mul[None, :] + add[None, :]
            low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(0))
    keys = [_signed(xxhash.xxh64_intdigest(low[i * BAND : (i + 1) * BAND].tobytes(), seed=i)) for i in range(BANDS)]
    return keys, (low & np.uint64(255)).astype(np.uint8).tobytes()


def stars(sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (centre, member) to verify among many members of one key, from their min-hash bytes, and all centres.

    A group of edited copies has its original in its middle: the centre is the member closest to the most frequent
    values. Whoever is alike to it is paired with it and leaves; the rest goes on with a centre of its own. Those who
    leave are also paired with the next centre where they are alike to it, so that neighbourhoods meet.
    """
    left, a, b, centres = np.arange(len(sigs)), [], [], []
    need = int(ALIKE * sigs.shape[1])
    while len(left):
        here = sigs[left]
        counts = np.zeros((sigs.shape[1], 256), np.int64)
        for i in range(sigs.shape[1]):
            counts[i] = np.bincount(here[:, i], minlength=256)
        centre = left[(here == counts.argmax(1)[None, :]).sum(1).argmax()]
        alike = (sigs == sigs[centre]).sum(1) >= need
        alike[centre] = False
        centres.append(centre)
        members = np.flatnonzero(alike)
        a.append(np.full(len(members), centre))
        b.append(members)
        left = left[~alike[left] & (left != centre)]
    return np.concatenate(a), np.concatenate(b), np.array(centres)


def _set_similarity(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): classes of documents linked by shingle sets of at least that similarity."""
    return near_classes(docs, id_col, text_col, k, similarity).select("doc_id", "component_id")


def fingerprint_links(rows: DataFrame, r: int) -> DataFrame:
    """(a, b): of the rows (node, fp), links that join the nodes of each class of fingerprints; a class is a star around its smallest node."""
    fps = save(rows.select("fp", "node").distinct(), "fp-nodes")
    links = save(link_fingerprints(fps.select("fp").distinct(), r), "fp-links")
    roots = components(links, "fp-components").select(F.col("node").alias("fp"), "root")
    named = fps.join(roots, "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    centres = named.groupBy("root").agg(F.min("node").alias("a"), F.max("node").alias("other")).where("a < other").select("root", "a")
    return named.join(centres, "root").where("a < node").select("a", F.col("node").alias("b")).distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, bits: int | None = None) -> DataFrame:
    """(doc_id, text_hash, root, component_id) for each row: root names its class, also where no row of it has an id.

    bits: documents whose fingerprints (see fingerprints()) differ in at most so many bits are linked too, before the sets are.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, bands, sigs, sizes, fps = [], [], [], [], []
            for x in b.column(2):
                text = x.as_py()
                s = np.unique(hashes(text, k))
                fps.append(None if bits is None else _signed(fingerprint(hashes(text, 4))))
                keys, sig = _bands(s)
                nodes.append(_signed(xxhash.xxh64_intdigest(s.tobytes())))
                bands.append(keys if len(s) else [0])
                sigs.append(sig)
                sizes.append(len(s))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64())], names=["doc_id", "text_hash", "node", "bands", "sig", "size", "fp"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(hashes(x.as_py(), k)).tobytes() for x in b.column(1)], pa.binary())], names=["node", "s"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    rows = save(slim.mapInArrow(sketch, f"doc_id {kind}, text_hash bigint, node bigint, bands array<bigint>, sig binary, size bigint, fp bigint"), "shingle-rows")
    # Equal sets are one node, whatever the number of their documents.
    nodes = save(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("text_hash").alias("text_hash"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("size").alias("size")), "shingle-nodes")
    keyed = nodes.select(F.explode("bands").alias("key"), "node", "size")
    hot = save(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CUT), "hot-bands")
    few = broadcast_if_small(hot.select("key"), BROADCAST_ROWS)
    found = save(_band_pairs(keyed.join(few, "key", "left_anti"), similarity), "shingle-pairs")
    crowd = found.where("large").select(F.col("a").alias("key"), F.col("b").alias("node")).union(keyed.join(few, "key", "left_semi").select("key", "node"))
    crowd = save(crowd, "shingle-crowds")
    pairs = save(found.where("not large").select("a", "b").union(_star_pairs(crowd, nodes.select("node", "size", "sig"), similarity)).distinct(), "shingle-pairs")

    def sets(of: DataFrame) -> DataFrame:
        """(node, s): shingle sets only of what is verified, made again from one text of each node."""
        ends = of.distinct().join(nodes.select("node", "text_hash"), "node")
        texts = slim.select("text_hash", "text").join(ends, "text_hash").groupBy("node").agg(F.first("text").alias("text"))
        return save(texts.select("node", "text").mapInArrow(sets_of, "node bigint, s binary"), "shingle-ends")

    ends = sets(pairs.select(F.explode(F.array("a", "b")).alias("node")))

    @F.udf("double", useArrow=True)
    def alike(a: bytes, b: bytes) -> float:
        return _set_similarity(a, b)

    both = pairs.join(ends.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(ends.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    links = both.where(alike("sa", "sb") >= similarity).select("a", "b")
    links = save(links if bits is None else fingerprint_links(rows.select("node", "fp"), bits).union(links), "shingle-links")
    roots = save(nodes.join(components(links, "shingle-components"), "node", "left").select("node", "first", "size", F.coalesce("root", "node").alias("root")), "shingle-roots")
    # Members of large keys that are still apart: all their pairs, in blocks.
    apart = save(_block_pairs(crowd.join(roots.drop("first"), "node"), similarity), "shingle-blocks")
    named = roots
    if not apart.isEmpty():
        more = save(_block_links(apart.join(sets(apart.select("node")), "node"), similarity), "shingle-links")
        joined = components(more, "shingle-components").select(F.col("node").alias("root"), F.col("root").alias("joined"))
        named = roots.join(joined, "root", "left").select("node", "first", F.coalesce("joined", "root").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "text_hash", "node").join(named.join(smallest, "root").select("node", "root", "component_id"), "node").select("doc_id", "text_hash", "root", "component_id")


def _grouped(keyed: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run over the rows of keyed (key, node, ...), sorted by key and node within tasks."""
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(run, schema)


def _bounds(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last-plus-one places of the runs of two or more equal keys."""
    edge = np.flatnonzero(np.diff(key)) + 1
    start, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
    yield from zip(start[end - start > 1].tolist(), end[end - start > 1].tolist(), strict=True)


def _fit(size: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs (i, j) can be that similar: two sets are at most as similar as the ratio of their sizes."""
    return np.minimum(size[i], size[j]) / np.maximum(1, np.maximum(size[i], size[j])) >= similarity


def _band_pairs(keyed: DataFrame, similarity: float) -> DataFrame:
    """(a, b, large): nodes to verify among the members of small keys; of large ones, a is the key and b each member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, size in _members(batches):
            i, j, big = [], [], []
            for s, e in _bounds(key):
                if e - s <= SMALL:
                    x, y = np.triu_indices(e - s, 1)
                    i.append(s + x)
                    j.append(s + y)
                else:
                    big.append(np.arange(s, e))
            for x, y, large in ((i, j, False), (big, big, True)):
                if x:
                    x, y = np.concatenate(x), np.concatenate(y)
                    if not large:
                        stay = _fit(size, x, y, similarity)
                        x, y = x[stay], y[stay]
                    yield pa.RecordBatch.from_arrays([pa.array((key if large else node)[x], pa.int64()), pa.array(node[y], pa.int64()), pa.array(np.full(len(x), large))], names=["a", "b", "large"])

    return _grouped(keyed.select("key", "node", "size"), run, "a bigint, b bigint, large boolean")


def _star_pairs(crowd: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): nodes to verify among the members (key, node) of large keys; nodes has each one's (node, size, sig).

    Members are dealt to blocks of CUT. The centres of a key's blocks are members of the next level, until each key has one
    block or most members are centres; whatever is apart then is compared in full by blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, key, node, size, sig in _members(batches):
            i, j, kept = [], [], []
            edge = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                x, y, centres = stars(np.frombuffer(b"".join(sig[s:e]), np.uint8).reshape(e - s, -1))
                i.append(s + x)
                j.append(s + y)
                kept.append(s + centres)
            x, y, kept = np.concatenate(i), np.concatenate(j), np.concatenate(kept)
            stay = _fit(size, x, y, similarity)
            x, y = np.concatenate([x[stay], kept]), np.concatenate([y[stay], kept])  # a centre is its own pair
            yield pa.RecordBatch.from_arrays([pa.array(key[x], pa.int64()), pa.array(node[x], pa.int64()), pa.array(node[y], pa.int64())], names=["key", "a", "b"])

    parts = int(crowd.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs, members = None, crowd
    while True:
        many = save(members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CUT), "star-keys")
        blocks = F.ceil(F.coalesce("n", F.lit(1)) / CUT)
        dealt = members.join(broadcast_if_small(many, BROADCAST_ROWS), "key", "left").withColumn("block", F.xxhash64("key", F.pmod(F.xxhash64("node"), blocks)))
        dealt = dealt.join(nodes, "node").select("block", "key", "node", "size", "sig")
        made = save(dealt.repartition(parts, "block").sortWithinPartitions("block", "node").mapInArrow(run, "key bigint, a bigint, b bigint"), "star-pairs")
        links = made.where("a <> b").select("a", "b")
        pairs = links if pairs is None else pairs.union(links)
        if many.isEmpty():
            return pairs
        centres = save(made.where("a = b").select("key", F.col("a").alias("node")).join(broadcast_if_small(many.select("key"), BROADCAST_ROWS), "key", "left_semi"), "star-centres")
        if 2 * centres.count() > members.count():
            return pairs
        members = centres


def _block_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """(key, i, j, block, node, root, size): the members (key, node, size, root) of large keys, once for each pair of blocks
    (i, j) of their key that is to be compared.

    A member's group is its band of sizes, so wide that sets beyond the next band cannot be that similar, and its root if that
    has many members in the key. Groups are dealt to blocks by hash. Left out are only pairs of blocks of one root, and
    those of bands or sizes too far apart.
    """
    mixed = save(members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"), "mixed-keys")
    mine = members.join(broadcast_if_small(mixed, BROADCAST_ROWS), "key", "left_semi")
    owners = save(mine.groupBy("key", "root").agg(F.count("*").alias("n")).where(F.col("n") >= CUT // 2).select("key", "root"), "shingle-owners")
    mine = mine.join(broadcast_if_small(owners.withColumn("own", F.col("root")), BROADCAST_ROWS), ["key", "root"], "left")
    mine = mine.withColumn("band", F.floor(F.log(F.greatest("size", F.lit(1))) / math.log(1 / similarity) + 1e-9))
    group = ["key", "band", "own"]
    sums = mine.groupBy(*group).agg(F.ceil(F.greatest(F.count("*") / CUT, F.sum("size") / CUT_SHINGLES)).alias("blocks")).where("blocks > 1")
    many = broadcast_if_small(save(sums.select(F.xxhash64(*group, F.col("own").isNull()).alias("group"), "blocks"), "shingle-groups"), BROADCAST_ROWS)
    mine = mine.withColumn("group", F.xxhash64(*group, F.col("own").isNull())).join(many, "group", "left")
    block = F.xxhash64("group", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))))
    placed = save(mine.select("key", "node", "root", "size", "band", block.alias("block")), "shingle-placed")
    blocks = placed.groupBy("key", "band", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("size").alias("least"), F.max("size").alias("most"))
    x = blocks.select("key", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("from"), *[F.col(c).alias(f"{c}_i") for c in ("block", "low", "high", "least", "most")])
    y = blocks.select("key", "band", *[F.col(c).alias(f"{c}_j") for c in ("block", "low", "high", "least", "most")])
    fits = (F.col("most_i") / F.greatest(F.lit(1), "least_j") >= similarity) & (F.col("most_j") / F.greatest(F.lit(1), "least_i") >= similarity)
    apart = F.least("low_i", "low_j") < F.greatest("high_i", "high_j")
    once = (F.col("band") > F.col("from")) | (F.col("block_i") <= F.col("block_j"))
    both = x.join(y, ["key", "band"]).where(once & fits & apart).select("key", F.col("block_i").alias("i"), F.col("block_j").alias("j"))
    return placed.drop("band").join(both.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")), ["key", "block"])


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Common values of each set of x with each of y."""
    values, at = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    row, cut = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)]), sum(len(s) for s in x)
    here = np.bincount(at[:cut], minlength=len(values)).astype(bool) & np.bincount(at[cut:], minlength=len(values)).astype(bool)
    column = (np.cumsum(here) - 1)[at]
    row, column = row[here[at]], column[here[at]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    out = np.zeros((len(x), len(y)))
    for start in range(0, int(here.sum()), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        some = np.zeros((len(x) + len(y), COLUMNS), np.float32)
        some[row[a:b], column[a:b] - start] = 1
        out += some[: len(x)] @ some[len(x) :].T
    return out


def _block_links(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the roots that members (key, i, j, block, node, root, size, s) of each two blocks link."""

    def run(table: pa.Table) -> pa.Table:
        block, root, size = (table[c].to_numpy() for c in ("block", "root", "size"))
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["s"]]
        x, y = np.flatnonzero(block == table["i"][0].as_py()), np.flatnonzero(block == table["j"][0].as_py())
        asked = (root[x][:, None] != root[y][None, :]) & _fit(size, x[:, None], y[None, :], similarity)
        rows, columns = asked.any(1), asked.any(0)
        x, y, asked = x[rows], y[columns], asked[rows][:, columns]
        links = np.zeros((0, 2), np.int64)
        if len(x):
            both = _common([sets[i] for i in x], [sets[i] for i in y])
            i, j = np.nonzero(asked & (both / np.maximum(1, np.add.outer(size[x], size[y]) - both) >= similarity))
            links = np.unique(np.sort(np.stack([root[x[i]], root[y[j]]], 1), 1), axis=0)
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    return members.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()
