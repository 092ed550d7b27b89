"""Line dedup over levelled sorted runs of line hashes. Native: DataFrame functions only.

Every line key of at least min_chars code points belongs to the smallest doc_id that holds it;
all other documents lose their lines with that key. Keys are kept in runs: tables of
(hash, owner) sorted by hash. Documents come in batches of ascending doc_id. A batch is merged
against the runs before it (a left anti sort-merge join on the hash) and adds what is new as a run of
level 0; as soon as a level holds fan_in runs, they are merged into one sorted run of the next level.
Keys of more than a thousandth of all lines, fewer than a thousand by that, meet their owners in a broadcast join, so
that a line which fills much of the corpus lands in no single task.

Defined results: a null or empty text is one empty line; null doc_ids come after all others and
never own a line that a document with an id holds; rows that share a doc_id are one document; ids are of any type that
has an order;
extra columns pass through unless they are named n_lines, n_dropped, which are replaced;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidline.llm.common import WHITE, byte_text, column, discard, hash_sample, kept_columns, save

KEY = ["h1", "h2"]
#: A key is heavy if it has more than this share of all lines.
HEAVY = 1 / 1000
#: Ids whose order gives the bounds of batches. They only say which batch a document is in; results do not depend on them.
BOUND_ROWS = 1000


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc_id, row, pos, h1, h2) of every line whose key has min_chars code points or more; row hashes the text."""
    lines = docs.select(column(id_col).alias("doc_id"), F.xxhash64(column(text_col)).alias("row"), F.posexplode(F.split(F.coalesce(column(text_col), F.lit("")), "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc_id", "row", "pos", F.btrim("line", F.lit(WHITE)).alias("line")).where(F.char_length("line") >= min_chars)
    key = lines.select("doc_id", "row", "pos", byte_text(F.col("line")).alias("key"))
    return key.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineRuns:
    """The runs of one corpus. add() takes the next batch of line keys, whose doc_ids are above all earlier ones."""

    def __init__(self, fan_in: int = 2) -> None:
        self.fan_in = fan_in
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> None:
        fresh = keys.groupBy(*KEY).agg(F.min("doc_id").alias("owner"))
        for run in self.runs():
            fresh = fresh.join(run.hint("merge"), KEY, "left_anti")
        self._push(save(fresh.sortWithinPartitions(*KEY), "line-run"), 0)

    def _push(self, run: DataFrame, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_in:
            old, self.levels[level] = self.levels[level], []
            self._push(save(_union(old).repartition(*KEY).sortWithinPartitions(*KEY), "line-run"), level + 1)
            for x in old:
                discard(x)

    def owners(self) -> DataFrame:
        return _union(self.runs())


def _union(runs: list[DataFrame]) -> DataFrame:
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out


def batch_bounds(docs: DataFrame, id_col: str, batches: int) -> list:
    """Ids, ascending, that cut the documents into about equal batches."""
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null")
    some = [r.id for r in hash_sample(ids, BOUND_ROWS, "id").orderBy("id").collect()]
    return list(dict.fromkeys(some[len(some) * i // batches] for i in range(1, batches))) if some else []


def owned(keys: DataFrame, owners: DataFrame) -> DataFrame:
    """keys with the owner of each."""
    least = max(1, int(keys.count() * HEAVY))
    heavy = save(keys.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") > least).select(*KEY), "heavy-keys")
    if heavy.isEmpty():
        return keys.join(owners, KEY)
    few = F.broadcast(heavy)  # under 1 / HEAVY keys
    columns = [*keys.columns, "owner"]
    many = keys.join(few, KEY, "left_semi").join(F.broadcast(owners.join(few, KEY, "left_semi")), KEY)
    return many.select(*columns).union(keys.join(few, KEY, "left_anti").join(owners, KEY).select(*columns))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 3) -> DataFrame:
    """docs with the text of the lines that stay, and n_lines, n_dropped. batches: how many runs the corpus is added in."""
    keys = save(line_keys(docs, id_col, text_col, min_chars), "line-keys")
    bounds = batch_bounds(docs, id_col, batches)
    edges = [None, *bounds, None]
    runs = LineRuns()
    for low, high in zip(edges, edges[1:], strict=False):
        part = keys
        if low is not None:
            part = part.where((F.col("doc_id") > low) | F.col("doc_id").isNull() if high is None else F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        runs.add(part)
    gone = owned(keys, runs.owners()).where(F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("doc_id")))
    gone = gone.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("gone"))
    kept = kept_columns(docs, text_col, "n_lines", "n_dropped")
    here = docs.select(*[column(c).alias(f"k{i}") for i, c in enumerate(kept)], column(id_col).alias("id"), column(text_col).alias("text"))
    text, lines = F.coalesce("text", F.lit("")), F.split(F.coalesce("text", F.lit("")), "\n", -1)
    here = here.join(gone, F.col("id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("text") == F.col("row")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return here.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], left.alias(text_col), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
