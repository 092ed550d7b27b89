"""Exact dedup: a persistent index of text digests, bucketed and sorted by digest.

The index is a folder of segments. A segment is a table of digests, bucketed and sorted by them, with one file a
bucket, so that joining a batch with all segments needs neither an exchange nor a sort of any segment. A batch is first
reduced to its distinct digests, with partial sums where the rows are, then sort-merge-anti-joined with the segments, and
what is left is appended as a segment of its own. A segment counts once Spark has committed it (`_SUCCESS`); what a lost driver
left half written is ignored. When segments become many they are merged into one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidline.llm.common import WHITE, column, kept_columns, save, scratch_root

#: Texts that more rows share than this, or than a 200,000th of all rows, meet their rows by broadcast: at most 200,000 digests.
HOT_ROWS, HOT_KEYS = 1000, 200_000
#: Segments that an index may have before they are merged.
SEGMENTS = 8


def normal_text(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Spark trusts the order inside bucket files only on request, and only where each bucket has one file."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class DigestIndex:
    """Digests of all texts added so far, (digest, load, keep_row, keep_id, chars, n), in segments under `path`.

    `buckets` is fixed when the index is made; an index that is opened again keeps what its segments were written with.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.segments: list[tuple[str, DataFrame]] = []
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        found = sorted(s.getPath().getName() for s in self._files.listStatus(where)) if self._files.exists(where) else []
        done = [f for f in found if f.startswith(("segment-", "merged-")) and self._files.exists(self._at(f"{f}/_SUCCESS"))]
        # A merge names the last segment that it holds: those up to it are no longer read.
        last = max((int(f.split("-")[1]) for f in done if f.startswith("merged")), default=-1)
        live = [f for f in done if int(f.split("-")[1]) > last or f.startswith("merged") and int(f.split("-")[1]) == last]
        self.buckets = int(live[0].split("-")[2]) if live else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._next = 1 + max((int(f.split("-")[1]) for f in done), default=-1)
        for folder in sorted(live, key=lambda f: int(f.split("-")[1])):
            if not any(s.getPath().getName().startswith("part-") for s in self._files.listStatus(self._at(folder))):
                continue  # a batch without a new digest
            schema = spark.read.parquet(f"{path}/{folder}").schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            table = self._name()
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/{folder}'")
            self.segments.append((folder, spark.table(table)))

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    @staticmethod
    def _name() -> str:
        return f"digests_{uuid.uuid4().hex}"

    def _write(self, df: DataFrame, folder: str) -> DataFrame:
        """df as a bucketed table: rows that already lie in their buckets are not exchanged again."""
        table = self._name()
        df.write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.path}/{folder}").option("compression", "zstd").saveAsTable(table)
        return self.spark.table(table)

    def add(self, batch: DataFrame) -> DataFrame:
        """Append those digests of batch (digest, load, keep_row, keep_id, chars, n; each digest once) that no segment holds.

        The batch is returned as it was written; tidy() deletes it.
        """
        folder = f"segment-{self._next}-{self.buckets}"
        with _sorted_scans(self.spark):
            if self.segments:
                # The batch lies in buckets of its own first, so that the anti joins exchange and sort neither side.
                met = self._write(batch.repartition(self.buckets, "digest"), f"batch-{uuid.uuid4().hex}")
                fresh = reduce(lambda rows, s: rows.join(s[1].select("digest").hint("merge"), "digest", "left_anti"), self.segments, met)
                out = self._write(fresh, folder)
            else:
                met = out = self._write(batch.repartition(self.buckets, "digest"), folder)
        self.segments.append((folder, out))
        self._next += 1
        return met

    def tidy(self) -> None:
        """Delete batches, and merge the segments if they are many; no plan may still read either."""
        for s in self._files.listStatus(self._at("")):
            if s.getPath().getName().startswith("batch-"):
                self._files.delete(s.getPath(), True)
        if len(self.segments) > SEGMENTS:
            self._merge()

    def _merge(self) -> None:
        """All segments become one; the old files go only when the new one is committed."""
        old = list(self.segments)
        folder = f"merged-{self._next - 1}-{self.buckets}"
        rows = reduce(DataFrame.unionByName, [s for _, s in old]).repartition(self.buckets, "digest")
        self.segments = [(folder, self._write(rows, folder))]
        for gone, _ in old:
            self._files.delete(self._at(gone), True)

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [s for _, s in self.segments])


def dedup_exact(docs: DataFrame, keep: list[str] | None = None, index: DigestIndex | None = None, batches: int = 4) -> DataFrame:
    """Columns `keep` (all, unless given) of every row of docs, with keep_id, group_size, kept and text_sha256.

    Texts are equal if they are once white space is deleted. Of equal texts the row with the most code points stays, then the
    smallest doc_id (null last), then the first as read: of rows that repeat each other exactly one stays. Rows go to the index
    in batches from the longest texts to the shortest, each of whole lengths, so what a batch finds in the index is never
    shorter than its own rows and always stays. An index that held digests before keeps them: rows that meet those go,
    keep_id is the id stored there, and group_size counts the rows of docs alone. Null and empty texts, and those of white
    space alone, are equal. Columns of docs named like a result are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    names = kept_columns(docs.select(*[column(c) for c in keep]) if keep else docs, "keep_id", "group_size", "kept", "text_sha256")
    own = F.struct(*[column(c) for c in names]) if names else F.struct(F.lit(None).alias("none"))
    rows = save(docs.select(own.alias("own"), column("doc_id").alias("doc_id"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), F.unhex(F.sha2(normal_text(F.col("text")), 256)).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    index = index or DigestIndex(spark, f"{scratch_root(spark)}/digest-index-{uuid.uuid4().hex}")
    load = uuid.uuid4().int >> 65  # tells the row numbers of this call from those of earlier ones
    cuts = sorted({*rows.approxQuantile("chars", [i / batches for i in range(1, batches)], 0.02)}, reverse=True)
    first = F.struct((-F.col("chars")).alias("short"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    met = []
    for low, high in zip([*cuts, None], [None, *cuts], strict=True):
        part = rows.where((F.lit(True) if low is None else F.col("chars") > low) & (F.lit(True) if high is None else F.col("chars") <= high))
        groups = part.groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("n"))
        met.append(index.add(groups.select("digest", F.lit(load).alias("load"), F.col("first.row").alias("keep_row"), F.col("first.doc_id").alias("keep_id"), (-F.col("first.short")).alias("chars"), "n")))
    held = index.rows().select("digest", F.when(F.col("load") == load, F.col("keep_row")).alias("keep_row"), "keep_id")
    total = reduce(DataFrame.union, [m.select("digest", "n") for m in met]).groupBy("digest").agg(F.sum("n").alias("group_size"))
    verdicts = save(total.join(held, "digest"), "digest-verdicts")
    index.tidy()
    count = rows.count()
    hot = F.broadcast(save(verdicts.where(F.col("group_size") > max(HOT_ROWS, count // HOT_KEYS)), "digest-hot"))
    cold = rows.join(hot.select("digest"), "digest", "left_anti").join(verdicts, "digest")
    out = [*[F.col("own").getField(c).alias(c) for c in names], "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
    return rows.join(hot, "digest").select(*out).unionByName(cold.select(*out))
