"""Content-addressed archive, immutable artifacts and checked readers of annotation sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidline.functions.identity import canonical_json
from braidline.sources.checked import json_lines

SCHEMA = "digest string, payload string"


def addressed(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(digest, payload): canonical JSON and its address; equal values have one row."""
    rows = payloads.select(canonical_json(F.col(column)).alias("payload")).where("payload is not null")
    return rows.select(F.concat(F.lit("sha256:"), F.sha2("payload", 256)).alias("digest"), "payload").dropDuplicates(["digest"])


def _stored(spark: SparkSession, path: str) -> DataFrame:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(SCHEMA + ", head string").parquet(path) if there else spark.createDataFrame([], SCHEMA + ", head string")


def put(payloads: DataFrame, path: str) -> None:
    """Append what the archive does not hold; partitions are the first two hex digits."""
    spark = payloads.sparkSession
    new = addressed(payloads).join(_stored(spark, path).select("digest"), "digest", "left_anti").withColumn("head", F.substring("digest", 8, 2))
    new.write.mode("append").partitionBy("head").parquet(path)


def get(spark: SparkSession, path: str, digests: DataFrame) -> DataFrame:
    return _stored(spark, path).join(digests.select("digest").distinct(), "digest", "left_semi").select("digest", "payload")


def broken(spark: SparkSession, path: str) -> DataFrame:
    """Objects whose payload does not hash to their address."""
    return _stored(spark, path).where(F.concat(F.lit("sha256:"), F.sha2("payload", 256)) != F.col("digest")).select("digest")


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """The union of two archives; one address with two payloads is an error."""
    both = left.select("digest", "payload").unionByName(right.select("digest", "payload")).distinct()
    bad = both.groupBy("digest").count().where("count > 1").limit(3).collect()
    if bad:
        raise ValueError(f"one address, several payloads: {[r.digest for r in bad]}")
    return both


def insert_artifacts(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows (id, hash, payload) of new that stored lacks; an id that is stored with another hash is an error."""
    clash = new.alias("n").join(stored.alias("s"), "id").where("n.hash <> s.hash").select("id").limit(3).collect()
    if clash:
        raise ValueError(f"artifacts cannot change: {[r.id for r in clash]}")
    return new.join(stored, "id", "left_anti")


def read_views(spark: SparkSession, path: str, schema: str | None = None, mode: str = "permissive") -> DataFrame:
    """Context views, one JSON document a line; blank lines are skipped. With a schema, lines that do not fit it are counted in a warning, or an
    error under `failfast`; without one it is inferred, and such a line is an error."""
    if schema is None:
        return spark.read.option("mode", "FAILFAST").json(path)
    return json_lines(spark, path, schema).under(mode)


def read_labels(spark: SparkSession, path: str, id_col: str, label_col: str, allowed: tuple[str, ...], rules: dict[str, str] | None = None) -> DataFrame:
    """(id, label) of an annotation sheet. Blank, repeated and unknown labels are errors, as are rows that break a rule (name: condition over the sheet's columns)."""
    sheet = spark.read.options(header="true", multiLine="true", escape='"').csv(path)
    sheet = sheet.toDF(*[c.removeprefix("\ufeff") for c in sheet.columns])
    rows = sheet.select("*", F.trim(F.col(id_col.removeprefix("\ufeff"))).alias("id_"), F.trim(label_col).alias("label_"))
    wrong = F.array(F.when(F.col("id_").isNull() | F.col("label_").isNull() | ~F.col("label_").isin(*allowed), "label"), *[F.when(~F.coalesce(F.expr(c), F.lit(False)), n) for n, c in (rules or {}).items()])
    bad = rows.select("id_", "label_", F.filter(wrong, lambda x: x.isNotNull()).alias("broken")).where(F.size("broken") > 0).limit(3).collect()
    twice = rows.groupBy("id_").count().where("count > 1").limit(3).collect()
    if bad or twice:
        raise ValueError(f"labels that cannot be read: {[tuple(r) for r in bad]}, ids that occur again: {[r.id_ for r in twice]}")
    return rows.select(F.col("id_").alias("id"), F.col("label_").alias("label"))
