"""Tables in the folder that all executors share: what several parts of a plan read is computed once, and lineage ends there."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings while sessions are kept together: joins by session_id and more take sides as they lie if both lie by session_id, and buckets
#: are read as such also below unions and writes.
TOGETHER = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
#: In how many parts sessions lie while plans keep them together.
PARTS = "spark.braidline.sessionParts"
_BEFORE = "spark.braidline.before."
#: Input rows of a part.
ROWS = 20_000


def together(rows: DataFrame, key: str) -> DataFrame:
    """rows in parts of whole sessions; until apart(), tables lie so too, and joins, aggregates and windows of sessions need no further exchange."""
    spark = rows.sparkSession
    if spark.conf.get(PARTS, None) is None:
        for name, value in TOGETHER.items():
            spark.conf.set(_BEFORE + name, spark.conf.get(name))
            spark.conf.set(name, value)
        spark.conf.set(PARTS, str(max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / ROWS))))
    return rows.repartition(int(spark.conf.get(PARTS)), key)


def apart(spark: SparkSession) -> None:
    """Settings as they were before together(): other plans have keys of few values."""
    if spark.conf.get(PARTS, None) is not None:
        for name in TOGETHER:
            spark.conf.set(name, spark.conf.get(_BEFORE + name))
            spark.conf.unset(_BEFORE + name)
        spark.conf.unset(PARTS)


def root(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir. Only a local session may leave that unset: elsewhere driver and executors
    would write to different disks."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or '/tmp/checkpoints'}/{context.applicationId}"


def table(df: DataFrame, name: str, lies: bool = False) -> DataFrame:
    """df written to a new table and read back; in buckets of whole sessions while they are kept together.

    lies: each partition holds rows of one bucket already, as in a union of what was kept together, whose files then add up.
    """
    spark, key = df.sparkSession, uuid.uuid4().hex
    path = f"{root(spark)}/{name}-{key}"
    parts = spark.conf.get(PARTS, None)
    if parts is None or "session_id" not in df.columns:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    # Spark exchanges no rows whose plan says that they lie in their parts, but a union says nothing. Ids are hexadecimal, which zstd halves.
    (df if lies else df.repartition(int(parts), "session_id")).write.bucketBy(int(parts), "session_id").option("path", path).option("compression", "zstd").saveAsTable(f"sessions_{key}")
    return spark.table(f"sessions_{key}")


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables of this application, once no plan reads them."""
    delete(spark, root(spark))
