"""Shared helpers of the corpus operators: scratch tables, text keys, bounded broadcasts, components."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word and line contracts: space, tab, LF, VT, FF, CR.
WHITE = " \t\n\x0b\x0c\r"
#: Words of letters, digits and everything beyond ASCII, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words between white space.
TOKEN = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """This application's folder in the one that all executors share. Only a local session may leave that unset: elsewhere
    driver and executors would write to different disks."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root or '/tmp/checkpoints'}/{context.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that save() made in this application, once no plan reads them."""
    _delete(spark, scratch_root(spark))


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: lineage ends there, executors may be lost."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # for discard()
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by save() that no later plan reads."""
    _delete(df.sparkSession, df._scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def column(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept_columns(df: DataFrame, *made: str) -> list[str]:
    """The columns of df but those that an operator makes or consumes; names are compared as Spark does, without case."""
    return [c for c in df.columns if c.lower() not in {m.lower() for m in made}]


def byte_text(text: Column) -> Column:
    """The text's UTF-8 bytes as one Latin-1 character each, lower-cased.

    Two texts give the same result if and only if they are equal after lower-casing A-Z alone:
    lower-casing bytes C0-DE only renames lead bytes of two-byte sequences, and how many
    continuation bytes follow still tells them from the three- and four-byte lead bytes.
    Bytes from 80 on stay there, so the ASCII word classes split it in the same places.
    """
    return F.lower(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"))


def words_of(text: Column) -> Column:
    """Array of the WORD words of byte_text(text); null text has none."""
    return F.filter(F.split(F.coalesce(byte_text(text), F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a saved table for broadcasting only if a count proves that it has at most max_rows rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def hash_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most `rows` rows, those of the smallest hashes of the columns key.

    A sort with a limit would send that many rows of every task to the driver. So only the lowest share of the
    hashes, that four times as many rows may be expected in, is sorted at all.
    """
    h = F.xxhash64(*key)
    share = 4 * rows / max(1, df.count())
    some = df.where(h < F.lit(int(share * 2**64) - 2**63)) if share < 1 else df
    return some.orderBy(h, *key).limit(rows)


def components(edges: DataFrame, name: str = "components", max_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's smallest node.

    Alternating large-star and small-star steps: each is a minimum per node and a join back, so
    nothing but counts reaches the driver and no component is gathered in one task. Every round
    ends in a table. Nodes without an edge don't appear.
    """
    pairs = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct()
    now = save(pairs, name)
    seen = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        then = save(small, name)
        mark = then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = then
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"{name}: no fixed point after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions)
