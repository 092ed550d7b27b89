"""Hashed identities, splits and opaque names."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 24 hex digits of the SHA-256 of the parts, joined by the unit separator."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws(chr(31), *[p.cast("string") for p in parts]), 256), 1, 24))


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys and no spaces, so that equal values have equal text; null where it does not parse."""

    def dump(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(dump)


def hash_share(*parts: Column) -> Column:
    """A number in [0, 1) from the JSON array of the parts: the first 12 hex digits of its SHA-256."""
    body = F.concat(F.lit("["), F.concat_ws(",", *[F.concat(F.lit('"'), p.cast("string"), F.lit('"')) for p in parts]), F.lit("]"))
    return F.conv(F.substring(F.sha2(body, 256), 1, 12), 16, 10).cast("double") / F.pow(F.lit(16.0), F.lit(12))


def split_name(share: Column, train: float = 0.6, validation: float = 0.8) -> Column:
    return F.when(share < train, "train").when(share < validation, "validation").otherwise("test")


def opaque_names(df: DataFrame, column: str, seed: str, prefix: str = "item") -> DataFrame:
    """The distinct values of a column, numbered by the order of sha256(seed, NUL, value).

    The order is global; the number comes from sorted partitions and their sizes, not from one task.
    """
    ranked = df.select(F.col(column).cast("string").alias(column)).distinct().withColumn("rank", F.sha2(F.concat(F.lit(seed + "\0"), F.col(column)), 256))
    return numbered(ranked, "rank", column).select(column, F.concat(F.lit(f"{prefix}_"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("opaque"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with its global place n, from 1: hex prefixes of a hash deal the rows to ranges whose sizes are added up."""
    head = F.substring(F.col(order[0]), 1, 2)
    sizes = df.groupBy(head.alias("head")).count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 256 rows
    place = F.row_number().over(Window.partitionBy("head").orderBy(*order))
    return df.withColumn("head", head).join(F.broadcast(before.select("head", "before")), "head").withColumn("n", place + F.col("before")).drop("head", "before")
