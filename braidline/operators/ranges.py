"""Global orders without a single task: rows are dealt to ranges, and what precedes a range comes from a table of the ranges' totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidline.scratch import table


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df dealt to ranges of the columns order, with its range as part_; saved, so that the ranges hold."""
    return table(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "ranges")


def _before(parts: DataFrame, total: str) -> DataFrame:
    """One row a range, so a window over all of them is small."""
    upto = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part_", F.expr(total).over(upto).alias("before_"))


def numbered(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """df with the place of each row in the order, from 1. Equal rows take places as they come."""
    rows = ranged(df, *order)
    before = _before(rows.groupBy("part_").agg(F.count("*").alias("n")), "sum(n)")
    here = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return rows.join(F.broadcast(before), "part_").withColumn(name, (here + F.coalesce("before_", F.lit(0))).cast("bigint")).drop("part_", "before_")


def greatest_before(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """df, of which order is unique, with the greatest value of the rows before."""
    rows = ranged(df, order)
    before = _before(rows.groupBy("part_").agg(F.max(value).alias("m")), "max(m)")
    here = F.max(value).over(Window.partitionBy("part_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(F.broadcast(before), "part_").withColumn(name, F.greatest(here, F.col("before_"))).drop("part_", "before_")
