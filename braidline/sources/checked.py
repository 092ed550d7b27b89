"""Rows beside what could not be read: every reader that meets foreign files says what it left out.

A Checked holds `rows` and `faults`, (file, fault, record): the record is its text, cut to 1,000 characters. Permissive readers warn with counts; strict ones
raise and name the first few. Nothing is dropped without either.
"""

from __future__ import annotations

import warnings
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

FAULTS = "file string, fault string, record string"
MODES = ("permissive", "failfast")


class Checked(NamedTuple):
    rows: DataFrame
    faults: DataFrame

    def counts(self) -> dict[str, int]:
        """How many records have each fault, from one pass."""
        return {r.fault: r.n for r in self.faults.groupBy("fault").agg(F.count("*").alias("n")).collect()}

    def under(self, mode: str) -> DataFrame:
        """The rows: `failfast` raises if there is a fault, `permissive` warns."""
        if mode not in MODES:
            raise ValueError(f"{mode} is none of {', '.join(MODES)}")
        found = self.counts()
        if found:
            said = ", ".join(f"{n} x {fault}" for fault, n in sorted(found.items()))
            if mode == "failfast":
                raise ValueError(f"records that cannot be read: {said}; first ones: {[(r.file, r.fault) for r in self.faults.limit(3).collect()]}")
            warnings.warn(f"records left out: {said}", stacklevel=3)
        return self.rows


def split(rows: DataFrame, fault: Column, record: Column, *keep: str) -> Checked:
    """rows (file, ...) without a fault, as the columns `keep`, and the faults of the others."""
    marked = rows.withColumn("_fault", fault)
    bad = marked.where("_fault IS NOT NULL").select("file", F.col("_fault").alias("fault"), F.substring(record, 1, 1000).alias("record"))
    return Checked(marked.where("_fault IS NULL").select(*keep), bad)


def json_fault(value: Column) -> Column:
    """What keeps a text from being a JSON object; null if nothing does."""
    parsed = F.try_parse_json(value)
    return F.when(parsed.isNull(), "not JSON").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "no object")


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> Checked:
    """Objects of JSON lines under a schema; blank lines do not count. A line that is JSON but has a value of another type is a fault too."""
    kind = spark.createDataFrame([], schema).schema
    mark = "_corrupt"
    wide = StructType([*kind.fields, StructField(mark, StringType())])
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    read = lines.withColumn("row", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": mark}))
    fault = F.coalesce(json_fault(F.col("value")), F.when(F.col("row")[mark].isNotNull(), "another type than the schema's"))
    checked = split(read, fault, F.col("value"), "row")
    return Checked(checked.rows.select(*[F.col("row")[f.name].alias(f.name) for f in kind.fields]), checked.faults)
