"""Typed flattening of JSON columns, as expressions: no generator, no shuffle, no Python.

A JSON text becomes array<struct<path, type, value>> in document order with keys sorted at every level. One level is one
`transform` over variants; how many levels a column needs is read off its texts, so the plan has as many as its deepest row.

Three ways of looking at nested values:

* ``arguments``: objects are gone into, a list is one value; empty objects give nothing.
* ``scalars``: objects and lists are gone into, list members as ``[i]``; nulls and empty containers give nothing.
* ``leaves``: as scalars, but nulls are values too.

Types are object, list, string, integer, number, boolean and null. A value is a string itself or JSON text; numbers that are not integers are written as
doubles, so that 1.50 and 1.5 are the same. Whole numbers of over 18 digits count as integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WAYS = ("arguments", "scalars", "leaves")


def nesting(text: Column) -> Column:
    """How many containers deep a JSON text goes: a running count of brackets outside strings; 0 for scalars, null and other text."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r'"(\\.|[^"\\])*+"', ""), r"[^\[\]{}]", "")
    step = lambda s, c: F.struct((s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most"))
    letters = F.filter(F.split(bare, ""), lambda c: c != "")
    return F.aggregate(letters, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])


def deepest(df: DataFrame, *columns: str) -> int:
    """The nesting of the deepest text of the columns: one number from one pass."""
    return df.agg(F.max(F.greatest(F.lit(0), *[nesting(F.col(c)) for c in columns]))).first()[0] or 0


def _object(v: Column) -> Column:
    return v.try_cast("map<string,variant>")


def _list(v: Column) -> Column:
    return v.try_cast("array<variant>")


def variant_type(v: Column) -> Column:
    """object, list, string, integer, number, boolean or null; null for no variant at all."""
    name = F.schema_of_variant(v)
    digits = F.regexp_extract(name, r"^DECIMAL\((\d+),0\)$", 1)
    return (
        F.when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "list")
        .when(name == "STRING", "string")
        .when(name.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
        .when(digits.try_cast("int") > 18, "integer")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null")
        .when(name.isNotNull(), "number")
    )


def value_text(v: Column, kind: Column) -> Column:
    """The value as text: strings as they are, numbers that are not integers as doubles, all else as JSON."""
    return F.when(kind == "number", v.try_cast("double").cast("string")).when(kind == "string", v.try_cast("string")).otherwise(F.to_json(v))


def flattened(text: Column, way: str, depth: int) -> Column:
    """array<struct<path string, type string, value string>> of a JSON text; null for text that is no JSON.

    depth: containers to open, deepest() of the column; what lies deeper would stay one value of type object or list.
    """
    if way not in WAYS:
        raise ValueError(f"{way} is none of {', '.join(WAYS)}")
    node = lambda path, v: F.struct(path.alias("path"), v.alias("v"))

    def opened(n: Column) -> Column:
        path, v = n["path"], n["v"]
        inner = F.transform(F.map_entries(_object(v)), lambda e: node(F.when(path == "", e["key"]).otherwise(F.concat(path, F.lit("."), e["key"])), e["value"]))
        if way == "arguments":
            return F.coalesce(inner, F.array(n))
        members = F.transform(_list(v), lambda x, i: node(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), x))
        return F.coalesce(inner, members, F.array(n))

    parsed = F.try_parse_json(text)
    nodes = F.array(node(F.lit(""), parsed))
    for _ in range(depth):
        nodes = F.flatten(F.transform(nodes, opened))
    typed = F.transform(nodes, lambda n: F.struct(n["path"].alias("path"), variant_type(n["v"]).alias("type"), n["v"].alias("v")))
    if way == "scalars":
        typed = F.filter(typed, lambda n: n["type"].isin("string", "integer", "number", "boolean"))
    elif way == "leaves":
        typed = F.filter(typed, lambda n: ~n["type"].isin("object", "list"))
    else:
        typed = F.filter(typed, lambda n: n["type"] != "object")
    out = F.transform(typed, lambda n: F.struct(n["path"].alias("path"), n["type"].alias("type"), value_text(n["v"], n["type"]).alias("value")))
    return F.when(parsed.isNotNull(), out)


def flat_rows(df: DataFrame, text: str, way: str, *keep: str) -> DataFrame:
    """A row (keep columns, path, type, value) for each entry of the column `text`. Rows without JSON, or with nothing in it, give none."""
    return df.select(*keep, F.explode(flattened(F.col(text), way, deepest(df, text))).alias("_f")).select(*keep, "_f.path", "_f.type", "_f.value")
