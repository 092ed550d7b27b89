"""Benchmark decontamination by winnowing. Native: DataFrame functions only.

A window is span consecutive words of a benchmark item, or the whole of a shorter item. On both
sides every run of span words holds span-k+1 k-grams, of which the one with the smallest hash is its
fingerprint; a shared window therefore has a shared fingerprint. Documents keep those of their
fingerprints that a bitmap of the benchmark's may contain, each with the words around it; a join on
the hash leaves true fingerprints, and every hit is extended to the windows of span words
around it, which are compared as text with the benchmark's. Items of fewer than span words are looked up by
the hash of all their words, for each such length that the benchmark has.

Defined results: null and empty texts have no words; items without a word have no window; equal
windows of several items count for each; rows that share a doc_id are judged one by one; null ids pass
through; an empty benchmark contaminates nothing; extra columns pass through, whatever their names, but for n_words, n_hit
and items, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidline.llm.common import broadcast_if_small, column, kept_columns, save, words_of

#: Words of 64 bits in the largest bitmap, as a power of two; beyond that it lets more through and the join decides.
MAP_BITS = 14
MADE = ("n_words", "n_hit", "items")
#: Rows of the benchmark's fingerprints or windows that are broadcast at most (about 100 bytes each).
BROADCAST_ROWS = 50_000


def gram(words: Column, at: Column, n: int) -> Column:
    """Hash of the n words from index at on."""
    return F.xxhash64(F.lit(n), *[F.get(words, at + i) for i in range(n)])


def windows_of(bench: DataFrame, item_col: str, text_col: str, span: int) -> DataFrame:
    """(item, n, window): the distinct windows of every item, as text of n words."""
    items = bench.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("n", F.least(F.size("w"), F.lit(span)))
    return items.select("item", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("window")).distinct()


def bitmap(hashes: DataFrame) -> tuple[Column, int]:
    """A foldable array of 64-bit words with a bit for each of the hashes (column h), and the log of its length."""
    bits = min(MAP_BITS, max(4, hashes.count().bit_length() + 1))
    place = F.shiftrightunsigned("h", 64 - bits).cast("int")
    rows = hashes.groupBy(place.alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("m")).collect()
    table = [0] * (1 << bits)
    for r in rows:
        table[r.i] = r.m
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>"), bits


def maybe(table: tuple[Column, int], h: Column) -> Column:
    words, bits = table
    word = F.get(words, F.shiftrightunsigned(h, 64 - bits).cast("int"))
    return F.call_function("shiftright", word, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _short(words: Column, n: int, table: tuple[Column, int]) -> Column:
    """Marks of all places whose n words may be a whole item of n words."""
    found = F.filter(F.sequence(F.lit(0), F.size(words) - n), lambda i: maybe(table, gram(words, i, n)))
    return F.transform(found, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.lit(None).cast("bigint").alias("h"), F.slice(words, i + 1, n).alias("near")))


def item_sets(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(window, n, set) and (set, items): windows that the same items hold share a set, so that a hit is one row, not one for each item."""
    grouped = save(windows.groupBy("window", "n").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")).withColumn("set", F.sha2(F.to_json("items"), 256)), "bench-sets")
    return grouped.select("window", "n", "set"), grouped.select("set", "items").dropDuplicates(["set"])


def scan(docs: DataFrame, bench: DataFrame, *, text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", span: int = 10, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The saved (row, columns of docs but the text as k0, k1, ..., n_words, marks), the spans found (row, start, n, set) and the sets (set, items)."""
    held, sets = item_sets(windows_of(bench, item_col, bench_text, span))
    windows = held
    lengths = sorted(r.n for r in windows.where(F.col("n") < span).select("n").distinct().collect())
    full = windows.where(F.col("n") == span).select("window").distinct().withColumn("w", F.split("window", " "))
    width = span - k + 1
    prints = save(full.select(F.array_min(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: gram(F.col("w"), i, k))).alias("h")).distinct(), "bench-prints")

    words, g = F.col("w"), F.col("g")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *[column(c).alias(f"k{i}") for i, c in enumerate(kept_columns(docs, text_col, *MADE))], words_of(column(text_col)).alias("w"))
    rows = rows.withColumn("g", F.when(F.size("w") >= span, F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: gram(words, i, k))).otherwise(F.array().cast("array<bigint>")))

    def smallest(i: Column) -> Column:
        """Whether the k-gram at i has the smallest hash of some span around it."""
        out = F.lit(False)
        for first in range(width):
            inside = (i >= first) & (i - first + width <= F.size(g))
            others = [F.get(g, i) <= F.get(g, i - first + j) for j in range(width) if j != first]
            test = inside
            for x in others:
                test = test & x
            out = out | test
        return out

    known = bitmap(prints)
    picked = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: maybe(known, F.get(g, i)) & smallest(i))
    first = lambda i: F.greatest(i - (width - 1), F.lit(0))
    mark = lambda i: F.struct(first(i).alias("at"), F.lit(span).alias("n"), F.get(g, i).alias("h"), F.slice(words, first(i) + 1, i - first(i) + span).alias("near"))
    nothing = F.lit(None).cast("array<struct<at:int,n:int,h:bigint,near:array<string>>>")
    marks = [F.when(F.size(g) > 0, F.transform(picked, mark)).otherwise(nothing)]
    for n in lengths:
        marks.append(F.when(F.size("w") >= n, _short(words, n, bitmap(windows.where(F.col("n") == n).select(gram(F.split("window", " "), F.lit(0), n).alias("h")).distinct()))).otherwise(nothing))
    empty = F.array().cast("array<struct<at:int,n:int,h:bigint,near:array<string>>>")
    others = [c for c in rows.columns if c not in ("w", "g")]
    rows = save(rows.select(*others, F.size("w").cast("long").alias("n_words"), F.concat(*[F.coalesce(m, empty) for m in marks]).alias("marks")), "doc-marks")

    hits = rows.select("row", F.explode("marks").alias("m")).select("row", "m.*")
    long = hits.where(F.col("h").isNotNull()).join(broadcast_if_small(prints, BROADCAST_ROWS), "h", "left_semi")
    around = F.transform(F.sequence(F.lit(0), F.size("near") - span), lambda j: F.struct((F.col("at") + j).alias("start"), F.col("n").alias("n"), F.array_join(F.slice("near", j + 1, span), " ").alias("window")))
    tries = long.where(F.size("near") >= span).select("row", F.explode(around).alias("t")).select("row", "t.*")
    tries = tries.union(hits.where(F.col("h").isNull()).select("row", F.col("at").alias("start"), "n", F.array_join("near", " ").alias("window"))).distinct()
    return rows, tries.join(broadcast_if_small(windows, BROADCAST_ROWS), ["window", "n"]).select("row", "start", "n", "set"), sets


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without their text, with n_words, n_hit (words inside a benchmark window) and items (sorted as strings)."""
    rows, spans, sets = scan(docs, bench, text_col=text_col, **options)
    spans = save(spans, "spans")
    ends = spans.select("row", "start", "n").distinct().groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("s"))
    covered = F.aggregate("s", F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")), lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["total"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("total")), lambda a: a["total"])
    items = spans.select("row", "set").distinct().join(sets, "set").groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = ends.select("row", covered.cast("long").alias("n_hit")).join(items, "row")
    judged = rows.drop("marks").join(found, "row", "left")
    kept = [F.col(f"k{i}").alias(c) for i, c in enumerate(kept_columns(docs, text_col, *MADE))]
    return judged.select(*kept, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
