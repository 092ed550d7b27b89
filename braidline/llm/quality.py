"""Host-level quality rules.

Every document is measured whole; what fails by a rule is counted by host, each host's failure rate is
shrunk towards the corpus by a beta prior fitted to the hosts' rates by moments, and the verdict on
the host is joined back to its documents. A document is rejected if it fails the base rules, or if
its host's shrunken rate is above max_host_rate.

Defined results: null and empty texts have no words and fail; a null host is a host of its own;
repeated rows count as often as they occur; without two hosts whose rates differ, the prior is PRIOR;
extra columns pass through, but for the ten measures, which are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidline.llm.common import column, kept_columns, save

SYMBOLS = "#*$%&|<>"
#: Words in a window whose repetition counts.
WINDOW = 5
#: Alpha and beta where the hosts' rates do not determine them.
PRIOR = (1.0, 9.0)
#: Host tables of at most this many rows (about 60 bytes each) are broadcast.
BROADCAST_ROWS = 50_000

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_word = re.compile(r"[^\x20\x09-\x0D]")


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of WINDOW words that occurs twice or more."""
    if len(words) <= WINDOW:
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total = end = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + WINDOW - max(i, end)
            end = i + WINDOW
    return total


def measure(text: str | None) -> tuple[int, ...]:
    """The six MEASURES of a text."""
    text = text or ""
    words = text.encode().split()
    lines = text.split("\n")
    seen: set[str] = set()
    dup = 0
    for line in lines:
        if line in seen:
            dup += 1
        elif _word.search(line):
            seen.add(line)
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines), dup, repeated_words(words)


def _measured(at: int, keep_text: bool):
    """Appends the MEASURES of column number `at`, which goes unless keep_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([measure(x.as_py()) for x in batch.column(at)], np.int64).reshape(-1, len(MEASURES))
            rest = [i for i in range(batch.num_columns) if keep_text or i != at]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + [pa.array(made[:, j]) for j in range(len(MEASURES))], names=[batch.schema.names[i] for i in rest] + list(MEASURES))

    return run


def host_rates(rows: DataFrame, host_col: str) -> DataFrame:
    """(host, n, failed, rate, host_rate): host_rate is the posterior mean under the prior fitted to all hosts."""
    hosts = rows.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("failed"))
    hosts = save(hosts.withColumn("rate", F.col("failed") / F.col("n")), "hosts")
    m = hosts.agg(F.count("*").alias("k"), F.avg("rate").alias("mean"), F.var_samp("rate").alias("var"), F.avg(F.lit(1.0) / F.col("n")).alias("inv")).first()
    alpha, beta = PRIOR
    if m.k and m.k > 1:
        spread = m["var"] - m["mean"] * (1 - m["mean"]) * m["inv"]  # what differs beyond binomial chance
        limit = m["mean"] * (1 - m["mean"])
        if limit > 0:  # hosts that differ by chance alone are pooled strongly, hosts that differ wholly by one row at least
            size = 1000.0 if spread <= 0 else max(1.0, limit / spread - 1)
            alpha, beta = m["mean"] * size, (1 - m["mean"]) * size
    return hosts.withColumn("host_rate", (F.col("failed") + F.lit(float(alpha))) / (F.col("n") + F.lit(float(alpha + beta))))


def quality_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", keep: list[str] | None = None, max_host_rate: float = 0.8, max_symbols: float = 0.25, max_dup_lines: float = 0.5) -> DataFrame:
    """The columns keep of docs (all unless given), with MEASURES, base_failed, rule_failed, host_rate and kept.

    rule_failed, the failure that hosts are judged by: base_failed, or more than max_symbols symbols a word,
    or more than max_dup_lines of the lines repeated.
    """
    made = kept_columns(docs, *MEASURES, "base_failed", "rule_failed", "host_rate", "kept")
    keep = [c for c in (docs.columns if keep is None else keep) if c in made]
    columns = [column(c).alias(f"k{i}") for i, c in enumerate(keep)]
    keep_text = text_col in keep
    slim = docs.select(*columns, column(host_col).alias("host__"), *([] if keep_text else [column(text_col).alias("text__")]))
    at = keep.index(text_col) if keep_text else len(slim.columns) - 1
    kinds = [f for i, f in enumerate(slim.schema.fields) if keep_text or i != at]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kinds] + [f"{m} bigint" for m in MEASURES])
    rows = slim.mapInArrow(_measured(at, keep_text), schema)
    rows = rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    rows = save(rows.withColumn("rule_failed", F.col("base_failed") | (F.col("n_symbols") > max_symbols * F.col("n_words")) | (F.col("n_dup_lines") > max_dup_lines * F.col("n_lines"))), "quality-rows")
    hosts = save(host_rates(rows, "host__").select("host", "host_rate"), "host-rates")
    few = hosts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        rows = rows.join(F.broadcast(hosts), F.col("host__").eqNullSafe(F.col("host")), "left")
    else:  # a host may hold a third of all rows: deal its rows to salts, and its verdict to each
        salts = 64
        salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("salt_", F.pmod(F.xxhash64(*[f.name for f in kinds]), F.lit(salts)).cast("int"))
        rows = rows.join(salted, F.col("host__").eqNullSafe(F.col("host")) & (F.col("salt_") == F.col("salt")), "left")
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_host_rate))
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *MEASURES, "base_failed", "rule_failed", "host_rate", "kept")
