"""Token counts by offset-mapped attribution.

A whole document is encoded once. The vocabulary is byte-level and loses nothing, so the tokens' byte lengths give their
character spans; the document's sections are character spans too. Both lists are sorted, so their interval join is a
merge. A token that lies across a boundary is allocated by RULES: "first" to the section of its first character,
"last" to that of its last one, "largest" to the section that holds most of its characters (the earliest of equals).

Sections are the lines of a text; a line's newline belongs to it. Defined results: a null or empty text is one empty
section without tokens; every section has a row, with or without tokens; rows that share an id are counted each; null
ids pass through; extra columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "last", "largest")


class Spans:
    """Character spans of a text's tokens, for a rank file of byte-level merges and the pattern that splits before them."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.size[i] = len(piece)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and last character of each token; parts of one character share it."""
        size = self.size[self.encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=())]
        end = np.cumsum(size)
        if len(text) == (end[-1] if len(end) else 0):
            return end - size, end - 1
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character of each byte
        return char[end - size], char[end - 1]


@cache
def spans(path: str, pattern: str) -> Spans:
    """One for each worker process."""
    return Spans(path, pattern)


def sections(text: str) -> np.ndarray:
    """The first character of each line, and the text's length."""
    lines = text.split("\n")
    ends = np.cumsum([len(x) + 1 for x in lines])
    ends[-1] -= 1
    return np.concatenate([[0], ends])


def attribute(first: np.ndarray, last: np.ndarray, bounds: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens allocated to each section, and how many of them lie across a boundary."""
    n = len(bounds) - 1
    a, b = (np.searchsorted(bounds[1:-1], x, "right") for x in (first, last))
    across = np.flatnonzero(a != b)
    to = b.copy() if rule == "last" else a.copy()
    if rule == "largest":
        for t in across:
            inside = np.arange(a[t], b[t] + 1)
            held = np.minimum(bounds[inside + 1], last[t] + 1) - np.maximum(bounds[inside], first[t])
            to[t] = inside[held.argmax()]
    return np.bincount(to, minlength=n), np.bincount(to[across], minlength=n)


def count_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "first") -> DataFrame:
    """(doc_id, section, start, n_chars, n_tokens, n_crossing, doc_tokens): a row for each section of each document."""
    if rule not in RULES:
        raise ValueError(f"{rule} is none of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = spans(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                rows, parts = [], []
                for i, x in enumerate(b.column(1)):
                    text = x.as_py() or ""
                    bounds = sections(text)
                    first, last = encoder.of(text)
                    tokens, crossing = attribute(first, last, bounds, rule)
                    n = len(tokens)
                    rows.append(np.full(n, i))
                    parts.append(np.stack([np.arange(n), bounds[:-1], np.diff(bounds), tokens, crossing, np.full(n, len(first))]))
                table = np.concatenate(parts, 1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(rows))), *[pa.array(c) for c in table]], names=["doc_id", "section", "start", "n_chars", "n_tokens", "n_crossing", "doc_tokens"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, section bigint, start bigint, n_chars bigint, n_tokens bigint, n_crossing bigint, doc_tokens bigint")
