"""Language identification by bit-sliced Bloom filters of character n-grams.

One table of positions serves all languages: position p holds a mask whose bit l says
whether p is set in language l's Bloom filter. The bitwise and of an n-gram's hashed positions is the set of
all languages that contain it. The table has ROOM positions, at least, for each n-gram of the largest language,
up to LARGEST; beyond that fewer hashes keep it from filling up. Per-language popcounts over a text's n-grams, each corrected for what the
filter lets through by chance, decide. An n-gram belongs to a language if its rate there, over
all rows learned from, is at least SHARE of its highest rate in any language and it occurs twice or more.

Defined results: null texts and texts without a letter are `und` with score 0; so is everything if no row
can be learned from; ties go to the first language by name; rows with a null language are predicted only;
a null doc_id is learned from; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidline.llm.common import save

GRAM = 3
#: Positions for each n-gram of the largest language; the smallest and the largest table (8 bytes a position for 64 languages).
ROOM, SMALLEST, LARGEST = 16, 1 << 16, 1 << 23
#: Hashes of an n-gram at most.
HASHES = 4
SHARE = 0.34
#: Characters of text that are hashed at a time.
CHUNK = 1 << 22
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """By code point: its lower case if it is a letter, else a space, as are combining marks."""
    out = np.full(0x110000, 32, np.int64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of all GRAM-grams over letters and the spaces around words; a gram packs its code points in 63 bits."""
    joined = "\0".join(["", *texts, ""])  # a text's ends count as spaces
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.zeros(len(code), np.int32)
    pos, starts = 0, []
    for t in texts:
        starts.append(pos)
        pos += len(t) + 1
    if starts:
        marks = np.zeros(len(code) + 1, np.int32)
        np.add.at(marks, np.array(starts[1:], np.int64), 1)
        owner = np.cumsum(marks)[: len(code)]
    low = letters()[code]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)  # one space between words
    low, owner = low[keep], owner[keep]
    if len(low) < GRAM:
        return np.array([], np.int32), np.array([], np.int64)
    key = np.zeros(len(low) - GRAM + 1, np.int64)
    for i in range(GRAM):
        key = (key << 21) | low[i : len(low) - GRAM + 1 + i]
    middle = low[1 : len(low) - GRAM + 2] != 32
    return owner[1 : len(low) - GRAM + 2][middle], key[middle]


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Texts in runs of about CHUNK characters: (index of the first, texts)."""
    start, some, size = 0, [], 0
    for i, t in enumerate(texts):
        some.append((t or "").replace("\0", " "))
        size += len(some[-1])
        if size >= CHUNK:
            yield start, some
            start, some, size = i + 1, [], 0
    if some:
        yield start, some


def shape_of(members: int) -> tuple[int, int]:
    """(positions, hashes) of a table for languages of at most so many n-grams."""
    size = SMALLEST
    while size < min(LARGEST, ROOM * members):
        size *= 2
    return size, max(1, min(HASHES, round(size / max(1, members) * 0.69)))


def slots(key: np.ndarray, size: int, hashes: int) -> Iterator[np.ndarray]:
    """The positions of grams in a table of that size, one array for each hash."""
    x = key.astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(hashes):
            h = (x + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            yield (h >> np.uint64(32)).astype(np.int64) % size


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, c) over docs (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for start, some in chunks(b.column(1).to_pylist()):
                owner, key = grams(some)
                names, inverse = np.unique(langs[start : start + len(some)].astype(str), return_inverse=True)
                for i, name in enumerate(names):
                    k, c = np.unique(key[inverse[owner] == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k), pa.array(c.astype(np.int64))], names=["lang", "gram", "c"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram bigint, c bigint").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


class Filters:
    """langs: names in order; table (positions, words of 64 languages): the masks; fill: the share of positions set by language."""

    def __init__(self, langs: list[str], table: np.ndarray, hashes: int = HASHES) -> None:
        self.langs, self.table, self.hashes = langs, table, hashes
        self.fill = np.array([((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])

    def masks(self, key: np.ndarray) -> np.ndarray:
        """All languages that contain each gram, as words of 64 bits."""
        out = None
        for at in slots(key, len(self.table), self.hashes):
            out = self.table[at] if out is None else out & self.table[at]
        return out

    def decide(self, texts: list[str]) -> list[tuple[str, float]]:
        owner, key = grams(texts)
        n = np.bincount(owner, minlength=len(texts)).astype(float)
        # A text repeats its grams: look each distinct one up once.
        distinct, inverse = np.unique(key, return_inverse=True)
        mask = self.masks(distinct)
        hits = np.stack([np.bincount(owner, ((mask[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(float)[inverse], len(texts)) for i in range(len(self.langs))], 1)
        chance = np.minimum(self.fill**self.hashes, 1 - 1e-9)  # a filter that is full says nothing
        true = np.clip((hits - n[:, None] * chance) / (1 - chance), 0, None)
        best = true.argmax(1)
        total = true.sum(1)
        return [(self.langs[b], float(min(1.0, t[b] / s))) if m and s > 0 else (self.langs[0], 0.0) if m else (UNKNOWN, 0.0) for b, t, s, m in zip(best, true, total, n, strict=True)]


def fit_filters(docs: DataFrame) -> Filters | None:
    """Filters of the rows of docs (lang, text) whose lang isn't null."""
    counts = save(gram_counts(docs.where("lang is not null")), "gram-counts")
    sizes = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("c").alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    of = docs.sparkSession.createDataFrame([(x, i, float(sizes[x])) for i, x in enumerate(langs)], "lang string, at int, n double")
    rated = counts.where("c > 1").join(F.broadcast(of), "lang").withColumn("rate", F.col("c") / F.col("n"))
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    member = save(rated.join(top, "gram").where(F.col("rate") >= SHARE * F.col("top")).select("at", "gram"), "gram-members")
    size, hashes = shape_of(max([r.n for r in member.groupBy("at").agg(F.count("*").alias("n")).collect()], default=0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, key = b.column(0).to_numpy(), b.column(1).to_numpy()
            for s in slots(key, size, hashes):
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array((at // 64).astype(np.int32)), pa.array((np.uint64(1) << (at % 64).astype(np.uint64)).view(np.int64))], names=["slot", "word", "mask"])

    made = member.select("at", "gram").mapInArrow(place, "slot bigint, word int, mask bigint").groupBy("slot", "word").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    table = np.zeros((size, (len(langs) + 63) // 64), np.uint64)  # at most LARGEST rows by language word came back
    table[made["slot"].to_numpy(), made["word"].to_numpy()] = made["mask"].to_numpy().view(np.uint64)
    return Filters(langs, table, hashes)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score); rows whose id's crc32, as text, is 2 modulo 4 are held out."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    named = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    filters = fit_filters(named.where("not held_out").select("lang", "text"))
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = sent.value
        for b in batches:
            out: list[tuple[str, float]] = []
            for _, some in chunks(b.column(2).to_pylist()):
                out += filters.decide(some) if filters else [(UNKNOWN, 0.0)] * len(some)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = named.schema["doc_id"].dataType.simpleString()
    return named.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
