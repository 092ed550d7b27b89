"""Phrase collocations: sketches propose phrases, automata count them, exact counts decide.

Two passes over the texts. The first counts, for each number of words, hashes of all phrases in count-min sketches; summed over
all shards, a sketch's smaller cell is never below a phrase's true count, so a phrase whose cells do not reach the least count cannot reach it.
The second takes each shard's phrases that the sketches let through, compiles them into an automaton of keys guarded by
delimiters on both sides, and scans the shard's own text with it, overlaps included. Counts of shards are summed and then compared
with the least count, so what the sketches let through wrongly falls away. A shard is what one task has read, up to SHARD bytes
of one language: automaton and text have a bound whatever the corpus holds.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidline.llm.common import broadcast_if_small, save

#: Bytes of text that a shard holds, and the words of the longest phrase.
SHARD, LONGEST = 6 << 20, 5
#: Cells of a sketch: at least this many (as powers of two), and at most; between them one for every so many characters of text, which is some 70
#: phrases of a length a cell. Beyond 17 thousand million characters cells fill and let more through: counts stay exact, but more are shuffled.
LEAST_CELLS, MOST_CELLS, CHARS_A_CELL = 16, 25, 512
#: Characters of text that a task reads, so that what repeats is summed before it is shuffled, and for each byte of its sketches in the first pass.
TASK, READ = 256 << 20, 8
#: Phrases that a task of the second pass gathers before it gives their counts out.
GATHER = 300_000
#: Rows of a sketch, and cells of a piece in which it travels.
ROWS, PIECE = 2, 1 << 15
#: Phrases that may be broadcast when the parts of cuts are looked up.
FEW = 200_000

_SPLIT = b".,;:!?\n\x0b\x0c\r"
#: A-Z to lower case, tabs to spaces, and whatever splits pieces to a full stop, which no word holds.
_TABLE = bytes(32 if b == 9 else 46 if b in _SPLIT else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Shards: a language, and the words of its texts with a full stop between pieces. No text is cut, so a shard may pass SHARD by one text."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(_TABLE)
            held[lang].append(raw)
            size[lang] += len(raw) + 3
            if size[lang] >= SHARD or sum(size.values()) >= 2 * SHARD:
                most = max(size, key=size.get)
                del size[most]
                yield most, b" . ".join(held.pop(most)).replace(b".", b" . ").split()
    for lang, texts in held.items():
        yield lang, b" . ".join(texts).replace(b".", b" . ").split()


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))


class _Vocabulary:
    """Numbers of a language's words and their 64-bit hashes, kept for a task up to a bound. The full stop has number and hash 0."""

    def __init__(self, lang: str):
        self.seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
        self.number, self.hashes = {b".": 0}, np.zeros(1, np.uint64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > 500_000:
            self.number, self.hashes = {b".": 0}, np.zeros(1, np.uint64)
        new = list(set(words).difference(self.number))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.hashes = np.concatenate([self.hashes, np.array([xxhash.xxh64_intdigest(w, self.seed) | 1 for w in new], np.uint64)])
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))


class _Vocabularies(dict):
    """Those of the languages that a task has met last."""

    def __missing__(self, lang: str) -> _Vocabulary:
        if len(self) >= 8:
            self.pop(next(iter(self)))
        self[lang] = _Vocabulary(lang)
        return self[lang]


def _longer(value: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases that go on with words of the hashes `last`."""
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + last
    return value ^ (value >> np.uint64(32))


def _cells(value: np.ndarray, bits: int) -> list[np.ndarray]:
    """Cells of the rows of a sketch."""
    return [((value * np.uint64(m)) >> np.uint64(64 - bits)).astype(np.int64) for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[:ROWS]]


def _add(sketch: np.ndarray, cells: np.ndarray, top: int) -> None:
    """Count cells, up to top."""
    if 4 * len(cells) < len(sketch):
        cells, n = np.unique(cells, return_counts=True)
        sketch[cells] = np.minimum(n + sketch[cells], top)
    else:
        n = np.bincount(cells, minlength=len(sketch))
        n += sketch
        sketch[:] = np.minimum(n, top, out=n)


_SKETCH = "row int, piece int, cells binary, words long, lang string"


def _dealt(docs: DataFrame, chars: int, least: int = 0) -> DataFrame:
    """docs in tasks of TASK characters and of `least`, if that is more; no fewer tasks than there are cores."""
    return docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, chars // max(TASK, least)))


def _sketches(docs: DataFrame, least: int, bits: int, chars: int) -> tuple[DataFrame, type, int]:
    """Pieces of each task's sketches, saturating at `least`, and its words by language.

    Tasks are made so large that what they give out stays a small part of what they read, however wide sketches are.
    """
    top = max(1, least)
    kind = np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else np.uint64
    size = (1 << bits) * LONGEST * ROWS * np.dtype(kind).itemsize
    docs = _dealt(docs, chars, READ * size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = {(k, j): np.zeros(1 << bits, kind) for k in range(1, LONGEST + 1) for j in range(ROWS)}
        words, vocabularies = Counter(), _Vocabularies()
        for lang, found in _texts(batches):
            known = vocabularies[lang]
            number = known.numbers(found)
            h = np.append(known.hashes[number], np.zeros(LONGEST, np.uint64))
            at = np.flatnonzero(h)
            value, words[lang] = h[at], words[lang] + len(at)
            for k in range(1, LONGEST + 1):
                if k > 1:
                    on = h[at + k - 1] > 0
                    at = at[on]
                    value = _longer(value[on], h[at + k - 1])
                for j, cells in enumerate(_cells(value, bits)):
                    _add(sketch[k, j], cells, top)
        out = []
        for (k, j), own in sketch.items():
            for i in range(0, len(own), PIECE):
                piece = own[i : i + PIECE]
                if piece.any():
                    out.append((k * ROWS + j, i // PIECE, piece.tobytes(), None, None))
            yield from _rows(out, _SKETCH_ARROW)
            out = []
        yield from _rows([(None, None, None, n, lang) for lang, n in words.items()], _SKETCH_ARROW)

    return docs.mapInArrow(count, _SKETCH), kind, top


_SKETCH_ARROW = pa.schema([("row", pa.int32()), ("piece", pa.int32()), ("cells", pa.binary()), ("words", pa.int64()), ("lang", pa.string())])
_COUNT_ARROW = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


def _rows(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _passing(sketches: DataFrame, kind: type, top: int) -> DataFrame:
    """(row, piece, bits): which cells of the summed sketches reach the least count. A piece is summed as its parts come in."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, piece, cells in zip(*(batch.column(c).to_pylist() for c in ("row", "piece", "cells")), strict=True):
                part = np.frombuffer(cells, kind)
                if (row, piece) in total:
                    total[row, piece][:] = np.minimum(total[row, piece].astype(np.uint64) + part, top)
                else:
                    total[row, piece] = part.copy()
        rows = [(row, piece, np.packbits(cells >= top).tobytes()) for (row, piece), cells in total.items() if (cells >= top).any()]
        yield from _rows(rows, pa.schema([("row", pa.int32()), ("piece", pa.int32()), ("bits", pa.binary())]))

    pieces = sketches.where("row IS NOT NULL").select("row", "piece", "cells")
    return pieces.repartition("row", "piece").mapInArrow(add, "row int, piece int, bits binary")


def _given(found: Counter) -> Iterator[pa.RecordBatch]:
    rows = [(lang, k, phrase.decode("utf-8", "surrogatepass"), n) for (lang, k, phrase), n in found.items()]
    for i in range(0, len(rows), 50_000):
        yield from _rows(rows[i : i + 50_000], _COUNT_ARROW)


def _counts(docs: DataFrame, passing: dict[int, bytes], bits: int) -> DataFrame:
    """(lang, k, phrase, n): what each shard holds of the phrases that the sketches let through."""
    shared = docs.sparkSession.sparkContext.broadcast(passing)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {row: np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool) for row, b in shared.value.items()}
        none, vocabularies, found = np.zeros(1 << bits, bool), _Vocabularies(), Counter()
        for lang, words in _texts(batches):
            automaton, order = ahocorasick.Automaton(ahocorasick.STORE_ANY), []
            known = vocabularies[lang]
            number = np.append(known.numbers(words), np.zeros(LONGEST, np.int64))
            h = known.hashes[number]
            at = np.flatnonzero(h)
            value, own = h[at], number[at]
            for k in range(1, LONGEST + 1):
                if k > 1:  # a phrase is no more frequent than its beginning, so only beginnings that passed go on
                    on = h[at + k - 1] > 0
                    at, own = at[on], own[on]
                    value = _longer(value[on], h[at + k - 1])
                may = np.ones(len(value), bool)
                for j, cells in enumerate(_cells(value, bits)):
                    may &= sets.get(k * ROWS + j, none)[cells]
                at, value, own = at[may], value[may], own[may]
                # Phrases are told apart by the number of their beginning and of their last word, not by hash.
                pairs = own if k == 1 else own * len(known.hashes) + number[at + k - 1]
                _, first, own = np.unique(pairs, return_index=True, return_inverse=True)
                for i in at[first].tolist():
                    key = b" ".join(words[i : i + k])
                    automaton.add_word(f" {key.decode('latin-1')} ", len(order))
                    order.append((k, key))
            if not order:
                continue
            automaton.make_automaton()
            text = f" {b' '.join(words).decode('latin-1')} "
            seen = Counter(map(itemgetter(1), automaton.iter(text)))
            for i, n in seen.items():
                found[lang, *order[i]] += n
            if len(found) >= GATHER:
                yield from _given(found)
                found = Counter()
        yield from _given(found)

    return docs.mapInArrow(scan, "lang string, k int, phrase string, n long")


def phrase_counts(docs: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) of every phrase of 1 to 5 words with f >= least, and (lang, n), all words of each language."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    bits = min(MOST_CELLS, max(LEAST_CELLS, (chars // CHARS_A_CELL).bit_length()))
    parts, kind, top = _sketches(docs, least, bits, chars)
    parts = save(parts, "phrase-sketches")
    passing: dict[int, bytearray] = defaultdict(lambda: bytearray((1 << bits) // 8))
    # Bits only, of a table whose size is fixed by MOST_CELLS.
    for r in _passing(parts, kind, top).toLocalIterator():
        passing[r.row][r.piece * PIECE // 8 : r.piece * PIECE // 8 + len(r.bits)] = r.bits
    found = _counts(_dealt(docs, chars), {row: bytes(b) for row, b in passing.items()}, bits)
    counts = save(found.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "phrase-counts")
    return counts, save(parts.where("row IS NULL").groupBy("lang").agg(F.sum("words").alias("n")), "phrase-words")


def mine(docs: DataFrame, least: int = 100, first: int = 2000) -> DataFrame:
    """The collocations of each language: lang, rank, phrase, a, l, r, n, score, as the contract has them.

    docs needs lang and text; other columns, whatever their names, play no part. A null lang counts as `und`, together with
    documents that say so; null and empty texts have no words. Repeated rows count each time. Of cuts of the same score the one after fewer
    words counts; equal scores rank by a, then by the phrase's bytes. Without a phrase that is frequent enough there are no rows.
    """
    counts, words = phrase_counts(docs, least)
    long = counts.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = long.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "j", joined(F.lit(1), F.col("j")).alias("left"), joined(F.col("j") + 1, F.col("k") - F.col("j")).alias("right"))
    parts = counts.select("lang", "phrase", "f")
    left = broadcast_if_small(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), FEW)
    right = broadcast_if_small(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), FEW)
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(F.broadcast(words), "lang")
    score = F.expr("(cast(a as decimal(14,0)) * cast(n as decimal(16,0)) * cast(1000 as decimal(4,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "j", "a", "l", "r", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    # Counts fall with length, so a phrase inside a longer one of the same count is also inside one that is a word longer.
    inner = long.where("k > 2").select("lang", "a", F.explode(F.array(joined(F.lit(1), F.col("k") - 1), joined(F.lit(2), F.col("k") - 1))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    stay = save(lowest.join(inner, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a"), "phrase-scores")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # A language's phrases are first cut to the best of each of 64 groups, so that no task holds all of them.
    group = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = stay.withColumn("place", F.row_number().over(Window.partitionBy("lang", group).orderBy(*order))).where(F.col("place") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
