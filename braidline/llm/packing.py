"""Lexical retrieval packing: windows filled with BM25 neighbours of their seed document.

Texts are encoded once. Documents are dealt to shards of about SHARD_IDS ids by what they are about: their two terms of the
most weight give a cell, cells in order fill the shards, and a cell that is larger than a shard is dealt to several
by row, so that no shard grows with a term, a text or a row that is repeated. Each shard holds an inverted index
over its documents' token ids with BM25 weights from the corpus's document frequencies and mean length. Window by
window, a seed document asks the index with all its terms for unused neighbours, best first, until they
have filled the window greedily; the one that does not fit is cut, and its rest is the next seed. Where no neighbour
shares a term, the next unused document follows. Only a shard's last window can need padding.

Defined results: a null or empty text is its end id alone; every document has at least that; rows with equal ids are
packed each; extra columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidline.llm.common import save

WINDOW, END = 2048, 1
#: Ids in a shard, about: the unit of one index in memory (40 bytes an id).
SHARD_IDS = 3_000_000
#: Cells that a document's heaviest term is divided into, by its second one; with 16-bit ids, cells are 2 ** 20 at most.
SECOND = 16
#: Share of a shard's documents from which on a term's weights are kept as a dense row.
DENSE = 1 / 16
K1, B = 1.2, 0.75
#: Words of one of the two generations of an encoder's memory, about 250 bytes each.
KNOWN = 250_000
#: Bytes of texts whose words are told apart together.
TOGETHER = 1 << 23


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else the next one beyond Latin-1."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts, as bytes of little-endian 16-bit numbers, for a vocabulary that never joins words across white space.

    Each word between ASCII white space is encoded once and remembered. The result is the tokenizer's own for the text, as
    it splits there before merging; it also splits between letters and marks, so that a word is its letters and
    the ASCII marks behind them. Latin letters go to the merges directly, everything else through the whole tokenizer.
    """

    #: A word and the marks behind it.
    PARTS = r"(?s)^(?P<core>.*[0-9A-Za-z])(?P<rest>[.,!?;:#$%&*|-]+)$"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        self.merges = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.letters = byte_letters()
        self.bytes_of = [i.to_bytes(2, "little") for i in range(1 << 16)]

    def made(self, word: str) -> bytes:
        """Ids of a word that holds no mark behind its letters."""
        low = word.lower()
        if not low.isalpha() or not low.isascii() and max(low) >= "\u0250":
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint16).tobytes()
        if not low.isascii():
            low = low.encode().decode("latin-1").translate(self.letters)
        two = self.bytes_of
        return b"".join([two[t.id] for t in self.merges(low)])

    def learn(self, word: str) -> bytes:
        """Encode a word and remember it. What is not asked for while a generation fills up is forgotten."""
        out = self.older.get(word)
        if out is None:
            out = self.made(word)
        if len(self.known) >= KNOWN:
            self.older = dict(self.known)
            self.known.clear()
        self.known[word] = out
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text. Words of some texts at a time are told apart first, so that each is looked up once and the ids are gathered."""
        out: list[np.ndarray] = []
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + TOGETHER, "right")))
            out += self._together(texts.slice(start, end - start))
            start = end
        return out

    def _together(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, "<|")  # names of special tokens have a case
        lists = pc.ascii_split_whitespace(pc.if_else(special, texts, pc.ascii_lower(texts)))
        words = lists.flatten().dictionary_encode()
        parts = pc.extract_regex(words.dictionary, self.PARTS)
        core = pc.coalesce(pc.struct_field(parts, "core"), words.dictionary).dictionary_encode()
        rest = pc.fill_null(pc.struct_field(parts, "rest"), "").dictionary_encode()
        get, learn = self.known.get, self.learn
        ids = [get(w) or learn(w) if w else b"" for d in (core, rest) for w in d.dictionary.to_pylist()]
        flat = np.frombuffer(b"".join(ids), np.uint16)
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        # Each word is its core and what is behind it; of every part, where its ids end in flat.
        part = np.stack([core.indices.to_numpy(), rest.indices.to_numpy() + len(core.dictionary)], 1)[words.indices.to_numpy()].ravel()
        n = length[part]
        ends = np.cumsum(n)
        gathered = flat[np.repeat(np.cumsum(length)[part] - ends, n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[2 * (lists.offsets.to_numpy() - lists.offsets[0].as_py())]
        return np.split(gathered, bounds[1:-1])


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process: what its tasks have learned is kept, up to KNOWN words."""
    return Encoder(path)


def cells_of(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each document, and how many documents hold each id. Up to 2 ** 16 documents, none of them empty, are sorted as one.

    A cell is the document's two ids of the most weight, root of the count times logarithm of the id; of equal weights the smaller id
    comes first. Byte-pair vocabularies number their ids by falling frequency, so that an id tells how rare it is before any document
    has been counted. The end id says nothing.
    """
    if not ids:
        return np.zeros(0, np.int64), np.zeros(1 << 16, np.int64)
    key = np.sort(np.repeat(np.arange(len(ids), dtype=np.uint32) << 16, [len(x) for x in ids]) | np.concatenate(ids))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    used, counts = key[at] & 0xFFFF, np.diff(at, append=len(key))
    start = np.searchsorted(key[at], np.arange(len(ids), dtype=np.uint32) << 16)
    size = np.diff(start, append=len(at))
    weight = np.sqrt(counts) * np.log(used + 2.0)
    weight[used == END] = 0

    def heaviest() -> np.ndarray:
        best = np.flatnonzero(weight == np.repeat(np.maximum.reduceat(weight, start), size))
        return best[np.searchsorted(best, start)]

    first = heaviest()
    cells = used[first].astype(np.int64) * SECOND
    weight[first] = -1
    second = [zlib.crc32(x.to_bytes(2, "little")) % SECOND for x in used[heaviest()].tolist()]
    return cells + np.where(size < 3, 0, second), np.bincount(used, minlength=1 << 16)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, cell, n, ids, df): n ids with the end id, as bytes of 16-bit numbers, and one further row a task, without
    ids, whose df holds the task's documents with each id, as bytes of 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        end = np.array([END], np.uint16)
        df = np.zeros(1 << 16, np.int64)
        names = ["row", "doc_id", "cell", "n", "ids", "df"]
        kind = None
        for b in batches:
            kind = b.schema.field(1).type
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                ids = [np.concatenate([x, end]) for x in encode(part.column(2))]
                cells, held = cells_of(ids)
                df += held
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cells, pa.int32()), pa.array([len(x) for x in ids], pa.int32()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.nulls(len(ids), pa.binary())], names=names)
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, kind), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([df.tobytes()], pa.binary())], names=names)

    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"row bigint, doc_id {slim.schema['doc_id'].dataType.simpleString()}, cell int, n int, ids binary, df binary")


def document_frequencies(encoded: DataFrame) -> np.ndarray:
    """Documents with each id, over all rows: a vector as long as the vocabulary, from the tasks' vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_py(), np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["id", "n"])

    table = encoded.select("df").where("df is not null").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << 16, np.int64)
    out[table["id"].to_numpy()] = table["n"].to_numpy()
    return out


def deal(encoded: DataFrame, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The documents of encoded with their shard: cells lie one behind the other, and a document lies in its cell by the hash of its row."""
    held = encoded.where("n is not null")
    cells = held.groupBy("cell").agg(F.sum("n").alias("size")).toArrow().sort_by("cell")  # 2 ** 20 rows at most
    size = cells["size"].to_numpy()
    places = pa.table({"cell": cells["cell"], "before": np.cumsum(size) - size, "size": size})
    spread = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    placed = held.join(F.broadcast(held.sparkSession.createDataFrame(places)), "cell")
    return placed.select("row", "doc_id", "ids", F.floor((F.col("before") + spread * F.col("size")) / shard_ids).cast("bigint").alias("shard"))


class Index:
    """BM25 over one shard."""

    def __init__(self, docs: list[np.ndarray], df: np.ndarray, count: int, mean: float) -> None:
        length = np.array([len(x) for x in docs])
        term = np.concatenate(docs).astype(np.int64)
        pair, tf = np.unique(term << 32 | np.repeat(np.arange(len(docs)), length), return_counts=True)
        self.term, self.doc = (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32)
        idf = np.log(1 + (count - df + 0.5) / (df + 0.5))
        self.weight = (idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.doc] / mean))).astype(np.float32)
        self.start = np.searchsorted(self.term, np.arange((1 << 16) + 1))
        by_doc = np.argsort(self.doc, kind="stable")
        bound = np.searchsorted(self.doc[by_doc], np.arange(len(docs) + 1))
        self.terms_of = lambda i: self.term[by_doc[bound[i] : bound[i + 1]]]
        self.size = len(docs)
        common = np.flatnonzero(np.diff(self.start) > max(DENSE * self.size, 1))
        self.place = np.full(1 << 16, -1)
        self.place[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.size), np.float32)
        for i, t in enumerate(common):
            a, b = self.start[t], self.start[t + 1]
            self.dense[i, self.doc[a:b]] = self.weight[a:b]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for all terms of the seed."""
        terms = self.terms_of(seed)
        place = self.place[terms]
        rare = terms[place < 0]
        start, length = self.start[rare], self.start[rare + 1] - self.start[rare]
        at = np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())
        common = np.add.reduce(self.dense[place[place >= 0]], 0)  # no product of matrices: that would start threads of its own
        return common + np.bincount(self.doc[at], self.weight[at], self.size).astype(np.float32)

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents by descending score, ties by place, to the last one with a common term."""
        score = self.scores(seed) * unused
        most, done = 64, 0
        while done < self.size:
            if most < self.size:  # a window seldom needs more than a few
                least = np.partition(score, self.size - most)[self.size - most]
                top = np.flatnonzero(score >= max(least, 1e-30))
            else:
                top = np.flatnonzero(score > 0)
            yield from top[np.argsort(-score[top], kind="stable")][done:].tolist()
            if most >= self.size or len(top) < most:
                return
            done, most = len(top), 8 * most


def pack_shard(docs: list[np.ndarray], df: np.ndarray, count: int, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover every id of docs once."""
    index = Index(docs, df, count, mean)
    unused = np.ones(len(docs), np.float32)
    pieces, sequence, filled, after = [], 0, 0, 0

    def put(i: int) -> None:
        """Lay document i from the present place on, over as many windows as it needs."""
        nonlocal sequence, filled
        unused[i] = 0
        start = 0
        while start < len(docs[i]):
            n = min(len(docs[i]) - start, window - filled)
            pieces.append((i, start, n, sequence, filled))
            start, filled = start + n, filled + n
            if filled == window:
                sequence, filled = sequence + 1, 0

    while True:
        while after < len(docs) and not unused[after]:
            after += 1
        if after == len(docs):
            return pieces
        seed = after
        put(seed)
        while filled:  # the seed of a window is the document that began it
            for i in index.neighbours(seed, unused):
                before = sequence
                put(i)
                if sequence != before:
                    seed = i
                    break
            else:
                break


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): one row for each piece; ids is an array."""
    encoded = save(encode_documents(docs, path, id_col, text_col), "packing-ids")
    total = encoded.agg(F.count("n").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("ids")).first()
    sent = docs.sparkSession.sparkContext.broadcast((document_frequencies(encoded), total.n, total.ids / max(1, total.n)))
    kind = encoded.schema["doc_id"].dataType

    def run(key: tuple, table: pa.Table) -> pa.Table:
        df, count, mean = sent.value
        table = table.take(pa.array(np.lexsort((table["row"].to_numpy(), [zlib.crc32(x) for x in table["ids"].to_pylist()]))))
        ids = [np.frombuffer(x, np.uint16) for x in table["ids"].to_pylist()]
        pieces = pack_shard(ids, df, count, mean, window)
        doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        laid = np.concatenate([ids[d][s : s + n] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]).astype("<u4")
        ends = np.concatenate([[0], np.cumsum(length)])
        raw = memoryview(laid).cast("B")
        return pa.table(
            {
                "doc_id": table["doc_id"].combine_chunks().take(pa.array(doc)),
                "start": start,
                "length": length,
                "ids_crc32": pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64()),
                "doc_tokens": np.array([len(x) for x in ids], np.int64)[doc],
                "sequence_id": (key[0].as_py() << 32) + sequence,
                "offset": offset,
                "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(laid.view(np.int32))),
            }
        )

    # A shard is one task's work at a time: as many partitions as shards, where those are more.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total.ids // SHARD_IDS + 1)
    dealt = deal(encoded).repartition(parts, "shard")
    schema = f"doc_id {kind.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids array<int>"
    return dealt.groupBy("shard").applyInArrow(run, schema)
