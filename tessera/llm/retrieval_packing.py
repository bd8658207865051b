"""Lexical retrieval packing: windows of related documents without padding.

A pass tokenizes every text and stores its ids with a signature of minimum hashes; a second counts, for each token, the documents that
hold it. Rows are then range-sorted by signature, so that texts with much in common lie side by side, and each task walks its range in
shards of a bounded number of documents. A shard gets a BM25 inverted index of its documents (token frequencies of the shard, document
frequencies of the corpus). The document that opens a window is its seed: its weightiest tokens are the query, the shard's unused
documents answer by falling score, and are put into the window until it is full. What the last one has too much opens the next window,
and so is its seed. A document's whole windows are sequences of their own; only what is left beyond them is placed by retrieval.

An open window goes on from shard to shard, so only a task's last window ends early. It is cut where a power of two ends, for sequences
of such lengths are not padded: no sequence is.

Edge cases: a null or empty text is the end id alone; rows that repeat, in id or as a whole, are packed each on its own (their pieces
repeat the same keys), and ranges are cut by the place of a row in the stored table, so that even equal rows are dealt to several tasks;
null ids are kept; documents that share no query token with the seed follow it in the order of signatures; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, materialize, summed_arrays, texts
from tessera.llm.packing import _word_tokenizer, default_tokenizer

WINDOW = 4096
END = 2
#: Documents in a shard of the index, and tokens after which it is closed all the same.
SHARD, SHARD_TOKENS = 1024, 4_000_000
#: Tokens of the seed that are asked for: those of the largest weight.
QUERY = 32
K1, B = 1.2, 0.75
#: Tokens that one task packs, on average at most, where that takes more tasks than the session's shuffles have.
PART_TOKENS = 64_000_000
#: Minimum hashes in a signature.
HASHES = 4

_MULTIPLIERS = np.random.default_rng(13).integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(ids: list[bytes]) -> pa.Array:
    """For each of some lists of ids the minimum of each of several hashes, as bytes that sort like the numbers. No list is empty."""
    own = np.frombuffer(b"".join(ids), "<u4")
    starts = np.cumsum([0, *(len(i) // 4 for i in ids[:-1])])
    low = np.empty((len(ids), HASHES), ">u4")
    for k, m in enumerate(_MULTIPLIERS):
        h = own * m
        h ^= h >> np.uint32(15)
        # Long texts have low minima: mixed once more, these do not lie side by side in the order.
        low[:, k] = np.minimum.reduceat(h, starts) * np.uint32(0x9E3779B1)
    return pa.Array.from_buffers(pa.binary(4 * HASHES), len(ids), [None, pa.py_buffer(low.tobytes())]).cast(pa.binary())


def tokenize(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids (unsigned 32-bit, little-endian, the end id last), tokens and signature of each row."""
    bounded_batches(docs.sparkSession)
    path, end = tokenizer or default_tokenizer(), END.to_bytes(4, "little")
    kind = dict(docs.dtypes)["doc_id"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_tokenizer(path)
        for b in batches:
            ids = [words.encode(text) + end for text in texts(b.column("text"))]
            if not ids:
                continue
            columns = [b.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), signatures(ids)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "tokens", "signature"])

    return docs.select("doc_id", "text").mapInArrow(encoded, f"doc_id {kind}, ids binary, tokens long, signature binary")


def document_frequencies(tokens: DataFrame, size: int) -> np.ndarray:
    """For each token below size, how many rows hold it; so many numbers reach the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for ids in b.column("ids").to_pylist():
                total[np.unique(np.frombuffer(ids, "<u4"))] += 1
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total], pa.list_(pa.int64()))], ["k", "n"])

    rows = summed_arrays(tokens.select("ids").mapInArrow(counted, "k int, n array<bigint>"), "k", "n").collect()
    return np.array(rows[0].n, np.int64) if rows else np.zeros(size, np.int64)


@dataclass
class Unit:
    """What is left of a document beyond its whole windows."""

    doc_id: object
    start: int
    ids: bytes
    doc_tokens: int
    terms: np.ndarray
    weights: np.ndarray


@dataclass
class Statistics:
    """BM25's numbers of the whole corpus."""

    idf: np.ndarray
    mean: float

    @classmethod
    def of(cls, frequencies: np.ndarray, documents: int, total: int) -> Statistics:
        return cls(np.log1p((documents - frequencies + 0.5) / (frequencies + 0.5)), max(total, 1) / max(documents, 1))

    def weighed(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct tokens of a document and their BM25 weights."""
        terms, tf = np.unique(ids, return_counts=True)
        return terms, self.idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / self.mean))


class ShardIndex:
    """An inverted index of one shard: for each token its documents and weights."""

    def __init__(self, units: list[Unit]):
        terms = np.concatenate([u.terms for u in units])
        order = np.argsort(terms, kind="stable")
        self.units = np.repeat(np.arange(len(units)), [len(u.terms) for u in units])[order]
        self.weights = np.concatenate([u.weights for u in units])[order]
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.starts = np.append(self.starts, len(terms))
        self.size = len(units)

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 of each document for distinct tokens."""
        total = np.zeros(self.size)
        at = np.searchsorted(self.terms, query)
        for k, term in zip(at.tolist(), query.tolist()):
            if k < len(self.terms) and self.terms[k] == term:
                own = slice(self.starts[k], self.starts[k + 1])
                total[self.units[own]] += self.weights[own]
        return total


class Packer:
    """The windows of one task; ``rows`` gathers the pieces of closed ones."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.open: list[tuple[Unit, int, int]] = []  # unit, place in its ids, tokens
        self.filled = 0
        self.query: np.ndarray | None = None
        self.rows: list[tuple] = []

    def _emit(self, unit: Unit, at: int, n: int, offset: int) -> None:
        crc = zlib.crc32(unit.ids[4 * at : 4 * (at + n)])
        self.rows.append((unit.doc_id, unit.start + at, n, crc, unit.doc_tokens, self.sequence, offset))

    def whole(self, doc_id, ids: bytes, n: int) -> None:
        """A sequence for each whole window of a document."""
        for start in range(0, n - self.window + 1, self.window):
            self.rows.append((doc_id, start, self.window, zlib.crc32(ids[4 * start : 4 * (start + self.window)]), n, self.sequence, 0))
            self.sequence += 1

    def _close(self) -> None:
        offset = 0
        for unit, at, n in self.open:
            self._emit(unit, at, n, offset)
            offset += n
        self.sequence += 1
        self.open, self.filled, self.query = [], 0, None

    def place(self, unit: Unit) -> None:
        """The unit at the end of the open window; what does not fit opens the next one."""
        at, left = 0, len(unit.ids) // 4
        while left:
            if self.query is None:
                top = np.argsort(-unit.weights, kind="stable")[:QUERY]
                self.query = unit.terms[top]
            n = min(left, self.window - self.filled)
            self.open.append((unit, at, n))
            self.filled, at, left = self.filled + n, at + n, left - n
            if self.filled == self.window:
                self._close()

    def shard(self, units: list[Unit]) -> None:
        """All units, each window's by retrieval."""
        index, unused = ShardIndex(units), np.ones(len(units), bool)
        first = 0
        while True:
            while first < len(units) and not unused[first]:
                first += 1
            if first == len(units):
                return
            if self.query is None:
                unused[first] = False
                self.place(units[first])
                continue
            score, room = np.where(unused, index.scores(self.query), -1.0), self.window - self.filled
            for k in np.argsort(-score, kind="stable").tolist():
                if not unused[k]:
                    return
                unused[k] = False
                room -= len(units[k].ids) // 4
                self.place(units[k])
                if room <= 0:
                    break

    def finish(self) -> None:
        """Cuts what the last window holds at powers of two, the largest first."""
        pieces = [list(x) for x in reversed(self.open)]
        while self.filled:
            size = room = 1 << (self.filled.bit_length() - 1)
            while room:
                unit, at, n = pieces[-1]
                own = min(n, room)
                self._emit(unit, at, own, size - room)
                room -= own
                pieces[-1][1:] = at + own, n - own
                if own == n:
                    pieces.pop()
            self.filled -= size
            self.sequence += 1
        self.open = []


#: The columns of a piece, after doc_id.
_PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, shard: int = SHARD) -> DataFrame:
    """A row for each piece of each document, with its sequence and its place there."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    # Rows are told apart by their place in the stored table, which stays.
    rows = materialize(tokenize(docs, tokenizer).withColumn("row", F.monotonically_increasing_id()), "packing-tokens")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).head()
    size = max(Tokenizer.from_file(tokenizer or default_tokenizer()).get_vocab_size(), END + 1)
    corpus = Statistics.of(document_frequencies(rows, size), n, total)
    names = ["doc_id", *_PIECE]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        units: list[Unit] = []
        held = 0

        def out(least: int) -> Iterator[pa.RecordBatch]:
            while len(packer.rows) > least:
                own, packer.rows = packer.rows[:20_000], packer.rows[20_000:]
                columns = list(zip(*own))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], ids_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        ids_type = None
        for b in batches:
            ids_type = b.schema.field("doc_id").type
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                n_own = len(ids) // 4
                packer.whole(doc_id, ids, n_own)
                start = n_own - n_own % window
                if start < n_own:
                    units.append(Unit(doc_id, start, ids[4 * start :], n_own, *corpus.weighed(np.frombuffer(ids, "<u4"))))
                    held += n_own - start + len(units[-1].terms)
                if len(units) >= shard or held >= SHARD_TOKENS:
                    packer.shard(units)
                    units, held = [], 0
                yield from out(20_000)
        if units:
            packer.shard(units)
        packer.finish()
        if ids_type is not None:
            yield from out(0)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_TOKENS))
    order = ["signature", "row"]
    dealt = rows.select("doc_id", "ids", *order).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "ids").mapInArrow(packed, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _PIECE))
