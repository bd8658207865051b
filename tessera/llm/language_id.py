"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams by language and bucket inside each partition and adds up these fixed-size tables in Spark; scoring broadcasts
one matrix of log probabilities (buckets x languages) and gathers its rows for all n-grams of a batch at once in numpy.

Edge cases: a text that is null or has no letter is ``und`` with score 0; null languages and held-out rows are not learnt from;
repeated rows each count and each get a row; with nothing to learn from every row is ``und``; an empty table gives no rows; further
columns are ignored. Long texts are hashed in slices, so memory does not grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, crc_of, summed_arrays, texts

BUCKETS = 1 << 16
ORDERS = (2, 3)
#: Code points hashed at once.
SLICE = 1 << 19
#: Counts in a row that a partition sends.
PIECE = 512


def _buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each code point but the last order - 1."""
    n = len(codes) - order + 1
    h = np.full(max(n, 0), order * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(order):
        h = (h ^ codes[k : k + len(h)]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def _blocks(values: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows: their code points, each text with a blank before it and two after, then bounds of the texts and their rows.

    A text longer than SLICE comes in slices that overlap, so that no n-gram is lost or counted twice.
    """
    at, size, most = [], 0, max(ORDERS) - 1
    held: list[str] = []

    def block():
        codes = np.frombuffer("".join(held).encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum([len(x) for x in held])
        return codes, np.column_stack([ends - [len(x) for x in held], ends - most]), np.array(at)

    for row, text in enumerate(values):
        text = " " + text.lower() + "  "
        for start in range(0, max(1, len(text) - most), SLICE):
            held.append(text[start : start + SLICE + most])
            at.append(row)
            size += len(held[-1])
            if size >= SLICE:
                yield block()
                at, size, held = [], 0, []
    if held:
        yield block()


def _trained(batches: Iterator[pa.RecordBatch], languages: dict[str, int]) -> Iterator[pa.RecordBatch]:
    k = len(languages)
    counts = np.zeros(BUCKETS * k, dtype=np.int64)
    for b in batches:
        own = np.array([languages[x] for x in b.column("lang").to_pylist()], dtype=np.int64)
        for codes, bounds, rows in _blocks(texts(b.column("text"))):
            of = np.full(len(codes), -1, dtype=np.int64)
            for (start, end), row in zip(bounds, rows):
                of[start:end] = own[row]
            for order in ORDERS:
                ids = _buckets(codes, order)
                here = of[: len(ids)]
                counts += np.bincount((ids * np.int64(k) + here)[here >= 0], minlength=len(counts))
    pieces = counts.reshape(-1, PIECE)
    some = np.flatnonzero(pieces.any(axis=1))
    for k in range(0, len(some), 1024):
        yield pa.RecordBatch.from_arrays([pa.array(some[k : k + 1024], pa.int32()), pa.array(list(pieces[some[k : k + 1024]]), pa.list_(pa.int64()))], ["piece", "n"])


class LanguageModel:
    """Languages, sorted; the log probability of each bucket in each; and of each language."""

    def __init__(self, languages: list[str], log_prob: np.ndarray, prior: np.ndarray):
        self.languages, self.log_prob, self.prior = languages, log_prob, prior

    def predict(self, values: list[str]) -> tuple[list[str], list[float]]:
        total = np.tile(self.prior, (len(values), 1))
        for codes, bounds, rows in _blocks(values):
            for order in ORDERS:
                # Every second segment is a text, the others the blanks after it.
                each = np.add.reduceat(np.vstack([self.log_prob[_buckets(codes, order)], np.zeros((order, len(self.prior)), np.float32)]), bounds.ravel(), axis=0, dtype=np.float64)
                np.add.at(total, rows, each[::2])
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        known = [any(map(str.isalpha, x)) for x in values]
        return [self.languages[k] if ok else "und" for k, ok in zip(best, known)], [float(p[i, k]) if ok else 0.0 for i, (k, ok) in enumerate(zip(best, known))]


def fit_languages(rows: DataFrame, smoothing: float = 0.5) -> LanguageModel | None:
    """Learns from rows (text, lang). The languages, and one count for each language and bucket, come to the driver: neither grows with the rows."""
    rows = rows.where("lang IS NOT NULL").select("text", "lang")
    prior = sorted((r.lang, r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    if not prior:
        return None
    names = [x for x, _ in prior]
    index, k = {x: i for i, x in enumerate(names)}, len(names)
    parts = rows.mapInArrow(lambda batches: _trained(batches, index), "piece int, n array<bigint>")
    counts = np.zeros((BUCKETS * k // PIECE, PIECE))
    for r in summed_arrays(parts, "piece", "n").collect():  # the matrix: BUCKETS x languages numbers
        counts[r.piece] = r.n
    counts = counts.reshape(BUCKETS, k) + smoothing
    n = np.array([x for _, x in prior], float)
    return LanguageModel(names, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(n / n.sum()))


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learnt from the others."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text", "lang")
    model = fit_languages(rows.where("NOT held_out"))
    sent = spark.sparkContext.broadcast(model)

    def scored(batches):
        for b in batches:
            values = texts(b.column("text"))
            got = sent.value.predict(values) if sent.value and values else (["und"] * len(values), [0.0] * len(values))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(got[0], pa.string()), pa.array(got[1], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kept = rows.select("doc_id", "held_out", "text")
    return kept.mapInArrow(scored, f"doc_id {dict(kept.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def fourth(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4."""
    return crc_of(F.col(doc_id)) % 4 == 2
