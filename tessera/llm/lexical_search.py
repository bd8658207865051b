"""Ranked lexical search over a tiered inverted index.

``build`` reads every text once. Rows are indexed in blocks of a bounded number of documents; a block holds for each of its terms up to
three lists of postings, the tiers: the postings of highest impact within the block, then the next, then the rest. Beside a list stands
its bound: for each term frequency in it the least document length, from which the largest impact in the list follows exactly for any
corpus, so a search knows what a tier may hold without reading its postings.

``search`` first adds up, for the whole corpus, how many documents hold a term and what the tiers below each hold at most (the residual
bounds). A round then reads the tiers down to one level. The tenth best sum so far is a score that the answer must reach. If the
residuals of an item's terms add up to less, no document outside the lists read can be among the ten: the item is proven, and the few
documents whose sum could still rise that far are scored whole, over all tiers. Items that lack this proof fall through to the next
round by themselves; the last one reads all tiers, where sums are exact.

Documents' scores add up within their block, so only the best ten rows of each block and the candidates move. Items are taken in
blocks of a bounded number of terms (by a count, then a hash), so what a task is handed with the items is bounded, too.

Edge cases: a null or empty text, and one without a term, is no document; rows that repeat, in id or as a whole, are documents each on
its own, and rank next to each other; null ids rank after others of their score; rows of one item id with different texts are items each
on its own, equal rows are one; an item without a term, or whose terms no document holds, gives no rows; empty tables give none;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, materialize
from tessera.operators.retrieval import top_per

#: Documents in a block, and postings after which it is closed all the same.
BLOCK, BLOCK_POSTINGS = 2048, 1_000_000
#: A term's postings in the first tier of a block, and in the first two: its documents divided by these.
SHARES = (32, 4)
TIERS = len(SHARES) + 1
#: Distinct terms of the items in a block of items, on average at most.
ITEM_TERMS = 200_000
#: Items' rows times documents of one matrix of sums.
MATRIX = 4_000_000
K = 10

#: Bytes of terms, in lower case; all others end a term.
_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in turn."""
    return text.translate(_TERMS).split()


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a posting adds to a score, but for the term's weight."""
    m = 100 - 90 + (90 * n * documents) // max(total, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class _Block:
    """Documents that are being indexed together."""

    def __init__(self, most: int):
        self.most = most
        self.ids: list = []
        self.lengths: list[int] = []
        self.terms: list[bytes] = []
        self.tfs: list[int] = []
        self.sizes: list[int] = []

    def add(self, doc_id, text: bytes) -> None:
        counts = Counter(terms_of(text))
        if counts:
            self.ids.append(doc_id)
            self.lengths.append(sum(counts.values()))
            self.sizes.append(len(counts))
            self.terms += counts.keys()
            self.tfs += counts.values()

    def full(self) -> bool:
        return len(self.ids) >= self.most or len(self.terms) >= BLOCK_POSTINGS

    def lists(self, block: int, ids_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """The block's own row (no term; ids, lengths), then a row for each term and tier."""
        n = np.array(self.lengths, np.int64)
        yield _rows(block, [None], [-1], [len(n)], [n.tobytes()], [b""], pa.array([self.ids], pa.list_(ids_type)))
        coded = pa.array(self.terms, pa.binary()).dictionary_encode()
        code, tf = coded.indices.to_numpy().astype(np.int64), np.array(self.tfs, np.int64)
        doc = np.repeat(np.arange(len(n)), self.sizes)
        order = np.lexsort((doc, -impacts(tf, n[doc], len(n), int(n.sum())), code))
        code, tf, doc = code[order], tf[order], doc[order]
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        rank = np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))
        tier = sum((rank >= -(-len(n) // share)).astype(np.int64) for share in SHARES)
        key = code * TIERS + tier
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        ends = np.append(starts[1:], len(key))
        # Bounds: of each list the frequencies in it, each with the least length.
        size = n[doc]
        by = np.lexsort((size, tf, key))
        pair = (key[by], tf[by])
        first = np.flatnonzero((np.diff(pair[0], prepend=-1) != 0) | (np.diff(pair[1], prepend=-1) != 0))
        bounds = np.column_stack([pair[1][first], size[by][first]]).astype("<i4")
        bound_ends = np.append(np.flatnonzero(np.diff(pair[0][first], prepend=-1))[1:], len(first))
        postings = np.column_stack([doc, tf]).astype("<i4")
        words = coded.dictionary.take(pa.array(code[starts]))
        for at in range(0, len(starts), 20_000):
            own = slice(at, at + 20_000)
            yield _rows(
                block, words[own], tier[starts][own], (ends - starts)[own], _binaries(postings, starts[own], ends[own]),
                _binaries(bounds, np.append(0, bound_ends[:-1])[own], bound_ends[own]), pa.nulls(len(starts[own]), pa.list_(ids_type)),
            )


def _binaries(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows starts[k] to ends[k] of a matrix as bytes, k by k; the ranges follow each other."""
    own = np.ascontiguousarray(values[starts[0] : ends[-1]])
    offsets = np.append(starts, ends[-1]) - starts[0]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((offsets * own.itemsize * own.shape[1]).astype("<i4").tobytes()), pa.py_buffer(own.tobytes())])


def _rows(block: int, term, tier, size, postings, bound, ids) -> pa.RecordBatch:
    columns = [pa.array([block] * len(size), pa.int64()), pa.array(term, pa.binary()), pa.array(tier, pa.int32()), pa.array(size, pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(postings, pa.binary()), pa.array(bound, pa.binary()), ids], ["block", "term", "tier", "size", "postings", "bound", "ids"])


def build(docs: DataFrame, most: int = BLOCK) -> DataFrame:
    """The index of all documents, written to the shared folder: block, term, tier, size, postings, bound, ids; a block has so many
    documents at most."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block, ids_type = _Block(most), TaskContext.get().partitionId() << 32, None
        for b in batches:
            ids_type = b.schema.field("doc_id").type
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                own.add(doc_id, text or b"")
                if own.full():
                    yield from own.lists(block, ids_type)
                    own, block = _Block(most), block + 1
        if own.ids:
            yield from own.lists(block, ids_type)

    schema = f"block long, term binary, tier int, size long, postings binary, bound binary, ids array<{kind}>"
    return materialize(docs.select("doc_id", "text").mapInArrow(indexed, schema), "lexical-index")


@dataclass
class Items:
    """A block of items with the corpus' numbers of their terms; this is handed to tasks."""

    ids: list
    terms: dict[bytes, int]
    of_term: list[np.ndarray]  # for each term the items that hold it
    documents: int
    total: int
    weight: np.ndarray  # of each term
    residual: np.ndarray  # [tier, term]: what postings below the tier add at most, with the weight

    def below(self, tier: int) -> np.ndarray:
        """For each item what the tiers below add at most."""
        out = np.zeros(len(self.ids), np.int64)
        for t, own in enumerate(self.of_term):
            out[own] += self.residual[tier, t]
        return out


def _item_terms(items: DataFrame) -> DataFrame:
    """item_id and the distinct terms of each item, equal rows once."""
    kind = dict(items.dtypes)["item_id"]

    def each(batches):
        for b in batches:
            own = [sorted(set(terms_of(x or b""))) for x in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(own, pa.list_(pa.binary()))], ["item_id", "terms"])

    return items.select("item_id", "text").distinct().mapInArrow(each, f"item_id {kind}, terms array<binary>").where("size(terms) > 0")


def _numbers(lists: DataFrame, rows: list) -> Items:
    """The corpus' numbers for a block of items (item_id, terms) from the lists of their terms: at most a row a term and tier is taken."""
    terms = {t: k for k, t in enumerate(sorted({t for r in rows for t in r.terms}))}
    of_term: list[list[int]] = [[] for _ in terms]
    for k, r in enumerate(rows):
        for t in r.terms:
            of_term[terms[t]].append(k)
    blocks = lists.where("term IS NULL").select("size", "postings")

    def sums(batches):
        for b in batches:
            lengths = [int(np.frombuffer(x, "<i8").sum()) for x in b.column("postings").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("size"), pa.array(lengths, pa.int64())], ["n", "total"])

    documents, total = (x or 0 for x in blocks.mapInArrow(sums, "n long, total long").agg(F.sum("n"), F.sum("total")).head())

    def tops(batches):
        for b in batches:
            top = []
            for x in b.column("bound").to_pylist():
                pair = np.frombuffer(x, "<i4").astype(np.int64)
                top.append(int(impacts(pair[::2], pair[1::2], documents, total).max()))
            yield pa.RecordBatch.from_arrays([b.column("term"), b.column("tier"), b.column("size"), pa.array(top, pa.int64())], ["term", "tier", "size", "top"])

    found = lists.where("term IS NOT NULL").select("term", "tier", "size", "bound").mapInArrow(tops, "term binary, tier int, size long, top long")
    df, top = np.zeros(len(terms), np.int64), np.zeros((TIERS + 1, len(terms)), np.int64)
    for r in found.groupBy("term", "tier").agg(F.sum("size").alias("size"), F.max("top").alias("top")).collect():
        t = terms[bytes(r.term)]
        df[t] += r.size
        top[r.tier, t] = r.top
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    below = np.flip(np.maximum.accumulate(np.flip(top, 0), 0), 0)[1:]  # of all tiers after each
    return Items([r.item_id for r in rows], terms, [np.array(x) for x in of_term], documents, total, weight, weight * below)


def _scored(table: pa.Table, items: Items, wanted: np.ndarray, tier: int):
    """The block's ids and, for some of the wanted items at a time, these with sums and credits over the block's documents.

    A credit is what the residual bounds of the terms that a document was found by add up to.
    """
    header = table.filter(pc.is_null(table.column("term")))
    ids = header.column("ids")[0].values
    lengths = np.frombuffer(header.column("postings")[0].as_py(), "<i8")
    lists = table.filter(pc.is_valid(table.column("term")))
    own = [(items.terms[t], np.frombuffer(p, "<i4").reshape(-1, 2)) for t, p in zip(lists.column("term").to_pylist(), lists.column("postings").to_pylist())]
    place = np.full(len(items.ids), -1)
    step = max(1, MATRIX // max(len(lengths), 1))
    for at in range(0, len(wanted), step):
        chosen = wanted[at : at + step]
        place[:] = -1
        place[chosen] = np.arange(len(chosen))
        sums = np.zeros((len(chosen), len(lengths)), np.int64)
        credits = np.zeros_like(sums) if tier < TIERS - 1 else None
        for t, posting in own:
            rows = place[items.of_term[t]]
            rows = rows[rows >= 0]
            if len(rows):
                doc, tf = posting[:, 0], posting[:, 1].astype(np.int64)
                sums[np.ix_(rows, doc)] += items.weight[t] * impacts(tf, lengths[doc], items.documents, items.total)
                if credits is not None and items.residual[tier, t]:
                    credits[np.ix_(rows, doc)] += items.residual[tier, t]
        yield ids, chosen, sums, credits


def _id_ranks(ids: pa.Array) -> np.ndarray:
    """The place of each id in ascending order; equal ones by row, null last."""
    out = np.empty(len(ids), np.int64)
    out[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
    return out


def _best(lists: DataFrame, items: Items, wanted: np.ndarray, tier: int, k: int, kind: str) -> DataFrame:
    """item (its number), doc_id, score: each block's k best sums over the lists, of which each item's k best are kept."""

    def best(t: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        ids, order = None, None
        for ids, chosen, sums, _ in _scored(t, items, wanted, tier):
            order = _id_ranks(ids) if order is None else order
            for row, item in enumerate(chosen.tolist()):
                some = np.flatnonzero(sums[row])
                if len(some) > k:
                    values = sums[row][some]
                    some = some[values >= np.partition(values, -k)[-k]]
                some = some[np.lexsort((order[some], -sums[row][some]))[:k]]
                out += zip([item] * len(some), some.tolist(), sums[row][some].tolist())
        item, doc, score = zip(*out) if out else ([], [], [])
        return pa.table({"item": pa.array(item, pa.int32()), "doc_id": ids.take(pa.array(doc, pa.int64())), "score": pa.array(score, pa.int64())})

    found = lists.groupBy("block").applyInArrow(best, f"item int, doc_id {kind}, score long")
    return top_per(found, "item", k, F.desc("score"), F.asc_nulls_last("doc_id"))


def _candidates(lists: DataFrame, items: Items, proven: np.ndarray, least: np.ndarray, tier: int) -> DataFrame:
    """block, item and row (in the block) of documents whose sum, with all that lower tiers may add, reaches what the item's answer needs."""
    below = items.below(tier)

    def able(t: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        for _, chosen, sums, credits in _scored(t, items, proven, tier):
            row, doc = np.nonzero((sums > 0) & (sums + below[chosen][:, None] - credits >= least[chosen][:, None]))
            out += zip(chosen[row].tolist(), doc.tolist())
        item, doc = zip(*out) if out else ([], [])
        return pa.table({"block": pa.array([t.column("block")[0].as_py()] * len(item), pa.int64()), "item": pa.array(item, pa.int32()), "row": pa.array(doc, pa.int32())})

    return lists.groupBy("block").applyInArrow(able, "block long, item int, row int")


def _exact(lists: DataFrame, candidates: DataFrame, items: Items, k: int, kind: str) -> DataFrame:
    """Each item's k best of its candidates, scored over all tiers; only their blocks are read."""

    def scored(found: pa.Table, t: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        number, row = found.column("item").to_numpy(), found.column("row").to_numpy()
        ids = None
        if len(number):
            for ids, chosen, sums, _ in _scored(t, items, np.unique(number), TIERS - 1):
                own = np.isin(number, chosen)
                at = np.searchsorted(chosen, number[own])
                out += zip(number[own].tolist(), row[own].tolist(), sums[at, row[own]].tolist())
        item, doc, score = zip(*out) if out else ([], [], [])
        ids = ids.take(pa.array(doc, pa.int64())) if ids is not None else t.column("ids").combine_chunks().flatten()[:0]
        return pa.table({"item": pa.array(item, pa.int32()), "doc_id": ids, "score": pa.array(score, pa.int64())})

    own = lists.join(candidates.select("block").distinct(), "block", "left_semi")
    rows = candidates.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(scored, f"item int, doc_id {kind}, score long")
    return top_per(rows, "item", k, F.desc("score"), F.asc_nulls_last("doc_id"))


def _answered(spark: SparkSession, index: DataFrame, rows: list, k: int, kind: str, proven_at: list[int] | None) -> Iterator[tuple[Items, DataFrame]]:
    """Answers of a block of items, round by round."""
    terms = sorted({t for r in rows for t in r.terms})
    vocabulary = spark.createDataFrame([(bytearray(t),) for t in terms], "term binary")
    if len(terms) <= 2 * ITEM_TERMS:  # a block has more only where one item has, and is then left to Spark
        vocabulary = F.broadcast(vocabulary)
    lists = materialize(index.join(vocabulary, "term", "left_semi").unionByName(index.where("term IS NULL")), "item-lists")
    items = _numbers(lists, rows)
    pending = np.arange(len(rows))
    for tier in range(TIERS):
        if not len(pending):
            return
        read = lists.where(F.col("tier") <= tier)
        best = materialize(_best(read, items, pending, tier, k, kind), "best")
        if tier == TIERS - 1:
            proven, done = pending, best
        else:
            # Of each item the k-th best sum, where there are so many: a row an item.
            kth = {r.item: r.score for r in best.groupBy("item").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == k).collect()}
            least = np.array([kth.get(i, 0) for i in range(len(rows))], np.int64)
            below = items.below(tier)
            proven = pending[(below[pending] < least[pending]) | (below[pending] == 0)]
            if not len(proven):
                continue
            candidates = materialize(_candidates(read, items, proven, least, tier), "candidates")
            done = _exact(lists, candidates, items, k, kind)
        if proven_at is not None:
            proven_at.append(len(proven))
        pending = np.setdiff1d(pending, proven)
        yield items, done


def search(index: DataFrame, items: DataFrame, k: int = K, proven_at: list[int] | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents. proven_at: gets the number of items proven in each round that proves some."""
    spark = index.sparkSession
    kind = dict(index.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    asked = materialize(_item_terms(items), "items")
    n_terms = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).head()[0]
    blocks = max(1, -(-n_terms // ITEM_TERMS))
    out = spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id {kind}, score long")
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block).orderBy("item_id", "terms").collect()
        for numbers, found in _answered(spark, index, rows, k, kind, proven_at) if rows else ():
            names = spark.createDataFrame(list(enumerate(numbers.ids)), f"item int, item_id {dict(items.dtypes)['item_id']}")
            ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
            out = out.unionByName(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """Each item's k best of all documents, by a fresh index."""
    return search(build(docs), items, k)
