"""Interaction audit of five filters from a histogram of failure masks.

Every text is measured once by DataFrame functions, which give a mask with a bit for each filter that it fails. A text's smallest id
comes from a groupBy on the text's digest, so bit E (an equal text under a smaller id) needs no join: rows are counted by (text, id,
part, labels), then by (text, part, labels), and all but those of the smallest id fail. What is left is a histogram of 32 cells a part,
from which all orders of the filters are read without looking at a document again.

Equal texts are those with equal SHA-256 digests. Only counts move: rows of some 100 bytes, first by (text, id), so a text that a third
of all rows share is counted in as many tasks as any other, and then a row for each text, part and labels.

Edge cases: a null text counts as empty; a null lang is the part of the empty string, as an empty lang is; a null id is no id, so its row
neither fails E nor makes others fail it; rows that repeat with one id are counted each, and do not fail E by each other; an id with
several labels has each that one of them gives; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import let, words_of

#: The filters; bit k of a mask is set where the k-th fails.
FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "[#$%&*|]"
LEAST_WORDS = 200


def _bits(*fails: Column) -> Column:
    """The mask of conditions, the first as its lowest bit."""
    total = F.lit(0)
    for k, condition in enumerate(fails):
        total = total + F.when(condition, 1 << k).otherwise(0)
    return total


def text_mask(text: Column) -> Column:
    """Bits A to D of a text that is not null."""
    upper = F.length(text) - F.length(F.regexp_replace(text, f"[{LETTERS[0]}-{LETTERS[-1]}]+", ""))
    words = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("own")))
    return let(words, lambda w: _bits(w.n < LEAST_WORDS, 100 * w.own < 50 * w.n, 100 * upper > 3 * F.length(text), text.rlike(SYMBOLS)))


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and bits A to D, a row for each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = let(text, lambda t: F.struct(F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"), text_mask(t).alias("mask")))
    return docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), read.alias("r")).select("doc_id", "part", "r.*")


def histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bits A to E), and in it the documents, those of quality 1 and the toxic ones: at most 32 rows a part."""
    counted = masks(docs).groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    named = counted.where("doc_id IS NOT NULL").join(known, "doc_id", "left").na.fill(0, ["good", "toxic"])
    nameless = counted.where("doc_id IS NULL").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    rows = named.unionByName(nameless)
    # Of each text's rows of one kind: all, the smallest id, and the rows of that id.
    kinds = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    own = F.col("nameless") + F.when(F.col("least") == first, F.col("n_least")).otherwise(0)
    each = kinds.withColumn("first_ones", own).select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("mask"), F.col("first_ones").alias("n")), F.struct((F.col("mask") + (CELLS >> 1)).alias("mask"), (F.col("n") - F.col("first_ones")).alias("n"))
        )).alias("cell"),
    )
    n = F.col("cell.n")
    counts = {"n": F.sum(n), "n_good": F.sum(n * F.col("good")), "n_toxic": F.sum(n * F.col("toxic"))}
    return each.groupBy("part", "cell.mask").agg(*(F.coalesce(v, F.lit(0)).alias(k) for k, v in counts.items())).where("n > 0")


def _steps() -> Column:
    """Each order of the filters with each of its steps: the bits before it and its own."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            rows.append(f"struct('{name}' AS filter_order, {step} AS step, {before} AS before, {1 << f} AS bit)")
            before |= 1 << f
    return F.expr(f"array({', '.join(rows)})")


def orders(cells: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from the histogram.

    shapley: over all orders a document is removed by the first of the filters that it fails, and each of k comes first equally often.
    """
    each = lambda c: F.array(*(F.sum(F.when(F.col("mask") == k, F.col(c)).otherwise(0)) for k in range(CELLS))).alias(c)
    parts = cells.groupBy("part").agg(each("n"), each("n_good"), each("n_toxic"))
    steps = parts.withColumn("s", F.explode(_steps())).select("*", "s.*")
    before, bit = F.col("before"), F.col("bit")

    def total(counts: str, wanted) -> Column:
        """The sum over the cells of a part whose mask is wanted; the filter is given the count and the mask."""
        own = F.transform(F.col(counts), lambda x, m: F.when(wanted(m), x).otherwise(F.lit(0).cast("long")))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, b: a + b)

    fails = lambda m: m.bitwiseAND(bit) != 0
    unseen = lambda m: m.bitwiseAND(before) == 0
    n_orders = F.lit(120)
    shares = F.transform("n", lambda x, m: F.when(fails(m), x * (n_orders / F.greatest(F.bit_count(m), F.lit(1))).cast("long")).otherwise(F.lit(0).cast("long")))
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda m: unseen(m) & ~fails(m)).alias("kept"),
        total("n", lambda m: unseen(m) & fails(m)).alias("removed"),
        total("n", lambda m: ~unseen(m) & fails(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("n_good", lambda m: unseen(m) & fails(m)).alias("good_lost"),
        total("n_toxic", lambda m: unseen(m) & fails(m)).alias("toxic_lost"),
        F.aggregate(shares, F.lit(0).cast("long"), lambda a, b: a + b).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The effect of each filter in each order: 600 rows a part."""
    return orders(histogram(docs, labels))
