"""Statistics, pivots and evaluation scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stats_by(rows: DataFrame, keys: list[str], value: str, digits: int = 4) -> DataFrame:
    """count, mean, sample deviation, min, median and max of a value by keys."""
    r = lambda c: F.round(c, digits)
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"), r(F.avg(value)).alias("mean"), r(F.stddev_samp(value)).alias("std"),
        F.min(value).alias("low"), r(F.percentile(value, F.lit(0.5))).alias("median"), F.max(value).alias("high"),
    )


def percentiles(rows: DataFrame, key: str, value: str, points=(0.25, 0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """n, interpolated percentiles and the largest value by key, each in a column of its own."""
    of = rows.groupBy(key).agg(F.count("*").alias("n"), F.percentile(value, F.array(*map(F.lit, points))).alias("p_"), F.max(value).alias("largest"))
    return of.select(key, "n", *(F.round(F.col("p_")[k], 4).alias(f"p{round(100 * p)}") for k, p in enumerate(points)), "largest")


def pivot_metrics(rows: DataFrame, key: str, metric: str, value: str, metrics: list[str], digits: int = 4) -> DataFrame:
    """A row a key, a column a metric: the mean of its values. The metrics are named, so no extra pass looks for them."""
    return rows.groupBy(key).agg(*(F.round(F.avg(F.when(F.col(metric) == m, F.col(value))), digits).alias(m) for m in metrics))


def rouge1(pairs: DataFrame) -> DataFrame:
    """pairs (id, a, b: arrays of words) -> id, precision, recall and F1 of b against a, by unigram counts."""
    def counts(side: str) -> DataFrame:
        return pairs.select("id", F.explode(side).alias("w")).groupBy("id", "w").agg(F.count("*").alias(side))

    common = counts("a").join(counts("b"), ["id", "w"]).groupBy("id").agg(F.sum(F.least("a", "b")).alias("common"))
    own = pairs.select("id", F.size("a").alias("na"), F.size("b").alias("nb")).join(common, "id", "left")
    c = F.coalesce("common", F.lit(0))
    share = lambda n: F.when(F.col(n) > 0, c / F.col(n)).otherwise(0.0)
    f1 = F.when(c > 0, 2 * c / (F.col("na") + F.col("nb"))).otherwise(0.0)
    return own.select("id", F.round(share("nb"), 4).alias("precision"), F.round(share("na"), 4).alias("recall"), F.round(f1, 4).alias("f1"))


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence: a bit for each place of the longer side, a step for each item of the shorter one.

    After a step, the zero bits of ``row`` mark the places where the best length so far grows. Only items of both sides count, and the
    places of an item are made into bits when it is met, so memory is linear in the longer side.
    """
    both = set(a) & set(b)
    long, short = sorted(([x for x in side if x in both] for side in (a, b)), key=len, reverse=True)
    places: dict = {}
    for i, x in enumerate(long):
        places.setdefault(x, []).append(i)
    everywhere = (1 << len(long)) - 1
    row = everywhere
    for x in short:
        bits = bytearray(len(long) // 8 + 1)
        for i in places[x]:
            bits[i >> 3] |= 1 << (i & 7)
        met = row & int.from_bytes(bits, "little")
        row = ((row + met) | (row - met)) & everywhere
    return len(long) - row.bit_count()


def rouge_l(pairs: DataFrame) -> DataFrame:
    """pairs (id, a, b: arrays of words) -> id, precision, recall and F1 of b against a, by their longest common subsequence; a null or
    empty side gives zeros. Pairs are independent, in Arrow batches; whole texts are compared."""

    def lengths(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([common_subsequence(list(x), list(y)) for x, y in zip(a, b)], dtype="int64")

    side = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    own = pairs.select("id", side(F.col("a")).alias("a"), side(F.col("b")).alias("b"))
    scored = own.select("id", F.size("a").alias("na"), F.size("b").alias("nb"), F.pandas_udf(lengths, "long")("a", "b").alias("c"))
    share = lambda n: F.round(F.when(F.col("c") > 0, F.col("c") / n).otherwise(0.0), 4)
    return scored.select("id", share(F.col("nb")).alias("precision"), share(F.col("na")).alias("recall"), share((F.col("na") + F.col("nb")) / 2).alias("f1"))


def size_histogram(rows: DataFrame, vector: str) -> DataFrame:
    """How many rows have a vector of each size; null ones have size 0."""
    size = F.coalesce(F.size(vector), F.lit(0))
    return rows.groupBy(F.when(F.col(vector).isNull(), 0).otherwise(size).alias("size")).agg(F.count("*").alias("n"))


def non_null(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, total and non_null of each column, from one aggregation."""
    one = rows.agg(F.count("*").alias("total"), *(F.count(c).alias(c) for c in columns))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("non_null")) for c in columns)))
    return one.select("total", each.alias("x")).select("x.column", "total", "x.non_null")


def value_counts(rows: DataFrame, column: Column, name: str) -> DataFrame:
    return rows.groupBy(column.alias(name)).agg(F.count("*").alias("n"))


def inverse(rows: DataFrame, mapping: str) -> DataFrame:
    """From maps of a new name to its old ones to rows old, new, without names that stay."""
    each = rows.select(F.explode(mapping).alias("new", "olds")).select("new", F.explode("olds").alias("old"))
    return each.where("old != new").select("old", "new")


def last_values(rows: DataFrame, key: str, order: str, maps: str, name: str) -> DataFrame:
    """The value that a name has in the last map of each key that holds it, by partial aggregation."""
    own = rows.where(F.map_contains_key(maps, name))
    return own.groupBy(key).agg(F.max_by(F.element_at(maps, name), order).alias("value"))


def zipped(rows: DataFrame, key: str, order: str, left: Column, right: Column) -> DataFrame:
    """key, place, question, answer: rows of either kind by their places among their own, without collecting a key's rows."""
    from pyspark.sql import Window

    w = Window.partitionBy(key, "kind_").orderBy(order)
    placed = rows.withColumn("kind_", F.when(left, 0).when(right, 1)).where("kind_ IS NOT NULL").withColumn("place", F.row_number().over(w) - 1)
    of = placed.groupBy(key, "place").agg(F.max(F.when(F.col("kind_") == 0, F.col(order))).alias("question"), F.max(F.when(F.col("kind_") == 1, F.col(order))).alias("answer"))
    both = placed.groupBy(key).agg(F.count_distinct("kind_").alias("kinds_")).where("kinds_ = 2").select(key)
    return of.join(both, key, "left_semi").select(key, "place", "question", "answer")


def both_allowed(triples: DataFrame, names: DataFrame) -> DataFrame:
    """triples (source, relation, target, ...) with allowed: whether both ends are among names."""
    own = names.distinct()
    a, b = own.select(F.col("name").alias("source"), F.lit(True).alias("a_")), own.select(F.col("name").alias("target"), F.lit(True).alias("b_"))
    joined = triples.join(a, "source", "left").join(b, "target", "left")
    return joined.select(*triples.columns, F.coalesce(F.col("a_") & F.col("b_"), F.lit(False)).alias("allowed"))


def entity_recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """id and recall: the share of the entities (id, entity) of the truth that were found; ids that both have."""
    a, b = truth.distinct(), found.distinct()
    hit = a.join(b.withColumn("hit_", F.lit(1)), ["id", "entity"], "left").groupBy("id").agg(F.round(F.count("hit_") / F.count("*"), 4).alias("recall"))
    return hit.join(found.select("id").distinct(), "id", "left_semi")


def semantic_score(pairs: DataFrame) -> DataFrame:
    """id and cosine of the vectors a and b."""
    from tessera.functions.vectors import cosine

    return pairs.select("id", F.round(cosine(F.col("a"), F.col("b")), 4).alias("score"))
