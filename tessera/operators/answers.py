"""Global answers: texts are cut into points, scored, and merged by a tree of groups, so that no task holds a level of the hierarchy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sinks_shared import materialize

#: From the text of a point to its score; 0 or null says that it does not help.
Scorer = Callable[[Column], Column]
#: Points that one group of a merge holds, on average.
FAN = 4096


def points(texts: DataFrame, scorer: Scorer, size: int = 500) -> DataFrame:
    """key, id, piece (from 0), score and text of texts (key, id, text), cut into pieces of so many characters; null and empty ones give none."""
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    rows = texts.select("key", "id", F.posexplode(cut).alias("piece", "text"))
    return rows.select("key", "id", "piece", scorer(F.col("text")).cast("double").alias("score"), "text")


def answers(found: DataFrame, budget: int = 4000, fan: int = FAN) -> DataFrame:
    """key, n_points, n_kept, mean_score and text: of each key its best points, best first, as long as all together fit the budget.

    found: key, id, piece, score, text. Points without a text or with a score of 0, less or null do not count. Equal scores stand by id
    and piece; of points that are equal in key, id and piece that of the higher score, then the later text, counts. A key whose first
    point does not fit has an empty text and no mean; a null key is a key.

    A group keeps the points before which no more than the budget is filled, so also the first that does not fit. What the whole level
    would take fits in each group too, and the first that it would not take is kept and stops the last merge, so the tree gives what one
    pass over all would. Groups are by a hash of id and piece, the same number for each key, and hold four times what they may keep or more.
    """
    fan, keys = max(fan, 4 * (budget + 1)), ["key", "id", "piece"]
    own = found.where("score > 0 AND length(text) > 0").groupBy(*keys).agg(F.max(F.struct("score", "text")).alias("b"))
    left = materialize(own.select(*keys, "b.score", "b.text", F.length("b.text").cast("long").alias("size")), "points")
    counts = materialize(left.groupBy("key").agg(F.count("*").alias("n_points")), "point-counts")
    order = [F.desc("score"), "id", "piece"]
    most = counts.agg(F.max("n_points")).head()[0] or 0
    while most > fan:
        groups = -(-most // fan)
        w = Window.partitionBy("key", F.pmod(F.xxhash64("id", "piece", F.lit(most)), F.lit(groups))).orderBy(*order)
        before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        left = materialize(left.withColumn("before", before).where(F.col("before") <= budget).drop("before"), "merged")
        most = left.groupBy("key").count().agg(F.max("count")).head()[0]
    w = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kept = left.withColumn("filled", F.sum("size").over(w)).where(F.col("filled") <= budget)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "piece", "text"))), lambda p: p.text), "\n")
    best = kept.groupBy("key").agg(F.count("*").alias("n_kept"), F.avg("score").alias("mean_score"), joined.alias("text")).withColumnRenamed("key", "of")
    all_keys = counts.join(best, F.col("key").eqNullSafe(F.col("of")), "left")
    return all_keys.select("key", "n_points", F.coalesce("n_kept", F.lit(0)).cast("long").alias("n_kept"), "mean_score", F.coalesce("text", F.lit("")).alias("text"))


def descendants(children: DataFrame, levels: int) -> DataFrame:
    """parent and child, each pair once, for children (parent, child) of as many levels: children, theirs, and so on."""
    edges = children.select("parent", "child").distinct()
    found = step = edges
    for _ in range(levels - 1):
        below = edges.select(F.col("parent").alias("child"), F.col("child").alias("below"))
        step = step.join(below, "child").select("parent", F.col("below").alias("child")).distinct()
        found = found.unionByName(step)
    return found.distinct()


def child_answers(children: DataFrame, texts: DataFrame, levels: int, budget: int = 4000, fan: int = FAN) -> DataFrame:
    """What parents without a text are summarized from: the texts (id, score, text) of all below them that have one, as ``answers`` gives them."""
    own = texts.where("length(text) > 0")
    bare = descendants(children, levels).join(own.select(F.col("id").alias("parent")).distinct(), "parent", "left_anti")
    rows = bare.join(own.withColumnRenamed("id", "child"), "child")
    return answers(rows.select(F.col("parent").alias("key"), F.col("child").alias("id"), F.lit(0).alias("piece"), F.col("score").cast("double").alias("score"), "text"), budget, fan)
