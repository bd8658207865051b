"""Property graphs as two tables: nodes (node_id, label, ...) and rels (type, src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sinks_shared import materialize


def both_ways(rels: DataFrame) -> DataFrame:
    """Each edge from both its ends; a loop once."""
    back = rels.where("src != dst").select(F.col("type"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return rels.select("type", "src", "dst").unionByName(back)


def neighbours(rels: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, type, neighbour, direction of each edge at a seed (node_id)."""
    s = seeds.select(F.col("node_id").alias("seed"))
    out = rels.join(s, F.col("src") == F.col("seed")).select("seed", "type", F.col("dst").alias("neighbour"), F.lit("out").alias("direction"))
    into = rels.where("src != dst").join(s, F.col("dst") == F.col("seed")).select("seed", "type", F.col("src").alias("neighbour"), F.lit("in").alias("direction"))
    return out.unionByName(into)


#: Ids that may be broadcast, at most.
FEW = 100_000


def induced(rels: DataFrame, nodes: DataFrame, keep: Column | None = None, few: int = FEW) -> DataFrame:
    """Edges of which both ends are among nodes (node_id); keep: and that meet a condition.

    Where nodes are many, most ends are among them: each end is then looked up once, and if those that are none are few, edges are held
    against these by broadcast, so that no edge is moved. Else edges meet the nodes at one end and then at the other.
    """
    ids = nodes.select("node_id").distinct()
    own = rels if keep is None else rels.where(keep)
    if nodes.select("node_id").limit(few + 1).count() > few:
        ends = own.select(F.col("src").alias("node_id")).union(own.select("dst")).where("node_id IS NOT NULL").distinct()
        strange = materialize(ends.join(nodes.select("node_id"), "node_id", "left_anti"), "strange-ends")
        if strange.count() <= few:
            strange = F.broadcast(strange)
            known = own.where("src IS NOT NULL AND dst IS NOT NULL")
            return known.join(strange, known["src"] == strange["node_id"], "left_anti").join(strange, F.col("dst") == strange["node_id"], "left_anti")
    return own.join(ids, own["src"] == ids["node_id"], "left_semi").join(ids, F.col("dst") == ids["node_id"], "left_semi")


def paths(rels: DataFrame, seeds: DataFrame, hops: int, through: Column | None = None, ends: DataFrame | None = None) -> DataFrame:
    """seed, length, end and edges of paths of 1 to so many edges in either direction that use no edge twice.

    through: a condition on the edges that may be used. ends: only paths to these nodes (node_id) are given; they may pass others.
    rels have a rel_id. Each hop is one join on the end of the path.
    """
    own = rels if through is None else rels.where(through)
    step = own.select("rel_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    step = step.unionByName(own.where("src != dst").select("rel_id", F.col("dst").alias("a"), F.col("src").alias("b")))
    reached = seeds.select(F.col("node_id").alias("seed"), F.col("node_id").alias("end"), F.array().cast("array<string>").alias("edges"))
    out = None
    for length in range(1, hops + 1):
        nxt = reached.join(step, reached["end"] == step["a"]).where(~F.array_contains("edges", F.col("rel_id")))
        reached = nxt.select("seed", F.col("b").alias("end"), F.array_append("edges", F.col("rel_id")).alias("edges"))
        found = reached.select("seed", F.lit(length).alias("length"), "end", "edges")
        out = found if out is None else out.unionByName(found)
    if ends is not None:
        out = out.join(ends.select(F.col("node_id").alias("end")).distinct(), "end", "left_semi")
    return out.select("seed", "length", "end", "edges")


def triplet_schema(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """Distinct (source label, type, target label), with the number of edges.

    Labels are few, so the sums by label are what the last shuffle moves.
    """
    a = nodes.select(F.col("node_id").alias("src"), F.col("label").alias("source"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("label").alias("target"))
    return rels.join(a, "src").join(b, "dst").groupBy("source", "type", "target").agg(F.count("*").alias("n"))


def filter_view(nodes: DataFrame, rels: DataFrame, groups: set[str], group_of: Column, deny: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes of some groups, and edges of allowed types between these."""
    own = nodes.where(group_of.isin(*groups))
    return own, induced(rels, own, ~F.col("type").isin(*deny) if deny else None)


def relabel(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping: old, new; labels without a row stay."""
    return nodes.join(F.broadcast(mapping), nodes["label"] == mapping["old"], "left").withColumn("label", F.coalesce("new", "label")).drop("old", "new")


def rename_types(rels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Types by a mapping of old to new, few as types are, so edges are not dealt by type; edges that become equal are one."""
    own = rels.join(F.broadcast(mapping), rels["type"] == mapping["old"], "left").withColumn("type", F.coalesce("new", "type")).drop("old", "new")
    return own.select("type", "src", "dst").distinct()


def ancestors(parents: DataFrame, levels: int = 10) -> DataFrame:
    """child, ancestor and distance over edges child -> parent, at most so many levels, so that a cycle ends.

    Each round joins the last level's pairs with the edges; pairs found at a smaller distance are not followed again. Rounds are
    written, so that plans do not grow with the levels, and end when one finds nothing.
    """
    edge = parents.select("child", "parent").distinct()
    out = last = materialize(edge.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")), "ancestors")
    up = edge.select(F.col("child").alias("ancestor"), F.col("parent").alias("next"))
    for distance in range(2, levels + 1):
        found = last.join(up, "ancestor").select("child", F.col("next").alias("ancestor")).distinct()
        last = materialize(found.join(out, ["child", "ancestor"], "left_anti").withColumn("distance", F.lit(distance)), "ancestors")
        if not last.limit(1).count():
            break
        out = out.unionByName(last)
    return out
