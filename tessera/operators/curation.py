"""Upkeep of a graph: orphans, duplicates, merges and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sinks_shared import materialize


#: Characters of a name that it meets longer ones by.
HEAD = 6


def orphans(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """Entities (node_id) without an edge to another entity."""
    ends = rels.where("src != dst").select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return entities.join(ends, "node_id", "left_anti")


def provenance(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """entities with documents (sorted names) and how many chunks mention each; none where none does."""
    of = mentions.groupBy("node_id").agg(F.sort_array(F.collect_set("file")).alias("documents"), F.count_distinct("chunk_id").alias("chunk_connections"))
    empty = F.array().cast("array<string>")
    return entities.join(of, "node_id", "left").withColumn("documents", F.coalesce("documents", empty)).withColumn("chunk_connections", F.coalesce("chunk_connections", F.lit(0)))


def duplicate_pairs(entities: DataFrame, distance: int | None = 5, shortest: int = 3, likeness: float = 0.97) -> DataFrame:
    """Pairs a < b of entities (label, name, and embedding if there is one) of one label that may be the same: one name contains the
    other, of at least ``shortest`` characters, or the first name is longer than the distance and their edit distance is below it (a
    distance of None: not asked), or their vectors' scaled similarity is the likeness or more. Names are compared in lower case.

    Names meet only if they share something: the first HEAD characters of a contained name, or all of a shorter one, stand in the other; of names within k edits, one of
    the k + 1 even pieces of the first stands in the other, k places away at most. Equal vectors meet by their hash; others by blocks.
    """
    own = entities.select("label", "name", F.lower("name").alias("low"), F.length("name").alias("n"))
    heads = lambda size: F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - size + 1, F.lit(1))), lambda i: F.substring("low", i, F.lit(size)))
    grams = F.array_distinct(F.flatten(F.array(*(heads(size) for size in range(shortest, max(shortest, HEAD) + 1)))))
    long = own.where(F.col("n") >= shortest)
    outer = long.select("label", F.col("name").alias("x"), F.col("low").alias("x_"), F.explode(grams).alias("gram"))
    inner = long.select("label", F.col("name").alias("y"), F.col("low").alias("y_"), F.left("low", F.lit(max(shortest, HEAD))).alias("gram"))
    contained = outer.join(inner, ["label", "gram"]).where(F.col("x_").contains(F.col("y_")) & (F.col("x") != F.col("y")))
    contained = contained.select("label", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    out = contained if distance is None else contained.unionByName(_near(own, distance))
    return (out.unionByName(_alike(entities, likeness)) if "embedding" in entities.columns else out).distinct()


def _near(own: DataFrame, distance: int) -> DataFrame:
    """Pairs within fewer edits than the distance, of own (label, name, low, n)."""
    k = distance - 1
    start = lambda n, i: F.floor(n * i / (k + 1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.substring("low", start(F.col("n"), i) + 1, start(F.col("n"), i + 1) - start(F.col("n"), i)))
    first = own.where(F.col("n") > distance).select("label", F.col("name").alias("a"), F.col("low").alias("a_"), "n", F.posexplode(pieces).alias("i", "piece"))
    probe = own.select("label", F.col("name").alias("b"), F.col("low").alias("b_"), F.col("n").alias("m"), F.explode(F.sequence(F.greatest(F.col("n") - k, F.lit(distance + 1)), F.greatest(F.col("n") + k, F.lit(distance + 1)))).alias("n"))
    probe = probe.select("*", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("i")).select("*", F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("shift"))
    at, width = start(F.col("n"), F.col("i")) + F.col("shift"), start(F.col("n"), F.col("i") + 1) - start(F.col("n"), F.col("i"))
    probe = probe.where((at >= 0) & (at + width <= F.col("m"))).select("label", "b", "b_", "n", "i", F.substring("b_", at + 1, width).alias("piece")).distinct()
    near = first.join(probe, ["label", "n", "i", "piece"]).where("a < b").select("label", "a", "a_", "b", "b_").distinct()
    return near.where(F.levenshtein("a_", "b_", k).between(0, k)).select("label", "a", "b")


def _alike(entities: DataFrame, likeness: float) -> DataFrame:
    from tessera.operators import vector_index

    own = entities.where("embedding IS NOT NULL AND label IS NOT NULL AND name IS NOT NULL").select("label", "name", "embedding", F.xxhash64("label", "name").alias("id"))
    name = lambda i, c: own.select(F.col("id").alias(i), F.col("name").alias(c))
    found = vector_index.pairs(vector_index.build(own), likeness, "label").join(name("id", "a"), "id").join(name("neighbour", "b"), "neighbour")
    return found.select("label", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def duplicate_page(groups: DataFrame, degrees: DataFrame, limit: int = 100) -> DataFrame:
    """The first groups (label, head, members) by the degree of their head (node_id, degree), then the length of its name, then the name."""
    d = degrees.select(F.col("node_id").alias("head"), "degree")
    return groups.join(d, "head", "left").orderBy(F.desc(F.coalesce("degree", F.lit(0))), F.desc(F.length("head")), "head", "label").limit(limit)


def duplicate_groups(pairs: DataFrame) -> DataFrame:
    """label, head and members (sorted, head included) for each first name, without groups that a larger one contains.

    Groups are only compared if they share a member.
    """
    first = pairs.groupBy("label", "a").agg(F.collect_set("b").alias("others"))
    groups = first.select("label", F.col("a").alias("head"), F.array_sort(F.array_union(F.array("a"), "others")).alias("members"))
    own = groups.select("label", "head", "members", F.explode("members").alias("member"))
    larger = groups.select("label", F.col("head").alias("head_"), F.col("members").alias("members_"), F.explode("members").alias("member"))
    contains = (F.size("members_") > F.size("members")) & (F.size(F.array_except("members", "members_")) == 0)
    inside = own.join(larger, ["label", "member"]).where(contains).select("label", "head").distinct()
    return groups.join(inside, ["label", "head"], "left_anti")


def closed(mapping: DataFrame) -> DataFrame:
    """mapping (old, kept) with each chain followed to its end, so that no kept node is itself an old one.

    An old node with several kept ones goes to the smallest; rows without a change, or with a null, go. Each round doubles the steps, so
    chains of n rows end after about log2(n) rounds; a circle, which has no end, is refused.
    """
    own = materialize(mapping.where("old != kept").groupBy("old").agg(F.min("kept").alias("kept")), "merged")
    rounds = own.count().bit_length() + 1
    for _ in range(rounds):
        further = own.select(F.col("old").alias("kept"), F.col("kept").alias("end_"))
        if own.join(further, "kept", "left_semi").isEmpty():
            return own
        own = materialize(own.join(further, "kept", "left").select("old", F.coalesce("end_", "kept").alias("kept")), "merged")
    raise ValueError("nodes are merged in a circle")


def merge_nodes(nodes: DataFrame, rels: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mapping: old, kept. The old nodes go; their edges move to the kept ones, without loops that this makes, equal edges once. A kept node
    that is merged too is followed to the one that stays."""
    mapping = closed(mapping)
    left = nodes.join(mapping.select(F.col("old").alias("node_id")), "node_id", "left_anti")
    a = mapping.select(F.col("old").alias("src"), F.col("kept").alias("src_"))
    b = mapping.select(F.col("old").alias("dst"), F.col("kept").alias("dst_"))
    moved = rels.join(a, "src", "left").join(b, "dst", "left").select(
        "type", F.coalesce("src_", "src").alias("src"), F.coalesce("dst_", "dst").alias("dst"), ((F.col("src") == F.col("dst"))).alias("loop")
    )
    return left, moved.where("src != dst OR loop").select("type", "src", "dst").distinct()


def delete_documents(mentions: DataFrame, files: DataFrame) -> DataFrame:
    """Entities (entity) that only deleted documents (file) mention, which go with them."""
    marked = mentions.select("entity", "file").distinct().join(files.select("file", F.lit(True).alias("gone_")).distinct(), "file", "left")
    return marked.groupBy("entity").agg(F.bool_and(F.coalesce("gone_", F.lit(False))).alias("all_")).where("all_").select("entity")


def entities_of(mentions: DataFrame, files: DataFrame, shared: bool = False) -> DataFrame:
    """Entities that files mention; without those that others mention too, unless shared ones are meant as well."""
    return mentions.join(files, "file", "left_semi").select("entity").distinct() if shared else delete_documents(mentions, files)


def detach(nodes: DataFrame, rels: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without these nodes (node_id) and all edges at them."""
    own = ids.select("node_id").distinct()
    kept = rels.join(own, rels["src"] == own["node_id"], "left_anti").join(own, F.col("dst") == own["node_id"], "left_anti")
    return nodes.join(own, "node_id", "left_anti"), kept


def cascade(communities: DataFrame, members: DataFrame) -> DataFrame:
    """Communities (id, level, parent) that stay: level 0 with a member (id), others with a child that stays, level by level."""
    alive = communities.where("level = 0").join(members.select("id").distinct(), "id", "left_semi")
    out, top = alive, communities.agg(F.max("level")).head()[0] or 0
    for level in range(1, top + 1):
        alive = communities.where(F.col("level") == level).join(alive.select(F.col("parent").alias("id")).distinct(), "id", "left_semi")
        out = out.unionByName(alive)
    return out


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n_ = 1").drop("n_")
