"""Communities of a weighted graph: detection, hierarchy, rank and weight."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.adjacency import Blocks, build, merged, pairs, starts, sums
from tessera.sinks_shared import materialize


def projection(rels: DataFrame) -> DataFrame:
    """Undirected edges source < target with the number of parallel ones; loops are no edges."""
    ends = rels.where("src != dst").select(F.least("src", "dst").alias("source"), F.greatest("src", "dst").alias("target"))
    return ends.groupBy("source", "target").agg(F.count("*").alias("weight"))


def _by_node(df: DataFrame) -> DataFrame:
    """A table of nodes, edges or communities as one side of a join: it is dealt by the key, however small a guess of its size.

    Detection joins such tables a hundred times, and each broadcast would pass all its rows through the driver.
    """
    return df.hint("merge")


#: Edges at one node from which it counts as a hub, and hubs that may be broadcast, at most.
HUB, HUBS = 10_000, 100_000


def components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """node, component (the smallest node of it) of undirected edges (source, target).

    The smallest label among neighbours, then the label of that label, until nothing changes. Each round's labels are written to the
    shared folder, and only whether any changed comes to the driver. Hubs, of which there are HUBS at most, hand their labels out by
    broadcast, so no task gets all edges of one; and only labels that are in use and have changed are looked up, which are few by the
    time that many nodes share one.
    """
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    both = materialize(both.union(edges.select("target", "source")).where("a != b").distinct(), "edges")
    first = materialize(both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")), "first-labels")
    labels = first.select(F.col("a").alias("node"), F.least("a", "low").alias("label"))
    total = first.agg(F.sum("n")).head()[0] or 0
    hubs = materialize(first.where(F.col("n") > max(hub, total // HUBS)).select(F.col("a").alias("b")), "hubs")
    some = hubs.limit(1).count() > 0
    usual = both.join(F.broadcast(hubs), "b", "left_anti") if some else both
    while True:
        given = labels.select(F.col("node").alias("b"), F.col("label").alias("l"))
        near = usual.join(given, "b").select("a", "l")
        if some:
            near = near.union(both.join(F.broadcast(given.join(F.broadcast(hubs), "b")), "b").select("a", "l"))
        near = near.groupBy("a").agg(F.min("l").alias("l"))
        lower = materialize(near.join(labels, near["a"] == labels["node"]).select("node", F.col("label").alias("was"), F.least("label", "l").alias("via")), "lower")
        changed = labels.where("node != label").select(F.col("node").alias("via"), F.col("label").alias("next")).join(lower.select("via").distinct(), "via", "left_semi")
        new = materialize(lower.join(changed, "via", "left").select("node", "was", F.least("via", "next").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("was != label").limit(1).count() == 0:
            return labels.withColumnRenamed("label", "component")


def modularity(edges: DataFrame, assigned: DataFrame, community: str = "community") -> float:
    """Of undirected weighted edges under an assignment of nodes: one aggregation by community."""
    c = lambda end: assigned.select(F.col("node").alias(end), F.col(community).alias(f"{end}_c"))
    own = edges.join(_by_node(c("source")), "source").join(_by_node(c("target")), "target")
    inside = F.when(F.col("source_c") == F.col("target_c"), F.col("weight")).otherwise(0)
    ends = own.select(F.explode(F.array(F.struct(F.col("source_c").alias("c"), inside.alias("w"), F.col("weight").alias("d")), F.struct(F.col("target_c").alias("c"), (inside * 0).alias("w"), F.col("weight").alias("d")))).alias("x"))
    sums = ends.groupBy("x.c").agg(F.sum("x.w").alias("w"), F.sum("x.d").alias("d"))
    within, squares, double = sums.agg(F.sum("w"), F.sum(F.col("d") * F.col("d")), F.sum("d")).head()
    return 2.0 * within / double - float(squares) / float(double) ** 2 if double else 0.0


#: A graph, or its edges (source, target, weight).
Edges = DataFrame | Blocks


def _blocks(edges: Edges) -> Blocks:
    return edges if isinstance(edges, Blocks) else build(pairs(edges), 2 * edges.count())


def _held(graph: Blocks, assigned: DataFrame) -> DataFrame:
    """block, node, k and community of each node."""
    return (assigned if {"block", "k"} <= {*assigned.columns} else graph.nodes.join(_by_node(assigned), "node")).select("block", "node", "k", "community")


def _around(graph: Blocks, held: DataFrame, turn: int, total: float) -> DataFrame:
    """What each node sees: volume of its community, inside (weight of its edges to it), low (its smallest neighbour there, or itself) and to.

    to is where it goes: nodes of one half (by a hash of node and turn) go to the neighbouring community with the largest gain. Only one
    half moves at a time, so two neighbours never swap for ever. Gains are those of modularity; the smallest id wins ties.
    """
    volume = held.groupBy("community").agg(F.sum("k").alias("volume"))
    mine = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
    state = held.join(_by_node(volume), "community").select("block", "node", "k", "community", "volume", mine.cast("long").alias("mine"))

    def look(own, near, edges):
        v, u, w = edges
        known, first, of = np.unique(near["community"], return_index=True, return_inverse=True)
        node, at, weight = sums(v, of[u], len(known), w)
        to, filled = known[at], near["volume"][first][at]
        home = to == own["community"][node]
        rest = np.where(home, filled - own["k"][node], filled)
        gain = weight - own["k"][node] * rest / (2.0 * total)
        inside, stay = np.zeros(len(own["node"])), np.zeros(len(own["node"]))
        inside[node[home]], stay[node[home]] = weight[home], gain[home]
        best, goal = best_of(node, np.round(gain, 9))
        who = node[best]
        better = (own["mine"][who] == 1) & (goal > stay[who] + 1e-9)
        next_ = own["community"].copy()
        next_[who[better]] = to[best[better]]
        low, same = own["node"].copy(), own["community"][v] == near["community"][u]
        np.minimum.at(low, v[same], near["node"][u[same]])
        return {c: own[c] for c in ("node", "k", "community", "volume")} | {"inside": inside, "low": low, "to": next_}

    return graph.look(state, ["community", "volume"], look, "block int, node long, k double, community long, volume double, inside double, low long, to long")


def best_of(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each group of neighbouring rows: the first with the largest value, and this."""
    at = starts(group)
    if not len(at):
        return at, value[:0]
    most = np.maximum.reduceat(value, at)
    hit = np.flatnonzero(value == np.repeat(most, np.diff(np.append(at, len(group)))))
    return hit[starts(group[hit])], most


def _move(edges: Edges, assigned: DataFrame, turn: int, total: float) -> DataFrame:
    """One round of moves: node, community."""
    graph = _blocks(edges)
    return _around(graph, _held(graph, assigned), turn, total).select("node", F.col("to").alias("community"))


def _moved(edges: Edges, assigned: DataFrame, total: float, turns: range) -> DataFrame:
    """The best of some rounds of moves, which end early if three in turn bring nothing, with what its nodes see.

    What nodes see before they move also tells the modularity, so each round looks at the edges once, and a last look is at the last round.
    """
    graph = _blocks(edges)
    held, best, quality, idle = _held(graph, assigned), None, 0.0, 0
    for turn in range(turns.start, turns.stop + 1):
        seen = materialize(_around(graph, held, turn, total), "assigned")
        inside, squares, double = seen.agg(F.sum("inside"), F.sum(F.col("k") * F.col("volume")), F.sum("k")).head()
        q = (inside + 2.0 * graph.loops) / double - float(squares) / float(double) ** 2 if double else 0.0
        if best is None:
            best, quality = seen, q
        else:
            best, quality, idle = (seen, q, 0) if q > quality + 1e-12 else (best, quality, idle + 1)
        if idle == 3:
            break
        held = seen.select("block", "node", "k", F.col("to").alias("community"))
    return best


def connected_parts(edges: Edges, assigned: DataFrame) -> DataFrame:
    """assigned (node, community) with each community cut into parts that hang together by its own edges, named by their smallest node.

    Moving single nodes may leave a community in pieces, whose split never lowers modularity. Nodes take the smallest label around them,
    and all nodes of a label the smallest one that any of them sees, until no neighbours of one community differ.
    """
    graph = _blocks(edges)
    seen = assigned if "low" in assigned.columns else materialize(_around(graph, _held(graph, assigned), 0, 1.0), "assigned")
    own = seen.select("block", "node", "k", "community", "inside", "low")
    above = seen.select(F.col("node").alias("low"), F.col("low").alias("label"))
    labels = own.join(_by_node(above), "low").drop("low")

    def look(own, near, edges):
        v, u, _ = edges
        same = own["community"][v] == near["community"][u]
        low = own["label"].copy()
        np.minimum.at(low, v[same], near["label"][u[same]])
        return {c: own[c] for c in ("node", "k", "community", "inside", "label")} | {"low": low}

    while True:
        told = materialize(graph.look(labels, ["community", "label"], look, "block int, node long, k double, community long, inside double, label long, low long"), "labels")
        lower = told.where("low < label").groupBy("label").agg(F.min("low").alias("low"))
        lower = materialize(lower, "lower")
        if not lower.limit(1).count():
            return told.select("block", "node", "k", "inside", F.col("label").alias("community"))
        # Labels that fall may have been handed out just now.
        for _ in range(2):
            further = lower.select(F.col("label").alias("low"), F.col("low").alias("next"))
            lower = lower.join(_by_node(further), "low", "left").select("label", F.coalesce("next", "low").alias("low"))
        labels = told.drop("low").join(_by_node(lower), "label", "left").withColumn("label", F.coalesce("low", "label")).drop("low")


def subdivided(edges: Edges, assigned: DataFrame, total: float, turns: int = 4) -> DataFrame:
    """node, community: a second partition inside the communities of the first, from single nodes merged along well-connected parts.

    In each turn one half of the nodes that are still alone, by a hash, may join a part of the other nodes of their community: if the
    node itself, and the part, have at least as much weight to the rest of the community as chance would give them, and modularity
    rises. Nobody leaves a part, so parts hang together.
    """
    graph = _blocks(edges)
    seen = assigned if "inside" in assigned.columns else materialize(_around(graph, _held(graph, assigned), 0, total), "assigned")
    volume = seen.groupBy("community").agg(F.sum("k").alias("all"))
    chance = lambda k, whole: k * (whole - k) / (2.0 * total)
    fit = (F.col("inside") >= chance(F.col("k"), F.col("all"))).cast("long")
    kept = "block int, node long, k double, community long, all double, fit long, part long"
    # cut: weight of a node's edges to other parts of its community, which is all it has there while it is alone.
    held = seen.join(_by_node(volume), "community").select("block", "node", "k", "community", "all", fit.alias("fit"), F.col("node").alias("part"), F.col("inside").alias("cut"))
    names = held.columns[1:-1]

    def crossing(own, near, edges):
        v, u, w = edges
        out = (own["community"][v] == near["community"][u]) & (own["part"][v] != near["part"][u])
        return {c: own[c] for c in names} | {"cut": np.bincount(v[out], w[out], len(own["node"])).astype(np.float64)}

    def join(own, near, edges):
        v, u, w = edges
        may = (own["moves"][v] == 1) & (near["open"][u] == 1) & (own["community"][v] == near["community"][u])
        known, first, of = np.unique(near["part"], return_index=True, return_inverse=True)
        # A part's volume and whether it is open are the same wherever it is met.
        node, at, weight = sums(v[may], of[u[may]], len(known), w[may])
        gain = np.round(weight - own["k"][node] * near["volume"][first][at] / (2.0 * total), 9)
        node, at, gain = node[gain > 0], at[gain > 0], gain[gain > 0]
        best, _ = best_of(node, gain)
        part = own["part"].copy()
        part[node[best]] = known[at[best]]
        return {c: own[c] for c in names} | {"part": part}

    for turn in range(turns):
        if turn:
            held = materialize(graph.look(held, ["community", "part"], crossing, f"{kept}, cut double"), "cuts")
        elif turns:
            held = materialize(held, "refined-nodes")
        sizes = held.groupBy("part").agg(F.sum("k").alias("volume"), F.count("*").alias("n"), F.first("all").alias("of"), F.sum("cut").alias("cut"))
        moves = (F.pmod(F.xxhash64("part", F.lit(turn)), F.lit(2)) == 0) & (F.col("n") == 1)
        open_ = ~moves & (F.col("cut") >= chance(F.col("volume"), F.col("of")))
        about = sizes.select("part", "volume", moves.cast("long").alias("moves"), open_.cast("long").alias("open"))
        state = held.drop("cut").join(_by_node(about), "part").withColumn("moves", F.col("moves") * F.col("fit")).select("block", *names, "volume", "moves", "open")
        held = graph.look(state, ["community", "part", "volume", "open"], join, kept)
    parts = materialize(held.select("block", "node", "part"), "parts")
    least = parts.groupBy("part").agg(F.min("node").alias("community"))
    return parts.join(_by_node(least), "part").select("block", "node", "community")


def detect(edges: DataFrame, levels: int = 3, rounds: int = 6) -> DataFrame:
    """node and communities: the list of its communities from the finest level to the coarsest, at most so many; levels nest.

    At each level nodes move between communities by modularity. Each community is then subdivided; the well-connected parts are what
    becomes a node of the next level, where moving goes on from the communities that were not subdivided. A part that was put into a
    community for want of a better place can so leave it as a whole. All levels but the last give the parts, the last one the
    communities, cut where they do not hang together. Node ids are long; a community is named by its smallest node. Edges: source,
    target, weight. A level's edges are stored in blocks of nodes, which the rounds look at where they are.
    """
    now = materialize(edges.select("source", "target", F.col("weight").cast("double").alias("weight")), "level-edges")
    n_edges, total = now.agg(F.count("*"), F.sum("weight")).head()
    total, rows = total or 0.0, 2 * n_edges
    graph = build(pairs(now), rows)
    start = graph.nodes.withColumn("community", F.col("node"))
    of, lists = start.select("node", F.col("node").alias("at")), None
    for level in range(levels):
        best = connected_parts(graph, _moved(graph, start, total, range(rounds)))
        # What a cut sets free may find a better place.
        best = materialize(connected_parts(graph, _moved(graph, best, total, range(rounds, rounds + rounds // 2))), "assigned")
        n, n_communities = best.agg(F.count("*"), F.count_distinct("community")).head()
        if lists is not None and n == n_communities:
            break
        last = level == levels - 1 or n_communities == 1
        given = best
        if not last:
            parts = materialize(subdivided(graph, best, total), "subdivided")
            given = parts if parts.where("node != community").limit(1).count() else best
        step = given.select(F.col("node").alias("at"), F.col("community").alias("next"))
        of = materialize(of.join(_by_node(step), "at", "left").select("node", F.coalesce("next", "at").alias("at")), "level")
        here = of.select("node", F.col("at").alias("c"))
        lists = here.select("node", F.array("c").alias("communities")) if lists is None else lists.join(_by_node(here), "node").select("node", F.array_append("communities", F.col("c")).alias("communities"))
        lists = materialize(lists, "lists")
        if last:
            break
        groups = given.select("block", "node", F.col("community").alias("group"))
        n_groups = groups.agg(F.count_distinct("group")).head()[0]
        rows = min(rows, n_groups * n_groups)
        # Loops keep the weight inside a community, which counts in its degree.
        below, graph = graph, build(merged(graph, groups), rows)
        below.drop()
        # The smallest node of a part is the part's name, and its community is its part's.
        start = best.join(_by_node(given.select("node", F.col("community").alias("part"))), "node").groupBy("part").agg(F.min("community").alias("community"))
        start = materialize(start.select(F.col("part").alias("node"), "community"), "assigned")
    graph.drop()
    return lists


def hierarchy(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From node, communities: membership (node, id of level 0) and parents (child, parent), ids being level-community."""
    at = lists.select("node", F.posexplode("communities").alias("level", "c"))
    ids = at.select("node", "level", F.concat_ws("-", F.col("level").cast("string"), F.col("c").cast("string")).alias("id"))
    parent = F.lead("id").over(Window.partitionBy("node").orderBy("level"))
    up = ids.withColumn("parent", parent).where("parent IS NOT NULL").select(F.col("id").alias("child"), "parent").distinct()
    return ids.where("level = 0").select("node", "id"), up


def rank(members: DataFrame, mentions: DataFrame) -> DataFrame:
    """Documents that mention a member of each community. members: community, entity. mentions: entity, file."""
    return members.join(mentions.select("entity", "file").distinct(), "entity").groupBy("community").agg(F.count_distinct("file").alias("community_rank"))


def weight(members: DataFrame, mentions: DataFrame) -> DataFrame:
    """Chunks that mention a member of each community. mentions: entity, chunk_id."""
    return members.join(mentions.select("entity", "chunk_id").distinct(), "entity").groupBy("community").agg(F.count_distinct("chunk_id").alias("weight"))


def large(members: DataFrame, least: int = 2) -> DataFrame:
    """Communities of so many members or more, with their sorted members."""
    return members.groupBy("community").agg(F.array_sort(F.collect_set("entity")).alias("nodes")).where(F.size("nodes") >= least)


def level_id(level: Column, community: Column) -> Column:
    return F.concat_ws("-", level.cast("string"), community.cast("string"))


def cleared(nodes: DataFrame, entities: DataFrame, label: str = "__Community__") -> tuple[DataFrame, DataFrame]:
    """Nodes without those of communities, and entities without the column that names theirs."""
    return nodes.where(F.col("label") != label), entities.drop("communities")


def to_embed(communities: DataFrame) -> DataFrame:
    """Communities that have a summary but no vector."""
    return communities.where("summary IS NOT NULL AND embedding IS NULL").select("community", F.col("summary").alias("text"))
