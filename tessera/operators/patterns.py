"""Patterns over a stored graph: labelled nodes, and typed, directed edges of one or several steps, as joins of its tables.

A pattern is checked against the triplets (label, type, label) that the graph has. It is matched from the rarest label on, each time
along the edge of the rarest triplet that touches what is bound already; whether a join is broadcast or shuffled is left to Spark.
Edges equal in type and ends are one, and no match takes an edge twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sinks_shared import materialize

#: Parts that the larger side of an expansion is dealt into, so that a node that all are at is no one task's;
#: rows told by a task, and tasks at most.
SPREAD, PART_ROWS, MOST_PARTS = 64, 1_000_000, 2000


@dataclass(frozen=True)
class Node:
    """A node by name; where: SQL over node_id and caption."""

    name: str
    label: str | None = None
    where: str | None = None


@dataclass(frozen=True)
class Edge:
    """From least to most steps of one type from a named node to another."""

    start: str
    type: str
    end: str
    least: int = 1
    most: int = 1


@dataclass(frozen=True)
class Pattern:
    nodes: tuple[Node, ...]
    edges: tuple[Edge, ...]

    def node(self, name: str) -> Node:
        return next(n for n in self.nodes if n.name == name)


def triplets(nodes: DataFrame, rels: DataFrame) -> dict[tuple[str, str, str], int]:
    """How many distinct edges lead from a label by a type to a label: a row a triplet, so few."""
    of = lambda end, name: nodes.select(F.col("node_id").alias(end), F.col("label").alias(name))
    own = rels.select("type", "src", "dst").distinct().join(of("src", "a"), "src").join(of("dst", "b"), "dst")
    return {(r.a, r.type, r.b): r.n for r in own.groupBy("a", "type", "b").agg(F.count("*").alias("n")).collect()}


def refusals(pattern: Pattern, schema: dict[tuple[str, str, str], int], labels: set[str] | None = None) -> list[str]:
    """Why a pattern cannot be asked of a graph with such triplets; nothing if it can. labels: of a graph of which only some triplets are given."""
    labels, types = {x for a, _, b in schema for x in (a, b)} if labels is None else labels, {t for _, t, _ in schema}
    names = {n.name for n in pattern.nodes}
    out = [f"unknown label {n.label}" for n in pattern.nodes if n.label and n.label not in labels]
    out += [f"unknown type {e.type}" for e in pattern.edges if e.type not in types]
    out += [f"unknown node {x}" for e in pattern.edges for x in (e.start, e.end) if x not in names]
    out += [f"steps of {e.type} from {e.least} to {e.most}" for e in pattern.edges if not 1 <= e.least <= e.most]
    if out:
        return out
    for e in pattern.edges:
        a, b = pattern.node(e.start).label, pattern.node(e.end).label
        if e.most == 1 and not any(t == e.type and a in (None, x) and b in (None, y) for x, t, y in schema):
            out.append(f"no {e.type} from {a} to {b}")
    reached, todo = set(), [pattern.nodes[0].name]
    while todo:
        reached.add(at := todo.pop())
        todo += [y for e in pattern.edges for x, y in ((e.start, e.end), (e.end, e.start)) if x == at and y not in reached]
    return out + [f"{n.name} hangs on nothing" for n in pattern.nodes if n.name not in reached]


def _fitting(nodes: DataFrame, node: Node) -> DataFrame:
    own = nodes.where(F.col("label") == node.label) if node.label else nodes
    return own.where(node.where) if node.where else own


def _stepped(rows: DataFrame, rels: DataFrame, bound: str, new: str, edge: Edge, forward: bool) -> DataFrame:
    """rows with a column more: the nodes that so many steps from a bound one lead to; used_ grows by the edges taken."""
    here, there = ("src", "dst") if forward else ("dst", "src")
    own = rels.where(F.col("type") == edge.type).select(F.col(here).alias("here_"), F.col(there).alias("there_"), F.concat_ws("\x1f", "type", "src", "dst").alias("edge_"))
    at, out = rows.withColumn("at_", F.col(bound)), None
    for step in range(1, edge.most + 1):
        near = at.join(own, at["at_"] == own["here_"]).where(~F.array_contains("used_", F.col("edge_")))
        at = near.withColumn("used_", F.array_append("used_", F.col("edge_"))).withColumn("at_", F.col("there_")).drop("here_", "there_", "edge_")
        if step >= edge.least:
            found = at.withColumnRenamed("at_", new)
            out = found if out is None else out.unionByName(found)
    return out


def _checked(nodes: DataFrame, rels: DataFrame, pattern: Pattern, schema: dict[tuple[str, str, str], int] | None = None) -> tuple[dict[tuple[str, str, str], int], DataFrame]:
    """The triplets of a pattern's types and the distinct edges of these; other edges are not read. Refuses what cannot be asked."""
    labels = None
    rels = rels.where(F.col("type").isin(sorted({e.type for e in pattern.edges})))
    if schema is None:
        schema = triplets(nodes, rels)
        labels = {r.label for r in nodes.select("label").distinct().collect()}  # a row a label
    if wrong := refusals(pattern, schema, labels):
        raise ValueError("; ".join(wrong))
    return schema, rels.select("type", "src", "dst").distinct()


def match(nodes: DataFrame, rels: DataFrame, pattern: Pattern, schema: dict[tuple[str, str, str], int] | None = None) -> DataFrame:
    """A row for each match: the node_id of each named node. nodes: node_id, label, caption. rels: type, src, dst."""
    schema, edges = _checked(nodes, rels, pattern, schema)

    def cost(e: Edge) -> tuple[int, int]:
        a, b = pattern.node(e.start).label, pattern.node(e.end).label
        return e.most, sum(n for (x, t, y), n in schema.items() if t == e.type and (e.most > 1 or a in (None, x) and b in (None, y)))

    # Labels by the number of edges at them; a condition makes a node likelier rare.
    at = lambda n: (n.where is None, sum(c for (x, _, y), c in schema.items() if n.label in (None, x, y)))
    first = min(pattern.nodes, key=at)
    rows = _fitting(nodes, first).select(F.col("node_id").alias(first.name), F.array().cast("array<string>").alias("used_"))
    bound, left = {first.name}, list(pattern.edges)
    while left:
        e = min((e for e in left if e.start in bound or e.end in bound), key=cost)
        left.remove(e)
        forward = e.start in bound
        here, there = (e.start, e.end) if forward else (e.end, e.start)
        if there in bound:
            rows = _stepped(rows, edges, here, "again_", e, forward).where(F.col("again_") == F.col(there)).drop("again_")
            continue
        rows = _stepped(rows, edges, here, there, e, forward)
        end = pattern.node(there)
        if end.label or end.where:
            rows = rows.join(_fitting(nodes, end).select(F.col("node_id").alias(there)), there, "left_semi")
        bound.add(there)
    return rows.select(*(n.name for n in pattern.nodes))


def answer(found: DataFrame, most: int = 3) -> DataFrame:
    """The first distinct rows of a match, as many as a model is told."""
    return found.distinct().orderBy(*found.columns).limit(most)


def count_by(found: DataFrame, *names: str) -> DataFrame:
    """How many matches each combination of some nodes has."""
    return found.groupBy(*names).agg(F.count("*").alias("n"))


def _classes(ends: DataFrame) -> DataFrame:
    """name and class (one of its members) of each node of ends (name, at): nodes at the same neighbours are one class.

    Neighbours are told apart by their number and two sums of 64-bit hashes, so no list of them is built.
    """
    sums = [F.sum(F.xxhash64("at", F.lit(seed)).cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)]
    own = ends.groupBy("name").agg(F.count("*").alias("n"), *sums)
    first = own.groupBy("n", "h1", "h2").agg(F.min("name").alias("class"))
    return own.join(first, ["n", "h1", "h2"]).select("name", "class")


def meeting_counts(nodes: DataFrame, rels: DataFrame, pattern: Pattern) -> DataFrame:
    """count_by the two ends of a pattern of three nodes, of which the middle one is where two edges of one step meet, both towards it or
    both from it; a row for each two ends with a match.

    Nodes with the same neighbours count alike, so matches are counted once for two classes of nodes and then told for their members:
    work grows with the rows given, which are not shuffled again.
    """
    one, two = pattern.edges
    (middle,) = {one.start, one.end} & {two.start, two.end}
    into = one.end == middle
    if one.most != 1 or two.most != 1 or len(pattern.nodes) != 3 or (two.end == middle) != into:
        raise ValueError("two edges of one step that meet in the third node")
    _, edges = _checked(nodes, rels, pattern)
    hub = pattern.node(middle)

    def ends(e: Edge) -> DataFrame:
        name, at = ("src", "dst") if into else ("dst", "src")
        own = edges.where(F.col("type") == e.type).select(F.col(name).alias("name"), F.col(at).alias("at"))
        for column, node in (("name", pattern.node(e.start if into else e.end)), ("at", hub)):
            if node.label or node.where:
                own = own.join(_fitting(nodes, node).select(F.col("node_id").alias(column)), column, "left_semi")
        return materialize(own, "ends")

    told = []
    for e, x in ((one, "a"), (two, "b")):
        own = ends(e)
        classes = materialize(_classes(own), "classes")
        met = own.join(classes.where("name = class").select("name"), "name", "left_semi").select(F.col("name").alias(f"class_{x}"), "at")
        told.append((classes.select(F.col("name").alias(x), F.col("class").alias(f"class_{x}")), met))
    (a, at_a), (b, at_b) = told
    counts = at_a.join(at_b, "at").groupBy("class_a", "class_b").agg(F.count("*").alias("n"))
    counts = materialize(counts, "class-counts")
    size = lambda df, x: df.groupBy(f"class_{x}").agg(F.count("*").alias(f"m_{x}"))
    told_rows = counts.join(size(a, "a"), "class_a").join(size(b, "b"), "class_b").agg(F.sum(F.col("m_a") * F.col("m_b"))).head()[0] or 0
    parts = int(min(MOST_PARTS, max(1, told_rows // PART_ROWS)))  # by the rows told, which Spark does not foresee: its own guess is by those read
    large, small, key = (a, b, "class_b") if a.count() >= b.count() else (b, a, "class_a")
    large = large.withColumn("part_", F.pmod(F.xxhash64(large.columns[0]), F.lit(SPREAD))).join(counts, large.columns[1]).repartition(parts, key, "part_")
    small = small.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("part_")).repartition(parts, key, "part_")
    rows = large.join(small, [key, "part_"])
    if one.type == two.type:
        rows = rows.where("a != b")  # one node's edge to a middle node would be taken twice
    ends_of = [e.start if into else e.end for e in (one, two)]
    return rows.select(F.col("a").alias(ends_of[0]), F.col("b").alias(ends_of[1]), "n")


def first_answers(nodes: DataFrame, rels: DataFrame, pattern: Pattern, most: int = 3, batch: int = 64) -> DataFrame:
    """answer of a match, of which only the first nodes' part is built: rows are told by the first node, so those of its smallest ids
    come first. Ids are taken by batches, each eight times the last, until these have so many rows or are all."""
    node = pattern.nodes[0]
    schema, edges = _checked(nodes, rels, pattern)
    e = next(e for e in pattern.edges if node.name in (e.start, e.end))
    ends = edges.where(F.col("type") == e.type).select(F.col("src" if e.start == node.name else "dst").alias("node_id"))
    ids = materialize(_fitting(nodes, node).join(ends, "node_id", "left_semi").select("node_id", "label").distinct(), "first-nodes")
    n = ids.count()
    while True:
        own = ids.orderBy("node_id").limit(batch)
        last = own.agg(F.max("node_id")).head()[0]
        within = f"({node.where}) AND node_id <= '{last}'" if node.where else f"node_id <= '{last}'"
        part = Pattern((Node(node.name, node.label, within), *pattern.nodes[1:]), pattern.edges)
        found = answer(match(nodes, edges, part, schema), most) if n else answer(match(nodes, edges, pattern, schema), most)
        found = materialize(found, "answer")
        if batch >= n or found.count() >= most:
            return found.orderBy(*found.columns)
        batch *= 8
