"""A weighted graph in blocks of nodes, for rounds in which each node looks at what its neighbours know.

A node and its edges are in one block, which is written once, in a bucket of its own. In a round only columns of nodes move: each block
sends what another one's edges lead to, once however many edges lead there, and edges stay where they are. A task holds the edges of one
block, and all those of a node; no table of nodes passes the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sinks_shared import materialize, shared_path

#: Edges of a block (each from both ends), on average, and from which there are as many blocks as cores.
BLOCK_EDGES, FEW_EDGES = 1_500_000, 50_000

#: Gets own (column: array, a value a node), near (column: array, a value a neighbour) and edges (place in own, place in near, weight;
#: sorted by the first), and returns column: array.
Look = Callable[[dict, dict, tuple[np.ndarray, np.ndarray, np.ndarray]], dict]


@dataclass(frozen=True)
class Blocks:
    edges: DataFrame  # block, at (null), nodes, k, loop, v, u, w, near: a row a block
    sends: DataFrame  # block, to, at: places of the nodes that another block's edges lead to
    nodes: DataFrame  # block, node, k: degrees, in which loops count twice
    loops: float  # weight of all loops
    database: str

    def look(self, state: DataFrame, told: list[str], look: Look, schema: str) -> DataFrame:
        """What look returns for each block. state: block and columns of long or double for each node once; told: those that neighbours learn."""
        columns = [c for c in state.columns if c != "block"]
        kinds = {c: np.float64 if t == "double" else np.int64 for c, t in state.dtypes}
        names = [x.split()[0] for x in schema.split(", ")]
        loads = pa.schema([("block", pa.int32()), ("at", pa.int32()), ("load", pa.binary())])

        def send(key, own: pa.Table, sends: pa.Table) -> pa.Table:
            order = np.argsort(own["node"].to_numpy())
            values = [np.ascontiguousarray(own[c].to_numpy()[order]).view(np.int64) for c in columns]
            out = [(key[0].as_py(), -1, np.stack(values).tobytes())]
            values = np.stack([values[columns.index(c)] for c in told])
            for to, at in zip(sends["to"].to_pylist(), sends["at"]):
                out.append((to, key[0].as_py(), values[:, np.frombuffer(at.as_buffer(), np.int32)].tobytes()))
            return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), loads.types)], schema=loads)

        def receive(key, sent: pa.Table, edges: pa.Table) -> pa.Table:
            got = sorted(zip(sent["at"].to_pylist(), sent["load"]), key=lambda x: x[0])
            rows = lambda load, n: np.frombuffer(load.as_buffer(), np.int64).reshape(n, -1)
            own = {c: x.view(kinds[c]) for c, x in zip(columns, rows(got[0][1], len(columns)))}
            parts = [rows(x, len(told)) for _, x in got[1:]]
            near = {c: np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]).view(kinds[c]) for k, c in enumerate(told)}
            of = lambda c, kind: np.frombuffer(edges[c][0].as_buffer(), kind)
            near["node"] = of("near", np.int64)
            found = {"block": None} | look(own, near, (of("v", np.int32), of("u", np.int32), of("w", np.float64)))
            n = len(found[names[-1]])
            return pa.table({c: np.full(n, key[0].as_py(), np.int32) if c == "block" else found[c] for c in names})

        loaded = state.groupBy("block").cogroup(self.sends.groupBy("block")).applyInArrow(send, "block int, at int, load binary")
        stored = self.edges.select("block", "v", "u", "w", "near")
        return loaded.groupBy("block").cogroup(stored.groupBy("block")).applyInArrow(receive, schema)

    def drop(self) -> None:
        """Deletes the stored blocks, once nothing reads them any more."""
        self.edges.sparkSession.sql(f"DROP DATABASE {self.database} CASCADE")


def sums(first: np.ndarray, second: np.ndarray, n_second: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of weights of each pair of numbers, in order; the second are below n_second."""
    key = first.astype(np.int64) * max(n_second, 1) + second
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    total = np.add.reduceat(weights[order], at) if len(at) else weights[:0]
    return key[at] // max(n_second, 1), key[at] % max(n_second, 1), total


def starts(sorted_numbers: np.ndarray) -> np.ndarray:
    """Where each number begins."""
    return np.flatnonzero(np.diff(sorted_numbers, prepend=-1))


def _cut(t: pa.Table) -> pa.Table:
    """A block's rows (block, node, other, to, weight) as one row of arrays, and a row for each block that its edges lead to, with the nodes there."""
    block = t["block"][0].as_py()
    weight, known = t["weight"].to_numpy(), t["other"].is_valid().to_numpy()
    nodes, v = np.unique(t["node"].to_numpy(), return_inverse=True)
    other, to = t["other"].fill_null(0).to_numpy(), t["to"].fill_null(0).to_numpy()
    loop = known & (other == nodes[v])
    loops = np.bincount(v[loop], weight[loop], len(nodes))
    k = np.bincount(v, weight, len(nodes)) + loops
    keep = known & ~loop
    near, first, u = np.unique(other[keep], return_index=True, return_inverse=True)
    where = to[keep][first]
    order = np.argsort(where, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    near, where = near[order], where[order]
    v, u, w = sums(v[keep], place[u], len(near), weight[keep])
    at = starts(where)
    asked = [near[a:b].tobytes() for a, b in zip(at, [*at[1:], len(near)])]
    own = [nodes, k, loops, v.astype(np.int32), u.astype(np.int32), w, near]
    columns = [[block] * (1 + len(at)), [None, *where[at].tolist()], *([x.tobytes()] + [None] * len(at) for x in own), [None, *asked]]
    return pa.Table.from_arrays([pa.array(x, kind) for x, kind in zip(columns, [pa.int32(), pa.int32(), *[pa.binary()] * 8])], names=["block", "to", "nodes", "k", "loop", "v", "u", "w", "near", "asked"])


def _placed(own: pa.Table, asked: pa.Table) -> pa.Table:
    """Of what other blocks ask a block for (block, to, asked): the places of these nodes among its own."""
    nodes = np.frombuffer(own["nodes"][0].as_buffer(), np.int64)
    at = [np.searchsorted(nodes, np.frombuffer(x.as_buffer(), np.int64)).astype(np.int32).tobytes() for x in asked["asked"]]
    return pa.table({"block": asked["block"], "to": asked["to"], "at": pa.array(at, pa.binary())})


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, nodes, k in zip(b["block"].to_pylist(), b["nodes"], b["k"]):
            nodes = np.frombuffer(nodes.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), block, np.int32)), pa.array(nodes), pa.array(np.frombuffer(k.as_buffer(), np.float64))], names=["block", "node", "k"])


def pairs(edges: DataFrame) -> DataFrame:
    """Undirected edges (source, target, weight) from both ends, loops once: node, other, weight."""
    there = edges.select(F.col("source").cast("long").alias("node"), F.col("target").cast("long").alias("other"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    back = there.where("node IS NULL OR other IS NULL OR node != other").select(F.col("other").alias("node"), F.col("node").alias("other"), "weight")
    return there.union(back).where("node IS NOT NULL")


def build(ends: DataFrame, rows: int) -> Blocks:
    """The blocks of about so many rows (node, other, weight), each edge from both its ends and loops once; equal pairs are summed up."""
    spark = ends.sparkSession
    n = max(1, -(-rows // BLOCK_EDGES), min(spark.sparkContext.defaultParallelism, rows // FEW_EDGES))
    # Numbers of blocks of which a hash deals one to each task.
    number = F.col("id").cast("int")
    numbers = [r.k for r in spark.range(64 * n).groupBy(F.pmod(F.hash(number), F.lit(n)).alias("p")).agg(F.min(number).alias("k")).collect()]
    block = lambda node: F.element_at(F.lit(numbers), F.pmod(F.xxhash64(node), F.lit(len(numbers))).cast("int") + 1)
    name = f"tessera_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{shared_path(spark, 'blocks')}'")

    def bucketed(df: DataFrame, table: str) -> DataFrame:
        df.write.bucketBy(n, "block").option("compression", "zstd").saveAsTable(f"{name}.{table}")
        return spark.table(f"{name}.{table}")

    to: Column = F.when(F.col("other").isNotNull(), block("other"))
    dealt = ends.select(block("node").alias("block"), "node", "other", to.alias("to"), "weight").repartition(n, "block")
    schema = "block int, to int, nodes binary, k binary, loop binary, v binary, u binary, w binary, near binary, asked binary"
    rows_of = bucketed(dealt.groupBy("block").applyInArrow(_cut, schema), "edges")
    edges = rows_of.where("to IS NULL")
    asked = rows_of.where("to IS NOT NULL").select(F.col("to").alias("block"), F.col("block").alias("to"), "asked")
    sends = bucketed(edges.select("block", "nodes").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_placed, "block int, to int, at binary"), "sends")
    nodes = materialize(edges.select("block", "nodes", "k").mapInArrow(_unpacked, "block int, node long, k double"), "nodes")

    def looped(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(np.frombuffer(x.as_buffer(), np.float64).sum()) for x in b["loop"]])], names=["loop"])

    loops = edges.select("loop").mapInArrow(looped, "loop double").agg(F.sum("loop")).head()[0] or 0.0
    return Blocks(edges, sends, nodes, loops, name)


def merged(graph: Blocks, given: DataFrame) -> DataFrame:
    """node, other, weight of the graph whose nodes are groups of nodes (given: block, node, group), for build; what is inside a group is its loop."""

    def look(own, near, edges):
        v, u, w = edges
        a, of_own = np.unique(own["group"], return_inverse=True)
        b, of_near = np.unique(near["group"], return_inverse=True)
        x, y, w = sums(of_own[v], of_near[u], len(b), w)
        node, other = a[x], b[y]
        # An edge inside a group is met from both its ends.
        return {"node": node, "other": other, "weight": np.where(node == other, w / 2, w)}

    across = graph.look(given.select("block", "node", "group"), ["group"], look, "block int, node long, other long, weight double")
    own = graph.edges.select("block", "nodes", "loop").mapInArrow(_loops, "node long, weight double").where("weight != 0")
    own = own.join(given.select("node", "group").hint("merge"), "node").select(F.col("group").alias("node"), F.col("group").alias("other"), "weight")
    return across.select("node", "other", "weight").union(own)


def _loops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for nodes, loop in zip(b["nodes"], b["loop"]):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(nodes.as_buffer(), np.int64)), pa.array(np.frombuffer(loop.as_buffer(), np.float64))], names=["node", "weight"])
