"""An inverted file of vectors: cells around centroids, so that a search reads a few cells and not the table.

Centroids are fitted on a bounded sample (SAMPLE rows at most, by a hash of the id), every row is assigned to its nearest, and the rows
are stored as one partition of files a cell. A cell also keeps its radius, the largest angle between its centroid and a member. From the
sample's true neighbours ``build`` finds how many cells must be opened to reach a wanted recall; that many are opened by default.

Searches and joins may be exact as well: after the first cells the k-th best score is known, and by the triangle inequality of angles no
member of a cell can be nearer to a vector than the angle to its centroid less the radius. Only cells that this does not rule out are
opened besides.

Null vectors and those without length belong to no cell and are not found.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.retrieval import vector_top
from tessera.sinks_shared import materialize, shared_path

#: Rows that centroids are fitted on, and cells, at most.
SAMPLE, CELLS = 20_000, 4096
#: Sampled rows whose true neighbours are looked up to choose how many cells a search opens.
ASKED = 200
#: Rows of a part of a cell, and of one side of a block, at most: cells share a block, so that vectors are copied once a block.
BLOCK, SIDE = 2000, 32_768
#: Scores that a task holds at once, and nearest cells that give a vector its first bound.
HELD, FIRST = 1 << 22, 4
#: Candidates of a row from which they are scored row by row.
MANY = 256
#: Scores are rounded to four places, so a bound may be short by this.
SLACK = 1e-4


def _units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as vectors of length 1."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1) if len(column) else np.zeros(0)
    return values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-300) if len(values) else values


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _centroids(sample: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means; a cell that loses all its rows takes one of those farthest from their centroid."""
    random = np.random.default_rng(seed)
    centroids = sample[random.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        likeness = sample @ centroids.T
        own = likeness.argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = sample[np.argsort(likeness.max(1), kind="stable")[: len(empty)]]
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return centroids


@dataclass(frozen=True)
class VectorIndex:
    """rows: id, embedding, further columns, cell (a partition of the files) and part (of a large cell)."""

    rows: DataFrame | None
    centroids: np.ndarray
    radius: np.ndarray
    parts: np.ndarray
    probes: int
    sizes: np.ndarray

    def __reduce__(self):
        """Tasks get the cells; the table stays with the driver."""
        return VectorIndex, (None, self.centroids, self.radius, self.parts, self.probes, self.sizes)

    @property
    def dimensions(self) -> int:
        return self.centroids.shape[1]

    def reach(self, vectors: np.ndarray) -> np.ndarray:
        """For each vector and cell the largest scaled similarity that a member can have."""
        return (1 + np.cos(np.maximum(_angles(vectors, self.centroids) - self.radius, 0))) / 2

    def nearest(self, vectors: np.ndarray, probes: int | None = None) -> np.ndarray:
        """For each vector the cells that a search opens, nearest centroid first."""
        return np.argsort(-(vectors @ self.centroids.T), axis=1, kind="stable")[:, : probes or self.probes]


def build(rows: DataFrame, path: str | None = None, cells: int | None = None, recall: float = 0.95, k: int = 10, rounds: int = 10, seed: int = 5) -> VectorIndex:
    """An index of rows (id long, embedding, ...), kept at a path; recall is that of the k nearest, reached on the sample."""
    spark = rows.sparkSession
    path = path or shared_path(spark, "vector-index")
    real = rows.where("embedding IS NOT NULL AND exists(embedding, x -> x != 0)")
    n = real.count()
    if not n:
        raise ValueError("no vector to index")
    share = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    sampled = real.where(share < min(1.0, SAMPLE / n)).select("id", "embedding").limit(2 * SAMPLE).toArrow()  # about SAMPLE rows
    sample = _units(sampled.column("embedding"))
    cells = max(1, min(cells or math.isqrt(n), CELLS, len(sample)))
    centroids = _centroids(sample, cells, rounds, seed) if len(sample) else _units(real.limit(1).toArrow().column("embedding"))
    kinds, names = rows.schema, rows.columns

    def assigned(batches):
        for b in batches:
            likeness = _units(b.column("embedding")) @ centroids.T if b.num_rows else np.zeros((0, 1))
            cell = likeness.argmax(1).astype(np.int32) if b.num_rows else np.zeros(0, np.int32)
            angle = np.arccos(np.clip(likeness.max(1), -1, 1)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle)], [*names, "cell", "angle"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "cell int, angle double"])
    placed = real.mapInArrow(assigned, schema)
    placed.write.parquet(f"{path}/assigned")
    placed = spark.read.schema(placed.schema).parquet(f"{path}/assigned")
    radius, parts, sizes = np.zeros(len(centroids)), np.ones(len(centroids), np.int64), np.zeros(len(centroids), np.int64)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect():  # a row a cell
        radius[r.cell], parts[r.cell], sizes[r.cell] = r.r + 1e-9, -(-r.n // BLOCK), r.n
    part = F.pmod(F.xxhash64("id"), F.get(F.array(*map(F.lit, parts.tolist())), F.col("cell"))).cast("int")
    placed.drop("angle").withColumn("part", part).repartition("cell", "part").write.partitionBy("cell").parquet(f"{path}/cells")
    about = {"centroids": centroids.tolist(), "radius": radius.tolist(), "parts": parts.tolist(), "sizes": sizes.tolist(), "probes": len(centroids)}
    index = _opened(spark, path, about)
    about["probes"] = _probes(index, sampled.slice(0, ASKED), recall, k)
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.parquet(f"{path}/about")
    return _opened(spark, path, about)


def _opened(spark: SparkSession, path: str, about: dict) -> VectorIndex:
    own = spark.read.parquet(f"{path}/cells")
    return VectorIndex(own, np.array(about["centroids"]), np.array(about["radius"]), np.array(about["parts"]), about["probes"], np.array(about["sizes"]))


def load(spark: SparkSession, path: str) -> VectorIndex:
    return _opened(spark, path, json.loads(spark.read.parquet(f"{path}/about").head()[0]))


def refreshed(rows: DataFrame, path: str, dimensions: int) -> tuple[VectorIndex, str]:
    """The index at a path if its vectors have so many dimensions, else a new one beside it; gives its path, too."""
    spark = rows.sparkSession
    try:
        index = load(spark, path)
        if index.dimensions == dimensions:
            return index, path
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    fresh = shared_path(spark, "vector-index")
    return build(rows.where(F.size("embedding") == dimensions), fresh), fresh


def _probes(index: VectorIndex, asked: pa.Table, recall: float, k: int) -> int:
    """The fewest cells that bring so large a share of the sampled rows' k nearest, by their true neighbours among all rows."""
    ids, vectors = asked.column("id").to_numpy(), _units(asked.column("embedding"))
    if not len(ids):
        return len(index.centroids)

    def best(batches):
        out = []
        for b in batches:
            if b.num_rows:
                score = np.round((1 + vectors @ _units(b.column("embedding")).T) / 2, 4)
                own = b.column("id").to_numpy()
                score[ids[:, None] == own[None, :]] = -1
                for row, at in enumerate(np.argsort(-score, axis=1, kind="stable")[:, :k]):
                    out += zip([row] * len(at), own[at].tolist(), b.column("cell").to_numpy()[at].tolist(), score[row, at].tolist())
        row, own, cell, score = zip(*out) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(own, pa.int64()), pa.array(cell, pa.int32()), pa.array(score, pa.float64())], ["row", "id", "cell", "score"])

    found = index.rows.select("id", "embedding", "cell").mapInArrow(best, "row int, id long, cell int, score double").where("score >= 0")
    w = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    true = found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("row", "cell").collect()  # ASKED * k rows at most
    order = index.nearest(vectors, len(index.centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    depth = np.sort([place[r.row, r.cell] for r in true])
    return int(depth[min(len(depth) - 1, math.ceil(recall * len(depth)))]) + 1 if len(depth) else 1


def search(index: VectorIndex, query: list[float], k: int, least: float = 0.0, exact: bool = False, probes: int | None = None) -> DataFrame:
    """The k rows most like a vector of those in the cells opened, or of all rows; score is the scaled similarity. Files of other cells are not read."""
    vector = np.array(query, np.float64)[None, :]
    vector = vector / max(np.linalg.norm(vector), 1e-300)
    opened = index.nearest(vector, probes)[0].tolist()
    if exact:
        kth = vector_top(index.rows.where(F.col("cell").isin(opened)), query, k, least).agg(F.count("*"), F.min("score")).head()
        needed = max(least, kth[1] if kth[0] == k else 0.0)
        opened = sorted({*opened, *np.flatnonzero(index.reach(vector)[0] >= needed - SLACK).tolist()})
    return vector_top(index.rows.where(F.col("cell").isin(opened)), query, k, least).drop("cell", "part")


def _order(centroids: np.ndarray) -> list[int]:
    """Cells in an order in which neighbours are near: halves by the direction of most spread, and so on."""
    todo, out = [np.arange(len(centroids))], []
    while todo:
        own = todo.pop()
        if len(own) < 3:
            out += own.tolist()
            continue
        spread = centroids[own] - centroids[own].mean(0)
        along = spread @ np.linalg.eigh(spread.T @ spread)[1][:, -1]
        own = own[np.argsort(along, kind="stable")]
        todo += [own[len(own) // 2 :], own[: len(own) // 2]]
    return out


def _blocks(index: VectorIndex) -> tuple[int, list[list[int]]]:
    """How many blocks there are, and the block of each part of each cell. A block has at most about SIDE rows, and a sixteenth of all, so that all tasks have some."""
    side, block, held, of = min(SIDE, max(BLOCK, int(index.sizes.sum()) // 16)), 0, 0, [[] for _ in index.parts]
    for cell in _order(index.centroids):
        each = int(index.sizes[cell]) // int(index.parts[cell])
        for _ in range(int(index.parts[cell])):
            if held and held + each > side:
                block, held = block + 1, 0
            of[cell].append(block)
            held += each
    return block + 1, of


def _steps(rows: int, columns: int):
    """Slices of rows of which a task holds all scores at once."""
    step = max(1, HELD // max(1, columns))
    return [slice(at, min(at + step, rows)) for at in range(0, rows, step)]


def _meet(index: VectorIndex, asks: DataFrame, able, give, schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    """asks (id, embedding, bar) and the members of blocks of cells, at most SIDE of each side a call of give, which gets both as tables.

    able(vectors, bar) says which cells a vector asks for; it goes once to each block that has one of them.
    """
    n, of = _blocks(index)
    member = np.zeros((len(of), n), np.float32)
    for cell, blocks in enumerate(of):
        member[cell, blocks] = 1
    kinds, names = dict(asks.dtypes), ["id", "embedding", "bar", *more]

    def sent(batches):
        for b in batches:
            for own in (b.slice(at, 512) for at in range(0, b.num_rows, 512)):
                row, block = np.nonzero(able(_units(own.column("embedding")), own.column("bar").to_numpy()).astype(np.float32) @ member > 0)
                yield pa.RecordBatch.from_arrays([*(own.column(c).take(pa.array(row)) for c in names), pa.array(block, pa.int32())], [*names, "block"])

    left = asks.select(*names).mapInArrow(sent, ", ".join(f"{c} {kinds[c]}" for c in names) + ", block int")
    parts = max(1, -(-int(index.sizes.sum()) // SIDE), n if n > 1 else 1)  # of the side that asks: no more than its rows
    left = left.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("side", F.lit(0)).withColumn("cell", F.lit(-1))
    place = F.get(F.get(F.array(*(F.array(*map(F.lit, b)) for b in of)), F.col("cell")), F.col("part"))
    right = index.rows.select("id", "embedding", F.lit(0.0).alias("bar"), *more, place.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("i"), F.lit(1).alias("side"), "cell")

    def both(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        return give(t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1)))

    return left.unionByName(right).groupBy("block", "i").applyInArrow(both, schema)


def _rounded(likeness: np.ndarray) -> np.ndarray:
    return np.round((1 + likeness) / 2, 4)


def _near(a: pa.Table, b: pa.Table, least: np.ndarray):
    """Pieces of the pairs of two tables: rows of each side whose score may be what a row of the first asks for, by single precision, and their
    exact scores. A piece has HELD pairs at most."""
    mine, others = _units(a.column("embedding")), _units(b.column("embedding"))
    rough, all_ = mine.astype(np.float32), others.astype(np.float32).T
    floor = (2 * least - 1 - 2 * SLACK - 1e-5).astype(np.float32)[:, None]
    for s in _steps(len(mine), len(others)):
        x, y = np.nonzero(rough[s] @ all_ >= floor[s])
        for at in range(0, len(x), HELD // 32):
            i, j = x[at : at + HELD // 32] + s.start, y[at : at + HELD // 32]
            yield i, j, _rounded(np.einsum("ij,ij->i", mine[i], others[j]))


def _best(k: int, least: float, allowed=None):
    """give of _meet: the k best of each asking row in a block. allowed(vectors, bar, cells): which members may be given."""

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out = {"id": [np.zeros(0, np.int64)], "neighbour": [np.zeros(0, np.int64)], "score": [np.zeros(0)]}
        if a.num_rows and b.num_rows:
            b = b.take(pa.array(np.argsort(b.column("id").to_numpy(), kind="stable")))  # of equal scores the first is the smallest id
            ids, others, cells = a.column("id").to_numpy(), b.column("id").to_numpy(), b.column("cell").to_numpy()
            mine, theirs, bar = _units(a.column("embedding")), _units(b.column("embedding")), a.column("bar").to_numpy()
            rough, all_ = mine.astype(np.float32), theirs.astype(np.float32).T
            for s in _steps(len(mine), len(theirs)):
                floor = np.maximum(bar[s], least)
                may = rough[s] @ all_ >= (2 * floor - 1 - 2 * SLACK - 1e-5).astype(np.float32)[:, None]
                if allowed is not None:
                    may &= allowed(mine[s], bar[s])[:, cells]
                many = may.sum(1) > MANY
                for row in np.flatnonzero(many):  # a bound that rules little out, as at first and among copies
                    own = np.flatnonzero(may[row])
                    score = _rounded(theirs[own] @ mine[s.start + row])
                    score[others[own] == ids[s.start + row]] = -1
                    low = np.partition(score, -min(k, len(score)))[-min(k, len(score))]
                    at = np.flatnonzero(score >= max(least, low, 0))
                    at = at[np.argsort(-score[at], kind="stable")[:k]]
                    for c, v in (("id", np.full(len(at), ids[s.start + row])), ("neighbour", others[own[at]]), ("score", score[at])):
                        out[c].append(v)
                x, y = np.nonzero(may & ~many[:, None])
                score = _rounded(np.einsum("ij,ij->i", mine[s][x], theirs[y]))
                ok = (score >= max(least, 0)) & (ids[s][x] != others[y])
                for c, v in (("id", ids[s][x[ok]]), ("neighbour", others[y[ok]]), ("score", score[ok])):
                    out[c].append(v)
        return pa.table({c: pa.array(np.concatenate(v), pa.float64() if c == "score" else pa.int64()) for c, v in out.items()})

    return best


def neighbours(index: VectorIndex, k: int, least: float = 0.0, exact: bool = False, probes: int | None = None) -> DataFrame:
    """id, neighbour, score: for each row of the index its k most similar others, of scaled similarity least or more; ties by id.

    A few of the nearest cells give each row a k-th score to reach. All cells that are opened, or all that can hold better, are then met in
    blocks, where single precision rules out what is below that score; what is left is scored exactly.
    """
    schema, own = "id long, neighbour long, score double", index.rows.select("id", "embedding")
    w = Window.partitionBy("id").orderBy(F.desc("score"), "neighbour")
    top = lambda df: df.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= k).drop("n_")
    opened = min(probes or index.probes, len(index.centroids))

    def cells(count: int):
        def able(vectors: np.ndarray, _: np.ndarray) -> np.ndarray:
            likeness = vectors @ index.centroids.T
            return likeness >= -np.partition(-likeness, count - 1, axis=1)[:, count - 1 : count] - 1e-9

        return able

    first = min(opened, FIRST)
    found = top(_meet(index, own.withColumn("bar", F.lit(0.0)), cells(first), _best(k, least, cells(first)), schema))
    if first == opened and not exact:
        return found
    kth = found.groupBy("id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(least).alias("bar"))
    needed = materialize(own.join(kth, "id", "left").withColumn("bar", F.coalesce("bar", F.lit(float(least)))), "bounds")
    reach = lambda vectors, bar: index.reach(vectors) >= bar[:, None] - SLACK
    if exact:
        return top(_meet(index, needed, reach, _best(k, least), schema))
    both = lambda vectors, bar: reach(vectors, bar) & cells(opened)(vectors, bar)
    return top(_meet(index, needed, both, _best(k, least, cells(opened)), schema))


def _pairs(index: VectorIndex, least: float, within: str | None, found, schema: str) -> DataFrame:
    more = (within,) if within else ()
    able = lambda v, _: index.reach(v) >= least - SLACK
    return _meet(index, index.rows.select("id", "embedding", F.lit(0.0).alias("bar"), *more), able, found, schema, more)


def _alike(a: pa.Table, b: pa.Table, least: float, within: str | None):
    """Pieces of the pairs id < neighbour of two tables that are alike: their rows and scores."""
    if not a.num_rows or not b.num_rows:
        return
    ids, others = a.column("id").to_numpy(), b.column("id").to_numpy()
    if within:
        code = {v: n for n, v in enumerate({*a.column(within).to_pylist(), *b.column(within).to_pylist()} - {None})}
        mine, theirs = (np.array([code.get(v, -1) for v in t.column(within).to_pylist()]) for t in (a, b))
    for x, y, score in _near(a, b, np.full(len(ids), least)):
        ok = (score >= least) & (ids[x] < others[y])
        if within:
            ok &= (mine[x] == theirs[y]) & (mine[x] >= 0)
        yield x[ok], y[ok], score[ok]


def pairs(index: VectorIndex, least: float, within: str | None = None) -> DataFrame:
    """id, neighbour and score of all pairs id < neighbour of scaled similarity least or more, exactly; within: a column that both
    share, which null is not. Only blocks that can hold such a partner are met."""

    def found(a: pa.Table, b: pa.Table) -> pa.Table:
        own = [*_alike(a, b, least, within)] or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        x, y, score = (np.concatenate(v) for v in zip(*own))
        out = {"id": a.column("id").take(pa.array(x)), "neighbour": b.column("id").take(pa.array(y)), "score": score}
        return pa.table(out | ({within: a.column(within).take(pa.array(x))} if within else {}))

    schema = "id long, neighbour long, score double" + (f", {within} {dict(index.rows.dtypes)[within]}" if within else "")
    return _pairs(index, least, within, found, schema)


def links(index: VectorIndex, least: float) -> DataFrame:
    """id and neighbour of as many pairs of scaled similarity least or more as connect what all such pairs do: of each block a forest, so
    that there are no more than rows in it however many are alike."""

    def forest(a: pa.Table, b: pa.Table) -> pa.Table:
        ids = np.unique(np.concatenate([a.column("id").to_numpy(), b.column("id").to_numpy()]))
        root = np.arange(len(ids))
        at = [np.searchsorted(ids, t.column("id").to_numpy()) for t in (a, b)]
        for x, y, _ in _alike(a, b, least, None):
            x, y = at[0][x], at[1][y]
            while len(x):
                x, y = root[x], root[y]
                apart = x != y
                x, y = x[apart], y[apart]
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while (root[root] != root).any():
                    root = root[root]
        tied = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"id": ids[root[tied]], "neighbour": ids[tied]})

    return _pairs(index, least, None, forest, "id long, neighbour long")
