"""The inverted file of vectors against all pairs in numpy."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.operators import retrieval, vector_index as V

KIND = "id long, embedding array<float>, label string"


def table(spark, n=600, dims=12, groups=15, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims)) * 3
    v = centres[rng.integers(groups, size=n)] + rng.normal(size=(n, dims))
    v[n - copies :] = v[0]
    rows = [(i, [float(x) for x in v[i]], "ab"[i % 2]) for i in range(n)]
    rows += [(n, None, "a"), (n + 1, [0.0] * dims, "a")]
    unit = np.float32(v).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    return spark.createDataFrame(rows, KIND).repartition(5), np.round((1 + unit @ unit.T) / 2, 4)


def true_neighbours(score, k, least=0.0):
    out = set()
    for i, row in enumerate(score):
        own = sorted((-s, j) for j, s in enumerate(row) if j != i and s >= least)[:k]
        out |= {(i, j, -s) for s, j in own}
    return out


@pytest.mark.parametrize("copies", [0, 200])
def test_exact_joins_and_recall(spark, copies, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 64)
    rows, score = table(spark, copies=copies)
    index = V.build(rows)
    assert index.probes < len(index.centroids) and index.rows.count() == 600
    want = true_neighbours(score, 5)
    assert {tuple(r) for r in V.neighbours(index, 5, exact=True).collect()} == want
    assert {tuple(r) for r in V.neighbours(index, 5, exact=True, probes=1).collect()} == want
    assert {tuple(r) for r in V.neighbours(index, 5, 0.9, exact=True).collect()} == true_neighbours(score, 5, 0.9)
    least = {i: s for i, _, s in sorted(want, key=lambda x: -x[2])}
    found = V.neighbours(index, 5).collect()
    assert sum(r.score >= least[r.id] for r in found) >= 0.9 * len(want)
    for at in (0, 7, 99):
        got = [(r.id, r.score) for r in V.search(index, rows.where(F.col("id") == at).head().embedding, 4, exact=True, probes=1).collect()]
        assert got == [(j, -s) for s, j in sorted((-s, j) for j, s in enumerate(score[at]))[:4]]


def test_pairs(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 64)
    rows, score = table(spark, n=200)
    index = V.build(rows)
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if score[i, j] >= 0.9}
    assert {(r.id, r.neighbour) for r in V.pairs(index, 0.9).collect()} == want and want
    assert {(r.id, r.neighbour, r.label) for r in V.pairs(index, 0.9, "label").collect()} == {(i, j, "ab"[i % 2]) for i, j in want if i % 2 == j % 2}


def test_a_search_opens_few_cells(spark):
    rows, _ = table(spark, n=2000, groups=40)
    index = V.build(rows, cells=40)
    found = V.search(index, [1.0] * 12, 3, probes=2)
    assert "PartitionFilters: [cell" in found._jdf.queryExecution().executedPlan().toString()
    cells = index.rows.where(F.col("cell").isin(index.nearest(np.ones((1, 12)), 2)[0].tolist()))
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(cells) <= 2 * 2 < files(index.rows) and cells.count() < 400
    assert index.probes <= 20


def test_kept_and_rebuilt_by_dimension(spark, tmp_path):
    rows, _ = table(spark, n=100)
    path = f"file://{tmp_path}/index"
    first, at = V.refreshed(rows, path, 12)
    assert at != path and V.load(spark, at).probes == first.probes
    same, again = V.refreshed(rows, at, 12)
    assert again == at and np.allclose(same.centroids, first.centroids)
    other = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [2.0, 1.0], "a")], KIND)
    new, place = V.refreshed(other, at, 2)
    assert place != at and new.dimensions == 2 and new.rows.count() == 2


def test_least_and_nothing(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0], "a")], KIND)
    index = V.build(one)
    assert V.neighbours(index, 3, exact=True).count() == 0 and [r.id for r in V.search(index, [1.0, 0.0], 3).collect()] == [1]
    with pytest.raises(ValueError):
        V.build(one.limit(0))
    assert retrieval.nearest_neighbours(one, 3).count() == 0


def test_vectors_are_copied_once_a_block_and_not_a_cell(spark):
    rows, score = table(spark, n=900, copies=300)
    index = V.build(rows, cells=200)
    assert V._blocks(index)[0] < 20 and {tuple(r) for r in V.neighbours(index, 5, exact=True).collect()} == true_neighbours(score, 5)


def test_links_are_a_forest_of_each_block(spark):
    rows, score = table(spark, n=500, copies=300)
    index = V.build(rows)
    got = [(r.id, r.neighbour) for r in V.links(index, 0.9).collect()]
    groups = {i: {i} for i in range(500)}
    for i, j in got:
        if groups[i] is not groups[j]:
            groups[i] |= groups[j]
            for x in groups[j]:
                groups[x] = groups[i]
    assert all(score[i, j] < 0.9 or groups[i] is groups[j] for i in range(500) for j in range(i))
    assert all(any(score[i, j] >= 0.9 for j in groups[i] if j != i) for i in range(500) if len(groups[i]) > 1)
    assert len(got) < 500 * V._blocks(index)[0] < (score >= 0.9).sum() / 2
