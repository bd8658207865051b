"""Rounds over a graph in blocks against plain Python: moves, parts, groups as nodes, and edges that stay where they are."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import adjacency as A
from tessera.operators import communities as C


@pytest.fixture(scope="module")
def rows():
    """Parallel edges in both directions, loops, a node with nothing but a loop, negative ids, a hub, and edges without an end."""
    rng = random.Random(4)
    out = [(rng.randrange(-20, 40), rng.randrange(-20, 40), float(rng.randint(1, 4))) for _ in range(300)]
    return [*out, *((0, k, 0.5) for k in range(60, 90)), (99, 99, 2.0), (100, 101, 1.0), (101, 100, 1.0), (102, None, 3.0), (None, 0, 1.0), (5, 6, None)]


@pytest.fixture(scope="module")
def edges(spark, rows):
    return spark.createDataFrame(rows, "source long, target long, weight double")


@pytest.fixture(scope="module")
def graph(edges):
    """As of a larger graph: some blocks, and some without a node."""
    with pytest.MonkeyPatch.context() as few:
        few.setattr(A, "BLOCK_EDGES", 60)
        return C._blocks(edges)


def around(rows):
    near, degree = defaultdict(lambda: defaultdict(float)), defaultdict(float)
    for a, b, w in rows:
        for x, y in ((a, b), (b, a)):
            if x is not None:
                degree[x] += w or 0
                if y not in (None, x):
                    near[x][y] += w or 0
    return near, degree


def test_a_move_is_the_best_one(spark, rows, edges, graph):
    near, degree = around(rows)
    total = sum(w or 0 for *_, w in rows)
    community = {x: x - x % 7 if x in degree and x % 3 else x for x in degree}
    mine = {r.node: r.m for r in spark.createDataFrame([(x,) for x in degree], "node long").select("node", (F.pmod(F.xxhash64("node", F.lit(3)), F.lit(2)) == 0).alias("m")).collect()}
    volume, want = defaultdict(float), {}
    for x, k in degree.items():
        volume[community[x]] += k
    for x, k in degree.items():
        weight = defaultdict(float)
        for y, w in near[x].items():
            weight[community[y]] += w
        gain = {c: w - k * (volume[c] - (k if c == community[x] else 0)) / (2 * total) for c, w in weight.items()}
        best = max(gain, key=lambda c: (round(gain[c], 9), -c), default=None)
        stays = best is None or not mine[x] or round(gain[best], 9) <= gain.get(community[x], 0) + 1e-9
        want[x] = community[x] if stays else best
    assert want != community
    own = spark.createDataFrame([*community.items()], "node long, community long")
    for of in (graph, edges):
        assert {r.node: r.community for r in C._move(of, own, 3, total).collect()} == want
    seen = {r.node: r for r in C._around(graph, C._held(graph, own), 3, total).collect()}
    for x in degree:
        assert seen[x].k == degree[x] and seen[x].volume == volume[community[x]]
        assert seen[x].inside == sum(w for y, w in near[x].items() if community[y] == community[x])
        assert seen[x].low == min([x, *(y for y in near[x] if community[y] == community[x])])


def test_parts_are_those_of_plain_search(spark, rows, graph):
    near, degree = around(rows)
    chain = {x: 1 for x in degree} | {99: 99}
    for community in (chain, {x: x % 4 for x in degree}):
        want = {}
        for x in sorted(degree):
            todo = [] if x in want else [x]
            while todo:
                y = todo.pop()
                want[y] = x
                todo += [z for z in near[y] if z not in want and community[z] == community[y]]
        got = C.connected_parts(graph, spark.createDataFrame([*community.items()], "node long, community long")).collect()
        assert {r.node: r.community for r in got} == want


def test_long_chains_end_in_few_rounds(spark, monkeypatch):
    """Labels of whole groups fall at once, so rounds do not grow with the length."""
    order = list(range(400))
    random.Random(5).shuffle(order)
    e = spark.createDataFrame([(a, b, 1.0) for a, b in zip(order, order[1:])], "source long, target long, weight double")
    rounds, write = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, name: rounds.append(name) or write(df, name))
    got = C.connected_parts(e, spark.createDataFrame([(k, 7) for k in order], "node long, community long"))
    assert {r.community for r in got.collect()} == {0} and rounds.count("labels") < 12


def test_groups_become_nodes(spark, rows, graph):
    _, degree = around(rows)
    group = {x: x // 10 for x in degree}
    own = graph.nodes.join(spark.createDataFrame([*group.items()], "node long, group long"), "node").select("block", "node", "group")
    above = A.build(A.merged(graph, own), 10)
    want = defaultdict(float)
    for x, k in degree.items():
        want[group[x]] += k
    missing = {102: 3.0, 0: 1.0}  # edges without an end stay in the degree of their node, and are none between groups
    for x, w in missing.items():
        want[group[x]] -= w
    assert {r.node: r.k for r in above.nodes.collect()} == {g: k for g, k in want.items() if k}
    assert above.loops == sum(w or 0 for a, b, w in rows if None not in (a, b) and group[a] == group[b])
    above.drop()


def test_edges_stay_where_they_are(spark, graph):
    """A round moves columns of nodes only: the stored edges meet them in their buckets."""
    own = graph.nodes.withColumn("community", F.col("node"))
    plan = C._move(graph, own, 0, 4.0)._jdf.queryExecution().executedPlan().toString().splitlines()
    at = [k for k, line in enumerate(plan) if "FileScan" in line and "near" in line]
    assert len(at) == 1 and "Bucketed: true" in plan[at[0]]
    depth = lambda line: re.search(r"[A-Za-z(*]", line).start()
    above, least = [], depth(plan[at[0]])
    for line in reversed(plan[: at[0]]):
        if depth(line) < least:
            above.append(line)
            least = depth(line)
    assert any("CoGroups" in line for line in above) and not any("Exchange" in line for line in above)
