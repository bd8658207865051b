"""Patterns against plain Python over a small random graph."""

import itertools
import random

import pytest

from tessera.operators import patterns as M


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(6)
    nodes = [(f"{label}{k}", label, f"{label} {k}") for label in "ABC" for k in range(7)]
    rels = [(rng.choice("XY"), rng.choice(nodes)[0], rng.choice(nodes)[0]) for _ in range(90)]
    return nodes, rels, spark.createDataFrame(nodes, "node_id string, label string, caption string"), spark.createDataFrame(rels, "type string, src string, dst string")


def paths(edges, kind, start, least, most):
    """(end, edges) of each path that takes no edge twice."""
    out, todo = [], [(start, ())]
    for step in range(1, most + 1):
        todo = [(e[2], (*taken, e)) for at, taken in todo for e in edges if e[0] == kind and e[1] == at and e not in taken]
        out += todo if step >= least else []
    return out


def brute(nodes, rels, pattern):
    edges, label = sorted(set(rels)), {n: x for n, x, _ in nodes}
    out = []
    for chosen in itertools.product(*([n for n, x, _ in nodes if v.label in (None, x) and (v.where is None or n in v.where)] for v in pattern.nodes)):
        at = {v.name: n for v, n in zip(pattern.nodes, chosen)}
        ways = [[taken for end, taken in paths(edges, e.type, at[e.start], e.least, e.most) if end == at[e.end]] for e in pattern.edges]
        for way in itertools.product(*ways):
            taken = [e for part in way for e in part]
            out += [chosen] if len(set(taken)) == len(taken) else []
    assert label
    return sorted(out)


N, E = M.Node, M.Edge


@pytest.mark.parametrize("pattern", [
    M.Pattern((N("a", "A"), N("b", "B")), (E("a", "X", "b"),)),
    M.Pattern((N("a", "A"), N("b"), N("c", "C")), (E("a", "X", "b"), E("c", "Y", "b"))),
    M.Pattern((N("a"), N("b", "B")), (E("a", "X", "b", 1, 3),)),
    M.Pattern((N("a", "A"), N("b"), N("c")), (E("a", "X", "b"), E("b", "Y", "c"), E("a", "Y", "c", 1, 2))),
    M.Pattern((N("a", "A", "node_id IN ('A1', 'A2')"), N("b"), N("c")), (E("b", "X", "a"), E("b", "X", "c"))),
    M.Pattern((N("a"),), (E("a", "X", "a", 1, 2),)),
])
def test_matches(graph, pattern):
    nodes, rels, n, r = graph
    got = sorted(tuple(x) for x in M.match(n, r, pattern).collect())
    assert got == brute(nodes, rels, pattern)
    assert [tuple(x) for x in M.answer(M.match(n, r, pattern)).collect()] == sorted(set(got))[:3]


@pytest.mark.parametrize(("pattern", "why"), [
    (M.Pattern((N("a", "Z"), N("b")), (E("a", "X", "b"),)), "unknown label Z"),
    (M.Pattern((N("a"), N("b")), (E("a", "W", "b"),)), "unknown type W"),
    (M.Pattern((N("a"),), (E("a", "X", "c"),)), "unknown node c"),
    (M.Pattern((N("a"), N("b")), (E("a", "X", "b", 2, 1),)), "steps"),
    (M.Pattern((N("a"), N("b"), N("c")), (E("a", "X", "b"),)), "hangs on nothing"),
])
def test_refusals(graph, pattern, why):
    _, _, n, r = graph
    with pytest.raises(ValueError, match=why):
        M.match(n, r, pattern)


def test_a_triplet_that_the_graph_does_not_have(spark):
    n = spark.createDataFrame([("a", "A", "a"), ("b", "B", "b")], "node_id string, label string, caption string")
    r = spark.createDataFrame([("X", "a", "b")], "type string, src string, dst string")
    with pytest.raises(ValueError, match="no X from B to A"):
        M.match(n, r, M.Pattern((N("p", "B"), N("q", "A")), (E("p", "X", "q"),)))


@pytest.mark.parametrize("pattern", [
    M.Pattern((N("a", "A"), N("n"), N("b", "B")), (E("a", "X", "n"), E("b", "X", "n"))),
    M.Pattern((N("a"), N("n", "C"), N("b")), (E("a", "X", "n"), E("b", "X", "n"))),
    M.Pattern((N("a", "A"), N("n"), N("b")), (E("n", "X", "a"), E("n", "Y", "b"))),
])
def test_ends_that_meet_are_counted_by_classes(graph, pattern):
    _, _, n, r = graph
    want = sorted(tuple(x) for x in M.count_by(M.match(n, r, pattern), "a", "b").collect())
    assert want and sorted(tuple(x) for x in M.meeting_counts(n, r, pattern).collect()) == want


@pytest.mark.parametrize("most", [3, 40, 10_000])
def test_first_answers(graph, most):
    _, _, n, r = graph
    pattern = M.Pattern((N("a"), N("b"), N("c", "C")), (E("a", "X", "b"), E("b", "Y", "c")))
    got = M.first_answers(n, r, pattern, most, batch=1).collect()
    assert got == M.answer(M.match(n, r, pattern), most).collect()
