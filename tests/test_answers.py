"""Answers by a tree of merges against one pass over all points."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import answers as A

KIND = "key string, id long, piece int, score double, text string"


def flat(rows, budget):
    own = {}
    for key, i, piece, score, text in rows:
        if text and score and score > 0:
            own[key, i, piece] = max(own.get((key, i, piece), (score, text)), (score, text))
    by = defaultdict(list)
    for (key, i, piece), (score, text) in own.items():
        by[key].append((-score, i, piece, text))
    out = {}
    for key, found in by.items():
        filled, kept = 0, []
        for p in sorted(found):
            filled += len(p[3])
            if filled > budget:
                break
            kept.append(p)
        mean = round(sum(-p[0] for p in kept) / len(kept), 6) if kept else None
        out[key] = (len(found), len(kept), mean, "\n".join(p[3] for p in kept))
    return out


@pytest.mark.parametrize("budget, longest", [(0, 3), (6, 9), (30, 4), (30, 60)])
def test_tree_is_one_pass(spark, monkeypatch, budget, longest):
    rng, merged = random.Random(budget + longest), []
    rows = [("hot", k, rng.randint(0, 1), float(rng.randint(1, 9)), "x" * rng.randint(1, longest)) for k in range(900)]
    rows += [(rng.choice(["a", "b", None]), k, 0, rng.choice([0.0, -1.0, 2.0, 3.0, None]), rng.choice([None, "", "one", "three"])) for k in range(300)]
    rows += rows[:200] + [("late", 1, 0, 5.0, "y" * 99), ("late", 2, 0, 1.0, "z")]
    kept = A.materialize
    monkeypatch.setattr(A, "materialize", lambda df, name: merged.append(name) or kept(df, name))
    got = A.answers(spark.createDataFrame(rows, KIND).repartition(5), budget, 1).collect()
    assert {r.key: (r.n_points, r.n_kept, None if r.mean_score is None else round(r.mean_score, 6), r.text) for r in got} == flat(rows, budget)
    assert len(got) == len({r.key for r in got}) and "merged" in merged


def test_no_points(spark):
    assert A.answers(spark.createDataFrame([], KIND)).count() == 0


def test_points_are_whole_texts(spark):
    texts = {1: "äb\ncd" * 7, 2: "", 3: None, 4: "x" * 10}
    got = A.points(spark.createDataFrame([("k", i, t) for i, t in texts.items()], "key string, id long, text string"), F.length, 10).orderBy("id", "piece").collect()
    assert "".join(r.text for r in got if r.id == 1) == texts[1] and [(r.piece, r.score) for r in got if r.id == 1] == [(0, 10.0), (1, 10.0), (2, 10.0), (3, 5.0)]
    assert [(r.id, r.text) for r in got if r.id > 1] == [(4, "x" * 10)]


def test_children_of_children(spark):
    children = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("a", "d"), ("e", "f")], "parent string, child string")
    texts = spark.createDataFrame([("c", 1.0, "see"), ("d", 2.0, "dee"), ("e", 1.0, "has one"), ("f", 1.0, "eff"), ("b", 1.0, "")], "id string, score double, text string")
    got = {r.key: r.text for r in A.child_answers(children, texts, 2).collect()}
    assert got == {"a": "dee\nsee", "b": "dee\nsee"}
