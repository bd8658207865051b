"""Alignment by bounds against comparing everything."""

import random
from difflib import SequenceMatcher

import pytest

from tessera.streaming import alignment as A


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def plain(chunks, pieces):
    out = set()
    for video, chunk in chunks:
        own = sorted((s, t.replace("\n", " ")) for v, s, t in pieces if v == video and video is not None and s is not None and t is not None)
        if own:
            ends = [(chunk or "")[:40].replace("\n", " ").strip(" "), (chunk or "")[-40:].replace("\n", " ").strip(" ")]
            out.add((video, chunk, *(max(own, key=lambda p, q=q: (ratio(q, p[1]), -p[0]))[0] for q in ends)))
    return out


def data(seed, n=160):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij klmnö", k=rng.randint(2, 7))) for _ in range(80)]
    say = lambda k: " ".join(rng.choices(words, k=k))
    pieces = [(rng.choice(["hot", "hot", "v1", "v2"]), float(k), say(rng.randint(1, 14))) for k in range(n)]
    pieces += [("hot", 900.0 + k, pieces[0][2]) for k in range(30)] + [("v1", 5.5, ""), ("v1", None, "x"), ("v2", 3.0, None), (None, 1.0, "a"), ("v1", 7.5, "a\nlong one " * 60)]
    chunks = [(v, " ".join(t for w, _, t in pieces[k : k + 4] if w == v and t)) for k, (v, _, _) in enumerate(pieces[:60])]
    chunks += chunks[:10] + [("hot", None), ("v1", ""), ("none", "text"), (None, "text"), ("v2", "zzzz qqqq"), ("v1", "a\nlong one a long")]
    return chunks, pieces


@pytest.mark.parametrize("seed, block", [(1, 512), (2, 16)])
def test_align(spark, seed, block):
    chunks, pieces = data(seed)
    own = spark.createDataFrame(chunks, "video string, chunk string"), spark.createDataFrame(pieces, "video string, start double, text string").repartition(4)
    got = [tuple(r) for r in A.align(*own, block=block).collect()]
    assert len(got) == len({*got}) and {*got} == plain(chunks, pieces)


def test_few_pairs_are_compared(spark):
    _, pieces = data(3, 600)
    told = sorted({(v, t): s for v, s, t in reversed(pieces) if v and t and s is not None}.items())
    asked = sorted({(v, t[:40].strip()) for (v, t), _ in told[::5]})
    own = spark.createDataFrame(asked, "video string, q string"), spark.createDataFrame([(v, t, s) for (v, t), s in told], "video string, text string, start double")
    got = A.best_pieces(*own).collect()
    pairs = sum(v == w for v, _ in asked for (w, _), _ in told)
    assert len(got) == len(asked) and sum(r.compared for r in got) < pairs / 4


def test_nothing(spark):
    assert A.align(spark.createDataFrame([], "video string, chunk string"), spark.createDataFrame([], "video string, start double, text string")).count() == 0


@pytest.mark.parametrize("few", [0, 64])
def test_guesses_move_no_texts_with_their_grams(spark, few, monkeypatch):
    monkeypatch.setattr(A, "FEW", few)
    asked = spark.createDataFrame([("v", "the end of it"), ("w", "other")], "video string, q string")
    pieces = spark.createDataFrame([("v", "x" * 900 + " the end of it", 1.0), ("v", "other", 2.0)], "video string, text string, start double")
    guessed = A._guesses(asked, pieces)
    assert {r.video: r.least > 0 for r in guessed.collect()} == {"v": few == 0, "w": False}
    plan = guessed._jdf.queryExecution().optimizedPlan().toString()
    counted = next(line for line in plan.splitlines() if "Aggregate [video" in line and "gram" in line)
    assert "min(h" in counted and "text" not in counted
