"""Duplicates, alignment, windows, states, expansions and sinks against plain Python."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import curation, lifecycle, models, retrieval
from tessera.sources import sinks
from tessera.streaming import transcript


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_duplicates_against_all_pairs(spark):
    rng = random.Random(2)
    base = ["".join(rng.choices("abcd", k=rng.randint(1, 14))) for _ in range(40)]
    names = set(base)
    for x in base:
        for _ in range(3):
            own = list(x)
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.randint(0, 1)] = rng.choice([[], ["Z"], ["a"]])
            names.add("".join(own))
    rows = sorted({(rng.choice("LM"), n) for n in names if n})
    got = {tuple(r) for r in curation.duplicate_pairs(spark.createDataFrame(rows, "label string, name string")).collect()}
    want = set()
    for la, a in rows:
        for lb, b in rows:
            x, y = a.lower(), b.lower()
            if la == lb and a < b and (min(len(a), len(b)) >= 3 and (x in y or y in x) or len(a) > 5 and edits(x, y) < 5):
                want.add((la, a, b))
    assert got == want and len(want) > 100


def test_alignment_against_plain_python(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "so", "it"]
    pieces = [(v, float(k), " ".join(rng.choices(words, k=8))) for v in "ab" for k in range(25)]
    chunks = [(v, " ".join(t for w, _, t in pieces if w == v)[at : at + 150]) for v in "ab" for at in (0, 40, 333)]
    got = {(r.video, r.chunk): (r.start, r.end) for r in transcript.align(spark.createDataFrame(chunks, "video string, chunk string"), spark.createDataFrame(pieces, "video string, start double, text string")).collect()}
    for v, chunk in chunks:
        best = []
        for part in (chunk[:40], chunk[-40:]):
            most = 0
            for w, start, text in pieces:
                ratio = SequenceMatcher(None, part.strip(), text).ratio()
                if w == v and ratio > most:
                    most, at = ratio, start
            best.append(at)
        assert got[v, chunk] == tuple(best)


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_against_the_fold(spark, seed):
    rng = random.Random(seed)
    rows, at = [], 0.0
    for k in range(200):
        at += rng.choice([0, 1, 20, 59, 60, 61, 300])
        rows.append(("v", at, f"t{k:03d}"))
    got = {x: r.window_no for r in transcript.transcript_windows(spark.createDataFrame(rows, "video string, start double, text string")).collect() for x in r.text.split()}
    border, no, want = 60.0, 0, {}
    for _, start, text in rows:
        want[text] = no
        if start >= border:
            border, no = border + 60, no + 1
    assert got == want


def test_states(spark):
    schema = "file string, status string, is_cancelled boolean, total_chunks int, processed_chunk int, node_count long, relationship_count long, error_message string"
    own = spark.createDataFrame([("a", "Processing", False, 9, 3, 5, 6, None), ("b", "Processing", True, 9, 3, 5, 6, None), ("c", "Completed", False, 9, 9, 5, 6, None)], schema)
    of = lambda df: {r.file: r for r in df.collect()}
    failed = of(lifecycle.fail(own, spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y")], "file string, message string")))
    assert [(failed[k].status, failed[k].error_message) for k in "abc"] == [("Failed", "x"), ("Cancelled", "y"), ("Completed", None)]
    again = of(lifecycle.retry(own, spark.createDataFrame([("a", lifecycle.WITHOUT_ENTITIES), ("b", lifecycle.FROM_START), ("c", lifecycle.FROM_LAST)], "file string, condition string")))
    assert [(again[k].processed_chunk, again[k].node_count, again[k].is_cancelled) for k in "abc"] == [(0, 0, False), (0, 5, False), (9, 5, False)]
    new = of(lifecycle.register(own, spark.createDataFrame([("c",), ("d",), ("d",)], "file string")))
    assert len(new) == 4 and (new["c"].status, new["c"].processed_chunk, new["d"].status) == ("New", 0, "New")
    assert of(lifecycle.cancel(own, spark.createDataFrame([("c",)], "file string")))["c"].is_cancelled


def test_tagged_triplets_are_those_that_were_marked(spark):
    rng = random.Random(8)
    word = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "de la", "x1"], k=rng.randint(1, 3)))
    rows = []
    for k in range(200):
        heads = [(word(), [(word(), word()) for _ in range(rng.randint(1, 3))]) for _ in range(rng.randrange(4))]
        marked = "".join(f"<triplet> {h} " + "".join(f"<subj> {t} <obj> {kind} " for t, kind in own) for h, own in heads)
        rows.append((k, f"<s>{rng.choice(['', 'before '])}{marked}</s><pad>", [(h, kind, t) for h, own in heads for t, kind in own]))
    got = {r.k: [tuple(x) for x in r.x] for r in spark.createDataFrame([r[:2] for r in rows], "k int, t string").select("k", T.tagged_triplets(F.col("t")).alias("x")).collect()}
    assert all(got[k] == want for k, _, want in rows)


@pytest.mark.parametrize(("text", "want"), [
    ("", []), ("no marks at all", []), ("<triplet> a", []), ("<triplet> a <subj> b", []), ("<triplet> a <subj> b <obj>", []), ("<triplet> <subj> b <obj> c", []),
    ("<triplet> a <subj> <obj> c <subj> d <obj> e", [("a", "e", "d")]), ("<triplet> a <subj> b <obj> c <triplet> d", [("a", "c", "b")]), ("<obj> c <subj> b <triplet> a <subj>  b   x <obj> c", [("a", "c", "b x")]),
])
def test_tagged_triplets_by_hand(spark, text, want):
    assert [tuple(x) for x in spark.createDataFrame([(text,)], "t string").select(T.tagged_triplets(F.col("t"))).head()[0]] == want


def test_models_are_arguments(spark):
    chunks = spark.createDataFrame([("f", 1, "c", "Alpha beta Gamma")], "file string, position int, chunk_id string, text string")
    assert [r.entity for r in models.extract(chunks).orderBy("place").collect()] == ["Alpha", "Gamma"]
    own = F.pandas_udf(lambda t: t.map(lambda x: [{"place": 0, "entity": x[::-1]}]), "array<struct<place int, entity string>>")
    assert [r.entity for r in models.extract(chunks, own).collect()] == ["ammaG ateb ahplA"]
    some = spark.createDataFrame([(1, "a", [9.0]), (2, "b", None)], "id int, text string, embedding array<double>")
    assert {r.id: r.embedding for r in models.embed(some, "text", lambda t: F.array(F.length(t).cast("double"))).collect()} == {1: [9.0], 2: [1.0]}
    assert len(models.embed(chunks, "text").head().embedding) == 64


def test_results_are_read_again_and_failures_set_aside(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, text string")
    for kind in ("csv", "json"):
        sinks.write_results(rows, f"{tmp_path}/{kind}", kind)
        assert sorted(map(tuple, sinks.read_results(spark, f"{tmp_path}/{kind}", "id int, text string", kind).collect())) == [(1, "a,b"), (2, None)]
    sinks.append_results(rows, f"{tmp_path}/json")
    assert sinks.read_results(spark, f"{tmp_path}/json", "id int, text string", "json").count() == 4
    good = sinks.set_aside(rows, F.col("text").isNull(), f"{tmp_path}/failed")
    assert [r.id for r in good.collect()] == [1] and [r.id for r in spark.read.parquet(f"{tmp_path}/failed").collect()] == [2]


def test_pairs_by_vectors_hold_no_names_that_are_merely_near(spark):
    rows = [("x", "v10000", [1.0, 0.0]), ("x", "v10001", [0.0, 1.0]), ("x", "v1000", [0.0, -1.0]), ("x", "v7", [1.0, 0.1]), (None, "v8", [1.0, 0.0]), (None, "v9", [1.0, 0.0]), ("x", None, [1.0, 0.0])]
    own = spark.createDataFrame(rows, "label string, name string, embedding array<float>")
    got = {tuple(r) for r in curation.duplicate_pairs(own, distance=None, likeness=0.9).collect()}
    assert got == {("x", "v1000", "v10000"), ("x", "v1000", "v10001"), ("x", "v10000", "v7")}
