"""The similarity join against all pairs, and components against a plain union-find."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import ngram_join
from tessera.llm.components import connected_components

SPLIT = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


def grams(text):
    words = [w for w in (text or "").translate(SPLIT).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """For each row: links and the rows that it hangs together with."""
    sets = [grams(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(rows[i][0])
    name = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return Counter((r[0], name[top(i)], links[i]) for i, r in enumerate(rows))


def corpus(seed, families, most, length):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.randint(1, length))
        for _ in range(rng.randint(1, most)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    return rows


def joined(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, node int, key string").repartition(4)
    return Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.similarity_join(docs).collect())


def test_against_all_pairs(spark):
    rows = corpus(1, 120, 6, 200)
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "one\ttwo"), (9005, "one two three"), (None, rows[0][1]), (None, "null only"), (9006, rows[5][1]), (9006, rows[5][1])]
    got, want = joined(spark, rows), brute(rows)
    assert sum((got & want).values()) >= 0.99 * len(rows) and sum(got.values()) == len(rows)
    # Recall of links, of which a pair at the threshold is missed once in a thousand.
    total = lambda c: sum(n * k[2] for k, n in c.items())
    assert 0.995 * total(want) <= total(got) <= total(want)


def test_families_larger_than_a_block(spark, monkeypatch):
    """Blocks of families, and of buckets where these are cheaper."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(w if rng.random() > 0.004 else f"x{rng.random()}" for w in base)) for i in range(90)]
    # A chain, each like the next only: its family is large and its buckets are small.
    words = [f"c{i}" for i in range(2000)]
    rows += [(1000 + i, " ".join(words[12 * i : 12 * i + 150])) for i in range(80)]
    got, want = joined(spark, rows), brute(rows)
    assert sum((got & want).values()) >= 0.97 * len(rows)


def test_deduplicate(spark):
    rows = corpus(2, 40, 5, 120)
    docs = spark.createDataFrame([(i, t, "en", 5) for i, t in rows] + [(0, rows[0][1], "en", 5), (None, "x", None, None)], "doc_id long, text string, rep string, links int")
    got = ngram_join.deduplicate(docs)
    assert got.columns == docs.columns
    names = {c for (i, c, _) in brute(rows)}
    assert got.where("text IS NULL").count() == 0
    ids = [r.doc_id for r in got.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == names | {None}
    assert ngram_join.similarity_join(docs.limit(0)).count() == ngram_join.deduplicate(docs.limit(0)).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    """A text that is no copy of anything stays, whatever id it has; of equal rows one stays; empty texts all stay."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "x"), (1, a, "x"), (3, c + " z", "y"), (4, c, "y"), (None, c, "y"), (None, "n", "y"), (None, "n", "z"), (5, "", "e"), (5, None, "e"), (5, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep_key string")
    got = Counter((r.doc_id, r.text) for r in ngram_join.deduplicate(docs.repartition(5)).collect())
    assert got == Counter([(1, a), (1, b), (3, c + " z"), (None, "n"), (5, ""), (5, None), (5, "")])


def test_levels():
    assert ngram_join.levels(0.8, 0.999, 0.99) == [6, 5, 4]
    for threshold in (0.5, 0.8, 0.9):
        for recall in (0.9, 0.99, 0.999):
            depths = ngram_join.levels(threshold, recall)
            assert depths == list(range(depths[0], depths[-1] - 1, -1)) and (ngram_join.chance(threshold, depths[-1]) >= recall or depths[-1] == 1)


@pytest.mark.parametrize(("edits", "reached"), [(1, {6}), (12, {4, 5}), (300, {4})])
def test_prefixes_are_shortened_as_far_as_the_data_need(edits, reached):
    """Texts far above the threshold are done by long prefixes; links near it, or none at all, make them shorter."""
    rng, depths, got = random.Random(9), ngram_join.levels(), set()
    for _ in range(6):
        base = [rng.randrange(1 << 62) for _ in range(600)]
        rows = [list(base) for _ in range(40)]
        for own in rows:
            for at in rng.sample(range(600), edits):
                own[at] = rng.randrange(1 << 62)
        # One more pair, with a short common prefix only, so that there is always something left to compare.
        bounds = np.arange(len(rows) + 1) * 600
        hashes, ends = ngram_join.shingles(np.array(rows, np.int64).ravel(), bounds)
        values = ngram_join.minhash(hashes, ends, depths[0]).astype(np.uint64)
        values[0, 0, : depths[-1]] = values[1, 0, : depths[-1]] = 1
        values[:, 1:, 0] = values[:, 1:, 0] if edits < 300 else np.arange(len(rows))[:, None]
        values[0, 1:, 0], values[1, 1:, 0] = 70_000, 70_001
        sets = [np.unique(hashes[s:e].view(np.int64)) for s, e in zip(ends, ends[1:])]
        n = len(rows)
        count, hub, depth = ngram_join._links(np.arange(n), np.ones(n, np.int64), values, sets, -1, np.zeros(n, int), 0, 0, 0.8, 0.999, depths)
        got.add(depth)
    assert got <= reached, got


def test_forest_is_the_sorted_signatures(spark):
    """What a node shares with its neighbours in order is what it shares with any; ends of ranges may say more."""
    rng = np.random.default_rng(3)
    depth = 4
    values = rng.integers(0, 3, (200, ngram_join.TREES, depth)).astype(">u2")
    nodes = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in enumerate(values)], "node long, signature binary")
    got = {(r.node, r.tree): r.shared for r in ngram_join.forest(nodes, depth, 1).collect()}
    for tree in range(ngram_join.TREES):
        own = values[:, tree]
        alike = np.cumprod(own[:, None, :] == own[None, :, :], axis=2).sum(axis=2)
        np.fill_diagonal(alike, 0)
        for k, most in enumerate(alike.max(axis=1)):
            assert got.get((k, tree), 0) >= most if most else True
    alike = sum(got.get((k, t), 0) for k in range(200) for t in range(ngram_join.TREES))
    assert alike <= 200 * ngram_join.TREES * depth


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(30)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    want = {x: top(x) for x in list(parent)}
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in want.items() if sum(top(y) == r for y in parent) > 1}
