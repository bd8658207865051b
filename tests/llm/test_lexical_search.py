"""Search over the tiered index against plain Python, rounds included."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lexical_search as L

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    own = [(d, Counter(terms(t))) for d, t in docs]
    own = [(d, c, c.total()) for d, c in own if c]
    n_docs, total = len(own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item_id, text in set(items):
        scored = []
        for d, c, n in own:
            m = 100 - 90 + (90 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item_id, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, most=L.BLOCK, proven_at=None):
    index = L.build(spark.createDataFrame(docs, DOCS).repartition(3), most)
    rows = L.search(index, spark.createDataFrame(items, ITEMS), proven_at=proven_at).collect()
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rows), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_python(spark, seed):
    rng = random.Random(seed)
    common, rare = ["the", "The", "und", "ÀB", "x1", "été"], [f"r{k}" for k in range(400)]
    docs = [(k, rng.choice([" ", "-", "\x7f"]).join(rng.choices(common, k=rng.randrange(60)) + rng.choices(rare, k=rng.randrange(12)))) for k in range(400)]
    items = [(k, " ".join(rng.choices(common, k=4) + rng.choices(rare, k=rng.randrange(6)))) for k in range(25)] + [(90, ""), (91, None), (92, "nowhere")]
    for most in (23, 5000):
        assert found(spark, docs, items, most) == brute(docs, items)


def test_items_are_proven_early_or_fall_through(spark):
    """Rare passages are answered from the first tier, common words alone from the last."""
    rng = random.Random(5)
    common = [f"c{k}" for k in range(12)]
    passage = [f"p{k}" for k in range(30)]
    docs = [(k, " ".join(rng.choices(common, k=rng.randint(5, 60)) + (passage if k % 97 == 0 else [f"r{rng.randrange(3000)}"]))) for k in range(2000)]
    rare, usual = (1, " ".join(passage + common[:2])), (2, " ".join(common[:4]))
    proven = []
    assert found(spark, docs, [rare, usual], 500, proven) == brute(docs, [rare, usual])
    assert proven == [1, 1]
    proven = []
    assert found(spark, docs, [rare], 500, proven) == brute(docs, [rare]) and proven == [1]


def test_bounds_hold_for_lower_tiers(spark):
    """The residual bound of each tier is the largest impact of a posting below it."""
    rng = random.Random(3)
    docs = [(k, " ".join(rng.choices(["a", "b", "c", "d"], k=rng.randint(1, 80)))) for k in range(300)]
    index = L.build(spark.createDataFrame(docs, DOCS).repartition(2), 64)
    lists, lengths = [r for r in index.collect() if r.term is not None], {r.block: np.frombuffer(r.postings, "<i8") for r in index.collect() if r.term is None}
    numbers = L._numbers(index, [type("Row", (), {"item_id": 1, "terms": [b"a", b"b", b"c", b"d"]})])
    for t, k in numbers.terms.items():
        for tier in range(L.TIERS):
            most = 0
            for r in lists:
                if bytes(r.term) == t and r.tier > tier:
                    own = np.frombuffer(r.postings, "<i4").reshape(-1, 2).astype(np.int64)
                    most = max(most, int(L.impacts(own[:, 1], lengths[r.block][own[:, 0]], numbers.documents, numbers.total).max()))
            assert numbers.residual[tier, k] == numbers.weight[k] * most
    assert sum(r.size for r in lists) == sum(len(set(terms(t))) for _, t in docs)


def test_ties_repeats_and_nulls(spark):
    """A third of the rows is one row, another third has no id; many documents of one score meet the limit of ten."""
    docs = [(5, "same words here")] * 40 + [(None, "other words")] * 40 + [(k, "other words") for k in range(40)]
    docs += [(200, None), (201, ""), (202, "--"), (203, "long " * 30000 + "here")]
    items = [(1, "words"), (1, "words"), (1, "here same"), (None, "other"), (3, "LONG Here")]
    assert found(spark, docs, items, 16) == brute(docs, items)


def test_blocks_of_items_and_few_sums_at_once(spark, monkeypatch):
    rng = random.Random(8)
    docs = [(k, " ".join(f"w{rng.randrange(200)}" for _ in range(20))) for k in range(200)]
    items = [(k, " ".join(f"w{rng.randrange(200)}" for _ in range(8))) for k in range(40)]
    monkeypatch.setattr(L, "ITEM_TERMS", 60)
    assert found(spark, docs, items, 32) == brute(docs, items)


def test_empty_tables_and_other_columns(spark):
    assert found(spark, [], [(1, "a")]) == [] == found(spark, [(1, "a")], []) == found(spark, [(1, " ")], [(1, "a")])
    names = ["item", "score", "rank", "block", "term", "tier", "size", "postings", "bound", "ids", "terms"]
    docs = spark.createDataFrame([("x", "a b", *names)], ["doc_id", "text", *names])
    items = spark.createDataFrame([("q", "b", *names)], ["item_id", "text", *names])
    got = L.ranked_search(docs, items).collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in got] == [("q", 1, "x")]
