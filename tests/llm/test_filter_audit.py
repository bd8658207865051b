"""The filters' audit against plain Python, a document at a time."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from tessera.llm import filter_audit

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    texts = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            texts[text or ""] = min(doc_id, texts.get(text or "", doc_id))
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    out = Counter()
    parts = {lang or "" for *_, lang in docs}
    for order in permutations("ABCDE"):
        for part in parts:
            for step in range(1, 6):
                for what in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
                    out[part, "".join(order), step, what] += 0
        for doc_id, text, lang in docs:
            text = text or ""
            words = WORD.findall(text)
            fails = {
                "A": len(words) < 200,
                "B": 100 * len(set(words)) < 50 * len(words),
                "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                "D": bool(re.search("[#$%&*|]", text)),
                "E": doc_id is not None and doc_id > texts[text],
            }
            there = True
            for step, f in enumerate(order, 1):
                key = (lang or "", "".join(order), step)
                out[(*key, "redundant")] += not there and fails[f]
                out[(*key, "unique_fails")] += [k for k, v in fails.items() if v] == [f]
                gone = there and fails[f]
                out[(*key, "removed")] += gone
                out[(*key, "good_lost")] += gone and doc_id in good
                out[(*key, "toxic_lost")] += gone and doc_id in toxic
                there = there and not fails[f]
                out[(*key, "kept")] += there
    return out


def compare(spark, docs, labels):
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)).collect()
    want = brute(docs, labels)
    assert len(got) == 600 * len({lang or "" for *_, lang in docs}) == len({(r.part, r.filter_order, r.step) for r in got})
    shapley = Counter()
    for r in got:
        for what in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[what] == want[r.part, r.filter_order, r.step, what], (r, what)
        shapley[r.part, r.filter_order[r.step - 1]] += r.removed
    assert all(r.shapley == shapley[r.part, r.filter_order[r.step - 1]] for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_python(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Wort", "ÀÉ", "x y", "été", "AB#", "z|", "ok"] + [f"w{k}" for k in range(300)]
    texts = [rng.choice([" ", "\n", "\x0b\t"]).join(rng.choices(vocabulary, k=rng.choice([0, 3, 199, 200, 201, 500]))) for _ in range(60)]
    docs = [(k, rng.choice(texts), rng.choice(["de", "fr", None, ""])) for k in range(150)]
    labels = [(rng.randrange(170), rng.randrange(2), rng.randrange(2)) for _ in range(90)]
    compare(spark, docs, labels)


def test_repeats_and_nulls(spark):
    """A third of the rows is one row, another third has no id; texts, langs and labels are missing."""
    long = " ".join(f"w{k}" for k in range(250))
    docs = [(7, long, "de")] * 40 + [(None, long, "de")] * 20 + [(None, None, None)] * 20
    docs += [(k, long if k % 2 else None, "de" if k % 3 else "fr") for k in range(40)]
    labels = [(7, 1, 0), (7, 0, 1), (None, 1, 1), (3, None, None), (5, 1, 1), (5, 1, 1)]
    compare(spark, docs, labels)


def test_empty_tables_and_other_columns(spark):
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    names = ["part", "digest", "mask", "n", "good", "toxic", "least", "n_least", "nameless", "cell", "r", "before", "bit", "step", "first_ones"]
    extra = spark.createDataFrame([(1, "a b", "de", *names)], ["doc_id", "text", "lang", *names])
    labels = spark.createDataFrame([(1, 1, 0, "x", "y")], ["doc_id", "quality", "toxic", "part", "text"])
    assert filter_audit.audit(extra, labels).count() == 600


def test_native(spark):
    """No Python runs on the executors."""
    df = filter_audit.audit(spark.createDataFrame([(1, "a", "de")], DOCS), spark.createDataFrame([(1, 1, 0)], LABELS))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
