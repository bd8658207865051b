"""License scans, mixing and the pipeline against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import license_scan, mixing, ngram_join, packing, quality_classifier, secret_scan
from tessera.llm.common import materialize, table, word_hashes

DATA = "/root/testdata/sf0.01"


def test_exact_notices_are_all_found(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {(r.doc_id, r.license, r.start, r.end) for r in license_scan.scan_licenses(documents).where("coverage = 1").collect()}
    want = set()
    for r in documents.collect():
        for name, forms in license_scan.TEMPLATES.items():
            for notice in forms:
                at = r.text.find(notice)
                while at >= 0:
                    want.add((r.doc_id, name, at, at + len(notice.rstrip("."))))
                    at = r.text.find(notice, at + 1)
    assert want and want <= got
    assert got == want, (got - want)


def longest_common(a, b):
    """Most words in common order, the whole of both."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(max(row[k] + 1 if x == y else 0, row[k + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("name", ["BSD-3-Clause", "CC0-1.0", "GPL-3.0", "MIT", "CC-BY-NC-4.0", "All-Rights-Reserved"])
def test_edited_notices(spark, name):
    """A notice that keeps its coverage is found whatever was left out, replaced or put between its words."""
    rng = random.Random(name)
    words = license_scan.TEMPLATES[name][0].split()
    rows = []
    for k in range(60):
        own = list(words)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([[], ["zz"], [own[at], "yy"]])
            own = own or ["zz"]
        rows.append((k, "é before. " * rng.randint(0, 5) + " ".join(own).upper() + " after", own))
    docs = spark.createDataFrame([(k, t, 1) for k, t, _ in rows], "doc_id long, text string, words int")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).where(f"license = '{name}' AND form = 0").collect()}
    template = license_scan.cut(license_scan.TEMPLATES[name][0])[0]
    needed = set(license_scan.cut(name)[0]) & set(template) if len(template) < license_scan.SHORT else set()
    most = 0
    for k, text, own in rows:
        edited = license_scan.cut(" ".join(own))[0]
        common = longest_common(template, edited)
        # Words put between those of a long template may break all its runs of GRAM + WINDOW - 1 words.
        unbroken = len(template) < license_scan.SHORT or len(edited) <= len(template)
        if common >= license_scan.COVERAGE * len(template) and needed <= set(edited) and unbroken:
            most += common < len(template)
            assert got[k].matched == common, (own, got.get(k))
            span = text[got[k].start : got[k].end]
            assert longest_common(template, license_scan.cut(span)[0]) == common and span == span.strip()
        if common < license_scan.COVERAGE * len(template):
            assert k not in got
    assert most or len(template) < 5


def test_whole_licenses(spark):
    """Texts of licenses, wrapped and with some words changed, and the notices inside them count once."""
    rng = random.Random(7)
    rows = []
    for name, forms in license_scan.TEMPLATES.items():
        for text in forms:
            words = text.split()
            if len(words) > 40:
                for at in rng.sample(range(len(words)), len(words) // 12):
                    words[at] = words[at] if words[at] in ("Affero", "Lesser") else "changed"  # these alone tell licenses apart
                rows.append((len(rows), "// " + " ".join(w + ("\n// " if k % 11 == 10 else "") for k, w in enumerate(words)), name))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {}
    for r in license_scan.scan_licenses(docs).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert len(rows) > 10
    for k, _, name in rows:
        assert name in got[k], (name, got.get(k))
    few = license_scan.scan_licenses(docs, {"none": ("",), "marks": ("...",)})
    assert few.count() == 0


def test_license_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "Released under the MIT License."), (3, "Released under the MIT License. " * 3), (3, "x")], "doc_id long, text string")
    got = Counter((r.doc_id, r.license) for r in license_scan.scan_licenses(docs).collect())
    assert got == {(None, "MIT"): 1, (3, "MIT"): 3}
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


def members(spark, seed, n=400, k=3):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.3] * k, n)
    tokens = rng.integers(0, 500, n)
    return p, tokens, spark.createDataFrame([(int(t), [float(x) for x in row]) for t, row in zip(tokens, p)], "n_tokens long, posterior array<double>")


@pytest.mark.parametrize("seed", [1, 2])
def test_rates_meet_the_targets(spark, seed):
    p, tokens, df = members(spark, seed)
    plan = mixing.solve(df, np.array([0.7, 0.25, 0.05]))
    rates = plan.rates(p)
    assert (rates >= 0).all()
    totals = (rates * tokens) @ p
    assert np.allclose(totals, plan.targets, atol=2e-4 * tokens.sum()) and np.allclose(totals, plan.totals)
    # Where no rate reaches zero, nothing nearer to 1 in the token metric does: the rates are 1 - p u.
    now = tokens @ p / tokens.sum()
    rates = mixing.solve(df, now + [0.02, -0.01, -0.01]).rates(p)
    u, *_ = np.linalg.lstsq(p, 1 - rates, rcond=None)
    assert rates.min() > 0 and np.allclose(1 - p @ u, rates)


def test_infeasible_targets_are_least_squares(spark):
    df = spark.createDataFrame([(10, [0.5, 0.5]), (20, [0.5, 0.5]), (0, [0.1, 0.9])], "n_tokens long, posterior array<double>")
    plan = mixing.solve(df, np.array([0.9, 0.1]), rounds=80)
    assert np.allclose(plan.totals, [15, 15], atol=0.2)


def test_an_anchor_only_thins_others(spark):
    p, tokens, df = members(spark, 3)
    now = tokens @ p
    plan = mixing.solve(df, np.array([0.9, 0.04, 0.06]), anchor=0)
    assert np.isclose(plan.targets[0], now[0]) and (plan.targets <= now + 1e-6).all()
    few = spark.createDataFrame([(100, [1.0, 0.0])] * 50 + [(1, [0.0, 1.0])], "n_tokens long, posterior array<double>")
    assert mixing.solve(few, np.array([0.9, 0.1]), anchor=0).rates(np.array([[0.0, 1.0]]))[0] < 1.5


def test_domains_of_rows_that_were_not_learnt_from(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(900):
        domain = ("toxic", "junk", "clean", "clean", "clean")[i % 5]
        text = [*rng.choice(words, 40), *({"toxic": ["scold", "sneer", "jeer"], "junk": ["buy", "click", "win"]}.get(domain, []))]
        rows.append((i, " ".join(rng.permutation(text)), domain))
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    model = mixing.fit_domains(df.where("doc_id < 600").select(word_hashes(F.col("text")).alias("words"), "domain", (F.col("doc_id") % 4 == 0).alias("later")))
    rest = df.where("doc_id >= 600").withColumn("truth", F.col("domain")).withColumn("words", word_hashes(F.col("text")))
    got = mixing.memberships(rest, model, keep=("doc_id", "truth")).collect()
    assert len(got) == 300 and np.mean([model.domains[int(np.argmax(r.posterior))] == r.truth for r in got]) > 0.98


def test_evidence_against_plain_python():
    rng = np.random.default_rng(4)
    words = np.sort(rng.choice(mixing.BUCKETS, 50, replace=False))
    weights = rng.random((50, 3))
    model = mixing.DomainModel(list("abc"), words, weights, np.vstack([np.zeros(3), rng.random((6, 3))]))
    texts = [[], [int(words[3])] * 4, *([int(x) + mixing.BUCKETS * int(rng.integers(-5, 5)) for x in rng.choice(np.concatenate([words, [7, 8, 9]]), n)] for n in (1, 5, 40))]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = model.evidence(np.array([w for t in texts for w in t], np.int64), bounds)
    at = {int(w): k for k, w in enumerate(words)}
    for row, text in zip(got, texts):
        own = {w % mixing.BUCKETS for w in text}
        hit = [weights[at[w]] for w in own if w in at]
        for d in range(3):
            assert np.isclose(row[d], np.sqrt(sum(x[d] ** 2 for x in hit))) and np.isclose(row[3 + d], mixing.TYPICAL * sum(x[d] for x in hit) / max(1, len(own)))
    p = model.posteriors(np.array([w for t in texts for w in t], np.int64), bounds)
    z = model.calibration[0] + got @ model.calibration[1:]
    assert np.allclose(p, np.exp(z) / np.exp(z).sum(axis=1, keepdims=True))


def test_anchor_rows_stay(spark):
    """Rows that are likeliest of the anchor are never thinned, whatever else they may be."""
    p = np.array([[0.6, 0.4]] * 300 + [[0.1, 0.9]] * 100)
    df = spark.createDataFrame([(10, [float(x) for x in row]) for row in p], "n_tokens long, posterior array<double>")
    rates = mixing.solve(df, np.array([0.99, 0.01]), anchor=0).rates(p)
    assert rates[:300].min() >= 1 and rates[300:].max() < 0.2


def test_mixing_documents(spark):
    documents, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    got = mixing.mix(documents, labels).collect()
    p = np.array([r.posterior for r in got])
    assert len(got) == documents.count() and np.allclose(p.sum(axis=1), 1)
    totals = (np.array([r.rate * r.n_tokens for r in got])) @ p
    assert np.allclose(totals / totals.sum(), [0.95, 0.04, 0.01], atol=1e-3)
    own = {r.doc_id: r for r in got}
    right = [own[r.doc_id].domain == ("toxic" if r.toxic else "clean" if r.quality else "junk") for r in labels.collect()]
    assert np.mean(right) > 0.9
    assert all(int(r.rate) <= r.n_copies <= r.rate + 1 for r in got)


def test_mixing_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "d e", "x"), (3, "f f", "x"), (4, None, "x"), (None, "", None), (1, "a b c", "x")], "doc_id long, text string, rate string")
    assert mixing.mix(docs, labels).count() == 6
    kept = mixing.apply_mix(docs, labels, anchor="clean")
    assert kept.columns == docs.columns and [r.text for r in kept.where("doc_id = 1").collect()] == ["a b c"] * 2
    assert {r.rate for r in mixing.mix(docs, labels.limit(0)).collect()} == {1.0}
    assert mixing.mix(docs.limit(0), labels).count() == mixing.apply_mix(docs.limit(0), labels).count() == 0


def test_pipeline(spark):
    """Each stage on its own input, by the operator's own results on it."""
    docs = table(spark, DATA, "documents")
    labels = {r.doc_id: r for r in table(spark, DATA, "labels").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, DATA), name)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns
    rows = lambda name: tuple(Counter(r.doc_id for r in df.collect()) for df in seen[name])
    before, after = rows("quality")
    gone = before - after
    known = [labels[i].quality for i in gone if i in labels]
    assert np.mean(known) < 0.1 and not after - before
    stayed = [labels[i].quality for i in after if i in labels]
    assert np.mean(stayed) > 0.97
    before, after = rows("near")
    classes = {r.class_id for r in ngram_join.similarity_join(seen["near"][0]).collect()}
    assert set(after) == classes and max(after.values()) == 1
    old, new = ({r.doc_id: r for r in df.collect()} for df in seen["secrets"])
    assert set(old) == set(new)
    for i, r in old.items():
        spans = secret_scan.find(r.text, secret_scan.RULES)
        assert (new[i].text == r.text) == (not spans) and new[i].n_chars == len(new[i].text)
        assert not secret_scan.find(new[i].text, secret_scan.RULES)
    before, after = rows("mixing")
    clean = [i for i in before if i in labels and labels[i].quality and not labels[i].toxic]
    toxic = [i for i in before if i in labels and labels[i].toxic]
    assert np.mean([i in after for i in clean]) > 0.99
    assert np.mean([i in after for i in toxic]) < 0.3
    pieces = seen["packing"][1].collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == after
    assert {r.doc_id for r in packing.pack(seen["packing"][0]).collect()} == set(after)
    scores = quality_classifier.with_score(seen["quality"][0], table(spark, DATA, "labels"), quality_classifier.third()).where("score >= 0.5")
    assert Counter(r.doc_id for r in scores.select("doc_id").collect()) == rows("quality")[1]


def test_applied_shares_meet_the_targets(spark):
    """Labelled rows of three domains, toxic ones twelve times their target: some must stay, and clean ones too."""
    rows = [(i, ("clean", "junk", "toxic")[0 if i % 100 < 80 else 1 if i % 100 < 88 else 2]) for i in range(20000)]
    docs = spark.createDataFrame([(i, f"{d} a b c d e f g h i") for i, d in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(d != "junk"), int(d == "toxic")) for i, d in rows], "doc_id long, quality int, toxic int")
    got = Counter(r.text.split()[0] for r in mixing.apply_mix(docs, labels, anchor="clean").collect())
    shares = {d: got[d] / sum(got.values()) for d in mixing.TARGETS}
    assert got["clean"] == 16000 and all(abs(shares[d] - t) < 0.15 * t for d, t in mixing.TARGETS.items()), shares


def test_labels_count_beyond_the_sample(spark, monkeypatch):
    """More labels than are learnt from: each labelled row still belongs to its own domain, a domain that the sample lacks included."""
    monkeypatch.setattr(mixing, "LABELLED", 40)
    rows = [(i, ("junk", "clean", "clean")[i % 3] if i else "toxic") for i in range(600)]
    docs = spark.createDataFrame([(i, f"{d} a b") for i, d in rows], "doc_id long, text string")
    # Half of the labels contradict what the words say.
    named = {i: "clean" if d == "junk" and i % 2 else d for i, d in rows}
    labels = spark.createDataFrame([(i, int(d != "junk"), int(d == "toxic")) for i, d in named.items()], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in mixing.mix(docs, labels, trust_labels=True).collect()}
    assert {i: r.domain for i, r in got.items()} == named and all(max(r.posterior) == 1 for r in got.values())
