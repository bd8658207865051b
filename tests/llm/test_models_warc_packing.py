"""Learnt operators by held-out accuracy, the WARC writer by its round trip, packing by brute force."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.llm import common, language_id, packing, quality_classifier, warc

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def held(doc_id, mod, rest):
    return zlib.crc32(str(doc_id).encode()) % mod == rest


def test_quality_on_held_out_rows(spark, documents, labels):
    got = {r.doc_id: r for r in quality_classifier.score_quality(documents, labels, quality_classifier.third()).collect()}
    assert len(got) == documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == held(r.doc_id, 3, 1) for r in got.values())
    pairs = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [s for s, q in pairs if q], [s for s, q in pairs if not q]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    accuracy = np.mean([(s >= 0.5) == q for s, q in pairs])
    assert auc > 0.95 and accuracy > 0.95, (auc, accuracy)


def test_normal_equations_and_scores_against_numpy(spark):
    rng = np.random.default_rng(2)
    stats = rng.normal(size=(300, quality_classifier.N_STATS))
    y = (stats[:, 0] + stats[:, 3] > 0).astype(float)
    df = spark.createDataFrame([([float(v) for v in s], float(v)) for s, v in zip(stats, y)], "stats array<double>, y double").repartition(7)
    zero = np.zeros(0)
    model = quality_classifier.QualityModel(stats.mean(0), stats.std(0), rng.normal(size=(quality_classifier.N_STATS, 16)), rng.uniform(0, 6, 16), zero, zero, zero)
    x = np.hstack([np.sqrt(2 / 16) * np.cos((stats - stats.mean(0)) / stats.std(0) @ model.omega + model.phase), np.ones((300, 1))])
    assert np.allclose(quality_classifier._normal_equations(df, model, 17), np.column_stack([x.T @ x, x.T @ y]))
    labelled = spark.createDataFrame([(k, [float(v) for v in s]) for k, s in enumerate(stats)], "doc_id long, stats array<double>")
    fitted = quality_classifier.fit_quality(labelled, spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id long, quality int"))
    # Scores rise with raw scores, and raw scores are those of the features.
    raw, score = fitted.raw(stats), fitted.score(stats)
    assert np.allclose(raw, fitted.features(stats) @ fitted.weights) and (np.diff(score[np.argsort(raw)]) >= 0).all() and np.mean((score >= 0.5) == y) > 0.9


def test_quality_edges(spark, labels):
    docs = spark.createDataFrame([(1, ""), (2, None), (None, "x"), (2, "word " * 50), (4, "é" * 5)], "doc_id long, text string")
    none = labels.limit(0)
    assert [r.score for r in quality_classifier.score_quality(docs, none, quality_classifier.third()).collect()] == [0.5] * 5
    some = spark.createDataFrame([(1, 0), (2, 1), (2, None), (None, 1), (4, 1)], "doc_id long, quality int")
    assert quality_classifier.score_quality(docs, some, quality_classifier.third()).count() == 5
    assert quality_classifier.score_quality(docs.limit(0), some, quality_classifier.third()).count() == 0
    assert quality_classifier.with_score(docs, some, quality_classifier.third()).columns == ["doc_id", "text", "score"]


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = random.Random(3)
    x = np.arange(50.0)
    y, w = np.array([rng.random() for _ in x]), np.array([rng.randint(1, 9) for _ in x], float)
    at, level = quality_classifier.isotonic(x, y, w)
    assert (np.diff(level) > 0).all() and (np.diff(at) > 0).all()
    # Brute force: the largest mean over starts of the smallest over ends.
    want = [max(min(np.average(y[a:b], weights=w[a:b]) for b in range(k + 1, 51)) for a in range(k + 1)) for k in range(50)]
    assert np.allclose(sorted(set(np.round(want, 9))), np.round(level, 9))


def test_languages_on_held_out_rows(spark, documents):
    got = {r.doc_id: r for r in language_id.identify(documents, language_id.fourth()).collect()}
    rows = documents.collect()
    assert len(got) == len(rows) and all(r.held_out == held(r.doc_id, 4, 2) for r in got.values())
    right = [got[r.doc_id].lang_pred == r.lang for r in rows if got[r.doc_id].held_out and r.lang]
    assert np.mean(right) > 0.97, np.mean(right)


def test_language_counts_match_plain_python(spark):
    """Slices of a long text give the n-grams of the whole."""
    text = "".join(random.Random(5).choices("abc é\U0001f600", k=3 * language_id.SLICE // 2))
    for value in ("", "a", text):
        padded = " " + value.lower() + "  "
        for order in language_id.ORDERS:
            grams = [padded[i : i + order] for i in range(len(value) + 1)]
            want = Counter()
            for g, n in Counter(grams).items():
                want[int(language_id._buckets(np.frombuffer(g.encode("utf-32-le"), np.uint32), order)[0])] += n
            have = Counter()
            for codes, bounds, _ in language_id._blocks([value]):
                ids = language_id._buckets(codes, order)
                for start, end in bounds:
                    have.update(ids[start:end].tolist())
            assert have == want


def test_language_scores_against_plain_python(spark):
    """Counts, log probabilities and posteriors by dictionaries."""
    rng = random.Random(6)
    rows = [("".join(rng.choices("abcdef " if lang == "x" else "defghi ", k=rng.randint(0, 60))), lang) for lang in "xyx" for _ in range(15)]
    model = language_id.fit_languages(spark.createDataFrame(rows, "text string, lang string").repartition(5))

    def buckets(text):
        padded = " " + text.lower() + "  "
        grams = [padded[i : i + order] for order in language_id.ORDERS for i in range(len(text) + 1)]
        return [int(language_id._buckets(np.frombuffer(g.encode("utf-32-le"), np.uint32), len(g))[0]) for g in grams]

    counts = {lang: Counter(b for t, own in rows if own == lang for b in buckets(t)) for lang in "xy"}
    prior = Counter(lang for _, lang in rows)
    texts = ["abc", "ghi fed", "", "d", "a cab deaf hig"]
    got = model.predict(texts)
    for text, lang, score in zip(texts, *got):
        logs = [np.log(prior[x] / len(rows)) + sum(np.log((counts[x][b] + 0.5) / (sum(counts[x].values()) + 0.5 * language_id.BUCKETS)) for b in buckets(text)) for x in "xy"]
        p = np.exp(logs - np.logaddexp(*logs))
        assert (lang, score) == ("und", 0) if not text else (lang == "xy"[int(np.argmax(p))] and abs(score - p.max()) < 1e-4)


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !", "fr"), (None, "le la", "fr"), (5, "the of", None), (6, "the and of", "en"), (6, "the and of", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs, language_id.fourth()).collect()
    assert len(got) == 7 and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert language_id.identify(docs.limit(0), language_id.fourth()).count() == 0
    nothing = docs.withColumn("lang", docs["lang"].substr(9, 0)).where("lang != ''")
    assert language_id.identify(nothing, language_id.fourth()).count() == 0


PAGES = [
    (1, "http://a/ b\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (9, "http://e", "<p>é</p>"),
    (9, "http://f", "<p>é</p>"), (9, "http://g", "other\r\n\r\nWARC/1.1"), (None, "http://h", "<p>é</p>"), (None, "http://i", "alone"), (10**12, "http://j", "x" * 5000),
]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    base = f"file://{tmp_path}/a"
    warc.write(pages, base, roll_bytes=1500, shard_bytes=2000)
    got = warc.read(spark, base).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((p, len((h or "").encode()), digest(h)) for p, _, h in PAGES)
    kinds = defaultdict(list)
    for r in got:
        kinds[r.page_id, r.payload_digest].append((r.record_type, r.refers_to))
    e = digest("<p>é</p>")
    assert kinds[1, e] == kinds[2, e] == kinds[None, e] == [("revisit", 9)]
    assert sorted(kinds[9, e], key=str) == [("response", None), ("revisit", 9)]
    assert kinds[3, digest("")] == [("revisit", 4)] and kinds[4, digest("")] == [("response", None)]
    # Plain gzip reads the files; the same pages in another order give the same files.
    files = {p.name: p.read_bytes() for p in (tmp_path / "a").glob("*.warc.gz")}
    assert len(files) > 1 and b"".join(map(gzip.decompress, files.values())).count(b"WARC/1.1\r\nWARC-Type: re") == len(PAGES)
    warc.write(pages.repartition(1), f"file://{tmp_path}/b", roll_bytes=1500, shard_bytes=2000)
    assert files == {p.name: p.read_bytes() for p in (tmp_path / "b").glob("*.warc.gz")}
    assert not (tmp_path / "a/_temporary").exists()


def test_warc_least_and_empty(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/a", least=9)
    kinds = {(r.page_id, r.payload_bytes): r.record_type for r in warc.read(spark, f"file://{tmp_path}/a").collect()}
    assert kinds[3, 0] == "response" and kinds[1, 9] == "revisit"
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_shards_are_exact_sums_of_bytes(spark):
    """Whatever the ranges and the gaps: a shard is where the bytes of all smaller ids end; a task is a run of shards."""
    rng = random.Random(4)
    rows = [(i, rng.randrange(0, 90)) for i in [*range(1000), *range(10**15, 10**15 + 1000), 5, 5, None, -7]]
    ids = spark.createDataFrame(rows, "page_id long, bytes long").repartition(5)
    sums, before, want = Counter(), 0, {}
    for i, n in rows:
        if i is not None:
            sums[i] += n
    for i in sorted(sums):
        want[i] = (before, before // 500)
        before += sums[i]
    for ranges in (1, 7, 64):
        assert {r.page_id: (r.before, r.shard) for r in warc.planned(ids, 500, ranges).collect()} == want
    starts = warc.task_starts(ids, 500)
    assert starts == sorted({s: (i, b) for i, (b, s) in sorted(want.items(), reverse=True)}.values())
    assert 2 <= len(warc.task_starts(ids, 500, tasks=7)) <= 7 and warc.task_starts(ids, 500, tasks=1) == starts[:1]
    assert warc.task_starts(ids.limit(0), 500) == []


def test_binary_rank(spark):
    for cuts in ([], [3], [1, 2, 5, 9, 12], list(range(0, 300, 3))):
        rows = spark.range(-2, 310).select("id", common.rank_among(cuts, F.col("id")).alias("r")).collect()
        assert all(r.r == sum(c < r.id for c in cuts) for r in rows)


def test_summed_arrays(spark):
    rows = [(k % 7, [float(k), 1.0]) for k in range(100)]
    df = spark.createDataFrame(rows, "i int, v array<double>").repartition(9)
    for fan in (2, 256):
        got = {r.i: r.v for r in common.summed_arrays(df, "i", "v", fan).collect()}
        assert got == {i: [sum(v[0] for k, v in rows if k == i), sum(k == i for k, _ in rows)] for i in range(7)}
    assert common.summed_arrays(df.limit(0), "i", "v").count() == 0


def plain_ids(texts):
    return [e.ids + [0] for e in packing._tokenizer(packing.default_tokenizer()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = [None, "", " ", "a", "Ünïcode ΣΑΣ 'S don't I'LL 12345 \x1c a\x1db \x85 \xa0x y", "<|endoftext|> a<|startoftext|>b", "é ́ x", "ﬁ İstanbul ſ K", "\U0001f600‍\U0001f600 の日本語 ab", "x" * 300, "word, " * 1500, "'s't 're_x __ --- ..."]


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_packing(spark, documents, which):
    docs = documents if which == "documents" else spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, length int")
    got = packing.pack(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    ids = dict(zip([r.doc_id for r in rows], plain_ids([r.text for r in rows])))
    want = {}
    for doc, all_ids in ids.items():
        for piece, start in enumerate(range(0, len(all_ids), 2048)):
            own = all_ids[start : start + 2048]
            want[doc, piece] = (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= len(best_fit([n for _, n, _ in want.values()]))


def best_fit(lengths):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= n]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - n)
        else:
            rooms.append(2048 - n)
    return rooms


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for trial in range(300):
        cap = rng.choice([10, 64, 2048])
        lengths = [min(cap, int(rng.expovariate(3 / cap)) + 1) for _ in range(rng.randint(0, 400))]
        rooms = []
        for n in sorted(lengths, reverse=True):
            fitting = [r for r in rooms if r >= n]
            if fitting:
                rooms.remove(min(fitting))
                rooms.append(min(fitting) - n)
            else:
                rooms.append(cap - n)
        used = Counter()
        for length, rank, n, first, each, offset in packing.plan(dict(Counter(lengths)), cap):
            for k in range(n):
                used[first + k // each] += length
        assert sum(used.values()) == sum(lengths) and max(used.values(), default=0) <= cap
        assert len(used) == len(rooms)


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="not a tokenizer"):
        packing.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_runs_over_many_blocks_of_ranks(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKS", 4)
    docs = spark.createDataFrame([(i, "a b c" if i % 3 else "d " * (i % 40)) for i in range(200)], "doc_id long, text string")
    got = packing.pack(docs, capacity=50).collect()
    assert {(r.doc_id, r.piece) for r in got} >= {(i, 0) for i in range(200)} and len(got) == len({(r.sequence_id, r.offset) for r in got})
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 50


def test_packing_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    got = packing.pack(docs).collect()
    assert len(got) == 4 and len({(r.sequence_id, r.offset) for r in got}) == 4
    assert packing.pack(docs.limit(0)).count() == 0
