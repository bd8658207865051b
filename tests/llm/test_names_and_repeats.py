"""Stages keep columns whatever their names, and stand rows that repeat."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import license_scan, mixing, ngram_join, packing, quality_classifier, secret_scan

#: Names that the stages use for themselves, now or before.
NAMES = "row row_ nth_ all place wordless text_ copy copy_ copies_ key key_text id_ of_ score score_ blob blob_ spans spans_ y stats later held_out domain n_tokens rate".split()


def frame(spark):
    rows = [(k, f"word{k} and so on, password = abc{k}defgh " * 12, f"v{k}") for k in range(30)] + [(None, None, "x"), (3, "", "y")]
    return spark.createDataFrame([(d, t, *(f"{v}{n}" for n in NAMES)) for d, t, v in rows], ["doc_id", "text", *NAMES])


def others(rows):
    return sorted((str(r.doc_id), *(r[n] for n in NAMES)) for r in rows)


def test_clashing_names(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    want = others(docs.collect())
    for out in (ngram_join.deduplicate(docs), secret_scan.redact(docs)):
        assert out.columns == docs.columns and others(out.collect()) == want
    mixed = mixing.apply_mix(docs, labels, anchor="clean")
    assert mixed.columns == docs.columns and {*others(mixed.collect())} <= {*want} and mixed.count() > 0


def test_pipeline_stages_keep_other_columns(spark, tmp_path):
    docs = frame(spark)
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = others(docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", *NAMES], name
        assert {*others(docs.collect())} <= {*want}


def test_labels_of_one_id_do_not_multiply_rows(spark, monkeypatch):
    stats = spark.createDataFrame([(1, [float(k)] * quality_classifier.N_STATS) for k in range(300)], "doc_id long, stats array<double>")
    labels = spark.createDataFrame([(1, k % 2) for k in range(300)], "doc_id long, quality int")
    sizes = []
    kept = quality_classifier.materialize
    monkeypatch.setattr(quality_classifier, "materialize", lambda df, name: sizes.append(kept(df, name)) or sizes[-1])
    quality_classifier.fit_quality(stats, labels)
    assert sizes[0].count() == 300


def test_deduplicate_with_a_third_of_rows_equal(spark):
    rows = [(7, "one two three four five six seven")] * 300 + [(k, f"text number {k} has words of its own {k * 7} and {k * 11}") for k in range(300)] + [(None, "")] * 5
    got = ngram_join.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sum(r.text.startswith("one") for r in got if r.text) == 1 and sum(r.text == "" for r in got) == 5 and len(got) == 306


def test_a_repeated_text_is_scanned_once(spark, tmp_path, monkeypatch):
    rows = [(7, "password = abcdef1")] * 200 + [(None, "password = abcdef1")] * 100 + [(k, f"token = value{k}x") for k in range(300)] + [(None, None), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes, got = [], []
    scan = secret_scan.scan
    monkeypatch.setattr(secret_scan, "scan", lambda blobs, rules: sizes.append(blobs.count()) or scan(blobs, rules))
    for few in (0, secret_scan.FEW):
        monkeypatch.setattr(secret_scan, "FEW", few)
        got.append(sorted(map(str, secret_scan.scan_documents(docs, f"file://{tmp_path}/ledger{few}").collect())))
    assert sizes == [302, 302] and got[0] == got[1] and len(got[0]) == len(rows)
    assert sum("assign:0:18" in x for x in got[0]) == 300


def test_ranks_of_repeated_and_null_ids_are_dealt_evenly(spark):
    rows = [(None, "a b c")] * 3000 + [(5, "a b c")] * 3000 + [(k, "a") for k in range(1000)]
    pieces = packing.tokenize(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    pieces = packing.materialize(pieces, "pieces")
    largest = pieces.groupBy("length", F.pmod("salt", F.lit(16))).count().agg(F.max("count")).head()[0]
    assert largest < 2 * 6000 / 16
    got = packing.ranked(pieces, 16).groupBy("length").agg(F.count_distinct("rank").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.count("*").alias("rows")).collect()
    assert got and all(r.low == 0 and r.high + 1 == r.n == r.rows for r in got)
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    places = packed.groupBy("sequence_id").agg(F.sum("length").alias("sum"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("n"), F.count("*").alias("rows")).collect()
    assert packed.count() == 7000 and all(r["sum"] == r.end <= 2048 and r.n == r.rows for r in places)


def test_matches_that_overlap_better_ones_go():
    r = random.Random(5)
    for _ in range(300):
        found = []
        for _ in range(r.randrange(30)):
            start = r.randrange(60)
            found.append({"license": r.choice("abc"), "coverage": r.choice((0.5, 1.0)), "words": r.choice((4, 8)), "start": start, "end": start + r.randrange(1, 12)})
        kept = []
        for m in sorted(found, key=lambda x: (-x["coverage"], -x["words"])):
            shares = lambda x: (m["coverage"], m["words"]) == (x["coverage"], x["words"]) and m["license"] != x["license"]
            if all(m["end"] <= x["start"] or x["end"] <= m["start"] or shares(x) for x in kept):
                kept.append(m)
        assert license_scan.apart(found) == sorted(kept, key=lambda x: (x["start"], x["end"], x["license"]))


def test_repeated_rows_of_linked_texts_give_their_shingles_once(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    near = [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in (0, 59)]
    rows = [(7, " ".join(words))] * 150 + [(None, near[0])] * 50 + [(9, near[1]), (11, near[1])] + [(k, f"text {k} alone {k * 7} {k * 11}") for k in range(20, 220)]
    kept, sizes = ngram_join.materialize, {}

    def counted(df, name):
        out = kept(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    got = ngram_join.similarity_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    linked = {(r.doc_id, r.class_id, r.n_copies, r.n_links) for r in got if r.n_links}
    assert sizes["shingle-sets"] == 3 and len(got) == len(rows)
    assert linked == {(7, 7, 150, 201), (None, 7, 50, 201), (9, 7, 2, 201), (11, 7, 2, 201)}


def test_popular_texts_are_few_however_many_rows(spark, monkeypatch):
    rows = [(k, f"text {k // 40 if k < 400 else k} and more") for k in range(1000)]
    monkeypatch.setattr(ngram_join, "POPULAR", 50)
    got = ngram_join.similarity_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {(r.doc_id, r.class_id, r.n_copies) for r in got} == {(k, k // 40 * 40 if k < 400 else k, 40 if k < 400 else 1) for k in range(1000)}
