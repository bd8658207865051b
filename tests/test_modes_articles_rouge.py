"""Routing by mode, the Python data source in batch and as a stream, and the longest common subsequence."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import modes
from tessera.operators import reporting as P
from tessera.sources.articles import ArticleReader, ArticleSource

DOCS = "/root/testdata/sf0.001/documents.parquet"


def table_of(a, b):
    """The quadratic table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(40))
def test_common_subsequence(seed):
    r = random.Random(seed)
    a, b = ([r.choice("abcdefgh"[: 1 + seed % 8]) for _ in range(r.randrange(120))] for _ in range(2))
    assert P.common_subsequence(a, b) == table_of(a, b) == P.common_subsequence(b, a)


def test_long_sides():
    r = random.Random(1)
    common = [f"c{k}" for k in range(15_000)]
    with_others = lambda tag: [x for c in common for x in ([c] if r.random() < 0.7 else [f"{tag}{r.random()}", c])]
    assert P.common_subsequence(with_others("x"), with_others("y")) == 15_000


def test_rouge_l(spark):
    rows = [(1, "a b c d".split(), "b x d a".split()), (2, [], ["a"]), (3, None, ["a"]), (4, ["a"], ["a"]), (4, ["a"], ["a"]), (None, ["a", None], ["a"])]
    got = sorted(map(str, P.rouge_l(spark.createDataFrame(rows, "id int, a array<string>, b array<string>")).collect()))
    want = [(1, 0.5, 0.5, 0.5), (2, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0), (4, 1.0, 1.0, 1.0), (4, 1.0, 1.0, 1.0), (None, 1.0, 0.5, 0.6667)]
    assert got == sorted(f"Row(id={i}, precision={p}, recall={r}, f1={f})" for i, p, r, f in want)
    assert P.rouge_l(spark.createDataFrame([], "id int, a array<string>, b array<string>")).count() == 0


def test_modes(spark):
    rows = [(1, "vector", [" a "]), (2, "fulltext", ["a"]), (3, "fulltext", []), (4, "no such", None), (5, None, ["a"]), (6, "graph", ["a"])]
    asked = spark.createDataFrame(rows, "id int, mode string, files array<string>")
    got = {r.id: r for r in modes.resolve(asked).collect()}
    assert got[1].refusal is None and got[1].files == ["a"] and got[1].top_k == 5 and got[2].refusal == got[5].refusal == modes.REFUSAL
    assert got[4].answered_by == got[5].answered_by == modes.DEFAULT and got[4].mode == "no such" and got[6].refusal is None and got[6].top_k is None
    by = {m: lambda q, m=m: q.where("id != 3").select("id", F.lit(m).alias("message")) for m in [*(x[0] for x in modes.MODES), modes.GRAPH]}
    said = {r.id: r.message for r in modes.answer(asked, by).collect()}
    assert said == {1: "vector", 2: modes.REFUSAL, 3: None, 4: modes.DEFAULT, 5: modes.REFUSAL, 6: "graph"}
    with pytest.raises(ValueError):
        modes.answer(asked, {"vector": by["vector"]})
    with pytest.raises(ValueError):
        modes.resolve(asked.withColumn("label", F.lit(1)))


def test_articles(spark, tmp_path):
    spark.dataSource.register(ArticleSource)
    docs = spark.read.parquet(DOCS)
    docs.repartition(3).write.option("parquet.block.size", 1 << 14).parquet(f"file://{tmp_path}/d")
    plain = sorted((r.doc_id, r.lang or "", (r.text or "")[:50]) for r in docs.collect())
    for split in (1 << 12, 1 << 26):
        read = spark.read.format("articles").option("most", 50).option("split", split).load(f"file://{tmp_path}/d")
        assert sorted((r.doc_id, r.language or "", r.text or "") for r in read.collect()) == plain
    pieces = ArticleReader({"path": f"{tmp_path}/d", "split": str(1 << 12)}).partitions()
    assert len(pieces) > 3
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = spark.read.format("articles").option("most", 50).option("push", "true").load(f"file://{tmp_path}/d").where("language = 'fr' AND doc_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144) AND text != ''")
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "= fr" not in plan and " IN " not in plan and "Filter" in plan
        assert sorted((r.doc_id, r.language, r.text) for r in some.collect()) == [x for x in plain if x[1] == "fr" and x[0] in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144) and x[2]]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    os.mkdir(f"{tmp_path}/none")
    assert spark.read.format("articles").load(f"file://{tmp_path}/none").count() == 0


def test_articles_as_a_stream_go_on_at_their_offset(spark, tmp_path):
    spark.dataSource.register(ArticleSource)
    docs = spark.read.parquet(DOCS)
    folder, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    os.mkdir(folder)

    def taken():
        read = spark.readStream.format("articles").load(f"file://{folder}")
        read.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r.doc_id for r in spark.read.schema("doc_id long").parquet(out).collect())

    docs.where("doc_id < 50").coalesce(1).write.mode("append").parquet(f"file://{folder}")
    assert taken() == list(range(50))
    docs.where("doc_id BETWEEN 50 AND 80").coalesce(2).write.mode("append").parquet(f"file://{folder}")
    assert taken() == list(range(81))
    assert taken() == list(range(81))
