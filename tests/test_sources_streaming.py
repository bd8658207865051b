"""Files, sinks and streams."""

import json
import time

from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.sources import files as S
from tessera.sources import sinks as K
from tessera.streaming import status, transcript


def test_read_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("één\fzwei".encode())
    (tmp_path / "b.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "c.html").write_text("<html><script>x</script><p>One &amp; two</p><!-- no --><p>three</p></html>")
    (tmp_path / "d.bin").write_bytes(b"x,y")
    got = {(r.file, r.page_number): r.text for r in S.read_pages(spark, f"file://{tmp_path}", decoders={".bin": lambda b: b.decode().split(",")}).collect()}
    assert got == {("a.txt", 1): "één", ("a.txt", 2): "zwei", ("b.txt", 1): "café", ("c.html", 1): "One & two\nthree", ("d.bin", 1): "x", ("d.bin", 2): "y"}
    assert {(r.name, r.size) for r in S.list_files(spark, f"file://{tmp_path}", "*.txt").collect()} == {("a.txt", 10), ("b.txt", 4)}


def test_repaging_and_transcripts(spark):
    rows = [("f", 1, "Text", "a"), ("f", 2, "Text", "b"), ("f", 3, "PageBreak", ""), ("f", 4, "Text", "c")]
    got = {r.page: r.text for r in S.repage(spark.createDataFrame(rows, "file string, seq int, kind string, text string")).collect()}
    assert got == {1: "a b", 2: "c"}
    pieces = spark.createDataFrame([("v", 1.0, "b"), ("v", 0.0, "a")], "video string, start double, text string")
    assert S.transcript_text(pieces).head().text == "a b"


def test_windows_after_a_gap(spark):
    rows = [("v", float(s), str(s)) for s in (0, 59, 60, 61, 200, 201)]
    got = [r.text for r in transcript.transcript_windows(spark.createDataFrame(rows, "video string, start double, text string")).orderBy("window_no").collect()]
    assert got == ["0 59 60", "61 200", "201"]


def test_importer_json():
    graph = {
        "nodeLabels": [{"$id": "l1", "token": "Person"}, {"$id": "l2", "token": "City"}],
        "relationshipTypes": [{"$id": "t1", "token": "LIVES_IN"}],
        "nodeObjectTypes": [{"$id": "n1", "labels": [{"$ref": "#l1"}]}, {"$id": "n2", "labels": [{"$ref": "#l2"}]}],
        "relationshipObjectTypes": [{"type": {"$ref": "#t1"}, "from": {"$ref": "#n1"}, "to": {"$ref": "#n2"}}],
    }
    text = json.dumps({"dataModel": {"graphSchemaRepresentation": {"graphSchema": graph}}})
    assert S.importer_triples(text) == [("Person", "LIVES_IN", "City")]


def test_schema_templates(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"schema": "s1", "triplet": ["A-R->B"]}, {"schema": "s2", "labels": ["A"], "relationshipTypes": ["R"]}]))
    got = {r.schema: (r.triplets, r.types) for r in S.schema_templates(spark, f"file://{tmp_path}/t.json").collect()}
    assert got == {"s1": (["A-R->B"], None), "s2": ([], ["R"])}


def test_upserted_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert K.read_version(spark, path) is None
    K.write_upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, ["k"])
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert K.write_upsert(new, path, ["k"]) == 2 and K.write_upsert(new, path, ["k"]) == 3
    assert sorted(map(tuple, K.read_version(spark, path).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_parts_are_merged_in_order(spark, tmp_path):
    for k in range(1, 12):
        (tmp_path / f"x.bin_part_{k}").write_bytes(bytes([k]))
    (tmp_path / "y.bin_part_2").write_bytes(b"late")
    got = {r.name: bytes(r.content) for r in K.merge_parts(spark, f"file://{tmp_path}").collect()}
    assert got == {"x.bin": bytes(range(1, 12))}
    K.write_results(spark.createDataFrame([(1, "a")], "n int, v string"), f"file://{tmp_path}/out")
    assert [r.v for r in spark.read.option("header", True).csv(f"file://{tmp_path}/out").collect()] == ["a"]


EVENTS = [(1, "f1", "New"), (2, "f1", "Processing"), (3, "f2", "New"), (4, "f1", "Processing"), (5, "f1", "Completed"), (6, "f2", "Cancelled")]


def test_stream_of_states_equals_its_batch_twin(spark, tmp_path):
    schema = "seq long, file string, state string"
    for part in (EVENTS[:3], EVENTS[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(1)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        own = status.fold_changes(stream, "file", "state", "seq")
        query = own.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    got = sorted((r.key, r.seq, r.value) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    batch = status.changes(spark.createDataFrame(EVENTS, schema), "file", ["seq"], "state").orderBy("seq").collect()
    want, n = [], {}
    for r in batch:
        n[r.file] = n.get(r.file, 0) + 1
        want.append((r.file, n[r.file], r.state))
    assert got == sorted(want)


def test_maintained_table(spark, tmp_path):
    schema = "seq long, file string, state string"
    spark.createDataFrame(EVENTS, schema).repartition(3).write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        status.maintain(spark, f"file://{tmp_path}/in", schema, f"file://{tmp_path}/t", ["file"], ["seq"], f"file://{tmp_path}/cp").awaitTermination(120)
    assert {(r.file, r.state) for r in K.read_version(spark, f"file://{tmp_path}/t").collect()} == {("f1", "Completed"), ("f2", "Cancelled")}


def test_life_cycle():
    assert status.valid_step(None, "New") and status.valid_step("Processing", "Failed") and not status.valid_step("Completed", "New")
    assert status.backoff(1, 4) == [1, 2, 4, 8]


def test_nearest_neighbours_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float((i * 37) % 11), float(i % 7), 1.0]) for i in range(60)], "id long, embedding array<double>")
    want = {(r.id, r.neighbour, r.score) for r in R.nearest_neighbours(rows, 4).collect()}
    monkeypatch.setattr(R, "BLOCK", 13)
    assert {(r.id, r.neighbour, r.score) for r in R.nearest_neighbours(rows, 4).collect()} == want and len(want) == 240


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, words array<string>")
    lengths = empty.select("id", F.size("words").alias("length"))
    assert R.bm25(R.postings(empty), lengths, ["a"]).count() == 0
    top = R.vector_top(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id long, embedding array<double>"), [1.0, 0.0], 2)
    assert [r.id for r in top.collect()] == [1, 2]
    assert R.fuse(spark.createDataFrame([("a", 2.0), ("b", 1.0)], "id string, score double"), spark.createDataFrame([("b", 4.0)], "id string, score double")).where(F.col("score") == 1).count() == 2
