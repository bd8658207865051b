"""Stored tables follow their data."""

from tessera.plans import derived as D


def write(spark, folder, texts):
    rows = [(k, t, "en", "web", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{folder}/documents.parquet")


def test_stored_tables_are_made_anew_when_data_change(spark, tmp_path):
    folder = f"file://{tmp_path}"
    names = lambda: {r.entity for r in D.mentions(spark, folder).collect()}
    write(spark, folder, ["Alice met someone", "Maria did too"])
    first = D.mentions(spark, folder)
    assert names() == {"Alice", "Maria"} and D.mentions(spark, folder) is first and D.edges(spark, folder).count() == 0
    write(spark, folder, ["Robert met Alice"])
    assert names() == {"Robert", "Alice"} and D.edges(spark, folder).count() == 1
    second = D.mentions(spark, folder)
    D.rebuild(spark, folder)
    assert D.mentions(spark, folder) is not second and names() == {"Robert", "Alice"}


def test_state_of_no_files_changes_with_the_first(spark, tmp_path):
    (tmp_path / "documents.parquet").mkdir()
    before = D.state(spark, f"file://{tmp_path}", "documents")
    write(spark, tmp_path, ["Alice"])
    assert before == 0 != D.state(spark, f"file://{tmp_path}", "documents")


def test_edges_need_no_mentions_and_use_those_that_are_kept(spark, tmp_path):
    folder = f"file://{tmp_path}"
    write(spark, folder, ["Alice met Maria", "", "Maria saw Alice and Robert"])
    got = sorted(map(tuple, D.edges(spark, folder).collect()))
    assert got == [("Alice", "Maria", 2), ("Alice", "Robert", 1)] and not D.is_kept(spark, folder, "mentions")
    D.rebuild(spark, folder)
    D.mentions(spark, folder)
    assert D.is_kept(spark, folder, "mentions") and sorted(map(tuple, D.edges(spark, folder).collect())) == got
    write(spark, folder, ["Robert met Alice"])
    assert not D.is_kept(spark, folder, "mentions")
