"""Typed relations against plain Python, the allowed schema and schemas from text."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import relations as R


def plain(rows, window, labels=(), allowed=()):
    n, docs, has, files = Counter(), defaultdict(set), defaultdict(set), set()
    for file, text in rows:
        words = (text or "").split(" ")
        found = []
        for place, w in enumerate(words):
            name = "".join(x for x in w if x.isascii() and x.isalpha())
            if len(name) > 3 and name[0].isupper() and name[1:].islower():
                label = "Short" if len(name) <= 5 else "Mid" if len(name) <= 8 else "Long"
                before = words[place - 1] if place else ""
                via = before.upper() if len(before) > 1 and all("a" <= x <= "z" for x in before) else "NEXT_TO"
                if not labels or label.lower() in [x.lower() for x in labels]:
                    found.append((place, name, label, via))
        for i, (p, a, la, _) in enumerate(found):
            files.add(file)
            has[a].add(file)
            for q, b, lb, via in found[i + 1 :]:
                key = (a, la, via, b, lb)
                if q <= p + window and a != b and (not allowed or (la.lower(), via.lower(), lb.lower()) in [tuple(x.lower() for x in t) for t in allowed]):
                    n[key] += 1
                    docs[key].add(file)
    return {(*k, n[k], len(docs[k]), len(has[k[0]]), len(has[k[3]]), len(files)) for k in n}


ROWS = [
    ("a", "Alice works at Microsoft in Paris"), ("a", "Alice works at Microsoft in Paris"), ("b", "then Alice, of Microsoft"), ("b", "Alice Paris Alice"),
    ("c", "London is far far far far far far far far away from Microsoft"), (None, "Paris near the Washington"), (None, "Alice at Microsoft"), ("d", None), ("e", ""), ("f", "nothing here"),
    *((f"g{k}", "Maria met the Consortium " * 30) for k in range(40)),
]


@pytest.mark.parametrize("labels, allowed", [((), ()), (("short", "LONG"), ()), (("Short", "Long"), (("Short", "at", "long"), ("Long", "NEXT_TO", "Short")))])
@pytest.mark.parametrize("window", [1, 4, 8])
def test_triples(spark, window, labels, allowed):
    chunks = spark.createDataFrame(ROWS, "file string, text string").repartition(3)
    got = [tuple(r) for r in R.triples(chunks, window, list(labels), list(allowed)).collect()]
    assert len(got) == len({*got}) and {*got} == plain(ROWS, window, labels, allowed)


def test_no_documents(spark):
    found = R.triples(spark.createDataFrame([], "file string, text string"))
    assert found.count() == 0 and R.infer_schema(R.relations(found)).count() == 0


def test_relations_are_more_than_chance_and_of_one_type(spark):
    triple = lambda kind, docs, target="B": ("A", "X", kind, target, "Y", docs, docs, 10, 20, 100)
    rows = [triple("SEES", 4), triple("MEETS", 4), triple("KNOWS", 3), triple("ONCE", 1, "C"), triple("CHANCE", 2, "D"), triple("LESS", 2, "E")[:8] + (21, 100)]
    found = spark.createDataFrame(rows, "source string, source_label string, type string, target string, target_label string, n long, docs long, source_docs long, target_docs long, n_docs long")
    got = {tuple(r) for r in R.relations(found).collect()}
    assert got == {("A", "X", "MEETS", "B", "Y", 4, 2000), ("A", "X", "CHANCE", "D", "Y", 2, 1000)}


def test_allowed_schema():
    assert R.allowed_schema(" Person, Company ,", "Person,WORKS_AT,Company") == (["Person", "Company"], [("Person", "WORKS_AT", "Company")])
    assert R.allowed_schema("", "") == ([], [])
    for nodes, wrong in (("Person", "Person,KNOWS"), ("Person", "Person,WORKS_AT,Company"), ("", "A,B,C")):
        with pytest.raises(ValueError):
            R.allowed_schema(nodes, wrong)


def test_schemas(spark):
    texts = ["Person-WORKS_AT->Company and `Person`-KNOWS->'Person'", "// (p:Person)-[:WORKS_AT]->(:Company)", None, "", "a - b > c", "Company -[r:OWNS]-> (Car)"]
    got = {tuple(r) for r in R.described_schema(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == {("Person-WORKS_AT->Company", 2), ("Person-KNOWS->Person", 1), ("Company-OWNS->Car", 1)}
    found = spark.createDataFrame([("P", "KNOW", "P"), ("P", "KNOWS", "P"), ("P", "KNOW", "C")], "source_label string, type string, target_label string")
    assert {tuple(r) for r in R.infer_schema(found, 1).collect()} == {("P-KNOW->P", 1), ("P-KNOWS->P", 1), ("P-KNOW->C", 1)}
    assert {tuple(r) for r in R.schema_among(found, ["P"], ["KNOW"]).collect()} == {("P-KNOW->P", 1)}


def test_entities_of_a_chunk_are_found_once(spark):
    """Finding them may be a model's work, so a condition on their number must not find them again."""
    calls = spark.sparkContext.accumulator(0)

    def find(text):
        calls.add(1)
        return [(k, w) for k, w in enumerate(text.split(" ")) if w.istitle()]

    rows = [(f"f{k % 7}", f"Alice met Carol{'abc'[k % 3]}") for k in range(30)]
    found = R.triples(spark.createDataFrame(rows, "file string, text string"), extractor=F.udf(find, "array<struct<place int, entity string>>"))
    assert found.count() == 3 and calls.value == len(rows)


def test_equal_descriptions_are_read_once(spark):
    """The notation is looked for behind the count of equal texts, so its work does not grow with their copies."""
    texts = ["A-R->B and A-S->B", None, "(:A)-[:R]->(:B)", "nothing"]
    found = R.described_schema(spark.createDataFrame([(t,) for t in texts * 20], "text string"))
    assert {tuple(r) for r in found.collect()} == {("A-R->B", 40), ("A-S->B", 20)}
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert max(k for k, line in enumerate(plan) if "regexp_extract_all" in line) < max(k for k, line in enumerate(plan) if "Aggregate" in line)
