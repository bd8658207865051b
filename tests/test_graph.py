"""Small graphs made by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.vectors import cosine, hashed_embedding, scaled
from tessera.operators import communities as C
from tessera.operators import curation as U
from tessera.operators import graph as G
from tessera.operators import ingest, models
from tessera.operators import reporting as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def rels(spark, edges):
    return spark.createDataFrame([("E", a, b) for a, b in edges], "type string, src string, dst string")


def test_neighbours_of_parallel_edges_and_loops(spark):
    r = rels(spark, [("a", "b"), ("a", "b"), ("b", "a"), ("a", "a")])
    got = sorted((x.neighbour, x.direction) for x in G.neighbours(r, spark.createDataFrame([("a",)], "node_id string")).collect())
    assert got == [("a", "out"), ("b", "in"), ("b", "out"), ("b", "out")]
    assert [(x.source, x.target, x.weight) for x in C.projection(r).collect()] == [("a", "b", 3)]
    assert G.neighbours(r, spark.createDataFrame([("z",)], "node_id string")).count() == 0


def test_paths_use_no_edge_twice(spark):
    r = rels(spark, [("a", "b"), ("b", "c"), ("c", "a")]).withColumn("rel_id", F.concat("src", "dst"))
    got = sorted((x.length, x.end) for x in G.paths(r, spark.createDataFrame([("a",)], "node_id string"), 3).collect())
    assert got == [(1, "b"), (1, "c"), (2, "b"), (2, "c"), (3, "a"), (3, "a")]
    ends = spark.createDataFrame([("c",)], "node_id string")
    assert {x.end for x in G.paths(r, spark.createDataFrame([("a",)], "node_id string"), 2, ends=ends).collect()} == {"c"}


def test_ancestors_end_in_a_cycle(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    got = {(x.child, x.ancestor): x.distance for x in G.ancestors(p).collect()}
    assert got["a", "b"] == 1 and got["a", "c"] == 2 and got["a", "a"] == 3 and len(got) == 9


def test_shared_entities_survive(spark):
    m = spark.createDataFrame([("d1", "x"), ("d1", "both"), ("d2", "both"), ("d2", "y")], "file string, entity string")
    gone = U.delete_documents(m, spark.createDataFrame([("d1",)], "file string"))
    assert [r.entity for r in gone.collect()] == ["x"]


def test_duplicates(spark):
    names = [("L", "abcdef"), ("L", "abcdeg"), ("L", "ab"), ("L", "abcdef and more"), ("M", "abcdef"), ("L", "zzzzzzzz"), ("L", "ABCDEF x")]
    pairs = {(r.a, r.b) for r in U.duplicate_pairs(spark.createDataFrame(names, "label string, name string")).collect()}
    assert ("abcdef", "abcdeg") in pairs and ("abcdef", "abcdef and more") in pairs and ("ABCDEF x", "abcdef") in pairs
    assert not any("ab" in p or "zzzzzzzz" in p for p in pairs)


def test_subsets_of_groups_go(spark):
    pairs = spark.createDataFrame([("L", "a", "b"), ("L", "a", "c"), ("L", "b", "c"), ("L", "d", "e")], "label string, a string, b string")
    got = {(r.head, tuple(r.members)) for r in U.duplicate_groups(pairs).collect()}
    assert got == {("a", ("a", "b", "c")), ("d", ("d", "e"))}


def test_merge_keeps_first_and_makes_no_loop(spark):
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    r = rels(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "c")])
    mapping = spark.createDataFrame([("b", "a")], "old string, kept string")
    nodes, edges = U.merge_nodes(n, r, mapping)
    assert sorted(x.node_id for x in nodes.collect()) == ["a", "c"]
    assert sorted((x.src, x.dst) for x in edges.collect()) == [("a", "c"), ("c", "c")]
    again = U.merge_nodes(nodes, edges, mapping)
    assert sorted((x.src, x.dst) for x in again[1].collect()) == [("a", "c"), ("c", "c")]


def test_views_cover_all_nodes_and_no_dangling_edge(spark):
    n = spark.createDataFrame([("a", "X"), ("b", "Y"), ("c", "Z")], "node_id string, label string")
    r = rels(spark, [("a", "b"), ("b", "c"), ("a", "missing")])
    both, edges = G.filter_view(n, r, {"X", "Y"}, F.col("label"))
    assert both.count() == 2 and [(x.src, x.dst) for x in edges.collect()] == [("a", "b")]
    assert G.filter_view(n, r, {"X", "Y"}, F.col("label"), deny=("E",))[1].count() == 0


def test_detection(spark, seed=1):
    """Levels nest, modularity is that of the planted groups at least, nobody is in two communities."""
    rng = random.Random(seed)
    edges = {}
    for _ in range(260):
        g = rng.randrange(4)
        a, b = sorted(rng.sample(range(g * 10, g * 10 + 10), 2))
        edges[a, b] = edges.get((a, b), 0) + 1
    for g in range(4):
        edges[tuple(sorted((g * 10, (g * 10 + 10) % 40)))] = 1
    e = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "source long, target long, weight long")
    got = {r.node: r.communities for r in C.detect(e, 2, 4).collect()}
    assert set(got) == {x for p in edges for x in p}
    for level in range(1, max(map(len, got.values()))):
        below = {}
        for c in got.values():
            assert below.setdefault(c[level - 1], c[level]) == c[level]
    last = spark.createDataFrame([(k, v[-1]) for k, v in got.items()], "node long, community long")
    planted = spark.createDataFrame([(k, k // 10) for k in got], "node long, community long")
    assert C.modularity(e, last) >= C.modularity(e, planted) - 0.02


def ring_of_groups(rng, groups=6, size=7):
    """Dense groups in a ring of bridges, and a loose chain that hangs on two of them."""
    edges = {}
    for g in range(groups):
        own = range(g * size, (g + 1) * size)
        for a in own:
            for b in own:
                if a < b and rng.random() < 0.8:
                    edges[a, b] = rng.randint(1, 3)
        edges[tuple(sorted((g * size, (g + 1) % groups * size + 1)))] = 1
    n = groups * size
    return edges | {(0, n): 1, (n, n + 1): 1, (size, n + 1): 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_parts_hang_together_and_modularity_is_that_of_moving_or_more(spark, seed):
    edges = ring_of_groups(random.Random(seed))
    e = spark.createDataFrame([(a, b, float(w)) for (a, b), w in edges.items()], "source long, target long, weight double")
    total = float(sum(edges.values()))
    got = {r.node: r.communities for r in C.detect(e, 3, 5).collect()}
    for level in range(max(map(len, got.values()))):
        groups = {}
        for k, c in got.items():
            groups.setdefault(c[level], set()).add(k)
        for name, own in groups.items():
            assert name == min(own)
            seen, todo = set(), [name]
            while todo:
                k = todo.pop()
                seen.add(k)
                todo += [x for a, b in edges if k in (a, b) for x in (a, b) if x in own and x not in seen]
            assert seen == own
    alone = C._moved(e, spark.createDataFrame([(k, k) for k in got], "node long, community long"), total, range(5))
    last = spark.createDataFrame([(k, v[-1]) for k, v in got.items()], "node long, community long")
    q = C.modularity(e, last)
    assert q >= C.modularity(e, alone) - 1e-9
    planted = spark.createDataFrame([(k, k // 7) for k in got], "node long, community long")
    assert q >= C.modularity(e, planted) - 0.02


def test_modularity_by_hand(spark):
    """Two edges inside, one between; loops count twice in a degree."""
    e = spark.createDataFrame([(1, 2, 2.0), (3, 4, 1.0), (2, 3, 1.0), (4, 4, 0.5)], "source long, target long, weight double")
    own = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "node long, community long")
    assert abs(C.modularity(e, own) - (3.5 / 4.5 - (5 / 9) ** 2 - (4 / 9) ** 2)) < 1e-12
    assert C.modularity(e.limit(0), own) == 0


def test_subdivision_stays_inside_and_leaves_loose_nodes_alone(spark):
    """Two dense groups that one community holds come apart; a node without weight to the rest stays single."""
    dense = [(a, b, 2.0) for g in (0, 5) for a in range(g, g + 5) for b in range(a + 1, g + 5)]
    e = spark.createDataFrame([*dense, (0, 5, 0.1), (10, 11, 3.0), (4, 10, 0.01)], "source long, target long, weight double")
    one = spark.createDataFrame([(k, 0) for k in range(11)] + [(11, 11)], "node long, community long")
    parts = {r.node: r.community for r in C.subdivided(e, one, 43.11, 8).collect()}
    assert parts[10] == 10 and parts[11] == 11
    assert all((k < 5) == (c < 5) for k, c in parts.items() if k < 10) and len({c for k, c in parts.items() if k < 10}) < 10


@pytest.mark.parametrize("hub", [3, 10_000])
def test_components_with_a_hub(spark, hub):
    """A star of a third of all edges, a chain, and pairs."""
    edges = [(0, k) for k in range(1, 200)] + [(k, k + 1) for k in range(300, 499)] + [(k, k + 1000) for k in range(600, 800)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "source long, target long"), hub).collect()}
    assert all(got[k] == 0 for k in range(200)) and all(got[k] == 300 for k in range(300, 500)) and all(got[k + 1000] == got[k] == k for k in range(600, 800))


def test_hierarchy_and_members(spark):
    lists = spark.createDataFrame([("x", [1, 2, 3]), ("y", [1, 2, 3]), ("z", [4, 2, 3])], "node string, communities array<int>")
    level0, up = C.hierarchy(lists)
    assert {(r.node, r.id) for r in level0.collect()} == {("x", "0-1"), ("y", "0-1"), ("z", "0-4")}
    assert {(r.child, r.parent) for r in up.collect()} == {("0-1", "1-2"), ("0-4", "1-2"), ("1-2", "2-3")}
    m = level0.select(F.col("id").alias("community"), F.col("node").alias("entity"))
    assert [(r.community, r.nodes) for r in C.large(m).collect()] == [("0-1", ["x", "y"])]


def test_components_of_an_empty_graph(spark):
    assert C.components(spark.createDataFrame([], "source long, target long")).count() == 0


def test_chunks_rebuild_the_text(spark):
    words = [f"w{i}" for i in range(333)]
    docs = spark.createDataFrame([("d", " ".join(words)), ("e", ""), ("f", None), ("g", "one 'two'\n\"three\"")], "file string, text string")
    got = sorted((r.file, r.position, r.text) for r in ingest.chunk_windows(docs).collect())
    own = [t.split() for f, _, t in got if f == "d"]
    assert own[0] + [w for c in own[1:] for w in c[20:]] == words and {len(c) for c in own[:-1]} == {100}
    assert [t for f, _, t in got if f == "g"] == ["one two three"] and {f for f, _, _ in got} == {"d", "g"}
    chain = ingest.chunk_chain(ingest.chunk_windows(docs)).where("file = 'd'").orderBy("position").collect()
    assert chain[0].edge == "FIRST_CHUNK" and all(b.previous_id == a.chunk_id for a, b in zip(chain, chain[1:]))
    assert [r.content_offset for r in chain][:2] == [0, len(own and got[0][2])]


def test_pages_cover_each_chunk_once(spark):
    rows = spark.createDataFrame([("d", k) for k in range(1, 26)], "file string, position int")
    pages = [[r.position for r in ingest.page(rows, "file", "position", p).collect()] for p in (1, 2, 3, 4)]
    assert sorted(sum(pages, [])) == list(range(1, 26)) and [len(p) for p in pages] == [10, 10, 5, 0]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "k int, v string, n int")
    new = spark.createDataFrame([(2, None, 7), (3, "c", 1)], "k int, v string, n int")
    once = ingest.upsert(old, new, ["k"])
    want = [(1, "a", 5), (2, "b", 7), (3, "c", 1)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, ingest.upsert(once, new, ["k"]).collect()))


def test_documented_counters():
    """The totals of published samples: nodes are chunks, entities and communities; relationships likewise."""
    for chunk, entity, community, nodes in ((5, 14, 0, 19), (100, 670, 289, 1059), (100, 780, 422, 1302)):
        assert chunk + entity + community == nodes


def test_scalars(spark):
    assert one(spark, T.seconds_of(F.lit("1:02:03"))) == 3723 and one(spark, T.hms(F.lit(3723))) == "1:02:03"
    assert one(spark, T.video_id(F.lit("https://www.youtube.com/watch?v=abcdefghijk&t=1"))) == "abcdefghijk" and one(spark, T.video_id(F.lit("https://x.y/"))) is None
    assert one(spark, T.url_last_segment(F.lit("https://a.b.c/x/y/?q=1"))) == "y" and one(spark, T.url_last_segment(F.lit("https://a.b.c"))) == "a"
    assert tuple(one(spark, T.parse_triplet(F.lit("A B-LIKES->C")))) == ("A B", "LIKES", "C") and one(spark, T.parse_triplet(F.lit("no"))) is None
    assert [tuple(x) for x in one(spark, T.triples_of(F.lit("a, r, b,b,s,c")))] == [("a", "r", "b"), ("b", "s", "c")] and one(spark, T.triples_of(F.lit("a,b"))) is None
    assert one(spark, T.capitalized(F.lit("hELLO"))) == "Hello" and one(spark, T.base_name(F.lit("../../etc/passwd"))) == "passwd"
    assert one(spark, T.is_refusal(F.lit(" Sorry, no"), ("sorry",))) and not one(spark, T.is_refusal(F.lit(None).cast("string"), ("sorry",)))
    assert one(spark, scaled(cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))))) == 0.5
    assert one(spark, cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    v = one(spark, hashed_embedding(F.array(F.lit("a"), F.lit("A"), F.lit("b"))))
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-6


def test_rouge(spark):
    p = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "b", "c", "d"]), (2, ["x"], ["y"])], "id int, a array<string>, b array<string>")
    got = {r.id: (r.precision, r.recall, r.f1) for r in P.rouge1(p).collect()}
    assert got == {1: (0.5, 0.6667, 0.5714), 2: (0.0, 0.0, 0.0)}


def test_merges_follow_chains(spark):
    rows = [(f"n{k:03}", f"n{k + 1:03}") for k in range(100)] + [("x", "n007"), ("x", "n050"), ("y", "y"), (None, "n001"), ("z", None)]
    got = {r.old: r.kept for r in U.closed(spark.createDataFrame(rows, "old string, kept string")).collect()}
    assert got == {f"n{k:03}": "n100" for k in range(100)} | {"x": "n100"}
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    rels = spark.createDataFrame([("R", "a", "c"), ("R", "d", "a")], "type string, src string, dst string")
    n, r = U.merge_nodes(nodes, rels, spark.createDataFrame([("a", "b"), ("b", "c")], "old string, kept string"))
    assert [x.node_id for x in n.collect()] == ["c"] and [tuple(x) for x in r.collect()] == [("R", "d", "c")]
    assert U.closed(spark.createDataFrame([], "old string, kept string")).count() == 0
    with pytest.raises(ValueError):
        U.closed(spark.createDataFrame([("a", "b"), ("b", "a")], "old string, kept string"))


def test_edges_are_not_dealt_by_type(spark):
    rels = spark.createDataFrame([("X", "a", "b"), ("Y", "a", "b"), ("Z", "a", "b")], "type string, src string, dst string")
    own = G.rename_types(rels, spark.createDataFrame([("X", "Y")], "old string, new string"))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert sorted(own.collect()) == [("Y", "a", "b"), ("Z", "a", "b")]


def test_words_and_entities_by_one_pass_are_as_before(spark):
    texts = ["", " ", "\t\r\n", None, "a  b\tc\r\nd", "\"it's\" 'a\n\n b'", "x\"\n'y z ", " a b\x0bc", "Alice, (Bob1by) a-L-i-c-e A1l2i3c4e É'Éclair Paris\n", "ABcd aBcde Abc Abcd 1A2b3c4d Xéyzw", "A" + "b" * 20_000]
    own = spark.createDataFrame([(f"f{k}", t) for k, t in enumerate(texts)], "file string, text string")
    before = F.array_remove(F.split(T.collapse(T.clean(F.col("text"))), " "), "")
    assert own.where(~T.words(F.col("text")).eqNullSafe(before)).count() == 0
    chunks = ingest.chunk_windows(own)
    at = chunks.select("file", F.posexplode(F.split("text", " ")).alias("place", "word")).withColumn("entity", F.regexp_replace("word", "[^A-Za-z]", ""))
    want = {(r.file, r.place, r.entity) for r in at.where(F.col("entity").rlike("^[A-Z][a-z]{3,}$")).collect()}
    assert len(want) > 6 and {(r.file, r.place, r.entity) for r in ingest.entity_mentions(chunks).collect()} == want
    assert {(r.file, r.place, r.entity) for r in models.extract(chunks).collect()} == want
    # The words of a text are cut once: nothing that is asked of them is put before them.
    assert chunks._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(text") == 1


@pytest.mark.parametrize("few", [0, 2, 3, 100])
def test_induced_edges_by_the_ends_that_are_no_nodes(spark, few):
    nodes = spark.createDataFrame([(x,) for x in "abcdeea"], "node_id string")
    rows = [("R", "a", "b"), ("R", "a", "b"), ("S", "a", "x"), ("S", "y", "b"), ("R", "x", "y"), ("R", "c", "c"), ("R", None, "a"), ("R", "a", None), ("S", "d", "e"), ("R", "z", "z")]
    rels = spark.createDataFrame(rows, "type string, src string, dst string")
    want = sorted(r for r in rows if r[1] and r[2] and {r[1], r[2]} <= set("abcde"))
    assert sorted(map(tuple, G.induced(rels, nodes, few=few).collect())) == want
    assert sorted(map(tuple, G.induced(rels, nodes, F.col("type") == "R", few=few).collect())) == [r for r in want if r[0] == "R"]
    if few == 3:  # x, y and z are no nodes: edges are not moved
        assert "Exchange hashpartitioning(src" not in G.induced(rels, nodes, few=few)._jdf.queryExecution().executedPlan().toString()


def test_only_chosen_documents_are_cut(spark):
    """Files are chosen before their words are cut, so the work does not grow with the other texts."""
    from tessera.plans import subgraph

    for chunks in (subgraph._used(spark, "/root/testdata/sf0.001"), subgraph._subgraph(spark, "/root/testdata/sf0.001")[1]):
        plan = chunks._jdf.queryExecution().optimizedPlan().toString().splitlines()
        cut = [k for k, line in enumerate(plan) if "regexp_replace(text" in line]
        assert cut and all("Join LeftSemi" in plan[k + 1] or "Join LeftSemi" in plan[k + 2] for k in cut)


def test_tables_of_nodes_do_not_pass_the_driver(spark):
    """Detection joins tables of nodes by their keys: a broadcast would gather them on the driver in each round."""
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (4, 5, 2.0)], "source long, target long, weight double")
    own = spark.createDataFrame([(k, k) for k in range(1, 6)], "node long, community long")
    assert "BroadcastExchange" not in C._move(edges, own, 0, 4.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in C.connected_parts(edges, own)._jdf.queryExecution().executedPlan().toString()


def test_edges_of_texts_are_those_of_their_chunks(spark):
    """Without mentions: only pairs are moved, once counted, unless a file is in several rows."""
    draw = random.Random(7)
    names = ["Alice", "Bobby", "O'Carol", "(Dora)", "\"Emma\"", "Zed-Al", "{Gina", "Hu\x0bgo", "É1Fgh", "ABcde", "Xyz"]

    def text(n, share):
        return "".join((draw.choice(names) if draw.random() < share else "w") + draw.choice([" ", "  ", "\n", "\t\r\n"]) for _ in range(n))

    rows = [(f"f{n}-{share}", text(n, share)) for n in (0, 1, 19, 20, 21, 99, 100, 101, 119, 120, 121, 180, 181, 500) for share in (0.03, 0.3, 0.9)] + [("null", None), ("blank", " \"\n")]
    again = [("x", "Alice a Carol"), ("x", "w Bobby w w Dora"), (None, "Alice w Bobby"), (None, "w Carol w Dora w"), (None, "")]
    for own in (rows, rows + again):
        docs = spark.createDataFrame(own, "file string, text string")
        for size, overlap in ((100, 20), (5, 4)):
            want = ingest.mention_edges(ingest.entity_mentions(ingest.chunk_windows(docs, size, overlap)))
            got = ingest.text_edges(docs, size, overlap)
            assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    plan = ingest.text_edges(spark.createDataFrame(rows, "file string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1 and plan.count("split(") == 1 and plan.count("RLIKE") == 1
