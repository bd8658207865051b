"""Queries over the property graph and its communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import communities as C
from tessera.operators import graph as G
from tessera.plans import derived as D
from tessera.plans.registry import query


@query(D.sql("SELECT a.label AS source, r.type, b.label AS target, count(*) AS n FROM rels r JOIN nodes a ON a.node_id = r.src JOIN nodes b ON b.node_id = r.dst GROUP BY ALL", "nodes", "rels"))
def graph_triplets(spark, sf_dir):
    return G.triplet_schema(D.nodes(spark, sf_dir), D.rels(spark, sf_dir))


@query(D.sql("SELECT label, count(*) AS n FROM nodes GROUP BY label", "nodes"))
def label_list(spark, sf_dir):
    return D.nodes(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n")).orderBy("label")


@query(D.sql("SELECT type, count(*) AS n, count(DISTINCT src || '>' || dst) AS n_pairs FROM rels GROUP BY type", "rels"))
def rel_type_list(spark, sf_dir):
    return D.rels(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("src", "dst").alias("n_pairs")).orderBy("type")


@query(D.sql("""SELECT 'Nation:3' AS seed, type, dst AS neighbour, 'out' AS direction FROM rels WHERE src = 'Nation:3'
    UNION ALL SELECT 'Nation:3', type, src, 'in' FROM rels WHERE dst = 'Nation:3' AND src <> dst""", "rels"))
def neighbours_of_nation(spark, sf_dir):
    return G.neighbours(D.rels(spark, sf_dir), spark.createDataFrame([("Nation:3",)], "node_id string"))


_STEPS = """i AS (SELECT DISTINCT src, dst FROM rels WHERE type = 'IN'), e AS (SELECT src AS a, dst AS b, src || dst AS id FROM i UNION ALL SELECT dst, src, src || dst FROM i)"""


@query(D.sql("""SELECT seed, length, "end", count(*) AS n FROM (SELECT a.node_id AS seed, 1 AS length, e.b AS "end" FROM nodes a JOIN e ON e.a = a.node_id WHERE a.label = 'Region'
    UNION ALL SELECT a.node_id, 2, f.b FROM nodes a JOIN e ON e.a = a.node_id JOIN e f ON f.a = e.b AND f.id <> e.id WHERE a.label = 'Region') GROUP BY ALL""", "nodes", "rels", also=_STEPS))
def two_hop_paths(spark, sf_dir):
    """Paths of one or two IN edges from the regions, no edge twice, counted by their ends."""
    edges = D.rels(spark, sf_dir).where("type = 'IN'").distinct().withColumn("rel_id", F.concat("src", "dst"))
    seeds = D.nodes(spark, sf_dir).where("label = 'Region'")
    return G.paths(edges, seeds, 2).groupBy("seed", "length", "end").agg(F.count("*").alias("n"))


_UP = """p AS (SELECT DISTINCT src AS child, dst AS parent FROM rels WHERE type = 'IN'),
    t AS (SELECT child, parent AS ancestor, 1 AS d FROM p UNION SELECT t.child, p.parent, d + 1 FROM t JOIN p ON p.child = t.ancestor WHERE d < 10)"""


@query(D.sql("SELECT child, ancestor, min(d) AS distance FROM t GROUP BY ALL", "rels", also=_UP))
def transitive_parents(spark, sf_dir):
    edges = D.rels(spark, sf_dir).where("type = 'IN'").select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    return G.ancestors(edges, 3)


@query(D.sql("""SELECT count(DISTINCT node_id) AS nodes, (SELECT count(*) FROM rels WHERE src LIKE 'Nation:%' AND dst LIKE 'Region:%') AS rels FROM nodes WHERE label IN ('Nation', 'Region')""", "nodes", "rels"))
def schema_level_view(spark, sf_dir):
    n, r = G.filter_view(D.nodes(spark, sf_dir), D.rels(spark, sf_dir), {"Nation", "Region"}, F.col("label"))
    return n.agg(F.count_distinct("node_id").alias("nodes")).crossJoin(r.agg(F.count("*").alias("rels")))


#: Views of the graph: which groups of labels are shown.
VIEWS = {
    "places": ("Region", "Nation"), "people": ("Customer", "Supplier"), "goods": ("Part", "Order"), "places_people": ("Region", "Nation", "Customer", "Supplier"),
    "people_goods": ("Customer", "Supplier", "Part", "Order"), "places_goods": ("Region", "Nation", "Part", "Order"), "all": ("Region", "Nation", "Customer", "Supplier", "Part", "Order"),
}


def _view(name: str, labels: tuple[str, ...]):
    listed = ", ".join(f"'{x}'" for x in labels)
    body = f"""SELECT r.type, count(*) AS n FROM rels r WHERE split_part(src, ':', 1) IN ({listed}) AND split_part(dst, ':', 1) IN ({listed})
        AND src IN (SELECT node_id FROM nodes) AND dst IN (SELECT node_id FROM nodes) GROUP BY r.type UNION ALL SELECT 'nodes', count(*) FROM nodes WHERE label IN ({listed})"""

    def view(spark, sf_dir):
        n, r = G.filter_view(D.nodes(spark, sf_dir), D.rels(spark, sf_dir), set(labels), F.col("label"))
        return r.groupBy("type").agg(F.count("*").alias("n")).unionByName(n.agg(F.count("*").alias("n")).withColumn("type", F.lit("nodes")))

    view.__name__ = f"filter_view_{name}"
    query(D.sql(body, "nodes", "rels"))(view)


for _name, _labels in VIEWS.items():
    _view(_name, _labels)


@query(D.sql("""SELECT CASE label WHEN 'Customer' THEN 'Company' WHEN 'Supplier' THEN 'Company' WHEN 'Part' THEN 'Product' ELSE label END AS label, count(*) AS n FROM nodes GROUP BY ALL""", "nodes"))
def relabel_nodes(spark, sf_dir):
    mapping = spark.createDataFrame([("Customer", "Company"), ("Supplier", "Company"), ("Part", "Product")], "old string, new string")
    return G.relabel(D.nodes(spark, sf_dir), mapping).groupBy("label").agg(F.count("*").alias("n"))


@query(D.sql("""SELECT type, count(*) AS n FROM (SELECT DISTINCT CASE type WHEN 'SUPPLIES' THEN 'OFFERS' WHEN 'CONTAINS' THEN 'OFFERS' ELSE type END AS type, src, dst FROM rels) GROUP BY type""", "rels"))
def rename_rels(spark, sf_dir):
    mapping = spark.createDataFrame([("SUPPLIES", "OFFERS"), ("CONTAINS", "OFFERS")], "old string, new string")
    return G.rename_types(D.rels(spark, sf_dir), mapping).groupBy("type").agg(F.count("*").alias("n"))


@query(D.sql("""SELECT label AS name, 'node' AS kind, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT type, 'relationship', count(*) FROM rels GROUP BY type""", "nodes", "rels"))
def legend(spark, sf_dir):
    n = D.nodes(spark, sf_dir).groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("node"))
    r = D.rels(spark, sf_dir).groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("relationship"))
    return n.unionByName(r)


@query("""SELECT n_name || '-IN->' || r_name AS triplet, n_name AS source, 'IN' AS relation, r_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey""")
def triplet_parse(spark, sf_dir):
    nation, region = D.table(spark, sf_dir, "nation"), D.table(spark, sf_dir, "region")
    joined = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    text = joined.select(T.triplet(F.col("n_name"), F.lit("IN"), F.col("r_name")).alias("triplet"))
    return text.select("triplet", T.parse_triplet(F.col("triplet")).alias("t")).select("triplet", "t.*")


@query(D.sql("SELECT least(src, dst) AS source, greatest(src, dst) AS target, count(*) AS weight FROM rels WHERE src <> dst GROUP BY ALL", "rels"))
def projection_weight(spark, sf_dir):
    return C.projection(D.rels(spark, sf_dir))


@query(D.sql("SELECT entity, 0 AS level, '0-' || c0 AS community FROM lists UNION ALL SELECT entity, 1, '1-' || c1 FROM lists UNION ALL SELECT entity, 2, '2-' || c2 FROM lists", "lists"))
def community_levels(spark, sf_dir):
    at = D.community_lists(D.mentions(spark, sf_dir)).select("entity", F.posexplode("communities").alias("level", "c"))
    return at.select("entity", "level", C.level_id(F.col("level"), F.col("c")).alias("community"))


@query(D.sql("SELECT DISTINCT '0-' || c0 AS child, '1-' || c1 AS parent FROM lists UNION SELECT DISTINCT '1-' || c1, '2-' || c2 FROM lists", "lists"))
def community_parents(spark, sf_dir):
    return C.hierarchy(D.community_lists(D.mentions(spark, sf_dir)).withColumnRenamed("entity", "node"))[1]


@query(D.sql("SELECT '0-' || c0 AS community, count(DISTINCT file) AS community_rank FROM lists JOIN mentions USING (entity) GROUP BY ALL", "lists", "mentions"))
def community_rank(spark, sf_dir):
    m = D.mentions(spark, sf_dir)
    members = D.community_lists(m).select("entity", C.level_id(F.lit(0), F.get("communities", F.lit(0))).alias("community"))
    return C.rank(members, m)


@query(D.sql("SELECT '0-' || c0 AS community, count(DISTINCT file) AS community_rank FROM lists JOIN (SELECT * FROM mentions WHERE position = 1) USING (entity) GROUP BY ALL", "lists", "mentions"))
def community_rank_first_chunk(spark, sf_dir):
    """Only documents whose first chunk mentions a member."""
    m = D.mentions(spark, sf_dir)
    members = D.community_lists(m).select("entity", C.level_id(F.lit(0), F.get("communities", F.lit(0))).alias("community"))
    return C.rank(members, m.where("position = 1"))


@query(D.sql("SELECT '0-' || c0 AS community, count(DISTINCT chunk_id) AS weight FROM lists JOIN mentions USING (entity) GROUP BY ALL", "lists", "mentions"))
def community_weight(spark, sf_dir):
    m = D.mentions(spark, sf_dir)
    members = D.community_lists(m).select("entity", C.level_id(F.lit(0), F.get("communities", F.lit(0))).alias("community"))
    return C.weight(members, m)


@query(D.sql("SELECT '0-' || c0 AS community, string_agg(entity, ' ' ORDER BY entity) AS nodes FROM lists GROUP BY ALL HAVING count(*) > 1", "lists"))
def community_members(spark, sf_dir):
    members = D.community_lists(D.mentions(spark, sf_dir)).select("entity", C.level_id(F.lit(0), F.get("communities", F.lit(0))).alias("community"))
    return C.large(members).select("community", F.array_join("nodes", " ").alias("nodes"))


_ALIKE = """s AS (SELECT a.id AS a, b.id AS b FROM vectors a, vectors b WHERE a.id <> b.id AND round((1 + list_cosine_similarity(a.embedding, b.embedding)) / 2, 4) >= 0.7),
    t AS (SELECT a AS node, a AS component FROM s UNION SELECT s.b, t.component FROM t JOIN s ON s.a = t.node)"""


@query(D.sql("SELECT node, min(component) AS component FROM t GROUP BY node", "vectors", also=_ALIKE))
def connected_components(spark, sf_dir):
    """Components of the graph of vectors that are alike, of those with a neighbour."""
    from tessera.operators.vector_index import links

    return C.components(links(D.vector_index(spark, sf_dir), 0.7).select(F.col("id").alias("source"), F.col("neighbour").alias("target")))


@query()
def leiden_like_communities(spark, sf_dir):
    """Communities of customers and suppliers by the parts and orders between them, at most three levels."""
    lines, orders = D.table(spark, sf_dir, "lineitem"), D.table(spark, sf_dir, "orders")
    customer = orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") * 2).alias("source"))
    edges = lines.select("l_orderkey", (F.col("l_suppkey") * 2 + 1).alias("target")).join(customer, "l_orderkey").groupBy("source", "target").agg(F.count("*").alias("weight"))
    return C.detect(edges, 3, 3)


_REGIONS = """m AS (SELECT n_nationkey AS node, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS community FROM nation)"""


def _detected(spark, sf_dir):
    """Communities of nations that trade with those of their region, and with one of the next region, as detection finds them.

    The regions form a ring of bridges, so the graph is one component.
    """
    nation = D.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_regionkey")
    inside = nation.select(F.col("k").alias("source"), "n_regionkey").join(nation.select(F.col("k").alias("target"), "n_regionkey"), "n_regionkey").where("source < target")
    n = D.table(spark, sf_dir, "region").count()
    heads = nation.groupBy("n_regionkey").agg(F.min("k").alias("a"), F.max("k").alias("b"))
    bridges = heads.select("a", F.pmod(F.col("n_regionkey") + 1, F.lit(n)).alias("n_regionkey")).join(heads.select("n_regionkey", "b"), "n_regionkey")
    edges = inside.select("source", "target", F.lit(2).alias("weight")).union(bridges.select(F.least("a", "b"), F.greatest("a", "b"), F.lit(1)))
    return C.detect(edges, 2, 4).select("node", F.element_at("communities", -1).alias("community"))


@query(f"WITH {_REGIONS} SELECT node, community FROM m")
def detected_communities(spark, sf_dir):
    return _detected(spark, sf_dir)


@query(f"WITH {_REGIONS} SELECT community, count(DISTINCT c_mktsegment) AS community_rank, count(DISTINCT c_custkey) AS weight, count(DISTINCT node) AS n_members FROM m JOIN customer ON c_nationkey = node GROUP BY community")
def detected_community_stats(spark, sf_dir):
    """Rank, weight and members of detected communities: market segments stand for documents, customers for chunks."""
    members = _detected(spark, sf_dir).withColumnRenamed("node", "entity")
    mentions = D.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("entity"), F.col("c_mktsegment").alias("file"), F.col("c_custkey").alias("chunk_id"))
    n = members.join(mentions.select("entity").distinct(), "entity", "left_semi").groupBy("community").agg(F.count("*").alias("n_members"))
    return C.rank(members, mentions).join(C.weight(members, mentions), "community").join(n, "community")


def _pattern(nodes, edges):
    from tessera.operators import patterns as M

    return M.Pattern(tuple(M.Node(*n) for n in nodes), tuple(M.Edge(*e) for e in edges))


def _match(spark, sf_dir, nodes, edges):
    from tessera.operators import patterns as M

    return M.match(D.nodes(spark, sf_dir), D.rels(spark, sf_dir), _pattern(nodes, edges))


@query(D.sql("""SELECT DISTINCT a.src AS c, a.dst AS n, b.dst AS r FROM rels a JOIN rels b ON b.type = 'IN' AND b.src = a.dst JOIN nodes x ON x.node_id = b.dst AND x.caption = 'ASIA'
    WHERE a.type = 'IN' AND a.src LIKE 'Customer:%'""", "nodes", "rels"))
def pattern_chain(spark, sf_dir):
    """(c:Customer)-[IN]->(n:Nation)-[IN]->(r:Region), of one region."""
    return _match(spark, sf_dir, [("c", "Customer"), ("n", "Nation"), ("r", "Region", "caption = 'ASIA'")], [("c", "IN", "n"), ("n", "IN", "r")])


@query(D.sql("""SELECT s, c, count(*) AS n FROM (SELECT DISTINCT a.src AS s, a.dst AS n, b.src AS c FROM rels a JOIN rels b ON b.type = 'IN' AND b.dst = a.dst AND b.src LIKE 'Customer:%' WHERE a.type = 'IN' AND a.src LIKE 'Supplier:%') GROUP BY ALL""", "rels"))
def pattern_neighbours(spark, sf_dir):
    """(s:Supplier)-[IN]->(n)<-[IN]-(c:Customer), counted by the two ends."""
    from tessera.operators import patterns as M

    own = _pattern([("s", "Supplier"), ("n",), ("c", "Customer")], [("s", "IN", "n"), ("c", "IN", "n")])
    return M.meeting_counts(D.nodes(spark, sf_dir), D.rels(spark, sf_dir), own)


@query(D.sql("""SELECT c, x FROM (SELECT DISTINCT src AS c, dst AS x FROM rels WHERE type = 'IN' AND src LIKE 'Customer:%')
    UNION ALL SELECT DISTINCT a.src, b.dst FROM rels a JOIN rels b ON b.type = 'IN' AND b.src = a.dst WHERE a.type = 'IN' AND a.src LIKE 'Customer:%'""", "rels"))
def pattern_steps(spark, sf_dir):
    """(c:Customer)-[IN*1..2]->(x)."""
    return _match(spark, sf_dir, [("c", "Customer"), ("x",)], [("c", "IN", "x", 1, 2)])


@query(D.sql("""SELECT c, n FROM (SELECT DISTINCT p.src AS c, p.dst AS o, q.dst AS part, i.dst AS n FROM rels p JOIN rels q ON q.type = 'CONTAINS' AND q.src = p.dst JOIN nodes x ON x.node_id = q.dst AND x.caption LIKE '%red%'
    JOIN rels i ON i.type = 'IN' AND i.src = p.src JOIN nodes y ON y.node_id = i.dst AND y.caption = 'NATION_7' WHERE p.type = 'PLACED')""", "nodes", "rels"))
def pattern_branch(spark, sf_dir):
    """(n:Nation)<-[IN]-(c:Customer)-[PLACED]->(o:Order)-[CONTAINS]->(p:Part), with conditions at both ends."""
    found = _match(
        spark, sf_dir, [("n", "Nation", "caption = 'NATION_7'"), ("c", "Customer"), ("o", "Order"), ("p", "Part", "contains(caption, 'red')")], [("c", "IN", "n"), ("c", "PLACED", "o"), ("o", "CONTAINS", "p")]
    )
    return found.select("c", "n")


@query(D.sql("""SELECT DISTINCT a.src AS s, b.src AS t, a.dst AS n FROM rels a JOIN rels b ON b.type = 'IN' AND b.dst = a.dst AND b.src LIKE 'Supplier:%' AND b.src <> a.src WHERE a.type = 'IN' AND a.src LIKE 'Supplier:%' ORDER BY s, t, n LIMIT 3""", "rels"))
def pattern_answer(spark, sf_dir):
    """(s:Supplier)-[IN]->(n)<-[IN]-(t:Supplier): the first three rows, as a model is told them; no edge is taken twice, so s is not t."""
    from tessera.operators import patterns as M

    own = _pattern([("s", "Supplier"), ("t", "Supplier"), ("n",)], [("s", "IN", "n"), ("t", "IN", "n")])
    return M.first_answers(D.nodes(spark, sf_dir), D.rels(spark, sf_dir), own)
