"""Queries that list and change what is wrong in a graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import curation as U
from tessera.operators import graph as G
from tessera.plans import derived as D
from tessera.plans.registry import query


@query("SELECT 'Customer:' || c_custkey AS node_id, 'Customer' AS label FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def orphan_entities(spark, sf_dir):
    """Customers that no edge to a large order touches."""
    name = lambda label, c: F.concat(F.lit(f"{label}:"), F.col(c).cast("string"))
    large = D.table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(name("Customer", "o_custkey").alias("src"), name("Order", "o_orderkey").alias("dst"))
    return U.orphans(D.nodes(spark, sf_dir).where("label = 'Customer'"), large).select("node_id", "label")


@query(D.sql("""SELECT entity, array_to_string(list_sort(list(DISTINCT file)), ',') AS documents, count(DISTINCT chunk_id) AS chunk_connections FROM mentions
    WHERE entity NOT IN (SELECT entity FROM pairs UNION SELECT next FROM pairs) GROUP BY entity""", "pairs"))
def orphan_mentions(spark, sf_dir):
    """Entities that never stand beside another, with where they are mentioned."""
    from tessera.operators.ingest import mention_edges

    m = D.mentions(spark, sf_dir)
    edges = mention_edges(m).select(F.col("source").alias("src"), F.col("target").alias("dst"))
    alone = U.orphans(m.select(F.col("entity").alias("node_id")).distinct(), edges)
    of = U.provenance(alone, m.withColumnRenamed("entity", "node_id"))
    return of.select(F.col("node_id").alias("entity"), F.array_join("documents", ",").alias("documents"), "chunk_connections")


_NAMES = "SELECT DISTINCT p_brand AS label, p_name AS name FROM part"
_PAIRS = f"""SELECT a.label, a.name AS a, b.name AS b FROM names a JOIN names b ON a.label = b.label AND a.name < b.name WHERE
    (length(a.name) >= 3 AND length(b.name) >= 3 AND (contains(lower(a.name), lower(b.name)) OR contains(lower(b.name), lower(a.name)))) OR (length(a.name) > 5 AND levenshtein(lower(a.name), lower(b.name)) < 5)"""


def _names(spark, sf_dir):
    return D.table(spark, sf_dir, "part").select(F.col("p_brand").alias("label"), F.col("p_name").alias("name")).distinct()


@query(f"WITH names AS ({_NAMES}) {_PAIRS}")
def duplicate_pairs(spark, sf_dir):
    return U.duplicate_pairs(_names(spark, sf_dir))


_GROUPS = f"""WITH names AS ({_NAMES}), pairs AS ({_PAIRS}), groups AS (SELECT label, a AS head, list_sort(list_distinct(list_append(list(DISTINCT b), a))) AS members FROM pairs GROUP BY label, a),
    kept AS (SELECT * FROM groups g WHERE NOT EXISTS (SELECT 1 FROM groups h WHERE h.label = g.label AND len(h.members) > len(g.members) AND list_has_all(h.members, g.members)))"""


@query(f"{_GROUPS} SELECT label, head, array_to_string(members, '|') AS members FROM kept")
def duplicate_groups(spark, sf_dir):
    return U.duplicate_groups(U.duplicate_pairs(_names(spark, sf_dir))).select("label", "head", F.array_join("members", "|").alias("members"))


@query(f"""{_GROUPS} SELECT label, head, array_to_string(members, '|') AS members, coalesce(degree, 0) AS degree FROM kept LEFT JOIN (SELECT p_name AS head, count(*) AS degree FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_name) USING (head)
    ORDER BY degree DESC, length(head) DESC, head, label LIMIT 100""")
def duplicate_page(spark, sf_dir):
    """The first hundred groups, those with the busiest heads first."""
    part, lines = D.table(spark, sf_dir, "part").select("p_partkey", "p_name"), D.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    degrees = lines.join(part, "p_partkey").groupBy(F.col("p_name").alias("node_id")).agg(F.count("*").alias("degree"))
    page = U.duplicate_page(U.duplicate_groups(U.duplicate_pairs(_names(spark, sf_dir))), degrees)
    return page.select("label", "head", F.array_join("members", "|").alias("members"), F.coalesce("degree", F.lit(0)).alias("degree"))


@query("""WITH e AS (SELECT label, 'v' || vec_id AS name, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.label, a.name AS a, b.name AS b FROM e a JOIN e b ON a.label = b.label AND a.name < b.name
    WHERE round((1 + list_cosine_similarity(a.v, b.v)) / 2, 4) >= 0.75 OR (contains(a.name, b.name) OR contains(b.name, a.name)) AND length(a.name) >= 3 AND length(b.name) >= 3""")
def duplicate_pairs_by_vectors(spark, sf_dir):
    """Names of one label that contain each other, or whose vectors are alike."""
    own = D.table(spark, sf_dir, "embeddings").select("label", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), "embedding")
    return U.duplicate_pairs(own, distance=None, likeness=0.75)


@query("""WITH m AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_name) AS kept FROM part)
    SELECT 'rels' AS what, count(*) AS n FROM (SELECT DISTINCT l_suppkey, kept FROM lineitem JOIN m ON l_partkey = p_partkey) UNION ALL SELECT 'nodes', count(DISTINCT kept) FROM m""")
def merge_duplicates(spark, sf_dir):
    """Parts of one brand and name become the one of the smallest key, and their suppliers' edges one each."""
    part = D.table(spark, sf_dir, "part")
    first = part.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("kept"))
    mapping = part.join(first, ["p_brand", "p_name"]).where("p_partkey != kept").select(F.col("p_partkey").cast("string").alias("old"), F.col("kept").cast("string").alias("kept"))
    nodes = part.select(F.col("p_partkey").cast("string").alias("node_id"))
    rels = D.table(spark, sf_dir, "lineitem").select(F.lit("SUPPLIES").alias("type"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("src"), F.col("l_partkey").cast("string").alias("dst"))
    n, r = U.merge_nodes(nodes, rels, mapping)
    return r.agg(F.count("*").alias("n")).withColumn("what", F.lit("rels")).unionByName(n.agg(F.count("*").alias("n")).withColumn("what", F.lit("nodes")))


@query(D.sql("""SELECT DISTINCT entity FROM mentions WHERE file IN (SELECT file FROM words WHERE lang = 'de') AND entity NOT IN (SELECT entity FROM mentions WHERE file NOT IN (SELECT file FROM words WHERE lang = 'de'))""", "mentions"))
def delete_docs_keep_shared(spark, sf_dir):
    """Entities that go with the documents of a language."""
    files = D.files(spark, sf_dir).where("lang = 'de'").select("file")
    return U.delete_documents(D.mentions(spark, sf_dir), files)


@query(D.sql("""SELECT 'nodes' AS what, count(*) AS n FROM nodes WHERE label <> 'Supplier' UNION ALL SELECT type, count(*) FROM rels WHERE NOT starts_with(src, 'Supplier') AND NOT starts_with(dst, 'Supplier') GROUP BY type""", "nodes", "rels"))
def detach_delete(spark, sf_dir):
    n = D.nodes(spark, sf_dir)
    kept, r = U.detach(n, D.rels(spark, sf_dir), n.where("label = 'Supplier'"))
    return kept.agg(F.count("*").alias("n")).withColumn("what", F.lit("nodes")).unionByName(r.groupBy(F.col("type").alias("what")).agg(F.count("*").alias("n")))


@query("""WITH c AS (SELECT 'c' || n_nationkey AS id, 0 AS level, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 1, 'w' FROM region UNION ALL SELECT 'w', 2, NULL),
    m AS (SELECT DISTINCT 'c' || c_nationkey AS id FROM customer WHERE c_acctbal > 9900), a0 AS (SELECT * FROM c WHERE level = 0 AND id IN (SELECT id FROM m)),
    a1 AS (SELECT * FROM c WHERE level = 1 AND id IN (SELECT parent FROM a0)), a2 AS (SELECT * FROM c WHERE level = 2 AND id IN (SELECT parent FROM a1))
    SELECT id, level FROM a0 UNION ALL SELECT id, level FROM a1 UNION ALL SELECT id, level FROM a2""")
def community_cascade(spark, sf_dir):
    """Which of nations, regions and world stay, if those without a rich customer go."""
    nation, region = D.table(spark, sf_dir, "nation"), D.table(spark, sf_dir, "region")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c = nation.select(name("c", "n_nationkey").alias("id"), F.lit(0).alias("level"), name("r", "n_regionkey").alias("parent"))
    c = c.unionByName(region.select(name("r", "r_regionkey").alias("id"), F.lit(1).alias("level"), F.lit("w").alias("parent")))
    c = c.unionByName(spark.createDataFrame([("w", 2, None)], "id string, level int, parent string"))
    members = D.table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(name("c", "c_nationkey").alias("id"))
    return U.cascade(c, members).select("id", "level")


@query("SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS r FROM part) WHERE r = 1")
def keep_first_part(spark, sf_dir):
    return U.keep_first(D.table(spark, sf_dir, "part"), ["p_brand", "p_name"], ["p_partkey"]).select("p_brand", "p_partkey", "p_name")


@query(D.sql("SELECT DISTINCT e.type, e.src, e.dst FROM rels e WHERE e.src LIKE 'Nation:%' OR (e.src LIKE 'Supplier:%' AND e.type = 'IN')", "rels"))
def induced_places(spark, sf_dir):
    places = D.nodes(spark, sf_dir).where("label IN ('Nation', 'Region', 'Supplier')")
    return G.induced(D.rels(spark, sf_dir), places, F.col("type") == "IN").distinct()
