"""Queries over the graph of documents, chunks, entities and communities, and over the details of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import communities as C
from tessera.operators import curation as U
from tessera.operators import ingest
from tessera.operators import models as M
from tessera.operators import reporting as P
from tessera.operators import subgraph as S
from tessera.plans import derived as D
from tessera.plans.registry import query

FILES = ["doc_3", "doc_14", "doc_15", "doc_92"]
_SELECTED = f"""sel AS (SELECT file, position, chunk_id FROM chunks WHERE file IN {tuple(FILES)} QUALIFY row_number() OVER (PARTITION BY file ORDER BY position) <= 50),
    has AS (SELECT DISTINCT m.chunk_id, entity FROM mentions m JOIN sel s ON s.file = m.file AND s.position = m.position), ent AS (SELECT DISTINCT entity FROM has),
    lv AS (SELECT entity, 0 AS level, '0-' || c0 AS community, '1-' || c1 AS parent FROM lists WHERE entity IN (SELECT entity FROM ent) UNION ALL SELECT entity, 1, '1-' || c1, '2-' || c2 FROM lists WHERE entity IN (SELECT entity FROM ent)
        UNION ALL SELECT entity, 2, '2-' || c2, NULL FROM lists WHERE entity IN (SELECT entity FROM ent))"""


def _files(spark):
    return spark.createDataFrame([(x,) for x in FILES], "file string")


def _texts(spark, sf_dir):
    """The chosen files with their texts, of which alone chunks are cut."""
    return D.files(spark, sf_dir).join(F.broadcast(_files(spark)), "file", "left_semi")


def _subgraph(spark, sf_dir):
    m, own = D.mentions(spark, sf_dir), _texts(spark, sf_dir)
    return S.document_subgraph(own.select("file"), ingest.chunk_windows(own), m, D.edges(spark, sf_dir), D.community_lists(m))


@query(D.sql(f"""SELECT 'Document' AS type, file AS a FROM words WHERE file IN {tuple(FILES)} UNION SELECT 'Chunk', chunk_id FROM sel UNION SELECT 'Entity', entity FROM ent UNION SELECT 'Community', community FROM lv""", "edges", "lists", also=_SELECTED))
def document_subgraph_nodes(spark, sf_dir):
    return _subgraph(spark, sf_dir)[0]


@query(D.sql("""SELECT 'PART_OF' AS type, chunk_id AS a, file AS b FROM sel UNION SELECT 'FIRST_CHUNK', file, chunk_id FROM sel WHERE position = 1
    UNION SELECT 'NEXT_CHUNK', before, chunk_id FROM (SELECT chunk_id, lag(chunk_id) OVER (PARTITION BY file ORDER BY position) AS before FROM sel) WHERE before IS NOT NULL UNION SELECT 'HAS_ENTITY', chunk_id, entity FROM has
    UNION SELECT 'RELATED', source, target FROM edges WHERE source IN (SELECT entity FROM ent) AND target IN (SELECT entity FROM ent) UNION SELECT 'IN_COMMUNITY', entity, community FROM lv WHERE level = 0
    UNION SELECT 'PARENT_COMMUNITY', community, parent FROM lv WHERE parent IS NOT NULL""", "edges", "lists", also=_SELECTED))
def document_subgraph_rels(spark, sf_dir):
    return _subgraph(spark, sf_dir)[1]


@query(D.sql("SELECT file, count(*) AS n, max(position) AS last FROM (SELECT file, position FROM chunks QUALIFY row_number() OVER (PARTITION BY file ORDER BY position) <= 3) GROUP BY file", "chunks"))
def first_chunks(spark, sf_dir):
    return S.first_chunks(D.chunks(spark, sf_dir), D.files(spark, sf_dir), 3).groupBy("file").agg(F.count("*").alias("n"), F.max("position").alias("last"))


_ANSWER = f"""used AS (SELECT DISTINCT chunk_id FROM chunks WHERE file IN {tuple(FILES)} AND position <= 2), has AS (SELECT DISTINCT chunk_id, entity FROM mentions WHERE chunk_id IN (SELECT chunk_id FROM used))"""


def _used(spark, sf_dir):
    return ingest.chunk_windows(_texts(spark, sf_dir)).where("position <= 2").select("chunk_id").distinct()


@query(D.sql("""SELECT 'Chunk' AS type, chunk_id AS a, '' AS b FROM used UNION SELECT 'Entity', entity, '' FROM has UNION SELECT 'HAS_ENTITY', chunk_id, entity FROM has
    UNION SELECT 'RELATED', source, target FROM edges WHERE source IN (SELECT entity FROM has) AND target IN (SELECT entity FROM has)""", "edges", also=_ANSWER))
def chunk_answer(spark, sf_dir):
    nodes, rels = S.chunk_answer(D.mentions(spark, sf_dir), D.edges(spark, sf_dir), _used(spark, sf_dir))
    return nodes.withColumn("b", F.lit("")).unionByName(rels)


@query(D.sql("SELECT '1-' || c1 AS community, count(*) AS n_entities, '1-' || c1 || ': ' || count(*) || ' entities' AS summary FROM lists WHERE c1 IN (0, 2, 4) GROUP BY c1", "lists"))
def community_details(spark, sf_dir):
    """Communities by their ids."""
    own = D.community_lists(D.mentions(spark, sf_dir)).select(C.level_id(F.lit(1), F.get("communities", F.lit(1))).alias("community"))
    of = own.where(F.col("community").isin("1-0", "1-2", "1-4")).groupBy("community").agg(F.count("*").alias("n_entities"))
    return of.select("community", "n_entities", F.concat("community", F.lit(": "), F.col("n_entities").cast("string"), F.lit(" entities")).alias("summary"))


@query(D.sql(r"SELECT DISTINCT chunk_id, regexp_replace(text, '\s+', ' ', 'g') AS text FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM used)", "chunks", also=_ANSWER.split(", has AS")[0]))
def answer_details(spark, sf_dir):
    """The dispatch by mode: here of one that answers by chunks, whose white space collapses."""
    by_chunks = lambda: D.chunks(spark, sf_dir).join(_used(spark, sf_dir), "chunk_id", "left_semi").select("chunk_id", F.regexp_replace("text", "\\s+", " ").alias("text")).distinct()
    return S.answer_details("vector", by_chunks, lambda: D.edges(spark, sf_dir), lambda: community_details(spark, sf_dir))


@query("""SELECT c_nationkey AS id, c_mktsegment || '' AS label, 'node' AS kind, 1 AS n FROM (SELECT c_nationkey, min(c_mktsegment) AS c_mktsegment FROM customer GROUP BY c_nationkey) UNION ALL SELECT c_nationkey, NULL, 'rel', count(DISTINCT c_mktsegment) FROM customer GROUP BY c_nationkey""")
def merged_records(spark, sf_dir):
    """Records with a node and an edge each, of which many repeat."""
    own = D.table(spark, sf_dir, "customer")
    node = F.struct(F.col("c_nationkey").alias("id"), F.array(F.lit("__Entity__"), F.col("c_mktsegment")).alias("labels"))
    rel = F.struct(F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("id"), F.col("c_nationkey").alias("src"))
    nodes, rels = S.merged_records(own.select(F.array(node).alias("nodes"), F.array(rel, rel).alias("rels")), "nodes", "rels")
    n = nodes.select("id", F.get("labels", F.lit(0)).alias("label"), F.lit("node").alias("kind"), F.lit(1).cast("long").alias("n"))
    return n.unionByName(rels.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).select("id", F.lit(None).cast("string").alias("label"), F.lit("rel").alias("kind"), "n"))


@query(D.sql("SELECT '0-' || c0 AS id, coalesce(CASE WHEN c0 % 2 = 0 THEN c0 / 10.0 END, 1)::DOUBLE AS score FROM (SELECT DISTINCT c0 FROM lists)", "lists"))
def community_scores(spark, sf_dir):
    """Scores that a search gave some communities put back on all; 1 where it gave none."""
    own = D.community_lists(D.mentions(spark, sf_dir)).select(F.get("communities", F.lit(0)).alias("c")).distinct()
    rows = own.select(C.level_id(F.lit(0), F.col("c")).alias("id"))
    return S.with_scores(rows, own.where("c % 2 = 0").select(C.level_id(F.lit(0), F.col("c")).alias("id"), (F.col("c") / 10).alias("score")), 1.0)


@query(f"""SELECT DISTINCT 'entities' AS kind, p_brand AS id FROM part UNION SELECT DISTINCT 'relationships', p_type FROM part WHERE p_partkey % 2 = 0""")
def used_ids(spark, sf_dir):
    """Ids that an answer's documents name in their lists, each once."""
    own = D.table(spark, sf_dir, "part")
    docs = own.select(F.array("p_brand").alias("entities"), F.when(F.col("p_partkey") % 2 == 0, F.array("p_type", "p_type")).otherwise(F.array().cast("array<string>")).alias("relationships"))
    return S.used_ids(docs, ["entities", "relationships"])


_PATTERNS = """p AS (SELECT DISTINCT r_name AS target, 'IN' AS relation, n_name AS source FROM nation JOIN region ON n_regionkey = r_regionkey), labels AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT source AS label FROM p UNION SELECT target FROM p))"""


@query(f"WITH {_PATTERNS} SELECT 'node' AS kind, id AS a, NULL AS b, label AS name FROM labels UNION ALL SELECT 'rel', x.id, y.id, relation FROM p JOIN labels x ON x.label = source JOIN labels y ON y.label = target")
def schema_from_patterns(spark, sf_dir):
    """Labels and edges that triplets of text name."""
    nation, region = D.table(spark, sf_dir, "nation"), D.table(spark, sf_dir, "region")
    joined = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    triplets = joined.select(T.parse_triplet(T.triplet(F.col("n_name"), F.lit("IN"), F.col("r_name"))).alias("t")).select("t.*")
    nodes, rels = S.schema_of(triplets)
    n = nodes.select(F.lit("node").alias("kind"), F.col("id").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.col("label").alias("name"))
    return n.unionByName(rels.select(F.lit("rel").alias("kind"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("relation").alias("name")))


@query(D.sql("""SELECT entity, array_to_string(list_sort(list(DISTINCT file)), ',') AS documents, count(DISTINCT chunk_id) AS chunk_connections FROM mentions
    WHERE entity NOT IN (SELECT source FROM edges UNION SELECT target FROM edges) GROUP BY entity ORDER BY entity LIMIT 100""", "edges"))
def orphan_page(spark, sf_dir):
    """The first hundred entities without an edge, with where they are mentioned."""
    m = D.mentions(spark, sf_dir)
    ends = D.edges(spark, sf_dir).select(F.col("source").alias("src"), F.col("target").alias("dst"))
    alone = U.orphans(m.select(F.col("entity").alias("node_id")).distinct(), ends).orderBy("node_id").limit(100)
    of = U.provenance(alone, m.withColumnRenamed("entity", "node_id"))
    return of.select(F.col("node_id").alias("entity"), F.array_join("documents", ",").alias("documents"), "chunk_connections").orderBy("entity")


@query(D.sql("""SELECT (SELECT count(DISTINCT entity) FROM mentions WHERE entity NOT IN (SELECT source FROM edges UNION SELECT target FROM edges)) AS orphans, (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM part GROUP BY p_brand, p_name)) AS merged""", "edges"))
def curation_totals(spark, sf_dir):
    m, part = D.mentions(spark, sf_dir), D.table(spark, sf_dir, "part")
    ends = D.edges(spark, sf_dir).select(F.col("source").alias("src"), F.col("target").alias("dst"))
    orphans = U.orphans(m.select(F.col("entity").alias("node_id")).distinct(), ends).agg(F.count("*").alias("orphans"))
    return orphans.crossJoin(F.broadcast(part.groupBy("p_brand", "p_name").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("merged"))))


@query(D.sql("""SELECT entity FROM mentions WHERE file IN ('doc_3', 'doc_14', 'doc_15', 'doc_92') GROUP BY entity""", "mentions"))
def entities_deleted_for_retry(spark, sf_dir):
    """Entities that go before documents are done again, shared ones too."""
    return U.entities_of(D.mentions(spark, sf_dir), _files(spark), shared=True)


@query(D.sql("SELECT DISTINCT entity, entity || ' ' AS text FROM mentions WHERE length(entity) > 8", "mentions"))
def entity_texts(spark, sf_dir):
    """What is embedded of entities that have no vector yet (here those with long names): name and description."""
    own = D.mentions(spark, sf_dir).where("label = 'Long'").select("entity").distinct()
    return own.select("entity", F.concat("entity", F.lit(" "), F.coalesce(F.lit(None).cast("string"), F.lit(""))).alias("text"))


@query(D.sql("SELECT '1-' || c1 AS parent, count(DISTINCT c0) AS n_children, string_agg(DISTINCT '0-' || c0, ' ' ORDER BY '0-' || c0) AS texts FROM lists GROUP BY c1", "lists"))
def child_summaries(spark, sf_dir):
    """For each community the texts (here ids, five at most) of those below it that have one."""
    pairs = D.community_lists(D.mentions(spark, sf_dir)).select(C.level_id(F.lit(1), F.get("communities", F.lit(1))).alias("parent"), C.level_id(F.lit(0), F.get("communities", F.lit(0))).alias("child")).distinct()
    return pairs.groupBy("parent").agg(F.count("*").alias("n_children"), F.array_join(F.array_sort(F.collect_list("child")), " ").alias("texts"))


@query(D.sql("SELECT label, count(DISTINCT entity) AS n, min(entity) AS first FROM mentions WHERE chunk_id IN (SELECT chunk_id FROM used) GROUP BY label ORDER BY n DESC", "mentions", also=_ANSWER.split(", has AS")[0]))
def answer_label_counts(spark, sf_dir):
    """Entities of an answer by their label, most first."""
    own = D.mentions(spark, sf_dir).join(F.broadcast(_used(spark, sf_dir)), "chunk_id", "left_semi")
    return own.groupBy("label").agg(F.count_distinct("entity").alias("n"), F.min("entity").alias("first")).orderBy(F.desc("n"), "label")


@query(D.sql("""SELECT node_id, label, caption, contains(lower(caption), 'st') OR contains(lower(node_id), 'st') AS selected FROM nodes""", "nodes"))
def searched_nodes(spark, sf_dir):
    """Nodes that a search in the drawn graph marks."""
    has = lambda c: F.contains(F.lower(c), F.lit("st"))
    return D.nodes(spark, sf_dir).select("node_id", "label", "caption", (has("caption") | has("node_id")).alias("selected"))


@query(D.sql("""SELECT node_id, CASE WHEN label = 'Order' THEN '*' ELSE label END AS labels, coalesce(nullif(caption, ''), ' ') AS title FROM nodes""", "nodes"))
def projected_nodes(spark, sf_dir):
    """Nodes as they are sent: labels without the system's (* for none), a title, and no heavy property."""
    labels = F.when(F.col("label") == "Order", F.array(F.lit("__Entity__"))).otherwise(F.array(F.lit("__Entity__"), F.col("label")))
    own = D.nodes(spark, sf_dir).withColumn("labels", labels)
    bare = F.array_except("labels", F.array(F.lit("__Entity__")))
    return own.select("node_id", F.array_join(F.when(F.size(bare) == 0, F.array(F.lit("*"))).otherwise(bare), ",").alias("labels"), F.coalesce(F.nullif("caption", F.lit("")), F.lit(" ")).alias("title"))


@query(D.sql("SELECT type || ':' || src || '>' || dst AS id, type, src, dst FROM rels", "rels"))
def projected_rels(spark, sf_dir):
    return D.rels(spark, sf_dir).select(F.concat("type", F.lit(":"), "src", F.lit(">"), "dst").alias("id"), "type", "src", "dst")


@query(D.sql("SELECT node_id FROM nodes WHERE label IN ('Nation', 'Region')", "nodes"))
def single_label_nodes(spark, sf_dir):
    """Nodes with exactly one label (here nations and regions; others have their kind besides)."""
    labels = F.when(F.col("label").isin("Nation", "Region"), F.array("label")).otherwise(F.array(F.col("label"), F.lit("Thing")))
    return D.nodes(spark, sf_dir).withColumn("labels", labels).where("size(labels) = 1").select("node_id")


@query(D.sql("SELECT name, kind, n, row_number() OVER (ORDER BY kind, CASE WHEN name IN ('Region', 'Nation') THEN 0 ELSE 1 END, lower(name)) AS place FROM (SELECT label AS name, 'node' AS kind, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT type, 'relationship', count(*) FROM rels GROUP BY type)", "nodes", "rels"))
def sorted_legend(spark, sf_dir):
    """The legend in its order: the two basic labels first, then by name in either case."""
    from pyspark.sql import Window

    from tessera.plans.graph import legend

    w = Window.orderBy("kind", F.when(F.col("name").isin("Region", "Nation"), 0).otherwise(1), F.lower("name"))  # a row a label or type
    return legend(spark, sf_dir).withColumn("place", F.row_number().over(w))


@query(D.sql("""SELECT g.file, g.group_no, chunk_id FROM (SELECT file, ((position - 1) // 3)::INTEGER AS group_no, chunk_id FROM chunks) g""", "chunks"))
def group_chunks(spark, sf_dir):
    """Chunks of each group that was extracted together."""
    from tessera.operators import ingest

    return ingest.chunk_groups(D.chunks(spark, sf_dir), 3).select("file", "group_no", F.explode("combined_chunk_ids").alias("chunk_id"))


@query("""SELECT b.item_id, b.item_id IN (SELECT doc_id FROM documents) AS answered, d.n_chars FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id""")
def answers_with_truth(spark, sf_dir):
    """Questions with the answers to them, where there are any."""
    own, docs = D.table(spark, sf_dir, "benchmark").select("item_id"), D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "n_chars", F.lit(True).alias("a"))
    return own.join(docs, "item_id", "left").select("item_id", F.coalesce("a", F.lit(False)).alias("answered"), "n_chars")


@query(D.sql("""SELECT a.file, round(len(list_intersect(a.e, b.e)) / len(a.e)::DOUBLE, 4) AS recall FROM (SELECT file, list(DISTINCT entity) AS e FROM mentions WHERE position = 1 GROUP BY file) a JOIN (SELECT file, list(DISTINCT entity) AS e FROM mentions WHERE position = 2 GROUP BY file) b USING (file)""", "mentions"))
def entity_recall(spark, sf_dir):
    """Of entities that the first chunk of a document mentions, the share that the second does too."""
    m = D.mentions(spark, sf_dir)
    return P.entity_recall(m.where("position = 1").select(F.col("file").alias("id"), "entity"), m.where("position = 2").select(F.col("file").alias("id"), "entity")).withColumnRenamed("id", "file")


@query(D.sql("SELECT a.id, round(list_cosine_similarity(a.embedding, b.embedding), 4) AS score FROM vectors a JOIN vectors b ON b.id = a.id + 1", "vectors"))
def semantic_score(spark, sf_dir):
    """Cosine of the vectors of answers and of what they should be (here of neighbours)."""
    v = D.vectors(spark, sf_dir)
    return P.semantic_score(v.select("id", F.col("embedding").alias("a")).join(v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("b")), "id"))


@query()
def transcript_alignment(spark, sf_dir):
    """Where a conversation's text begins and ends among its turns, by the likeness of its first and last forty characters."""
    from tessera.streaming import transcript

    own = D.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video"), F.col("turn").alias("start"), F.col("text"))
    return transcript.align(own.select("video", F.col("text").alias("chunk")), own)


def _summaries(spark, sf_dir):
    """Communities of a level with title and summary, the first of which has been written before."""
    own = D.community_lists(D.mentions(spark, sf_dir)).select("entity", C.level_id(F.lit(1), F.get("communities", F.lit(1))).alias("community"))
    of = own.groupBy("community").agg(F.min("entity").alias("first"), F.count("*").alias("n"))
    node = F.array(F.struct(F.col("first").alias("id"), F.lit("Entity").alias("type"), F.lit(None).cast("string").alias("description")))
    none = F.array().cast("array<struct<start string, type string, end string>>")
    return M.summarize(of.withColumn("text", T.community_text(node, none)), "text")


@query(D.sql("""SELECT community, n, 'id: ' || first_entity || ', type: Entity' AS title, 'Nodes are: id: ' || first_entity || ', type: Entity Relationships are:' AS summary FROM (SELECT '1-' || c1 AS community, min(entity) AS first_entity, count(*) AS n FROM lists GROUP BY c1)""", "lists"))
def community_summaries(spark, sf_dir):
    """Titles and summaries that a writer which is put in gives communities."""
    return _summaries(spark, sf_dir).select("community", "n", "title", "summary")


@query(D.sql("""SELECT '1-' || c1 AS community, CASE WHEN c1 % 2 = 0 THEN 'written' ELSE 'old' END AS summary, c1 % 3 = 0 AS has_vector, c1 % 3 <> 0 AS to_embed FROM lists GROUP BY c1""", "lists"))
def stored_summaries(spark, sf_dir):
    """Summaries and vectors that are written back by id; those without a vector are embedded next."""
    c = D.community_lists(D.mentions(spark, sf_dir)).select(F.get("communities", F.lit(1)).alias("c")).distinct()
    rows = c.select("c", C.level_id(F.lit(1), F.col("c")).alias("community"), F.lit("old").alias("summary"))
    written = M.set_columns(rows, rows.where("c % 2 = 0").select("community", F.lit("written").alias("summary")), "community")
    whole = M.set_columns(written, rows.where("c % 3 = 0").select("community", F.array(F.lit(1.0)).alias("embedding")), "community")
    todo = C.to_embed(whole).select("community", F.lit(True).alias("todo"))
    return whole.join(todo, "community", "left").select("community", "summary", F.col("embedding").isNotNull().alias("has_vector"), F.coalesce("todo", F.lit(False)).alias("to_embed"))


@query(D.sql("""SELECT label, count(*) AS n FROM nodes WHERE label <> 'Region' GROUP BY label""", "nodes"))
def cleared_communities(spark, sf_dir):
    """The graph without its communities (here regions)."""
    n = D.nodes(spark, sf_dir)
    return C.cleared(n, n.withColumn("communities", F.array(F.lit(1))), "Region")[0].groupBy("label").agg(F.count("*").alias("n"))


@query(D.sql("""SELECT *, dense_rank() OVER (ORDER BY source) AS source_id FROM (SELECT a.label AS source, r.type, b.label AS target, count(*) AS n FROM rels r JOIN nodes a ON a.node_id = r.src JOIN nodes b ON b.node_id = r.dst GROUP BY ALL)""", "nodes", "rels"))
def schema_drawing(spark, sf_dir):
    """The schema as a graph of its own: an edge for each (label, type, label), labels numbered."""
    from pyspark.sql import Window

    from tessera.operators import graph as G

    own = G.triplet_schema(D.nodes(spark, sf_dir), D.rels(spark, sf_dir))
    return own.withColumn("source_id", F.dense_rank().over(Window.orderBy("source")))  # a row a triplet of labels


@query(D.sql(f"""SELECT 'entity' AS part, entity AS value FROM nodes UNION ALL SELECT 'relationship', source || '|' || target FROM edges WHERE source IN (SELECT entity FROM nodes) AND target IN (SELECT entity FROM nodes)
    UNION ALL SELECT 'outside', b FROM (SELECT b, count(*) AS n FROM (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges) WHERE a IN (SELECT entity FROM nodes) AND b NOT IN (SELECT entity FROM nodes) GROUP BY b ORDER BY n DESC, b LIMIT 10)""",
    "edges", also="nodes AS (SELECT DISTINCT entity FROM mentions ORDER BY entity LIMIT 12)"))
def entity_details(spark, sf_dir):
    """What surrounds entities that are given by their ids: edges among them and the busiest neighbours outside."""
    from tessera.operators import retrieval as R

    m = D.mentions(spark, sf_dir)
    seeds = m.select("entity").distinct().orderBy("entity").limit(12)
    members = D.community_lists(m).select("entity", C.level_id(F.lit(0), F.get("communities", F.lit(0))).alias("community"))
    ranks = C.rank(members, m).join(C.weight(members, m), "community")
    return R.local_context(seeds, m, D.edges(spark, sf_dir), members, ranks).where("part IN ('entity', 'relationship', 'outside')")
