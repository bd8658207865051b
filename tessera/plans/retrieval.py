"""Queries of the retrieval modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.vectors import cosine, scaled
from tessera.operators import fulltext as X
from tessera.operators import retrieval as R
from tessera.operators import vector_index as V
from tessera.plans import derived as D
from tessera.plans.registry import query

#: Terms of the keyword queries.
TERMS = ["thand", "inear", "oner"]


def _question(spark, sf_dir) -> list[float]:
    """The vector that stands for a question: that of the first row."""
    row = D.table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").head()
    if row is None:
        raise ValueError("no vector to ask for")
    return [float(x) for x in row[0]]


_SCORED = "scored AS (SELECT *, round((1 + list_cosine_similarity(embedding, (SELECT embedding FROM vectors WHERE id = 0))) / 2, 4) AS score FROM vectors)"
_LOWER = r"""lw AS (SELECT 'doc_' || doc_id AS id, list_filter(string_split(trim(regexp_replace(translate(lower(translate(text, '.,', '')), chr(10) || '"' || chr(39), ' '), '[ \t\r\n]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents)"""
_BM25 = f"""{_LOWER}, terms AS (SELECT unnest({TERMS}) AS t), stats AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM lw),
    tf AS (SELECT id, t, len(w) AS dl, len(list_filter(w, lambda x: x = t)) AS f FROM lw, terms), df AS (SELECT t, count(*) FILTER (f > 0) AS d FROM tf GROUP BY t),
    bm AS (SELECT id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (t), stats GROUP BY id HAVING sum(f) > 0)"""


@query(D.sql("SELECT id, file, score FROM scored WHERE score >= 0.5 ORDER BY score DESC, id LIMIT 5", "vectors", also=_SCORED))
def vector_topk(spark, sf_dir):
    """Through the index, exactly: cells that cannot hold a better row are not read."""
    return V.search(D.vector_index(spark, sf_dir), _question(spark, sf_dir), 5, 0.5, exact=True).select("id", "file", "score")


@query(D.sql("""SELECT file, string_agg(text, chr(10) ORDER BY score DESC, text) AS text, round(avg(score), 4) AS score, count(*) AS n_chunks
    FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 10) GROUP BY file""", "vectors", also=_SCORED))
def vector_topk_docs(spark, sf_dir):
    hits = R.vector_top(D.vectors(spark, sf_dir), _question(spark, sf_dir), 10)
    return R.document_texts(hits.withColumn("chunk_id", F.col("text")))


@query(D.sql("SELECT id, file, score FROM scored WHERE file IN ('doc_1', 'doc_2', 'doc_3') ORDER BY score DESC, id LIMIT 5", "vectors", also=_SCORED))
def vector_filtered(spark, sf_dir):
    """Search inside selected documents; the filter comes before the top."""
    own = D.vectors(spark, sf_dir).where(F.col("file").isin("doc_1", "doc_2", "doc_3"))
    return R.vector_top(own, _question(spark, sf_dir), 5).select("id", "file", "score")


@query(D.sql("SELECT id, score FROM scored WHERE score >= 0.55", "vectors", also=_SCORED))
def embedding_filter(spark, sf_dir):
    vector = F.array(*(F.lit(x) for x in _question(spark, sf_dir)))
    return D.vectors(spark, sf_dir).select("id", F.round(scaled(cosine(F.col("embedding"), vector)), 4).alias("score")).where("score >= 0.55")


@query(D.sql("""SELECT a AS id, b AS neighbour, score FROM (SELECT a.id AS a, b.id AS b, round((1 + list_cosine_similarity(a.embedding, b.embedding)) / 2, 4) AS score FROM vectors a, vectors b WHERE a.id <> b.id)
    QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5""", "vectors"))
def knn_topk(spark, sf_dir):
    return V.neighbours(D.vector_index(spark, sf_dir), 5, exact=True)


@query("SELECT 5 AS k, count(*) AS n, true AS reached FROM embeddings")
def knn_recall(spark, sf_dir):
    """Whether the neighbours in the cells that the index opens by itself are nine of ten true ones or more, over all rows."""
    index = D.vector_index(spark, sf_dir)
    true, found = V.neighbours(index, 5, exact=True), V.neighbours(index, 5)
    # Of neighbours with one score any may be given.
    least = true.groupBy("id").agg(F.min("score").alias("least"), F.count("*").alias("wanted"))
    hits = found.join(least, "id").where("score >= least").groupBy("id").agg(F.count("*").alias("hits"))
    of = least.join(hits, "id", "left").agg(F.count("*").alias("n"), (F.sum(F.coalesce("hits", F.lit(0))) / F.sum("wanted")).alias("recall"))
    return of.select(F.lit(5).alias("k"), "n", (F.col("recall") >= 0.9).alias("reached"))


_KNN = """k AS (SELECT a, b, score FROM (SELECT a.id AS a, b.id AS b, round((1 + list_cosine_similarity(a.embedding, b.embedding)) / 2, 4) AS score FROM vectors a, vectors b WHERE a.id <> b.id)
    WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)"""


@query(D.sql("SELECT least(a, b) AS source, greatest(a, b) AS target, max(score) AS score FROM k GROUP BY ALL", "vectors", also=_KNN))
def knn_edges(spark, sf_dir):
    return R.similar_edges(V.neighbours(D.vector_index(spark, sf_dir), 5, 0.6, exact=True))


@query(f"WITH {_BM25} SELECT id, score FROM bm")
def fulltext_bm25(spark, sf_dir):
    return R.bm25(*D.keyword_index(spark, sf_dir), TERMS)


@query(f"WITH {_BM25} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 10")
def fulltext_top(spark, sf_dir):
    """The ten best, by blocks whose bound reaches them."""
    return X.top(D.text_index(spark, sf_dir), TERMS, 10)[0]


@query(f"""WITH {_LOWER} SELECT id, array_to_string(s, ',') AS starts FROM (SELECT id, list_filter(range(0, len(w)), lambda i: w[i + 1] = 'that' AND w[i + 2] = 'the') AS s FROM lw) WHERE len(s) > 0""")
def fulltext_phrase(spark, sf_dir):
    """Where two words follow each other."""
    return X.phrase(D.text_index(spark, sf_dir), ["that", "the"]).select("id", F.array_join(F.col("starts").cast("array<string>"), ",").alias("starts"))


@query(D.sql(r"""SELECT file || '#' || position AS id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'in' AND w[i + 1] = 'the')) AS n FROM (SELECT file, position, list_filter(string_split(lower(translate(text, '.,', '')), ' '), lambda x: x <> '') AS w FROM chunks) WHERE n > 0""", "chunks"))
def chunk_phrase(spark, sf_dir):
    """Chunks in which two words follow each other, and how often."""
    return X.phrase(D.text_index(spark, sf_dir, "chunks"), ["in", "the"]).select("id", F.size("starts").cast("long").alias("n"))


@query(f"""WITH {_LOWER} SELECT id FROM lw WHERE list_contains(w, 'that') AND list_has_any(w, {TERMS}) AND NOT list_contains(w, 'was')""")
def fulltext_boolean(spark, sf_dir):
    """Texts with one word, one of some others, and without a third."""
    return X.boolean(D.text_index(spark, sf_dir), ["that"], TERMS, ["was"])


@query(D.sql("SELECT label || ':' || entity AS id, (starts_with(lower(entity), 'sh')::INT + starts_with(lower(label), 'sh')::INT)::BIGINT AS n FROM (SELECT DISTINCT entity, label FROM mentions) WHERE n > 0", "mentions"))
def entity_prefix(spark, sf_dir):
    """Entities whose name or label has a word that begins so."""
    return X.prefix(D.text_index(spark, sf_dir, "entities"), "sh")


@query(D.sql("""SELECT id, round(max(score), 6) AS score FROM (SELECT id, score / (SELECT max(score) FROM bm) AS score FROM bm
    UNION ALL SELECT file, score / (SELECT max(score) FROM v) FROM v) GROUP BY id ORDER BY score DESC, id LIMIT 10""", "vectors", also=f"{_SCORED}, v AS (SELECT file, max(score) AS score FROM scored GROUP BY file), {_BM25}"))
def hybrid_topk(spark, sf_dir):
    vector = F.array(*(F.lit(x) for x in _question(spark, sf_dir)))
    v = D.vectors(spark, sf_dir).select(F.col("file").alias("id"), F.round(scaled(cosine(F.col("embedding"), vector)), 4).alias("s")).groupBy("id").agg(F.max("s").alias("score"))
    return R.fuse(R.bm25(*D.keyword_index(spark, sf_dir), TERMS), v).orderBy(F.desc("score"), "id").limit(10)


@query(D.sql("""SELECT file, entity, n FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, entity) AS r FROM (SELECT file, entity, count(*) AS n
    FROM mentions WHERE file IN (SELECT file FROM (SELECT file FROM scored ORDER BY score DESC, id LIMIT 5)) GROUP BY file, entity)) WHERE r <= 40""", "vectors", "mentions", also=_SCORED))
def graph_vector_entities(spark, sf_dir):
    """Entities of the documents that a vector search finds, the 40 most frequent of each."""
    hits = R.vector_top(D.vectors(spark, sf_dir), _question(spark, sf_dir), 5).select("file").distinct()
    n = D.mentions(spark, sf_dir).join(F.broadcast(hits), "file").groupBy("file", "entity").agg(F.count("*").alias("n"))
    return R.top_per(n, "file", 40, F.desc("n"), "entity")


@query(D.sql("""SELECT e.source, e.target, e.weight FROM (SELECT least(entity, next) AS source, greatest(entity, next) AS target, count(*) AS weight FROM pairs GROUP BY ALL) e
    WHERE e.source IN (SELECT entity FROM seed) OR e.target IN (SELECT entity FROM seed)""", "pairs", also="seed AS (SELECT entity FROM mentions GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 10)"))
def entity_neighbourhood(spark, sf_dir):
    """Edges at the ten entities that are mentioned most."""
    seed = D.mentions(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(10).select("entity")
    edges = D.edges(spark, sf_dir)
    at = edges.join(F.broadcast(seed.withColumnRenamed("entity", "source")), "source", "left_semi")
    other = edges.join(F.broadcast(seed.withColumnRenamed("entity", "target")), "target", "left_semi")
    return at.unionByName(other).distinct()


@query(D.sql("""SELECT DISTINCT '0-' || c0 AS community, (SELECT count(*) FROM lists b WHERE b.c0 = a.c0) AS n_entities FROM lists a JOIN seed USING (entity)""", "lists", also="seed AS (SELECT entity FROM mentions GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 10)"))
def local_communities(spark, sf_dir):
    """Communities of the ten entities that are mentioned most, with their sizes."""
    m = D.mentions(spark, sf_dir)
    seed = m.groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(10).select("entity")
    lists = D.community_lists(m).select("entity", F.concat_ws("-", F.lit("0"), F.get("communities", F.lit(0)).cast("string")).alias("community"))
    near = lists.join(F.broadcast(seed), "entity", "left_semi").select("community").distinct()
    return lists.join(F.broadcast(near), "community").groupBy("community").agg(F.count("*").alias("n_entities"))


@query(D.sql("SELECT string_agg(summary, chr(10) ORDER BY community) AS text, count(*) AS n FROM (SELECT c1 AS community, '1-' || c1 || ': ' || count(*) || ' entities' AS summary FROM lists GROUP BY c1)", "lists"))
def global_summary(spark, sf_dir):
    """The summaries of all communities of a level as one text: as many lines as there are communities."""
    lists = D.community_lists(D.mentions(spark, sf_dir)).groupBy(F.get("communities", F.lit(1)).alias("community")).agg(F.count("*").alias("n"))
    line = F.concat(F.lit("1-"), F.col("community").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" entities"))
    o = lists.agg(F.array_sort(F.collect_list(F.struct("community", line.alias("line")))).alias("o"), F.count("*").alias("n"))
    return o.select(F.array_join(F.transform("o", lambda x: x.line), "\n").alias("text"), "n")


@query(D.sql("SELECT DISTINCT file, id, score FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 20)", "vectors", also=_SCORED))
def source_details(spark, sf_dir):
    return R.vector_top(D.vectors(spark, sf_dir), _question(spark, sf_dir), 20).select("file", "id", "score").dropDuplicates(["id", "score"])


_EHITS = """eh AS (SELECT entity, round((1 + list_cosine_similarity(embedding, (SELECT embedding FROM vectors WHERE id = 0))) / 2, 4) AS score FROM evectors), nodes AS (SELECT entity, score FROM eh WHERE score >= 0.5 ORDER BY score DESC, entity LIMIT 10)"""


def _entity_hits(spark, sf_dir):
    """The ten entities most like the question."""
    return R.vector_top(D.entity_vectors(spark, sf_dir).withColumnRenamed("entity", "id"), _question(spark, sf_dir), 10, 0.5).select(F.col("id").alias("entity"), "score")


@query(D.sql("""SELECT 'entity' AS part, entity AS value FROM nodes
    UNION ALL SELECT 'chunk', chunk_id FROM (SELECT chunk_id, count(DISTINCT entity) AS n FROM mentions WHERE entity IN (SELECT entity FROM nodes) GROUP BY chunk_id ORDER BY n DESC, chunk_id LIMIT 3)
    UNION ALL SELECT 'community', community FROM (SELECT * FROM (SELECT entity, '0-' || c0 AS community FROM lists WHERE entity IN (SELECT entity FROM nodes)) JOIN ranks USING (community)
        ORDER BY community_rank, weight DESC, community, entity LIMIT 3)
    UNION ALL SELECT 'relationship', source || '|' || target FROM edges WHERE source IN (SELECT entity FROM nodes) AND target IN (SELECT entity FROM nodes)
    UNION ALL SELECT 'outside', b FROM (SELECT b, count(*) AS n FROM (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges) WHERE a IN (SELECT entity FROM nodes) AND b NOT IN (SELECT entity FROM nodes)
        GROUP BY b ORDER BY n DESC, b LIMIT 10)""", "vectors", "evectors", "edges", "lists", also=f"""{_EHITS},
    ranks AS (SELECT '0-' || c0 AS community, count(DISTINCT file) AS community_rank, count(DISTINCT chunk_id) AS weight FROM lists JOIN mentions USING (entity) GROUP BY ALL)"""))
def local_search(spark, sf_dir):
    """The whole local search: entities by their vectors, and what surrounds them."""
    from tessera.operators import communities as C

    m = D.mentions(spark, sf_dir)
    members = D.community_lists(m).select("entity", C.level_id(F.lit(0), F.get("communities", F.lit(0))).alias("community"))
    ranks = C.rank(members, m).join(C.weight(members, m), "community")
    return R.local_context(_entity_hits(spark, sf_dir), m, D.edges(spark, sf_dir), members, ranks)


_EXPANDED = """hit_files AS (SELECT DISTINCT file FROM (SELECT file FROM scored ORDER BY score DESC, id LIMIT 5)),
    own AS (SELECT file, entity FROM (SELECT file, entity, row_number() OVER (PARTITION BY file ORDER BY count(*) DESC, entity) AS r FROM mentions WHERE file IN (SELECT file FROM hit_files) GROUP BY file, entity) WHERE r <= 40),
    eh AS (SELECT entity, round((1 + list_cosine_similarity(embedding, (SELECT embedding FROM vectors WHERE id = 0))) / 2, 4) AS score FROM evectors WHERE entity IN (SELECT entity FROM own)),
    seeds AS (SELECT DISTINCT entity AS seed, CASE WHEN score IS NULL OR score BETWEEN 0.3 AND 0.9 THEN 1 WHEN score > 0.9 THEN 2 ELSE 0 END AS hops FROM own LEFT JOIN eh USING (entity)),
    step AS (SELECT source AS a, target AS b, source || '|' || target AS edge FROM edges UNION ALL SELECT target, source, source || '|' || target FROM edges WHERE source <> target),
    one AS (SELECT seed, hops, 1 AS length, b AS "end", edge, NULL AS first FROM seeds JOIN step ON a = seed WHERE hops > 0),
    two AS (SELECT seed, hops, 2 AS length, s.b AS "end", s.edge, one.edge AS first FROM one JOIN step s ON s.a = one."end" AND s.edge <> one.edge WHERE hops > 1),
    paths AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY length, "end", edge NULLS FIRST, first NULLS FIRST) AS r FROM (SELECT seed, hops, 0 AS length, seed AS "end", NULL AS edge, NULL AS first FROM seeds UNION ALL SELECT * FROM one
        UNION ALL SELECT * FROM two)) WHERE r <= CASE WHEN hops > 1 THEN 40 ELSE 20 END)"""


def _context_rows(spark, sf_dir, hit_files):
    """file, kind and text of the entities and edges that the documents' entities lead to."""
    n = D.mentions(spark, sf_dir).join(F.broadcast(hit_files), "file").groupBy("file", "entity").agg(F.count("*").alias("n"))
    own = R.top_per(n, "file", 40, F.desc("n"), "entity").select("file", "entity")
    vector = F.array(*(F.lit(x) for x in _question(spark, sf_dir)))
    scored = D.entity_vectors(spark, sf_dir).select("entity", F.round(scaled(cosine(F.col("embedding"), vector)), 4).alias("score"))
    seeds = own.select("entity").distinct().join(scored, "entity", "left").select(F.col("entity").alias("seed"), R.hops(F.col("score")).alias("hops"))
    paths = own.withColumnRenamed("entity", "seed").join(R.expansion(D.edges(spark, sf_dir), seeds), "seed")
    rows = paths.select("file", F.lit("entity").alias("kind"), F.col("end").alias("text")).unionByName(paths.select("file", F.lit("relationship").alias("kind"), F.explode(F.array("edge", "first")).alias("text")).where("text IS NOT NULL"))
    return rows.distinct()


_CONTEXT = """SELECT DISTINCT file, 'entity' AS kind, "end" AS text FROM own JOIN paths ON seed = entity UNION SELECT DISTINCT file, 'relationship', unnest([edge, first]) AS text FROM own JOIN paths ON seed = entity"""


@query(D.sql(f"SELECT * FROM ({_CONTEXT}) WHERE text IS NOT NULL", "vectors", "evectors", "edges", also=f"{_SCORED}, {_EXPANDED}"))
def graph_vector_context(spark, sf_dir):
    """Documents by their chunks' vectors, their entities, and what these lead to: as far as each is like the question."""
    return _context_rows(spark, sf_dir, R.vector_top(D.vectors(spark, sf_dir), _question(spark, sf_dir), 5).select("file").distinct())


_HYBRID = f"""v AS (SELECT file, max(score) AS score FROM scored GROUP BY file), {_BM25}, hybrid AS (SELECT id, round(max(score), 6) AS score FROM (SELECT id, score / (SELECT max(score) FROM bm) AS score FROM bm
    UNION ALL SELECT file, score / (SELECT max(score) FROM v) FROM v) GROUP BY id)"""


def _hybrid(spark, sf_dir):
    vector = F.array(*(F.lit(x) for x in _question(spark, sf_dir)))
    v = D.vectors(spark, sf_dir).select(F.col("file").alias("id"), F.round(scaled(cosine(F.col("embedding"), vector)), 4).alias("s")).groupBy("id").agg(F.max("s").alias("score"))
    return R.fuse(R.bm25(*D.keyword_index(spark, sf_dir), TERMS), v)


@query(D.sql(f"SELECT * FROM ({_CONTEXT}) WHERE text IS NOT NULL", "vectors", "evectors", "edges",
    also=f"{_SCORED}, {_HYBRID}, {_EXPANDED}".replace("SELECT DISTINCT file FROM (SELECT file FROM scored ORDER BY score DESC, id LIMIT 5)", "SELECT id AS file FROM hybrid ORDER BY score DESC, id LIMIT 5")))
def graph_vector_fulltext_context(spark, sf_dir):
    """As before, with documents by vectors and keywords together."""
    return _context_rows(spark, sf_dir, _hybrid(spark, sf_dir).orderBy(F.desc("score"), "id").limit(5).select(F.col("id").alias("file")))


@query(D.sql("""SELECT id, round(max(score), 6) AS score FROM (SELECT id, score / (SELECT max(score) FROM kw) AS score FROM kw UNION ALL SELECT id, score / (SELECT max(score) FROM cv) FROM cv) GROUP BY id ORDER BY score DESC, id LIMIT 10""", "lists", "vectors", also=r"""
    sums AS (SELECT '1-' || c1 AS id, c1, list(entity) AS w FROM lists GROUP BY c1), terms AS (SELECT unnest(['Thand', 'Inear', 'Oner']) AS t), stats AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM sums),
    tf AS (SELECT id, t, len(w) AS dl, len(list_filter(w, lambda x: x = t)) AS f FROM sums, terms), df AS (SELECT t, count(*) FILTER (f > 0) AS d FROM tf GROUP BY t),
    kw AS (SELECT id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (t), stats GROUP BY id HAVING sum(f) > 0),
    cv AS (SELECT sums.id, round((1 + list_cosine_similarity(v.embedding, (SELECT embedding FROM vectors WHERE id = 0))) / 2, 4) AS score FROM sums JOIN vectors v ON v.id = c1 + 1)"""))
def global_search(spark, sf_dir):
    """Communities of a level by their vectors and by the words of their summaries (their members' names) together, the ten best."""
    own = D.community_lists(D.mentions(spark, sf_dir)).select("entity", F.get("communities", F.lit(1)).alias("c"))
    name = F.concat(F.lit("1-"), F.col("c").cast("string"))
    vector = F.array(*(F.lit(x) for x in _question(spark, sf_dir)))
    cv = own.select("c").distinct().join(D.vectors(spark, sf_dir).select((F.col("id") - 1).alias("c"), "embedding"), "c").select(name.alias("id"), F.round(scaled(cosine(F.col("embedding"), vector)), 4).alias("score"))
    sizes = own.groupBy(name.alias("id")).agg(F.count("*").alias("length"))
    index = own.select(F.col("entity").alias("term"), name.alias("id"), F.lit(1).alias("tf")).join(sizes, "id")
    return R.fuse(R.bm25(index, sizes, ["Thand", "Inear", "Oner"]), cv).orderBy(F.desc("score"), "id").limit(10)


@query(D.sql("""SELECT string_agg('Document start' || chr(10) || 'This Document belongs to the source ' || file || chr(10) || 'Content: ' || text || chr(10) || 'Document end' || chr(10), chr(10) || chr(10) ORDER BY score DESC, file) AS text, count(*) AS n
    FROM (SELECT file, string_agg(text, chr(10) ORDER BY score DESC, text) AS text, round(avg(score), 4) AS score FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 10) GROUP BY file ORDER BY score DESC, file LIMIT 4)""", "vectors", also=_SCORED))
def answer_context(spark, sf_dir):
    """The text that a model gets: the four documents most like the question."""
    hits = R.vector_top(D.vectors(spark, sf_dir), _question(spark, sf_dir), 10)
    return R.context(R.cut_off(R.document_texts(hits.withColumn("chunk_id", F.col("text"))).withColumnRenamed("file", "source"), 4))


@query(D.sql("""SELECT file, k AS piece, array_to_string(w[k * 30 + 1 : k * 30 + 30], ' ') AS text FROM (SELECT file, w, unnest(range(0, ceil(len(w) / 30.0)::BIGINT)) AS k FROM (SELECT * FROM words WHERE doc_id IN (SELECT id FROM scored ORDER BY score DESC, id LIMIT 10)))""", "words", "vectors", also=_SCORED))
def answer_pieces(spark, sf_dir):
    """Retrieved texts cut again, without overlap."""
    hits = R.vector_top(D.vectors(spark, sf_dir), _question(spark, sf_dir), 10).select(F.concat(F.lit("doc_"), F.col("id").cast("string")).alias("file"))
    from tessera.operators.ingest import chunk_windows

    return chunk_windows(D.files(spark, sf_dir).join(F.broadcast(hits), "file"), 30, 0).select("file", (F.col("position") - 1).cast("long").alias("piece"), "text")


@query(D.sql("""SELECT '1-' || c1 AS community, count(*) FILTER (starts_with(entity, 'T')) AS points FROM lists GROUP BY c1 HAVING points > 0""", "lists"))
def scored_communities(spark, sf_dir):
    """Every community of a level gets points for a question (members that begin with T); none is left out but those without."""
    own = D.community_lists(D.mentions(spark, sf_dir)).select("entity", F.concat(F.lit("1-"), F.get("communities", F.lit(1)).cast("string")).alias("community"))
    return own.groupBy("community").agg(F.count_if(F.col("entity").startswith("T")).alias("points")).where("points > 0").orderBy(F.desc("points"), "community")


_LABEL = "CASE WHEN length(text) <= 5 THEN 'Short' WHEN length(text) <= 8 THEN 'Mid' ELSE 'Long' END || ':' || text"


@query(D.sql(f"""SELECT t.file, 'Text Content:' || chr(10) || t.text || chr(10) || '----' || chr(10) || 'Entities:' || chr(10) || c.entities || chr(10) || '----' || chr(10) || 'Relationships:' || chr(10) || coalesce(c.relationships, '') AS text, t.score
    FROM (SELECT file, string_agg(text, chr(10) || '----' || chr(10) ORDER BY score DESC, text) AS text, round(avg(score), 4) AS score FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 5) GROUP BY file) t
    JOIN (SELECT file, string_agg({_LABEL}, chr(10) ORDER BY {_LABEL}) FILTER (kind = 'entity') AS entities, string_agg(replace(text, '|', ' RELATED '), chr(10) ORDER BY replace(text, '|', ' RELATED ')) FILTER (kind = 'relationship') AS relationships
    FROM ({_CONTEXT}) WHERE text IS NOT NULL GROUP BY file) c USING (file)""", "vectors", "evectors", "edges", also=f"{_SCORED}, {_EXPANDED}"))
def graph_vector_texts(spark, sf_dir):
    """The text of each document that is found: its chunks, and the sorted lists of entities and relationships around them."""
    hits = R.vector_top(D.vectors(spark, sf_dir), _question(spark, sf_dir), 5)
    rows = _context_rows(spark, sf_dir, hits.select("file").distinct())
    return R.sectioned(R.document_texts(hits.withColumn("chunk_id", F.col("text")), "\n----\n"), rows)
