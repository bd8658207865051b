"""Queries over documents, chunks, mentions and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import ingest
from tessera.operators import models as M
from tessera.operators import token_chunks as K
from tessera.plans import derived as D
from tessera.plans.registry import query
from tessera.sources import files as sources
from tessera.streaming import status, transcript


@query("SELECT 'doc_' || doc_id AS file, source AS file_source, lang AS language, n_chars AS file_size, 'Completed' AS status FROM documents WHERE doc_id IS NOT NULL")
def doc_list(spark, sf_dir):
    return D.files(spark, sf_dir).select("file", F.col("source").alias("file_source"), F.col("lang").alias("language"), F.col("n_chars").alias("file_size"), F.lit("Completed").alias("status")).where("file IS NOT NULL").orderBy(F.desc("file"))


@query("SELECT 'doc_' || doc_id AS file, source, lang, n_chars FROM documents WHERE doc_id = 42")
def doc_status(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").where("doc_id = 42").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("file"), "source", "lang", "n_chars")


@query(D.sql("SELECT file, position, chunk_id, length, text FROM chunks", "chunks"))
def doc_chunks(spark, sf_dir):
    return D.chunks(spark, sf_dir).select("file", "position", "chunk_id", "length", "text")


@query(D.sql("""SELECT file, position, chunk_id, lag(chunk_id) OVER w AS previous_id,
    coalesce(sum(length) OVER (PARTITION BY file ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS content_offset,
    position = 1 AS is_first, CASE WHEN position = 1 THEN 'FIRST_CHUNK' ELSE 'NEXT_CHUNK' END AS edge FROM chunks WINDOW w AS (PARTITION BY file ORDER BY position)""", "chunks"))
def chunk_chain(spark, sf_dir):
    return ingest.chunk_chain(D.chunks(spark, sf_dir))


@query(D.sql("""SELECT file, ((position - 1) // 3)::INTEGER AS group_no, string_agg(text, ' ' ORDER BY position) AS text, array_to_string(list(chunk_id ORDER BY position), ',') AS ids
    FROM chunks GROUP BY ALL""", "chunks"))
def chunk_groups(spark, sf_dir):
    return ingest.chunk_groups(D.chunks(spark, sf_dir), 3).select("file", "group_no", "text", F.array_join("combined_chunk_ids", ",").alias("ids"))


@query(D.sql("SELECT file, count(*) AS n, max(position) AS last FROM chunks WHERE position <= 5 GROUP BY file", "chunks"))
def chunk_cap(spark, sf_dir):
    return ingest.chunk_windows(D.files(spark, sf_dir), cap=5).groupBy("file").agg(F.count("*").alias("n"), F.max("position").alias("last"))


@query(D.sql("""SELECT file, position, text, ceil(n / 10.0)::BIGINT AS total_pages FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY position) AS r, count(*) OVER (PARTITION BY file) AS n FROM chunks)
    WHERE r BETWEEN 11 AND 20""", "chunks"))
def chunk_page(spark, sf_dir):
    return ingest.page(D.chunks(spark, sf_dir), "file", "position", 2).select("file", "position", "text", "total_pages")


@query(D.sql("SELECT entity, label, count(*) AS n_mentions, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT file) AS n_files FROM mentions GROUP BY entity, label", "mentions"))
def entity_mentions(spark, sf_dir):
    return D.mentions(spark, sf_dir).groupBy("entity", "label").agg(F.count("*").alias("n_mentions"), F.count_distinct("chunk_id").alias("n_chunks"), F.count_distinct("file").alias("n_files"))


@query(D.sql("SELECT least(entity, next) AS source, greatest(entity, next) AS target, count(*) AS weight FROM pairs GROUP BY ALL", "pairs"))
def cooccurrence_edges(spark, sf_dir):
    return D.edges(spark, sf_dir)


@query(D.sql("""SELECT c.file, c.chunk_nodes, coalesce(e.entity_nodes, 0) AS entity_nodes, coalesce(r.entity_rels, 0) AS entity_rels, c.part_of + c.last + coalesce(e.has_entity, 0) AS chunk_rels,
    c.chunk_nodes + coalesce(e.entity_nodes, 0) AS node_count, c.part_of + c.last + coalesce(e.has_entity, 0) + coalesce(r.entity_rels, 0) AS relationship_count
    FROM (SELECT file, count(DISTINCT chunk_id) AS chunk_nodes, count(*) AS part_of, max(position) AS last FROM chunks GROUP BY file) c
    LEFT JOIN (SELECT file, count(DISTINCT entity) AS entity_nodes, count(DISTINCT chunk_id || entity) AS has_entity FROM mentions GROUP BY file) e USING (file)
    LEFT JOIN (SELECT file, count(DISTINCT least(entity, next) || '|' || greatest(entity, next)) AS entity_rels FROM pairs GROUP BY file) r USING (file)""", "pairs"))
def doc_counts(spark, sf_dir):
    return ingest.document_counters(D.chunks(spark, sf_dir), D.mentions(spark, sf_dir))


@query(D.sql("""SELECT file, n AS total, b AS batch_no, least(b * 20, n) AS processed, floor(least(b * 20, n) * 100 / n)::BIGINT AS percent
    FROM (SELECT file, n, unnest(range(1, ceil(n / 20.0)::BIGINT + 1)) AS b FROM (SELECT file, count(*) AS n FROM chunks GROUP BY file))""", "chunks"))
def progress_batches(spark, sf_dir):
    return ingest.progress(D.chunks(spark, sf_dir))


@query(D.sql("SELECT file, min(position) AS position FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE position <= 2) GROUP BY file", "chunks"))
def resume_position(spark, sf_dir):
    c = D.chunks(spark, sf_dir)
    return ingest.resume_position(c, c.where("position <= 2"))


@query("""SELECT c_custkey AS key, CASE WHEN n_name IS NOT NULL THEN upper(n_name) ELSE c_mktsegment END AS value, coalesce(n_regionkey, c_nationkey) AS amount
    FROM customer FULL JOIN nation ON c_custkey = n_nationkey WHERE c_custkey IS NOT NULL
    UNION ALL SELECT n_nationkey, upper(n_name), n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT c_custkey FROM customer)""")
def upsert_rows(spark, sf_dir):
    old = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"), F.col("c_nationkey").alias("amount"))
    new = D.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.upper("n_name").alias("value"), F.col("n_regionkey").alias("amount"))
    return ingest.upsert(old, new, ["key"])


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_status(spark, sf_dir):
    return status.latest_status(D.table(spark, sf_dir, "events"), "user_id", ["event_id"], ["event_type", "value", "event_id"])


@query("""SELECT user_id, event_id, event_type, previous FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
    WHERE previous IS NULL OR previous <> event_type""")
def status_changes(spark, sf_dir):
    return status.changes(D.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", "previous")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return status.counts_by_window(D.table(spark, sf_dir, "events"))


@query("""WITH RECURSIVE p AS (SELECT user_id AS video, epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id) AS start, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), event_type) AS r
        FROM events),
    f AS (SELECT video, r, start, text, 0 AS no, CASE WHEN start >= 3600 THEN 7200::DOUBLE ELSE 3600::DOUBLE END AS border, CASE WHEN start >= 3600 THEN 1 ELSE 0 END AS next FROM p WHERE r = 1
        UNION ALL SELECT p.video, p.r, p.start, p.text, f.next, CASE WHEN p.start >= f.border THEN f.border + 3600 ELSE f.border END, CASE WHEN p.start >= f.border THEN f.next + 1 ELSE f.next END
        FROM f JOIN p ON p.video = f.video AND p.r = f.r + 1)
    SELECT video, no AS window_no, round(min(start), 3) AS start, round(max(start), 3) AS "end", string_agg(text, ' ' ORDER BY r) AS text FROM f GROUP BY video, no""")
def transcript_windows(spark, sf_dir):
    """Events of each user as pieces of a video, an hour a window."""
    from pyspark.sql import Window

    own = D.table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    pieces = own.select(F.col("user_id").alias("video"), (at - F.min(at).over(Window.partitionBy("user_id"))).alias("start"), F.col("event_type").alias("text"))
    return transcript.transcript_windows(pieces, 3600.0).withColumn("start", F.round("start", 3)).withColumn("end", F.round("end", 3))


@query("SELECT o_orderkey AS file, o_orderdate AS created_at FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 3 DAY AND o_orderstatus = 'O'")
def expired_files(spark, sf_dir):
    orders = D.table(spark, sf_dir, "orders")
    now = orders.agg(F.max("o_orderdate").alias("now"))
    return orders.where("o_orderstatus = 'O'").crossJoin(F.broadcast(now)).where(F.expr("o_orderdate < now - INTERVAL 3 DAYS")).select(F.col("o_orderkey").alias("file"), F.col("o_orderdate").alias("created_at"))


@query("SELECT conv_id, turn, role, text, age FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations) WHERE age <= 2")
def chat_last_messages(spark, sf_dir):
    return transcript.last_messages(D.table(spark, sf_dir, "conversations"), "conv_id", "turn", 2)


@query("""SELECT conv_id, count(*) FILTER (age <= 2) AS n_recent, count(*) FILTER (age > 2) AS n_older, coalesce(sum(length(text)) FILTER (age > 2), 0)::BIGINT AS chars_older
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations) GROUP BY conv_id""")
def chat_summarized(spark, sf_dir):
    return transcript.summarized(D.table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("""SELECT conv_id, count(*) AS n, CASE WHEN count(*) = 1 THEN 'question' ELSE 'rewrite' END AS branch, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def rewrite_branch(spark, sf_dir):
    own = D.table(spark, sf_dir, "conversations").where("role = 'user'")
    return own.groupBy("conv_id").agg(F.count("*").alias("n"), F.max_by("text", "turn").alias("question")).withColumn("branch", F.when(F.col("n") == 1, "question").otherwise("rewrite"))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) AS host,
    CASE WHEN regexp_extract(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '([^/]+)/*$', 1) <> '' THEN regexp_extract(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '([^/]+)/*$', 1)
    ELSE split_part(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1), '.', 1) END AS title FROM pages""")
def web_titles(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", T.url_host(F.col("url")).alias("host"), T.url_last_segment(F.col("url")).alias("title"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""")
def web_text(spark, sf_dir):
    return sources.web_pages(D.table(spark, sf_dir, "pages")).select("page_id", "text")


@query("SELECT o_orderkey, printf('%d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) AS at, s AS seconds FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS s FROM orders)")
def time_format(spark, sf_dir):
    at = T.hms(F.floor("o_totalprice"))
    return D.table(spark, sf_dir, "orders").select("o_orderkey", at.alias("at"), T.seconds_of(at).alias("seconds"))


@query(D.sql("SELECT entity, label, count(*) AS n FROM mentions GROUP BY ALL", "mentions"))
def extracted_entities(spark, sf_dir):
    """An extractor that is put in: here the rule of mentions, as a function."""
    own = ingest.chunk_windows(D.files(spark, sf_dir))
    return M.extract(own, M.capitalized_words).groupBy("entity", "label").agg(F.count("*").alias("n"))


@query(D.sql("SELECT file, position, len(string_split(text, ' ')) AS a, length(text) AS b FROM chunks", "chunks"))
def embedded_chunks(spark, sf_dir):
    """An embedder that is put in: vectors of two numbers, of words and characters."""
    rows = M.embed(D.chunks(spark, sf_dir), "text", lambda t: F.array(F.size(F.split(t, " ")), F.length(t)))
    return rows.select("file", "position", F.col("embedding")[0].cast("long").alias("a"), F.col("embedding")[1].cast("long").alias("b"))


@query("""SELECT 'IN' AS kind, 'Customers' AS old, 'Customer' AS new UNION ALL SELECT 'IN', 'CUSTOMER', 'Customer' WHERE false UNION ALL SELECT 'IN', 'customer_', 'Customer'""")
def consolidated_schema(spark, sf_dir):
    """Labels that mean the same, by a rule that is put in."""
    labels = spark.createDataFrame([("Customer",), ("Customers",), ("customer_",), ("Order",)], "name string")
    return M.consolidation(labels).select(F.lit("IN").alias("kind"), "old", "new")


@query("""SELECT l_suppkey, l_partkey, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey FROM lineitem) GROUP BY ALL HAVING count(*) > 1""")
def written_graph(spark, sf_dir):
    """Nodes and edges that several extractions gave, written once each and counted."""
    own = D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").dropDuplicates(["l_orderkey", "l_suppkey", "l_partkey"])
    return own.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n")).where("n > 1")


@query(D.sql("""SELECT file, count(DISTINCT c0) + count(DISTINCT c1) + count(DISTINCT c2) AS community_nodes, count(DISTINCT entity) + count(DISTINCT c0) + count(DISTINCT c1) AS community_rels
    FROM (SELECT DISTINCT file, entity FROM mentions) JOIN lists USING (entity) GROUP BY file""", "lists"))
def doc_community_counts(spark, sf_dir):
    """The community branch of a document's counters (here each community has one parent)."""
    m = D.mentions(spark, sf_dir)
    return ingest.community_counters(m, D.community_lists(m))


@query(D.sql("SELECT file, count(*) AS n FROM chunks WHERE file NOT IN (SELECT file FROM sources WHERE file IN ('doc_1', 'doc_2', 'doc_3', 'doc_4') AND file_source IN ('local file', 'youtube')) GROUP BY file", "chunks", "sources"))
def delete_docs_and_chunks(spark, sf_dir):
    """What stays of chunks if some files of some origins go."""
    kept = ingest.without_documents(D.chunks(spark, sf_dir), D.sources(spark, sf_dir), ["doc_1", "doc_2", "doc_3", "doc_4"], ["local file", "youtube"])
    return kept.groupBy("file").agg(F.count("*").alias("n"))


@query(D.sql("SELECT file_source, file_type, arg_min(file, doc_id) AS file FROM sources GROUP BY ALL", "sources"))
def first_per_origin(spark, sf_dir):
    """The first file of each origin and kind."""
    from tessera.operators.curation import keep_first

    return keep_first(D.sources(spark, sf_dir), ["file_source", "file_type"], ["doc_id"]).select("file_source", "file_type", "file")


@query("SELECT n_nationkey, 'N' || n_nationkey AS source, 'LIES_IN' AS relation, 'R' || n_regionkey AS target FROM nation")
def imported_schema(spark, sf_dir):
    """Triples of importers' documents, one a nation, whose types name each other by reference."""
    n, r = (F.concat(F.lit(p), F.col(c).cast("string")) for p, c in (("N", "n_nationkey"), ("R", "n_regionkey")))
    named = lambda k, token: F.create_map(F.lit("$id"), F.lit(k), F.lit("token"), token)
    ref = lambda k: F.struct(F.lit("#" + k).alias("$ref"))
    kind = lambda k, label: F.struct(F.lit(k).alias("$id"), F.array(ref(label)).alias("labels"))
    graph = F.struct(
        F.array(named("nl:0", n), named("nl:1", r)).alias("nodeLabels"), F.array(named("rt:0", F.lit("LIES_IN"))).alias("relationshipTypes"), F.array(kind("n:0", "nl:0"), kind("n:1", "nl:1")).alias("nodeObjectTypes"),
        F.array(F.struct(F.lit("r:0").alias("$id"), ref("rt:0").alias("type"), ref("n:0").alias("from"), ref("n:1").alias("to"))).alias("relationshipObjectTypes"),
    )
    document = F.to_json(F.struct(F.struct(F.struct(graph.alias("graphSchema")).alias("graphSchemaRepresentation")).alias("dataModel")))
    return D.table(spark, sf_dir, "nation").select("n_nationkey", F.explode(sources.imported_triples(document)).alias("t")).select("n_nationkey", "t.*")


@query(D.sql("SELECT 'mentions' AS name, count(*) AS n FROM mentions", "mentions"))
def mentions_table(spark, sf_dir):
    """The table of mentions, made if it is not there."""
    return D.mentions(spark, sf_dir).agg(F.count("*").alias("n")).select(F.lit("mentions").alias("name"), "n")


@query(D.sql("SELECT 'edges' AS name, count(*) AS n, sum(weight)::BIGINT AS weight FROM edges", "edges"))
def edges_table(spark, sf_dir):
    """The table of edges between entities."""
    return D.edges(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).select(F.lit("edges").alias("name"), "n", "weight")


@query(r"""SELECT count(*) AS postings, sum(tf)::BIGINT AS words FROM (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(string_split(trim(regexp_replace(translate(lower(translate(text, '.,', '')), chr(10) || '"' || chr(39), ' '), '[ 	
]+', ' ', 'g')), ' '),
    lambda x: x <> '')) AS t FROM documents) GROUP BY ALL)""")
def keyword_index(spark, sf_dir):
    """The inverted index of all texts."""
    return D.keyword_index(spark, sf_dir)[0].agg(F.count("*").alias("postings"), F.sum("tf").alias("words"))


@query("SELECT 'doc_' || doc_id AS file, octet_length(encode(text)) AS bytes, true AS gapless, true AS full FROM documents WHERE text <> ''")
def token_chunks(spark, sf_dir):
    """Chunks of 200 tokens of all documents: together they are each text, byte by byte, and all but the last are full."""
    found = K.document_chunks(D.files(spark, sf_dir), 200, 0)
    before = F.lag("end", 1, 0).over(Window.partitionBy("file").orderBy("position"))
    last = F.max("position").over(Window.partitionBy("file"))
    own = found.select("file", "start", "end", (F.col("start") == before).alias("follows"), ((F.col("tokens") == 200) | (F.col("position") == last)).alias("full"))
    return own.groupBy("file").agg(F.max("end").alias("bytes"), F.bool_and("follows").alias("gapless"), F.bool_and("full").alias("full"))


@query(r"""SELECT 'doc_' || doc_id AS file, page_number, octet_length(encode(page)) AS bytes FROM (SELECT doc_id, unnest(p) AS page, unnest(range(1, len(p) + 1))::INT AS page_number
    FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) WHERE page <> ''""")
def page_chunks(spark, sf_dir):
    """Texts with a line a page, cut page by page with 20 tokens in common: no chunk crosses a page, and each page is covered."""
    pages = D.files(spark, sf_dir).select("file", F.posexplode(F.split("text", "\n")).alias("page_number", "text")).withColumn("page_number", F.col("page_number") + 1)
    return K.page_chunks(pages, 100, 20).groupBy("file", "page_number").agg(F.max("end").alias("bytes"))


@query("""SELECT conv_id AS video, min(turn)::DOUBLE AS first, max(turn)::DOUBLE + 1 AS last FROM conversations WHERE text <> '' GROUP BY conv_id""")
def transcript_chunks(spark, sf_dir):
    """Conversations as transcripts, a second a turn: chunks of 50 tokens with the times of the turns that they begin and end in."""
    own = D.table(spark, sf_dir, "conversations").where("text != ''")
    pieces = own.select(F.col("conv_id").alias("video"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"), "text")
    return K.transcript_chunks(pieces, 50, 10).groupBy("video").agg(F.min("start_time").alias("first"), F.max("end_time").alias("last"))


@query()
def work_queue(spark, sf_dir):
    """Events as the work of ten queues: what each of them changes, and what the life cycle refuses."""
    from tessera.streaming import queue

    k = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("request", "batch", "batch", "cancel", "batch", "fail", "request"))), (k % 7 + 1).cast("int"))
    own = D.table(spark, sf_dir, "events").where("event_id IS NOT NULL AND user_id IS NOT NULL")
    return queue.work_in_batch(own.select((F.col("user_id") % 10).cast("string").alias("queue"), k.alias("seq"), kind.alias("kind"), F.concat(F.lit("f"), (k % 31).cast("string")).alias("file"), (k % 60 + 1).alias("total")))
