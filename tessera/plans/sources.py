"""Queries over the table of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import lifecycle as L
from tessera.operators import modes
from tessera.plans import derived as D
from tessera.plans.registry import query
from tessera.sources.articles import ArticleSource

_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _time(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(D.sql(f"SELECT file, {_TIME.format('updated_at')} AS updated FROM sources WHERE status = 'Completed'", "sources"))
def completed_documents(spark, sf_dir):
    """Newest change first."""
    return D.sources(spark, sf_dir).where("status = 'Completed'").orderBy(F.desc("updated_at"), "file").select("file", _time("updated_at").alias("updated"))


@query(D.sql("SELECT file, url FROM sources WHERE file = 'doc_41' AND file_source = 'web-url'", "sources"))
def web_source_url(spark, sf_dir):
    return D.sources(spark, sf_dir).where("file = 'doc_41' AND file_source = 'web-url'").select("file", "url")


@query(D.sql(f"SELECT file, {_TIME.format('created_at')} AS created FROM sources ORDER BY created_at DESC, file LIMIT 50", "sources"))
def newest_documents(spark, sf_dir):
    return D.sources(spark, sf_dir).orderBy(F.desc("created_at"), "file").limit(50).select("file", _time("created_at").alias("created"))


@query(D.sql("""SELECT status, is_cancelled, count(*) AS n, sum(total_chunks + processed_chunk + node_count)::BIGINT AS counters FROM (
    SELECT 'New' AS status, false AS is_cancelled, 0 AS total_chunks, 0 AS processed_chunk, 0 AS node_count FROM (SELECT file FROM sources WHERE status = 'Failed' UNION SELECT 'new_' || n_nationkey FROM nation)
    UNION ALL SELECT status, is_cancelled, total_chunks, processed_chunk, node_count FROM sources WHERE status <> 'Failed') GROUP BY ALL""", "sources"))
def register_documents(spark, sf_dir):
    """Files that failed and one for each nation, put in anew."""
    own = D.sources(spark, sf_dir)
    new = own.where("status = 'Failed'").select("file").unionByName(D.table(spark, sf_dir, "nation").select(F.concat(F.lit("new_"), F.col("n_nationkey").cast("string")).alias("file")))
    of = L.register(own, new)
    return of.groupBy("status", "is_cancelled").agg(F.count("*").alias("n"), F.sum(F.col("total_chunks") + F.col("processed_chunk") + F.col("node_count")).alias("counters"))


@query(D.sql("SELECT file, CASE WHEN doc_id % 11 = 0 THEN CASE WHEN is_cancelled THEN 'Cancelled' ELSE 'Failed' END ELSE status END AS status FROM sources", "sources"))
def failed_documents(spark, sf_dir):
    own = D.sources(spark, sf_dir)
    return L.fail(own, own.where("doc_id % 11 = 0").select("file", F.lit("broken").alias("message"))).select("file", "status")


@query(D.sql("SELECT file, CASE WHEN status = 'Processing' THEN 'Cancelled' ELSE status END AS status, is_cancelled OR status = 'Processing' AS is_cancelled, processed_chunk FROM sources", "sources"))
def cancelled_jobs(spark, sf_dir):
    own = D.sources(spark, sf_dir)
    return L.cancel(own, own.where("status = 'Processing'")).select("file", "status", "is_cancelled", "processed_chunk")


@query(D.sql("""SELECT file, CASE WHEN r THEN 'Ready to Reprocess' ELSE status END AS status, CASE WHEN r AND doc_id % 3 < 2 THEN 0 ELSE processed_chunk END AS processed_chunk,
    CASE WHEN r AND doc_id % 3 = 1 THEN 0 ELSE node_count END AS node_count FROM (SELECT *, status IN ('Failed', 'Cancelled') AS r FROM sources)""", "sources"))
def retry_states(spark, sf_dir):
    """Failed and cancelled files are tried again, by each of the conditions."""
    own = D.sources(spark, sf_dir)
    condition = F.when(F.col("doc_id") % 3 == 0, L.FROM_START).when(F.col("doc_id") % 3 == 1, L.WITHOUT_ENTITIES).otherwise(L.FROM_LAST)
    return L.retry(own, own.where("status IN ('Failed', 'Cancelled')").select("file", condition.alias("condition"))).select("file", "status", "processed_chunk", "node_count")


@query(D.sql("""SELECT file, status IN ('New', 'Ready to Reprocess') AS ready, status IN ('New', 'Ready to Reprocess') AND file_source = 'local file' AS ready_local FROM sources""", "sources"))
def ready_files(spark, sf_dir):
    return D.sources(spark, sf_dir).select("file", L.ready(F.col("status")).alias("ready"), L.ready(F.col("status"), F.col("file_source")).alias("ready_local"))


@query(D.sql("SELECT file FROM sources WHERE status = 'Completed' AND model = 'model-b'", "sources"))
def table_filters(spark, sf_dir):
    return D.sources(spark, sf_dir).where(L.matches_filters({"status": "Completed", "file_type": "All", "model": "model-b"})).select("file")


@query(D.sql(f"""SELECT file, coalesce(file_size, 0) AS file_size, coalesce(upper(replace(file_type, '.', '')), '') AS file_type, file_source, status, CASE WHEN url IS NULL OR contains(url, 'None') THEN '' ELSE url END AS url,
    node_count, relationship_count, floor(processed_chunk * 100 / total_chunks)::BIGINT AS percent, {_TIME.format('updated_at')} AS updated FROM sources""", "sources"))
def table_rows(spark, sf_dir):
    return L.shown(D.sources(spark, sf_dir))


@query(D.sql("SELECT file, coalesce(CASE WHEN contains(url, 'None') THEN file ELSE url END, file) AS source FROM sources", "sources"))
def answer_sources(spark, sf_dir):
    return D.sources(spark, sf_dir).select("file", L.source_of(F.col("url"), F.col("file")).alias("source"))


@query(D.sql("""SELECT file, '{"file":"' || file || '","status":"' || status || '","total_chunks":' || total_chunks || ',"processed_chunk":' || processed_chunk || ',"node_count":' || node_count
    || ',"relationship_count":' || relationship_count || ',"is_cancelled":' || is_cancelled || '}' AS json FROM sources""", "sources"))
def status_json(spark, sf_dir):
    return L.status_json(D.sources(spark, sf_dir))


@query(D.sql("SELECT file, CASE WHEN file_size < 2000 THEN 'polling' ELSE 'stream' END AS way FROM sources WHERE status = 'Processing'", "sources"))
def file_routing(spark, sf_dir):
    return D.sources(spark, sf_dir).where("status = 'Processing'").select("file", L.route(F.col("file_size"), 2000).alias("way"))


@query(D.sql("""SELECT bool_or(created_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 3 DAY) AS any_expired, bool_or(file_size > 5000) AS any_large FROM sources
    WHERE status IN ('New', 'Ready to Reprocess') AND file_source = 'local file'""", "sources"))
def ready_files_exist(spark, sf_dir):
    """Whether any local file that waits is expired, or large."""
    own = D.sources(spark, sf_dir).where(L.ready(F.col("status"), F.col("file_source")))
    return own.agg(F.bool_or(F.expr("created_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 3 DAYS")).alias("any_expired"), F.bool_or(F.col("file_size") > 5000).alias("any_large"))


@query(D.sql("SELECT DISTINCT 'source' AS filter, file_source AS value FROM sources UNION SELECT DISTINCT 'type', coalesce(file_type, '') FROM sources", "sources"))
def filter_values(spark, sf_dir):
    own = D.sources(spark, sf_dir)
    return own.select(F.lit("source").alias("filter"), F.col("file_source").alias("value")).unionByName(own.select(F.lit("type").alias("filter"), F.coalesce("file_type", F.lit("")).alias("value"))).distinct()


@query(D.sql("SELECT file FROM sources WHERE status IN ('New', 'Ready to Reprocess') AND file NOT IN (SELECT file FROM sources WHERE status IN ('New', 'Ready to Reprocess') ORDER BY created_at, file LIMIT 2)", "sources"))
def waiting_files(spark, sf_dir):
    """Those that wait beyond the two that are taken next."""
    own = D.sources(spark, sf_dir).where(L.ready(F.col("status")))
    return own.select("file").join(own.orderBy("created_at", "file").limit(2).select("file"), "file", "left_anti")


@query(D.sql("SELECT file, file_size FROM sources ORDER BY file_size DESC NULLS LAST, file LIMIT 5 OFFSET 10", "sources"))
def sorted_page(spark, sf_dir):
    return L.page_of(D.sources(spark, sf_dir), [F.desc_nulls_last("file_size"), "file"], 3, 5).select("file", "file_size")


@query(D.sql("""SELECT c.file, c.position, s.file_source, CASE WHEN s.file_source = 'youtube' THEN least(c.position * 60, c.position * 50 + 30) END AS start FROM chunks c JOIN sources s USING (file)""", "chunks", "sources"))
def chunk_details(spark, sf_dir):
    """Chunks with what their source is; times of videos as seconds, the start not after the end."""
    c = D.chunks(spark, sf_dir).withColumn("start", T.hms(F.col("position") * 60)).withColumn("end", T.hms(F.col("position") * 50 + 30))
    own = c.join(D.sources(spark, sf_dir).select("file", "file_source"), "file")
    start = F.when(F.col("file_source") == "youtube", F.least(T.seconds_of(F.col("start")), T.seconds_of(F.col("end"))))
    return own.select("file", "position", "file_source", start.alias("start"))


@query(D.sql("""SELECT file, CASE WHEN u.n > 1 THEN title || '-' || regexp_extract(url, '([^/]+)/*$', 1) ELSE title END AS title
    FROM (SELECT *, split_part(split_part(url, '//', 2), '.', 1) AS title FROM sources WHERE url LIKE 'https%') s JOIN (SELECT split_part(split_part(url, '//', 2), '.', 1) AS t, count(DISTINCT url) AS n FROM sources WHERE url LIKE 'https%' GROUP BY 1) u ON u.t = s.title""", "sources"))
def web_titles_apart(spark, sf_dir):
    """Pages of one title but several urls get the last part of theirs."""
    own = D.sources(spark, sf_dir).where("url LIKE 'https%'").withColumn("title", F.split_part(T.url_host(F.col("url")), F.lit("."), F.lit(1)))
    n = own.groupBy("title").agg(F.count_distinct("url").alias("n"))
    return own.join(n, "title").select("file", T.title_apart(F.col("title"), F.col("url"), F.col("n")).alias("title"))


@query(D.sql("""SELECT file, url IS NOT NULL AND url <> 'None' AND len(string_split(regexp_extract(url, '^https?://([^/]*)', 1), '.')) >= 2 AS web, coalesce(split_part(split_part(url, '//', 2), '/', 1) IN ('host1.example', 'host2.example'), false) AS allowed
    FROM sources""", "sources"))
def url_checks(spark, sf_dir):
    own = D.sources(spark, sf_dir)
    return own.select("file", T.is_web_url(F.col("url")).alias("web"), T.host_in(F.col("url"), ["host1.example", "host2.example"]).alias("allowed"))


@query("SELECT doc_id, lang AS language, substr(text, 1, 100000) AS text FROM documents")
def article_source(spark, sf_dir):
    """All documents through the Python data source."""
    spark.dataSource.register(ArticleSource)
    return spark.read.format("articles").load(f"{sf_dir}/documents.parquet")


_MODE_ROWS = ", ".join(f"('{m}', {k}, '{v}', {repr(w) if w else 'NULL'}, {d}, '{n}')" for m, k, v, w, d, n in modes.MODES)
_ASKED = [*(m[0] for m in modes.MODES), modes.GRAPH, "hybrid"]


@query(f"""WITH q AS (SELECT conv_id, turn, CASE WHEN conv_id % 9 < 8 THEN {_ASKED!r}[conv_id % 9 + 1] END AS mode, turn % 4 = 0 AS selected FROM conversations WHERE role = 'user'),
    settings AS (SELECT * FROM (VALUES {_MODE_ROWS}) t (answered_by, top_k, vector_index, keyword_index, document_filter, label)),
    r AS (SELECT *, CASE WHEN mode IN (SELECT answered_by FROM settings) OR mode = 'graph' THEN mode ELSE 'graph_vector_fulltext' END AS answered_by FROM q)
    SELECT conv_id, turn, mode, answered_by, top_k, vector_index, keyword_index, label, CASE WHEN selected AND NOT document_filter THEN '{modes.REFUSAL}' END AS refusal FROM r LEFT JOIN settings USING (answered_by)""")
def routed_questions(spark, sf_dir):
    """Users' turns as questions, with modes (one unknown, one null) and selected documents by rules over their numbers."""
    asked = F.get(F.array(*map(F.lit, _ASKED)), (F.col("conv_id") % 9).cast("int"))
    files = F.when(F.col("turn") % 4 == 0, F.array(F.concat(F.lit(" doc_"), F.col("conv_id").cast("string"))))
    own = D.table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", asked.alias("mode"), files.alias("files"))
    return modes.resolve(own).select("conv_id", "turn", "mode", "answered_by", "top_k", "vector_index", "keyword_index", "label", "refusal")
