"""The knowledge graph that the registered queries run on, derived from the data folder by rules that SQL can state too."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import ingest
from tessera.sinks_shared import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: file, text and metadata."""
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("file"), "doc_id", "text", "lang", "source", "n_chars")


#: What the stand-in for the table of sources cycles through.
STATUSES = ["New", "Processing", "Completed", "Failed", "Cancelled", "Ready to Reprocess", "Completed"]
KINDS = [".pdf", ".txt", ".html", None]
ORIGINS = ["local file", "web-url", "youtube", "s3 bucket"]
MODELS = ["model-a", "model-b", "model-c"]


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as rows of the table of sources: file, size, kind, origin, state, times and counters, by rules over their ids."""
    k = F.col("doc_id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    at = lambda a, b: F.timestamp_seconds(F.lit(1_704_067_200) + k * a % b * 3600)
    url = F.when(k % 5 == 0, "None").when(k % 3 != 0, F.concat(F.lit("https://host"), (k % 9).cast("string"), F.lit(".example/p/"), k.cast("string")))
    return table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(
        F.concat(F.lit("doc_"), k.cast("string")).alias("file"), "doc_id", F.col("n_chars").alias("file_size"), pick(KINDS).alias("file_type"), pick(ORIGINS).alias("file_source"),
        pick(STATUSES).alias("status"), url.alias("url"), F.col("lang").alias("language"), pick(MODELS).alias("model"), at(37, 1000).alias("created_at"), at(91, 3000).alias("updated_at"),
        (k % 40 + 1).cast("int").alias("total_chunks"), (k % 40 * 7 % 41).cast("int").alias("processed_chunk"), (k % 7 == 4).alias("is_cancelled"), (k % 50).alias("node_count"), (k % 30).alias("relationship_count"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.chunk_windows(files(spark, sf_dir))


def state(spark: SparkSession, sf_dir: str, *names: str) -> int:
    """A number that changes when a file of these tables comes, goes, or changes its size or time. Files are listed, not read."""
    each = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{sf_dir}/{name}.parquet" for name in names])
    one = F.pmod(F.xxhash64("path", "length", "modificationTime"), F.lit(1 << 31))  # sums of so many files fit
    return each.agg(F.sum(one).alias("s")).head().s or 0


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object], of: tuple[str, ...] = ("documents",)):
    """What make gives, made once a session, data folder and state of the tables that it is of."""
    made, now = spark.__dict__.setdefault("_tessera_kept", {}), state(spark, sf_dir, *of)
    if (sf_dir, name) not in made or made[sf_dir, name][0] != now:
        made[sf_dir, name] = now, make()
    return made[sf_dir, name][1]


def is_kept(spark: SparkSession, sf_dir: str, name: str, of: tuple[str, ...] = ("documents",)) -> bool:
    """Whether a thing is kept of the tables as they are now."""
    made = spark.__dict__.get("_tessera_kept", {})
    return (sf_dir, name) in made and made[sf_dir, name][0] == state(spark, sf_dir, *of)


def rebuild(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Forgets what is kept of a data folder, or of all, so that the next query makes it anew."""
    made = spark.__dict__.setdefault("_tessera_kept", {})
    for key in [k for k in made if sf_dir in (None, k[0])]:
        del made[key]


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], of: tuple[str, ...] = ("documents",)) -> DataFrame:
    """A table that is made once, as ingestion does, and read by all queries until its data change."""
    return kept(spark, sf_dir, name, lambda: materialize(make(), name), of)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "mentions", lambda: ingest.entity_mentions(chunks(spark, sf_dir)))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, weight of entities that stand side by side; from the mentions where these are kept, else from the texts."""
    make = lambda: ingest.mention_edges(mentions(spark, sf_dir)) if is_kept(spark, sf_dir, "mentions") else ingest.text_edges(files(spark, sf_dir))
    return stored(spark, sf_dir, "entity-edges", make)


def keyword_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of the documents' words in lower case, without dots and commas."""
    from tessera.operators import retrieval

    words = lambda: files(spark, sf_dir).select(F.col("file").alias("id"), T.words(F.lower(F.translate("text", ".,", ""))).alias("words"))
    return stored(spark, sf_dir, "postings", lambda: retrieval.postings(words())), stored(spark, sf_dir, "lengths", lambda: words().select("id", F.size("words").alias("length")))


def entity_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity with one of the vectors, by a hash of its name."""
    own = mentions(spark, sf_dir).select("entity").distinct()
    n = vectors(spark, sf_dir).count()
    h = F.conv(F.substring(F.md5("entity"), 1, 6), 16, 10).cast("long") % max(n, 1)
    return own.select("entity", h.alias("id")).join(vectors(spark, sf_dir).select("id", "embedding"), "id").select("entity", "embedding")


def text_index(spark: SparkSession, sf_dir: str, of: str = "documents"):
    """The full-text index of documents, chunks or entities, made once while the data stay as they are."""
    from tessera.operators import fulltext

    low = lambda text: T.words(F.lower(F.translate(text, ".,", "")))
    rows = {
        "documents": lambda: files(spark, sf_dir).select(F.col("file").alias("id"), low("text").alias("words")),
        "chunks": lambda: chunks(spark, sf_dir).select(F.concat_ws("#", "file", "position").alias("id"), low("text").alias("words")),
        "entities": lambda: mentions(spark, sf_dir).select("entity", "label").distinct().select(F.concat_ws(":", "label", "entity").alias("id"), F.array(F.lower("entity"), F.lower("label")).alias("words")),
    }
    return kept(spark, sf_dir, f"texts of {of}", lambda: fulltext.build(rows[of]()))


def vector_index(spark: SparkSession, sf_dir: str):
    """The index of all vectors, made once while the data stay as they are."""
    from tessera.operators import vector_index as V

    return kept(spark, sf_dir, "vectors", lambda: V.build(vectors(spark, sf_dir)), ("embeddings",))


def community_lists(mentions_of: DataFrame) -> DataFrame:
    """entity with nested communities: by its first letter, then fives of these, then threes of those."""
    letter = F.ascii("entity") - 65
    five = F.floor(letter / 5).cast("int")
    return mentions_of.select("entity").distinct().select("entity", F.array(letter, five, F.floor(five / 3).cast("int")).alias("communities"))


def _node(spark: SparkSession, sf_dir: str, name: str, label: str, key: str, caption: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.concat(F.lit(f"{label}:"), F.col(key).cast("string")).alias("node_id"), F.lit(label).alias("label"), F.col(caption).cast("string").alias("caption"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, label and caption of the business graph."""
    parts = [
        ("region", "Region", "r_regionkey", "r_name"), ("nation", "Nation", "n_nationkey", "n_name"), ("customer", "Customer", "c_custkey", "c_name"),
        ("supplier", "Supplier", "s_suppkey", "s_name"), ("part", "Part", "p_partkey", "p_name"), ("orders", "Order", "o_orderkey", "o_orderkey"),
    ]
    return reduce(DataFrame.unionByName, (_node(spark, sf_dir, *p) for p in parts))


def rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type, src, dst of the business graph; repeated purchases are parallel edges."""

    def edge(name: str, kind: str, a: str, ka: str, b: str, kb: str) -> DataFrame:
        end = lambda label, key: F.concat(F.lit(f"{label}:"), F.col(key).cast("string"))
        return table(spark, sf_dir, name).select(F.lit(kind).alias("type"), end(a, ka).alias("src"), end(b, kb).alias("dst"))

    parts = [
        ("nation", "IN", "Nation", "n_nationkey", "Region", "n_regionkey"), ("customer", "IN", "Customer", "c_custkey", "Nation", "c_nationkey"),
        ("supplier", "IN", "Supplier", "s_suppkey", "Nation", "s_nationkey"), ("orders", "PLACED", "Customer", "o_custkey", "Order", "o_orderkey"),
        ("lineitem", "CONTAINS", "Order", "l_orderkey", "Part", "l_partkey"), ("lineitem", "SUPPLIES", "Supplier", "l_suppkey", "Part", "l_partkey"),
    ]
    return reduce(DataFrame.unionByName, (edge(*p) for p in parts))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, embedding, and the file that a vector belongs to."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", "label", F.concat(F.lit("doc_"), (F.col("vec_id") % 50).cast("string")).alias("file"), F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("text")
    )


#: The same tables as SQL, each a common table expression; a query names those that it needs.
SQL = {
    "words": r"""words AS (SELECT 'doc_' || doc_id AS file, doc_id, lang, source, n_chars,
        list_filter(string_split(trim(regexp_replace(translate(text, chr(10) || '"' || chr(39), ' '), '[ \t\r\n]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents)""",
    "chunks": r"""starts AS (SELECT file, w, unnest(range(0, greatest(1, ceil((len(w) - 20) / 80.0))::BIGINT)) AS k FROM words WHERE len(w) > 0),
        chunks AS (SELECT file, (k + 1)::INTEGER AS position, array_to_string(w[k * 80 + 1 : k * 80 + 100], ' ') AS text,
            sha1(array_to_string(w[k * 80 + 1 : k * 80 + 100], ' ')) AS chunk_id, length(array_to_string(w[k * 80 + 1 : k * 80 + 100], ' ')) AS length FROM starts)""",
    "mentions": r"""chunk_words AS (SELECT file, position, chunk_id, string_split(text, ' ') AS w FROM chunks),
        places AS (SELECT file, position, chunk_id, unnest(range(0, len(w))) AS place, w FROM chunk_words),
        mentions AS (SELECT file, position, chunk_id, place, entity, CASE WHEN length(entity) <= 5 THEN 'Short' WHEN length(entity) <= 8 THEN 'Mid' ELSE 'Long' END AS label
            FROM (SELECT file, position, chunk_id, place, regexp_replace(w[place + 1], '[^A-Za-z]', '', 'g') AS entity FROM places) WHERE regexp_full_match(entity, '[A-Z][a-z]{3,}'))""",
    "pairs": r"""pairs AS (SELECT file, position, entity, next FROM (SELECT *, lead(entity) OVER (PARTITION BY file, position ORDER BY place) AS next FROM mentions) WHERE next <> entity)""",
    "edges": r"""edges AS (SELECT least(entity, next) AS source, greatest(entity, next) AS target, count(*) AS weight FROM pairs GROUP BY ALL)""",
    "evectors": r"""evectors AS (SELECT entity, embedding::DOUBLE[] AS embedding FROM (SELECT DISTINCT entity FROM mentions) JOIN embeddings ON vec_id = ('0x' || substr(md5(entity), 1, 6))::BIGINT % (SELECT count(*) FROM embeddings))""",
    "lists": r"""lists AS (SELECT DISTINCT entity, ascii(entity) - 65 AS c0, (ascii(entity) - 65) // 5 AS c1, ((ascii(entity) - 65) // 5) // 3 AS c2 FROM mentions)""",
    "nodes": r"""nodes AS (SELECT 'Region:' || r_regionkey AS node_id, 'Region' AS label, r_name AS caption FROM region
        UNION ALL SELECT 'Nation:' || n_nationkey, 'Nation', n_name FROM nation UNION ALL SELECT 'Customer:' || c_custkey, 'Customer', c_name FROM customer
        UNION ALL SELECT 'Supplier:' || s_suppkey, 'Supplier', s_name FROM supplier UNION ALL SELECT 'Part:' || p_partkey, 'Part', p_name FROM part
        UNION ALL SELECT 'Order:' || o_orderkey, 'Order', o_orderkey::VARCHAR FROM orders)""",
    "rels": r"""rels AS (SELECT 'IN' AS type, 'Nation:' || n_nationkey AS src, 'Region:' || n_regionkey AS dst FROM nation
        UNION ALL SELECT 'IN', 'Customer:' || c_custkey, 'Nation:' || c_nationkey FROM customer UNION ALL SELECT 'IN', 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey FROM supplier
        UNION ALL SELECT 'PLACED', 'Customer:' || o_custkey, 'Order:' || o_orderkey FROM orders
        UNION ALL SELECT 'CONTAINS', 'Order:' || l_orderkey, 'Part:' || l_partkey FROM lineitem UNION ALL SELECT 'SUPPLIES', 'Supplier:' || l_suppkey, 'Part:' || l_partkey FROM lineitem)""",
    "sources": f"""sources AS (SELECT 'doc_' || doc_id AS file, doc_id, n_chars AS file_size, {KINDS!r}[doc_id % 4 + 1] AS file_type, {ORIGINS!r}[doc_id % 4 + 1] AS file_source,
        {STATUSES!r}[doc_id % 7 + 1] AS status, CASE WHEN doc_id % 5 = 0 THEN 'None' WHEN doc_id % 3 <> 0 THEN 'https://host' || (doc_id % 9) || '.example/p/' || doc_id END AS url, lang AS language,
        {MODELS!r}[doc_id % 3 + 1] AS model, make_timestamp((1704067200 + doc_id * 37 % 1000 * 3600) * 1000000) AS created_at, make_timestamp((1704067200 + doc_id * 91 % 3000 * 3600) * 1000000) AS updated_at,
        (doc_id % 40 + 1)::INTEGER AS total_chunks, (doc_id % 40 * 7 % 41)::INTEGER AS processed_chunk, doc_id % 7 = 4 AS is_cancelled, doc_id % 50 AS node_count, doc_id % 30 AS relationship_count
        FROM documents WHERE doc_id IS NOT NULL)""".replace("None]", "NULL]"),
    "vectors": r"""vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS embedding, label, 'doc_' || (vec_id % 50) AS file, 'chunk ' || vec_id AS text FROM embeddings)""",
}
_NEEDS = {"chunks": ("words",), "mentions": ("words", "chunks"), "pairs": ("words", "chunks", "mentions"), "lists": ("words", "chunks", "mentions"),
    "edges": ("words", "chunks", "mentions", "pairs"), "evectors": ("words", "chunks", "mentions")}


def sql(body: str, *names: str, also: str = "") -> str:
    """A query over derived tables, and over further table expressions of its own, which may be recursive."""
    order = [n for n in SQL if n in {*names, *(x for name in names for x in _NEEDS.get(name, ()))}]
    return f"WITH {'RECURSIVE ' if also else ''}{', '.join([*(SQL[n] for n in order), *([also] if also else [])])} {body}" if order or also else body
