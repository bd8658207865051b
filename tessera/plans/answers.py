"""Queries of global answers by a tree of merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import answers as A
from tessera.plans import derived as D
from tessera.plans.registry import query

ASKED = "(?:the|und|les|que)"


def _flat(source: str, budget: int) -> str:
    """The answer in one pass over all points of a key (own: key, id, piece, score, text)."""
    return f"""WITH ranked AS (SELECT *, sum(length(text)) OVER (PARTITION BY key ORDER BY score DESC, id, piece ROWS UNBOUNDED PRECEDING) AS filled FROM ({source}) WHERE score > 0)
        SELECT key, count(*) AS n_points, count(*) FILTER (filled <= {budget}) AS n_kept, round(avg(score) FILTER (filled <= {budget}), 6) AS mean_score,
        coalesce(string_agg(text, chr(10) ORDER BY score DESC, id, piece) FILTER (filled <= {budget}), '') AS text FROM ranked GROUP BY key"""


def _inner(source: str, budget: int) -> str:
    return f"SELECT * FROM ({_flat(source, budget)})"


def _rounded(found):
    return found.withColumn("mean_score", F.round("mean_score", 6))


@query(_flat(f"""SELECT lang AS key, doc_id AS id, k AS piece, len(regexp_extract_all(p, '{ASKED}'))::DOUBLE AS score, p AS text
    FROM (SELECT lang, doc_id, unnest(range(0, (length(text) + 199) // 200)) AS k, text, substr(text, k * 200 + 1, 200) AS p FROM documents WHERE length(text) > 0)""", 1000))
def global_answer(spark, sf_dir):
    """For each language what all documents say to a question: their pieces by how often they have its words, as many as fit."""
    texts = D.table(spark, sf_dir, "documents").select(F.col("lang").alias("key"), F.col("doc_id").alias("id"), "text")
    return _rounded(A.answers(A.points(texts, lambda t: F.regexp_count(t, F.lit(ASKED)), 200), 1000))


@query(D.sql(_inner("SELECT level AS key, name AS id, 0 AS piece, n::DOUBLE AS score, text FROM members", 300), "lists",
    also="""m AS (SELECT entity, count(*) AS n FROM mentions GROUP BY entity), members AS (SELECT level, c || ':' || entity AS name, n, entity || ' (' || n || ')' AS text
        FROM (SELECT entity, n, unnest([0, 1, 2]) AS level, unnest([c0, c1, c2]) AS c FROM lists JOIN m USING (entity)))"""))
def level_answer(spark, sf_dir):
    """For each level of communities its strongest members, as one text that fits."""
    n = D.mentions(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("n"))
    of = D.community_lists(D.mentions(spark, sf_dir)).join(n, "entity").select("entity", "n", F.posexplode("communities").alias("key", "c"))
    text = F.concat("entity", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    return _rounded(A.answers(of.select("key", F.concat_ws(":", F.col("c").cast("string"), "entity").alias("id"), F.lit(0).alias("piece"), F.col("n").cast("double").alias("score"), text.alias("text")), 300))


@query(D.sql(_inner("SELECT key, id, 0 AS piece, score, text FROM below JOIN own USING (id)", 60), "lists",
    also="""own AS (SELECT '0-' || c0 AS id, count(*)::DOUBLE AS score, '0-' || c0 || ' has ' || count(*) AS text FROM lists GROUP BY c0),
        below AS (SELECT DISTINCT '1-' || c1 AS key, '0-' || c0 AS id FROM lists UNION SELECT DISTINCT '2-' || c2, '0-' || c0 FROM lists)"""))
def descendant_answers(spark, sf_dir):
    """Communities without a text, from the texts of all below them, through levels that have none either."""
    own = D.community_lists(D.mentions(spark, sf_dir)).select(*(F.concat(F.lit(f"{k}-"), F.get("communities", F.lit(k)).cast("string")).alias(f"c{k}") for k in range(3)))
    children = own.select(F.col("c1").alias("parent"), F.col("c0").alias("child")).unionByName(own.select(F.col("c2").alias("parent"), F.col("c1").alias("child")))
    sizes = own.groupBy(F.col("c0").alias("id")).agg(F.count("*").alias("score"))
    return _rounded(A.child_answers(children, sizes.withColumn("text", F.format_string("%s has %d", "id", "score")), 2, 60))
