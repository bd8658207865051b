"""Queries of typed relations and of schemas from text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import relations as R
from tessera.plans import derived as D
from tessera.plans.registry import query

WINDOW = 8
#: What the query of an allowed schema allows, as a form would send it.
LABELS, ALLOWED = "Short, Mid, Long", "Short,NEXT_TO,Mid, Mid,NEXT_TO,Long, Long,THE,Short, Mid,OF,Mid, Short,DER,Short"


def _sql(body: str, labels: str = "", allowed: str = "") -> str:
    """A query over kept: the triples that are more than chance."""
    named = f"WHERE lower(label) IN ({', '.join(repr(x.strip().lower()) for x in labels.split(','))})" if labels else ""
    inside = "true"
    if allowed:
        inside = f"""lower(a.label || '|' || b.via || '|' || b.label) IN ({', '.join(repr('|'.join(t).lower()) for t in R.allowed_schema(labels, allowed)[1])})"""
    own = f"""named AS (SELECT m.file, m.position, place, entity, label, CASE WHEN regexp_full_match(w[place], '[a-z]{{2,}}') THEN upper(w[place]) ELSE 'NEXT_TO' END AS via
            FROM mentions m JOIN chunk_words c ON m.file = c.file AND m.position = c.position {named}),
        each_pair AS (SELECT a.file, a.entity AS source, a.label AS source_label, b.via AS type, b.entity AS target, b.label AS target_label
            FROM named a JOIN named b ON a.file = b.file AND a.position = b.position AND b.place > a.place AND b.place <= a.place + {WINDOW} AND a.entity <> b.entity WHERE {inside}),
        entity_docs AS (SELECT entity, count(DISTINCT file) AS d FROM named GROUP BY ALL),
        counted AS (SELECT source, source_label, type, target, target_label, count(*) AS n, count(DISTINCT file) AS docs FROM each_pair GROUP BY ALL),
        lifted AS (SELECT counted.*, docs::DOUBLE * (SELECT count(DISTINCT file) FROM named) / (s.d::DOUBLE * t.d) AS lift FROM counted JOIN entity_docs s ON s.entity = source JOIN entity_docs t ON t.entity = target),
        kept AS (SELECT source, source_label, type, target, target_label, docs, floor(lift * 1000)::BIGINT AS lift_milli FROM lifted WHERE docs >= 2 AND lift >= 1
            QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY docs DESC, type) = 1)"""
    return D.sql(body, "mentions", also=own)


def _triples(spark, sf_dir):
    return D.stored(spark, sf_dir, "triples", lambda: R.triples(D.chunks(spark, sf_dir), WINDOW))


@query(_sql("SELECT source, source_label, type, target, target_label, docs, lift_milli FROM kept"))
def extracted_relations(spark, sf_dir):
    """Typed relations of all documents that are more than chance."""
    return R.relations(_triples(spark, sf_dir))


@query(_sql("SELECT type, count(*) AS n_triples, sum(n)::BIGINT AS n FROM counted GROUP BY ALL"))
def relation_types(spark, sf_dir):
    """Each type of relation with its different triples and all its pairs in chunks."""
    return _triples(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n_triples"), F.sum("n").alias("n"))


@query(_sql("SELECT source, source_label, type, target, target_label, docs, lift_milli FROM kept", LABELS, ALLOWED))
def allowed_relations(spark, sf_dir):
    """Relations inside an allowed schema: other triples are dropped before they are counted."""
    labels, allowed = R.allowed_schema(LABELS, ALLOWED)
    return R.relations(R.triples(D.chunks(spark, sf_dir), WINDOW, labels, allowed))


@query(_sql("SELECT source_label || '-' || type || '->' || target_label AS triplet, count(*) AS n_pairs FROM kept GROUP BY ALL HAVING count(*) >= 2"))
def inferred_schema(spark, sf_dir):
    """The schema that the relations of all documents have."""
    return R.infer_schema(R.relations(_triples(spark, sf_dir)))


@query(_sql("SELECT source_label || '-' || type || '->' || target_label AS triplet, count(*) AS n_pairs FROM kept WHERE source_label <> 'Long' AND target_label <> 'Long' AND type IN ('THE', 'NEXT_TO') GROUP BY ALL"))
def schema_of_lists(spark, sf_dir):
    """Lists of labels and types, put together as the relations have them."""
    return R.schema_among(R.relations(_triples(spark, sf_dir)), ["Short", "Mid"], ["THE", "NEXT_TO"])


@query(D.sql("SELECT string_split(src, ':')[1] || '-' || type || '->' || string_split(dst, ':')[1] AS triplet, count(*) AS n FROM rels GROUP BY ALL", "rels"))
def described_schema(spark, sf_dir):
    """The schema read from descriptions of all relations of the business graph, written in two notations by turns."""
    label = lambda c: F.substring_index(c, ":", 1)
    rows = D.rels(spark, sf_dir).select(label(F.col("src")).alias("a"), "type", label(F.col("dst")).alias("b"), (F.crc32(F.col("dst").cast("binary")) % 2 == 0).alias("turn"))
    told = lambda *parts: F.concat(*(F.col(x) if k % 2 else F.lit(x) for k, x in enumerate(parts)))
    drawn, stated = told("MATCH (x:", "a", ")-[r:", "type", "]->(y:", "b", ") RETURN x; // drawn"), told('* "', "a", '" -', "type", '-> "', "b", '", as stated')
    return R.described_schema(rows.select(F.when(F.col("turn"), drawn).otherwise(stated).alias("text")))
