"""The part of a knowledge graph that belongs to some documents or to an answer, as rows of nodes and edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_chunks(chunks: DataFrame, files: DataFrame, limit: int = 50) -> DataFrame:
    """The first chunks of each of some files (file), so many each."""
    own = chunks.join(files.select("file").distinct(), "file", "left_semi")
    return own.withColumn("n_", F.row_number().over(Window.partitionBy("file").orderBy("position"))).where(F.col("n_") <= limit).drop("n_")


def _rows(kind: str, a: Column, b: Column) -> list[Column]:
    return [F.lit(kind).alias("type"), a.alias("a"), b.alias("b")]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def mentioned_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges (source, target) of which both ends are among entities (entity)."""
    own = entities.select("entity").distinct()
    return edges.join(own, edges["source"] == own["entity"], "left_semi").join(own, F.col("target") == own["entity"], "left_semi")


def document_subgraph(files: DataFrame, chunks: DataFrame, mentions: DataFrame, edges: DataFrame, lists: DataFrame, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """Nodes (type, a) and edges (type, a, b), each once: documents, their first chunks, the chains of these, entities that they mention,
    edges between such entities, and the entities' communities with all that these are part of.

    chunks: file, position, chunk_id. mentions: file, position, chunk_id, entity. edges: source, target. lists: entity, communities (the
    community of each level).
    """
    own = first_chunks(chunks, files, limit).select("file", "position", "chunk_id")
    before = own.withColumn("before", F.lag("chunk_id").over(Window.partitionBy("file").orderBy("position")))
    has = mentions.join(own.select("file", "position"), ["file", "position"], "left_semi").select("chunk_id", "entity").distinct()
    entities = has.select("entity").distinct()
    level = lists.join(entities, "entity", "left_semi").select("entity", F.posexplode("communities").alias("level", "c"))
    level = level.withColumn("community", F.concat_ws("-", F.col("level").cast("string"), F.col("c").cast("string")))
    up = level.withColumn("parent", F.lead("community").over(Window.partitionBy("entity").orderBy("level"))).where("parent IS NOT NULL")
    rels = _union([
        own.select(*_rows("PART_OF", F.col("chunk_id"), F.col("file"))), own.where("position = 1").select(*_rows("FIRST_CHUNK", F.col("file"), F.col("chunk_id"))),
        before.where("before IS NOT NULL").select(*_rows("NEXT_CHUNK", F.col("before"), F.col("chunk_id"))), has.select(*_rows("HAS_ENTITY", F.col("chunk_id"), F.col("entity"))),
        mentioned_edges(edges, entities).select(*_rows("RELATED", F.col("source"), F.col("target"))), level.where("level = 0").select(*_rows("IN_COMMUNITY", F.col("entity"), F.col("community"))),
        up.select(*_rows("PARENT_COMMUNITY", F.col("community"), F.col("parent"))),
    ])
    node = lambda kind, c: [F.lit(kind).alias("type"), F.col(c).alias("a")]
    nodes = _union([files.select(*node("Document", "file")), own.select(*node("Chunk", "chunk_id")), entities.select(*node("Entity", "entity")), level.select(*node("Community", "community"))])
    return nodes, rels


def chunk_answer(mentions: DataFrame, edges: DataFrame, chunk_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (type, a) and edges (type, a, b) of the chunks (chunk_id) that an answer used: they, their entities, and edges between these."""
    ids = F.broadcast(chunk_ids.select("chunk_id").distinct())
    has = mentions.join(ids, "chunk_id", "left_semi").select("chunk_id", "entity").distinct()
    rels = _union([has.select(*_rows("HAS_ENTITY", F.col("chunk_id"), F.col("entity"))), mentioned_edges(edges, has).select(*_rows("RELATED", F.col("source"), F.col("target")))])
    nodes = _union([ids.select(F.lit("Chunk").alias("type"), F.col("chunk_id").alias("a")), has.select(F.lit("Entity").alias("type"), F.col("entity").alias("a"))])
    return nodes, rels


def merged_records(records: DataFrame, nodes: str, rels: str) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes (id, labels) and edges (id, ...) of records that each hold lists of them; the system's label is taken off, * stands
    for no other. Of nodes that differ under one id the first by their labels."""
    n = records.select(F.explode(nodes).alias("x")).select("x.*")
    bare = F.array_sort(F.array_except("labels", F.array(F.lit("__Entity__"))))
    own = n.withColumn("labels", F.when(F.size(bare) == 0, F.array(F.lit("*"))).otherwise(bare)).groupBy("id").agg(F.min("labels").alias("labels"))
    return own, records.select(F.explode(rels).alias("x")).select("x.*").distinct()


def answer_details(mode: str, by_chunks: Callable[[], DataFrame], by_entities: Callable[[], DataFrame], by_communities: Callable[[], DataFrame]) -> DataFrame:
    """What an answer rests on, by the mode it was made in; only the one that is asked for is planned."""
    return {"entity_vector": by_entities, "global_vector": by_communities}.get(mode, by_chunks)()


def with_scores(rows: DataFrame, details: DataFrame, default: float | None = None) -> DataFrame:
    """rows (id, ...) with the scores of details (id, score), best first."""
    score = F.col("score") if default is None else F.coalesce("score", F.lit(default))
    return rows.join(details.select("id", "score"), "id", "left").withColumn("score", score).orderBy(F.desc_nulls_last("score"), "id")


def used_ids(documents: DataFrame, columns: list[str]) -> DataFrame:
    """kind, id: each id that any document's lists name, once."""
    return _union([documents.select(F.lit(c).alias("kind"), F.explode(c).alias("id")) for c in columns])


def schema_of(triplets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels with numbers by their order, and edges between these numbers, of triplets (source, relation, target). Schemas are small."""
    labels = triplets.select(F.col("source").alias("label")).union(triplets.select("target")).distinct()
    numbered = labels.withColumn("id", F.row_number().over(Window.orderBy("label")) - 1)
    a, b = numbered.select(F.col("label").alias("source"), F.col("id").alias("a")), numbered.select(F.col("label").alias("target"), F.col("id").alias("b"))
    return numbered, triplets.distinct().join(a, "source").join(b, "target").select("a", "relation", "b")
