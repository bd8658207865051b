"""From documents to chunks, mentions and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sinks_shared import materialize


def chunk_windows(docs: DataFrame, size: int = 100, overlap: int = 20, cap: int | None = None) -> DataFrame:
    """file, text -> file, position (from 1), text, chunk_id (SHA-1 of the text), length.

    A window begins each size - overlap words, and the last is the first that reaches the end. A text is cut inside its row: the only
    shuffle is none. cap: the most chunks of a document.
    """
    step = size - overlap
    own = docs.select("file", T.words(F.col("text")).alias("w"))
    last = F.greatest(F.ceil((F.size("w") - overlap) / step), F.lit(1)).cast("int") - 1
    if cap:
        last = F.least(last, F.lit(cap - 1))
    # Texts without words have no windows; a condition on their number would be put before the words and make them twice.
    at = own.select("file", "w", F.explode(F.when(F.size("w") > 0, F.sequence(F.lit(0), last))).alias("k"))
    cut = at.select("file", (F.col("k") + 1).alias("position"), F.array_join(F.slice("w", F.col("k") * step + 1, size), " ").alias("text"))
    return cut.withColumn("chunk_id", F.sha1("text")).withColumn("length", F.length("text"))


def chunk_chain(chunks: DataFrame) -> DataFrame:
    """chunk_id, previous_id, content_offset (lengths of those before), is_first; and the edge that ends in the chunk."""
    w = Window.partitionBy("file").orderBy("position")
    before = F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return chunks.select(
        "file", "position", "chunk_id", F.lag("chunk_id").over(w).alias("previous_id"),
        F.coalesce(before, F.lit(0)).alias("content_offset"), (F.col("position") == 1).alias("is_first"),
        F.when(F.col("position") == 1, "FIRST_CHUNK").otherwise("NEXT_CHUNK").alias("edge"),
    )


def chunk_groups(chunks: DataFrame, together: int) -> DataFrame:
    """Runs of so many neighbouring chunks: their texts and ids joined in order."""
    rows = chunks.withColumn("group_no", F.floor((F.col("position") - 1) / together).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "text", "chunk_id")))
    joined = rows.groupBy("file", "group_no").agg(ordered.alias("o"))
    return joined.select(
        "file", "group_no", F.array_join(F.transform("o", lambda x: x.text), " ").alias("text"),
        F.transform("o", lambda x: x.chunk_id).alias("combined_chunk_ids"),
    )


def entity_mentions(chunks: DataFrame) -> DataFrame:
    """Deterministic stand-in for extraction: capitalized ASCII words of a chunk, with their place among its words."""
    at = chunks.select("file", "position", "chunk_id", F.posexplode(F.split("text", " ")).alias("place", "word"))
    own = at.where(T.entity_like(F.col("word"))).select("file", "position", "chunk_id", "place", T.letters(F.col("word")).alias("entity"))
    return own.where(F.length("entity") > 3).withColumn("label", entity_label(F.col("entity")))


def entity_label(entity: Column) -> Column:
    n = F.length(entity)
    return F.when(n <= 5, "Short").when(n <= 8, "Mid").otherwise("Long")


def mention_edges(mentions: DataFrame) -> DataFrame:
    """Neighbouring entities of a chunk: source, target (smaller name first) and how often."""
    w = Window.partitionBy("file", "position").orderBy("place")
    pairs = mentions.withColumn("next", F.lead("entity").over(w)).where("next IS NOT NULL AND next != entity")
    return pairs.groupBy(F.least("entity", "next").alias("source"), F.greatest("entity", "next").alias("target")).agg(F.count("*").alias("weight"))


def text_edges(docs: DataFrame, size: int = 100, overlap: int = 20) -> DataFrame:
    """file, text -> the edges that ``mention_edges`` finds in the chunks of the texts, without chunks and mentions.

    Entities that follow each other in a chunk follow each other in its text, so they are paired in the text's row and counted once for
    each chunk that holds both; only pairs are moved. Chunks of one file that is in several rows have their mentions in common and go
    through ``mention_edges``.
    """
    again = materialize(docs.groupBy("file").agg(F.count("*").alias("n")).where("n > 1").select(F.col("file").alias("again")), "repeated-files")
    if again.isEmpty():
        return _summed(_text_pairs(docs, size, overlap))
    same = F.col("file").eqNullSafe(F.col("again"))
    mentions = entity_mentions(chunk_windows(docs.join(again, same, "left_semi"), size, overlap))
    return _summed(_text_pairs(docs.join(again, same, "left_anti"), size, overlap).unionByName(mention_edges(mentions)))


def _text_pairs(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """source, target and weight of each two entities that follow each other in a text: the number of chunks that hold both, if any."""
    step = size - overlap
    found = F.transform("w", lambda x, i: F.when(T.entity_like(x), F.struct(i.alias("place"), T.letters(x).alias("entity"))))
    last = F.greatest(F.ceil((F.size("w") - overlap) / step), F.lit(1)) - 1
    # Each step is a column, so that words are cut and entities found once a text.
    own = docs.select(T.words(F.col("text")).alias("w")).select(last.alias("last"), F.filter(found, lambda x: F.length(x.entity) > 3).alias("m"))
    each = own.select("last", F.explode(F.transform("m", lambda x, i: F.struct(x.alias("a"), F.get("m", i + 1).alias("b")))).alias("p"))
    a, b = F.col("p.a"), F.col("p.b")
    # From the first chunk that reaches b to the last that begins at a or before.
    n = F.least(F.floor(a.place / step), "last") - F.floor(F.greatest(b.place - overlap, F.lit(0)) / step) + 1
    pairs = each.where(b.entity != a.entity).select(F.least(a.entity, b.entity).alias("source"), F.greatest(a.entity, b.entity).alias("target"), n.alias("weight"))
    return pairs.where("weight > 0")


def _summed(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def document_counters(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """Nodes and edges of each document; each branch is counted on its own, so none multiplies another."""
    own = chunks.groupBy("file").agg(F.count_distinct("chunk_id").alias("chunk_nodes"), F.count("*").alias("part_of"), F.max("position").alias("last"))
    entities = mentions.groupBy("file").agg(F.count_distinct("entity").alias("entity_nodes"), F.count_distinct("chunk_id", "entity").alias("has_entity"))
    w = Window.partitionBy("file", "position").orderBy("place")
    pairs = mentions.withColumn("next", F.lead("entity").over(w)).where("next IS NOT NULL AND next != entity")
    rels = pairs.groupBy("file").agg(F.count_distinct(F.least("entity", "next"), F.greatest("entity", "next")).alias("entity_rels"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = own.join(entities, "file", "left").join(rels, "file", "left").select(
        "file", "chunk_nodes", n("entity_nodes").alias("entity_nodes"), n("entity_rels").alias("entity_rels"),
        # PART_OF, FIRST_CHUNK, NEXT_CHUNK and HAS_ENTITY edges.
        (F.col("part_of") + F.col("last") + n("has_entity")).cast("long").alias("chunk_rels"),
    )
    return out.withColumn("node_count", F.col("chunk_nodes") + F.col("entity_nodes")).withColumn("relationship_count", F.col("chunk_rels") + F.col("entity_rels"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key: a new row replaces the old, and its nulls leave the old values. Both sides have the same columns."""
    rest = [c for c in old.columns if c not in keys]
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    return a.join(b, on, "full_outer").select(*(F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in keys), *(F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in rest))


def latest_by(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key, by partial aggregation: no key's rows meet in one task before they are reduced."""
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("r")
    return rows.groupBy(*keys).agg(best).select(*keys, "r.*")


def resume_position(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """For each document the first position whose chunk is not done."""
    return chunks.join(done.select("chunk_id").distinct(), "chunk_id", "left_anti").groupBy("file").agg(F.min("position").alias("position"))


def progress(chunks: DataFrame, batch: int = 20) -> DataFrame:
    """After each batch of chunks: how many are done, and of what share."""
    n = chunks.groupBy("file").agg(F.count("*").alias("total"))
    steps = n.select("file", "total", F.explode(F.sequence(F.lit(1), F.ceil(F.col("total") / batch).cast("int"))).alias("batch_no"))
    done = F.least(F.col("batch_no") * batch, F.col("total"))
    return steps.select("file", "total", "batch_no", done.alias("processed"), F.floor(done * 100 / F.col("total")).cast("long").alias("percent"))


def page(rows: DataFrame, key: str, order: str, number: int, size: int = 10) -> DataFrame:
    """One page of each key's rows, with the number of pages."""
    w = Window.partitionBy(key)
    counted = rows.withColumn("row_no", F.row_number().over(w.orderBy(order))).withColumn("total_pages", F.ceil(F.count("*").over(w) / size).cast("long"))
    return counted.where((F.col("row_no") > (number - 1) * size) & (F.col("row_no") <= number * size)).drop("row_no")


def community_counters(mentions: DataFrame, lists: DataFrame) -> DataFrame:
    """file, community_nodes and community_rels: communities of all levels that a document's entities are in, and the edges that lead
    there, each once. lists: entity, communities (the community of each level). Levels are counted each on its own."""
    of = mentions.select("file", "entity").distinct().join(lists, "entity")
    at = of.select("file", "entity", F.posexplode("communities").alias("level", "c"))
    nodes = at.groupBy("file").agg(F.count_distinct("level", "c").alias("community_nodes"), F.count_distinct(F.when(F.col("level") == 0, F.struct("entity", "c"))).alias("members"))
    pairs = of.select("file", F.explode(F.transform(F.slice("communities", 2, 100), lambda c, i: F.struct(i.alias("level"), F.get("communities", i).alias("c"), c.alias("parent")))).alias("p"))
    ups = pairs.groupBy("file").agg(F.count_distinct("p").alias("ups"))
    return nodes.join(ups, "file", "left").select("file", "community_nodes", (F.col("members") + F.coalesce("ups", F.lit(0))).alias("community_rels"))


def without_documents(rows: DataFrame, sources: DataFrame, files: list[str], origins: list[str]) -> DataFrame:
    """rows (file, ...) without those of documents (file, file_source) whose name and origin (None stands for null) are both listed."""
    gone = sources.where(F.col("file").isin(*files) & F.coalesce("file_source", F.lit("None")).isin(*origins)).select("file")
    return rows.join(gone, "file", "left_anti")
