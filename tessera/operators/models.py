"""Where models come in: each is a function from columns to a column, so a real one (a pandas UDF) can take the place of the fixed rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.vectors import hashed_embedding
from tessera.operators.ingest import entity_label

#: From a text to a list of (place, entity).
Extractor = Callable[[Column], Column]
#: From a text to a vector.
Embedder = Callable[[Column], Column]
#: From a text to a reply, which may have lines Title: and Summary:.
Writer = Callable[[Column], Column]


def capitalized_words(text: Column) -> Column:
    """Capitalized ASCII words of four letters or more, with their places."""
    words = F.filter(F.transform(F.split(text, " "), lambda w, i: F.struct(i.alias("place"), w.alias("entity"))), lambda x: T.entity_like(x.entity))
    return F.filter(F.transform(words, lambda x: F.struct(x.place.alias("place"), T.letters(x.entity).alias("entity"))), lambda x: F.length(x.entity) > 3)


def word_counts(text: Column) -> Column:
    """A vector of counts of words by hash."""
    return hashed_embedding(T.words(text))


def first_words(text: Column, most: int = 8) -> Column:
    """A title of the first line and a summary of the first words."""
    line = F.get(F.split(text, "\n"), F.lit(1))
    return F.concat(F.lit("Title: "), F.coalesce(line, F.lit("")), F.lit("\nSummary: "), F.array_join(F.slice(T.words(text), 1, most), " "))


def extract(chunks: DataFrame, extractor: Extractor = capitalized_words) -> DataFrame:
    """file, position, chunk_id, place, entity and label of what an extractor finds in chunks."""
    each = chunks.select("file", "position", "chunk_id", F.explode(extractor(F.col("text"))).alias("x"))
    return each.select("file", "position", "chunk_id", F.col("x.place").alias("place"), F.col("x.entity").alias("entity")).withColumn("label", entity_label(F.col("entity")))


def embed(rows: DataFrame, text: str, embedder: Embedder = word_counts, into: str = "embedding") -> DataFrame:
    """rows with vectors where they have none; those that are there stay."""
    vector = embedder(F.col(text))
    return rows.withColumn(into, F.coalesce(into, vector) if into in rows.columns else vector)


def summarize(communities: DataFrame, text: str, writer: Writer = first_words) -> DataFrame:
    """communities with title and summary of what a writer says to each text."""
    return communities.withColumn("reply_", T.title_and_summary(writer(F.col(text)))).withColumns({"title": F.col("reply_.title"), "summary": F.col("reply_.summary")}).drop("reply_")


def consolidation(names: DataFrame, same: Callable[[Column], Column] = lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z0-9]|s$", ""))) -> DataFrame:
    """old and new for names (name) that a rule takes for the same: the shortest, then first, stands for all. Names are labels or types, so few."""
    key = names.select("name", same(F.col("name")).alias("key")).distinct()
    best = key.groupBy("key").agg(F.min(F.struct(F.length("name").alias("n"), "name")).alias("b")).select("key", F.col("b.name").alias("new"))
    return key.join(best, "key").where("name != new").select(F.col("name").alias("old"), "new")


def set_columns(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """rows with the columns of values (one row a key) where it has the key; other rows keep theirs, or null."""
    own = [c for c in values.columns if c != key]
    joined = rows.alias("r").join(values.alias("v"), F.col(f"r.{key}") == F.col(f"v.{key}"), "left")
    kept = [F.coalesce(f"v.{c}", f"r.{c}").alias(c) if c in own else F.col(f"r.{c}") for c in rows.columns]
    return joined.select(*kept, *(F.col(f"v.{c}") for c in own if c not in rows.columns))
