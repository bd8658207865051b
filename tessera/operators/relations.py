"""Typed relations between entities of chunks, inside an allowed schema, and the schema that a corpus or a description has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ingest import entity_label
from tessera.operators.models import Extractor, capitalized_words, consolidation
from tessera.sinks_shared import materialize

Triple = tuple[str, str, str]
#: From the words of a chunk and the place of an entity to the name of the relation that leads there.
Namer = Callable[[Column, Column], Column]

#: A relation in a description: A-REL->B or (:A)-[:REL]->(:B), with quotes, names of variables or blanks around.
_DESCRIBED = r"""\(?(?:\w*:)?["'`]?([A-Za-z]\w*)["'`]?\)?\s*-\s*\[?(?:\w*:)?["'`]?([A-Za-z]\w*)["'`]?\]?\s*->\s*\(?(?:\w*:)?["'`]?([A-Za-z]\w*)"""


def allowed_schema(nodes: str, relations: str = "") -> tuple[list[str], list[Triple]]:
    """Labels and (source, type, target) of two comma-separated lists. ValueError if a relation is incomplete or names another label."""
    split = lambda s: [x.strip() for x in (s or "").split(",") if x.strip()]
    labels, items = split(nodes), split(relations)
    if len(items) % 3:
        raise ValueError("relations are triples of source, type and target")
    triples = list(zip(items[::3], items[1::3], items[2::3]))
    strange = [t for t in triples if t[0] not in labels or t[2] not in labels]
    if strange:
        raise ValueError(f"source or target is no allowed label: {strange}")
    return labels, triples


def word_before(words: Column, place: Column) -> Column:
    """The word that stands before an entity in capitals, if it is all small ASCII letters and two or more; else NEXT_TO."""
    word = F.get(words, place - 1)
    return F.when(word.rlike("^[a-z]{2,}$"), F.upper(word)).otherwise("NEXT_TO")


def _low(*values: Column) -> Column:
    return F.lower(F.concat_ws("\n", *values))


def triples(chunks: DataFrame, window: int = 8, labels: list[str] = (), allowed: list[Triple] = (), extractor: Extractor = capitalized_words, namer: Namer = word_before) -> DataFrame:
    """source, source_label, type, target, target_label, n, docs, source_docs, target_docs and n_docs.

    chunks: file, text. An entity is related to each other one that follows within so many words of its chunk; n counts these pairs in
    chunks, docs the files that have one, source_docs and target_docs the files that have the entity, and n_docs those that have any.
    labels and allowed keep only entities and triples of these, in either case; empty lists keep all. Pairs are made inside each chunk,
    each entity with at most window others, and one aggregation counts pairs, entities and files; texts are not moved. Null and empty
    texts have no entities, a null file is a file, and repeated chunks count again in n but not in docs.
    """
    # The words are a column, so that they are cut once a chunk and not once an entity.
    texts = chunks.select("file", "text", F.split("text", " ").alias("words"))
    words = F.col("words")
    found = F.transform(extractor(F.col("text")), lambda x: F.struct(x.place.alias("place"), x.entity.alias("entity"), entity_label(x.entity).alias("label"), namer(words, x.place).alias("via")))
    if labels:
        found = F.filter(found, lambda x: F.lower(x.label).isin(*(v.lower() for v in labels)))
    none = F.lit(None).cast("string")

    def row(source, label, kind, target, target_label):
        return F.struct(source.alias("source"), label.alias("source_label"), kind.alias("type"), target.alias("target"), target_label.alias("target_label"))

    def pairs(own: Column) -> Column:
        def of(a: Column, i: Column) -> Column:
            near = F.filter(F.slice(own, i + 2, F.lit(window)), lambda b: (b.place <= a.place + window) & (b.entity != a.entity))
            return F.transform(near, lambda b: row(a.entity, a.label, b.via, b.entity, b.label))

        each = F.flatten(F.transform(own, of))
        if allowed:
            each = F.filter(each, lambda t: _low(t.source_label, t.type, t.target_label).isin(*("\n".join(t).lower() for t in allowed)))
        return each

    sorted_ = texts.select("file", F.array_sort(found).alias("m"))
    # Of one kind each: triples, entities (no type), and one row a chunk without either, which counts the files.
    entities = F.transform("m", lambda x: row(x.entity, x.label, none, none, none))
    marks = F.array(row(none, none, none, none, none))
    # A condition on the number of entities would be put before the entities and find them twice.
    each = sorted_.select("file", F.explode(F.when(F.size("m") > 0, F.concat(pairs(F.col("m")), entities, marks))).alias("t")).select("file", "t.*")
    keys = ["source", "source_label", "type", "target", "target_label"]
    counted = each.groupBy("file", *keys).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    counted = materialize(counted, "triples")
    total = counted.where("source IS NULL").select("docs").head()
    docs = counted.where("source IS NOT NULL AND type IS NULL").select("source", "docs")
    side = lambda c: docs.select(F.col("source").alias(c), F.col("docs").alias(f"{c}_docs"))
    return counted.where("type IS NOT NULL").join(side("source"), "source").join(side("target"), "target").withColumn("n_docs", F.lit(total.docs if total else 0).cast("long")).select(*keys, "n", "docs", "source_docs", "target_docs", "n_docs")


def relations(found: DataFrame, least_docs: int = 2, least_lift: float = 1.0) -> DataFrame:
    """source, source_label, type, target, target_label, docs, lift_milli: what triples are more than chance.

    A triple is kept if so many files have it, and at least least_lift times as many as would if its entities were spread over the
    files independently. Of a source and target the type that most files have stays, of equal ones the first by name. lift_milli is
    the measure in thousandths, rounded down.
    """
    lift = F.col("docs").cast("double") * F.col("n_docs") / (F.col("source_docs").cast("double") * F.col("target_docs"))
    strong = found.withColumn("lift", lift).where((F.col("docs") >= least_docs) & (F.col("lift") >= least_lift))
    names = strong.groupBy("source", "target").agg(F.min(F.struct((-F.col("docs")).alias("d"), "type", "source_label", "target_label", "lift")).alias("b"))
    return names.select("source", "b.source_label", "b.type", "target", "b.target_label", (-F.col("b.d")).alias("docs"), F.floor(F.col("b.lift") * 1000).alias("lift_milli"))


def _triplet() -> Column:
    return F.concat("source_label", F.lit("-"), "type", F.lit("->"), "target_label")


def infer_schema(found: DataFrame, least_docs: int = 2, general: bool = False) -> DataFrame:
    """triplet (A-TYPE->B) and n_pairs: the schema that relations have. Triplets of fewer pairs are left out.

    general=True takes types that a rule holds for the same (``consolidation``) for one; types are then brought together first.
    """
    if general:
        names = consolidation(found.select(F.col("type").alias("name")).distinct())
        found = found.join(names, found["type"] == names["old"], "left").withColumn("type", F.coalesce("new", "type"))
    pairs = found.groupBy("source_label", "type", "target_label").agg(F.count("*").alias("n_pairs"))
    return pairs.where(F.col("n_pairs") >= least_docs).select(_triplet().alias("triplet"), "n_pairs")


def described_schema(texts: DataFrame, text: str = "text") -> DataFrame:
    """triplet and n: the relations that descriptions state, in either notation, whatever markup is around them. Equal texts are read once."""
    part = lambda g: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_DESCRIBED), F.lit(g))
    zipped = F.arrays_zip(part(1).alias("source_label"), part(2).alias("type"), part(3).alias("target_label"))
    each = texts.groupBy(text).agg(F.count("*").alias("copies"))
    rows = each.select("copies", F.explode(zipped).alias("t")).select("copies", *(F.col("t").getField(k).alias(k) for k in ("source_label", "type", "target_label")))
    return rows.groupBy(_triplet().alias("triplet")).agg(F.sum("copies").alias("n"))


def schema_among(found: DataFrame, labels: list[str], types: list[str]) -> DataFrame:
    """triplet and n_pairs of the schema whose labels and types are listed: how a list of each is put together, as the relations have it."""
    own = found.where(F.col("source_label").isin(*labels) & F.col("target_label").isin(*labels) & F.col("type").isin(*types))
    return infer_schema(own, 1)
