"""Rows of the table of sources: states, and what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a retry begins with.
FROM_START, WITHOUT_ENTITIES, FROM_LAST = "start_from_beginning", "delete_entities_and_start_from_beginning", "start_from_last_processed_position"


def register(sources: DataFrame, new: DataFrame) -> DataFrame:
    """sources with each new file (file, and any of the other columns) as state New with zeroed counters; a file that is known begins anew."""
    own = {c: F.col(c) if c in new.columns else F.lit(None).cast(t) for c, t in sources.dtypes}
    own |= {"status": F.lit("New"), "is_cancelled": F.lit(False)} | {c: F.lit(0).cast(dict(sources.dtypes)[c]) for c in ("total_chunks", "processed_chunk", "node_count", "relationship_count") if c in sources.columns}
    rows = new.dropDuplicates(["file"]).select(*(v.alias(c) for c, v in own.items()))
    return sources.join(rows.select("file"), "file", "left_anti").select(sources.columns).unionByName(rows)


def _changed(sources: DataFrame, changes: DataFrame, values: dict[str, Column]) -> DataFrame:
    """sources with these values in the rows that changes (file, ...) names."""
    of = changes.dropDuplicates(["file"]).withColumn("hit_", F.lit(True))
    joined = sources.join(of, "file", "left")
    return joined.select(*((F.when(F.col("hit_"), values[c]).otherwise(F.col(c)) if c in values else F.col(c)).alias(c) for c in sources.columns))


def fail(sources: DataFrame, failures: DataFrame) -> DataFrame:
    """failures: file, message. A file that was cancelled stays Cancelled, any other becomes Failed; the message is kept if there is a column for it."""
    own = {"status": F.when(F.col("is_cancelled"), "Cancelled").otherwise("Failed")}
    return _changed(sources, failures, own | ({"error_message": F.col("message")} if "error_message" in sources.columns else {}))


def cancel(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Files (file) are Cancelled; what was processed stays counted."""
    return _changed(sources, files.select("file"), {"status": F.lit("Cancelled"), "is_cancelled": F.lit(True)})


def retry(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: file, condition. State Ready to Reprocess; two conditions begin at chunk 0, one of them with no entities."""
    start = F.col("condition").isin(FROM_START, WITHOUT_ENTITIES)
    bare = F.col("condition") == WITHOUT_ENTITIES
    own = {"status": F.lit("Ready to Reprocess"), "is_cancelled": F.lit(False), "processed_chunk": F.when(start, 0).otherwise(F.col("processed_chunk"))}
    own |= {c: F.when(bare, 0).otherwise(F.col(c)) for c in ("node_count", "relationship_count")}
    return _changed(sources, wanted, own)


def ready(status: Column, origin: Column | None = None) -> Column:
    """May be processed; with an origin: and is a local file."""
    own = status.isin("New", "Ready to Reprocess")
    return own if origin is None else own & (origin == "local file")


def matches_filters(wanted: dict[str, str]) -> Column:
    """Equality by column; All lets everything pass."""
    out = F.lit(True)
    for column, value in wanted.items():
        out = out if value == "All" else out & (F.col(column) == value)
    return out


def shown(sources: DataFrame) -> DataFrame:
    """Rows as the table shows them: kind in upper case without dot, sizes and counters 0 if null, url blank if None, percent or null."""
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    percent = F.when(F.col("total_chunks") > 0, F.floor(F.col("processed_chunk") * 100 / F.col("total_chunks")).cast("long"))
    return sources.select(
        "file", n("file_size"), F.coalesce(F.upper(F.regexp_replace("file_type", "[.]", "")), F.lit("")).alias("file_type"), "file_source", "status",
        F.when(F.col("url").contains("None") | F.col("url").isNull(), "").otherwise(F.col("url")).alias("url"), n("node_count"), n("relationship_count"), percent.alias("percent"),
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"),
    )


def source_of(url: Column, file: Column) -> Column:
    """The url that an answer names, or the file where there is none."""
    return F.coalesce(F.when(url.contains("None"), file).otherwise(url), file)


def status_json(sources: DataFrame) -> DataFrame:
    """file and its row of counters as JSON."""
    own = F.struct("file", "status", "total_chunks", "processed_chunk", "node_count", "relationship_count", "is_cancelled")
    return sources.select("file", F.to_json(own).alias("json"))


def route(size: Column, limit: int) -> Column:
    """How a file under way is followed: small ones are asked for, large ones send events."""
    return F.when(size < limit, "polling").otherwise("stream")


def page_of(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of a sorted table."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)
