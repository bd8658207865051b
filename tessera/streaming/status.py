"""The life cycle of documents as a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.ingest import latest_by
from tessera.sources.sinks import write_upsert

#: The states of a document, and which may follow which.
FOLLOWS = {
    "New": ("Processing", "Cancelled"),
    "Processing": ("Completed", "Failed", "Cancelled"),
    "Ready to Reprocess": ("Processing", "Cancelled"),
    "Completed": ("Ready to Reprocess",),
    "Failed": ("Ready to Reprocess",),
    "Cancelled": ("Ready to Reprocess",),
}


def latest_status(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last event of each key. On a stream, use it in complete or update mode."""
    return latest_by(events, [key], order, columns)


def changes(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Events whose value differs from that of the key's event before, the first included."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("previous", before).where(F.col("previous").isNull() | (F.col("previous") != F.col(value)))


def valid_step(old: str | None, new: str) -> bool:
    return new in FOLLOWS.get(old, ()) if old else new == "New"


def fold_changes(events: DataFrame, key: str, value: str, order: str = "ts") -> DataFrame:
    """On a stream: key, value, seq of each change, by state that holds each key's last value. Events of one batch are taken in order."""

    def fold(k, batches, state):
        import pandas as pd

        last, n = state.get if state.exists else (None, 0)
        out = []
        for x in sorted((row for b in batches for row in b.itertuples(index=False)), key=lambda r: getattr(r, order)):
            if getattr(x, value) != last:
                last, n = getattr(x, value), n + 1
                out.append((k[0], last, n))
        state.update((last, n))
        yield pd.DataFrame(out, columns=["key", "value", "seq"])

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(fold, f"key {kind}, value string, seq long", "last string, n long", "append", "NoTimeout")


def maintain(spark: SparkSession, source: str, schema: str, target: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Keeps a table of the last row of each key from files that arrive in a folder; each micro-batch is one upsert."""
    columns = [c for c in spark.createDataFrame([], schema).columns if c not in keys]
    stream = spark.readStream.schema(schema).parquet(source)

    def batch(rows: DataFrame, _: int) -> None:
        write_upsert(latest_by(rows, keys, order, columns), target, keys)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events and sums by window and type; on a stream, events later than the watermark are left out."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def backoff(first: float = 1.0, most: int = 10) -> list[float]:
    """Waits before each poll: doubling from the first."""
    return [first * 2**k for k in range(most)]
