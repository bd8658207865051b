"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sinks_shared import materialize, shared_path

#: An unused path in the folder that all executors share.
scratch = shared_path

#: Rows in an Arrow batch; with it, what a Python worker holds at once is bounded.
BATCH_ROWS = 1000

#: The characters that end a word.
SEPARATORS = " \t\n\x0b\x0c\r"


def unused(taken: list[str], *names: str) -> list[str]:
    """names, each with as many underscores behind it as it takes to be none of those taken, in either case."""
    own, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in own:
            name += "_"
        own.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small, for texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text: what stands between SEPARATORS. Null texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SEPARATORS}]+"), "")


def word_hashes(text: Column) -> Column:
    """A 64-bit hash for each word of a text."""
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def crc_of(doc_id: Column) -> Column:
    """crc32 of an id as text; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0))


def labelled_sample(labels: DataFrame, most: int) -> DataFrame:
    """Labelled rows to learn from, one an id, about ``most`` of them at most: those whose id hashes below a share of all.

    So many rows may be broadcast to the texts, which then need not move; the count is checked before that.
    """
    rows = labels.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    rows = materialize(rows, "labelled-sample")
    return F.broadcast(rows) if rows.count() <= 2 * most else rows


def range_cuts(rows: DataFrame, column: str, ranges: int) -> list[int]:
    """Ids at approximate quantiles that cut rows into so many ranges of about as many rows; as many numbers as ranges, whatever the rows."""
    share = [k / ranges for k in range(1, ranges)]
    return sorted(set(rows.agg(F.percentile_approx(column, share, 20 * ranges)).head()[0] or []))


def rank_among(cuts: list[int], value: Column) -> Column:
    """How many of the sorted cuts are below the value, by halving; 0 for null."""
    if not cuts:
        return F.lit(0)
    listed = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")  # one literal, which the optimizer folds
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, len(cuts).bit_length())))))
    forward = lambda at, step: F.when(F.get(listed, at + step - 1) < value, at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), forward)


def summed_arrays(parts: DataFrame, key: str, value: str, fan: int = 256) -> DataFrame:
    """A row for each key: the sum of its arrays (of one length), in two rounds.

    Partitions send a row a key at most. The first round adds up those of so many neighbouring partitions, the second the sums, so no
    task gets more than fan or partitions / fan rows a key; rows are added as they come, and a task holds one array a key.
    """
    kind = dict(parts.dtypes)[value]
    dtype = {"array<bigint>": "int64", "array<double>": "float64"}[kind]

    def added(batches):
        import numpy as np

        sums: dict = {}
        for b in batches:
            values, bounds = flat(b.column(value))
            for k, start, end in zip(b.column(key).to_pylist(), bounds, bounds[1:]):
                sums[k] = sums[k] + values[start:end] if k in sums else np.array(values[start:end], dtype=dtype)
        keys = sorted(sums)
        item = pa.int64() if dtype == "int64" else pa.float64()
        for at in range(0, len(keys), 1024):
            own = keys[at : at + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([sums[k] for k in own], pa.list_(item))], [key, value])

    schema = f"{key} int, {value} {kind}"
    near = parts.select(key, value, F.floor(F.spark_partition_id() / fan).alias("near_"))
    first = near.repartition(key, "near_").select(key, value).mapInArrow(added, schema)
    return first.repartition(key).mapInArrow(added, schema)


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column; null becomes empty."""
    return [x or "" for x in column.to_pylist()]


def flat(column: pa.Array):
    """Values and row bounds (one more than there are rows) of a list column, as numpy arrays. Null rows are empty."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    bounds = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=bounds[1:])
    return column.flatten().to_numpy(zero_copy_only=False), bounds
