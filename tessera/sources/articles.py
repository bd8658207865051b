"""A Python data source of articles: Parquet files below a folder, of any store that pyarrow reaches, in batch and as a stream.

    spark.dataSource.register(ArticleSource)
    spark.read.format("articles").load(folder)              # doc_id, language, text
    spark.readStream.format("articles").load(folder)

Options: most (characters of a text that are kept, 100 000; 0: all), split (bytes of a partition, 64 MB), settle (seconds that a file must
be old before a stream takes it, 0), push (true: filters are pushed).

The driver lists files and cuts them into ranges of bytes; footers are read by the tasks, each of which takes the row groups whose middle
lies in its range. With push, equality and IN on language and doc_id skip row groups by their statistics, and rows, before they reach Spark;
this needs spark.sql.python.filterPushdown.enabled. A stream's offset is the time and path of the last file taken: files must not change, and must
be complete within ``settle`` seconds of their time. A task that is run again reads the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

MOST = 100_000
SCHEMA = "doc_id bigint, language string, text string"
#: Columns of the result that filters can be pushed on, and those of the files.
PUSHED = {"doc_id": "doc_id", "language": "lang"}


@dataclass
class Range(InputPartition):
    """Row groups of a file whose middle is at least at ``begin`` and before ``end``."""

    path: str
    begin: int
    end: int


def _files(folder: str) -> list[tuple[int, str, int]]:
    """Time in nanoseconds, path and size of the Parquet files below a folder or of one file, in this order."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    one = store.get_file_info(base)
    found = [one] if one.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
    scheme = folder.split("://", 1)[0] + "://" if "://" in folder else ""
    host = folder[len(scheme) :].split("/", 1)[0] + "/" if scheme == "hdfs://" else ""
    own = [f for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet") and not f.base_name.startswith(("_", "."))]
    return sorted((f.mtime_ns or 0, scheme + host + f.path.lstrip("/") if host else scheme + f.path, f.size) for f in own)


def _ranges(files: list[tuple[int, str, int]], split: int) -> list[Range]:
    return [Range(path, begin, begin + split) for _, path, size in files for begin in range(0, max(size, 1), split)]


def _possible(group, wanted: dict[str, set]) -> bool:
    """Whether a row group may hold one of the wanted values in each column, by its statistics."""
    for k in range(group.num_columns):
        column = group.column(k)
        if column.path_in_schema in wanted and column.statistics is not None and column.statistics.has_min_max:
            low, high = column.statistics.min, column.statistics.max
            if not any(low <= x <= high for x in wanted[column.path_in_schema]):
                return False
    return True


def _read(part: Range, wanted: dict[str, set], most: int) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(part.path) if "://" in part.path else (fs.LocalFileSystem(), part.path)
    with store.open_input_file(path) as opened:
        file = pq.ParquetFile(opened)
        for k in range(file.num_row_groups):
            group = file.metadata.row_group(k)
            first = group.column(0)
            begin = min(x for x in (first.dictionary_page_offset, first.data_page_offset) if x)
            middle = begin + sum(group.column(c).total_compressed_size for c in range(group.num_columns)) // 2
            if not part.begin <= middle < part.end or not _possible(group, wanted):
                continue
            for batch in file.iter_batches(batch_size=1024, row_groups=[k], columns=["doc_id", "text", "lang"]):
                for name, values in wanted.items():
                    batch = batch.filter(pc.is_in(batch.column(name), pa.array(sorted(values), batch.column(name).type)))
                text = batch.column("text")
                columns = [batch.column("doc_id"), batch.column("lang"), pc.utf8_slice_codeunits(text, 0, most) if most else text]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "language", "text"])


class ArticleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.most, self.split = options["path"], int(options.get("most", MOST)), int(options.get("split", 64 << 20))
        self.wanted: dict[str, set] = {}

    def partitions(self) -> list[Range]:
        return _ranges(_files(self.folder), self.split) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.wanted, self.most) if partition.path else iter(())


class PushedArticleReader(ArticleReader):
    """Spark refuses a reader that takes filters where its setting is off, so this is one of its own."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in PUSHED and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else {x for x in f.value if x is not None}
                own = PUSHED[name]
                self.wanted[own] = self.wanted[own] & values if own in self.wanted else values
            else:
                yield f


class ArticleStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.most, self.split = options["path"], int(options.get("most", MOST)), int(options.get("split", 64 << 20))
        self.settle = int(float(options.get("settle", 0)) * 1e9)

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        import time

        own = [f for f in _files(self.folder) if f[0] <= time.time_ns() - self.settle]
        return {"time": own[-1][0], "path": own[-1][1]} if own else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return _ranges([f for f in _files(self.folder) if low < f[:2] <= high], self.split) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(partition, {}, self.most) if partition.path else iter(())


class ArticleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "articles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArticleReader:
        return (PushedArticleReader if self.options.get("push", "false").lower() == "true" else ArticleReader)(self.options)

    def streamReader(self, schema) -> ArticleStream:
        return ArticleStream(self.options)
