"""A deterministic sharded WARC writer, and a reader.

Pages are cut into shards by id: a page belongs to the shard in which the bytes of all smaller ids end, so the same pages give the
same shards whatever the cluster. The sums of bytes before each id are made on the executors, in two levels: over ranges of ids, then
inside each range. A task gets a run of neighbouring shards, sorts it by id, and writes each shard as files that roll at a compressed
size, one gzip member a record, with headers and digests made anew from the payload. A file is written under a temporary name and
renamed when complete; a task that runs again writes the same bytes under the same name. The manifest, which Spark commits last,
lists the files that count; readers start there.

Of records with equal payloads of ``least`` bytes or more, that with the largest id is the response and the others revisit it.
What revisits what is found on digests alone, and travels to the writer in the same shuffle as the pages.

Edge cases: a null html is an empty payload; a null url has no target header; rows of a null id are written into the first shard, and
are responses only where no equal payload has an id; of rows with one id and one payload the first written is the response and the
others revisit it; all rows of one id are in one shard; an empty table gives an empty manifest; further columns are ignored. Records
are written as they come; a task holds one Arrow batch of them (BATCH_ROWS).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, materialize, range_cuts, rank_among, scratch

SHARD_BYTES = 16 << 20
ROLL_BYTES = 8 << 20
#: The capture date of every record: fixed, so that equal pages give equal files.
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tessera:warc")
#: Tasks of a write, at most: with more shards a task writes several. The driver keeps two numbers a task.
TASKS = 100_000


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _headers(first: str, fields: list[tuple[str, object]]) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields if v is not None), "\r\n"]).encode()


def _uri(url: str | None) -> str | None:
    """Without what would end a header line."""
    return url and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_id(page_id: int | None, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{nth}')}>"


def record(page_id: int | None, nth: int, url: str | None, payload: bytes, refers_to: tuple[int | None, int] | None) -> bytes:
    """One WARC record. refers_to: id and ordinal of the response that this revisits."""
    http = _headers("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    block = http if refers_to else http + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", record_id(page_id, nth)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Page-ID", page_id),
        ("WARC-Profile", PROFILE if refers_to else None),
        ("WARC-Refers-To", record_id(*refers_to) if refers_to else None),
        ("WARC-Refers-To-Page-ID", refers_to[0] if refers_to else None),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return _headers("WARC/1.1", fields) + block + b"\r\n\r\n"


def _info(name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))]
    return _headers("WARC/1.1", fields) + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def planned(ids: DataFrame, target: int, ranges: int | None = None) -> DataFrame:
    """page_id (each once, not null), before (bytes of all smaller ids) and shard, from ids (page_id, bytes).

    Ids are cut into ranges at approximate quantiles, whose sums are as many rows as there are ranges; the sums inside a range are a
    window over it. The cuts only spread the work: what is summed is exact.
    """
    spark = ids.sparkSession
    cuts = range_cuts(ids, "page_id", ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = ids.where("page_id IS NOT NULL").groupBy("page_id").agg(F.sum("bytes").alias("bytes"))
    each = materialize(each.withColumn("range_", rank_among(cuts, F.col("page_id"))), "page-bytes")
    earlier = lambda w: F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = each.groupBy("range_").agg(F.sum("bytes").alias("bytes"))
    offsets = F.broadcast(sums.select("range_", earlier(Window.orderBy("range_")).alias("offset")))  # a row a range
    inside = each.select("page_id", "range_", earlier(Window.partitionBy("range_").orderBy("page_id")).alias("inside"))
    before = F.col("inside") + F.col("offset")
    return inside.join(offsets, "range_").select("page_id", before.alias("before"), F.floor(before / target).alias("shard"))


def task_starts(ids: DataFrame, target: int, tasks: int = TASKS) -> list[tuple[int, int]]:
    """For each task its first id and the bytes before that: runs of so many shards that there are at most so many tasks."""
    whole = ids.agg(F.sum("bytes")).head()[0] or 0
    together = max(1, -(-whole // (target * tasks)))
    of = planned(ids, target).groupBy(F.floor(F.col("shard") / together).alias("task"))
    return sorted(tuple(r) for r in of.agg(F.min("page_id").alias("first"), F.min("before").alias("before")).select("first", "before").collect())


def _rows(pages: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Pages, and a notice before each page that revisits another; and the ids and bytes of all pages."""
    payload = F.coalesce("html", F.lit(""))
    ids = materialize(pages.select("page_id", F.octet_length(payload).alias("bytes"), F.unhex(F.sha2(payload, 256)).alias("sha")), "page-digests")
    groups = ids.where(F.col("bytes") >= least).groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    groups = materialize(groups.select("sha", "refers_to"), "equal-payloads")
    notices = ids.join(groups, "sha").where("page_id IS NULL OR page_id < refers_to").select("page_id", "sha", "refers_to").distinct()
    of = pages.select("page_id", F.unhex(F.sha2(payload, 256)).alias("sha"), F.lit(None).cast("bigint").alias("refers_to"), F.lit(1).alias("kind"), "url", payload.alias("html"))
    empty = {"kind": F.lit(0), "url": F.lit(None).cast("string"), "html": F.lit(None).cast("string")}
    return of.unionByName(notices.withColumns(empty)), ids


class _File:
    """A file under a temporary name until it is closed."""

    def __init__(self, base: str, name: str, level: int):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(base)
        self.name, self.level = name, level
        self.temporary = f"{self.base}/_temporary/{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.base}/_temporary", recursive=True)
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.bytes, self.records, self.digest = 0, 0, hashlib.sha256()
        self.add(_info(name))
        self.records = 0

    def add(self, data: bytes) -> None:
        data = _member(data, self.level)
        self.out.write(data)
        self.digest.update(data)
        self.bytes += len(data)
        self.records += 1

    def close(self) -> tuple[str, int, int, str]:
        self.out.close()
        self.fs.move(self.temporary, f"{self.base}/{self.name}")
        return self.name, self.records, self.bytes, self.digest.hexdigest()


def write(pages: DataFrame, base: str, least: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, level: int = 6) -> DataFrame:
    """Writes the archive below base, a URI that pyarrow can open, and gives its manifest: file, records, bytes, sha256.

    least: payloads of fewer bytes are never revisited. roll_bytes: a file ends after the record that brings it to this size.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    rows, ids = _rows(pages.select("page_id", "url", "html"), least)
    starts = task_starts(ids, shard_bytes)
    firsts = [first for first, _ in starts]
    # A task begins at its first id, so the first ids of those after it are the cuts.
    task = rank_among([first - 1 for first in firsts[1:]], F.col("page_id"))
    dealt = rows.withColumn("task", task).repartitionById(max(1, len(starts)), "task").sortWithinPartitions("page_id", "sha", "kind", "url")
    known_starts = dict(starts)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq, file, at, nth, known, before, own = None, 0, None, object(), 0, {}, None, 0
        done: list[tuple[str, int, int, str]] = []
        for b in batches:
            for page_id, sha, kind, refers_to, url, html in zip(*(b.column(c).to_pylist() if c != "html" else (x.as_py() for x in b.column(c)) for c in ("page_id", "sha", "kind", "refers_to", "url", "html"))):
                if page_id != at:
                    at, nth, known = page_id, 0, {}
                    if page_id is not None:
                        before, own = known_starts[page_id] if before is None else before + own, 0
                    now = 0 if before is None else before // shard_bytes
                    if now != shard:
                        if file:
                            done.append(file.close())
                        shard, seq, file = now, 0, None
                if not kind:
                    known[sha] = (refers_to, 0)
                    continue
                payload = html.encode()
                own += len(payload) if page_id is not None else 0
                file = file or _File(base, f"part-{shard:06d}-{seq:04d}.warc.gz", level)
                file.add(record(at, nth, url, payload, known.get(sha)))
                if at is not None and len(payload) >= least:
                    known.setdefault(sha, (at, nth))
                nth += 1
                if file.bytes >= roll_bytes:
                    done.append(file.close())
                    seq, file = seq + 1, None
        if file:
            done.append(file.close())
        columns = list(zip(*done)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["file", "records", "bytes", "sha256"])

    schema = "file string, records long, bytes long, sha256 string"
    dealt.select("page_id", "sha", "kind", "refers_to", "url", "html").mapInArrow(written, schema).write.parquet(f"{base}/_manifest")
    _drop_temporary(base)
    return spark.read.schema(schema).parquet(f"{base}/_manifest")


def _drop_temporary(base: str) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(base)
    if store.get_file_info(f"{path}/_temporary").type != fs.FileType.NotFound:
        store.delete_dir(f"{path}/_temporary")


def parse(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Headers, block and offset of each record of an archive, one gzip member at a time."""
    rest, offset = b"", 0
    while rest := rest or stream.read(chunk):
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while True:
            parts.append(unpack.decompress(rest))
            used += len(rest) - len(unpack.unused_data)
            rest = unpack.unused_data
            if unpack.eof:
                break
            rest = stream.read(chunk)
            if not rest:
                raise ValueError("the archive ends inside a record")
        data = b"".join(parts)
        head, _, block = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, block[: int(fields["Content-Length"])], offset
        offset += used


def read(spark: SparkSession, base: str) -> DataFrame:
    """A row for each response and revisit of an archive, files in parallel. A payload that differs from its digest is an error."""
    bounded_batches(spark)
    files = spark.read.schema("file string").parquet(f"{base}/_manifest")
    # A task for some files of at most ROLL_BYTES or a record each.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), files.count() // 16)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def one(fields: dict[str, str], block: bytes, name: str, offset: int):
        http, _, payload = block.partition(b"\r\n\r\n")
        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
            raise ValueError(f"{name}: the payload of {fields['WARC-Record-ID']} differs from its digest")
        number = lambda k: int(fields[k]) if k in fields else None
        return number("WARC-Page-ID"), fields.get("WARC-Target-URI"), size, digest, kind, number("WARC-Refers-To-Page-ID"), name, offset

    def records(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(base)
        for b in batches:
            for name in b.column("file").to_pylist():
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    held = []
                    for fields, block, offset in parse(stream):
                        if fields["WARC-Type"] != "warcinfo":
                            held.append(one(fields, block, name, offset))
                        if len(held) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"
    return files.repartition(min(parts, TASKS), "file").mapInArrow(records, schema)


def round_trip(pages: DataFrame, base: str | None = None, least: int = 0) -> DataFrame:
    """Writes the pages and reads the archive back."""
    base = base or scratch(pages.sparkSession, "warc")
    write(pages, base, least)
    return read(pages.sparkSession, base).drop("url", "offset")
