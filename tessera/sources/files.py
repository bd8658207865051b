"""Files of any store that Spark reads, as pages of text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Byte order marks and the encodings that they announce.
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def list_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, name and size of the files below a folder; their content is not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select("path", T.base_name(F.col("path")).alias("name"), F.col("length").alias("size"))


def encoding_of(head: bytes) -> str:
    """By its mark, else UTF-8 if the first bytes are that (but for a cut character at their end), else Latin-1."""
    for mark, name in MARKS:
        if head.startswith(mark):
            return name
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as broken:
        return "utf-8" if broken.start >= len(head) - 3 and len(head) >= 4096 else "latin-1"
    return "utf-8"


def html_text(html: str) -> str:
    """Visible text of a page, blocks on lines of their own."""
    html = re.sub(r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ", html)
    html = re.sub(r"(?s)<!--.*?-->", " ", html)
    html = re.sub(r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n", html)
    import html as entities

    text = entities.unescape(re.sub(r"(?s)<[^>]*>", " ", html))
    return "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x)


def _pages(name: str, content: bytes) -> Iterator[tuple[int, str]]:
    kind = re.search(r"(\.[^./]+)?$", name.lower())[0]
    if kind == ".pdf":
        raise ValueError(f"{name}: reading pdf needs a decoder; pass one to read_pages")
    text = content.decode(encoding_of(content[:4096]), errors="replace")
    if kind in (".html", ".htm"):
        text = html_text(text)
    # A form feed ends a page.
    yield from enumerate(text.split("\f"), 1)


def read_pages(spark: SparkSession, path: str, pattern: str = "*", decoders: dict | None = None) -> DataFrame:
    """file, page_number, text of all files below a path. decoders: from a suffix to a function of bytes that gives pages."""
    own = decoders or {}

    def decoded(batches):
        for b in batches:
            rows = []
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                suffix = "." + name.rsplit(".", 1)[-1].lower()
                pages = enumerate(own[suffix](content), 1) if suffix in own else _pages(name, content)
                rows += [(name.rsplit("/", 1)[-1], k, t) for k, t in pages]
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], ["file", "page_number", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(decoded, "file string, page_number int, text string")


def repage(elements: DataFrame) -> DataFrame:
    """file, seq, kind, text -> file, page, text: a PageBreak element ends a page; texts are joined in order."""
    from pyspark.sql import Window

    breaks = F.sum((F.col("kind") == "PageBreak").cast("int")).over(Window.partitionBy("file").orderBy("seq"))
    own = elements.withColumn("page", breaks + 1).where("kind != 'PageBreak'")
    joined = own.groupBy("file", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("o"))
    return joined.select("file", "page", F.array_join(F.transform("o", lambda x: x.text), " ").alias("text"))


def web_pages(pages: DataFrame) -> DataFrame:
    """url, title and text of raw pages, without Python: markup goes by patterns."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    text = T.collapse(T.unescaped(F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")))
    return pages.select("page_id", "url", T.url_last_segment(F.col("url")).alias("title"), text.alias("text"))


def transcript_text(pieces: DataFrame) -> DataFrame:
    """video, text: pieces (video, start, text) joined in the order of their starts."""
    o = pieces.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("o"))
    return o.select("video", F.array_join(F.transform("o", lambda x: x.text), " ").alias("text"))


def encyclopedia_text(text: Column, most: int = 100_000) -> Column:
    """The first characters of an article, as the source gives them."""
    return F.substring(text, 1, most)


def schema_templates(spark: SparkSession, path: str) -> DataFrame:
    """name and triplets of templates in JSON: {schema, triplet[]}, or {labels[], relationshipTypes[], schema} without triplets."""
    rows = spark.read.schema("schema string, triplet array<string>, labels array<string>, relationshipTypes array<string>").option("multiLine", True).json(path)
    return rows.select("schema", F.coalesce("triplet", F.array().cast("array<string>")).alias("triplets"), "labels", F.col("relationshipTypes").alias("types"))


def importer_triples(document: str) -> list[tuple[str, str, str]]:
    """Triples of an importer's JSON: its relationship types join node types that are named by reference."""
    graph = json.loads(document)["dataModel"]["graphSchemaRepresentation"]["graphSchema"]
    if not isinstance(graph.get("nodeObjectTypes"), list) or not isinstance(graph.get("relationshipObjectTypes"), list):
        raise ValueError("node and relationship types must be lists")
    token = {x["$id"]: x["token"] for x in [*graph["nodeLabels"], *graph["relationshipTypes"]]}
    node = {x["$id"]: token[x["labels"][0]["$ref"].lstrip("#")] for x in graph["nodeObjectTypes"]}
    end = lambda x: node[x["$ref"].lstrip("#")]
    return [(end(r["from"]), token[r["type"]["$ref"].lstrip("#")], end(r["to"])) for r in graph["relationshipObjectTypes"]]


_REF = "struct<`$ref`: string>"
_NAMED = "array<struct<`$id`: string, token: string>>"
_IMPORT = (
    f"dataModel struct<graphSchemaRepresentation: struct<graphSchema: struct<nodeLabels: {_NAMED}, relationshipTypes: {_NAMED}, nodeObjectTypes: array<struct<`$id`: string, labels: array<{_REF}>>>, "
    f"relationshipObjectTypes: array<struct<`$id`: string, type: {_REF}, from: {_REF}, to: {_REF}>>>>>"
)


def imported_triples(document: Column) -> Column:
    """As ``importer_triples``, of a column of such documents: an array of source, relation, target; null where the lists are missing."""
    graph = F.from_json(document, _IMPORT).dataModel.graphSchemaRepresentation.graphSchema
    entries = lambda x, value: F.map_from_entries(F.transform(x, lambda y: F.struct(y["$id"].alias("k"), value(y).alias("v"))))
    at = lambda names, ref: F.element_at(names, F.substring(ref["$ref"], F.lit(2), F.length(ref["$ref"])))
    token = entries(F.concat(graph.nodeLabels, graph.relationshipTypes), lambda y: y.token)
    node = entries(graph.nodeObjectTypes, lambda y: at(token, F.get(y.labels, F.lit(0))))
    triple = lambda r: F.struct(at(node, r["from"]).alias("source"), at(token, r["type"]).alias("relation"), at(node, r["to"]).alias("target"))
    return F.when(graph.nodeObjectTypes.isNotNull(), F.transform(graph.relationshipObjectTypes, triple))
