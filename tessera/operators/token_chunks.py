"""Documents cut into windows of tokens of a public tokenizer, by a table function that is joined laterally to each text.

Plain mode cuts whole texts, page mode each page on its own, and transcript mode gives each window the times of the pieces that it
begins and ends in. The tokenizer is a file of ranks of byte pairs; its path is a parameter. Tokens stand for bytes, so a window's
bounds are exact in bytes, and its text has a replacement character where a bound falls into a character.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Bytes of a text in a block, by which windows meet the pieces of a transcript.
BLOCK = 4096


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@udtf(returnType="position int, text string, tokens int, start long, end long")
class TokenWindows:
    """A row for each window: position (from 1), text, tokens, and its first byte and the one after its last in the text."""

    def eval(self, text: str, size: int, overlap: int, ranks: str):
        if not text:
            return
        encoding = _encoding(ranks)
        pieces = encoding.decode_tokens_bytes(encoding.encode_ordinary(text))
        ends = [0]
        for piece in pieces:
            ends.append(ends[-1] + len(piece))
        step, at, position = size - overlap, 0, 0
        while True:
            position += 1
            own = pieces[at : at + size]
            yield position, b"".join(own).decode(errors="replace"), len(own), ends[at], ends[at + len(own)]
            at += step
            if at + overlap >= len(pieces):
                return


def windows(docs: DataFrame, size: int = 200, overlap: int = 20, cap: int | None = None, ranks: str | None = None) -> DataFrame:
    """docs (text, ...) with the columns of its windows for text; one begins each size - overlap tokens, and the last is the first that
    reaches the end. Null and empty texts have none. cap: the most windows of a row."""
    if not 0 <= overlap < size:
        raise ValueError("an overlap must be shorter than a window")
    cut = TokenWindows(F.col("text").outer(), F.lit(size), F.lit(overlap), F.lit(ranks or default_ranks()))
    rest = [c for c in docs.columns if c != "text"]
    found = docs.alias("d").lateralJoin(cut.alias("w")).select(*(F.col(f"d.{c}") for c in rest), "w.*")
    return found.where(F.col("position") <= cap) if cap else found


def chunked(found: DataFrame) -> DataFrame:
    """Windows with the id (SHA-1) and the length of their text."""
    return found.withColumn("chunk_id", F.sha1("text")).withColumn("length", F.length("text"))


def document_chunks(docs: DataFrame, size: int = 200, overlap: int = 20, cap: int | None = None, ranks: str | None = None) -> DataFrame:
    """Chunks of documents (file, text): file, position, text, tokens, start, end, chunk_id, length."""
    return chunked(windows(docs.select("file", "text"), size, overlap, cap, ranks))


def page_chunks(pages: DataFrame, size: int = 200, overlap: int = 20, cap: int | None = None, ranks: str | None = None) -> DataFrame:
    """Chunks of pages (file, page_number, text), none over a page's end; position counts through the document, cap is of the document.

    A page's first position comes from the counts of the pages before it, so windows themselves are not sorted.
    """
    found = windows(pages.select("file", "page_number", "text"), size, overlap, None, ranks)
    counts = found.groupBy("file", "page_number").agg(F.max("position").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("file", "page_number", F.coalesce(before, F.lit(0)).alias("before"))
    placed = found.join(first, ["file", "page_number"]).withColumn("position", (F.col("position") + F.col("before")).cast("int")).drop("before")
    return chunked(placed.where(F.col("position") <= cap) if cap else placed)


def transcript_chunks(pieces: DataFrame, size: int = 200, overlap: int = 20, ranks: str | None = None) -> DataFrame:
    """Chunks of transcripts (video, start, end, text; in the order of start, then text) with start_time and end_time.

    Texts of a video are joined by blanks. Pieces meet windows by the block of bytes that a window begins or ends in.
    """
    by = Window.partitionBy("video").orderBy("start", "text")
    n = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    at = pieces.select("video", "start", "end", F.sum(n).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("after"), n.alias("n")).withColumn("first", F.col("after") - F.col("n"))
    ordered = F.array_sort(F.collect_list(F.struct("start", F.coalesce("text", F.lit("")).alias("text"))))
    whole = pieces.groupBy("video").agg(ordered.alias("o")).select("video", F.array_join(F.transform("o", lambda x: x.text), " ").alias("text"))
    found = windows(whole, size, overlap, None, ranks).withColumnRenamed("start", "first_byte").withColumnRenamed("end", "end_byte")
    blocks = F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("after") - 1) / BLOCK)))
    own = at.select("video", blocks.alias("block"), "first", "after", F.col("start").alias("time"), F.col("end").alias("time_end"))
    ends = found.select("video", "position", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("first_byte").alias("byte")), F.struct(F.lit(1).alias("side"), (F.col("end_byte") - 1).alias("byte")))).alias("e")).select("video", "position", "e.*")
    hit = ends.withColumn("block", F.floor(F.col("byte") / BLOCK)).join(own, ["video", "block"]).where((F.col("byte") >= F.col("first")) & (F.col("byte") < F.col("after")))
    times = hit.groupBy("video", "position").agg(F.min(F.when(F.col("side") == 0, F.col("time"))).alias("start_time"), F.max(F.when(F.col("side") == 1, F.col("time_end"))).alias("end_time"))
    return chunked(found.join(times, ["video", "position"]).drop("first_byte", "end_byte"))
