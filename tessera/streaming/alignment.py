"""Chunks of transcripts aligned with the pieces most like their ends: bounds first, exact ratios for what they leave."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sinks_shared import materialize

#: Characters of a gram, grams that a first guess is made from, and lengths of pieces that share a block.
GRAM, GUESSES, STEP = 4, 3, 8
#: Pieces of a video up to which a question is compared without a first guess.
FEW = 64


def _counts(texts: list[str]) -> np.ndarray:
    """A row for each text: its characters by the last six bits, so what two rows share is no less than what the texts do."""
    out = np.zeros((len(texts), 64), dtype=np.int32)
    for row, text in zip(out, texts):
        np.add.at(row, np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) & 63, 1)
    return out


def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _guesses(asked: DataFrame, pieces: DataFrame) -> DataFrame:
    """asked with least: the best ratio to one piece each of its rarest grams, which the best of all pieces does not fall below; 0 in
    videos of few pieces, where comparing all takes no more than guessing."""
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - GRAM + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(GRAM)))))
    # Only hashes move with the grams, of which a text has as many as characters; the few texts that are guessed are looked up.
    many = pieces.groupBy("video").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("video")
    pieces, own = pieces.join(many, "video", "left_semi").withColumn("h", F.xxhash64("text")), asked.join(many, "video", "left_semi")
    rare = pieces.select("video", "h", grams("text").alias("gram")).groupBy("video", "gram").agg(F.count("*").alias("n"), F.min("h").alias("h"))
    met = own.select("video", "q", grams("q").alias("gram")).join(rare, ["video", "gram"])
    first = met.withColumn("k", F.row_number().over(Window.partitionBy("video", "q").orderBy("n", "gram"))).where(F.col("k") <= GUESSES).select("video", "q", "h").distinct()
    first = first.join(pieces.select("video", "h", "text"), ["video", "h"])
    like = F.pandas_udf(lambda a, b: pd.Series([_ratio(x, y) for x, y in zip(a, b)], dtype=float), "double")
    known = first.select("video", "q", like("q", "text").alias("r")).groupBy("video", "q").agg(F.max("r").alias("least"))
    return asked.join(known, ["video", "q"], "left").fillna(0.0, ["least"])


def best_pieces(asked: DataFrame, pieces: DataFrame, block: int = 512) -> DataFrame:
    """video, q, start and compared: for each q (video, q; distinct) the start of the piece (video, text, start; one a text) of its video
    that difflib takes for most like it, the earliest of equal ones, and how many pieces it was compared with in full.

    In videos of many pieces a first guess by rare grams gives a ratio to reach. Pieces whose length rules that out are not met; the others come in blocks, of a
    video, a range of lengths and at most about so many pieces and questions, and those whose counts of characters rule it out are not
    compared. Bounds are never below the ratio, so the answer is that of comparing all.
    """
    kind = dict(pieces.dtypes)["start"]
    placed = pieces.withColumn("bucket", F.floor(F.length("text") / STEP))
    ranges = placed.groupBy("video", "bucket").agg(F.count("*").alias("n"), F.ceil(F.count("*") / block).cast("int").alias("parts"))
    crowds = asked.groupBy("video").agg(F.count("*").alias("m"), F.ceil(F.count("*") / block).cast("int").alias("crowds"))
    ranges = materialize(ranges.join(crowds, "video"), "ranges")
    moved = ranges.agg(F.sum(F.col("n") * F.col("crowds") + F.col("m") * F.col("parts"))).head()[0] or 0
    packs = F.lit(max(1, moved // (4 * block)))  # small blocks share a call
    guessed = materialize(_guesses(asked, pieces), "guesses")
    n, low = F.length("q"), F.col("bucket") * STEP
    near = F.greatest(low, F.least(n, low + STEP - 1))  # the length in the range that is most like the question's
    bound = F.when(n + near == 0, 1.0).otherwise(2.0 * F.least(n, near) / (n + near))
    part = lambda c, parts: F.pmod(F.xxhash64(c), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = guessed.join(ranges, "video").where(bound >= F.col("least") - 1e-9).select("video", "q", "least", "bucket", part("q", "crowds").alias("crowd"), every("parts").alias("part"))
    right = placed.join(ranges, ["video", "bucket"]).select("video", "text", "start", "bucket", part("text", "parts").alias("part"), every("crowds").alias("crowd"))

    def compared(questions: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows, blocks, of = [], dict(list(own.groupby(block_key))), questions[block_key].itertuples(index=False, name=None)
        known = {k: (b["text"].tolist(), b["start"].tolist(), b["text"].str.len().to_numpy(), _counts(b["text"].tolist())) for k, b in blocks.items()}
        for block_of, q, least, shared in zip(of, questions["q"], questions["least"], _counts(questions["q"].tolist())):
            if block_of not in known:
                continue
            texts, starts, sizes, counts = known[block_of]
            total = sizes + len(q)
            upper = np.where(total > 0, 2.0 * np.minimum(counts, shared).sum(axis=1) / np.maximum(total, 1), 1.0)
            best, done = None, 0
            for j in np.argsort(-upper, kind="stable"):
                if upper[j] < least:
                    break
                ratio, done = _ratio(q, texts[j]), done + 1
                if best is None or (ratio, -starts[j]) > (best[0], -best[1]):
                    best = (ratio, starts[j])
                least = max(least, ratio)
            if best:
                rows.append((block_of[0], q, *best, done))
        return pd.DataFrame(rows, columns=["video", "q", "ratio", "start", "compared"])

    block_key = ["video", "bucket", "part", "crowd"]
    schema = f"video {dict(asked.dtypes)['video']}, q string, ratio double, start {kind}, compared long"
    pack = F.pmod(F.xxhash64(*block_key), packs)
    found = left.groupBy(pack).cogroup(right.groupBy(pack)).applyInPandas(compared, schema)
    return found.groupBy("video", "q").agg(F.max_by("start", F.struct("ratio", -F.col("start"))).alias("start"), F.sum("compared").alias("compared"))


def align(chunks: DataFrame, pieces: DataFrame, width: int = 40, block: int = 512) -> DataFrame:
    """video, chunk, start, end: for each different chunk (video, chunk: its text) the start of the piece (video, start, text) most like its
    first characters, and of that most like its last; the earliest of equal ones. Pieces of the chunk's video only are compared.

    Null chunks are empty; pieces without a text or start are none, and a chunk whose video is null or has no pieces gives no row.
    """
    plain = lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    rows = chunks.select("video", "chunk").where("video IS NOT NULL").distinct()
    rows = rows.select("video", "chunk", plain(F.left("chunk", F.lit(width))).alias("a"), plain(F.right("chunk", F.lit(width))).alias("b"))
    asked = materialize(rows.select("video", F.explode(F.array("a", "b")).alias("q")).distinct(), "asked")
    told = pieces.where("video IS NOT NULL AND start IS NOT NULL AND text IS NOT NULL").groupBy("video", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text")).agg(F.min("start").alias("start"))
    best = materialize(best_pieces(asked, materialize(told, "pieces"), block), "best")
    side = lambda q, name: best.select("video", F.col("q").alias(q), F.col("start").alias(name))
    return rows.join(side("a", "start"), ["video", "a"]).join(side("b", "end"), ["video", "b"]).select("video", "chunk", "start", "end")
