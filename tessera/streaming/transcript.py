"""Windows of about a minute over the pieces of a transcript, and chat memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.streaming.alignment import align as align


def transcript_windows(pieces: DataFrame, width: float = 60.0) -> DataFrame:
    """video, start, text -> video, window_no, start, end, text.

    A window collects pieces until one starts at its border or later; that piece still belongs to it, and the border moves on by the
    width once, however late the piece was. So after a gap several windows hold one piece each. The last is given even if it is not
    full. With f = floor(start / width) of piece i, windows closed after it are c = min(c before + 1, f), which is i plus the least of 0
    and all f - i so far: a running minimum, which streams over a video's sorted pieces. Only a window's own pieces are collected.
    """
    w = Window.partitionBy("video").orderBy("start", "text")
    placed = pieces.select("video", F.col("start").cast("double").alias("start"), "text").withColumn("i", F.row_number().over(w))
    least = F.min(F.floor(F.col("start") / width) - F.col("i")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    closed = placed.withColumn("closed", (F.col("i") + F.least(F.lit(0), least)).cast("int"))
    each = closed.withColumn("window_no", F.lag("closed", 1, 0).over(w))
    of = each.groupBy("video", "window_no").agg(F.min("start").alias("start"), F.max("start").alias("end"), F.array_sort(F.collect_list(F.struct("start", "text"))).alias("o"))
    return of.select("video", "window_no", "start", "end", F.array_join(F.transform("o", lambda x: x.text), " ").alias("text"))


def end_time(start: Column, width: int = 60) -> Column:
    return start + width


def last_messages(turns: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The last k messages of each conversation, numbered from the newest."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return turns.withColumn("age", F.row_number().over(w)).where(F.col("age") <= k)


def summarized(turns: DataFrame, key: str, order: str) -> DataFrame:
    """What memory keeps when it is condensed: a summary message in place of all turns but the last question and answer."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    aged = turns.withColumn("age", F.row_number().over(w))
    older = aged.where("age > 2").groupBy(key).agg(F.count("*").alias("n_older"), F.sum(F.length("text")).alias("chars_older"))
    recent = aged.where("age <= 2").groupBy(key).agg(F.count("*").alias("n_recent"))
    return recent.join(older, key, "left").select(key, "n_recent", F.coalesce("n_older", F.lit(0)).alias("n_older"), F.coalesce("chars_older", F.lit(0)).alias("chars_older"))
