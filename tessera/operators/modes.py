"""Modes of answering: which settings a question gets, which questions are refused, and which answerer each of them goes to."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Mode, best hits, vector index, keyword index, whether documents may be selected, label of what is searched.
MODES = [
    ("vector", 5, "vector", None, True, "Chunk"),
    ("fulltext", 5, "vector", "keyword", False, "Chunk"),
    ("entity_vector", 10, "entity_vector", None, False, "__Entity__"),
    ("graph_vector", 5, "vector", None, True, "Chunk"),
    ("graph_vector_fulltext", 5, "vector", "keyword", False, "Chunk"),
    ("global_vector", 10, "community_vector", "community_keyword", False, "__Community__"),
]
#: The mode of questions with an unknown one, the mode without settings, and what refused questions are told.
DEFAULT = "graph_vector_fulltext"
GRAPH = "graph"
REFUSAL = "Please deselect all documents in the table before using this chat mode"

_SETTINGS = "mode string, top_k int, vector_index string, keyword_index string, document_filter boolean, label string"


def resolve(questions: DataFrame) -> DataFrame:
    """questions (mode, files: names of selected documents, and other columns) with answered_by, the mode whose settings count, these
    settings, and refusal, null unless documents are selected in a mode that cannot keep to them.

    An unknown, empty or null mode is answered as the default one, and its own name stays. Mode ``graph`` has no settings and refuses
    nothing. Names are trimmed; null files are none. The settings are a table of six rows, so questions of one mode need no shuffle.
    """
    taken = {"answered_by", "refusal", "top_k", "vector_index", "keyword_index", "document_filter", "label"} & set(questions.columns)
    if taken:
        raise ValueError(f"questions have columns of the result: {sorted(taken)}")
    known = F.col("mode").isin(*(m[0] for m in MODES), GRAPH)
    own = questions.withColumn("answered_by", F.when(known, F.col("mode")).otherwise(DEFAULT))
    own = own.withColumn("files", F.transform(F.coalesce("files", F.array().cast("array<string>")), lambda x: F.trim(x)))
    settings = questions.sparkSession.createDataFrame(MODES, _SETTINGS).withColumnRenamed("mode", "answered_by")
    refused = (F.size("files") > 0) & ~F.col("document_filter")
    return own.join(F.broadcast(settings), "answered_by", "left").withColumn("refusal", F.when(refused, REFUSAL)).select(*questions.columns, "answered_by", *settings.columns[1:], "refusal")


def answer(questions: DataFrame, answerers: dict[str, Callable[[DataFrame], DataFrame]], key: str = "id") -> DataFrame:
    """key, answered_by and message of all questions: the refusal, or what the answerer of the mode gives for its questions (key,
    message); null where it gives nothing. Each answerer gets its own questions only, as one DataFrame, so a mode is one job for all."""
    missing = {m[0] for m in MODES} | {GRAPH}
    if missing - set(answerers):
        raise ValueError(f"no answerer of {sorted(missing - set(answerers))}")
    routed = resolve(questions)
    open_ = routed.where("refusal IS NULL")

    def of(mode: str) -> DataFrame:
        mine = open_.where(F.col("answered_by") == mode)
        return mine.select(key, "answered_by").join(answerers[mode](mine).select(key, "message"), key, "left")

    refused = routed.where("refusal IS NOT NULL").select(key, "answered_by", F.col("refusal").alias("message"))
    return reduce(DataFrame.unionByName, (of(m) for m in answerers), refused)
