"""A quality score: kernel ridge regression by random Fourier features over document statistics, calibrated by isotonic regression.

Statistics of each text are standardized and mapped to D random cosine features, which approximate a Gaussian kernel. Each partition
sums its part of the normal equations (D + 1 rows of numbers whatever its size), Spark adds these up by row, and the driver solves
one D + 1 square system. Raw scores of labelled rows that the ridge fit has not seen are counted in fixed bins and made monotone.

Edge cases: null and empty texts have the statistics of an empty text and get a score like any other; unlabelled rows only get
scores; null labels and null ids are not learnt from; repeated rows each get a row and each count; with no usable label at all the
score is 0.5; a table without rows gives none; further columns are ignored by ``score_quality`` and kept by ``with_score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from tessera.llm.common import bounded_batches, crc_of, labelled_sample, materialize, summed_arrays

#: Characters whose share in a text is a statistic.
MARKS = ("#*$%&<>", "|", "!?", ".,;:", "\n")
N_STATS = 9 + len(MARKS)
#: Labelled rows that ``with_score`` learns from, at most: a sample by a hash of the id.
LABELLED = 50_000


def statistics(text: str | None) -> list[float]:
    """What is measured of one whole text; all are ratios or logarithms, so long texts are like short ones."""
    text = text or ""
    n, words = len(text), text.split()
    m = max(1, len(words))
    lines = text.split("\n")
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    shares = [sum(map(text.count, marks)) / max(1, n) for marks in MARKS]
    upper = np.count_nonzero((codes >= 65) & (codes <= 90)) / max(1, n)
    digits = np.count_nonzero((codes >= 48) & (codes <= 57)) / max(1, n)
    distinct = len(set(words))
    runs = sum(map(str.__eq__, words, words[1:]))
    return [
        np.log1p(n), np.log1p(len(words)), n / m, upper, digits, distinct / m, np.log1p(m / max(1, distinct)), runs / m,
        1 - len(set(lines)) / len(lines), *(np.sqrt(s) for s in shares),
    ]


@pandas_udf(ArrayType(DoubleType()))
def _statistics(text: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in text])


@dataclass(frozen=True)
class QualityModel:
    """mean, scale: of the statistics. omega, phase: of the random features. weights: the last is the intercept. bounds, levels: calibration."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    bounds: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = (stats - self.mean) / self.scale
        x = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.omega + self.phase)
        return np.hstack([x, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.bounds, self.levels)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), b.column("y").to_numpy(zero_copy_only=False)


def _normal_equations(labelled: DataFrame, model: QualityModel, size: int) -> np.ndarray:
    """X'X with X'y as its last column: each partition sends a row for each row of the matrix, and these are added up in two rounds."""

    def partial(batches):
        total = np.zeros((size, size + 1))
        for stats, y in _rows_of(batches):
            x = model.features(stats)
            total += x.T @ np.column_stack([x, y])
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    sums = summed_arrays(labelled.mapInArrow(partial, "i int, row array<double>"), "i", "row").collect()  # size rows
    return np.array([r.row for r in sorted(sums)])


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression of points sorted by x: the pooled means at their mean x."""
    blocks: list[list[float]] = []  # of weight, sum of y, sum of x
    for xi, yi, w in zip(x, y, weight):
        blocks.append([w, w * yi, w * xi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def _calibration(labelled: DataFrame, model: QualityModel, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of the labels on the raw score, over counts in so many fixed bins of -1 to 2."""
    raw = pandas_udf(lambda s: pd.Series(model.raw(np.stack(s))) if len(s) else pd.Series(dtype=float), "double")
    place = F.least(F.greatest(F.floor((F.col("raw") + 1) / 3 * bins), F.lit(0)), F.lit(bins - 1))
    counted = labelled.withColumn("raw", raw("stats")).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    rows = sorted(counted.collect())  # a row a bin at most
    if not rows:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    # Half a label of each kind keeps scores off 0 and 1.
    n, y = np.array([r.n for r in rows], float), np.array([r.y for r in rows], float)
    x = (np.array([r.bin for r in rows]) + 0.5) / bins * 3 - 1
    bounds, levels = isotonic(x, y / n, n)
    return bounds, np.clip(levels, 0.001, 0.999)


def fit_quality(stats: DataFrame, labels: DataFrame, features: int = 128, gamma: float = 0.02, ridge: float = 1e-3, bins: int = 1000, seed: int = 7) -> QualityModel | None:
    """Fits a model to stats (doc_id, stats) of rows that may be learnt from, and labels (doc_id, quality).

    One labelled row in five, by a hash of its id, is kept for calibration. An id has one label: the smallest, if several disagree.
    """
    y = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    rows = materialize(stats.join(y, "doc_id").select("stats", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("later")), "labelled")
    of = [f(F.col("stats")[k]) for k in range(N_STATS) for f in (F.mean, F.stddev_pop)]
    about = rows.agg(F.count("*"), *of).head()
    if not about[0]:
        return None
    at = np.array(about[1:], float).reshape(-1, 2)
    random = np.random.default_rng(seed)
    omega = random.normal(scale=np.sqrt(2 * gamma), size=(N_STATS, features))
    model = QualityModel(at[:, 0], np.where(at[:, 1] > 1e-9, at[:, 1], 1), omega, random.uniform(0, 2 * np.pi, features), np.zeros(0), np.zeros(0), np.zeros(0))
    size = features + 1
    both = _normal_equations(rows.where("NOT later"), model, size)
    if not len(both):
        both = _normal_equations(rows, model, size)
    n = max(1.0, both[-1, -2])  # the intercept's own square counts the rows
    weights = np.linalg.solve(both[:, :-1] / n + ridge * np.eye(size), both[:, -1] / n)
    model = QualityModel(model.mean, model.scale, omega, model.phase, weights, model.bounds, model.levels)
    bounds, levels = _calibration(rows.where("later"), model, bins)
    return QualityModel(model.mean, model.scale, omega, model.phase, weights, bounds, levels)


def score_column(model: QualityModel | None, stats: Column) -> Column:
    """0 to 1: how likely the label is 1."""
    if model is None:
        return F.lit(0.5)
    score = pandas_udf(lambda s: pd.Series(model.score(np.stack(s))) if len(s) else pd.Series(dtype=float), "double")
    return score(stats)


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; rows where held_out is true are not learnt from."""
    bounded_batches(docs.sparkSession)
    stats = materialize(docs.select("doc_id", held_out.alias("held_out"), _statistics("text").alias("stats")), "statistics")
    model = fit_quality(stats.where("NOT held_out").select("doc_id", "stats"), labels)
    return stats.select("doc_id", "held_out", score_column(model, F.col("stats")).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def with_score(docs: DataFrame, labels: DataFrame, held_out: Column, name: str = "score") -> DataFrame:
    """docs with a column more. Texts are read twice: to fit, on LABELLED labelled rows at most, and to score; none is shuffled."""
    bounded_batches(docs.sparkSession)
    known = labelled_sample(labels.where("quality IS NOT NULL").select("doc_id"), LABELLED)
    stats = docs.where(~held_out).select("doc_id", "text").join(known, "doc_id", "left_semi")
    model = fit_quality(materialize(stats.select("doc_id", _statistics("text").alias("stats")), "statistics"), labels)
    return docs.withColumn(name, score_column(model, _statistics(docs["text"])))


def third(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3."""
    return crc_of(F.col(doc_id)) % 3 == 1
