"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

The statistics of a document (lengths, character classes, repeats, function words) are transformed to be nearer to normal and standardised. Each class has
a mean and a covariance; the covariance is shrunk towards the identity. All come from sums over every labelled row that isn't held out,
so one aggregate of fixed size goes to the driver. A score is the logistic of the difference of the two log densities plus the log prior ratio; each
density's Mahalanobis distance comes from the inverse Cholesky factor, computed once and sent with the tasks.

Defined cases: an empty or null text has all statistics 0 and is scored like any other; without labels of both classes every score is the share of
label 1 (0.5 without labels); repeated rows are scored each for itself, and a doc_id with several labels counts as 1 if any is 1; very long texts are read whole and their statistics cut off at CLIP
deviations; a score can't tie with the threshold but by equal statistics; extra columns, also of clashing names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.llm.common import arrow_batches, materialize, table
from shoalgrid.llm.labels import held_out, training
from shoalgrid.llm.quality_rules import CLASSES, SYMBOLS, VOCABULARY, document_statistics

THRESHOLD = 0.3
SHRINKAGE = 0.1
#: Standardised statistics are cut off at so many deviations, so that one odd value does not outweigh all others.
CLIP = 8.0
#: Log odds are cut off here, which keeps scores apart from 0 and 1.
LOG_ODDS = 30.0


def features(stats: DataFrame) -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.aggregate("classes", F.lit(0).cast("long"), lambda s, x: s + x), F.lit(1)).cast("double")
    share = lambda k: F.sqrt(F.col("classes")[k] / chars)
    place = {"consonants": 0, "vowels": 1, "symbols": CLASSES.index(SYMBOLS), "upper": 3, "digits": 4, "points": 5, "shouts": 6, "others": 7, "spaces": 8}
    return {
        "words": F.log1p("n_words"),
        "word_length": F.log1p(F.col("word_chars") / n),
        "repeats": F.sqrt(F.col("n_repeat_words") / n),
        "lines": F.log1p("n_dup_lines"),
        "commons": F.sqrt((F.col("n_words") - F.col("commons")[len(VOCABULARY)]) / n),
        **{name: share(k) for name, k in place.items()},
    }


@dataclass(frozen=True)
class Quadratic:
    """Two normal densities in standardised space; None where a class has no rows."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray  # inverse Cholesky factors
    offset: float  # log prior ratio and half the difference of the log determinants
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip((x - self.centre) / self.scale, -CLIP, CLIP)
        far = [(((z - m) @ f.T) ** 2).sum(axis=1) for m, f in zip(self.means, self.factors, strict=True)]
        return 1 / (1 + np.exp(-np.clip(self.offset + (far[0] - far[1]) / 2, -LOG_ODDS, LOG_ODDS)))


def fit(rows: DataFrame, names: list[str], shrinkage: float = SHRINKAGE) -> Quadratic:
    """From rows of the named statistics and y; only sums leave the executors."""
    d = len(names)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(names)], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p_{i}_{j}") for i, j in pairs])
    got = {r["y"]: r for r in sums.collect()}  # two rows
    n = np.array([got[k]["n"] if k in got else 0 for k in (0, 1)], float)
    if not n.all():
        constant = float(n[1] / n.sum()) if n.sum() else 0.5
        return Quadratic(np.zeros(d), np.ones(d), np.zeros((2, d)), np.zeros((2, d, d)), 0.0, constant)
    first = np.array([[got[k][f"s_{i}"] for i in range(d)] for k in (0, 1)])
    second = np.zeros((2, d, d))
    for i, j in pairs:
        second[:, i, j] = second[:, j, i] = [got[k][f"p_{i}_{j}"] for k in (0, 1)]
    centre = first.sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.einsum("kii->i", second) / n.sum() - centre**2, 1e-8))
    means = (first / n[:, None] - centre) / scale
    factors, logdet = np.zeros((2, d, d)), np.zeros(2)
    for k in (0, 1):
        m = first[k] / n[k]
        cov = (second[k] / n[k] - np.outer(m, m)) / np.outer(scale, scale)
        lower = np.linalg.cholesky((1 - shrinkage) * cov + shrinkage * np.eye(d))
        factors[k], logdet[k] = np.linalg.inv(lower), 2 * np.log(np.diag(lower)).sum()
    return Quadratic(centre, scale, means, factors, float(np.log(n[1] / n[0]) - (logdet[1] - logdet[0]) / 2))


def _score(model: Quadratic, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id and score of every row of docs."""
    arrow_batches(docs.sparkSession)
    stats = document_statistics(docs)
    columns = features(stats)
    names = list(columns)
    slim = materialize(stats.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.cast("double").alias(k) for k, c in columns.items()]), "quality-features")
    model = fit(training(slim, labels, label), names)
    return slim.mapInArrow(_score(model, names), "doc_id long, score double")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
ORACLES: dict[str, str] = {}
