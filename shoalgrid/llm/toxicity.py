"""Toxicity: a factorization machine over hashed terms.

A document's terms are its words (lower case, letters only) and their first four and five letters, each hashed into
HASHES slots; a term counts once a document. The machine is fitted on a bounded sample: TRAINING_ROWS labelled documents that aren't held out, chosen by
a hash of their doc_id, so the list of them can be broadcast and no text is shuffled. Counts of every slot over the sample (a table of at most
HASHES rows) say which slots go with the label, each by itself; the machine is over those, at most TERMS of them (without that screen noise fills the pairs: the README has figures). It has a weight for each and
a vector of FACTORS numbers, whose dot products are the weights of pairs, so that an insult with a group's name can weigh more than both alone.
Every document is then scored in one pass over its whole text; the model is a few hundred KB whatever the input.

Defined cases: an empty or null text has no terms and gets the bias alone; without labels of both classes every score is the share of label 1 (0 without
labels); repeated rows are scored each for itself, and a doc_id with several labels counts as toxic if any says so; very long texts are read whole, for their distinct terms; slots whose counts tie are
taken by number; extra columns, also of clashing names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.llm.common import arrow_batches, materialize, table
from shoalgrid.llm.labels import held_out, taught

THRESHOLD = 0.5
HASHES = 1 << 18
TERMS = 4096
FACTORS = 8
#: Bound of the rows that the machine is fitted on.
TRAINING_ROWS = 20_000
MIN_DOCUMENTS = 3
MIN_CHI2 = 15.0
#: Steps of BATCH rows.
STEPS = 4000
BATCH = 256
#: Tokens whose slots a task remembers.
CACHE_TOKENS = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def slots(token: str) -> tuple[int, ...]:
    """Slots of the terms of a token, which may hold several words or none."""
    terms = {t for w in _WORD.findall(token) for t in (w, "^" + w[:4], "^" + w[:5])}
    return tuple({xxhash.xxh64_intdigest(t.encode(), 7) % HASHES for t in terms})


class Reader:
    """The slots of texts (or, with place, the rows that stand for slots), remembering up to CACHE_TOKENS tokens."""

    def __init__(self, place: dict[int, int] | None = None):
        self.place, self.known = place, {}

    def __call__(self, text: str | None) -> set[int]:
        if len(self.known) > CACHE_TOKENS:
            self.known = {}
        out: set[int] = set()
        for token in set((text or "").lower().split()):
            found = self.known.get(token)
            if found is None:
                found = slots(token)
                if self.place is not None:
                    found = tuple(self.place[s] for s in found if s in self.place)
                self.known[token] = found
            if found:
                out.update(found)
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that have a slot, summed over the task."""
    counts, read = (Counter(), Counter()), Reader()
    for batch in batches:
        for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
            counts[y].update(read(text.as_py()))
    keys = sorted(counts[0].keys() | counts[1].keys())
    for at in range(0, len(keys), 50_000):
        some = keys[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([counts[0][k] for k in some], pa.int64()), pa.array([counts[1][k] for k in some], pa.int64())], ["slot", "n0", "n1"])


def _pick(place: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(place)
        for batch in batches:
            found = [sorted(read(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), pa.array(found, pa.list_(pa.int32()))], ["h", "y", "terms"])

    return run


@dataclass
class Machine:
    """bias + sum of weights + sum over pairs of dot products; place: slot to row of the weights."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    place: dict[int, int] = field(default_factory=dict)

    def raw(self, terms: list[int]) -> float:
        if not terms:
            return self.bias
        v = self.vectors[terms]
        s = v.sum(axis=0)
        return float(self.bias + self.weights[terms].sum() + 0.5 * ((s * s).sum() - (v * v).sum()))

    def scores(self, texts: list[str | None], read: Reader) -> list[float]:
        return [float(1 / (1 + np.exp(-np.clip(self.raw(sorted(read(t))), -30, 30)))) for t in texts]


def learn(rows: list[tuple[list[int], int]], size: int, seed: int = 11, steps: int = STEPS, rate: float = 0.2, decay: float = 1e-5) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, weights, vectors) by Adagrad on the logistic loss, in batches."""
    rng = np.random.default_rng(seed)
    y = np.array([r[1] for r in rows], float)
    flat = np.array([t for r in rows for t in r[0]], np.int64)
    sizes = np.array([len(r[0]) for r in rows])
    start = np.concatenate(([0], np.cumsum(sizes)))
    bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    w, v = np.zeros(size), rng.normal(0, 0.01, (size, FACTORS))
    gb, gw, gv = 1e-6, np.full(size, 1e-6), np.full((size, FACTORS), 1e-6)
    for _ in range(-(-steps * BATCH // len(rows))):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            some = order[at : at + BATCH]
            terms = np.concatenate([flat[start[i] : start[i + 1]] for i in some])
            owner = np.repeat(np.arange(len(some)), sizes[some])
            s = np.zeros((len(some), FACTORS))
            np.add.at(s, owner, v[terms])
            squares = np.bincount(owner, (v[terms] ** 2).sum(axis=1), len(some))
            raw = bias + np.bincount(owner, w[terms], len(some)) + 0.5 * ((s * s).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[some]) / len(some)
            dw = np.bincount(terms, error[owner], size) + decay * w
            dv = np.zeros_like(v)
            np.add.at(dv, terms, error[owner, None] * (s[owner] - v[terms]))
            dv += decay * v
            db = error.sum()
            gb, gw, gv = gb + db * db, gw + dw * dw, gv + dv * dv
            bias -= rate * db / gb**0.5
            w -= rate * dw / np.sqrt(gw)
            v -= rate * 0.1 * dv / np.sqrt(gv)
    return bias, w, v


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Machine:
    """docs: doc_id and text."""
    arrow_batches(docs.sparkSession, megabytes=8)
    chosen = taught(labels, label).filter(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS).withColumnRenamed("doc_id", "_id")
    chosen = materialize(chosen, "toxicity-chosen")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).drop("_id")
    rows = materialize(rows, "toxicity-training")
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.0
        return Machine(float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))), np.zeros(0), np.zeros((0, FACTORS)))
    counts = rows.select("text", "y").mapInArrow(_count, "slot int, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    got = counts.filter(F.col("n0") + F.col("n1") >= MIN_DOCUMENTS).toPandas()  # at most HASHES rows
    a, b = got["n1"].to_numpy(float), got["n0"].to_numpy(float)
    n = n0 + n1
    chi2 = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum((a + b) * (n - a - b) * n0 * n1, 1e-9)
    best = np.lexsort((got["slot"].to_numpy(), -chi2))[:TERMS]
    best = best[chi2[best] >= MIN_CHI2]
    place = {int(s): i for i, s in enumerate(sorted(got["slot"].to_numpy()[best]))}
    picked = rows.select(F.xxhash64("doc_id").alias("h"), "y", "text").mapInArrow(_pick(place), "h long, y int, terms array<int>")
    sample = picked.orderBy("h", "y", "terms").limit(TRAINING_ROWS).collect()
    bias, w, v = learn([(list(r["terms"]), r["y"]) for r in sample], max(1, len(place)))
    return Machine(bias, w, v, place)


def _score(model: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(model.place)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(batch.column("text").to_pylist(), read), pa.float64())], ["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id and score of every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_score(fit(rows, labels, label)), "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
