"""Monotone step fits: a pixel is dry below a cut in tide order and wet from it on.

Observations are rows (pixel, p, v, w): p is the scene's rank by tide from 0, v whether the pixel was seen, w whether it was wet (w <= v). The fit with the
fewest errors, and the fit that leaves one observation out, come from one error curve a pixel: prefix and suffix minima in place of refits.

A pixel's observations are packed into one array (one shuffle, and none where the stack comes packed: with codes in place of p, v and w); all curves of a batch are then one matrix, and every step is a pass over it. So the work is
in proportion to the observations, however many scenes there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalgrid.shipping import ship

SUBTIDAL, NODATA, INTERTIDAL, SUPRATIDAL = 0, 64, 128, 255
LEAST_VALID = 10
#: Entries of a matrix that is worked on at once.
ENTRIES = 1 << 21


def packed(obs: DataFrame, by: tuple[str, ...] = ("pixel",)) -> DataFrame:
    """by and codes: 4 p + 2 v + w of every observation, in the order of p. Observations that come packed stay as they are."""
    if "codes" in obs.columns:
        return obs.select(*dict.fromkeys([*by, "codes"]))
    code = (F.col("p") * 4 + F.col("v") * 2 + F.col("w")).cast("int")
    return obs.select(*by, code.alias("code")).groupBy(*by).agg(F.sort_array(F.collect_list("code")).alias("codes"))


def unpacked(rows: DataFrame, *keep: str) -> DataFrame:
    """keep, p, v and w: a row for each observation."""
    code = F.col("_code")
    p, v, w = F.shiftright(code, 2), F.shiftright(code, 1).bitwiseAND(F.lit(1)), code.bitwiseAND(F.lit(1))
    return rows.select(*keep, F.explode("codes").alias("_code")).select(*keep, p.alias("p"), v.alias("v"), w.alias("w"))


class _Curves:
    """Of some pixels: seen and wet (pixels, n), and err (pixels, n + 1), the errors of a cut at each place. Scenes without an observation count as not seen."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, n: int):
        self.row, self.p = np.repeat(np.arange(len(sizes)), sizes), codes >> 2
        self.v, self.w = (codes >> 1) & 1, codes & 1
        self.seen, self.wet = np.zeros((len(sizes), n), np.int32), np.zeros((len(sizes), n), np.int32)
        self.seen[self.row, self.p], self.wet[self.row, self.p] = self.v, self.w
        self._curve()

    def _curve(self) -> None:
        self.valid = self.seen.sum(axis=1)
        self.err = np.zeros((self.seen.shape[0], self.seen.shape[1] + 1), np.int32)
        np.cumsum(2 * self.wet - self.seen, axis=1, out=self.err[:, 1:])
        self.err += (self.valid - self.wet.sum(axis=1))[:, None]

    def reordered(self, rows: np.ndarray, scenes: list[int]) -> "_Curves":
        """The curves of some pixels with some scenes in another order; entries are what was seen."""
        out = object.__new__(_Curves)
        out.seen, out.wet = self.seen[np.ix_(rows, scenes)], self.wet[np.ix_(rows, scenes)]
        out.row, out.p = np.nonzero(out.seen)
        out.v, out.w = np.ones(len(out.p), np.int64), out.wet[out.row, out.p].astype(np.int64)
        out._curve()
        return out

    def held_out(self) -> np.ndarray:
        """The cut that all other observations of the pixel give, for each observation."""
        width = self.err.shape[1]
        place = np.arange(width, dtype=np.int64)
        up, down = self.err.astype(np.int64) * width + place, self.err.astype(np.int64) * width + (width - 1 - place)
        before = np.minimum.accumulate(up, axis=1), np.minimum.accumulate(down, axis=1)
        after = [np.minimum.accumulate(m[:, ::-1], axis=1)[:, ::-1] for m in (up, down)]
        a, a_back, b, b_back = before[0][self.row, self.p], before[1][self.row, self.p], after[0][self.row, self.p + 1], after[1][self.row, self.p + 1]
        left, right = a // width - self.v * (1 - self.w), b // width - self.v * self.w
        # First and last place of the least error on either side; a tie spans both.
        lo = np.where(left <= right, a % width, b % width)
        hi = np.where(right <= left, width - 1 - b_back % width, width - 1 - a_back % width)
        return (lo + hi) // 2

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """(half way between the first and last best cut, its errors) of each pixel."""
        least = self.err.min(axis=1)
        at = self.err == least[:, None]
        return (at.argmax(axis=1) + self.err.shape[1] - 1 - at[:, ::-1].argmax(axis=1)) // 2, least


def _each(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, _Curves]]:
    for batch in batches:
        rows = max(1, ENTRIES // (n + 1))
        for at in range(0, batch.num_rows, rows):
            some = batch.slice(at, rows)
            lists = some.column("codes")
            yield some, _Curves(lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), n)


def _schema(obs: DataFrame, by: tuple[str, ...], **more: str) -> T.StructType:
    kinds = {"int": T.IntegerType(), "long": T.LongType()}
    return T.StructType([*[obs.schema[c] for c in by], *[T.StructField(c, kinds[k]) for c, k in more.items()]])


def fit(obs: DataFrame, n: int, by: tuple[str, ...] = ("pixel",)) -> DataFrame:
    """by, k (half way between the first and last best cut), misfit and valid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, curves in _each(batches, n):
            k, least = curves.best()
            numbers = [pa.array(k, pa.int32()), pa.array(least, pa.int64()), pa.array(curves.valid, pa.int64())]
            yield pa.RecordBatch.from_arrays([*[some.column(c) for c in by], *numbers], [*by, "k", "misfit", "valid"])

    ship(obs.sparkSession)
    return packed(obs, by).mapInArrow(run, _schema(obs, by, k="int", misfit="long", valid="long"))


def leave_one_out(obs: DataFrame, n: int, by: tuple[str, ...] = ("pixel",)) -> DataFrame:
    """by, p, v, w, k and wet: the cut that all other observations of the pixel give, and what it says of this one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, curves in _each(batches, n):
            k = curves.held_out()
            numbers = [curves.p, curves.v, curves.w, k, curves.p >= k]
            rows = pa.array(curves.row)
            yield pa.RecordBatch.from_arrays([*[some.column(c).take(rows) for c in by], *[pa.array(x.astype(np.int32)) for x in numbers]], [*by, "p", "v", "w", "k", "wet"])

    ship(obs.sparkSession)
    return packed(obs, by).mapInArrow(run, _schema(obs, by, p="int", v="int", w="int", k="int", wet="int"))


def held_out_confusion(obs: DataFrame, n: int, by: tuple[str, ...] = ("pixel",), keep: tuple[str, ...] = ()) -> DataFrame:
    """keep (of by), p, tp, fp, fn and tn over the observations that were seen, each predicted by the others of its pixel. Counted within a batch first: what leaves it is a row a scene and
    combination of keep, not a row an observation."""
    names = ("tp", "fp", "fn", "tn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, curves in _each(batches, n):
            said = curves.p >= curves.held_out()
            group, groups, columns = np.zeros(some.num_rows, np.int64), 1, []
            if keep:
                code = np.zeros(some.num_rows, np.int64)
                for c in keep:  # combinations as one number: no more of them than rows in the batch
                    one = some.column(c).dictionary_encode()
                    code = code * len(one.dictionary) + one.indices.to_numpy(zero_copy_only=False)
                    code = np.unique(code, return_inverse=True)[1]
                _, first, group = np.unique(code, return_index=True, return_inverse=True)
                groups, columns = len(first), [some.column(c).take(pa.array(first)) for c in keep]
            at = (group[curves.row] * n + curves.p) * 4 + np.where(said, 1 - curves.w, 3 - curves.w)
            counts = np.bincount(at[curves.v == 1], minlength=groups * n * 4).reshape(groups * n, 4)
            index = pa.array(np.repeat(np.arange(groups), n))
            yield pa.RecordBatch.from_arrays([*[c.take(index) for c in columns], pa.array(np.tile(np.arange(n, dtype=np.int32), groups)), *[pa.array(counts[:, i]) for i in range(4)]], [*keep, "p", *names])

    ship(obs.sparkSession)
    parts = packed(obs, by).mapInArrow(run, _schema(obs, keep, p="int", **dict.fromkeys(names, "long")))
    return parts.groupBy(*keep, "p").agg(*[F.sum(c).alias(c) for c in names])


def held_out_orders(obs: DataFrame, n: int, group: str, orders: dict[int, list[int]], of_group: dict[int, list[int]], by: tuple[str, ...] = ("pixel",)) -> DataFrame:
    """group, order, scene, tp, fp, fn and tn of every order of scenes that a pixel's group is fitted in. obs: by, group (a whole number), p (the scene), v, w; orders: some or all scenes in turn.

    A pixel's observations are packed once and put in each order in memory, so a grid of parameters costs no more shuffling than one fit. Orders are a table of parameters, not of data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for some, curves in _each(batches, n):
            groups = some.column(group).to_numpy(zero_copy_only=False)
            for g in np.unique(groups).tolist():
                rows = np.flatnonzero(groups == g)
                for o in of_group.get(g, ()):
                    mine = curves.reordered(rows, orders[o])
                    said = mine.p >= mine.held_out()
                    counts = np.bincount(mine.p * 4 + np.where(said, 1 - mine.w, 3 - mine.w), minlength=4 * len(orders[o])).reshape(-1, 4)
                    totals[g, o] = totals.get((g, o), 0) + counts
        for (g, o), counts in totals.items():
            m = len(orders[o])
            fixed = [pa.array(np.full(m, g, np.int32)), pa.array(np.full(m, o, np.int32)), pa.array(np.array(orders[o], np.int32))]
            yield pa.RecordBatch.from_arrays([*fixed, *[pa.array(counts[:, i].astype(np.int64)) for i in range(4)]], [group, "order", "scene", "tp", "fp", "fn", "tn"])

    ship(obs.sparkSession)
    rows = packed(obs.withColumn(group, F.col(group).cast("int")), (*by, group))
    names = ("tp", "fp", "fn", "tn")
    parts = rows.mapInArrow(run, f"{group} int, `order` int, scene int, " + ", ".join(f"{c} long" for c in names))
    return parts.groupBy(group, "order", "scene").agg(*[F.sum(c).alias(c) for c in names])


def classify(fits: DataFrame, tides: DataFrame, n: int) -> DataFrame:
    """fits with cls and height: half way between the tides on both sides of the cut. tides: p and tide, one row for each of the n scenes, which become one array value."""
    levels = tides.agg(F.array_sort(F.collect_list(F.struct("p", "tide"))).alias("steps")).select(F.col("steps.tide").alias("_levels"))
    joined = fits.withColumn("_levels", levels.scalar()).withColumns({"_lo": F.get("_levels", F.col("k") - 1), "_hi": F.get("_levels", F.col("k"))}).drop("_levels")
    cls = F.when(F.col("valid") < LEAST_VALID, NODATA).when(F.col("k") == 0, SUBTIDAL).when(F.col("k") == n, SUPRATIDAL).otherwise(INTERTIDAL)
    return joined.withColumn("cls", cls).withColumn("height", F.when(F.col("cls") == INTERTIDAL, (F.col("_lo") + F.col("_hi")) / F.lit(2.0))).drop("_lo", "_hi")


def wet_at(tide: Column) -> Column:
    """Whether a classified pixel is under water at a tide."""
    return (F.col("cls") == SUBTIDAL) | ((F.col("cls") == INTERTIDAL) & (F.col("height") <= tide))


def confusion(rows: DataFrame, by: list[str], predicted: Column) -> DataFrame:
    """tp, fp, fn and tn over the rows that were seen."""
    count = lambda c: F.sum((c & (F.col("v") == 1)).cast("int")).alias
    wet, said = F.col("w") == 1, predicted
    return rows.groupBy(*by).agg(count(said & wet)("tp"), count(said & ~wet)("fp"), count(~said & wet)("fn"), count(~said & ~wet)("tn"))


def overlap() -> Column:
    """Intersection over union of water; 1 where neither has any."""
    return F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp") + F.col("fn")), F.lit(1.0))


def land_overlap() -> Column:
    return F.try_divide(F.col("tn").cast("double"), F.col("tn") + F.col("fp") + F.col("fn"))


def agreement() -> Column:
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return F.coalesce(F.try_divide(F.lit(100.0) * (F.col("tp") + F.col("tn")), total), F.lit(100.0))
