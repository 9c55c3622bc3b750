"""Harmonic regression: sums on the executors, a small solve on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalgrid.functions import tide
from shoalgrid.shipping import ship

#: Constituents whose amplitude is below this (m) are left out on a second fit.
PRUNE = 0.005
#: Start times whose turning points are searched at a time.
SLICE = 256


def _basis(speeds: list[float], t: str):
    return [F.lit(1.0), *[f(F.lit(s) * F.col(t)) for s in speeds for f in (F.cos, F.sin)]]


def normal_equations(rows: DataFrame, speeds: list[float], t: str, h: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(A'A, A'b, n) of the basis 1, cos, sin: one aggregate row, whatever the input."""
    k = 2 * len(speeds) + 1
    named = rows.select(F.col(h).alias("_h"), F.array(*_basis(speeds, t)).alias("_b"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = named.agg(
        F.array(*[F.sum(F.col("_b")[i] * F.col("_b")[j]) for i, j in pairs]).alias("a"), F.array(*[F.sum(F.col("_b")[i] * F.col("_h")) for i in range(k)]).alias("r"), F.count(F.lit(1)).alias("n")
    ).first()
    a = np.zeros((k, k))
    for (i, j), v in zip(pairs, got["a"], strict=True):
        a[i, j] = a[j, i] = v or 0.0
    return a, np.array([v or 0.0 for v in got["r"]]), got["n"]


def fit(rows: DataFrame, speeds: dict[str, float], t: str = "t", h: str = "h", ridge: float = 0.0) -> tuple[float, dict[str, tuple[float, float]]]:
    """(mean level, {name: (amplitude, phase)}) by least squares; ridge adds to the diagonal."""
    a, r, _ = normal_equations(rows, list(speeds.values()), t, h)
    x = np.linalg.solve(a + ridge * np.eye(len(a)), r)
    return float(x[0]), {name: (math.hypot(x[2 * k + 1], x[2 * k + 2]), math.atan2(x[2 * k + 2], x[2 * k + 1])) for k, name in enumerate(speeds)}


def fit_pruned(rows: DataFrame, speeds: dict[str, float], least: float = PRUNE, **how) -> tuple[float, dict[str, tuple[float, float]]]:
    """fit(), then again without the constituents that came out small."""
    _, first = fit(rows, speeds, **how)
    return fit(rows, {n: s for n, s in speeds.items() if first[n][0] >= least}, **how)


def predicted(mean: float, found: dict[str, tuple[float, float]], speeds: dict[str, float], t: str = "t"):
    out = F.lit(mean)
    for name, (amplitude, phase) in found.items():
        out = out + F.lit(amplitude) * F.cos(F.lit(speeds[name]) * F.col(t) - F.lit(phase))
    return out


def slope_at(hours: np.ndarray) -> np.ndarray:
    """The model's slope (m an hour) in numpy, for root finding."""
    hours = np.asarray(hours, float)
    n = (125.04452 - 1934.136261 / 36525 * (8400.5 + hours / 24)) * math.pi / 180
    out = np.zeros_like(hours)
    for name, speed, amplitude, phase in tide.CONSTITUENTS:
        size, angle = np.full_like(hours, amplitude), speed * hours - phase
        for basic, power, times in tide.NODAL_OF.get(name, ()):
            factors, phases = tide.NODAL[basic]
            size = size * sum(c * np.cos(k * n) for k, c in enumerate(factors)) ** power
            angle = angle - times * sum((c * np.sin(k * n) for k, c in enumerate(phases, 1)), np.zeros_like(hours)) * math.pi / 180
        out -= size * speed * np.sin(angle)
    return out


def turning_points(starts: DataFrame, key: str, t: str, hours: float, step: float = 1 / 30, halvings: int = 40) -> DataFrame:
    """key, kind (high, low) and at (hours) of the turning points within `hours` after t: a two-minute scan, then bisection. Start times that are equal in a
    batch are searched once, SLICE of them at a time, so memory doesn't depend on the batch."""

    def found(grid):
        s = slope_at(grid.ravel()).reshape(grid.shape)
        row, col = np.nonzero(((s[:, :-1] > 0) & (s[:, 1:] <= 0)) | ((s[:, :-1] < 0) & (s[:, 1:] >= 0)))
        lo, hi, rising = grid[row, col], grid[row, col + 1], s[row, col] > 0
        for _ in range(halvings):
            mid = (lo + hi) / 2
            same = (slope_at(mid) > 0) == rising
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid)
        return row, np.where(rising, "high", "low"), (lo + hi) / 2

    def run(batches):
        import pandas as pd

        after = np.arange(0, hours + step / 2, step)
        for pdf in batches:
            starts, which = np.unique(pdf[t].to_numpy(), return_inverse=True)
            for k in range(0, len(starts), SLICE):
                row, kind, at = found(starts[k : k + SLICE, None] + after[None, :])
                points = pd.DataFrame({"_start": row + k, "kind": kind, "at": at})
                yield pd.DataFrame({key: pdf[key].to_numpy(), "_start": which}).merge(points, on="_start")[[key, "kind", "at"]]

    ship(starts.sparkSession)
    return starts.select(F.col(key).cast("long").alias(key), F.col(t).cast("double").alias(t)).mapInPandas(run, f"{key} long, kind string, at double")
