"""Focal filters, resampling, mosaics and rasterising on rasters in long form.

Filters are separable where they can be: one window a row, one a column, with the raster's edge repeated beyond it. All sums are expressions over a window, so a
raster is split by row and column, never gathered.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoalgrid.lineage import cut, drop

AXES = ("x", "y")


def line(axis: str):
    return Window.partitionBy("y" if axis == "x" else "x").orderBy(axis)


def at(value: str, axis: str, step: int) -> Column:
    """The value `step` cells further along a dense axis; the edge's value beyond it."""
    w = line(axis)
    if step == 0:
        return F.col(value)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = F.lead(value, step).over(w) if step > 0 else F.lag(value, -step).over(w)
    return F.coalesce(moved, F.last(value).over(whole) if step > 0 else F.first(value).over(whole))


def weighted(cells: DataFrame, value: str, axis: str, weights: list[float]) -> DataFrame:
    """value replaced by the weighted sum of the cells around it along an axis (an odd number of weights)."""
    r = len(weights) // 2
    total = sum((F.lit(float(w)) * at(value, axis, k - r) for k, w in enumerate(weights)), F.lit(0.0))
    return cells.withColumn(value, total)


def separable(cells: DataFrame, value: str, weights: list[float]) -> DataFrame:
    for axis in AXES:
        cells = weighted(cells, value, axis, weights)
    return cells


def gaussian(sigma: float, reach: float = 3.0) -> list[float]:
    r = math.ceil(reach * sigma)
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def box(radius: int) -> list[float]:
    return [1 / (2 * radius + 1)] * (2 * radius + 1)


def box_sizes(sigma: float, n: int = 3) -> list[int]:
    """Radii of n boxes whose passes come near a Gaussian."""
    ideal = math.sqrt(12 * sigma * sigma / n + 1)
    low = math.floor(ideal) - (math.floor(ideal) % 2 == 0)
    m = round((12 * sigma * sigma - n * low * low - 4 * n * low - 3 * n) / (-4 * low - 4))
    return [(low if i < m else low + 2) // 2 for i in range(n)]


def box_blur(cells: DataFrame, value: str, sigma: float) -> DataFrame:
    """Near a Gaussian by three boxes: all passes along one axis, then all along the other, which gives the same and exchanges the raster twice."""
    for axis in AXES:
        for r in box_sizes(sigma):
            cells = weighted(cells, value, axis, box(r))
    return cells


TENT = [1 / 9, 2 / 9, 3 / 9, 2 / 9, 1 / 9]


def square_max(cells: DataFrame, value: str, radius: int) -> DataFrame:
    """The largest value within a square, 0 at least."""
    for axis in AXES:
        cells = cells.withColumn(value, F.greatest(F.lit(0.0), F.max(value).over(line(axis).rowsBetween(-radius, radius))))
    return cells


def median3(cells: DataFrame, value: str) -> DataFrame:
    """x, y and the upper median of the 3 by 3 cells, fewer at the edge. Every cell goes to nine, so a group has nine rows at most."""
    around = F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    sent = cells.select(F.explode(around).alias("c"), value, ).select("c.x", "c.y", value)
    got = sent.groupBy("x", "y").agg(F.sort_array(F.collect_list(value)).alias("v"))
    return got.join(cells.select("x", "y"), ["x", "y"], "left_semi").select("x", "y", F.element_at("v", F.floor(F.size("v") / 2).cast("int") + 1).alias(value))


def gradient(value: str) -> tuple[Column, Column]:
    return tuple((at(value, a, 1) - at(value, a, -1)) / F.lit(2.0) for a in AXES)


def ridge(value: str) -> Column:
    """Minus the Laplacian."""
    return F.lit(4.0) * F.col(value) - at(value, "x", 1) - at(value, "x", -1) - at(value, "y", 1) - at(value, "y", -1)


def structure_tensor(cells: DataFrame, value: str, radius: int) -> DataFrame:
    """cells with anisotropy (0 to 1) and angle of the minor axis, from gradient products averaged over a box."""
    gx, gy = gradient(value)
    t = cells.withColumn("_gx", gx).withColumn("_gy", gy)
    t = t.withColumns({"_xx": F.col("_gx") * F.col("_gx"), "_xy": F.col("_gx") * F.col("_gy"), "_yy": F.col("_gy") * F.col("_gy")})
    for axis in AXES:  # all three along one axis before the other: one exchange an axis
        for c in ("_xx", "_xy", "_yy"):
            t = weighted(t, c, axis, box(radius))
    half, cross = (F.col("_xx") - F.col("_yy")) / 2, F.col("_xy")
    root = F.sqrt(half * half + cross * cross)
    t = t.withColumn("anisotropy", F.coalesce(F.try_divide(F.lit(2.0) * root, F.col("_xx") + F.col("_yy")), F.lit(0.0)))
    return t.withColumn("angle", F.atan2(F.lit(2.0) * cross, F.lit(2.0) * half) / 2 + F.lit(math.pi / 2)).drop("_gx", "_gy", "_xx", "_xy", "_yy")


def hillshade(gx: Column, gy: Column, azimuth: float = 315.0, elevation: float = 45.0) -> Column:
    az, el = math.radians(azimuth), math.radians(elevation)
    lx, ly, lz = math.sin(az) * math.cos(el), -math.cos(az) * math.cos(el), math.sin(el)
    return F.greatest(F.lit(0.0), (F.lit(lz) - gx * F.lit(lx) - gy * F.lit(ly)) / F.sqrt(F.lit(1.0) + gx * gx + gy * gy))


def block_average(cells: DataFrame, value: str, sx: int, sy: int) -> DataFrame:
    return cells.groupBy(F.floor(F.col("x") / sx).alias("x"), F.floor(F.col("y") / sy).alias("y")).agg(F.avg(value).alias(value))


def nearest(cells: DataFrame, value: str, n: tuple[int, int], p: tuple[int, int]) -> DataFrame:
    """A raster of n cells as one of p cells: cell i takes floor(i * n / p). n and p: (across, down). Each cell says which new ones take it."""
    out = lambda a, k: F.sequence(F.ceil(F.col(a) * p[k] / F.lit(n[k])), F.ceil((F.col(a) + 1) * p[k] / F.lit(n[k])) - 1)
    some = lambda a, k: F.ceil(F.col(a) * p[k] / F.lit(n[k])) <= F.ceil((F.col(a) + 1) * p[k] / F.lit(n[k])) - 1
    taken = cells.filter(some("x", 0) & some("y", 1)).select(out("x", 0).alias("ox"), out("y", 1).alias("oy"), value)
    return taken.select(F.explode("ox").alias("x"), "oy", value).select("x", F.explode("oy").alias("y"), value)


def bilinear(points: DataFrame, cells: DataFrame, value: str, key: str, n: tuple[int, int]) -> DataFrame:
    """key and value at points (px, py), from the four cells around each, the edge repeated. Each point meets its cells by an equi-join."""
    clamp = lambda c, k: F.least(F.greatest(c, F.lit(0)), F.lit(n[k] - 1)).cast("int")
    fx, fy = F.floor("px"), F.floor("py")
    taps = [F.struct(clamp(fx + i, 0).alias("x"), clamp(fy + j, 1).alias("y"), ((F.col("px") - fx if i else F.lit(1.0) - (F.col("px") - fx)) * (F.col("py") - fy if j else F.lit(1.0) - (F.col("py") - fy))).alias("w")) for i in (0, 1) for j in (0, 1)]
    rows = points.select(key, F.explode(F.array(*taps)).alias("t")).select(key, "t.*")
    return rows.join(cells.select("x", "y", value), ["x", "y"]).groupBy(key).agg(F.sum(F.col("w") * F.col(value)).alias(value))


def mitchell(t: float, b: float = 1 / 3, c: float = 1 / 3) -> float:
    t = abs(t)
    if t < 1:
        return ((12 - 9 * b - 6 * c) * t**3 + (-18 + 12 * b + 6 * c) * t**2 + (6 - 2 * b)) / 6
    if t < 2:
        return ((-b - 6 * c) * t**3 + (6 * b + 30 * c) * t**2 + (-12 * b - 48 * c) * t + (8 * b + 24 * c)) / 6
    return 0.0


def taps(n: int, p: int) -> list[tuple[int, int, float]]:
    """(out, source, weight) of resampling n cells to p with the cubic kernel; four cells each, edge repeated, weights summing to 1."""
    out = []
    for i in range(p):
        centre = (i + 0.5) * n / p - 0.5
        base = math.floor(centre)
        w = [(min(max(base + k, 0), n - 1), mitchell(centre - base - k)) for k in (-1, 0, 1, 2)]
        total = sum(x for _, x in w)
        out += [(i, s, x / total) for s, x in w]
    return out


def cardinal(t: float, reach: int = 20) -> float:
    """The cubic spline through 1 at 0 and 0 at all other integers. Its B-spline coefficients fall by a constant ratio."""
    ratio = math.sqrt(3) - 2
    total = 0.0
    for k in range(math.floor(t) - 1, math.floor(t) + 3):
        u = abs(t - k)
        bump = (4 - 6 * u * u + 3 * u**3) / 6 if u < 1 else max(0.0, 2 - u) ** 3 / 6
        total += math.sqrt(3) * ratio ** abs(k) * bump
    return total if abs(t) <= reach else 0.0


def spline_taps(n: int, p: int, reach: int = 20) -> list[tuple[int, int, float]]:
    """(out, source, weight) of the interpolating cubic spline, the raster mirrored at its edge cells. Beyond `reach` cells weights are below 1e-10."""
    out = []
    for i in range(p):
        centre = (i + 0.5) * n / p - 0.5
        found: dict[int, float] = {}
        for k in range(math.floor(centre) - reach, math.floor(centre) + reach + 2):
            turn = k % (2 * n - 2) if n > 1 else 0
            source = min(turn, 2 * n - 2 - turn)
            found[source] = found.get(source, 0.0) + cardinal(centre - k, reach + 1)
        total = sum(found.values())
        out += [(i, s, w / total) for s, w in sorted(found.items())]
    return out


def _mitchell(t: Column, b: float = 1 / 3, c: float = 1 / 3) -> Column:
    near = F.lit((12 - 9 * b - 6 * c) / 6) * t * t * t + F.lit((-18 + 12 * b + 6 * c) / 6) * t * t + F.lit((6 - 2 * b) / 6)
    far = F.lit((-b - 6 * c) / 6) * t * t * t + F.lit((6 * b + 30 * c) / 6) * t * t + F.lit((-12 * b - 48 * c) / 6) * t + F.lit((8 * b + 24 * c) / 6)
    return F.when(t < 1, near).when(t < 2, far).otherwise(F.lit(0.0))


def _cardinal(t: Column) -> Column:
    """cardinal() as a Column: four bumps reach a place."""
    total = F.lit(0.0)
    for k in range(-1, 3):
        at = F.floor(t) + k
        u = F.abs(t - at)
        bump = F.when(u < 1, (F.lit(4.0) - u * u * 6 + u * u * u * 3) / 6).otherwise(F.pow(F.greatest(F.lit(0.0), F.lit(2.0) - u), F.lit(3)) / 6)
        total = total + F.lit(math.sqrt(3)) * F.pow(F.lit(2 - math.sqrt(3)), F.abs(at).cast("double")) * F.when(F.abs(at) % 2 == 0, 1.0).otherwise(-1.0) * bump
    return total


def tap_table(spark: SparkSession, n: int, p: int, spline: bool = False, reach: int = 20) -> DataFrame:
    """_out, _src, _w: what taps() and spline_taps() list, made by Spark, as it has a few rows for every cell along the axis."""
    first, last = (-reach, reach + 1) if spline else (-1, 2)
    places = spark.range(p).select(F.col("id").alias("_out"), ((F.col("id") + F.lit(0.5)) * n / F.lit(float(p)) - F.lit(0.5)).alias("centre"))
    each = places.select("_out", "centre", F.explode(F.sequence(F.floor("centre") + first, F.floor("centre") + last)).alias("k"))
    if spline:
        turn = F.pmod("k", F.lit(2 * n - 2)) if n > 1 else F.lit(0)
        each = each.withColumn("_src", F.least(turn, F.lit(2 * n - 2) - turn)).withColumn("_w", _cardinal(F.col("centre") - F.col("k")))
    else:
        each = each.withColumn("_src", F.least(F.greatest("k", F.lit(0)), F.lit(n - 1))).withColumn("_w", _mitchell(F.abs(F.col("centre") - F.col("k"))))
    whole = Window.partitionBy("_out")
    return each.select("_out", F.col("_src").cast("int").alias("_src"), (F.col("_w") / F.sum("_w").over(whole)).alias("_w"))


def resample(cells: DataFrame, value: str, axis: str, n: int, p: int, spline: bool = False) -> DataFrame:
    """A raster resampled along one axis by a join with the table of taps, by the cubic kernel or the interpolating spline (the raster mirrored at its edge cells)."""
    other = "y" if axis == "x" else "x"
    rows = cells.select(F.col(axis).cast("int").alias("_src"), other, value).join(tap_table(cells.sparkSession, n, p, spline), "_src")
    return rows.groupBy(F.col("_out").alias(axis), other).agg(F.sum(F.col("_w") * F.col(value)).alias(value))


def mosaic(base: Column, layers: list[tuple[Column, Column]]) -> Column:
    """Layers over a base, lowest first: each has a value (null: none) and a weight from 0 to 1 that blends it in."""
    for value, weight in layers:
        base = F.when(value.isNull(), base).when(base.isNull(), value).otherwise(base * (F.lit(1.0) - weight) + value * weight)
    return base


def flatten_tone(cells: DataFrame, value: str, mask: str, sigma: float, target: float) -> DataFrame:
    """The masked tone brought towards a target: blur(L * m) / blur(m) is the local tone, the gain is held to 0.72 to 1.45 and softened."""
    t = cells.withColumn("_a", F.col(value) * F.col(mask)).withColumn("_b", F.col(mask).cast("double"))
    for axis in AXES:
        for c in ("_a", "_b"):
            t = weighted(t, c, axis, gaussian(sigma))
    local = F.try_divide(F.col("_a"), F.col("_b"))
    gain = F.pow(F.least(F.greatest(F.try_divide(F.lit(float(target)), local), F.lit(0.72)), F.lit(1.45)), F.lit(0.75))
    return t.withColumn(value, F.when(F.col(mask) == 1, F.col(value) * F.coalesce(gain, F.lit(1.0))).otherwise(F.col(value))).drop("_a", "_b")


def inside(px: Column, py: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd test of a point against a fixed ring, edge by edge in generated code."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 == y2:
            continue
        spans = (F.lit(float(y1)) > py) != (F.lit(float(y2)) > py)
        cross = F.lit(float(x2 - x1)) * (py - F.lit(float(y1))) / F.lit(float(y2 - y1)) + F.lit(float(x1))
        crossings = crossings + (spans & (px < cross)).cast("int")
    return crossings % 2 == 1


def segments(vertices: DataFrame, by: str, order: str) -> DataFrame:
    """Neighbouring vertices of each line: by, order, x1, y1, x2, y2."""
    w = Window.partitionBy(by).orderBy(order)
    return vertices.select(by, order, F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).filter(F.col("x2").isNotNull())


def densify(segs: DataFrame, by: str, order: str, spacing: float) -> DataFrame:
    """Points along each segment at most `spacing` apart, its first vertex included."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    n = F.greatest(F.lit(1), F.ceil(length / F.lit(float(spacing)))).cast("int")
    rows = segs.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    t = F.col("k") / F.col("n")
    return rows.select(by, order, "k", (F.col("x1") + (F.col("x2") - F.col("x1")) * t).alias("x"), (F.col("y1") + (F.col("y2") - F.col("y1")) * t).alias("y"))


def rasterise_lines(segs: DataFrame, half_width: float, weight: Column) -> DataFrame:
    """x, y and the largest weight of lines that pass within half_width of a cell's centre; only cells of a segment's box are looked at."""
    box = lambda a, b: F.sequence(F.floor(F.least(F.col(a), F.col(b)) - half_width).cast("int"), F.ceil(F.greatest(F.col(a), F.col(b)) + half_width).cast("int"))
    cells = segs.withColumn("weight", weight).select("*", F.explode(box("x1", "x2")).alias("x")).select("*", F.explode(box("y1", "y2")).alias("y"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.coalesce(F.try_divide((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    away = F.hypot(F.col("x") - F.col("x1") - t * dx, F.col("y") - F.col("y1") - t * dy)
    return cells.filter(away <= half_width).groupBy("x", "y").agg(F.max("weight").alias("weight"))


def lamps(segs: DataFrame, by: str, order: str, spacing: float, phase: float) -> DataFrame:
    """Points every `spacing` along each line from `phase` on, by the distance carried over from segment to segment."""
    w = Window.partitionBy(by).orderBy(order)
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    s = segs.withColumn("_len", length).withColumn("_end", F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_start", F.col("_end") - F.col("_len"))
    first, last = F.ceil((F.col("_start") - phase) / spacing), F.ceil((F.col("_end") - phase) / spacing) - 1
    s = s.withColumn("_a", F.greatest(first, F.lit(0))).withColumn("_b", last).filter("_b >= _a and _len > 0").select("*", F.explode(F.sequence("_a", "_b")).alias("k"))
    t = (F.lit(float(phase)) + F.col("k") * F.lit(float(spacing)) - F.col("_start")) / F.col("_len")
    return s.select(by, "k", (F.col("x1") + (F.col("x2") - F.col("x1")) * t).alias("x"), (F.col("y1") + (F.col("y2") - F.col("y1")) * t).alias("y"))


def splat(points: DataFrame, weight: str, tone: str) -> DataFrame:
    """x, y, total weight and weighted mean tone of points spread over nine cells by a Gaussian of their distance."""
    around = F.array(*[F.struct((F.floor("px") + i).alias("x"), (F.floor("py") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    rows = points.select("px", "py", weight, tone, F.explode(around).alias("c"))
    d2 = (F.col("c.x") + F.lit(0.5) - F.col("px")) ** 2 + (F.col("c.y") + F.lit(0.5) - F.col("py")) ** 2
    rows = rows.withColumn("w", F.col(weight) * F.exp(-d2 / F.lit(0.98)))
    return rows.groupBy("c.x", "c.y").agg(F.sum("w").alias("weight"), (F.sum(F.col("w") * F.col(tone)) / F.sum("w")).alias("tone"))


def nearest_distance(points: DataFrame, targets: DataFrame, key: str, first: float, last: float) -> DataFrame:
    """key and d2, the squared distance to the nearest target, of all points that have one within `last`.

    Points meet targets in squares: those with none in the squares of width `first` around them look again in squares twice as wide, and so on. What lies outside the nine squares around a point
    is further away than their width, so a distance up to that is final. Targets are thinned to distinct places first."""
    places = cut(targets.select("px", "py").distinct(), "places")
    left, found, width = cut(points.select(key, "px", "py"), "points"), None, first
    while True:
        cell = lambda c, w=width: F.floor(F.col(c) / F.lit(w))
        around = F.array(*[F.struct((cell("px") + i).alias("cx"), (cell("py") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        there = places.select(F.col("px").alias("tx"), F.col("py").alias("ty"), cell("px").alias("cx"), cell("py").alias("cy"))
        d2 = (F.col("px") - F.col("tx")) ** 2 + (F.col("py") - F.col("ty")) ** 2
        near = left.select("*", F.explode(around).alias("c")).select(key, "px", "py", "c.*").join(there, ["cx", "cy"]).groupBy(key).agg(F.min(d2).alias("d2"))
        near = cut(near.filter(F.col("d2") <= width * width), "near")
        found = near if found is None else found.unionByName(near)
        if width >= last:
            return found.filter(F.col("d2") <= last * last)
        before, left = left, cut(left.join(near, key, "left_anti"), "points")
        drop(before)
        if not left.limit(1).count():
            return found.filter(F.col("d2") <= last * last)
        width = min(2 * width, last)


def confidence(points: DataFrame, targets: DataFrame, key: str, reach: float) -> DataFrame:
    """key and exp(-(d / reach)^2) of the distance to the nearest target, 0 without any. Beyond 28 reaches a double holds nothing but 0, so no nearest target is looked for there."""
    found = nearest_distance(points, targets, key, 3.0 * reach, 28.0 * reach)
    return points.select(key).join(found, key, "left").select(key, F.coalesce(F.exp(-F.col("d2") / F.lit(float(reach * reach))), F.lit(0.0)).alias("confidence"))


def fill_nearest(cells: DataFrame, value: str) -> DataFrame:
    """x, y and value of every cell without one (null), from the nearest cell that has one, however far; ties go to the first in raster order. A raster without values stays so.

    The nearest value up and down its column is found for every cell by one pass each way; then a row's cells are compared with those columns, nearer ones first, until none can be nearer."""
    column = Window.partitionBy("x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("x").orderBy(F.col("y").desc()).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("y").alias("y"), F.col(value).cast("double").alias("v")))
    rows = cells.select("x", "y", F.last(known, True).over(column).alias("u"), F.last(known, True).over(back).alias("w"), F.col(value).isNull().alias("gap"))
    up = F.coalesce(F.col("y") - F.col("u.y") <= F.col("w.y") - F.col("y"), F.col("u.y").isNotNull())
    rows = rows.select(F.col("x").cast("int"), F.col("y").cast("int"), "gap", F.when(up, F.col("u.y")).otherwise(F.col("w.y")).cast("double").alias("sy"), F.when(up, F.col("u.v")).otherwise(F.col("w.v")).alias("sv"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, width, y = int(pdf.x.min()), int(pdf.x.max() - pdf.x.min()) + 1, int(pdf.y.iloc[0])
        sy, sv = np.full(width, np.nan), np.full(width, np.nan)
        sy[pdf.x - x0], sv[pdf.x - x0] = pdf.sy, pdf.sv
        tall = np.where(np.isnan(sy), np.inf, (sy - y) ** 2)
        gaps = pdf.x[pdf.gap].to_numpy() - x0
        best, best_y, best_v = np.full(len(gaps), np.inf), np.full(len(gaps), np.inf), np.full(len(gaps), np.nan)
        for step in range(width):
            if len(gaps) == 0 or (step * step > best).all():
                break
            for side in (-step, step) if step else (0,):
                at = gaps + side
                ok = (at >= 0) & (at < width)
                at = np.clip(at, 0, width - 1)
                d2 = np.where(ok, tall[at] + step * step, np.inf)
                # Of equal distances the upper one; in a row the left one, which comes first.
                nearer = (d2 < best) | ((d2 == best) & np.isfinite(d2) & (sy[at] < best_y))
                best, best_y, best_v = np.where(nearer, d2, best), np.where(nearer, sy[at], best_y), np.where(nearer, sv[at], best_v)
        done = np.isfinite(best)
        return pd.DataFrame({"x": gaps[done] + x0, "y": y, value: best_v[done]})

    return rows.groupBy("y").applyInPandas(fill, f"x int, y int, {value} double")
