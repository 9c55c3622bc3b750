"""Depth codes and their seams, waterline contours, transects and differences of rasters in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalgrid.functions.scalars import clamp, depth_shade, half_up
from shoalgrid.operators.focal import box, box_sizes, gaussian, separable, square_max

#: Fixed value: the elevation below which a cell is surely wet.
WET = -0.05


def byte(x: Column) -> Column:
    return clamp(half_up(x), 0, 255).cast("int")


def seam_blend(cells: DataFrame, elevation: str, other: str, sigma: float) -> DataFrame:
    """cells with code: the depth code where the elevation is surely wet, another source's byte elsewhere, blended over a blurred seam."""
    wet = F.col(elevation) < WET
    t = cells.withColumn("_alpha", F.when(wet, F.lit(1.0)).otherwise(F.lit(0.0)))
    t = t.withColumn("_code", F.when(wet, byte(depth_shade(-F.col(elevation)) * F.lit(255.0))).otherwise(F.lit(0)))
    t = separable(t, "_alpha", gaussian(sigma))
    return t.withColumn("code", byte(F.col("_alpha") * F.col("_code") + (F.lit(1.0) - F.col("_alpha")) * F.col(other))).drop("_alpha", "_code")


def contour(height: Column, gx: Column, gy: Column, spacing: float, least_slope: float = 0.0008) -> Column:
    """How much of an iso-contour a cell shows (0 to 1): contours lie at multiples of the spacing and are about a cell wide whatever the slope."""
    slope = F.greatest(F.abs(gx) + F.abs(gy), F.lit(least_slope))
    c = height / F.lit(spacing)
    away = F.lit(0.5) - F.abs(c - F.floor(c) - F.lit(0.5))
    return F.lit(1.0) - clamp(away / (slope / F.lit(spacing) * F.lit(1.1)), 0, 1)


def waterline(height: Column, tide: Column, gx: Column, gy: Column, least_slope: float = 0.0008) -> Column:
    """How much of the present waterline a cell shows (0 to 1)."""
    return F.lit(1.0) - clamp(F.abs(height - tide) / (F.greatest(F.abs(gx) + F.abs(gy), F.lit(least_slope)) * F.lit(2.2)), 0, 1)


def transect(lines: DataFrame, cells: DataFrame, value: str, by: str, n: int, size: tuple[int, int]) -> DataFrame:
    """by, k and the value at n points from (x0, y0) to (x1, y1) of each line, both ends included; points beyond the raster take its edge cell."""
    points = lines.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    place = lambda a, m: F.least(F.greatest(F.floor(F.col(f"{a}0") + (F.col(f"{a}1") - F.col(f"{a}0")) * (F.col("k") / F.lit(float(n - 1)))), F.lit(0)), F.lit(m - 1)).cast("int")
    points = points.select(by, "k", place("x", size[0]).alias("x"), place("y", size[1]).alias("y"))
    return points.join(cells.select("x", "y", value), ["x", "y"]).select(by, "k", value)


def changed(before: DataFrame, after: DataFrame, value: str, threshold: float) -> DataFrame:
    """x, y and difference of the cells that differ by more than the threshold."""
    both = before.select("x", "y", F.col(value).alias("_a")).join(after.select("x", "y", F.col(value).alias("_b")), ["x", "y"])
    return both.select("x", "y", F.abs(F.col("_a") - F.col("_b")).alias("difference")).filter(F.col("difference") > threshold)


def skirt(cells: DataFrame, shoal: Column, radius: int, sigma: float) -> DataFrame:
    """cells with skirt (0 to 1): shoals spread by a square and softened by three boxes."""
    t = square_max(cells.withColumn("skirt", F.when(shoal, F.lit(1.0)).otherwise(F.lit(0.0))), "skirt", radius)
    for r in box_sizes(sigma):
        t = separable(t, "skirt", box(r))
    return t
