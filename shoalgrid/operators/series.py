"""Irregular time series: as-of interpolation, neighbours, turning points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.functions import tide
from shoalgrid.lineage import cut


#: Rows of a key that one task holds in order.
SORTED = 1 << 20


def _neighbours(rows: DataFrame, by: list[str], t: str, knot: Column, own: bool, most: int) -> DataFrame:
    """rows with _before, the last knot before each row (own: or the row itself), and _after, the first one behind it. knot: a struct that begins with the time, null where a row is none; at
    one time knots come first.

    Rows are shuffled once by key and sorted, forth and back: both neighbours are the last knot so far, so a row costs the same however busy its key is. Where a key has more than `most`
    rows, keys are cut into ranges of time first, and what a range can't see, the nearest knots of the ranges on either side, comes from a table of one row for each range."""
    rows = rows.withColumn("_knot", knot)
    place = []
    if rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).limit(1).count():
        rows, place = cut(rows.repartitionByRange(*by, t).withColumn("_place", F.spark_partition_id()), "neighbours"), ["_place"]  # equal times share a range
    within, late = Window.partitionBy(*place, *by), F.col("_knot").isNull()
    forth = within.orderBy(t, late, "_knot").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    back = within.orderBy(F.col(t).desc(), late.desc(), F.col("_knot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_before", F.last("_knot", ignorenulls=True).over(forth)).withColumn("_after", F.last("_knot", ignorenulls=True).over(back))
    if not place:
        return out
    ends = rows.groupBy(*by, "_place").agg(F.min("_knot").alias("_first"), F.max("_knot").alias("_last"))
    key = Window.partitionBy(*by)
    earlier, later = (key.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("_place"), F.col("_place").desc()))
    beyond = ends.select(*[F.col(c).alias(f"_{c}_key") for c in by], F.col("_place").alias("_range"), F.last("_last", ignorenulls=True).over(earlier).alias("_earlier"), F.last("_first", ignorenulls=True).over(later).alias("_later"))
    same = [F.col("_place") == F.col("_range"), *[F.col(c).eqNullSafe(F.col(f"_{c}_key")) for c in by]]
    out = out.join(beyond, same)
    return out.withColumn("_before", F.coalesce("_before", "_earlier")).withColumn("_after", F.coalesce("_after", "_later"))


def asof_interpolate(points: DataFrame, series: DataFrame, by: list[str], t: str = "t", h: str = "h", most: int = SORTED) -> DataFrame:
    """points with h interpolated by half a cosine between the series' rows around t; null outside the series' range, whose last row still counts.

    No range join: see _neighbours. Series rows have (by, t, h), one for each time."""
    both = points.withColumn("_h", F.lit(None).cast("double")).withColumn("_p", F.lit(1)).unionByName(
        series.select(*by, F.col(t), F.col(h).cast("double").alias("_h")).withColumn("_p", F.lit(0)), allowMissingColumns=True
    )
    both = _neighbours(both, by, t, F.when(F.col("_p") == 0, F.struct(F.col(t).alias("t"), F.col("_h").alias("h"))), True, most)
    share = F.try_divide(F.col(t) - F.col("_before.t"), F.col("_after.t") - F.col("_before.t"))
    value = F.when(F.col("_before.t") == F.col(t), F.col("_before.h")).otherwise(tide.cosine_between(F.col("_before.h"), F.col("_after.h"), share))
    return both.withColumn(h, value).filter("_p = 1").select(*points.columns, h)


def leave_one_out(series: DataFrame, by: list[str], t: str, h: str, most: int = SORTED) -> DataFrame:
    """Each inner row with the value that its two neighbours give for its time."""
    out = _neighbours(series, by, t, F.struct(F.col(t).alias("t"), F.col(h).alias("h")), False, most).filter("_before is not null and _after is not null")
    share = F.try_divide(F.col(t) - F.col("_before.t"), F.col("_after.t") - F.col("_before.t"))
    return out.withColumn("estimate", tide.cosine_between(F.col("_before.h"), F.col("_after.h"), share)).select(*series.columns, "estimate")


def mid_points(series: DataFrame, by: list[str], t: str, h: str, longest: float, most: int = SORTED) -> DataFrame:
    """Time and value half way between neighbours that are at most `longest` apart."""
    out = _neighbours(series, by, t, F.struct(F.col(t).alias("t"), F.col(h).alias("h")), False, most)
    gap = F.col("_after.t") - F.col(t)
    out = out.select(*by, (F.col(t) + gap / F.lit(2.0)).alias("mid_t"), ((F.col(h) + F.col("_after.h")) / F.lit(2.0)).alias("mid_h"), gap.alias("gap"))
    return out.filter((F.col("gap") > 0) & (F.col("gap") <= longest)).drop("gap")


def error_summary(error: Column) -> list[Column]:
    return [F.avg(error).alias("bias"), F.sqrt(F.avg(error * error)).alias("rmse"), F.max(F.abs(error)).alias("max_abs"), F.avg(F.abs(error)).alias("mean_abs")]
