"""Queries on seams, contours, transects, differences and spline resampling, on the raster of plans.raster."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalgrid.operators import focal, seams
from shoalgrid.plans.raster import _A, _HEIGHT, _cells, _height, _sql_at, _sql_separable, _sql_spline
from shoalgrid.session import table


def seam_blend(spark, d):
    c = _cells(spark, d).withColumn("e", F.lit(30.0) - F.col("v")).withColumn("old", (F.col("v") * 7) % 256)
    return seams.seam_blend(c, "e", "old", 1.5).select("x", "y", "code")


def _slopes():
    return [focal.at("v", a, 1) - F.col("v") for a in focal.AXES]


def contour_lines(spark, d):
    gx, gy = _slopes()
    return _cells(spark, d).select("x", "y", F.round(seams.contour(F.col("v"), gx, gy, 7.5), 6).alias("line"), F.round(seams.waterline(F.col("v"), F.lit(22.0), gx, gy), 6).alias("edge"))


def transect(spark, d):
    """Lines spread over all rows; some ends lie beyond the raster."""
    height = _height(spark, d)
    s = F.col("s_suppkey")
    ends = {"x0": s % 50, "y0": s * 7 % (height + 1), "x1": s * 3 % 53, "y1": s * 11 % max(1, height - 3)}
    lines = table(spark, d, "supplier").select("s_suppkey", *[c.cast("double").alias(k) for k, c in ends.items()])
    return seams.transect(lines, _cells(spark, d), "v", "s_suppkey", 17, (50, height))


def image_difference(spark, d):
    c = _cells(spark, d)
    found = seams.changed(c, c.withColumn("v", (F.col("v") * 13 + F.col("x")) % 51), "v", 6)
    return found.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("difference"), 6).alias("mean"), F.round(F.stddev_pop("difference"), 6).alias("deviation"))


def shoal_skirt(spark, d):
    return seams.skirt(_cells(spark, d), F.col("v") > 48, 2, 1.5).select("x", "y", F.round("skirt", 6).alias("skirt"))


def spline_resample(spark, d):
    """Smoothed a little, then the cubic spline through the cells, across and down."""
    height = _height(spark, d)
    c = focal.separable(_cells(spark, d).select("x", "y", "v"), "v", focal.gaussian(0.75))
    return focal.resample(focal.resample(c, "v", "x", 50, 80, True), "v", "y", height, height * 33 // 20, True).select("x", "y", F.round("v", 6).alias("v"))


# --- SQL ---------------------------------------------------------------------------------------------------------------

_SLOPES = f"g as (select x, y, v, greatest(abs({_sql_at('x', 1)} - v) + abs({_sql_at('y', 1)} - v), 0.0008::double) s from a)"
_BYTE = lambda x: f"least(greatest(floor({x} + 0.5::double), 0), 255)"


def _sql_skirt():
    out = "q"
    for r in focal.box_sizes(1.5):
        out = _sql_separable(out, focal.box(r))
    return f"with {_A}, q as (select a.x, a.y, max(case when n.v > 48 then 1.0::double else 0.0::double end) v from a join a n on abs(n.x - a.x) <= 2 and abs(n.y - a.y) <= 2 group by 1, 2) select x, y, round(v, 6) skirt from {out}"


ORACLES = {
    "seam_blend": f"""with {_A}, e as (select x, y, 30 - v e, (v * 7) % 256 o from a), w as (select *, case when e < -0.05 then 1.0::double else 0.0::double end v, least(greatest((-e - 15) / 25, 0), 1) t from e),
c as (select *, case when e >= -0.05 then 0 else {_BYTE('255.0::double * case when -e < 15 then 0.5::double * pow(-e / 15, 0.6::double) else 0.5::double + 0.5::double * (t * t * (3 - 2 * t)) end')} end code from w),
b as {_sql_separable('c', focal.gaussian(1.5))} select x, y, cast({_BYTE('v * code + (1 - v) * o')} as int) code from b""",
    "contour_lines": f"with {_A}, {_SLOPES} select x, y, round(1 - least(greatest((0.5 - abs(v / 7.5::double - floor(v / 7.5::double) - 0.5)) / (s / 7.5::double * 1.1::double), 0), 1), 6) line, round(1 - least(greatest(abs(v - 22) / (s * 2.2::double), 0), 1), 6) edge from g",
    "transect": f"with {_A}, n as (select {_HEIGHT} n), l as (select s_suppkey, n, (s_suppkey % 50)::double x0, (s_suppkey * 7 % (n + 1))::double y0, (s_suppkey * 3 % 53)::double x1, (s_suppkey * 11 % greatest(1, n - 3))::double y1 from supplier, n), p as (select s_suppkey, cast(k as int) k, least(greatest(floor(x0 + (x1 - x0) * (k / 16.0::double)), 0), 49) px, least(greatest(floor(y0 + (y1 - y0) * (k / 16.0::double)), 0), n - 1) py from l, range(17) r(k)) select s_suppkey, k, v from p join a on a.x = px and a.y = py",
    "image_difference": f"with {_A}, c as (select y, abs(v - (v * 13 + x) % 51) c from a) select y, count(*) n, round(avg(c), 6) mean, round(stddev_pop(c), 6) deviation from c where c > 6 group by 1",
    "shoal_skirt": _sql_skirt(),
    "spline_resample": f"with {_A}, f as (select x, y, v from a), s as {_sql_separable('f', focal.gaussian(0.75))}, {_sql_spline('tx', '50', '80')}, {_sql_spline('ty', _HEIGHT, f'{_HEIGHT} * 33 // 20')}, h as (select tx.o x, s.y, sum(w * v) v from s join tx on s.x = tx.s group by 1, 2) select x, cast(ty.o as bigint) y, round(sum(w * v), 6) v from h join ty on h.y = ty.s group by 1, 2",
}
QUERIES = {name: globals()[name] for name in ORACLES}
