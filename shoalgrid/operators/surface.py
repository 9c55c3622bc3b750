"""Resampling that heeds missing values, choosing between sheets, fusing and grading images, gates and masks, on rasters in long form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.functions import scalars
from shoalgrid.operators import focal, scenes


def average_onto(cells: DataFrame, value: str, x: Column, y: Column) -> DataFrame:
    """x, y, value and cover of a coarser grid whose cell each source cell falls into: the mean of what is there, and the share of source cells that have a value (null: none)."""
    there = F.col(value).isNotNull().cast("double")
    sums = cells.groupBy(x.alias("x"), y.alias("y")).agg(F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("_s"), F.sum(there).alias("_m"), F.avg(there).alias("cover"))
    return sums.select("x", "y", F.try_divide("_s", "_m").alias(value), "cover")


def best_covered(sheets: DataFrame, value: str, order: str, least: float) -> DataFrame:
    """x, y, value, cover and order of the sheet that covers a cell best (the first in order on ties), where that is enough. sheets: x, y, value, cover, order."""
    best = F.max_by(F.struct(value, "cover", order), F.struct(F.col("cover"), -F.col(order)))
    return sheets.filter(F.col(value).isNotNull()).groupBy("x", "y").agg(best.alias("b")).select("x", "y", "b.*").filter(F.col("cover") >= least)


def equirect_points(rows: DataFrame, size: tuple[int, int], source: tuple[int, int], box: tuple[float, float, float, float] = scalars.BOX) -> DataFrame:
    """rows (x, y of an equirectangular raster of that size) with px, py: where each cell's centre lies in a Mercator raster of the same box, in its cells."""
    top, bottom = (float(_mercator(lat)) for lat in (box[3], box[1]))
    px = (F.col("x") + F.lit(0.5)) / size[0] * source[0] - F.lit(0.5)
    py = (scalars.mercator(scalars.lat_of(F.col("y"), size[1], box)) - F.lit(top)) / F.lit(bottom - top) * source[1] - F.lit(0.5)
    return rows.select("*", scalars.clamp(px, 0, source[0] - 1).alias("px"), scalars.clamp(py, 0, source[1] - 1).alias("py"))


def _mercator(lat: float) -> float:
    return (1 - math.log(math.tan(math.pi / 4 + lat * math.pi / 360)) / math.pi) / 2


def rotated(cells: DataFrame, degrees: float, size: tuple[float, float], aspect: float = 4 / 3) -> DataFrame:
    """cells with u, v (places in the raster turned about its middle), of the largest upright frame of that aspect that lies within the turned raster."""
    a = math.radians(degrees)
    c, s = math.cos(a), math.sin(a)
    dx, dy = F.col("x") + F.lit(0.5) - F.lit(size[0] / 2), F.col("y") + F.lit(0.5) - F.lit(size[1] / 2)
    # A frame of half height h fits if its corners, turned back, stay within both half sides.
    h = min(size[0] / 2 / (aspect * abs(c) + abs(s)), size[1] / 2 / (aspect * abs(s) + abs(c)))
    out = cells.withColumns({"u": dx * F.lit(c) - dy * F.lit(s), "v": dx * F.lit(s) + dy * F.lit(c)})
    return out.filter((F.abs("u") <= h * aspect) & (F.abs("v") <= h))


def fused(cells: DataFrame, sharp: str, colours: tuple[str, str, str], sigma: float, wide: float, gain: float = 0.85, most: float = 46.0, ratio: tuple[float, float] = (0.55, 1.9)) -> DataFrame:
    """cells with r, g, b: colours of one image, relit to another's brightness around (a ratio of wide blurs, held within bounds) and given its detail (what a blur takes from it, held too)."""
    own = scalars.luminance(*[F.col(c) for c in colours])
    t = cells.withColumns({"_own": own, "_near": F.col(sharp).cast("double"), "_far": F.col(sharp).cast("double"), "_wide": own})
    for axis in focal.AXES:
        for column, s in (("_near", sigma), ("_far", wide), ("_wide", wide)):
            t = focal.weighted(t, column, axis, focal.gaussian(s))
    relit = F.col("_own") * F.least(F.greatest(F.col("_far") / F.greatest(F.col("_wide"), F.lit(4.0)), F.lit(ratio[0])), F.lit(ratio[1]))
    lum = relit + F.lit(gain) * scalars.clamp(F.col(sharp) - F.col("_near"), -most, most)
    byte = lambda c: scalars.half_up(scalars.clamp(lum + F.col(c) - F.col("_own"), 0, 255)).cast("int")
    return t.select("x", "y", *[byte(c).alias(n) for c, n in zip(colours, "rgb", strict=True)])


def levels(cells: DataFrame, columns: str, share: float) -> dict[str, float]:
    """The value of each column at rank round(share * (n - 1)); no entries for an empty table."""
    each = cells.select(F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).cast("double").alias("v")) for c in columns])).alias("c")).select("c.*")
    return {r["of"]: r["v"] for r in scenes.at_rank(each, ["of"], "v", F.floor(F.lit(share) * (F.col("n") - 1) + F.lit(0.5))).collect()}


def graded(cells: DataFrame, land: Column, haze: float = 0.55, floor: float = 6.0, white: float = 0.995, power: float = 0.88, vibrance: float = 0.35, bias: tuple[int, int, int] = (5, 4, -6)) -> DataFrame:
    """x, y, r, g, b: part of the black point taken away and stretched to the white point, a power curve either side of the middle, more colour where there is little, and a bias on land."""
    curved, dark, bright = [], levels(cells, "rgb", 0.01), levels(cells, "rgb", white)
    if not dark:
        return cells.select("x", "y", *[F.col(k).cast("int") for k in "rgb"])
    for c in "rgb":
        low = min(floor, dark[c] * haze)
        t = scalars.clamp((F.col(c) - F.lit(low)) / F.lit(max(1.0, bright[c] - low)), 0, 1)
        curved.append(F.when(t < 0.5, F.lit(0.5) * F.pow(t * 2, F.lit(power))).otherwise(F.lit(1.0) - F.lit(0.5) * F.pow((F.lit(1.0) - t) * 2, F.lit(power))) * 255)
    t = cells.select("x", "y", land.cast("double").alias("_m"), *[c.alias(f"_{n}") for c, n in zip(curved, "rgb", strict=True)])
    mean = (F.col("_r") + F.col("_g") + F.col("_b")) / F.lit(3.0)
    boost = F.lit(1.0) + F.lit(vibrance) * (F.lit(1.0) - scalars.clamp((F.greatest("_r", "_g", "_b") - mean) * 2 / 255, 0, 1))
    return t.select("x", "y", *[scalars.half_up(scalars.clamp(scalars.clamp(mean + (F.col(f"_{n}") - mean) * boost, 0, 255) + F.lit(float(k)) * F.col("_m"), 0, 255)).cast("int").alias(n) for n, k in zip("rgb", bias, strict=True)])


def soft_blend(cells: DataFrame, front: str, back: str, mask: str, sigma: float) -> DataFrame:
    """x, y, value: front over back where the mask (0 or 1), blurred, says so."""
    t = focal.separable(cells.withColumn("_a", F.col(mask).cast("double")), "_a", focal.gaussian(sigma))
    return t.select("x", "y", (F.col(front) * F.col("_a") + F.col(back) * (F.lit(1.0) - F.col("_a"))).alias("value"))


def ridge_gate(cells: DataFrame, value: str, sigma: float, water: Column, sampled: Column, band: tuple[float, float]) -> DataFrame:
    """x, y, gate: how much a cell lies on a ridge, its curvature against the 85th percentile of the sampled water cells that curve so."""
    t = focal.separable(cells.withColumn("_smooth", F.col(value)), "_smooth", focal.gaussian(sigma)).withColumn("_ridge", focal.ridge("_smooth"))
    some = t.filter(water & sampled & (F.col("_ridge") > 0)).select(F.lit(1).alias("one"), "_ridge")
    found = scenes.at_rank(some, ["one"], "_ridge", F.floor(F.col("n") * F.lit(0.85))).first()
    return t.select("x", "y", scalars.smoothstep(*band, F.col("_ridge") / F.lit(found["_ridge"] if found else 1e-6)).alias("gate"))


def slope_bytes(value: str, land: Column, across: float, down: float, most: float = 1.5) -> tuple[Column, Column]:
    """Metres a metre east and north as bytes (0.5 is level), on land; at the raster's edge over one cell."""
    out = []
    for axis, size, sign in (("x", across, 1.0), ("y", down, -1.0)):
        w = focal.line(axis)
        after, before = F.lead(value, 1).over(w), F.lag(value, 1).over(w)
        apart = (after.isNotNull().cast("int") + before.isNotNull().cast("int")) * F.lit(float(size))
        slope = F.lit(sign) * F.coalesce(F.try_divide(F.coalesce(after, F.col(value)) - F.coalesce(before, F.col(value)), apart), F.lit(0.0))
        out.append(scalars.half_up((scalars.clamp(F.when(land, slope).otherwise(0.0), -most, most) / F.lit(2 * most) + F.lit(0.5)) * 255).cast("int"))
    return tuple(out)


def lit_cells(cells: DataFrame, land: str, colours: tuple[str, str, str], sigma: float, inland: float = 250.0, share: float = 0.985, grey: float = 0.2) -> DataFrame:
    """x, y, light: land cells well inland that are brighter than a percentile of them and nearly grey; how far above it they lie, as a byte."""
    t = focal.separable(cells.withColumn("_in", F.col(land) * F.lit(255.0)), "_in", focal.gaussian(sigma)).filter((F.col(land) == 1) & (F.col("_in") >= inland))
    t = t.withColumn("_lum", scalars.luminance(*[F.col(c) for c in colours]) / F.lit(255.0))
    found = scenes.at_rank(t.select(F.lit(1).alias("one"), "_lum"), ["one"], "_lum", F.floor(F.col("n") * F.lit(share))).first()
    cut = found["_lum"] if found else 0.0
    above = F.least(F.lit(255), scalars.half_up((F.col("_lum") - F.lit(cut)) / F.lit(max(1 - cut, 0.02)) * 255)).cast("int")
    return t.filter((F.col("_lum") > cut) & (scalars.chroma(*[F.col(c) for c in colours]) <= grey)).select("x", "y", above.alias("light"))


def scan_fill(rings: DataFrame, by: str, weight: Column, tallest: int = 2000) -> DataFrame:
    """x, y and the largest weight of closed rings that cover a cell, by the even-odd rule along the line through the middle of each row; rings that are taller than `tallest` are left out. rings: by, i, x, y."""
    w = Window.partitionBy(by).orderBy("i")
    ends = Window.partitionBy(by)
    first, last = F.min(F.struct("i", "x", "y")).over(ends), F.max(F.struct("i", "x", "y")).over(ends)
    closed = (F.abs(first["x"] - last["x"]) < 1e-9) & (F.abs(first["y"] - last["y"]) < 1e-9) & (F.count(F.lit(1)).over(ends) > 2)
    tall = F.ceil(F.max("y").over(ends)) - F.floor(F.min("y").over(ends)) <= tallest
    edges = rings.select(by, "i", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), weight.alias("weight"), (closed & tall).alias("ok"))
    edges = edges.filter("ok and x1 is not null and y0 <> y1")
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = edges.withColumns({"a": F.ceil(low - F.lit(0.5)), "b": F.ceil(high - F.lit(0.5)) - 1}).filter("a <= b").withColumn("y", F.explode(F.sequence("a", "b")))
    rows = rows.withColumn("at", F.col("x0") + (F.col("y") + F.lit(0.5) - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")))
    across = Window.partitionBy(by, "y").orderBy("at", "i")
    spans = rows.select("y", "weight", "at", F.lead("at").over(across).alias("to"), F.row_number().over(across).alias("n")).filter("n % 2 = 1 and to is not null")
    cells = spans.withColumns({"a": scalars.half_up(F.col("at")), "b": scalars.half_up(F.col("to"))})
    return cells.select("y", "weight", F.explode(F.sequence("a", "b")).alias("x")).groupBy("x", "y").agg(F.max("weight").alias("weight"))


def road_lamps(segs: DataFrame, by: str, order: str, spacing: Column, outage: float = 0.06, jitter: float = 2.4) -> DataFrame:
    """by, k, x, y and power: lamps along each line at its class's spacing from a hashed phase on, each moved and dimmed by hashes of its own, a few of them out."""
    w = Window.partitionBy(by).orderBy(order)
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    s = segs.withColumns({"_len": length, "_gap": spacing}).withColumn("_end", F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_start", F.col("_end") - F.col("_len")).withColumn("_phase", F.col("_gap") * (F.lit(1.0) - scalars.seed_hash(F.col(by).cast("double"))))
    first = F.greatest(F.ceil((F.col("_start") - F.col("_phase")) / F.col("_gap")), F.lit(0))
    s = s.withColumns({"_a": first, "_b": F.ceil((F.col("_end") - F.col("_phase")) / F.col("_gap")) - 1}).filter("_a <= _b and _len > 0").withColumn("k", F.explode(F.sequence("_a", "_b")))
    t = (F.col("_phase") + F.col("k") * F.col("_gap") - F.col("_start")) / F.col("_len")
    seed = F.col(by) * F.lit(97.13) + F.col("k") * F.lit(7.77)
    draw = lambda plus: scalars.seed_hash(seed + F.lit(plus))
    place = lambda a, b, plus: F.col(a) + (F.col(b) - F.col(a)) * t + (draw(plus) - F.lit(0.5)) * F.lit(jitter)
    return s.filter(draw(0.62) >= outage).select(by, "k", place("x1", "x2", 0.0).alias("x"), place("y1", "y2", 0.31).alias("y"), (F.lit(0.82) + F.lit(0.36) * draw(0.44)).alias("power"))


def centroid_lights(rings: DataFrame, by: str, prior: DataFrame) -> DataFrame:
    """by, x, y, power, cool: a light in the middle of each closed ring's vertices, with a chance, power and colour that depend on the land's use there. prior: x, y, use (2 trade, 1 homes)."""
    w = Window.partitionBy(by)
    inner = rings.withColumn("_last", F.max("i").over(w)).filter(F.col("i") < F.col("_last"))
    mid = inner.groupBy(by).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    at = mid.withColumns({"_x": scalars.half_up(F.col("x")), "_y": scalars.half_up(F.col("y"))}).join(prior.select(F.col("x").alias("_x"), F.col("y").alias("_y"), "use"), ["_x", "_y"], "left")
    seed = F.col(by) * F.lit(53.7)
    by_use = lambda trade, homes, other: F.when(F.col("use") == 2, trade).when(F.col("use") == 1, homes).otherwise(other)
    lit = at.filter(scalars.seed_hash(seed) <= by_use(0.90, 0.55, 0.42))
    power = by_use(0.62, 0.30, 0.34) * (F.lit(0.75) + F.lit(0.5) * scalars.seed_hash(seed + F.lit(0.19)))
    cool = scalars.seed_hash(seed + F.lit(0.51))
    return lit.select(by, "x", "y", power.alias("power"), by_use(F.lit(0.55) + F.lit(0.25) * cool, F.lit(0.05) + F.lit(0.15) * cool, F.lit(0.05) + F.lit(0.15) * cool).alias("cool"))


def normalised(cells: DataFrame, value: str, share: float = 0.999) -> DataFrame:
    """cells with value as a byte, full at the percentile by index min(n - 1, floor(share * n))."""
    found = scenes.at_rank(cells.select(F.lit(1).alias("one"), value), ["one"], value, F.least(F.col("n") - 1, F.floor(F.lit(share) * F.col("n")))).first()
    scale = 255 / found[value] if found and found[value] > 0 else 1.0
    return cells.withColumn(value, scalars.clamp(scalars.half_up(F.col(value) * F.lit(scale)), 0, 255).cast("int"))


def blended_axis(cells: DataFrame, scales: list[tuple[str, str, str]], seaward: tuple[str, str], sure: tuple[float, float]) -> DataFrame:
    """cells with ax, ay, anisotropy: an axis blended from scales (columns x, y, anisotropy), fine to coarse. Each takes what its anisotropy earns of the rest, turned to agree with what is there; the
    end points seaward. A step at a time, so that no expression holds another twice."""
    zero = F.lit(0.0)
    t = cells.withColumns({"_x": zero, "_y": zero, "_total": zero, "_rest": F.lit(1.0)})
    for k, (ax, ay, an) in enumerate(scales):
        weight = F.col("_rest") if k == len(scales) - 1 else F.col("_rest") * scalars.smoothstep(*sure, F.col(an))
        t = t.withColumns({"_w": weight, "_sign": F.when(F.col("_x") * F.col(ax) + F.col("_y") * F.col(ay) < 0, -1.0).otherwise(1.0)})
        turned = lambda own, c: F.col(own) + F.col("_w") * F.col("_sign") * F.col(c)
        t = t.withColumns({"_x": turned("_x", ax), "_y": turned("_y", ay), "_total": F.col("_total") + F.col("_w") * F.col(an), "_rest": F.col("_rest") - F.col("_w")})
    t = t.withColumn("_size", F.hypot("_x", "_y"))
    t = t.withColumns({"_x": F.when(F.col("_size") > 1e-9, F.col("_x") / F.col("_size")).otherwise(1.0), "_y": F.when(F.col("_size") > 1e-9, F.col("_y") / F.col("_size")).otherwise(0.0)})
    back = F.when(F.col("_x") * F.col(seaward[0]) + F.col("_y") * F.col(seaward[1]) < 0, -1.0).otherwise(1.0)
    return t.select(*cells.columns, (F.col("_x") * back).alias("ax"), (F.col("_y") * back).alias("ay"), F.col("_total").alias("anisotropy"))
