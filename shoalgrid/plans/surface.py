"""Reprojection, sheets, fusing, grading, gates, lights and flow amplitude, on the raster of plans.raster."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from shoalgrid.functions import scalars
from shoalgrid.operators import focal, grid, surface
from shoalgrid.plans.raster import _A, _HEIGHT, _cells, _height, _sql_at, _sql_places, _sql_separable
from shoalgrid.plans.selection import sql_components
from shoalgrid.session import table


def _gappy(spark, d, k=5):
    return _cells(spark, d).withColumn("v", F.when((F.col("x") * 3 + F.col("y") * 7) % k != 0, F.col("v")))


def average_reproject(spark, d):
    onto = lambda c, scale: F.floor(F.col(c) * F.lit(scale)).cast("int")
    out = surface.average_onto(_gappy(spark, d), "v", onto("x", 0.37), onto("y", 0.41))
    return out.select("x", "y", F.round("v", 6).alias("v"), F.round("cover", 6).alias("cover"))


def best_sheet(spark, d):
    """Three overlapping sheets with gaps of their own, brought from their datum to mean sea level."""
    sheets = None
    for k in (2, 3, 5):
        one = surface.average_onto(_gappy(spark, d, k), "v", F.floor(F.col("x") / 3).cast("int"), F.floor(F.col("y") / 3).cast("int")).withColumn("sheet", F.lit(k))
        sheets = one if sheets is None else sheets.unionByName(one)
    out = surface.best_covered(sheets, "v", "sheet", 0.30)
    return out.select("x", "y", F.round(F.col("v") - F.lit(0.12), 6).alias("v"), F.round("cover", 6).alias("cover"), "sheet")


def mercator_to_equirect(spark, d):
    height = _height(spark, d)
    size = (40, 40)
    rows = spark.range(size[0] * size[1]).select("id", (F.col("id") % size[0]).alias("x"), F.floor(F.col("id") / size[0]).alias("y"))
    points = surface.equirect_points(rows, size, (50, height)).select("id", "px", "py")
    out = focal.bilinear(points, _cells(spark, d), "v", "id", (50, height))
    return out.select("id", F.round("v", 5).alias("v"))


def decoded_bilinear(spark, d):
    """Heights kept as two bytes are decoded before they are blended: bytes can't be."""
    height = _height(spark, d)
    code = scalars.signed_height_code(F.col("v") / F.lit(16.0) - F.lit(0.7))
    packed = _cells(spark, d).select("x", "y", scalars.high_byte(code).alias("hi"), scalars.low_byte(code).alias("lo"))
    decoded = packed.select("x", "y", (F.lit(-0.75) + (F.col("hi") * 256 + F.col("lo")) / F.lit(65535.0) * F.lit(4.0)).alias("h"))
    s = F.col("s_suppkey")
    points = table(spark, d, "supplier").select("s_suppkey", (s * F.lit(0.37) % 49).alias("px"), (s * F.lit(1.9) % max(1, height - 1)).alias("py"))
    return focal.bilinear(points, decoded, "h", "s_suppkey", (50, height)).select("s_suppkey", F.round("h", 6).alias("h"))


def rotated_crop(spark, d):
    height = _height(spark, d)
    out = surface.rotated(_cells(spark, d), -38.0, (50, height))
    return out.select("x", "y", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


def percentile_crop(spark, d):
    """Cells within the 10th and 90th percentile of the water's places around its median, by the largest of the four distances."""
    water = _cells(spark, d).filter("m = 1")
    q = [F.percentile(c, [0.1, 0.5, 0.9]) for c in ("x", "y")]
    box = water.agg(q[0].alias("qx"), q[1].alias("qy")).select(F.col("qx")[1].alias("cx"), F.col("qy")[1].alias("cy"), F.greatest(F.col("qx")[2] - F.col("qx")[1], F.col("qx")[1] - F.col("qx")[0]).alias("rx"), F.greatest(F.col("qy")[2] - F.col("qy")[1], F.col("qy")[1] - F.col("qy")[0]).alias("ry"))
    return _cells(spark, d).crossJoin(F.broadcast(box)).filter((F.abs(F.col("x") - F.col("cx")) <= F.col("rx")) & (F.abs(F.col("y") - F.col("cy")) <= F.col("ry"))).select("x", "y", "v")


def _colours(spark, d):
    byte = lambda k, c: ((F.col("v") * k + F.col(c)) % 256).cast("double")
    return _cells(spark, d).select("x", "y", "v", "m", byte(5, "x").alias("r"), byte(3, "y").alias("g"), byte(7, "x").alias("b"), (F.col("v") * 5).alias("aerial"))


def pansharpen(spark, d):
    return surface.fused(_colours(spark, d), "aerial", ("r", "g", "b"), 1.0, 2.0)


def graded(spark, d):
    return surface.graded(_colours(spark, d), F.col("m") == 0)


def coast_blend(spark, d):
    return surface.soft_blend(_colours(spark, d), "aerial", "g", "m", 1.2).select("x", "y", F.round("value", 5).alias("value"))


def ridge_gate(spark, d):
    out = surface.ridge_gate(_cells(spark, d), "v", 1.0, F.col("v") < 40, (F.col("y") * 50 + F.col("x")) % 6 == 0, (0.0, 0.55))
    return out.select("x", "y", F.round("gate", 5).alias("gate"))


def slope_bytes(spark, d):
    east, north = surface.slope_bytes("v", F.col("v") > 10, 9.5, 10.3)
    return _cells(spark, d).select("x", "y", east.alias("east"), north.alias("north"))


def gauss_short(spark, d):
    """A Gaussian cut off at two and a half deviations."""
    return focal.separable(_cells(spark, d), "v", focal.gaussian(1.2, 2.5)).select("x", "y", F.round("v", 6).alias("v"))


def flatten_twice(spark, d):
    """Tones evened out over land, then over what lies between the tides, each with its own statistics."""
    cells = _cells(spark, d).withColumns({"land": (F.col("v") > 30).cast("int"), "flat": ((F.col("v") > 15) & (F.col("v") <= 30)).cast("int")})
    once = focal.flatten_tone(cells, "v", "land", 1.5, 40.0)
    return focal.flatten_tone(once.select("x", "y", "v", "flat"), "v", "flat", 1.2, 22.0).select("x", "y", F.round("v", 6).alias("v"))


def depth_proxy(spark, d):
    """Depth as a byte from the way to the nearest dry cell, easing in and full at five cells."""
    cells = _cells(spark, d)
    dist = grid.distance(cells, F.col("v") > 40, tile=64, limit=5.0)
    return dist.select("x", "y", scalars.half_up(F.lit(255.0) * scalars.smoothstep(0, 5, F.least("dist", F.lit(5.0)))).cast("int").alias("depth"))


def lit_cells(spark, d):
    grey = _colours(spark, d).withColumns({"land": (F.col("v") > 4).cast("int"), "gg": (F.col("r") + F.col("y") % 7) % 256, "bb": F.col("r")})
    return surface.lit_cells(grey, "land", ("r", "gg", "bb"), 0.4, 200.0, 0.8, 0.2)


def frozen_sea(spark, d):
    """Two rules by which cells between the tides count as sea: outside the mask, and blue and dark."""
    c = _colours(spark, d).withColumns({"cls": F.when(F.col("v") <= 15, 0).when(F.col("v") <= 35, 128).otherwise(255), "mask": (F.col("x") * 7 + F.col("y")) % 4})
    lum = scalars.luminance(F.col("r"), F.col("g"), F.col("b")) / F.lit(255.0)
    frozen = lambda c: F.when((F.col("cls") == 128) & c, 0).otherwise(F.col("cls"))
    return c.select("x", "y", frozen(F.col("mask") == 0).alias("by_mask"), frozen((F.col("b") > F.col("r")) & (lum < 0.34)).alias("by_colour"))


def _ring_rows(spark, d):
    """Each supplier's ring of five corners, closed but for every ninth."""
    s = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(s.alias("ring"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    turn = F.when((F.col("i") == 5) & (F.col("ring") % 9 != 0), F.lit(0)).otherwise(F.col("i"))
    x = F.col("ring") * 3 % 40 + F.element_at(F.array(*[F.lit(v) for v in (0.0, 7.3, 9.1, 4.2, -2.5, 1.0)]), turn.cast("int") + 1)
    y = F.col("ring") * 11 % 31 + F.element_at(F.array(*[F.lit(v) for v in (0.0, 1.2, 6.4, 3.1, 8.7, 2.0)]), turn.cast("int") + 1)
    return rows.select("ring", "i", x.cast("double").alias("x"), y.cast("double").alias("y"))


def polygon_fill(spark, d):
    return surface.scan_fill(_ring_rows(spark, d), "ring", (F.col("ring") % 5 + 1).cast("double"))


def closed_rings(spark, d):
    rings = _ring_rows(spark, d).groupBy("ring").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("p"))
    first, last = F.element_at("p", 1), F.element_at("p", -1)
    return rings.select("ring", ((F.size("p") > 2) & (F.abs(first["x"] - last["x"]) < 1e-9) & (F.abs(first["y"] - last["y"]) < 1e-9)).alias("closed"))


def road_lamps(spark, d):
    from shoalgrid.plans.raster import _lines

    spacing = F.element_at(F.array(F.lit(2.1), F.lit(1.7), F.lit(2.9)), (F.col("line") % 3).cast("int") + 1)
    out = surface.road_lamps(_lines(spark, d), "line", "i", spacing)
    return out.select("line", "k", *[F.round(c, 4).alias(c) for c in ("x", "y", "power")])


def centroid_lights(spark, d):
    prior = _cells(spark, d).select("x", "y", F.when(F.col("v") > 35, 2).when(F.col("v") > 15, 1).otherwise(0).alias("use"))
    out = surface.centroid_lights(_ring_rows(spark, d), "ring", prior)
    return out.select("ring", *[F.round(c, 4).alias(c) for c in ("x", "y", "power", "cool")])


def city_glow(spark, d):
    """Roads, buildings and land use weighted, as cores and halos, dimmed where satellites see little, normalised at the 99.9th percentile."""
    raw = (F.col("v") > 45).cast("double") + (F.col("v") % 7 == 0).cast("double") * F.lit(0.35) + (F.col("v") % 5 == 1).cast("double") * F.lit(0.2)
    cells = _cells(spark, d).withColumns({"core": raw, "halo": raw, "seen": F.col("v")})
    for axis in focal.AXES:
        for c, s in (("core", 0.5), ("halo", 2.0)):
            cells = focal.weighted(cells, c, axis, focal.gaussian(s))
    top = cells.agg(F.max("seen")).first()[0] or 1.0
    out = cells.select("x", "y", ((F.col("core") * F.lit(0.75) + F.col("halo") * F.lit(0.55)) * (F.lit(0.35) + F.lit(0.65) * F.col("seen") / F.lit(float(top)))).alias("light"))
    return surface.normalised(out, "light")


def axis_blend(spark, d):
    a = lambda k: (F.col("v") * k + F.col("x")) * F.lit(0.1)
    cells = _cells(spark, d)
    for k in (1, 2, 3):
        cells = cells.withColumns({f"x{k}": F.cos(a(k)), f"y{k}": F.sin(a(k)), f"n{k}": (F.col("v") * k % 11) / F.lit(10.0)})
    cells = cells.withColumns({"sx": F.cos(a(5)), "sy": F.sin(a(5))})
    out = surface.blended_axis(cells, [(f"x{k}", f"y{k}", f"n{k}") for k in (1, 2, 3)], ("sx", "sy"), (0.2, 0.7))
    return out.select("x", "y", *[F.round(c, 5).alias(c) for c in ("ax", "ay", "anisotropy")])


def flow_amplitude(spark, d):
    """How strong a channel a cell is: its depth against the deepest near it, cubed, times a depth ramp, a boost where deep, and a gate on land."""
    near = focal.square_max(_cells(spark, d).select("x", "y", "v", F.col("v").alias("depth")), "v", 2)
    rel = F.when(F.col("v") > 0.25, scalars.clamp(F.col("depth") / F.col("v"), 0, 1)).otherwise(0.0)
    out = F.pow(rel, F.lit(3)) * scalars.smoothstep(4, 20, F.col("depth")) * (F.lit(0.6) + F.lit(0.4) * scalars.smoothstep(20, 45, F.col("depth"))) * (F.lit(1.0) - scalars.smoothstep(40, 50, F.col("depth")))
    return near.select("x", "y", F.round(out, 6).alias("amplitude"))


def _flats(spark, d):
    return _cells(spark, d).filter("v > 20 and v < 45")


def harbour_membership(spark, d):
    """Nearness to flats whose extent is at least five cells: a square maximum, then three boxes."""
    labelled = grid.components(_flats(spark, d), diagonal=False)
    large = labelled.groupBy("comp").agg(F.greatest(F.max("x") - F.min("x") + 1, F.max("y") - F.min("y") + 1).alias("span")).filter("span >= 5").select("comp")
    flats = labelled.join(large, "comp", "left_semi").select("x", "y", F.lit(1.0).alias("f"))
    cells = _cells(spark, d).select("x", "y").join(flats, ["x", "y"], "left").select("x", "y", F.coalesce("f", F.lit(0.0)).alias("f"))
    return focal.box_blur(focal.square_max(cells, "f", 1), "f", 1.5).select("x", "y", F.round("f", 6).alias("member"))


def flow_coverage(spark, d):
    amp = flow_amplitude(spark, d).join(_cells(spark, d).select("x", "y", "v"), ["x", "y"]).filter("v < 40")
    return amp.agg(F.count(F.lit(1)).alias("water"), F.round(F.avg((F.col("amplitude") > 0.3).cast("double")) * 100, 5).alias("lit_percent"), F.round(F.avg("amplitude"), 6).alias("mean"))


# --- SQL ---------------------------------------------------------------------------------------------------------------

_STEP = lambda lo, hi, x: f"(least(greatest((({x}) - {lo}) / ({hi} - {lo})::double, 0), 1) * least(greatest((({x}) - {lo}) / ({hi} - {lo})::double, 0), 1) * (3 - 2 * least(greatest((({x}) - {lo}) / ({hi} - {lo})::double, 0), 1)))"
_GAPPY = lambda k, name: f"{name} as (select x, y, case when (x * 3 + y * 7) % {k} <> 0 then v end v from a)"
_RGB = "co as (select x, y, v, m, ((v * 5 + x) % 256)::double r, ((v * 3 + y) % 256)::double g, ((v * 7 + x) % 256)::double b, v * 5 aerial from a)"
_LUM = "(r * 0.299::double + g * 0.587::double + b * 0.114::double)"
_RINGS = """rg0 as (select s_suppkey ring, i, case when i = 5 and s_suppkey % 9 <> 0 then 0 else i end t from supplier, range(6) q(i)),
rg as (select ring, i, (ring * 3 % 40 + [0.0, 7.3, 9.1, 4.2, -2.5, 1.0][t + 1])::double x, (ring * 11 % 31 + [0.0, 1.2, 6.4, 3.1, 8.7, 2.0][t + 1])::double y from rg0),
rc as (select ring, count(*) > 2 and abs(min_by(x, i) - max_by(x, i)) < 1e-9 and abs(min_by(y, i) - max_by(y, i)) < 1e-9 closed from rg group by 1)"""
_HASH = lambda s: f"(sin(({s}) * 127.1::double + 311.7::double) * 43758.5453123::double - floor(sin(({s}) * 127.1::double + 311.7::double) * 43758.5453123::double))"


def _blur(source, column, weights):
    """A relation (x, y, v) of a blurred column of a relation."""
    return _sql_separable(f"(select x, y, {column} v from {source})", weights)


def _merc(lat):
    return f"((1 - ln(tan(pi() / 4 + ({lat}) * pi() / 360)) / pi()) / 2)"


def _at_share(column, rank, source="co"):
    return f"(select {column} from (select {column}, row_number() over (order by {column}) - 1 i, count(*) over () n from {source}) where i = {rank})"


def _sql_bilinear(points, key, value, height):
    return f"""select {key}, sum(w * {value}) z from (select {key}, case when i = 1 then px - floor(px) else 1 - (px - floor(px)) end * case when j = 1 then py - floor(py) else 1 - (py - floor(py)) end w, least(greatest(floor(px) + i, 0), 49) tx, least(greatest(floor(py) + j, 0), {height} - 1) ty from ({points}), range(2) q(i), range(2) z(j)) join a on a.x = tx and a.y = ty group by 1"""


def _sql_grade():
    out = []
    for c in "rgb":
        black, white = _at_share(c, "floor(0.01::double * (n - 1) + 0.5::double)"), _at_share(c, "floor(0.995::double * (n - 1) + 0.5::double)")
        out.append(f"{c}s as (select least(6.0::double, {black} * 0.55::double) lo, {white} hi)")
    curve = lambda t: f"case when {t} < 0.5 then 0.5::double * pow({t} * 2, 0.88::double) else 1 - 0.5::double * pow((1 - {t}) * 2, 0.88::double) end * 255"
    ts = ", ".join(f"least(greatest(({c} - (select lo from {c}s)) / greatest(1.0::double, (select hi - lo from {c}s)), 0), 1) t{c}" for c in "rgb")
    byte = lambda c, k: f"cast(floor(least(greatest(least(greatest(mean + (c{c} - mean) * boost, 0), 255) + {k} * land, 0), 255) + 0.5) as int) {c}"
    return f"""with {_A}, {_RGB}, {', '.join(out)}, t as (select x, y, case when m = 0 then 1.0::double else 0 end land, {ts} from co), c as (select *, {', '.join(f'{curve(f"t{c}")} c{c}' for c in 'rgb')} from t),
e as (select *, (cr + cg + cb) / 3 mean from c), f as (select *, 1 + 0.35::double * (1 - least(greatest((greatest(cr, cg, cb) - mean) * 2 / 255, 0), 1)) boost from e) select x, y, {byte('r', 5)}, {byte('g', 4)}, {byte('b', -6)} from f"""


def _sql_fused():
    near, far, wide = _blur("co", "aerial", focal.gaussian(1.0)), _blur("co", "aerial", focal.gaussian(2.0)), _blur("lu", "l", focal.gaussian(2.0))
    byte = lambda c: f"cast(floor(least(greatest(lum + {c} - l, 0), 255) + 0.5) as int) {c}"
    return f"""with {_A}, {_RGB}, lu as (select *, {_LUM} l from co), z as (select lu.*, n.v near, f.v far, w.v wide from lu join {near} n using (x, y) join {far} f using (x, y) join {wide} w using (x, y)),
q as (select *, l * least(greatest(far / greatest(wide, 4), 0.55::double), 1.9::double) + 0.85::double * least(greatest(aerial - near, -46), 46) lum from z) select x, y, {byte('r')}, {byte('g')}, {byte('b')} from q"""


def _sql_flatten(source, mask, sigma, target):
    return f"(select a.* replace (case when a.{mask} = 1 then a.v * coalesce(pow(least(greatest({target} / nullif(l.v / nullif(n.v, 0), 0), 0.72), 1.45), 0.75::double), 1) else a.v end as v) from {source} a join {_blur(source, f'v * {mask}', focal.gaussian(sigma))} l using (x, y) join {_blur(source, f'{mask}::double', focal.gaussian(sigma))} n using (x, y))"


def _sql_axis():
    a = lambda k: f"((v * {k} + x) * 0.1::double)"
    out, rest, x, y = f"with {_A}, s0 as (select *, 0.0::double ax, 0.0::double ay, 0.0::double an, 1.0::double rest from a)", "s0", "ax", "ay"
    for k in (1, 2, 3):
        an = f"(v * {k} % 11 / 10.0::double)"
        weight = "rest" if k == 3 else f"rest * {_STEP(0.2, 0.7, an)}"
        out += f", s{k} as (select * replace (ax + w * sign * cos({a(k)}) as ax, ay + w * sign * sin({a(k)}) as ay, an + w * {an} as an, rest - w as rest) exclude (w, sign) from (select *, {weight} w, case when ax * cos({a(k)}) + ay * sin({a(k)}) < 0 then -1 else 1 end sign from s{k - 1}))".replace("select * replace", "select * exclude (w, sign) replace").replace(" exclude (w, sign) from (select", " from (select")
    return out + f", u as (select x, y, v, an, case when sqrt(ax * ax + ay * ay) > 1e-9 then ax / sqrt(ax * ax + ay * ay) else 1 end ux, case when sqrt(ax * ax + ay * ay) > 1e-9 then ay / sqrt(ax * ax + ay * ay) else 0 end uy from s3), b as (select *, case when ux * cos({a(5)}) + uy * sin({a(5)}) < 0 then -1 else 1 end back from u) select x, y, round(ux * back, 5) ax, round(uy * back, 5) ay, round(an, 5) anisotropy from b"


_AMPLITUDE = f"am as (select p.x, p.y, p.v, pow(case when n.v > 0.25 then least(greatest(p.v / n.v, 0), 1) else 0 end, 3) * {_STEP(4, 20, 'p.v')} * (0.6::double + 0.4::double * {_STEP(20, 45, 'p.v')}) * (1 - {_STEP(40, 50, 'p.v')}) amp from a p join (select a.x, a.y, max(n.v) v from a join a n on abs(n.x - a.x) <= 2 and abs(n.y - a.y) <= 2 group by 1, 2) n using (x, y))"
_TURN, _SIDE = (math.cos(math.radians(-38.0)), math.sin(math.radians(-38.0))), "least(25 / (4 / 3.0::double * {c} + {s}), n / 2.0::double / (4 / 3.0::double * {s} + {c}))"
_FIT = _SIDE.format(c=repr(abs(_TURN[0])), s=repr(abs(_TURN[1])))
_BOXES = lambda source, sigma: _boxed(source, sigma)


def _boxed(source, sigma):
    from shoalgrid.plans.raster import _sql_pass

    for axis in focal.AXES:
        for r in focal.box_sizes(sigma):
            source = _sql_pass(source, axis, focal.box(r))
    return source


ORACLES = {
    "average_reproject": f"with {_A}, {_GAPPY(5, 'g')} select cast(floor(x * 0.37::double) as int) x, cast(floor(y * 0.41::double) as int) y, round(sum(coalesce(v, 0)) / nullif(count(v), 0), 6) v, round(count(v) / count(*)::double, 6) as cover from g group by 1, 2",
    "best_sheet": f"with {_A}, {', '.join(_GAPPY(k, f'g{k}') for k in (2, 3, 5))}, s as ({' union all '.join(f'select cast(x // 3 as int) x, cast(y // 3 as int) y, sum(v) / nullif(count(v), 0) v, count(v) / count(*)::double as cover, {k} sheet from g{k} group by 1, 2' for k in (2, 3, 5))}) select x, y, round(v - 0.12::double, 6) v, round(cover, 6) as cover, sheet from (select * from s where v is not null qualify row_number() over (partition by x, y order by cover desc, sheet) = 1) where cover >= 0.30",
    "mercator_to_equirect": f"with {_A}, n as (select {_HEIGHT} n), p as (select id, least(greatest((id % 40 + 0.5::double) / 40 * 50 - 0.5::double, 0), 49) px, least(greatest(({_merc('-37.41::double - (id // 40 + 0.5::double) / 40 * 0.38::double')} - {_merc('-37.41::double')}) / ({_merc('-37.79::double')} - {_merc('-37.41::double')}) * n - 0.5::double, 0), n - 1) py from range(1600) r(id), n) select id, round(z, 5) v from ({_sql_bilinear('select * from p', 'id', 'v', _HEIGHT)})",
    "decoded_bilinear": f"with a0 as (select cast(p_partkey % 50 as int) x, cast(p_partkey // 50 as int) y, cast(floor(least(greatest((p_size / 16.0::double - 0.7::double + 0.75::double) / 4, 0), 1) * 65535 + 0.5) as bigint) code from part), a as (select x, y, -0.75::double + (code // 256 * 256 + code % 256) / 65535.0::double * 4 h from a0) select s_suppkey, round(z, 6) h from ({_sql_bilinear(f'select s_suppkey, s_suppkey * 0.37::double % 49 px, s_suppkey * 1.9::double % greatest(1, {_HEIGHT} - 1) py from supplier', 's_suppkey', 'h', _HEIGHT)})",
    "rotated_crop": f"with {_A}, n as (select {_HEIGHT} n), t as (select x, y, (x + 0.5::double - 25) * {_TURN[0]!r} - (y + 0.5::double - n / 2.0::double) * ({_TURN[1]!r}) u, (x + 0.5::double - 25) * ({_TURN[1]!r}) + (y + 0.5::double - n / 2.0::double) * {_TURN[0]!r} w, {_FIT} h from a, n) select x, y, round(u, 6) u, round(w, 6) v from t where abs(u) <= h * 4 / 3.0::double and abs(w) <= h",
    "percentile_crop": f"with {_A}, b as (select median(x) cx, median(y) cy, greatest(quantile_cont(x, 0.9) - median(x), median(x) - quantile_cont(x, 0.1)) rx, greatest(quantile_cont(y, 0.9) - median(y), median(y) - quantile_cont(y, 0.1)) ry from a where m = 1) select x, y, v from a, b where abs(x - cx) <= rx and abs(y - cy) <= ry",
    "pansharpen": _sql_fused(),
    "graded": _sql_grade(),
    "coast_blend": f"with {_A}, {_RGB} select x, y, round(aerial * k.v + g * (1 - k.v), 5) as value from co join {_blur('co', 'm::double', focal.gaussian(1.2))} k using (x, y)",
    "ridge_gate": f"with {_A}, s as (select a.x, a.y, a.v raw, k.v from a join {_blur('a', 'v', focal.gaussian(1.0))} k using (x, y)), r as (select x, y, raw, 4.0::double * v - {_sql_at('x', 1)} - {_sql_at('x', -1)} - {_sql_at('y', 1)} - {_sql_at('y', -1)} g from s), q as (select g from r where raw < 40 and (y * 50 + x) % 6 = 0 and g > 0) select x, y, round({_STEP(0, 0.55, 'g / (' + _at_share('g', 'floor(n * 0.85::double)', 'q') + ')')}, 5) gate from r",
    "slope_bytes": f"with {_A}, w as (select *, lead(v) over r e, lag(v) over r w, lead(v) over c s, lag(v) over c n from a window r as (partition by y order by x), c as (partition by x order by y)), g as (select x, y, case when v > 10 then coalesce((coalesce(e, v) - coalesce(w, v)) / nullif((case when e is null then 0 else 1 end + case when w is null then 0 else 1 end) * 9.5::double, 0), 0) else 0 end gx, case when v > 10 then coalesce(-(coalesce(s, v) - coalesce(n, v)) / nullif((case when s is null then 0 else 1 end + case when n is null then 0 else 1 end) * 10.3::double, 0), 0) else 0 end gy from w) select x, y, cast(floor((least(greatest(gx, -1.5), 1.5) / 3.0::double + 0.5::double) * 255 + 0.5) as int) east, cast(floor((least(greatest(gy, -1.5), 1.5) / 3.0::double + 0.5::double) * 255 + 0.5) as int) north from g",
    "gauss_short": f"with {_A} select x, y, round(v, 6) v from {_sql_separable('a', focal.gaussian(1.2, 2.5))}",
    "flatten_twice": f"with {_A}, k as (select x, y, v, case when v > 30 then 1 else 0 end land, case when v > 15 and v <= 30 then 1 else 0 end flat from a), f1 as (select * from {_sql_flatten('k', 'land', 1.5, 40)}) select x, y, round(v, 6) v from {_sql_flatten('f1', 'flat', 1.2, 22)}",
    "depth_proxy": f"with {_A}, d as (select a.x, a.y, least(5, min(greatest(abs(s.x - a.x), abs(s.y - a.y)) + (sqrt(2) - 1) * least(abs(s.x - a.x), abs(s.y - a.y)))) d from a, (select x, y from a where v > 40) s group by 1, 2) select x, y, cast(floor(255.0::double * {_STEP(0, 5, 'd')} + 0.5) as int) depth from d",
    "lit_cells": f"with {_A}, {_RGB}, l as (select x, y, r, (r + y % 7) % 256 g, r b, case when v > 4 then 1 else 0 end land from co), i as (select l.*, {_LUM} / 255 lum from l join {_blur('l', 'land * 255.0::double', focal.gaussian(0.4))} k using (x, y) where land = 1 and k.v >= 200), c as (select {_at_share('lum', 'floor(n * 0.8::double)', 'i')} cut) select x, y, cast(least(255, floor((lum - cut) / greatest(1 - cut, 0.02) * 255 + 0.5)) as int) light from i, c where lum > cut and coalesce((greatest(r, g, b) - least(r, g, b)) / nullif(greatest(r, g, b), 0), 0) <= 0.2",
    "frozen_sea": f"with {_A}, {_RGB}, k as (select *, case when v <= 15 then 0 when v <= 35 then 128 else 255 end cls from co) select x, y, case when cls = 128 and (x * 7 + y) % 4 = 0 then 0 else cls end by_mask, case when cls = 128 and b > r and {_LUM} / 255 < 0.34 then 0 else cls end by_colour from k",
    "polygon_fill": f"""with {_RINGS}, e as (select ring, i, x x0, y y0, lead(x) over w x1, lead(y) over w y1 from rg join rc using (ring) where closed window w as (partition by ring order by i)),
r as (select *, unnest(range(cast(floor(least(y0, y1)) - 1 as bigint), cast(ceil(greatest(y0, y1)) + 2 as bigint))) yy from e where x1 is not null), c as (select ring, i, yy, x0 + (yy + 0.5::double - y0) / (y1 - y0) * (x1 - x0) cut from r where (y0 <= yy + 0.5 and y1 > yy + 0.5) or (y1 <= yy + 0.5 and y0 > yy + 0.5)),
s as (select ring, yy, cut, lead(cut) over w nxt, row_number() over w n from c window w as (partition by ring, yy order by cut, i)) select x, yy y, max(ring % 5 + 1)::double weight from (select ring, yy, unnest(range(cast(floor(cut + 0.5) as bigint), cast(floor(nxt + 0.5) as bigint) + 1)) x from s where n % 2 = 1 and nxt is not null) group by 1, 2""",
    "closed_rings": f"with {_RINGS} select ring, closed from rc",
    "centroid_lights": f"""with {_A}, {_RINGS}, c as (select ring, avg(x) x, avg(y) y from (select *, max(i) over (partition by ring) last from rg) where i < last group by 1), p as (select c.*, case when a.v > 35 then 2 when a.v > 15 then 1 else 0 end u, ring * 53.7::double seed from c left join a on a.x = floor(c.x + 0.5) and a.y = floor(c.y + 0.5))
select ring, round(x, 4) x, round(y, 4) y, round(case u when 2 then 0.62::double when 1 then 0.30::double else 0.34::double end * (0.75::double + 0.5::double * {_HASH('seed + 0.19::double')}), 4) as power, round(case when u = 2 then 0.55::double + 0.25::double * {_HASH('seed + 0.51::double')} else 0.05::double + 0.15::double * {_HASH('seed + 0.51::double')} end, 4) cool from p where {_HASH('seed')} <= case u when 2 then 0.90::double when 1 then 0.55::double else 0.42::double end""",
    "city_glow": f"""with {_A}, w as (select *, case when v > 45 then 1.0::double else 0 end + case when v % 7 = 0 then 0.35::double else 0 end + case when v % 5 = 1 then 0.2::double else 0 end raw from a),
g as (select w.x, w.y, (c.v * 0.75::double + h.v * 0.55::double) * (0.35::double + 0.65::double * w.v / max(w.v) over ()) l from w join {_blur('w', 'raw', focal.gaussian(0.5))} c using (x, y) join {_blur('w', 'raw', focal.gaussian(2.0))} h using (x, y)) select x, y, cast(least(greatest(floor(l * (255 / {_at_share('l', 'least(n - 1, floor(0.999::double * n))', 'g')}) + 0.5), 0), 255) as int) light from g""",
    "axis_blend": _sql_axis(),
    "flow_amplitude": f"with {_A}, {_AMPLITUDE} select x, y, round(amp, 6) amplitude from am",
    "harbour_membership": f"""with recursive {_A}, f as (select x, y from a where v > 20 and v < 45), {sql_components('f', 'fc').replace('abs(n.x - c.x) <= 1 and abs(n.y - c.y) <= 1 and (n.x <> c.x or n.y <> c.y)', 'abs(n.x - c.x) + abs(n.y - c.y) = 1')},
b as (select x, y from fc where comp in (select comp from fc group by 1 having greatest(max(x) - min(x), max(y) - min(y)) + 1 >= 5)), s as (select a.x, a.y, max(case when b.x is null then 0.0::double else 1.0::double end) v from a left join b on abs(b.x - a.x) <= 1 and abs(b.y - a.y) <= 1 group by 1, 2) select x, y, round(v, 6) member from {_boxed('s', 1.5)}""",
    "flow_coverage": f"with {_A}, {_AMPLITUDE} select count(*) water, round(avg(case when round(amp, 6) > 0.3 then 1.0::double else 0 end) * 100, 5) lit_percent, round(avg(round(amp, 6)), 6) mean from am where v < 40",
}
_LAMP_LINES = "ln as (select s_suppkey line, i, (s_suppkey * 3 % 47 + i * 5)::double x, (s_suppkey * 11 % 31 + i * i * 3)::double y from supplier, range(4) r(i)), sl as (select *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) len from (select line, i, x x1, y y1, lead(x) over w x2, lead(y) over w y2 from ln window w as (partition by line order by i)) where x2 is not null)"
ORACLES["road_lamps"] = f"""with {_LAMP_LINES}, e as (select *, sum(len) over (partition by line order by i) fin, [2.1, 1.7, 2.9][line % 3 + 1]::double gap from sl), p as (select *, fin - len ini, gap * (1 - {_HASH('line')}) phase from e), k as (select *, unnest(range(80)) k from p),
s as (select *, line * 97.13::double + k * 7.77::double seed, (phase + k * gap - ini) / len t from k where phase + k * gap >= ini and phase + k * gap < fin)
select line, k, round(x1 + (x2 - x1) * t + ({_HASH('seed')} - 0.5::double) * 2.4::double, 4) x, round(y1 + (y2 - y1) * t + ({_HASH('seed + 0.31::double')} - 0.5::double) * 2.4::double, 4) y, round(0.82::double + 0.36::double * {_HASH('seed + 0.44::double')}, 4) as power from s where {_HASH('seed + 0.62::double')} >= 0.06"""
QUERIES = {name: globals()[name] for name in ORACLES}
