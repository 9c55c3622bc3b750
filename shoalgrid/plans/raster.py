"""Raster queries: cells x = p_partkey % 50, y = p_partkey div 50, value = p_size."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalgrid.operators import focal, grid
from shoalgrid.plans.scenes import _raster
from shoalgrid.session import table

RING = [(5, 3), (30, 2), (44, 10), (46, 30), (38, 37), (30, 28), (22, 36), (8, 33), (3, 20), (12, 12)]


def _cells(spark, d):
    return _raster(spark, d).select("x", "y", F.col("p_size").cast("double").alias("v"), (F.col("p_size") > 25).cast("int").alias("m"))


def _water(spark, d):
    return _cells(spark, d).filter("m = 1")


def _height(spark, d):
    """Rows of the whole raster."""
    last = _raster(spark, d).agg(F.max("y")).first()[0]
    return 0 if last is None else last + 1


def dilate(spark, d):
    return grid.dilate(_cells(spark, d).withColumn("m", (F.col("v") > 45).cast("int")), "m", 2).select("x", "y", "m")


def erode(spark, d):
    return grid.erode(_cells(spark, d).withColumn("m", (F.col("v") > 3).cast("int")), "m", 2).select("x", "y", "m")


def boundary(spark, d):
    c = _cells(spark, d)
    return c.withColumn("edge", grid.boundary(c, "m")).select("x", "y", "edge")


def touches_land(spark, d):
    c = grid.touches(_cells(spark, d).withColumn("land", (F.col("v") > 44).cast("int")), "land")
    return c.filter("m = 1").select("x", "y", F.col("_near").alias("touches"))


def disc_dilate(spark, d):
    return grid.disc_dilate(_cells(spark, d).withColumn("m", (F.col("v") > 46).cast("int")), "m", 3)


def components8(spark, d):
    return grid.components(_water(spark, d)).select("x", "y", (F.col("comp.y") * 50 + F.col("comp.x")).alias("comp"))


def components4(spark, d):
    return grid.components(_water(spark, d), diagonal=False).select("x", "y", (F.col("comp.y") * 50 + F.col("comp.x")).alias("comp"))


def component_stats(spark, d):
    s = grid.component_stats(grid.components(_water(spark, d)))
    return s.select((F.col("comp.y") * 50 + F.col("comp.x")).alias("comp"), "n", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "west", "east", "north", "south")


def despeckle(spark, d):
    return grid.despeckle(_water(spark, d), 6, diagonal=False)


def sea_connected(spark, d):
    return grid.connected_to(_water(spark, d), (F.col("x") == 0) | (F.col("y") == 0), diagonal=False)


def geodesic(spark, d):
    """Way through the water from its cells in every tenth column; tiles of 16 cells."""
    dist = grid.distance(_water(spark, d), F.col("x") % 10 == 0, 1.0, 1.2, 1.562, tile=16)
    return dist.select("x", "y", F.round("dist", 6).alias("dist")).filter(F.col("dist") < float("inf"))


def chamfer(spark, d):
    """Distance to the nearest deep cell by steps of 1 and the square root of 2, at most 220."""
    dist = grid.distance(_cells(spark, d), F.col("v") > 45, tile=64, limit=220.0)
    return dist.select("x", "y", F.round(F.least("dist", F.lit(220.0)), 6).alias("dist"))


def bfs_grow(spark, d):
    return grid.grow(_water(spark, d), F.col("x") == 0, 12)


def median3(spark, d):
    return focal.median3(_cells(spark, d), "v")


def _smooth(cells, weights):
    return focal.separable(cells, "v", weights).select("x", "y", F.round("v", 6).alias("v"))


def gauss_sep(spark, d):
    return _smooth(_cells(spark, d), focal.gaussian(1.2))


def tent5(spark, d):
    return _smooth(_cells(spark, d), focal.TENT)


def box_blur(spark, d):
    return focal.box_blur(_cells(spark, d), "v", 2.0).select("x", "y", F.round("v", 6).alias("v"))


def max_filter(spark, d):
    return focal.square_max(_cells(spark, d), "v", 3).select("x", "y", "v")


def gradient(spark, d):
    gx, gy = focal.gradient("v")
    return _cells(spark, d).select("x", "y", gx.alias("gx"), gy.alias("gy"))


def laplacian(spark, d):
    return _cells(spark, d).select("x", "y", focal.ridge("v").alias("ridge"))


def hillshade(spark, d):
    gx, gy = focal.gradient("v")
    return _cells(spark, d).select("x", "y", F.round(focal.hillshade(gx, gy), 6).alias("shade"))


def structure_tensor(spark, d):
    return focal.structure_tensor(_cells(spark, d), "v", 2).select("x", "y", F.round("anisotropy", 5).alias("anisotropy"))


def block_avg(spark, d):
    return focal.block_average(_cells(spark, d), "v", 5, 4).withColumn("v", F.round("v", 6))


def nearest_resize(spark, d):
    height = _height(spark, d)
    return focal.nearest(_cells(spark, d), "v", (50, height), (33, max(1, height * 17 // 40)))


def bilinear(spark, d):
    """Every supplier's point, all of them within the raster."""
    height = _height(spark, d)
    s = F.col("s_suppkey")
    points = table(spark, d, "supplier").select("s_suppkey", (s * F.lit(0.49) % 49).alias("px"), (s * 7 % max(1, height - 1) + F.lit(0.25)).alias("py"))
    return focal.bilinear(points, _cells(spark, d), "v", "s_suppkey", (50, height)).withColumn("v", F.round("v", 6))


def mitchell(spark, d):
    height = _height(spark, d)
    return focal.resample(focal.resample(_cells(spark, d), "v", "x", 50, 80), "v", "y", height, height * 8 // 5).select("x", "y", F.round("v", 6).alias("v"))


def priority_mosaic(spark, d):
    v, k = F.col("v"), F.col("x") + F.col("y") * 50
    base = F.when(k % 11 != 0, v)
    layers = [(F.when(k % 3 == 0, v + 5), F.lit(1.0)), (F.when(k % 5 < 2, v * 2), (k % 7) / F.lit(6.0)), (F.when(k % 13 == 0, F.lit(-1.0)), F.lit(0.5))]
    return _cells(spark, d).select("x", "y", F.round(focal.mosaic(base, layers), 6).alias("v"))


def masked_flatten(spark, d):
    return focal.flatten_tone(_cells(spark, d), "v", "m", 1.5, 30.0).select("x", "y", F.round("v", 6).alias("v"))


def pip_mask(spark, d):
    return _cells(spark, d).filter(focal.inside(F.col("x") + F.lit(0.5), F.col("y") + F.lit(0.5), RING)).select("x", "y")


def _lines(spark, d):
    """Each supplier's line of four vertices."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("line"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    return focal.segments(s.select("line", "i", (F.col("line") * 3 % 47 + F.col("i") * 5).cast("double").alias("x"), (F.col("line") * 11 % 31 + F.col("i") * F.col("i") * 3).cast("double").alias("y")), "line", "i")


def densify(spark, d):
    return focal.densify(_lines(spark, d), "line", "i", 1.5).select("line", "i", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def line_raster(spark, d):
    return focal.rasterise_lines(_lines(spark, d), 0.75, (F.col("line") % 9).cast("double"))


def arc_lamps(spark, d):
    return focal.lamps(_lines(spark, d), "line", "i", 2.7, 0.4).select("line", "k", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


def splat(spark, d):
    points = table(spark, d, "customer").select((F.col("c_custkey") % 40 + F.lit(0.3)).alias("px"), (F.col("c_custkey") * 7 % 30 + F.lit(0.6)).alias("py"), F.lit(1.0).alias("w0"), (F.col("c_custkey") % 10).cast("double").alias("tone0"))
    return focal.splat(points, "w0", "tone0").select("x", "y", F.round("weight", 5).alias("weight"), F.round("tone", 5).alias("tone"))


def nearest_confidence(spark, d):
    points = table(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") % 97 * 10).cast("double").alias("px"), (F.col("c_custkey") * 13 % 89 * 10).cast("double").alias("py"))
    targets = table(spark, d, "supplier").select((F.col("s_suppkey") * 31 % 900).cast("double").alias("px"), (F.col("s_suppkey") * 17 % 700).cast("double").alias("py"))
    return focal.confidence(points, targets, "c_custkey", 25.0).withColumn("confidence", F.round("confidence", 6))


def nearest_fill(spark, d):
    """Gaps (one cell in three, and a block in every twenty rows) filled from the nearest valid cell, ties to the first in raster order."""
    x, y = F.col("x"), F.col("y")
    gap = ((x * 7 + y * 3) % 3 == 0) | ((x >= 12) & (x < 24) & (y % 20 >= 4) & (y % 20 < 12))
    return focal.fill_nearest(_cells(spark, d).withColumn("v", F.when(~gap, F.col("v"))), "v")


# --- SQL ---------------------------------------------------------------------------------------------------------------

_A = "a as (select cast(p_partkey % 50 as int) x, cast(p_partkey // 50 as int) y, p_size::double v, case when p_size > 25 then 1 else 0 end m from part)"
_HEIGHT = "(select max(p_partkey) // 50 + 1 from part)"


def _sql_places(name, n, p):
    return f"(select n, p, o, (o + 0.5::double) * n / p - 0.5::double centre from (select n, p, unnest(range(cast(p as bigint))) o from (select {n} n, {p} p)))"


def _sql_taps(name, n, p):
    """A relation (o, s, w) of the cubic kernel's taps."""
    t = "abs(centre - k)"
    w = f"case when {t} < 1 then (7 * {t} * {t} * {t} - 12 * {t} * {t} + 16 / 3.0::double) / 6 when {t} < 2 then (-7 / 3.0::double * {t} * {t} * {t} + 12 * {t} * {t} - 20 * {t} + 32 / 3.0::double) / 6 else 0.0::double end"
    return f"{name} as (select o, least(greatest(k, 0), n - 1) s, w / sum(w) over (partition by o) w from (select *, {w} w from (select *, floor(centre) + unnest([-1, 0, 1, 2]) k from {_sql_places(name, n, p)})))"


def _sql_spline(name, n, p):
    """A relation (o, s, w) of the interpolating spline's taps: a B-spline's bumps times their coefficients, mirrored at the edge cells."""
    u = "abs(centre - k - j)"
    bump = f"case when {u} < 1 then (4 - 6 * {u} * {u} + 3 * {u} * {u} * {u}) / 6 else pow(greatest(0, 2 - {u}), 3) / 6 end"
    turn = "(k - floor(k / (2 * n - 2)::double) * (2 * n - 2))"
    return f"""{name} as (select o, least({turn}, 2 * n - 2 - {turn}) s, w / sum(w) over (partition by o) w from (select o, n, k, sum(sqrt(3) * pow(2 - sqrt(3), abs(j)) * case when abs(j) % 2 = 0 then 1 else -1 end * {bump}) w
  from (select *, floor(centre - k) + unnest([-1, 0, 1, 2]) j from (select *, floor(centre) + unnest(range(-20, 22)) k from {_sql_places(name, n, p)})) group by all))"""


def _sql_reach(diagonal):
    near = "greatest(abs(n.x - r.x), abs(n.y - r.y)) = 1" if diagonal else "abs(n.x - r.x) + abs(n.y - r.y) = 1"
    return f"""with recursive {_A}, w as (select x, y, y * 50 + x id from a where m = 1),
e as (select r.id, n.id other from w r join w n on n.x between r.x - 1 and r.x + 1 and n.y between r.y - 1 and r.y + 1 and {near}),
c as (select id, id comp from w union select e.other, c.comp from c join e on c.id = e.id where c.comp < e.other),
l as (select id % 50 x, id // 50 y, min(comp) comp from c group by id)"""


def _sql_at(axis, step):
    if step == 0:
        return "v"
    w = f"(partition by {'y' if axis == 'x' else 'x'} order by {axis}"
    whole = w + " rows between unbounded preceding and unbounded following)"
    return f"coalesce({'lead' if step > 0 else 'lag'}(v, {abs(step)}) over {w}), {'last' if step > 0 else 'first'}_value(v) over {whole})"


def _sql_pass(source, axis, weights):
    r = len(weights) // 2
    return f"(select * replace ({' + '.join(f'{w!r}::double * {_sql_at(axis, k - r)}' for k, w in enumerate(weights))} as v) from {source})"


def _sql_separable(source, weights):
    return _sql_pass(_sql_pass(source, "x", weights), "y", weights)


def _sql_box():
    out = "a"
    for r in focal.box_sizes(2.0):
        out = _sql_separable(out, focal.box(r))
    return f"with {_A} select x, y, round(v, 6) v from {out}"


def _sql_morph(start, radius, grow):
    steps, name = [], "s0"
    for k in range(radius):
        join = f"(select count(*) from {name} n where abs(n.x - c.x) + abs(n.y - c.y) <= 1 and n.m = 1)"
        steps.append(f"s{k + 1} as (select x, y, case when {join} {'> 0' if grow else '= 5'} then 1 else 0 end m from {name} c)")
        name = f"s{k + 1}"
    return f"with {_A}, s0 as (select x, y, case when {start} then 1 else 0 end m from a), {', '.join(steps)} select * from {name}"


_INSIDE = " + ".join(f"case when ({y1} > y + 0.5) <> ({y2} > y + 0.5) and x + 0.5 < {x2 - x1}::double * (y + 0.5 - {y1}) / ({y2 - y1}) + {x1} then 1 else 0 end" for (x1, y1), (x2, y2) in zip(RING, [*RING[1:], RING[0]], strict=True) if y1 != y2)
_LINES = "ln as (select s_suppkey line, i, (s_suppkey * 3 % 47 + i * 5)::double x, (s_suppkey * 11 % 31 + i * i * 3)::double y from supplier, range(4) r(i)), sg as (select * from (select line, i, x x1, y y1, lead(x) over w x2, lead(y) over w y2 from ln window w as (partition by line order by i)) where x2 is not null), sl as (select *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) len from sg)"
_TENSOR = f"""with {_A}, g as (select x, y, ({_sql_at('x', 1)} - {_sql_at('x', -1)}) / 2 gx, ({_sql_at('y', 1)} - {_sql_at('y', -1)}) / 2 gy from a),
xx as (select x, y, gx * gx v from g), xy as (select x, y, gx * gy v from g), yy as (select x, y, gy * gy v from g),
t as (select x, y, p.v xx, q.v xy, r.v yy from {_sql_separable('xx', focal.box(2))} p join {_sql_separable('xy', focal.box(2))} q using (x, y) join {_sql_separable('yy', focal.box(2))} r using (x, y))
select x, y, round(coalesce(2 * sqrt((xx - yy) / 2 * (xx - yy) / 2 + xy * xy) / nullif(xx + yy, 0), 0), 5) anisotropy from t"""
_SHADE_X, _SHADE_Y, _SHADE_Z = "(sin(radians(315)) * cos(radians(45)))", "(-cos(radians(315)) * cos(radians(45)))", "sin(radians(45))"
ORACLES = {
    "dilate": _sql_morph("v > 45", 2, True),
    "erode": _sql_morph("v > 3", 2, False),
    "boundary": f"with {_A} select x, y, exists (select 1 from a n where abs(n.x - a.x) + abs(n.y - a.y) = 1 and n.m <> a.m) edge from a",
    "touches_land": f"with {_A} select x, y, case when exists (select 1 from a n where abs(n.x - a.x) <= 1 and abs(n.y - a.y) <= 1 and n.v > 44) then 1 else 0 end touches from a where m = 1",
    "disc_dilate": f"with {_A} select x, y from a where exists (select 1 from a n where n.v > 46 and (n.x - a.x) * (n.x - a.x) + (n.y - a.y) * (n.y - a.y) <= 9)",
    "components8": f"{_sql_reach(True)} select * from l",
    "components4": f"{_sql_reach(False)} select * from l",
    "component_stats": f"{_sql_reach(True)} select comp, count(*) n, round(avg(x), 6) cx, round(avg(y), 6) cy, min(x) west, max(x) east, min(y) north, max(y) south from l group by 1",
    "despeckle": f"{_sql_reach(False)} select x, y from l where comp in (select comp from l group by 1 having count(*) >= 6)",
    "sea_connected": f"{_sql_reach(False)} select x, y from l where comp in (select comp from l where x = 0 or y = 0)",
    "chamfer": f"with {_A}, d as (select a.x, a.y, min(greatest(abs(s.x - a.x), abs(s.y - a.y)) + (sqrt(2) - 1) * least(abs(s.x - a.x), abs(s.y - a.y))) d from a, (select x, y from a where v > 45) s group by 1, 2) select x, y, round(least(d, 220), 6) dist from d",
    "bfs_grow": f"with recursive {_A}, w as (select x, y from a where m = 1), r as (select x, y, 0 n from w where x = 0 union select w.x, w.y, n + 1 from r join w on abs(w.x - r.x) + abs(w.y - r.y) = 1 where n < 12) select distinct x, y from r",
    "median3": f"with {_A}, s as (select a.x, a.y, list_sort(list(n.v)) l from a join a n on abs(n.x - a.x) <= 1 and abs(n.y - a.y) <= 1 group by 1, 2) select x, y, l[len(l) // 2 + 1] v from s",
    "gauss_sep": f"with {_A} select x, y, round(v, 6) v from {_sql_separable('a', focal.gaussian(1.2))}",
    "tent5": f"with {_A} select x, y, round(v, 6) v from {_sql_separable('a', focal.TENT)}",
    "box_blur": _sql_box(),
    "max_filter": f"with {_A} select a.x, a.y, max(n.v) v from a join a n on abs(n.x - a.x) <= 3 and abs(n.y - a.y) <= 3 group by 1, 2",
    "gradient": f"with {_A} select x, y, ({_sql_at('x', 1)} - {_sql_at('x', -1)}) / 2 gx, ({_sql_at('y', 1)} - {_sql_at('y', -1)}) / 2 gy from a",
    "laplacian": f"with {_A} select x, y, 4 * v - {_sql_at('x', 1)} - {_sql_at('x', -1)} - {_sql_at('y', 1)} - {_sql_at('y', -1)} ridge from a",
    "hillshade": f"with {_A}, g as (select x, y, ({_sql_at('x', 1)} - {_sql_at('x', -1)}) / 2 gx, ({_sql_at('y', 1)} - {_sql_at('y', -1)}) / 2 gy from a) select x, y, round(greatest(0, ({_SHADE_Z} - gx * {_SHADE_X} - gy * {_SHADE_Y}) / sqrt(1 + gx * gx + gy * gy)), 6) shade from g",
    "structure_tensor": _TENSOR,
    "block_avg": f"with {_A} select cast(x // 5 as bigint) x, cast(y // 4 as bigint) y, round(avg(v), 6) v from a group by 1, 2",
    "nearest_resize": f"with {_A}, n as (select {_HEIGHT} n, greatest(1, {_HEIGHT} * 17 // 40) p), o as (select i x, unnest(range(cast(p as bigint))) y, n, p from n, range(33) q(i)) select o.x, o.y, a.v from o join a on a.x = o.x * 50 // 33 and a.y = o.y * n // p",
    "bilinear": f"with {_A}, n as (select {_HEIGHT} n), p as (select s_suppkey, s_suppkey * 0.49::double % 49 px, s_suppkey * 7 % greatest(1, n - 1) + 0.25::double py, n from supplier, n), t as (select *, case when i = 1 then px - floor(px) else 1 - (px - floor(px)) end * case when j = 1 then py - floor(py) else 1 - (py - floor(py)) end w, least(greatest(floor(px) + i, 0), 49) tx, least(greatest(floor(py) + j, 0), n - 1) ty from p, range(2) q(i), range(2) z(j)) select s_suppkey, round(sum(w * v), 6) v from t join a on a.x = tx and a.y = ty group by 1",
    "mitchell": f"with {_A}, {_sql_taps('tx', '50', '80')}, {_sql_taps('ty', _HEIGHT, f'{_HEIGHT} * 8 // 5')}, h as (select tx.o x, a.y, sum(w * v) v from a join tx on a.x = tx.s group by 1, 2) select x, cast(ty.o as bigint) y, round(sum(w * v), 6) v from h join ty on h.y = ty.s group by 1, 2",
    "priority_mosaic": f"""with {_A}, k as (select *, x + y * 50 k from a), b as (select *, case when k % 11 <> 0 then v end e0 from k), c as (select *, case when k % 3 = 0 then v + 5 else e0 end e1 from b),
e as (select *, case when k % 5 >= 2 then e1 when e1 is null then v * 2 else e1 * (1 - k % 7 / 6.0::double) + v * 2 * (k % 7 / 6.0::double) end e2 from c) select x, y, round(case when k % 13 <> 0 then e2 when e2 is null then -1 else e2 * 0.5 - 0.5 end, 6) v from e""",
    "masked_flatten": f"with {_A}, p as (select x, y, v * m v from a), q as (select x, y, m::double v from a) select x, y, round(case when m = 1 then a.v * coalesce(pow(least(greatest(30 / nullif(l.v / nullif(n.v, 0), 0), 0.72), 1.45), 0.75::double), 1) else a.v end, 6) v from a join {_sql_separable('p', focal.gaussian(1.5))} l using (x, y) join {_sql_separable('q', focal.gaussian(1.5))} n using (x, y)",
    "pip_mask": f"with {_A} select x, y from a where ({_INSIDE}) % 2 = 1",
    "densify": f"with {_LINES}, n as (select *, cast(greatest(1, ceil(len / 1.5)) as int) n from sl), k as (select *, unnest(range(n)) k from n) select line, i, cast(k as int) k, round(x1 + (x2 - x1) * k / n, 6) x, round(y1 + (y2 - y1) * k / n, 6) y from k",
    "line_raster": f"with {_LINES}, b as (select *, unnest(range(cast(floor(least(x1, x2) - 1) as bigint), cast(ceil(greatest(x1, x2) + 2) as bigint))) px from sl), c0 as (select *, unnest(range(cast(floor(least(y1, y2) - 1) as bigint), cast(ceil(greatest(y1, y2) + 2) as bigint))) py from b), c as (select *, least(greatest(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (len * len), 0), 1) t from c0) select cast(px as int) x, cast(py as int) y, max(line % 9)::double weight from c where sqrt(pow(px - x1 - t * (x2 - x1), 2) + pow(py - y1 - t * (y2 - y1), 2)) <= 0.75 group by 1, 2",
    "arc_lamps": f"with {_LINES}, e as (select *, sum(len) over (partition by line order by i) fin from sl), k as (select *, fin - len ini, unnest(range(60)) k from e) select line, k, round(x1 + (x2 - x1) * (0.4 + k * 2.7 - ini) / len, 5) x, round(y1 + (y2 - y1) * (0.4 + k * 2.7 - ini) / len, 5) y from k where 0.4 + k * 2.7 >= ini and 0.4 + k * 2.7 < fin",
    "splat": "with p as (select c_custkey % 40 + 0.3::double px, c_custkey * 7 % 30 + 0.6::double py, (c_custkey % 10)::double tone from customer), s as (select cast(floor(px) as bigint) + i x, cast(floor(py) as bigint) + j y, tone, exp(-(pow(floor(px) + i + 0.5 - px, 2) + pow(floor(py) + j + 0.5 - py, 2)) / 0.98) w from p, range(-1, 2) a(i), range(-1, 2) b(j)) select x, y, round(sum(w), 5) weight, round(sum(w * tone) / sum(w), 5) tone from s group by 1, 2",
    "nearest_confidence": "with p as (select c_custkey, (c_custkey % 97 * 10)::double px, (c_custkey * 13 % 89 * 10)::double py from customer), t as (select (s_suppkey * 31 % 900)::double tx, (s_suppkey * 17 % 700)::double ty from supplier) select c_custkey, round(exp(-min(pow(px - tx, 2) + pow(py - ty, 2)) / 625), 6) confidence from p, t group by 1",
    "nearest_fill": f"with {_A}, g as (select *, (x * 7 + y * 3) % 3 = 0 or (x >= 12 and x < 24 and y % 20 >= 4 and y % 20 < 12) gap from a) select g.x, g.y, n.v from (select * from g where gap) g join (select * from g where not gap) n on true qualify row_number() over (partition by g.x, g.y order by (n.x - g.x) * (n.x - g.x) + (n.y - g.y) * (n.y - g.y), n.y, n.x) = 1",
    # A cell's distance is replaced while a shorter one is found.
    "geodesic": f"""with recursive {_A}, w as (select x, y from a where m = 1), d(x, y, dist) using key (x, y) as (select x, y, 0.0::double from w where x % 10 = 0
  union (select n.x, n.y, min(d.dist + case when n.x <> d.x and n.y <> d.y then 1.562 when n.x <> d.x then 1.0 else 1.2 end::double) from d join w n on abs(n.x - d.x) <= 1 and abs(n.y - d.y) <= 1 and (n.x <> d.x or n.y <> d.y)
    left join recurring.d o on o.x = n.x and o.y = n.y where o.dist is null or d.dist + case when n.x <> d.x and n.y <> d.y then 1.562 when n.x <> d.x then 1.0 else 1.2 end::double < o.dist - 1e-9 group by n.x, n.y))
select x, y, round(dist, 6) dist from d""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
