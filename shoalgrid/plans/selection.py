"""The waterline workflow on the planted stack: threshold rules, lag grids, nested selection, ablation, the fit in two passes, the harbour mask and cleaning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shoalgrid.lineage import cut
from shoalgrid.operators import focal, grid, scenes, stepfit
from shoalgrid.plans.raster import _INSIDE, RING
from shoalgrid.plans.scenes import PLACES, _sql_otsu
from shoalgrid.plans.waterline import _CLS, _IOU, _OBS, _PLACES, _WET, GRID, N, _grid_scores, _level, _sql_grid, _sql_loo, _tide, bin_orders, classes, lag_bin, pack, packed_classes, packed_stack, placed, spectral_classes, stack, tides

RULES = ("frame", "frame_median", "harbour", "harbour_median", "fixed")
TAUS = (0, 30, 45, 60, 70, 80, 90, 100, 110, 120)
CLOUD_GRID = [(tau0, slope) for tau0 in (0, 20, 40, 60, 80, 100) for slope in (0, 1, 2, 3, 4, 6, 8)]
#: Scenes with few clouds are two in three; of 30 these are 20.
CLEAN, CLEAN_N = "scene % 3 < 2", 20
CLEAN_SQL = CLEAN


def _clean(scene):
    return scene % 3 < 2


TAU0, SLOPE = 40, 2
SEA, INLAND, RADII = (12, 10), (32, 10), (1, 2, 3)


def _gray_at(size, p):
    """Bright where the tide stands above the pixel."""
    return F.least(F.greatest(F.floor((_tide(p) - _level(size, p)) / 16) + 128, F.lit(0)), F.lit(255)).cast("int")


def gray_stack(spark, d):
    """The stack's brightness."""
    return stack(spark, d, keep=("p_size",)).select("pixel", "p", "v", _gray_at(F.col("p_size"), F.col("p")).alias("gray"))


def _thresholds(rows, names=RULES):
    """rule, p and threshold of each scene: Otsu's on the frame and on the harbour (the raster's west half), the upper medians of both over all scenes, and a fixed one. Rows are read once, for
    their histograms."""
    west = (F.col("pixel") % 50 < 25).alias("west")
    counts = cut(rows.filter("v = 1").groupBy("p", "gray", west).agg(F.count(F.lit(1)).alias("n")), "histograms")
    otsu = lambda part: scenes.otsu(part.groupBy("p", "gray").agg(F.sum("n").alias("n")), ["p"])
    out = None
    for name, own in (("frame", otsu(counts)), ("harbour", otsu(counts.filter("west")))):
        middle = scenes.upper_median(own.select(F.lit(1).alias("one"), "threshold"), ["one"], "threshold").select(F.col("threshold").alias("middle"))
        both = own.crossJoin(F.broadcast(middle)).select("p", F.explode(F.array(F.struct(F.lit(name).alias("rule"), F.col("threshold")), F.struct(F.lit(f"{name}_median").alias("rule"), F.col("middle").cast("int").alias("threshold")))).alias("r"))
        both = both.select("r.rule", "p", "r.threshold")
        out = both if out is None else out.unionByName(both)
    fixed = rows.sparkSession.range(N).select(F.lit("fixed").alias("rule"), F.col("id").cast("int").alias("p"), F.lit(128).alias("threshold"))
    return out.unionByName(fixed).filter(F.col("rule").isin(*names))


def _ruled(spark, d, names=RULES, of="true"):
    """rule, pixel, codes: the stack's masks by each rule, of the pixels of a condition. Thresholds are a parameter of the function: a number for each rule and scene."""
    table_of = {name: np.full(N, -1) for name in names}  # -1: a scene without a threshold
    for r in _thresholds(gray_stack(spark, d), names).collect():
        table_of[r["rule"]][r["p"]] = r["threshold"]

    def wet(level, tide, rule):
        gray = np.clip((tide - level) // 16 + 128, 0, 255)
        return gray > table_of[rule], table_of[rule] >= 0

    return pack(spark, d, wet, names=names, of=of)


def threshold_experiment(spark, d):
    """Five rules for the water's threshold by their held-out scores on the pixels that each finds intertidal, in the harbour."""
    rows = _ruled(spark, d, of="pixel % 50 < 25")
    full = stepfit.classify(stepfit.fit(rows, N, ("rule", "pixel", "codes")), tides(spark), N)
    counts = full.groupBy("rule").agg(*[F.sum((F.col("cls") == c).cast("int")).alias(n) for n, c in (("subtidal", 0), ("intertidal", 128), ("supratidal", 255))])
    scored = stepfit.held_out_confusion(full.filter("cls = 128"), N, ("rule", "pixel"), ("rule",))
    scored = scored.groupBy("rule").agg(F.round(F.avg(stepfit.overlap()), 6).alias("iou"), F.round(F.min(stepfit.overlap()), 6).alias("least"), F.round(F.avg(stepfit.agreement()), 5).alias("agree"))
    return counts.join(scored, "rule")


def reference_pixels(spark, d):
    return classes(spark, d).filter("cls = 128").select("pixel")


def rule_lag_grid(spark, d):
    """Two rules by ten uniform lags, scored on the fixed set of intertidal pixels. Lags that round to one bin share an order."""
    bins = {t: int(t / 5 + 0.5) for t in TAUS}
    rows = _ruled(spark, d, ("frame", "frame_median")).join(reference_pixels(spark, d).hint("merge"), "pixel", "left_semi")
    every = sorted(set(bins.values()))
    scores = stepfit.held_out_orders(rows.withColumn("of", (F.col("rule") == "frame").cast("int")), N, "of", bin_orders(every), {0: every, 1: every}, ("pixel", "rule"))
    dealt = spark.createDataFrame(list(bins.items()), "tau int, `order` int")
    scores = scores.withColumn("rule", F.when(F.col("of") == 1, "frame").otherwise("frame_median")).join(F.broadcast(dealt), "order")
    return scores.groupBy("rule", "tau").agg(F.round(F.avg(stepfit.overlap()), 6).alias("iou"))


def _reference_obs(spark, d):
    """pixel and codes of the intertidal pixels."""
    return packed_classes(spark, d).filter("cls = 128").select("pixel", "codes")


def cloud_lag_grid(spark, d):
    """Fits on all scenes and on those with few clouds, each scored on the scenes it is fitted on, for every lag and slope; a fixed set of pixels."""
    obs = _reference_obs(spark, d)
    every = _grid_scores(spark, d, CLOUD_GRID, obs=obs).withColumn("cloud", F.lit(20))
    clean = _grid_scores(spark, d, CLOUD_GRID, _clean, obs).withColumn("cloud", F.lit(5))
    return every.unionByName(clean).groupBy("cloud", "tau0", "slope").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("iou"), 6).alias("iou"))


def final_grid(spark, d):
    """Fitted on all scenes, scored on those with few clouds."""
    return _grid_scores(spark, d, obs=_reference_obs(spark, d)).filter(CLEAN).groupBy("tau0", "slope").agg(F.round(F.avg("iou"), 6).alias("iou"))


def nested_selection(spark, d):
    """Lag and slope chosen on one half of the clean scenes and scored on the other, both ways, beside the best uniform lag chosen the same way; and the means of the held-out scores (half -1)."""
    half = F.floor(F.col("scene") / 2) % 2
    mean = _grid_scores(spark, d, obs=_reference_obs(spark, d)).filter(CLEAN).groupBy("tau0", "slope", half.alias("half")).agg(F.round(F.avg("iou"), 6).alias("iou"))
    kinds = mean.withColumn("kind", F.explode(F.when(F.col("slope") == 0, F.array(F.lit("spatial"), F.lit("uniform"))).otherwise(F.array(F.lit("spatial")))))
    best = scenes.first_by(kinds, ["kind", "half"], [F.col("iou").desc(), "tau0", "slope"]).select("kind", "tau0", "slope", (1 - F.col("half")).alias("half"), F.col("iou").alias("chosen"))
    rows = best.join(mean, ["tau0", "slope", "half"]).select("kind", "half", "tau0", "slope", "chosen", F.col("iou").alias("held_out"))
    whole = rows.groupBy("kind").agg(F.round(F.avg("held_out"), 6).alias("held_out"))
    none = lambda c: F.lit(None).cast("int").alias(c)
    return rows.unionByName(whole.select("kind", F.lit(-1).cast("long").alias("half"), none("tau0"), none("slope"), F.lit(None).cast("double").alias("chosen"), "held_out"))


#: label, scenes fitted on, their number, lag and slope; all scored on the clean ones among them.
ABLATION = (("before", f"{CLEAN} and scene >= 10", 13, 80, 0), ("uniform", "true", N, 60, 0), ("after", "true", N, TAU0, SLOPE))
_CHOSEN = {"before": lambda s: _clean(s) and s >= 10, "uniform": lambda s: True, "after": lambda s: True}


def ablation(spark, d):
    """Three settings scored on clean scenes: held-out overlap of water and land, agreement. A setting's scores, a row a scene, are kept: mean and median come from one pass over the stack."""
    out = None
    for label, _, n, tau0, slope in ABLATION:
        rows = cut(_grid_scores(spark, d, [(tau0, slope)], _CHOSEN[label], _reference_obs(spark, d)).filter(CLEAN), "scores")
        rows = rows.withColumns({"land": stepfit.land_overlap(), "agree": stepfit.agreement()})
        middle = scenes.upper_median(rows.select(F.lit(1).alias("one"), "iou"), ["one"], "iou").select(F.round("iou", 6).alias("median"))
        one = rows.agg(F.lit(label).alias("label"), F.lit(n).alias("n_fit"), F.count(F.lit(1)).alias("n_scored"), F.round(F.avg("iou"), 6).alias("iou"), F.round(F.avg("land"), 6).alias("land_iou"), F.round(F.avg("agree"), 5).alias("agree")).crossJoin(middle)
        out = one if out is None else out.unionByName(one)
    return out


def _cells_of(rows):
    return rows.withColumns({"x": (F.col("pixel") % 50).cast("int"), "y": F.floor(F.col("pixel") / 50).cast("int")})


def ocean_seed():
    """Water outside the polygon is open sea."""
    return ~focal.inside(F.col("x") + F.lit(0.5), F.col("y") + F.lit(0.5), RING)


def along_channel(spark, d, cls=None):
    """pixel, dist: the way from the open sea through what the first fit (cls, if that is there) finds wet."""
    water = _cells_of((classes(spark, d) if cls is None else cls).filter("cls in (0, 128)").select("pixel"))
    way = grid.distance(water, ocean_seed(), 1.0, 1.0, 2**0.5)
    return way.filter(F.col("dist") < float("inf")).select((F.col("y").cast("long") * 50 + F.col("x")).alias("pixel"), "dist")


def _lagged(bin):
    """The scenes by their lagged tide in a bin, as an array of level and scene; a function of the bin alone, so no table of bins is joined, most pixels having the same one."""
    level = lambda scene: (_tide(scene) * 10 - bin * (scene % 3) * 40).alias("level")
    return F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda scene: F.struct(level(scene), scene.alias("scene"))))


def two_pass_fit(spark, d):
    """A fit with one lag for all gives the water, its way to the sea gives each pixel its lag, and the second fit takes the scenes in the order of that. Pixels without a way have none to add."""
    far = packed_stack(spark, d).join(along_channel(spark, d).hint("merge"), "pixel", "left")
    lags = far.select("pixel", "codes", lag_bin(F.lit(TAU0), F.lit(SLOPE), F.coalesce("dist", F.lit(0.0))).alias("bin"))
    place = lambda order, c: (F.array_position(order, F.shiftright(c, 2)).cast("int") - 1) * 4 + c % 4
    again = F.transform(F.array(_lagged(F.col("bin"))["scene"]), lambda order: F.transform("codes", lambda c: place(order, c)))[0]
    fits = stepfit.fit(lags.select("bin", "pixel", F.sort_array(again).alias("codes")), N, ("bin", "pixel"))
    cls = F.when(F.col("valid") < stepfit.LEAST_VALID, stepfit.NODATA).when(F.col("k") == 0, stepfit.SUBTIDAL).when(F.col("k") == N, stepfit.SUPRATIDAL).otherwise(stepfit.INTERTIDAL)
    middle = F.transform(F.array(_lagged(F.col("bin"))["level"]), lambda levels: (F.get(levels, F.col("k") - 1) + F.get(levels, F.col("k"))) / F.lit(2.0))[0]
    out = fits.withColumn("cls", cls)
    return out.select("pixel", "bin", "cls", F.when(F.col("cls") == stepfit.INTERTIDAL, middle).alias("height"), "misfit")


def place_audit(spark, d):
    """Score, error rate, mean misfit and mean way to the sea of each place's intertidal pixels."""
    at = placed(spark, packed_classes(spark, d).filter("cls = 128").select("pixel", "codes", "misfit"))
    far = at.select("pixel", "place", "misfit").join(along_channel(spark, d).hint("merge"), "pixel", "left")
    far = far.groupBy("place").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.avg("misfit"), 6).alias("misfit"), F.round(F.avg("dist"), 5).alias("dist"))
    counts = stepfit.held_out_confusion(at, N, ("place", "pixel"), ("place",)).groupBy("place").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    rate = F.try_divide((F.col("fp") + F.col("fn")).cast("double"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return counts.select("place", F.round(stepfit.overlap(), 6).alias("iou"), F.round(rate, 6).alias("error_rate")).join(far, "place")


def _basins(spark, d):
    """Two basins with a channel three cells wide in every forty rows, and islands."""
    x, y = F.col("p_partkey") % 50, F.floor(F.col("p_partkey") / 50)
    wet = ((x <= 20) | (x >= 26) | ((y % 40 >= 18) & (y % 40 <= 20))) & ~((F.col("p_size") == 50) & (x % 10 >= 5))
    return spark.read.parquet(f"{d}/part.parquet").select(x.cast("int").alias("x"), y.cast("int").alias("y"), wet.cast("int").alias("m"))


def erosion_radius(spark, d):
    """By how many cells the water must shrink until sea and harbour part, and into how many components."""
    found = grid.separating_radius(_basins(spark, d).filter("m = 1"), SEA, INLAND, RADII)
    if found is None:
        return spark.createDataFrame([], "radius int, components long, cells long")
    radius, parts = found
    return parts.agg(F.lit(radius).alias("radius"), F.countDistinct("comp").alias("components"), F.count(F.lit(1)).alias("cells"))


def harbour_mask(spark, d):
    return grid.enclosed_water(_basins(spark, d), SEA, INLAND, RADII)


def clean_classes(spark, d):
    """Classes before and after: intertidal pixels that don't look like water when covered go to land, then all water that the sea (the first column) doesn't reach."""
    cls = spectral_classes(spark, d)
    water = _cells_of(cls.filter("cls_after in (0, 128)").select("pixel"))
    sea = grid.connected_to(water, F.col("x") == 0).select((F.col("y").cast("long") * 50 + F.col("x")).alias("pixel"), F.lit(1).alias("sea"))
    after = F.when(F.col("cls_after").isin(0, 128) & F.col("sea").isNull(), 255).otherwise(F.col("cls_after"))
    return cls.join(sea.hint("merge"), "pixel", "left").groupBy("cls_before", after.alias("cls_after")).agg(F.count(F.lit(1)).alias("n"))


def component_audit(spark, d):
    """Intertidal components of five cells or more: centre, box, misfit, and the shares inside the polygon, on the way to the sea and beside land; and what that makes them."""
    cls = cut(classes(spark, d).select("pixel", "cls", "misfit"), "classes")
    inter = _cells_of(cls.filter("cls = 128").select("pixel", "misfit")).select("x", "y", "misfit")
    near = grid.touches(_cells_of(cls.select("pixel", (F.col("cls") == 255).cast("int").alias("land"))).select("x", "y", "land"), "land").select("x", "y", "_near")
    far = _cells_of(along_channel(spark, d, cls)).select("x", "y", F.lit(1).alias("reached"))
    rows = grid.components(inter.select("x", "y")).join(inter.hint("merge"), ["x", "y"]).join(near.hint("merge"), ["x", "y"]).join(far.hint("merge"), ["x", "y"], "left")
    share = lambda c: F.avg(c.cast("double"))
    ring = focal.inside(F.col("x") + F.lit(0.5), F.col("y") + F.lit(0.5), RING)
    stats = rows.groupBy("comp").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"), F.avg("misfit").alias("misfit"),
        share(ring).alias("inside"), share(F.coalesce("reached", F.lit(0))).alias("connected"), share(F.col("_near")).alias("shore"),
    ).filter("n >= 5")
    verdict = F.when(F.col("connected") < 0.02, "flood").when(F.col("inside") >= 0.5, "fringe").when(F.col("shore") > 0.25, "beach").otherwise("glint")
    return stats.select((F.col("comp.y").cast("long") * 50 + F.col("comp.x")).alias("comp"), "n", "span", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "misfit", "inside", "connected", "shore")], verdict.alias("verdict"))


# --- SQL ---------------------------------------------------------------------------------------------------------------

_GRAY = "gs0 as (select pixel, p, v, cast(least(greatest(floor((tide - (p_size * 60 - 400 + ((pixel * 31 + p * 17) % 11 - 5) * 40)) / 16.0) + 128, 0), 255) as int) gray from o1)"


def _sql_rules(names=RULES):
    parts = []
    for name, where in (("frame", "true"), ("harbour", "pixel % 50 < 25")):
        own = f"(select p, threshold from {_sql_otsu(f'(select p, gray, count(*) n from gs0 where v = 1 and {where} group by all)', 'p')})"
        parts.append(f"select '{name}' rule, p, threshold from {own}")
        parts.append(f"select '{name}_median', p, (select threshold from (select threshold, row_number() over (order by threshold) - 1 i, count(*) over () n from {own}) where i = n // 2) from {own}")
    parts.append("select 'fixed', cast(p as int), 128 from range(30) r(p)")
    return f"th as (select * from ({' union all '.join(parts)}) where rule in ({', '.join(repr(n) for n in names)}))"


_RULED = "ru as (select rule, pixel, gs0.p, v, v * case when gray > threshold then 1 else 0 end w from gs0 join th using (p))"
_REF = "rf as (select pixel from cls where cls = 128), ro as (select obs.* from obs join rf using (pixel))"
_AGREE = "coalesce(100.0::double * (tp + tn) / nullif(tp + fp + fn + tn, 0), 100)"
_LAND = "tn::double / nullif(tn + fp + fn, 0)"


def _sql_classes(source, by, name):
    """cls of every pixel of a relation (by, pixel, p, v, w)."""
    loo = _sql_loo(source, by, f"{name}q")
    k = "cast(floor((min(err * 1000 + p) % 1000 + 1000 * cast(floor(min(err * 1000 + p) / 1000.0) as bigint) - min(err * 1000 - p)) / 2.0) as int)"
    return f"""{loo}, {name} as (select *, case when valid < 10 then 64 when k = 0 then 0 when k = 30 then 255 else 128 end cls from (select {by}, {k} k, cast(min(err) as bigint) misfit, cast(sum(v) as bigint) valid from {name}qe group by {by}))"""


def _sql_way(water, seeds):
    """A relation wd (x, y, dist): shortest ways through water from seeds. Needs `with recursive`."""
    cost = "case when n.x <> d.x and n.y <> d.y then sqrt(2) else 1.0 end"
    return f"""ww as ({water}), wd(x, y, dist) using key (x, y) as (select x, y, 0.0::double from ww where {seeds}
  union (select n.x, n.y, min(d.dist + {cost}) from wd d join ww n on abs(n.x - d.x) <= 1 and abs(n.y - d.y) <= 1 and (n.x <> d.x or n.y <> d.y)
    left join recurring.wd o on o.x = n.x and o.y = n.y where o.dist is null or d.dist + {cost} < o.dist - 1e-9 group by n.x, n.y))"""


_WAY = _sql_way("select pixel % 50 x, pixel // 50 y from cls where cls in (0, 128)", f"({_INSIDE}) % 2 = 0")
_FAR = f"{_WAY}, far as (select y * 50 + x pixel, dist from wd)"


def sql_components(cells, name):
    """A relation (x, y, comp) of the components (eight neighbours) of a relation's cells. Needs `with recursive`."""
    return f"""{name}(x, y, comp) using key (x, y) as (select x, y, y * 50 + x from {cells}
  union (select n.x, n.y, min(c.comp) from {name} c join {cells} n on abs(n.x - c.x) <= 1 and abs(n.y - c.y) <= 1 and (n.x <> c.x or n.y <> c.y) join recurring.{name} o on o.x = n.x and o.y = n.y where c.comp < o.comp group by n.x, n.y))"""


def _sql_diamond(source, name, radius, grow):
    cells = f"select c.x, c.y, count(*) n from (select x, y from {source}) c join {source} o on abs(o.x - c.x) + abs(o.y - c.y) <= {radius} and o.m = 1 group by all"
    full = 2 * radius * (radius + 1) + 1
    return f"{name} as (select x, y, 1 m from ({cells}){'' if grow else f' where n = {full}'})"


_BASINS = "ba as (select cast(p_partkey % 50 as int) x, cast(p_partkey // 50 as int) y, case when (p_partkey % 50 <= 20 or p_partkey % 50 >= 26 or (p_partkey // 50 % 40 between 18 and 20)) and not (p_size = 50 and p_partkey % 10 >= 5) then 1 else 0 end m from part), bw as (select x, y, m from ba where m = 1)"
_RADII = ", ".join(f"{_sql_diamond('ba', f'er{r}', r, False)}, {sql_components(f'er{r}', f'ec{r}')}" for r in RADII)
_NEAR = f"order by greatest(abs(x - {INLAND[0]}), abs(y - {INLAND[1]})), y, x limit 1"
_PARTED = "pt as (" + " union all ".join(f"select {r} r, (select comp from ec{r} where x = {SEA[0]} and y = {SEA[1]}) sea, (select comp from ec{r} {_NEAR}) inl" for r in RADII) + "), rr as (select min(r) r from pt where sea <> inl)"
_EROSION = f"with recursive {_BASINS}, {_RADII}, {_PARTED}, al as ({' union all '.join(f'select {r} r, * from ec{r}' for r in RADII)})"
_SEA_BACK = ", ".join(f"se{r} as (select x, y, 1 m from ec{r} where comp = (select sea from pt where r = {r})), bk{r} as (select distinct c.x, c.y from ba c join se{r} o on abs(o.x - c.x) + abs(o.y - c.y) <= {r})" for r in RADII)
_DEMOTED = "wm as (select pixel, count(*) n, avg((pixel * 3 + p * 5) % 256) mean from obs join (select pixel, height from cls where cls = 128) using (pixel) where v = 1 and tide > height group by 1 having count(*) >= 3), dm as (select pixel, cls cls_before, case when cls = 128 and round(mean, 6) < 100 then 255 else cls end cls_after from cls left join wm using (pixel))"
_CLASSED_TWICE = f"""lg as (select pixel, cast(floor(({TAU0} + {SLOPE} * coalesce(dist, 0)) / 5::double + 0.5) as int) bin from cls left join far using (pixel)),
lo as (select bin, scene, level, row_number() over (partition by bin order by level, scene) - 1 p from (select bin, scene, scene * 2300 // 29 * 10 - bin * (scene % 3) * 40 as level from (select distinct bin from lg), range({N}) q(scene))),
lb as (select bin, pixel, lo.p, v, w from (select pixel, p scene, v, w from obs) join lg using (pixel) join lo using (bin, scene)), {_sql_classes('lb', 'bin, pixel', 'tw')}"""


def _sql_ablation(label, chosen, n, tau0, slope):
    return f"(with {_OBS}, {_CLS}, {_REF}, {_sql_grid([(tau0, slope)], 'g', chosen, n, 'ro')}, z as (select *, {_LAND} land, {_AGREE} agree, row_number() over (order by iou) - 1 i, count(*) over () c from gi where {CLEAN_SQL}) select '{label}' as label, {n} n_fit, count(*) n_scored, round(avg(iou), 6) iou, round(avg(land), 6) land_iou, round(avg(agree), 5) agree, round(max(case when i = c // 2 then iou end), 6) median from z)"


ORACLES = {
    "threshold_experiment": f"""with {_OBS}, {_GRAY}, {_sql_rules()}, {_RULED}, rh as (select * from ru where pixel % 50 < 25), {_sql_classes('rh', 'rule, pixel', 'rc')},
ri as (select rh.* from rh join (select rule, pixel from rc where cls = 128) using (rule, pixel)), {_sql_loo('ri', 'rule, pixel', 'rl')}, rs as (select rule, p, {_WET} from rl group by all)
select * from (select rule, cast(sum(case when cls = 0 then 1 else 0 end) as bigint) subtidal, cast(sum(case when cls = 128 then 1 else 0 end) as bigint) intertidal, cast(sum(case when cls = 255 then 1 else 0 end) as bigint) supratidal from rc group by 1)
join (select rule, round(avg({_IOU}), 6) iou, round(min({_IOU}), 6) least, round(avg({_AGREE}), 5) agree from rs group by 1) using (rule)""",
    "rule_lag_grid": f"""with {_OBS}, {_CLS}, {_REF}, {_GRAY}, {_sql_rules(('frame', 'frame_median'))}, {_RULED}, tg as (select tau, cast(floor(tau / 5::double + 0.5) as bigint) bin from (values {', '.join(f'({t})' for t in TAUS)}) v(tau)),
tr as (select bin, scene, row_number() over (partition by bin order by level, scene) - 1 p from (select bin, scene, scene * 2300 // 29 * 10 - bin * (scene % 3) * 40 as level from (select distinct bin from tg), range({N}) q(scene))),
tp0 as (select rule, bin, pixel, tr.p, v, w from (select rule, pixel, p scene, v, w from ru join rf using (pixel)) join tr using (scene)), {_sql_loo('tp0', 'rule, bin, pixel', 'tl')}, ts as (select rule, bin, p, {_WET} from tl group by all)
select rule, tau, round(avg({_IOU}), 6) iou from ts join tg using (bin) group by all""",
    "cloud_lag_grid": f"with {_OBS}, {_CLS}, {_REF}, {_sql_grid(CLOUD_GRID, 'ga', obs='ro')}, {_sql_grid(CLOUD_GRID, 'gc', CLEAN_SQL, CLEAN_N, 'ro')} select cloud, tau0, slope, count(*) n, round(avg(iou), 6) iou from (select 20 cloud, tau0, slope, iou from gai union all select 5, tau0, slope, iou from gci) group by all",
    "final_grid": f"with {_OBS}, {_CLS}, {_REF}, {_sql_grid(obs='ro')} select tau0, slope, round(avg(iou), 6) iou from gi where {CLEAN_SQL} group by all",
    "nested_selection": f"""with {_OBS}, {_CLS}, {_REF}, {_sql_grid(obs='ro')}, hm as (select tau0, slope, scene // 2 % 2 half, round(avg(iou), 6) iou from gi where {CLEAN_SQL} group by all),
hk as (select 'spatial' kind, * from hm union all select 'uniform', * from hm where slope = 0), hb as (select kind, tau0, slope, 1 - half half, iou chosen from hk qualify row_number() over (partition by kind, half order by iou desc, tau0, slope) = 1),
hr as (select kind, half, tau0, slope, chosen, iou held_out from hb join hm using (half, tau0, slope)) select * from hr union all select kind, -1, null, null, null, round(avg(held_out), 6) from hr group by kind""",
    "ablation": " union all ".join(_sql_ablation(*a) for a in ABLATION),
    "two_pass_fit": f"with recursive {_OBS}, {_CLS}, {_FAR}, {_CLASSED_TWICE} select pixel, bin, cls, case when cls = 128 then (a.level + b.level) / 2.0::double end height, misfit from tw left join (select bin, p + 1 k, level from lo) a using (bin, k) left join (select bin, p k, level from lo) b using (bin, k)",
    "place_audit": f"""with recursive {_OBS}, {_CLS}, {_FAR}, pa as (select pixel, place, misfit from cls join (values {_PLACES}) q(place, w0, s0, e0, n0) on pixel % 50 between w0 and e0 and pixel // 50 between s0 and n0 where cls = 128),
po as (select place, pixel, p, v, w from obs join pa using (pixel)), {_sql_loo('po', 'place, pixel', 'pl')}, ps as (select place, {_WET} from pl group by 1)
select place, round({_IOU}, 6) iou, round((fp + fn)::double / nullif(tp + fp + fn + tn, 0), 6) error_rate, pixels, misfit, dist from ps join (select place, count(*) pixels, round(avg(misfit), 6) misfit, round(avg(dist), 5) dist from pa left join far using (pixel) group by 1) using (place)""",
    "erosion_radius": f"{_EROSION} select r radius, count(distinct comp) components, count(*) cells from al join rr using (r) group by 1",
    "harbour_mask": f"""{_EROSION}, {_SEA_BACK}, bk as ({' union all '.join(f'select {r} r, * from bk{r}' for r in RADII)}), re as (select x, y, 1 m from bw where not exists (select 1 from bk join rr using (r) where bk.x = bw.x and bk.y = bw.y)), {sql_components('re', 'rec')},
hc as (select comp from rec group by comp order by max(case when x = {INLAND[0]} and y = {INLAND[1]} then 1 else 0 end) desc, count(*) desc, comp limit 1), hw as (select x, y from rec where comp = (select comp from hc))
select distinct c.x, c.y from ba c join hw on abs(hw.x - c.x) + abs(hw.y - c.y) <= 2 where (select r from rr) is not null""",
    "clean_classes": f"with recursive {_OBS}, {_CLS}, {_DEMOTED}, dw as (select pixel % 50 x, pixel // 50 y from dm where cls_after in (0, 128)), {sql_components('dw', 'dc')}, ds as (select y * 50 + x pixel from dc where comp in (select comp from dc where x = 0)) select cls_before, case when cls_after in (0, 128) and ds.pixel is null then 255 else cls_after end cls_after, count(*) n from dm left join ds using (pixel) group by all",
    "component_audit": f"""with recursive {_OBS}, {_CLS}, {_FAR}, ci as (select pixel % 50 x, pixel // 50 y, misfit from cls where cls = 128), {sql_components('ci', 'cc')},
cn as (select distinct c.x, c.y from ci c join (select pixel % 50 x, pixel // 50 y from cls where cls = 255) l on abs(l.x - c.x) <= 1 and abs(l.y - c.y) <= 1),
cr as (select comp, x, y, misfit, case when ({_INSIDE}) % 2 = 1 then 1 else 0 end ring, case when wd.dist is not null then 1 else 0 end reached, case when cn.x is not null then 1 else 0 end shore from cc join ci using (x, y) left join wd using (x, y) left join cn using (x, y)),
cs as (select comp, count(*) n, greatest(max(x) - min(x), max(y) - min(y)) span, avg(x) cx, avg(y) cy, avg(misfit) misfit, avg(ring) inside, avg(reached) connected, avg(shore) shore from cr group by 1 having count(*) >= 5)
select comp, n, span, round(cx, 6) cx, round(cy, 6) cy, round(misfit, 6) misfit, round(inside, 6) inside, round(connected, 6) connected, round(shore, 6) shore, case when connected < 0.02 then 'flood' when inside >= 0.5 then 'fringe' when shore > 0.25 then 'beach' else 'glint' end verdict from cs""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
