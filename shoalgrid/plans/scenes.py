"""Scene selection, histograms, summaries, filters, joins and sets on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shoalgrid.functions import scalars
from shoalgrid.operators import scenes
from shoalgrid.session import table

_DESC = lambda c: F.col(c).desc()


def scene_dedupe(spark, d):
    """One event a user and minute: the greatest type, then the lowest value, then the first id."""
    events = table(spark, d, "events")
    return scenes.first_by(events.withColumn("minute_of", F.date_trunc("minute", "ts")), ["user_id", "minute_of"], [_DESC("event_type"), "value", "event_id"]).select("event_id")


def dedupe_min(spark, d):
    return scenes.first_by(table(spark, d, "events").withColumn("day", F.col("ts").cast("date")), ["day", "event_type"], [F.coalesce("value", F.lit(100.0)), "event_id"]).select("event_id", "value")


def dedupe_last(spark, d):
    return scenes.first_by(table(spark, d, "events").withColumn("slot", F.date_trunc("hour", "ts")), ["slot"], [_DESC("event_id")]).select("event_id")


def best_per_bin(spark, d):
    return scenes.first_by(table(spark, d, "part").withColumn("bin", F.floor(F.col("p_retailprice") / 20)), ["bin"], ["p_size", "p_partkey"]).select("bin", "p_partkey", "p_size")


def top_worst(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.abs(F.col("o_totalprice") - 250000).alias("error"))
    return o.orderBy(_DESC("error"), "o_orderkey").limit(10)


def worst_and_best(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return c.orderBy("c_acctbal", "c_custkey").limit(10).withColumn("side", F.lit("worst")).unionByName(c.orderBy(_DESC("c_acctbal"), "c_custkey").limit(5).withColumn("side", F.lit("best")))


def argmax_first(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_quantity", "l_linenumber").agg(F.count(F.lit(1)).alias("score"))
    best = F.max_by(F.struct("l_quantity", "l_linenumber"), F.struct(F.col("score"), -F.col("l_quantity"), -F.col("l_linenumber")))
    return g.agg(best.alias("b"), F.max("score").alias("score")).select(F.col("b.l_quantity").cast("double").alias("quantity"), F.col("b.l_linenumber").alias("linenumber"), "score")


def split_rank(spark, d):
    c = scenes.numbered(table(spark, d, "customer").select("c_nationkey", "c_acctbal", "c_custkey"), ["c_nationkey"], ["c_acctbal", "c_custkey"], "i").withColumn("half", (F.col("i") % 2).cast("int"))
    return c.groupBy("c_nationkey", "half").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


def nearest_scene(spark, d):
    c = table(spark, d, "customer")
    return c.groupBy("c_nationkey").agg(F.min_by("c_custkey", F.struct(F.abs(F.col("c_acctbal") - 1000), F.col("c_custkey"))).alias("c_custkey"))


def monotonicity(spark, d):
    daily = table(spark, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    step = F.col("n") - F.lag("n").over(Window.partitionBy("event_type").orderBy("day"))
    return daily.withColumn("step", step).groupBy("event_type").agg(F.sum((F.col("step") < 0).cast("int")).alias("violations"), F.min("step").alias("worst_drop"), F.count("step").alias("steps"))


def subsample_kth(spark, d):
    return scenes.every_kth(table(spark, d, "part").filter("p_size > 20"), ["p_brand"], ["p_retailprice", "p_partkey"], 3).select("p_partkey")


def hist_clamped(spark, d):
    return scenes.clamped_bins(table(spark, d, "events"), F.col("value"), 45.0, 10)


def hist_dropped(spark, d):
    return scenes.dropped_bins(table(spark, d, "events"), F.col("value"), 50.0, 25.0, 12)


def _gray():
    return F.least(scalars.half_up(F.col("value") / F.lit(490.1) * 255), F.lit(255)).cast("int")


def hist_masked(spark, d):
    return scenes.histogram(table(spark, d, "events").filter(F.col("event_id") % 7 != 0), ["event_type"], _gray())


def hist_smooth_valley(spark, d):
    smooth = scenes.smoothed(scenes.histogram(table(spark, d, "events"), ["event_type"], _gray()), ["event_type"])
    return scenes.valley(smooth, ["event_type"]).withColumn("ratio", F.round("ratio", 6))


def otsu_per_group(spark, d):
    return scenes.otsu(scenes.histogram(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_quantity")), ["l_returnflag"])


def otsu_single(spark, d):
    """Thresholds of histograms of which every third has one level only; those keep the level that the search begins with."""
    gray = F.when(F.col("p_partkey") % 3 == 0, F.lit(7)).otherwise(F.col("p_size")).cast("int")
    rows = table(spark, d, "part").withColumn("key", F.col("p_partkey") % 30)
    return scenes.otsu(scenes.histogram(rows, ["key"], gray), ["key"], 0)


def upper_median(spark, d):
    return scenes.upper_median(table(spark, d, "orders").select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice")


def otsu_upper_median(spark, d):
    per_user = scenes.otsu(scenes.histogram(table(spark, d, "events"), ["user_id"], _gray()), ["user_id"])
    return scenes.upper_median(per_user.select(F.lit(1).alias("whole"), "threshold"), ["whole"], "threshold").select("threshold")


def percentile_index(spark, d):
    return scenes.at_rank(table(spark, d, "customer").select("c_mktsegment", "c_acctbal"), ["c_mktsegment"], "c_acctbal", F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(0.985))))


PIXEL_KM2 = 0.000241212


def class_counts(spark, d):
    cls = F.when(F.col("p_size") <= 10, 0).when(F.col("p_size") <= 35, 128).when(F.col("p_size") <= 45, 255).otherwise(64)
    return table(spark, d, "part").groupBy(cls.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) * F.lit(PIXEL_KM2), 6).alias("km2"))


def distinct_sorted(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_set(F.dayofmonth("ts"))), ",").alias("days"), F.countDistinct("user_id").alias("users"))


def ols_detrend(spark, d):
    o = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return scenes.detrend(o, "x", "y").select("p_partkey", F.round("residual", 5).alias("residual"))


def correlation(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr(F.col("l_quantity").cast("double"), F.col("l_extendedprice")), 6).alias("r"))


def misfit_hist(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("misfit")).groupBy(F.least(F.lit(5), "misfit").alias("misfit")).agg(F.count(F.lit(1)).alias("n"))


def pinned_edges(spark, d):
    c = table(spark, d, "customer")
    ends = c.groupBy("c_nationkey").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    near = lambda x: F.sum(x.cast("int"))
    return c.join(ends, "c_nationkey").groupBy("c_nationkey").agg(near(F.col("c_acctbal") <= F.col("lo") + 500).alias("low"), near(F.col("c_acctbal") >= F.col("hi") - 500).alias("high"))


def distribution_summary(spark, d):
    p = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    q = F.percentile("o_totalprice", p)
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(*[F.round(q[k], 4).alias(f"p{round(x * 100)}") for k, x in enumerate(p)], F.round(F.avg("o_totalprice"), 4).alias("mean"), F.max("o_totalprice").alias("max"))


def mode_share(spark, d):
    codes = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    return codes.groupBy("p_brand").agg(F.count(F.lit(1)).alias("codes"), F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"))


def overlap_diagnostics(spark, d):
    diff = F.col("l_extendedprice") * F.lit(0.001) - F.col("l_quantity").cast("double")
    q = F.percentile("diff", [0.25, 0.5, 0.75])
    return table(spark, d, "lineitem").select("l_returnflag", diff.alias("diff")).groupBy("l_returnflag").agg(F.round(q[1], 5).alias("median"), F.round(q[2] - q[0], 5).alias("iqr"), F.round(F.stddev_pop("diff"), 5).alias("std"))


def source_share(spark, d):
    k = F.col("l_suppkey") % 5
    return table(spark, d, "lineitem").agg(*[F.round(F.avg((k == i).cast("double")), 6).alias(f"share{i}") for i in range(5)])


def composite_cells(spark, d):
    cell = [(F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y")]
    return table(spark, d, "lineitem").groupBy(*cell).agg(F.max("l_quantity").cast("double").alias("brightest"), F.sum("l_quantity").cast("double").alias("splat"))


def mask_audit(spark, d):
    a, b = F.col("p_size") > 25, F.col("p_partkey") % 3 == 0
    area = lambda x: F.round(F.sum(x.cast("int")) * F.lit(PIXEL_KM2), 6)
    return table(spark, d, "part").groupBy("p_brand").agg(area(a & ~b).alias("only_a"), area(~a & b).alias("only_b"), area(a & b).alias("both"))


def quality_filter(spark, d):
    return table(spark, d, "lineitem").filter("l_discount < 0.05 and l_tax < 0.03 and l_quantity >= 10").select("l_orderkey", "l_linenumber")


def id_contains(spark, d):
    p = table(spark, d, "pages").filter(F.col("url").contains("1"))
    return p.select("page_id", F.coalesce(F.regexp_extract("url", "([0-9]+)[^0-9]*$", 1), F.lit("")).alias("version"))


def text_validation(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.split("c_name", "#"). alias("f"))
    return c.select("c_custkey", F.element_at("f", -1).rlike("^[0-9]+$").alias("numeric"), F.element_at("f", 1).rlike("^[A-Z][a-z]+$").alias("word"))


def year_split(spark, d):
    o = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return o.select("year", "n", F.when(F.col("year") % 2 == 0, "fit").otherwise("check").alias("fold"))


def water_predicate(spark, d):
    tide = (F.col("l_linenumber") * 7).cast("double")
    wet = (F.col("p_size") % 4 == 0) | ((F.col("p_size") % 4 == 1) & (F.col("p_size") <= tide))
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_linenumber").agg(F.sum(wet.cast("int")).alias("wet"), F.count(F.lit(1)).alias("n"))


#: Boxes (name, west, south, east, north) in raster cells; the first that holds a point wins, edges included.
PLACES = (("north", 0, 0, 20, 12), ("middle", 10, 8, 35, 25), ("south", 0, 20, 49, 39), ("corner", 40, 0, 49, 5))


def _raster(spark, d):
    return table(spark, d, "part").select((F.col("p_partkey") % 50).cast("int").alias("x"), F.floor(F.col("p_partkey") / 50).cast("int").alias("y"), "p_size", "p_partkey")


def place_join(spark, d):
    """A range join with a table of a few boxes, which is broadcast."""
    places = spark.createDataFrame([(i, *p) for i, p in enumerate(PLACES)], "rank int, place string, w int, s int, e int, n int")
    inside = (F.col("x") >= F.col("w")) & (F.col("x") <= F.col("e")) & (F.col("y") >= F.col("s")) & (F.col("y") <= F.col("n"))
    rows = _raster(spark, d).join(F.broadcast(places), inside, "left")
    return rows.groupBy("p_partkey").agg(F.min_by("place", "rank").alias("place"))


def decision_list(spark, d):
    kind = F.when(F.col("l_discount") >= 0.08, "flood").when((F.col("l_tax") > 0.05) & (F.col("l_quantity") > 30), "fringe").when(F.col("l_returnflag") == "R", "surf").otherwise("glint")
    return table(spark, d, "lineitem").groupBy(kind.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity").cast("double"), 2).alias("area"))


BANDS = ((0, 75), (75, 100), (100, 150), (150, 200), (200, 1000), (1000, 2000))


def banded_means(spark, d):
    bands = spark.createDataFrame(list(BANDS), "lo int, hi int")
    events = table(spark, d, "events").select("value", "user_id")
    within = (F.col("value") >= F.col("lo")) & (F.col("value") < F.col("hi"))
    return F.broadcast(bands).join(events, within, "left").groupBy("lo", "hi").agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


def light_candidates(spark, d):
    """Values above the 98.5th percentile by rank of their group."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    cut = percentile_index(spark, d).withColumnRenamed("c_acctbal", "cut")
    return c.join(cut, "c_mktsegment").filter("c_acctbal > cut").select("c_custkey")


def agreement_gate(spark, d):
    a = _raster(spark, d).select("x", "y", F.col("p_size").cast("double").alias("a"))
    b = a.select((F.col("x") + 1).alias("x"), "y", F.col("a").alias("b"))
    return a.join(b, ["x", "y"]).filter(F.abs(F.col("a") - F.col("b")) < 10).select("x", "y", (F.col("a") - F.col("b")).alias("diff"))


def coverage_gate(spark, d):
    v = (F.col("p_partkey") * 7 % 10 < 4).cast("double")
    return _raster(spark, d).groupBy(F.floor(F.col("x") / 5).alias("cx"), F.floor(F.col("y") / 4).alias("cy")).agg(F.round(F.avg(v), 6).alias("coverage")).filter("coverage >= 0.3")


def subset_semi(spark, d):
    chosen = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(chosen, "o_custkey", "left_semi").select("o_orderkey")


def aligned_rasters(spark, d):
    a = _raster(spark, d).select("x", "y", "p_size")
    b = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 50).cast("int").alias("x"), (F.floor(F.col("l_partkey") / 50) % 40).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return a.join(b, ["x", "y"], "left").select("x", "y", (F.col("p_size") * F.coalesce("n", F.lit(0))).alias("product"))


def lag_bins(spark, d):
    """Rows meet their lag bin's scenes in that bin's order: the bins and scenes are a small dimension."""
    lines = table(spark, d, "supplier").select("s_suppkey", F.floor((F.lit(40) + F.col("s_suppkey") % 13 * 4) / 5 + F.lit(0.5)).alias("bin"))
    scene = spark.range(30).select(F.col("id").alias("scene"), (F.col("id") * 97 % 31).alias("tide"))
    bins = spark.range(8, 20).withColumnRenamed("id", "bin").crossJoin(scene).withColumn("lagged", F.col("tide") * 10 - F.col("bin") * (F.col("scene") % 3))
    ordered = bins.withColumn("rank", F.row_number().over(Window.partitionBy("bin").orderBy("lagged", "scene")) - 1)
    return lines.join(F.broadcast(ordered), "bin").select("s_suppkey", "bin", "scene", "rank")


def hysteresis_pair(spark, d):
    """For each rising row the falling one within 5.00 of its level with the largest gap in value, the first on ties. Levels in whole cents."""
    c = table(spark, d, "customer").select(F.round(F.col("c_acctbal") * 100).cast("long").alias("level"), F.col("c_custkey").alias("value"))
    best = scenes.furthest_partner(c, F.col("value") % 2 == 0, F.col("value") % 2 == 1, "level", "value", 500)
    return best.select(F.col("id").alias("rising"), F.col("partner").alias("falling"), "gap")


def hysteresis_residual(spark, d):
    """What is left of a quantity after the straight line through it and the level is taken away, compared between rising and falling rows of like level."""
    c = table(spark, d, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("level"), (F.col("c_acctbal") * F.lit(0.01) + F.col("c_custkey") * 7919 % 1009).alias("y"))
    rest = scenes.detrend(c.withColumn("x", F.col("level").cast("double")), "x", "y").select("c_custkey", "level", F.round("residual", 4).alias("r"))
    best = scenes.furthest_partner(rest, F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 2 == 1, "level", "r", 500, "c_custkey")
    return best.select(F.col("id").alias("rising"), F.round("gap", 3).alias("gap"))


def band_tiles(spark, d):
    bands = spark.createDataFrame([(3, 9), (20, 22), (37, 38)], "lo int, hi int")
    tiles = _raster(spark, d).select(F.floor(F.col("y") / 4).alias("ty")).distinct()
    return tiles.join(F.broadcast(bands), (F.col("ty") * 4 <= F.col("hi")) & (F.col("ty") * 4 + 3 >= F.col("lo")), "left_semi")


def complement_anti(spark, d):
    busy = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(busy, "c_custkey", "left_anti").select("c_custkey")


def parameter_grid(spark, d):
    return spark.range(7).select((F.col("id") * 10).alias("tau0")).crossJoin(spark.range(7).select((F.col("id") * 2).alias("slope"))).crossJoin(table(spark, d, "region").select("r_regionkey"))


def union_pages(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit("orders").alias("page"))
    return o.unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("page"))).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


def mask_algebra(spark, d):
    r = _raster(spark, d)
    a, b = r.filter("p_size > 20").select("x", "y"), r.filter("p_partkey % 3 = 0").select("x", "y")
    tag = lambda s, n: s.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * 1000 + F.col("y")).alias("total")).withColumn("op", F.lit(n))
    return tag(a.intersect(b), "and").unionByName(tag(a.exceptAll(b), "minus")).unionByName(tag(a.union(b).distinct(), "or"))


def change_raster(spark, d):
    before = F.when(F.col("p_size") > 25, 1).otherwise(0)
    after = F.when(F.col("p_size") + F.col("p_partkey") % 9 > 27, 1).otherwise(0)
    return _raster(spark, d).filter(before != after).select("x", "y", before.alias("before"), after.alias("after"))


def water_index(spark, d):
    g, n = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    index = scalars.water_index(g, n)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(index, 6).alias("ndwi"), scalars.index_to_gray(index).alias("gray"))
    return rows.withColumn("back", F.round(scalars.gray_to_index(F.col("gray")), 6))


def encode_height(spark, d):
    h = F.col("l_quantity").cast("double") / F.lit(20.0)
    code = scalars.encode_height(h)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", code.alias("code"), F.round(scalars.decode_height(code), 6).alias("height"))


def split_bytes(spark, d):
    code = scalars.signed_height_code(F.col("p_size") / F.lit(10.0))
    return table(spark, d, "part").select("p_partkey", code.alias("code"), scalars.high_byte(code).alias("hi"), scalars.low_byte(code).alias("lo"))


def terrain_rgb(spark, d):
    e = scalars.terrain_rgb(F.lit(1), F.col("p_partkey") % 256, F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", F.round(F.greatest(e, F.lit(-1000.0)), 3).alias("metres")).filter("metres > -50000 and metres < 4000")


def shades(spark, d):
    x = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(scalars.smoothstep(5, 45, x), 6).alias("smooth"), F.round(scalars.depth_shade(x), 6).alias("shade"), F.round(scalars.luminance(x, x + 1, x * 2), 6).alias("luminance"))


def slippy_tiles(spark, d):
    lon, lat = F.col("c_acctbal") / F.lit(60.0), F.col("c_custkey") % 80 * F.lit(1.0) - F.lit(40.25)
    return table(spark, d, "customer").select("c_custkey", scalars.tile_x(lon, 15).alias("tx"), scalars.tile_y(lat, 15).alias("ty"), F.round(scalars.ground_resolution(lat, 15), 6).alias("resolution"))


def bitpack_popcount(spark, d):
    """Booleans packed 32 to a word, and the number of set bits."""
    bits = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 32).alias("word"), F.when(F.col("p_size") > 25, F.expr("shiftleft(1L, cast(p_partkey % 32 as int))")).otherwise(F.lit(0)).alias("bit"))
    return bits.groupBy("word").agg(F.bit_or("bit").alias("packed")).withColumn("ones", F.bit_count("packed"))


def size_estimate(spark, d):
    """From 20 rows at even strides of each key, what all of them come to."""
    docs = scenes.numbered(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "i")
    sizes = table(spark, d, "documents").groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    some = docs.join(sizes, F.col("source").eqNullSafe(F.col("of"))).filter(F.col("i") % F.greatest(F.lit(1), F.floor(F.col("n") / 20)) == 0)
    return some.groupBy("source").agg(F.round(F.avg("n_chars") * F.max("n"), 2).alias("estimate"))


def json_flatten(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("n"))


def provenance(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), F.octet_length("html").cast("long").alias("bytes"))


_A = "(select cast(p_partkey % 50 as int) x, cast(p_partkey // 50 as int) y, p_size, p_partkey from part)"
_G = "cast(least(floor(value / 490.1::double * 255 + 0.5), 255) as int)"
_HIST = f"(select event_type, {_G} gray, count(*) n from events group by all)"


def _sql_otsu(hist, by):
    return f"""(select {by}, cast(coalesce(-max(case when f > 0 then {{'f': f, 'g': -gray}} end)['g'], 128) as int) threshold from (select *, case when wb > 0 and w > wb then wb::double * (w - wb) * (sb::double / wb - (s - sb)::double / (w - wb)) * (sb::double / wb - (s - sb)::double / (w - wb)) end f
from (select {by}, gray, sum(n) over r wb, sum(gray * n) over r sb, sum(n) over (partition by {by}) w, sum(gray * n) over (partition by {by}) s from {hist} window r as (partition by {by} order by gray))) group by {by})"""


_PLACES = ", ".join(f"({i}, '{p}', {w}, {s}, {e}, {n})" for i, (p, w, s, e, n) in enumerate(PLACES))
_TILE_LAT = "((c_custkey % 80) - 40.25::double)"
ORACLES = {
    "scene_dedupe": "select event_id from events qualify row_number() over (partition by user_id, date_trunc('minute', ts) order by event_type desc, value, event_id) = 1",
    "dedupe_min": "select event_id, value from events qualify row_number() over (partition by cast(ts as date), event_type order by coalesce(value, 100), event_id) = 1",
    "dedupe_last": "select max(event_id) event_id from events group by date_trunc('hour', ts)",
    "best_per_bin": "select cast(floor(p_retailprice / 20) as bigint) bin, p_partkey, p_size from part qualify row_number() over (partition by floor(p_retailprice / 20) order by p_size, p_partkey) = 1",
    "top_worst": "select o_orderkey, abs(o_totalprice - 250000) error from orders order by 2 desc, 1 limit 10",
    "worst_and_best": "(select c_custkey, c_acctbal, 'worst' side from customer order by c_acctbal, c_custkey limit 10) union all (select c_custkey, c_acctbal, 'best' from customer order by c_acctbal desc, c_custkey limit 5)",
    "argmax_first": "select cast(l_quantity as double) quantity, l_linenumber linenumber, count(*) score from lineitem group by l_quantity, l_linenumber order by score desc, l_quantity, l_linenumber limit 1",
    "split_rank": "select c_nationkey, half, count(*) n, round(avg(c_acctbal), 4) mean from (select *, (row_number() over (partition by c_nationkey order by c_acctbal, c_custkey) - 1) % 2 half from customer) group by 1, 2",
    "nearest_scene": "select c_nationkey, c_custkey from customer qualify row_number() over (partition by c_nationkey order by abs(c_acctbal - 1000), c_custkey) = 1",
    "monotonicity": "select event_type, cast(sum(case when step < 0 then 1 else 0 end) as bigint) violations, min(step) worst_drop, count(step) steps from (select event_type, n - lag(n) over (partition by event_type order by day) step from (select event_type, cast(ts as date) as day, count(*) n from events group by all)) group by 1",
    "subsample_kth": "select p_partkey from (select *, row_number() over (partition by p_brand order by p_retailprice, p_partkey) i from part where p_size > 20) where (i - 1) % 3 = 0",
    "hist_clamped": "select cast(b as bigint) bin, count(value) n from range(10) r(b) left join events on least(greatest(floor(value / 45), 0), 9) = b group by 1",
    "hist_dropped": "select cast(floor((value - 50) / 25) as bigint) bin, count(*) n from events where value >= 50 and value < 350 group by 1",
    "hist_masked": f"select event_type, {_G} gray, count(*) n from events where event_id % 7 <> 0 group by all",
    "hist_smooth_valley": f"""with h as {_HIST}, g as (select event_type, gray, coalesce(n, 0) n from (select distinct event_type from h), range(256) r(gray) left join h using (event_type, gray)),
s as (select *, avg(n) over (partition by event_type order by gray rows between 4 preceding and 4 following) m from g),
a as (select event_type, gray low_mode, m ma from s where gray < 128 qualify row_number() over (partition by event_type order by m desc, gray) = 1),
b as (select event_type, gray high_mode, m mb from s where gray >= 128 qualify row_number() over (partition by event_type order by m desc, gray) = 1)
select event_type, cast(low_mode as int) low_mode, cast(high_mode as int) high_mode, cast(gray as int) valley, round(coalesce(m / nullif(least(ma, mb), 0), 1), 6) ratio from s join a using (event_type) join b using (event_type) where gray between low_mode and high_mode qualify row_number() over (partition by event_type order by m, gray) = 1""".replace("from (select distinct event_type from h), range(256) r(gray) left join h using (event_type, gray)", "from (select event_type, cast(gray as int) gray from (select distinct event_type from h), range(256) r(gray)) left join h using (event_type, gray)"),
    "otsu_per_group": "select * from " + _sql_otsu("(select l_returnflag, cast(l_quantity as int) gray, count(*) n from lineitem group by all)", "l_returnflag"),
    "otsu_single": "select * from " + _sql_otsu("(select p_partkey % 30 as key, cast(case when p_partkey % 3 = 0 then 7 else p_size end as int) gray, count(*) n from part group by all)", "key").replace("'], 128)", "'], 0)"),
    "upper_median": "select o_orderpriority, o_totalprice from (select *, row_number() over (partition by o_orderpriority order by o_totalprice) - 1 i, count(*) over (partition by o_orderpriority) n from orders) where i = n // 2",
    "otsu_upper_median": f"select threshold from (select threshold, row_number() over (order by threshold) - 1 i, count(*) over () n from {_sql_otsu(f'(select user_id, {_G} gray, count(*) n from events group by all)', 'user_id')}) where i = n // 2",
    "percentile_index": "select c_mktsegment, c_acctbal from (select *, row_number() over (partition by c_mktsegment order by c_acctbal) - 1 i, count(*) over (partition by c_mktsegment) n from customer) where i = least(n - 1, floor(n * 0.985::double))",
    "class_counts": f"select case when p_size <= 10 then 0 when p_size <= 35 then 128 when p_size <= 45 then 255 else 64 end class, count(*) n, round(count(*) * {PIXEL_KM2}::double, 6) km2 from part group by 1",
    "distinct_sorted": "select event_type, array_to_string(list_sort(list(distinct day(ts))), ',') as days, count(distinct user_id) as users from events group by 1",
    "ols_detrend": "select p_partkey, round(p_retailprice - regr_slope(p_retailprice, p_size::double) over () * p_size - regr_intercept(p_retailprice, p_size::double) over (), 5) residual from part",
    "correlation": "select l_returnflag, round(corr(l_quantity::double, l_extendedprice), 6) r from lineitem group by 1",
    "misfit_hist": "select least(5, k) misfit, count(*) n from (select count(*) k from lineitem group by l_orderkey) group by 1",
    "pinned_edges": "select c_nationkey, cast(sum(case when c_acctbal <= lo + 500 then 1 else 0 end) as bigint) low, cast(sum(case when c_acctbal >= hi - 500 then 1 else 0 end) as bigint) high from (select *, min(c_acctbal) over (partition by c_nationkey) lo, max(c_acctbal) over (partition by c_nationkey) hi from customer) group by 1",
    "distribution_summary": "select o_orderstatus, " + ", ".join(f"round(quantile_cont(o_totalprice, {x}), 4) p{round(x * 100)}" for x in (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + ', round(avg(o_totalprice), 4) mean, max(o_totalprice) "max" from orders group by 1',
    "mode_share": "select p_brand, count(*) codes, round(max(n) / sum(n)::double, 6) largest_share from (select p_brand, p_size, count(*) n from part group by all) group by 1",
    "overlap_diagnostics": "select l_returnflag, round(median(d), 5) median, round(quantile_cont(d, 0.75) - quantile_cont(d, 0.25), 5) iqr, round(stddev_pop(d), 5) std from (select l_returnflag, l_extendedprice * 0.001::double - l_quantity::double d from lineitem) group by 1",
    "source_share": "select " + ", ".join(f"round(avg(case when l_suppkey % 5 = {i} then 1.0 else 0.0 end), 6) share{i}" for i in range(5)) + " from lineitem",
    "composite_cells": "select l_partkey % 64 x, l_suppkey % 64 y, cast(max(l_quantity) as double) brightest, cast(sum(l_quantity) as double) splat from lineitem group by 1, 2",
    "mask_audit": "select p_brand, " + ", ".join(f"round(sum(case when {c} then 1 else 0 end) * {PIXEL_KM2}::double, 6) as \"{n}\"" for n, c in (("only_a", "p_size > 25 and p_partkey % 3 <> 0"), ("only_b", "not p_size > 25 and p_partkey % 3 = 0"), ("both", "p_size > 25 and p_partkey % 3 = 0"))) + " from part group by 1",
    "quality_filter": "select l_orderkey, l_linenumber from lineitem where l_discount < 0.05 and l_tax < 0.03 and l_quantity >= 10",
    "id_contains": "select page_id, regexp_extract(url, '([0-9]+)[^0-9]*$', 1) as version from pages where contains(url, '1')",
    "text_validation": "select c_custkey, regexp_matches(list_extract(string_split(c_name, '#'), -1), '^[0-9]+$') as numeric, regexp_matches(string_split(c_name, '#')[1], '^[A-Z][a-z]+$') word from customer",
    "year_split": "select cast(year(o_orderdate) as int) as year, count(*) n, case when year(o_orderdate) % 2 = 0 then 'fit' else 'check' end fold from orders group by 1, 3",
    "water_predicate": "select l_linenumber, cast(sum(case when p_size % 4 = 0 or (p_size % 4 = 1 and p_size <= l_linenumber * 7) then 1 else 0 end) as bigint) wet, count(*) n from lineitem join part on l_partkey = p_partkey group by 1",
    "place_join": f"select p_partkey, arg_min(place, rank) place from {_A} left join (values {_PLACES}) v(rank, place, w, s, e, n) on x between w and e and y between s and n group by 1",
    "decision_list": "select case when l_discount >= 0.08 then 'flood' when l_tax > 0.05 and l_quantity > 30 then 'fringe' when l_returnflag = 'R' then 'surf' else 'glint' end verdict, count(*) n, round(cast(sum(l_quantity) as double), 2) area from lineitem group by 1",
    "banded_means": "select lo, hi, count(value) n, round(avg(value), 4) mean from (values " + ", ".join(map(str, BANDS)) + ") b(lo, hi) left join events on value >= lo and value < hi group by 1, 2",
    "light_candidates": "select c_custkey from (select *, row_number() over (partition by c_mktsegment order by c_acctbal) - 1 i, count(*) over (partition by c_mktsegment) n from customer) q where c_acctbal > (select max(c_acctbal) from (select c_acctbal, c_mktsegment, row_number() over (partition by c_mktsegment order by c_acctbal) - 1 i, count(*) over (partition by c_mktsegment) n from customer) z where z.c_mktsegment = q.c_mktsegment and z.i = least(z.n - 1, floor(z.n * 0.985::double)))",
    "agreement_gate": f"select a.x, a.y, (a.p_size - b.p_size)::double diff from {_A} a join {_A} b on a.x = b.x + 1 and a.y = b.y where abs(a.p_size - b.p_size) < 10",
    "coverage_gate": f"select cast(x // 5 as bigint) cx, cast(y // 4 as bigint) cy, round(avg(case when p_partkey * 7 % 10 < 4 then 1.0 else 0.0 end), 6) coverage from {_A} group by 1, 2 having avg(case when p_partkey * 7 % 10 < 4 then 1.0 else 0.0 end) >= 0.3",
    "subset_semi": "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 9000)",
    "aligned_rasters": f"select x, y, p_size * coalesce(n, 0) product from {_A} left join (select l_partkey % 50 x, l_partkey // 50 % 40 y, count(*) n from lineitem group by 1, 2) using (x, y)",
    "lag_bins": "select s_suppkey, cast(bin as bigint) bin, scene, rank from (select s_suppkey, floor((40 + s_suppkey % 13 * 4) / 5::double + 0.5) bin from supplier) join (select bin, scene, row_number() over (partition by bin order by id97 * 10 - bin * (scene % 3), scene) - 1 as rank from range(8, 20) r(bin), (select s scene, s * 97 % 31 id97 from range(30) q(s))) using (bin)",
    "hysteresis_pair": "select a.c_custkey rising, b.c_custkey falling, abs(a.c_custkey - b.c_custkey) gap from customer a join customer b on a.c_custkey % 2 = 0 and b.c_custkey % 2 = 1 and abs(cast(round(a.c_acctbal * 100) as bigint) - cast(round(b.c_acctbal * 100) as bigint)) <= 500 qualify row_number() over (partition by a.c_custkey order by abs(a.c_custkey - b.c_custkey) desc, b.c_custkey) = 1",
    "hysteresis_residual": "with c as (select c_custkey k, cast(round(c_acctbal * 100) as bigint) l, c_acctbal * 0.01::double + c_custkey * 7919 % 1009 y from customer), r as (select k, l, round(y - regr_slope(y, l::double) over () * l - regr_intercept(y, l::double) over (), 4) r from c) select a.k rising, round(max(abs(a.r - b.r)), 3) gap from r a join r b on a.k % 2 = 0 and b.k % 2 = 1 and abs(a.l - b.l) <= 500 group by 1",
    "band_tiles": f"select distinct cast(y // 4 as bigint) ty from {_A} where exists (select 1 from (values (3, 9), (20, 22), (37, 38)) v(lo, hi) where y // 4 * 4 <= hi and y // 4 * 4 + 3 >= lo)",
    "complement_anti": "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)",
    "parameter_grid": "select a * 10 tau0, b * 2 slope, r_regionkey from range(7) p(a), range(7) q(b), region",
    "union_pages": "select 'orders' page, count(*) n, cast(sum(o_custkey) as bigint) total from orders union all select 'customer', count(*), cast(sum(c_custkey) as bigint) from customer",
    "mask_algebra": " union all ".join(f"select '{n}' op, count(*) n, cast(sum(x * 1000 + y) as bigint) total from {_A} where {c}" for n, c in (("and", "p_size > 20 and p_partkey % 3 = 0"), ("minus", "p_size > 20 and p_partkey % 3 <> 0"), ("or", "p_size > 20 or p_partkey % 3 = 0"))),
    "change_raster": f"select * from (select x, y, case when p_size > 25 then 1 else 0 end as before, case when p_size + p_partkey % 9 > 27 then 1 else 0 end as after from {_A}) where before <> after",
    "water_index": "select l_orderkey, l_linenumber, round(i, 6) ndwi, cast(floor((i + 1) * 127.5 + 0.5) as bigint) gray, round(floor((i + 1) * 127.5 + 0.5) / 127.5 - 1, 6) back from (select *, (l_quantity::double - l_linenumber) / (l_quantity::double + l_linenumber) i from lineitem)",
    "encode_height": "select l_orderkey, l_linenumber, code, round((code - 1) / 65533.0::double * 2.5, 6) height from (select *, cast(least(greatest(floor(1 + l_quantity::double / 20 / 2.5 * 65533 + 0.5), 1), 65534) as bigint) code from lineitem)",
    "split_bytes": "select p_partkey, code, code // 256 hi, code % 256 lo from (select *, cast(floor(least(greatest((p_size / 10.0::double + 0.75) / 4, 0), 1) * 65535 + 0.5) as bigint) code from part)",
    "terrain_rgb": "select p_partkey, round(greatest(-10000 + (65536 + p_partkey % 256 * 256 + p_size) * 0.1::double, -1000), 3) metres from part where -10000 + (65536 + p_partkey % 256 * 256 + p_size) * 0.1 < 4000",
    "shades": "select p_partkey, round(t * t * (3 - 2 * t), 6) smooth, round(case when p_size <= 15 then 0.5 * pow(p_size / 15.0::double, 0.6::double) else 0.5 + 0.5 * u * u * (3 - 2 * u) end, 6) shade, round(p_size * 0.299::double + (p_size + 1) * 0.587::double + p_size * 2 * 0.114::double, 6) luminance from (select *, least(greatest((p_size - 5) / 40.0::double, 0), 1) t, least(greatest((p_size - 15) / 25.0::double, 0), 1) u from part)",
    "slippy_tiles": f"select c_custkey, cast(floor((c_acctbal / 60 + 180) / 360 * 32768) as bigint) tx, cast(floor((1 - ln(tan({_TILE_LAT} * pi() / 180) + 1 / cos({_TILE_LAT} * pi() / 180)) / pi()) / 2 * 32768) as bigint) ty, round(cos({_TILE_LAT} * pi() / 180) * 2 * pi() * 6378137 / (256 * 32768), 6) resolution from customer",
    "bitpack_popcount": "select cast(p_partkey // 32 as bigint) word, cast(bit_or(case when p_size > 25 then 1::bigint << (p_partkey % 32) else 0 end) as bigint) packed, cast(sum(case when p_size > 25 then 1 else 0 end) as int) ones from part group by 1",
    "size_estimate": "select source, round(avg(n_chars) * max(n), 2) estimate from (select source, n_chars, row_number() over (partition by source order by doc_id) i, count(*) over (partition by source) n from documents) where (i - 1) % greatest(1, n // 20) = 0 group by 1",
    "json_flatten": "select event_type, cast(sum(k) as bigint) total, count(k) n from (select event_type, try_cast(json_extract_string(props, '$.k') as bigint) k from events) group by 1",
    "provenance": "select page_id, sha256(html) sha256, cast(octet_length(encode(html)) as bigint) bytes from pages",
}
QUERIES = {name: globals()[name] for name in ORACLES}
