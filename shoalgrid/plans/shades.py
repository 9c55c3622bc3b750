"""Scalar functions of colour, noise, light and maps, and more of the tide, on the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from shoalgrid.functions import astro, scalars, tide
from shoalgrid.operators import scenes
from shoalgrid.plans.raster import _A, _cells, _height
from shoalgrid.plans.series import _DAYS, _E, _H, _MOON, _SUN, LAT, LON, _altitude, _days, _node, _orders, _series, sql_height
from shoalgrid.plans.surface import _STEP
from shoalgrid.session import table

WATER_STOPS = [(0.0, 1.4, 0.62), (0.6, 3.2, 0.48), (2.2, 5.5, 0.33), (4.0, 8.0, 0.21), (6.5, 13.0, 0.12), (11.0, 25.0, 0.05)]


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), F.col("p_partkey").cast("double").alias("k"))


def noise(spark, d):
    x, y = F.col("k") * F.lit(0.37), F.col("s") * F.lit(0.61)
    return _parts(spark, d).select("p_partkey", F.round(scalars.hash_noise(F.col("k"), F.col("s")), 4).alias("hashed"), F.round(scalars.value_noise(x, y), 4).alias("smooth"), F.round(scalars.gradient_noise(F.col("k"), F.col("s")), 5).alias("dither"))


def random_draws(spark, d):
    """Draws of two generators whose state at any draw is known without those before it, or from one step."""
    key = F.col("p_partkey").cast("long")
    return table(spark, d, "part").select("p_partkey", F.round(scalars.mulberry(scalars.mulberry_state(F.lit(20260727).cast("long"), key)), 9).alias("draw"), scalars.congruential(key * 7919 % 2147483647).alias("state"))


def depth_inverse(spark, d):
    x = (F.col("s") - 1) * F.lit(0.8)
    shade = scalars.depth_shade(x)
    return _parts(spark, d).select("p_partkey", F.round(shade, 6).alias("shade"), F.round(scalars.depth_of_shade(shade), 5).alias("depth"))


def colour_measures(spark, d):
    r, g, b = F.col("s") * 5, F.col("s") * 3 + 7, F.col("k") % 256
    return _parts(spark, d).select("p_partkey", F.round(scalars.chroma(r, g, b), 6).alias("chroma"), F.round(scalars.saturation(r, g, b), 6).alias("saturation"))


def sun_azimuth(spark, d):
    return _orders(spark, d).select("o_orderkey", F.round(astro.sun_azimuth(_days() + (F.col("o_orderkey") % 24) / F.lit(24.0), LAT, LON), 3).alias("azimuth"))


def synodic_moon(spark, d):
    age = astro.moon_age(_days())
    return _orders(spark, d).select("o_orderkey", F.round(age, 6).alias("age"), F.round((F.lit(1.0) - F.cos(age * F.lit(2 * math.pi / astro.SYNODIC))) / 2, 6).alias("fraction"))


def day_light(spark, d):
    n = _days()
    parts = scalars.light(astro.sun_altitude(n, LAT, LON), astro.moon_altitude(n, LAT, LON), astro.moon_fraction(n))
    return _orders(spark, d).select("o_orderkey", *[F.round(c, 4).alias(k) for k, c in parts.items()])


def damp_bands(spark, d):
    h, t, past = F.col("s") / F.lit(20.0), (F.col("k") % 13) / F.lit(8.0), (F.col("k") % 17) / F.lit(8.0)
    return _parts(spark, d).select("p_partkey", F.round(scalars.damp(h, t, past), 6).alias("hard"), F.round(scalars.damp(h, t, past, 0.8, 0.01), 6).alias("soft"))


def water_tones(spark, d):
    depth = F.col("s") * F.lit(0.6)
    tone = scalars.chained(depth, 0.8, WATER_STOPS)
    edge = F.lit(1.0) - F.lit(0.36) * scalars.smoothstep(0.42, 0.98, F.hypot((F.col("k") % 50) / F.lit(50.0) - 0.5, (F.col("k") % 40) / F.lit(40.0) - 0.5))
    return _parts(spark, d).select("p_partkey", F.round(tone, 6).alias("tone"), F.round(edge, 6).alias("vignette"), scalars.filmic(tone * edge, 1.0, 0.92).alias("byte"))


def view_frames(spark, d):
    """Centres held so that a view stays on the map, by zoom and ground aspect."""
    zoom = F.lit(0.1) + (F.col("k") % 80) / F.lit(100.0)
    aspect = (0.38 * 110.95) / (0.44 * 111.320 * math.cos(math.radians(37.6)))
    hw, hh = zoom * F.lit(4 / 3 * aspect / 2), zoom / 2
    return _parts(spark, d).select("p_partkey", F.round(scalars.held_centre(F.col("s") / 50, hw), 6).alias("cx"), F.round(scalars.held_centre((F.col("k") % 31) / F.lit(31.0), hh), 6).alias("cy"))


def civil_text(spark, d):
    """Local civil time, as a readout shows it, of dates twenty years on (the clocks' rule has stood since 2007)."""
    at = F.from_utc_timestamp(F.add_months("o_orderdate", 240).cast("timestamp") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int")), "Pacific/Auckland")
    return table(spark, d, "orders").select("o_orderkey", F.lower(F.date_format(at, "h:mm a")).alias("clock"), F.date_format(at, "E d MMM").alias("day"))


def grid_places(spark, d):
    """Pixels to degrees and back, and tiles to degrees and back."""
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 37 % 2600).alias("x"), (F.col("c_custkey") * 91 % 2600).alias("y"))
    lon, lat = scalars.lon_of(F.col("x"), 2600), scalars.lat_of(F.col("y"), 2600)
    return c.select("c_custkey", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"), scalars.x_of(scalars.lon_of(F.col("x") - 0.25, 2600), 2600).alias("x_back"), scalars.y_of(scalars.lat_of(F.col("y") - 0.25, 2600), 2600).alias("y_back"), F.round(scalars.tile_lon(F.col("x") + F.lit(32000.0), 16), 9).alias("tile_lon"), F.round(scalars.tile_lat(F.col("y") + F.lit(31000.0), 16), 9).alias("tile_lat"))


def pixel_area(spark, d):
    """Area of each class, a pixel's ground size following from its latitude."""
    one = scalars.pixel_km2(scalars.BOX, 50, max(1, _height(spark, d)))
    return _cells(spark, d).groupBy((F.col("v") > 25).alias("high")).agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) * F.lit(one), 6).alias("km2"))


def rank_rules(spark, d):
    """One share by the four ways in which it is turned into a rank."""
    rows, out = table(spark, d, "customer").select("c_mktsegment", "c_acctbal"), None
    n, p = F.col("n"), F.lit(0.985)
    for name, rank in {"floor_n": F.least(F.floor(n * p), n - 1), "floor_last": F.floor((n - 1) * p), "round_last": F.floor(p * (n - 1) + F.lit(0.5)), "held": F.least(n - 1, F.floor(p * n))}.items():
        one = scenes.at_rank(rows, ["c_mktsegment"], "c_acctbal", rank).withColumn("rule", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def scene_versions(spark, d):
    """One scene a minute: the highest version in its name, then the clearest, then the first seen."""
    e = table(spark, d, "events").select("event_id", F.date_trunc("minute", "ts").alias("minute_of"), "value", F.format_string("S2_%d_%d_L2A", "user_id", F.col("event_id") % 3).alias("id"))
    version = F.regexp_extract("id", r"_(\d+)_L2A$", 1).cast("int")
    return scenes.first_by(e.withColumn("version", version), ["minute_of"], [F.col("version").desc(), "value", "event_id"]).select("event_id", "id", "version")


def nodal_species(spark, d):
    """Factor and phase of every species on each day of an order."""
    days = _orders(spark, d).select("h").distinct().withColumn("n", tide.node_angle(F.col("h")))
    rows = [F.struct(F.lit(name).alias("name"), *[c.alias(k) for c, k in zip(tide.species(name, F.col("n")), "fu", strict=True)]) for name in sorted(tide.NODAL_OF | tide.NODAL_OF_OTHERS)]
    return days.select("h", F.explode(F.array(*rows)).alias("s")).select("h", "s.name", F.round("s.f", 6).alias("f"), F.round("s.u", 6).alias("u"))


def harmonic_basis(spark, d):
    """Cosine and sine of every fitted constituent on each day of an order."""
    t = F.col("h") - F.lit(tide.FIT_EPOCH)
    days = _orders(spark, d).select("h").distinct()
    rows = [F.struct(F.lit(n).alias("name"), F.cos(t * F.lit(math.radians(s))).alias("c"), F.sin(t * F.lit(math.radians(s))).alias("s")) for n, s in tide.FITTED]
    return days.select("h", F.explode(F.array(*rows)).alias("b")).select("h", "b.name", F.round("b.c", 5).alias("c"), F.round("b.s", 5).alias("s"))


def nearest_turning(spark, d):
    """For each event the minute, within three hours, at which the tide turns nearest to it (the earlier on ties); turning minutes are found once and met by cells of three hours."""
    minute = F.floor(tide.epoch_hours(F.col("ts")) * 60).cast("long")
    events = table(spark, d, "events").select("event_id", minute.alias("m"))
    span = events.agg(F.min("m").alias("a"), F.max("m").alias("b"))
    # Hours of the span, each with the minutes on both sides of it, so that every height is computed in its hour and differences stay within.
    hours = span.select(F.explode(F.sequence(F.floor((F.col("a") - 180) / 60), F.floor((F.col("b") + 180) / 60))).alias("hour")).repartition("hour")
    grid = hours.select("hour", F.explode(F.sequence(F.col("hour") * 60 - 1, F.col("hour") * 60 + 60)).alias("t")).withColumn("y", tide.height(F.col("t") / F.lit(60.0)))
    w = Window.partitionBy("hour").orderBy("t")
    near = grid.select("t", (F.col("y") - F.lag("y").over(w)).alias("before"), (F.lead("y").over(w) - F.col("y")).alias("after"))
    turns = near.filter(((F.col("before") > 0) & (F.col("after") <= 0)) | ((F.col("before") < 0) & (F.col("after") >= 0))).select("t", F.floor(F.col("t") / 180).alias("cell"))
    cells = events.select("event_id", "m", F.explode(F.sequence(F.floor(F.col("m") / 180) - 1, F.floor(F.col("m") / 180) + 1)).alias("cell"))
    met = cells.join(turns, "cell").filter(F.abs(F.col("t") - F.col("m")) <= 180)
    return met.groupBy("event_id").agg(F.min_by(F.col("t") - F.col("m"), F.struct(F.abs(F.col("t") - F.col("m")), F.col("t"))).alias("minutes"))


# --- SQL ---------------------------------------------------------------------------------------------------------------

_P = "p as (select p_partkey, p_size::double s, p_partkey::double k from part)"
_FR = lambda x: f"({x} - floor({x}))"
_HN = lambda x, y: _FR(f"(sin(({x}) * 127.1::double + ({y}) * 311.7::double) * 43758.5453123::double)")
_MUL = lambda a, b: f"((({a}) & 65535) * ({b}) + (((({a}) >> 16) * ({b})) & 65535) * 65536) & 4294967295"
_EASE = lambda t: f"({t} * {t} * (3 - {t} * 2))"


def _chain():
    out = "0.8::double"
    for lo, hi, value in WATER_STOPS:
        out = f"(({out}) + ({value}::double - ({out})) * {_STEP(lo, hi, 'dp')})" if len(out) < 20 else f"(select w + ({value}::double - w) * {_STEP(lo, hi, 'dp')} from (select {out} w))"
    return out


def _soft(lo, hi, x):
    t = f"least(greatest((({x}) - ({lo})) / (({hi}) - ({lo})), 0), 1)"
    return f"({t} * {t} * (3 - {t} * 2))"


_TILT_RA, _TILT_DEC = f"atan2(cos({_E}) * sin(sl), cos(sl))", f"asin(sin({_E}) * sin(sl))"
_LST = "(18.697374558::double + 24.06570982441908::double * n)"
_TURNED = f"(({_LST} - floor({_LST} / 24) * 24) + {LON}::double / 15)"
_HOUR = f"(({_TURNED} - floor({_TURNED} / 24) * 24) * 15 * pi() / 180 - {_TILT_RA})"
_LATR = f"({LAT}::double * pi() / 180)"
_AZ = f"(atan2(sin({_HOUR}), cos({_HOUR}) * sin({_LATR}) - tan({_TILT_DEC}) * cos({_LATR})) / (pi() / 180) + 180)"
_SUNS = _SUN.replace(_DAYS, f"select o_orderkey, {_H} / 24 + 8400.5::double + (o_orderkey % 24) / 24.0::double n from orders")
_SALT, _MALT = _altitude(_TILT_RA, _TILT_DEC), _altitude(f"atan2(sin(ml) * cos({_E}) - tan(mb) * sin({_E}), cos(ml))", f"asin(sin(mb) * cos({_E}) + cos(mb) * sin({_E}) * sin(ml))")
_ASPECT = (0.38 * 110.95) / (0.44 * 111.320 * math.cos(math.radians(37.6)))


def _species_sql():
    out = []
    for name in sorted(tide.NODAL_OF | tide.NODAL_OF_OTHERS):
        f, u = "1.0::double", "0.0::double"
        for basic, power, times in (tide.NODAL_OF | tide.NODAL_OF_OTHERS)[name]:
            f += f" * {_series(basic, 'n', 0)}" * power
            u += f" + ({times}) * {_series(basic, 'n', 1)}"
        out.append(f"select h, '{name}' as name, round({f}, 6) f, round({u}, 6) u from b")
    return f"with b as (select h, {_node('h')} n from (select distinct {_H} h from orders)) " + " union all ".join(out)


def _ranks_sql():
    rules = {"floor_n": "least(floor(n * 0.985::double), n - 1)", "floor_last": "floor((n - 1) * 0.985::double)", "round_last": "floor(0.985::double * (n - 1) + 0.5::double)", "held": "least(n - 1, floor(0.985::double * n))"}
    base = "with r as (select c_mktsegment, c_acctbal, row_number() over (partition by c_mktsegment order by c_acctbal) - 1 i, count(*) over (partition by c_mktsegment) n from customer) "
    return base + " union all ".join(f"select c_mktsegment, c_acctbal, '{name}' as rule from r where i = {rank}" for name, rank in rules.items())


_CLAMP = lambda x: f"least(greatest({x}, 0), 1)"
ORACLES = {
    "noise": f"with {_P}, q as (select *, k * 0.37::double x, s * 0.61::double y from p), c as (select *, floor(x) ix, floor(y) iy, {_EASE('(x - floor(x))')} ux, {_EASE('(y - floor(y))')} uy from q), e as (select *, {_HN('ix', 'iy')} + ({_HN('ix + 1', 'iy')} - {_HN('ix', 'iy')}) * ux top, {_HN('ix', 'iy + 1')} + ({_HN('ix + 1', 'iy + 1')} - {_HN('ix', 'iy + 1')}) * ux low from c) select p_partkey, round({_HN('k', 's')}, 4) hashed, round(top + (low - top) * uy, 4) smooth, round({_FR('(52.9829189::double * ' + _FR('(k * 0.06711056::double + s * 0.00583715::double)') + ')')}, 5) dither from e",
    "random_draws": f"""with a as (select p_partkey, (20260727 + ({_MUL('p_partkey::bigint', '1831565813::bigint')})) & 4294967295 a from part), t as (select *, {_MUL('xor(a, a >> 15)', '(a | 1)')} t from a), u as (select *, xor(t, (t + ({_MUL('xor(t, t >> 7)', '(t | 61)')})) & 4294967295) u from t)
select p_partkey, round(xor(u, u >> 14) / 4294967296.0::double, 9) draw, (p_partkey::bigint * 7919 % 2147483647 * 1103515245 + 12345) & 2147483647 state from u""",
    "depth_inverse": f"with {_P}, z as (select *, case when x <= 15 then 0.5::double * pow(greatest(x, 0) / 15, 0.6::double) else 0.5::double + 0.5::double * {_STEP(15, 40, 'x')} end sh from (select *, (s - 1) * 0.8::double x from p)) select p_partkey, round(sh, 6) shade, round(case when sh < 0.5 then 15.0::double * pow(greatest(sh * 2, 0), 5 / 3.0::double) else 15.0::double + 25.0::double * (0.5::double - sin(asin(1.0::double - least(greatest((sh - 0.5) * 2, 0), 1) * 2) / 3)) end, 5) depth from z",
    "colour_measures": f"with {_P}, c as (select p_partkey, s * 5 r, s * 3 + 7 g, k % 256 b from p) select p_partkey, round(coalesce((greatest(r, g, b) - least(r, g, b)) / nullif(greatest(r, g, b), 0), 0), 6) chroma, round((greatest(r, g, b) - (r + g + b) / 3) * 2 / 255, 6) saturation from c",
    "sun_azimuth": f"select o_orderkey, round({_AZ} - floor({_AZ} / 360) * 360, 3) azimuth from ({_SUNS})",
    "synodic_moon": f"with m as (select o_orderkey, n - {astro.NEW_MOON!r}::double q from ({_DAYS})), a as (select o_orderkey, q - floor(q / {astro.SYNODIC!r}::double) * {astro.SYNODIC!r}::double age from m) select o_orderkey, round(age, 6) age, round((1 - cos(age * {2 * math.pi / astro.SYNODIC!r}::double)) / 2, 6) fraction from a",
    "day_light": f"with z as (select o_orderkey, {_SALT} sa, {_MALT} ma, (1 - cos(mb) * cos(ml - sl)) / 2 fr from ({_MOON})), w as (select *, {_CLAMP('(12 - sa) / 18')} warm from z) select o_orderkey, round({_CLAMP('(sa + 6) / 11')}, 4) as day, round(warm, 4) warm, round(0.30::double + 0.70::double * {_CLAMP('(sa + 4) / 26')}, 4) intensity, round(least(1, fr * {_CLAMP('(ma + 2) / 16')}), 4) moonlight, round(1 + 0.30::double * warm, 4) red, round(1 - 0.05::double * warm, 4) green, round(1 - 0.34::double * warm, 4) blue from w",
    "damp_bands": f"with {_P}, z as (select p_partkey, s / 20.0::double h, k % 13 / 8.0::double t, k % 17 / 8.0::double q from p), w as (select *, 1 - (h - t) / greatest(q - t, 0.0001::double) f from z) select p_partkey, round({_CLAMP('case when q >= t + 0.0004::double and h >= t and h <= q then 1.0::double else 0 end * f')}, 6) hard, round({_CLAMP(_soft('t', 't + 0.004::double', 'q') + ' * ' + _soft('t - 0.01::double', 't + 0.01::double', 'h') + ' * (1 - ' + _soft('q - 0.01::double', 'q + 0.01::double', 'h') + ') * f * 0.8::double')}, 6) soft from w",
    "water_tones": f"with {_P}, z0 as (select *, s * 0.6::double dp, 0.8::double w0 from p), " + ", ".join(f"z{i + 1} as (select * exclude (w{i}), w{i} + ({v}::double - w{i}) * {_STEP(lo, hi, 'dp')} w{i + 1} from z{i})" for i, (lo, hi, v) in enumerate(WATER_STOPS)) + f", q as (select p_partkey, w{len(WATER_STOPS)} tone, 1 - 0.36::double * {_STEP(0.42, 0.98, 'sqrt(pow(k % 50 / 50 - 0.5, 2) + pow(k % 40 / 40 - 0.5, 2))')} e from z{len(WATER_STOPS)}) select p_partkey, round(tone, 6) tone, round(e, 6) vignette, cast(floor(255.0::double * pow(least(greatest(1 - exp(-tone * e), 0), 1), 0.92::double) + 0.5) as int) byte from q",
    "view_frames": f"with {_P}, z as (select *, 0.1::double + k % 80 / 100 zoom from p), h as (select *, zoom * {4 / 3 * _ASPECT / 2!r}::double hw, zoom / 2 hh from z) select p_partkey, round(least(greatest(s / 50, hw), 1 - hw), 6) cx, round(least(greatest(k % 31 / 31, hh), 1 - hh), 6) cy from h",
    "civil_text": """with o as (select o_orderkey, cast(o_orderdate as timestamp) + interval 20 year + to_hours(o_orderkey % 24) t from orders), b as (select *, make_date(year(t), 4, 1) a, make_date(year(t), 9, 30) s from o),
c as (select *, cast(a + cast((7 - dayofweek(a)) % 7 as integer) as timestamp) - interval 10 hour ends, cast(s - cast(dayofweek(s) as integer) as timestamp) - interval 10 hour begins from b), l as (select o_orderkey, t + case when t < ends or t >= begins then interval 13 hour else interval 12 hour end lt from c)
select o_orderkey, lower(strftime(lt, '%-I:%M %p')) clock, strftime(lt, '%a %-d %b') as day from l""",
    "grid_places": "with c as (select c_custkey, c_custkey * 37 % 2600 x, c_custkey * 91 % 2600 y from customer), g as (select *, 175.93::double + (x + 0.5::double) / 2600 * 0.44::double lon, -37.41::double - (y + 0.5::double) / 2600 * 0.38::double lat from c) select c_custkey, round(lon, 9) lon, round(lat, 9) lat, cast(floor((x + 0.25::double) + 0.5) as bigint) x_back, cast(floor((y + 0.25::double) + 0.5) as bigint) y_back, round((x + 32000.0::double) / 65536 * 360 - 180, 9) tile_lon, round(atan((exp(pi() - 2 * pi() * (y + 31000.0::double) / 65536) - exp(-(pi() - 2 * pi() * (y + 31000.0::double) / 65536))) / 2) * 180 / pi(), 9) tile_lat from g",
    "pixel_area": f"with {_A}, n as (select max(y) + 1 n from a) select v > 25 high, count(*) n, round(count(*) * (0.44::double * 111.320::double * cos(-75.2::double / 2 * pi() / 180) / 50 * 0.38::double * 110.574::double / (select n from n)), 6) km2 from a group by 1",
    "rank_rules": _ranks_sql(),
    "scene_versions": "select event_id, 'S2_' || user_id || '_' || event_id % 3 || '_L2A' id, cast(event_id % 3 as int) as version from events qualify row_number() over (partition by date_trunc('minute', ts) order by event_id % 3 desc, value, event_id) = 1",
    "nodal_species": _species_sql(),
    "harmonic_basis": f"with b as (select distinct {_H} h from orders) " + " union all ".join(f"select h, '{n}' as name, round(cos((h - {tide.FIT_EPOCH}::double) * {math.radians(s)!r}::double), 5) c, round(sin((h - {tide.FIT_EPOCH}::double) * {math.radians(s)!r}::double), 5) s from b" for n, s in tide.FITTED),
    "nearest_turning": f"""with e as (select event_id, cast(floor((date_diff('day', date '2023-01-01', cast(ts as date)) * 24 + hour(ts) + minute(ts) / 60.0::double + second(ts) / 3600.0::double) * 60) as bigint) m from events),
g as (select unnest(range((select min(m) from e) - 181, (select max(m) from e) + 182)) t), f as (select t, {sql_height('h')} y from (select *, {_node('h')} n from (select t, t / 60.0::double h from g))),
s as (select t, y - lag(y) over (order by t) b, lead(y) over (order by t) - y c from f), u as (select t from s where (b > 0 and c <= 0) or (b < 0 and c >= 0))
select event_id, t - m as minutes from e join u on t between m - 180 and m + 180 qualify row_number() over (partition by event_id order by abs(t - m), t) = 1""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
