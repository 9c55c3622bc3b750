"""Tide and time-series queries on the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from shoalgrid.functions import astro, tide
from shoalgrid.operators import series
from shoalgrid.session import table

LAT, LON = -37.6, 176.1


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate", tide.epoch_hours(F.col("o_orderdate")).alias("h"))


def tide_predict(spark, d):
    return _orders(spark, d).select("o_orderkey", F.round(tide.height(F.col("h")), 6).alias("height"))


def tide_without_nodal(spark, d):
    return _orders(spark, d).select("o_orderkey", F.round(tide.height(F.col("h"), nodal=False), 6).alias("height"))


def tide_derivative(spark, d):
    return _orders(spark, d).select("o_orderkey", F.round(tide.slope(F.col("h")), 6).alias("slope"))


def tide_effective(spark, d):
    lagged = F.col("h") - (F.col("o_orderkey") % 120) / F.lit(60.0)
    return _orders(spark, d).select("o_orderkey", F.round(tide.height(lagged), 6).alias("height"))


def tide_rate(spark, d):
    h = F.col("h")
    return _orders(spark, d).select("o_orderkey", F.round(tide.height(h + 0.5) - tide.height(h - 0.5), 6).alias("rate"), (tide.height(h) > tide.height(h - F.lit(1 / 6))).alias("rising"))


def tide_state(spark, d):
    h = F.col("h")
    return _orders(spark, d).select("o_orderkey", tide.state_word(tide.height(h), tide.height(h) > tide.height(h - F.lit(1 / 6))).alias("state"))


def tide_nodal(spark, d):
    n = tide.node_angle(F.col("h"))
    out = [F.round(tide.nodal_factor(c, n), 6).alias(f"f_{c.lower()}") for c in tide.NODAL] + [F.round(tide.nodal_phase(c, n), 6).alias(f"u_{c.lower()}") for c in tide.NODAL if c != "Mm"]
    return _orders(spark, d).select("o_orderkey", F.round(n, 6).alias("node"), *out)


def tide_range(spark, d):
    """Every ten minutes of two days, both ends included."""
    grid = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(2 * 1440), F.lit(10))).alias("minute"))
    return grid.select(F.col("minute").cast("long"), F.round(tide.height(F.lit(8760.0) + F.col("minute") / F.lit(60.0)), 6).alias("height"))


def tide_turning_grid(spark, d):
    """Turning points on a two-minute grid over a month: the slope changes sign since the grid point before."""
    grid = spark.range(0, 31 * 720).select((F.lit(8760.0) + F.col("id") / F.lit(30.0)).alias("h"), (F.col("id") * 2).alias("minute"))
    slopes = F.struct(tide.slope(F.col("h") - F.lit(1 / 30)).alias("a"), tide.slope(F.col("h")).alias("b"))
    grid = grid.select("minute", "h", F.explode(F.array(slopes)).alias("s")).select("minute", "h", "s.*")  # so that each slope is computed once
    turned = grid.filter(((F.col("a") > 0) & (F.col("b") <= 0)) | ((F.col("a") < 0) & (F.col("b") >= 0)))
    return turned.select("minute", F.when(F.col("a") > 0, "high").otherwise("low").alias("kind"), F.round(tide.height(F.col("h")), 5).alias("height"))


def _daily(spark, d):
    events = table(spark, d, "events")
    return events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.max("value").alias("h")).select("user_id", F.date_diff("day", F.lit("2024-01-01").cast("date")).cast("double").alias("t"), "h")


def tide_asof_cosine(spark, d):
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) / F.lit(86400.0)
    points = table(spark, d, "events").select("event_id", "user_id", day.alias("t"))
    return series.asof_interpolate(points, _daily(spark, d), ["user_id"]).select("event_id", F.round("h", 6).alias("h"))


def leave_one_out(spark, d):
    return series.leave_one_out(_daily(spark, d), ["user_id"], "t", "h").select("user_id", "t", F.round("estimate", 6).alias("estimate"))


def mid_points(spark, d):
    return series.mid_points(_daily(spark, d), ["user_id"], "t", "h", 2.0).select("user_id", F.round("mid_t", 6).alias("mid_t"), F.round("mid_h", 6).alias("mid_h"))


def nodal_ablation(spark, d):
    e = tide.height(F.col("h"), nodal=False) - tide.height(F.col("h"))
    return _orders(spark, d).agg(*series.error_summary(e)).select(*[F.round(c, 6).alias(c) for c in ("bias", "rmse", "max_abs", "mean_abs")])


def civil_offset(spark, d):
    return table(spark, d, "orders").select("o_orderkey", tide.civil_offset(F.col("o_orderdate")).alias("hours"))


def season_cos(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(tide.season(F.dayofyear("o_orderdate") - 1), 6).alias("season"))


def _days():
    return F.col("h") / F.lit(24.0) + F.lit(8400.5)


def sun_position(spark, d):
    return _orders(spark, d).select("o_orderkey", F.round(astro.sun_altitude(_days(), LAT, LON), 4).alias("altitude"))


def moon_phase(spark, d):
    n = _days()
    return _orders(spark, d).select("o_orderkey", F.round(astro.moon_altitude(n, LAT, LON), 4).alias("altitude"), F.round(astro.moon_fraction(n), 6).alias("fraction"), astro.moon_waxing(n).alias("waxing"))


def harmonic_normal_eq(spark, d):
    """Upper triangle of the normal equations of (1, cos, sin) for three speeds: one row for each pair, summed map-side first."""
    speeds = [s for _, s, _, _ in tide.CONSTITUENTS[:3]]
    basis = [F.lit(1.0), *[f(F.lit(s) * F.col("h")) for s in speeds for f in (F.cos, F.sin)]]
    rows = _orders(spark, d).join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    names = [f"b{i}" for i in range(len(basis))]
    rows = rows.select("o_totalprice", *[b.alias(n) for b, n in zip(basis, names, strict=True)])
    pairs = [(i, j) for i in range(7) for j in range(i, 7)]
    sums = [F.sum(F.col(f"b{i}") * F.col(f"b{j}")).alias(f"a_{i}_{j}") for i, j in pairs] + [F.sum(F.col(f"b{i}") * F.col("o_totalprice")).alias(f"r_{i}") for i in range(7)]
    one = rows.agg(*sums)
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.round(F.col(f"a_{i}_{j}"), 4).alias("total")) for i, j in pairs] + [F.struct(F.lit(i).alias("i"), F.lit(7).alias("j"), F.round(F.col(f"r_{i}"), 1).alias("total")) for i in range(7)]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def amplitude_phase(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(F.hypot(F.col("c_acctbal"), F.col("c_custkey").cast("double")), 6).alias("amplitude"), F.round(F.atan2(F.col("c_custkey").cast("double"), F.col("c_acctbal")), 6).alias("phase"))


def table_unpivot(spark, d):
    wide = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"), "l_extendedprice", "l_discount", "l_tax")
    return wide.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "measure", "value")


# --- SQL ---------------------------------------------------------------------------------------------------------------

_H = "(date_diff('second', timestamp '2023-01-01', o_orderdate) / 3600.0::double)"
_R = "(pi() / 180)"


def _node(h):
    return f"((125.04452::double - 1934.136261::double / 36525 * (8400.5::double + ({h}) / 24)) * {_R})"


def _series(name, n, part):
    coefficients = tide.NODAL[name][part]
    f = "cos" if part == 0 else "sin"
    start = 0 if part == 0 else 1
    return "(" + (" + ".join(f"({c!r})::double" + (f" * {f}({k} * {n})" if k else "") for k, c in enumerate(coefficients, start)) or "0") + ")" + (f" * {_R}" if part else "")


def sql_height(h, nodal=True, slope=False, n="n"):
    out = [] if slope else [f"{tide.MEAN_LEVEL!r}::double"]
    for name, speed, amplitude, phase in tide.CONSTITUENTS:
        size, angle = f"{amplitude!r}::double", f"{speed!r}::double * ({h}) - ({phase!r})::double"
        for basic, power, times in tide.NODAL_OF.get(name, ()) if nodal else ():
            size += f" * {_series(basic, n, 0)}" * power
            angle += f" - ({times}) * {_series(basic, n, 1)}"
        out.append(f"-({size}) * {speed!r}::double * sin({angle})" if slope else f"{size} * cos({angle})")
    return " + ".join(out)


def _at(shift="0", column="height", nodal=True, slope=False, source=f"select o_orderkey, {_H} h0 from orders"):
    """A relation with the key and the tide at h0 + shift."""
    return f"(select *, {sql_height('h', nodal, slope)} {column} from (select *, {_node('h')} n from (select *, h0 + ({shift}) h from ({source}))))"


_DAILY = "select user_id, date_diff('day', date '2024-01-01', cast(ts as date))::double t, max(value) h from events group by all"
_BETWEEN = "ha + (hb - ha) * (1 - cos(pi() * (t - ta) / (tb - ta))) / 2"
_DAYS = f"select o_orderkey, {_H} / 24 + 8400.5::double n from orders"
_SUN = f"select *, (280.460::double + 0.9856474::double * n) * {_R} + 1.915::double * {_R} * sin((357.528::double + 0.9856003::double * n) * {_R}) + 0.020::double * {_R} * sin(2 * (357.528::double + 0.9856003::double * n) * {_R}) sl from ({_DAYS})"
_MOON = f"select *, (218.316::double + 13.176396::double * n) * {_R} + 6.289::double * {_R} * sin((134.963::double + 13.064993::double * n) * {_R}) ml, 5.128::double * {_R} * sin((93.272::double + 13.229350::double * n) * {_R}) mb from ({_SUN})"
_E = f"(23.439::double * {_R})"


def _altitude(ra, dec):
    lst = f"(18.697374558::double + 24.06570982441908::double * n)"
    turn = f"(({lst} - floor({lst} / 24) * 24) + {LON}::double / 15)"
    return f"asin(sin({LAT}::double * {_R}) * sin({dec}) + cos({LAT}::double * {_R}) * cos({dec}) * cos(({turn} - floor({turn} / 24) * 24) * 15 * {_R} - ({ra}))) / {_R}"


def _normal():
    speeds = [s for _, s, _, _ in tide.CONSTITUENTS[:3]]
    basis = ["1::double", *[f"{f}({s!r}::double * h)" for s in speeds for f in ("cos", "sin")]]
    base = f"with b as (select o_totalprice p, {', '.join(f'{x} b{i}' for i, x in enumerate(basis))} from (select *, {_H} h from orders))"
    cells = [f"select {i} i, {j} j, round(sum(b{i} * b{j}), 4) total from b" for i in range(7) for j in range(i, 7)] + [f"select {i}, 7, round(sum(b{i} * p), 1) from b" for i in range(7)]
    return base + " " + " union all ".join(cells)


QUERIES = {
    f.__name__: f
    for f in (
        tide_predict, tide_without_nodal, tide_derivative, tide_effective, tide_rate, tide_state, tide_nodal, tide_range, tide_turning_grid, tide_asof_cosine,
        leave_one_out, mid_points, nodal_ablation, civil_offset, season_cos, sun_position, moon_phase, harmonic_normal_eq, amplitude_phase, table_unpivot,
    )
}
_RATE = f"select a.o_orderkey, a.h1 - b.h2 rate, c.h3 > e.h4 rising, c.h3 from {_at('0.5', 'h1')} a join {_at('-0.5', 'h2')} b using (o_orderkey) join {_at('0', 'h3')} c using (o_orderkey) join {_at('-1.0::double / 6', 'h4')} e using (o_orderkey)"
ORACLES = {
    "tide_predict": f"select o_orderkey, round(height, 6) height from {_at()}",
    "tide_without_nodal": f"select o_orderkey, round(height, 6) height from {_at(nodal=False)}",
    "tide_derivative": f"select o_orderkey, round(height, 6) slope from {_at(slope=True)}",
    "tide_effective": f"select o_orderkey, round(height, 6) height from {_at('-(o_orderkey % 120) / 60.0::double')}",
    "tide_rate": f"select o_orderkey, round(rate, 6) rate, rising from ({_RATE})",
    "tide_state": f"select o_orderkey, case when f < 0.14 then 'Low Tide' when f > 0.86 then 'High Tide' when f > 0.40 and f < 0.60 then 'Mid Tide' when rising then 'Flooding' else 'Draining' end state from (select *, (h3 - 0.332::double) / 1.795::double f from ({_RATE}))",
    "tide_nodal": "select o_orderkey, round(n, 6) node, " + ", ".join([f"round({_series(c, 'n', 0)}, 6) f_{c.lower()}" for c in tide.NODAL] + [f"round({_series(c, 'n', 1)}, 6) u_{c.lower()}" for c in tide.NODAL if c != "Mm"]) + f" from (select *, {_node('h')} n from (select o_orderkey, {_H} h from orders))",
    "tide_range": f"select minute, round(height, 6) height from {_at(source='select cast(m as bigint) as minute, 8760 + m / 60.0::double h0 from range(0, 2881, 10) r(m)')}",
    "tide_turning_grid": "select minute, case when a > 0 then 'high' else 'low' end kind, round(height, 5) height from "
    + _at("-1.0::double / 30", "a", slope=True, source="select id * 2 as minute, 8760 + id / 30.0::double h0 from range(31 * 720) r(id)")
    + " join (select minute, height b from " + _at("0", slope=True, source="select id * 2 as minute, 8760 + id / 30.0::double h0 from range(31 * 720) r(id)") + ") using (minute) join (select minute, height from "
    + _at("0", source="select id * 2 as minute, 8760 + id / 30.0::double h0 from range(31 * 720) r(id)") + ") using (minute) where (a > 0 and b <= 0) or (a < 0 and b >= 0)",
    "tide_asof_cosine": f"""with s as ({_DAILY}), k as (select user_id, t ta, h ha, lead(t) over w tb, lead(h) over w hb from s window w as (partition by user_id order by t)),
p as (select event_id, user_id, date_diff('day', date '2024-01-01', cast(ts as date)) + (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400.0::double t from events)
select event_id, round(case when t = ta then ha else {_BETWEEN} end, 6) h from p left join k on p.user_id = k.user_id and t >= ta and (t < tb or (tb is null and t = ta))""",
    "leave_one_out": f"select user_id, t, round({_BETWEEN}, 6) estimate from (select *, lag(t) over w ta, lag(h) over w ha, lead(t) over w tb, lead(h) over w hb from ({_DAILY}) window w as (partition by user_id order by t)) where ta is not null and tb is not null",
    "mid_points": f"select user_id, round(t + gap / 2, 6) mid_t, round((h + hb) / 2, 6) mid_h from (select *, lead(t) over w - t gap, lead(h) over w hb from ({_DAILY}) window w as (partition by user_id order by t)) where gap > 0 and gap <= 2",
    "nodal_ablation": f"select round(avg(e), 6) bias, round(sqrt(avg(e * e)), 6) rmse, round(max(abs(e)), 6) max_abs, round(avg(abs(e)), 6) mean_abs from (select a.x - b.y e from {_at('0', 'x', nodal=False)} a join {_at('0', 'y')} b using (o_orderkey))",
    "civil_offset": """with o as (select o_orderkey, o_orderdate t, make_date(year(o_orderdate), 4, 1) a, make_date(year(o_orderdate), 9, 30) s from orders)
select o_orderkey, case when t < a + cast((7 - dayofweek(a)) % 7 as integer) + interval 3 hour or t >= s - cast(dayofweek(s) as integer) + interval 2 hour then 13 else 12 end as hours from o""",
    "season_cos": "select o_orderkey, round(cos(2 * pi() * (dayofyear(o_orderdate) - 1 - 355) / 365.25::double), 6) season from orders",
    "sun_position": f"select o_orderkey, round({_altitude(f'atan2(cos({_E}) * sin(sl), cos(sl))', f'asin(sin({_E}) * sin(sl))')}, 4) altitude from ({_SUN})",
    "moon_phase": f"select o_orderkey, round({_altitude(f'atan2(sin(ml) * cos({_E}) - tan(mb) * sin({_E}), cos(ml))', f'asin(sin(mb) * cos({_E}) + cos(mb) * sin({_E}) * sin(ml))')}, 4) altitude, round((1 - cos(mb) * cos(ml - sl)) / 2, 6) fraction, (ml - sl) / {_R} - floor((ml - sl) / {_R} / 360) * 360 < 180 waxing from ({_MOON})",
    "harmonic_normal_eq": _normal(),
    "amplitude_phase": "select c_custkey, round(sqrt(c_acctbal * c_acctbal + c_custkey * c_custkey), 6) amplitude, round(atan2(c_custkey, c_acctbal), 6) phase from customer",
    "table_unpivot": " union all ".join(f"select l_orderkey, l_linenumber, '{c}' measure, cast({c} as double) as value from lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
}
