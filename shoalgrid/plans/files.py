"""Sources and sinks on the driver's tables: packed and read back, or written as the text that a file would hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalgrid.functions import scalars, tide
from shoalgrid.plans.raster import _A, _cells, _height
from shoalgrid.plans.series import _H, _orders
from shoalgrid.plans.waterline import _CLS, _OBS, N, classes, stack
from shoalgrid.session import table
from shoalgrid.shipping import ship
from shoalgrid.sources import planes, rasters

#: Colours of a preview by class, and stops of the height ramp (metres, bytes).
PALETTE = {0: "#0b3d91", 64: "#808080", 128: "#e0c080", 255: "#2e6b2e"}
RAMP = [(0.0, (8, 29, 88)), (600.0, (34, 94, 168)), (1200.0, (65, 182, 196)), (1800.0, (199, 233, 180)), (2400.0, (255, 255, 217))]


def tile_composite(spark, d):
    """Tiles of 25 by 25 cells as arrays, laid side by side again; alpha 0 is no value."""
    side = 25
    cells = _cells(spark, d).select(F.floor(F.col("x") / side).alias("gx"), F.floor(F.col("y") / side).alias("gy"), (F.col("y") % side * side + F.col("x") % side).alias("i"), F.col("v").cast("int").alias("v"), F.when((F.col("x") + F.col("y")) % 6 == 0, 0).otherwise(255).alias("alpha"))
    slots = cells.select("gx", "gy").distinct().select("gx", "gy", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("i"))
    dense = slots.join(cells, ["gx", "gy", "i"], "left").groupBy("gx", "gy").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("alpha", F.lit(0)).alias("a")))).alias("t"))
    return rasters.composite(dense.select("gx", "gy", F.col("t.v").alias("values"), F.col("t.a").alias("alpha")), side).filter("value is not null")


def float_grid(spark, d):
    """Raw grids of 50 by 8 cells, written and read back."""
    strips = _cells(spark, d).select(F.floor(F.col("y") / 8).cast("int").alias("strip"), "x", (F.col("y") % 8).alias("y"), (F.col("v") / 4).alias("v"))
    back = rasters.unpack_rows(rasters.pack_rows(strips, "strip", "v", 50, 8), "strip", 50, 8)
    return back.filter("value > 0").select("x", (F.col("strip") * 8 + F.col("y")).alias("y"), "value")


def fit_file(spark, d):
    """Height code, class and misfit of every pixel, packed and read back."""
    fits = classes(spark, d).select(F.floor(F.col("pixel") / 512).cast("int").alias("part"), F.col("pixel"), F.when(F.col("height").isNotNull(), scalars.encode_height(F.col("height") / 1000)).otherwise(0).cast("int").alias("code"), "cls", F.least("misfit", F.lit(255)).cast("int").alias("misfit"))
    back = rasters.unpack_fits(rasters.pack_fits(fits, "part"), "part")
    return back.join(fits.select("pixel"), "pixel", "left_semi").select("pixel", "code", "cls", "misfit")


def plane_stack(spark, d):
    """Two planes a scene, packed 32 pixels to a word, with the scenes' list as JSON; counted after they are read back."""
    obs = stack(spark, d).select(F.col("p").alias("scene"), "pixel", "v", "w")
    both = None
    for kind, flag in (("valid", "v"), ("water", "w")):
        one = planes.pack_plane(obs, "scene", "pixel", flag).withColumn("kind", F.lit(kind))
        both = one if both is None else both.unionByName(one)
    listed = F.lit("[" + ",".join(f'{{"id":{p},"tide":{p * 2300 // 29}}}' for p in range(N)) + "]")
    return rasters.stack_of_planes(both, listed).groupBy("scene", "tide").agg(F.count(F.lit(1)).alias("valid"), F.sum("w").alias("water"), F.sum("pixel").alias("pixels"))


def masked_bytes(spark, d):
    """Gray levels with their mask, a file a scene, read back."""
    obs = stack(spark, d).select(F.col("p").alias("scene"), F.col("pixel").alias("i"), ((F.col("pixel") * 3 + F.col("p") * 5) % 256).cast("int").alias("gray"), F.col("v").alias("valid"))
    back = rasters.unpack_masked(rasters.pack_masked(obs, "scene"), "scene")
    return back.groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.sum("gray").alias("gray"), F.sum(F.col("i") * F.col("gray")).alias("check"))


def class_images(spark, d):
    """Class rasters as images of bytes, in strips, read back."""
    cells = classes(spark, d).select(F.floor(F.col("pixel") / 800).cast("int").alias("strip"), (F.col("pixel") % 50).cast("int").alias("x"), (F.floor(F.col("pixel") / 50) % 16).cast("int").alias("y"), F.col("cls"))

    def write(pdf):
        import numpy as np
        import pandas as pd

        out = np.zeros((16, 50), np.uint8)
        out[pdf.y, pdf.x] = pdf.cls
        return pd.DataFrame({"strip": [pdf.strip.iloc[0]], "png": [planes.encode_png8(out)]})

    def read(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for strip, png in zip(pdf.strip, pdf.png, strict=True):
                v = planes.decode_png8(bytes(png))
                y, x = np.nonzero(v)
                yield pd.DataFrame({"strip": strip, "x": x, "y": y, "cls": v[y, x].astype(int)})

    ship(spark)
    images = cells.groupBy("strip").applyInPandas(write, "strip int, png binary")
    return images.mapInPandas(read, "strip int, x int, y int, cls int").select((F.col("strip") * 800 + F.col("y") * 50 + F.col("x")).cast("long").alias("pixel"), "cls")


def catalogue_pages(spark, d):
    """Scenes of a paged catalogue, page after page by the name of the next, clear ones only."""
    s = table(spark, d, "supplier").select("s_suppkey", F.floor(F.col("s_suppkey") / 20).alias("page"))
    feature = F.struct(F.concat(F.lit("S"), F.col("s_suppkey")).alias("id"), F.struct(F.concat(F.lit("2024-01-"), F.lpad((F.col("s_suppkey") % 28 + 1).cast("string"), 2, "0")).alias("datetime"), (F.col("s_suppkey") * 7 % 50).cast("double").alias("cloud"), (F.col("s_suppkey") % 9).cast("double").alias("nodata")).alias("properties"))
    pages = s.groupBy("page").agg(F.collect_list(feature).alias("features"))
    pages = pages.select(F.concat(F.lit("p"), F.col("page")).alias("name"), F.to_json(F.struct("features", F.concat(F.lit("p"), F.col("page") + 1).alias("next"))).alias("body"))
    return rasters.follow_pages(pages, "p0", 10_000).filter("cloud < 20 and nodata < 5")


def first_good_tile(spark, d):
    """Of each day's candidates the first, by hour, with a value above a bound."""
    e = table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day"), F.hour("ts").alias("rank")).agg(F.max("value").alias("brightest"), F.count(F.lit(1)).alias("n"))
    return rasters.first_good(e, ["day"], "rank", F.col("brightest") > 400).select(F.col("day").cast("string").alias("day"), "rank", "brightest", "n")


def tombstones(spark, d):
    """Tiles as a cache keeps them: those that came back empty are kept as such and not asked for again."""
    p = table(spark, d, "pages").select("page_id", F.octet_length("html").cast("long").alias("bytes"))
    kept = p.withColumn("payload", F.when(F.col("bytes") % 5 != 0, F.col("bytes")))
    return kept.groupBy(F.col("payload").isNull().alias("tombstone")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("payload", F.lit(0))).alias("bytes"))


def window_read(spark, d):
    """Cells of a window, by the tiles that it touches first, so that a table partitioned by tile is read there only."""
    x, y = F.col("x"), F.col("y")
    tiled = _cells(spark, d).withColumns({"tx": F.floor(x / 16), "ty": F.floor(y / 16)})
    return tiled.filter("tx between 0 and 2 and ty between 0 and 1").filter("x between 7 and 40 and y between 5 and 25").select("x", "y", "v")


def artifact_json(spark, d):
    """An artifact's text: nested objects, a row a brand."""
    p = table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("p_size").alias("least"), F.max("p_size").alias("most"))
    return p.select("p_brand", F.to_json(F.struct(F.col("p_brand").alias("brand"), F.struct("n", "least", "most").alias("sizes"))).alias("body"))


def json_nested(spark, d):
    """What the artifacts' text holds, read back with a given schema."""
    body = F.from_json("body", "brand string, sizes struct<n:long,least:int,most:int>").alias("b")
    return artifact_json(spark, d).select(body).select("b.brand", "b.sizes.n", "b.sizes.least", "b.sizes.most")


def preview_colours(spark, d):
    """A preview's colours: by class, and between stops by height."""
    c = classes(spark, d)
    code = F.lit(PALETTE[64])
    for cls, colour in PALETTE.items():
        code = F.when(F.col("cls") == cls, colour).otherwise(code)
    flat = [F.round(scalars.hex_channel(code, k) * 255).cast("int").alias(n) for k, n in enumerate("rgb")]
    ramped = [scalars.half_up(scalars.ramp(F.coalesce(F.col("height"), F.lit(0.0)), RAMP, k)).cast("int").alias(f"h{n}") for k, n in enumerate("rgb")]
    return c.select("pixel", *flat, *ramped)


def review_states(spark, d):
    """The parameter table of a review sheet: tide states by light by way, each with its cell."""
    states = spark.createDataFrame([(0, "low", 0.4), (1, "mid", 1.2), (2, "high", 2.0), (3, "spring", 2.1), (4, "neap", 0.9)], "i int, state string, tide double")
    lights = spark.createDataFrame([(0, "dawn", -3.0), (1, "noon", 45.0), (2, "night", -20.0)], "j int, light string, sun double")
    return states.crossJoin(lights).select("state", "light", "tide", "sun", (F.col("j") * 320).alias("left"), (F.col("i") * 240).alias("top"))


def report_lines(spark, d):
    """A report's table as text, a line a class."""
    counts = classes(spark, d).groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum("misfit").alias("errors"))
    return counts.select("cls", F.format_string("| %d | %d | %d |", "cls", "n", "errors").alias("line"))


def provenance_card(spark, d):
    """What a file's card says of it: source, size, hash, box, datum and licence."""
    box = "[" + ",".join(str(b) for b in scalars.BOX) + "]"
    card = F.concat(F.lit('{"source":"'), F.col("url"), F.lit('","bytes":'), F.octet_length("html").cast("string"), F.lit(',"sha256":"'), F.sha2(F.col("html").cast("binary"), 256), F.lit(f'","bbox":{box},"datum":"MSL","licence":"CC BY 4.0"}}'))
    return table(spark, d, "pages").select("page_id", card.alias("card"))


def tide_from_table(spark, d):
    """A fitted model kept as a table: heights are a join with it and a sum, not an expression."""
    model = spark.createDataFrame([(n, s, a, p) for n, s, a, p in tide.CONSTITUENTS], "name string, speed double, amplitude double, phase double")
    days = _orders(spark, d).select("h").distinct().crossJoin(F.broadcast(model))
    term = F.col("amplitude") * F.cos(F.col("speed") * F.col("h") - F.col("phase"))
    return days.groupBy("h").agg(F.round(F.lit(tide.MEAN_LEVEL) + F.sum(term), 6).alias("height"))


def text_codes(spark, d):
    """Base64 in one line: Spark breaks it after every 76 characters."""
    return table(spark, d, "pages").select("page_id", F.translate(F.base64(F.col("url").cast("binary")), "\r\n", "").alias("code"))


def status_map(spark, d):
    """Counts by status as a map for each priority, read by key and as entries."""
    o = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    m = o.groupBy("o_orderpriority").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    entries = F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return m.select("o_orderpriority", F.coalesce(F.try_element_at("m", F.lit("F")), F.lit(0)).alias("finished"), F.map_contains_key("m", "X").alias("odd"), F.size("m").alias("keys"), entries.alias("entries"))


def padded_text(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("padded"), F.rpad("c_mktsegment", 12, ".").alias("dotted"), F.format_string("%.2f", F.col("c_acctbal")).alias("fixed"), F.upper(F.substring("c_name", 1, 4)).alias("head"))


# --- SQL ---------------------------------------------------------------------------------------------------------------


def _ramp_sql(k):
    out = f"{RAMP[-1][1][k]}::double"
    for (a, ca), (b, cb) in reversed(list(zip(RAMP, RAMP[1:], strict=False))):
        out = f"case when h < {b} then {ca[k]} + {cb[k] - ca[k]}::double * least(greatest((h - {a}) / {b - a}::double, 0), 1) else {out} end"
    return f"cast(floor({out} + 0.5) as int)"


_FLAT = {n: "case cls " + " ".join(f"when {c} then {int(p[1 + 2 * k : 3 + 2 * k], 16)}" for c, p in PALETTE.items()) + " end" for k, n in enumerate("rgb")}
ORACLES = {
    "masked_bytes": f"with {_OBS} select cast(p as int) scene, count(*) n, cast(sum((pixel * 3 + p * 5) % 256) as bigint) gray, cast(sum(pixel * ((pixel * 3 + p * 5) % 256)) as bigint) as check from obs where v = 1 group by 1",
    "class_images": f"with {_OBS}, {_CLS} select pixel, cls from cls where cls <> 0",
    "tile_composite": f"with {_A} select x, y, cast(v as int) as value from a where (x + y) % 6 <> 0",
    "float_grid": f"with {_A} select x, y, v / 4 as value from a where v > 0",
    "fit_file": f"with {_OBS}, {_CLS} select pixel, cast(case when height is null then 0 else least(greatest(floor(1 + height / 1000 / 2.5::double * 65533 + 0.5), 1), 65534) end as int) code, cls, cast(least(misfit, 255) as int) misfit from cls",
    "plane_stack": f"with {_OBS} select cast(p as int) scene, cast(tide as int) tide, count(*) valid, cast(sum(w) as bigint) water, cast(sum(pixel) as bigint) pixels from obs where v = 1 group by 1, 2",
    "catalogue_pages": "select 'S' || s_suppkey id, '2024-01-' || lpad(cast(s_suppkey % 28 + 1 as varchar), 2, '0') datetime, (s_suppkey * 7 % 50)::double cloud, (s_suppkey % 9)::double nodata from supplier where s_suppkey * 7 % 50 < 20 and s_suppkey % 9 < 5",
    "first_good_tile": "select strftime(day, '%Y-%m-%d') as day, cast(rank as int) as rank, brightest, n from (select cast(ts as date) as day, hour(ts) as rank, max(value) brightest, count(*) n from events group by all) where brightest > 400 qualify row_number() over (partition by day order by rank) = 1",
    "tombstones": "select octet_length(encode(html)) % 5 = 0 tombstone, count(*) n, cast(sum(case when octet_length(encode(html)) % 5 <> 0 then octet_length(encode(html)) else 0 end) as bigint) bytes from pages group by 1",
    "window_read": f"with {_A} select x, y, v from a where x between 7 and 40 and y between 5 and 25",
    "artifact_json": """select p_brand, '{"brand":"' || p_brand || '","sizes":{"n":' || count(*) || ',"least":' || min(p_size) || ',"most":' || max(p_size) || '}}' body from part group by 1""",
    "json_nested": "select p_brand brand, count(*) n, cast(min(p_size) as int) least, cast(max(p_size) as int) most from part group by 1",
    "preview_colours": f"with {_OBS}, {_CLS} select pixel, {', '.join(f'{e} as {n}' for n, e in _FLAT.items())}, {', '.join(f'{_ramp_sql(k)} as h{n}' for k, n in enumerate('rgb'))} from (select *, coalesce(height, 0) h from cls)",
    "review_states": "select state, light, tide, sun, cast(j * 320 as int) as \"left\", cast(i * 240 as int) top from (values (0, 'low', 0.4::double), (1, 'mid', 1.2::double), (2, 'high', 2.0::double), (3, 'spring', 2.1::double), (4, 'neap', 0.9::double)) s(i, state, tide), (values (0, 'dawn', -3.0::double), (1, 'noon', 45.0::double), (2, 'night', -20.0::double)) l(j, light, sun)",
    "report_lines": f"with {_OBS}, {_CLS} select cls, '| ' || cls || ' | ' || count(*) || ' | ' || cast(sum(misfit) as bigint) || ' |' line from cls group by cls",
    "provenance_card": """select page_id, '{"source":"' || url || '","bytes":' || octet_length(encode(html)) || ',"sha256":"' || sha256(html) || '","bbox":[""" + ",".join(str(b) for b in scalars.BOX) + """],"datum":"MSL","licence":"CC BY 4.0"}' card from pages""",
    "tide_from_table": f"select h, round({tide.MEAN_LEVEL!r}::double + " + " + ".join(f"{a!r}::double * cos({s!r}::double * h - ({p!r})::double)" for _, s, a, p in tide.CONSTITUENTS) + f", 6) height from (select distinct {_H} h from orders)",
    "text_codes": "select page_id, base64(encode(url)) code from pages",
    "status_map": "select o_orderpriority, cast(coalesce(sum(n) filter (o_orderstatus = 'F'), 0) as bigint) finished, false odd, cast(count(*) as int) as keys, string_agg(o_orderstatus || '=' || n, ',' order by o_orderstatus || '=' || n) entries from (select o_orderpriority, o_orderstatus, count(*) n from orders group by all) group by 1",
    "padded_text": "select c_custkey, lpad(cast(c_custkey as varchar), 9, '0') padded, rpad(c_mktsegment, 12, '.') dotted, printf('%.2f', c_acctbal) as fixed, upper(substr(c_name, 1, 4)) head from customer",
}
QUERIES = {name: globals()[name] for name in ORACLES}
