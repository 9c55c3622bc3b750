"""Operators of the core against naive versions, with tiles, cells and limits small enough to matter."""

import heapq
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalgrid.functions import scalars, tide
from shoalgrid.operators import flow, focal, grid, scenes, series, stepfit
from shoalgrid.sources import planes, rasters
from shoalgrid.streaming import accumulate


def _congruential(seed):
    while True:
        seed = seed * 1103515245 + 12345 & 0x7FFFFFFF
        yield seed / 0x7FFFFFFF


def test_held_out_fits_are_refits(spark):
    """Random pixels of the generator that the check of old used, some with few or no valid scenes; every held-out cut against a refit without that scene."""
    n, draw = 23, _congruential(7)
    rows, want, fits = [], {}, {}
    for pixel in range(120):
        cut, noise = next(draw) * n, next(draw) * 0.5
        v = [int(next(draw) > (0.95 if pixel % 10 == 0 else 0.2)) for _ in range(n)]
        w = [v[p] * int((p >= cut) != (next(draw) < noise)) for p in range(n)]
        rows += [(pixel, p, v[p], w[p]) for p in range(n)]
        errors = np.array([[v[p] * int((p >= k) != w[p]) for p in range(n)] for k in range(n + 1)])
        best = np.flatnonzero(errors.sum(axis=1) == errors.sum(axis=1).min())
        fits[pixel] = ((best[0] + best[-1]) // 2, errors.sum(axis=1).min(), sum(v))
        for out in range(n):
            left = errors.sum(axis=1) - errors[:, out]
            best = np.flatnonzero(left == left.min())
            want[pixel, out] = (best[0] + best[-1]) // 2
    obs = spark.createDataFrame(rows, "pixel long, p int, v int, w int")
    got = stepfit.leave_one_out(obs, n).collect()
    assert {(r["pixel"], r["p"]): r["k"] for r in got} == want
    assert all(r["wet"] == int(r["p"] >= r["k"]) for r in got)
    assert {r["pixel"]: (r["k"], r["misfit"], r["valid"]) for r in stepfit.fit(obs, n).collect()} == fits
    keyed = obs.withColumns({"a": F.col("pixel") % 3, "b": F.concat(F.lit("k"), F.col("pixel") % 2)})
    counts = {(r["a"], r["b"], r["p"]): (r["tp"], r["fp"], r["fn"], r["tn"]) for r in stepfit.held_out_confusion(keyed, n, ("a", "b", "pixel"), ("a", "b")).collect()}
    assert len(counts) == 6 * n
    for (a, b, p), c in counts.items():
        mine = [(v, w, want[pixel, p]) for pixel, q, v, w in rows if q == p and pixel % 3 == a and f"k{pixel % 2}" == b and v]
        assert c == tuple(sum(w == truth and (p >= k) == said for _, w, k in mine) for truth, said in ((1, True), (0, True), (1, False), (0, False)))


def test_orders_in_memory_are_orders_of_rows(spark):
    rng = random.Random(12)
    rows = [(pixel, pixel % 3, p, v := int(rng.random() < 0.8), v * int(rng.random() < p / 12)) for pixel in range(60) for p in range(12)]
    obs = spark.createDataFrame(rows, "pixel long, g int, p int, v int, w int")
    orders = {5: list(range(12)), 9: [11, 3, 4, 0, 1, 2, 5, 6, 7, 10, 9, 8], 2: [6, 1, 8, 3]}
    got = {(r["g"], r["order"], r["scene"]): tuple(r[c] for c in ("tp", "fp", "fn", "tn")) for r in stepfit.held_out_orders(obs, 12, "g", orders, {0: [5, 9], 1: [2], 2: [9]}).collect()}
    want = {}
    for g, mine in {0: [5, 9], 1: [2], 2: [9]}.items():
        for o in mine:
            place = {s: k for k, s in enumerate(orders[o])}
            again = spark.createDataFrame([(pixel, place[p], v, w) for pixel, h, p, v, w in rows if h == g and p in place], "pixel long, p int, v int, w int")
            want |= {(g, o, orders[o][r["p"]]): tuple(r[c] for c in ("tp", "fp", "fn", "tn")) for r in stepfit.held_out_confusion(again, len(place)).collect()}
    assert got == want


def test_missing_scenes_count_as_not_seen(spark):
    whole = [(1, p, int(p != 3), int(p > 4)) for p in range(8)]
    full, part = (spark.createDataFrame(r, "pixel long, p int, v int, w int") for r in (whole, [r for r in whole if r[1] != 3]))
    assert stepfit.fit(full, 8).collect() == stepfit.fit(part, 8).collect()
    assert stepfit.leave_one_out(full, 8).filter("p <> 3").sort("p").collect() == stepfit.leave_one_out(part, 8).sort("p").collect()


@pytest.mark.parametrize("most", [1 << 20, 50])
def test_asof_on_one_busy_key(spark, most):
    rng = random.Random(3)
    knots = sorted(rng.sample(range(1000), 40))
    level = {t: rng.random() for t in knots}
    points = [(i, 1, float(rng.randrange(-20, 1020))) for i in range(500)]
    knot_rows = spark.createDataFrame([(1, float(t), h) for t, h in level.items()], "k int, t double, h double")
    got = series.asof_interpolate(spark.createDataFrame(points, "id int, k int, t double"), knot_rows, ["k"], most=most).collect()
    assert len(got) == len(points)
    for r in got:
        before, after = [t for t in knots if t <= r["t"]], [t for t in knots if t > r["t"]]
        if not before or (not after and before[-1] != r["t"]):
            assert r["h"] is None
        else:
            a = level[before[-1]]
            share = (r["t"] - before[-1]) / (after[0] - before[-1]) if after else 0.0
            assert r["h"] == pytest.approx(a if before[-1] == r["t"] else a + (level[after[0]] - a) * (1 - np.cos(np.pi * share)) / 2)


def test_neighbours_across_ranges_of_time(spark):
    rng = random.Random(4)
    rows = [(k, float(t), rng.random()) for k, n in ((1, 300), (None, 40), (2, 1), (3, 2)) for t in rng.sample(range(900), n)]
    frame = spark.createDataFrame(rows, "k int, t double, h double").repartition(7)
    for f in (lambda most: series.leave_one_out(frame, ["k"], "t", "h", most), lambda most: series.mid_points(frame, ["k"], "t", "h", 4.0, most)):
        whole, split = (sorted(map(tuple, f(most).collect()), key=str) for most in (1 << 20, 30))
        assert whole == split and whole
    inner = series.leave_one_out(frame, ["k"], "t", "h", 30).collect()
    assert sum(r["k"] == 1 for r in inner) == 298 and sum(r["k"] is None for r in inner) == 38 and not any(r["k"] == 2 for r in inner)


def _mask(seed, width=23, height=19, share=0.6):
    rng = random.Random(seed)
    return {(x, y) for x in range(width) for y in range(height) if rng.random() < share}


def _frame(spark, cells):
    return spark.createDataFrame(sorted(cells), "x int, y int")


@pytest.mark.parametrize("diagonal", [True, False])
def test_components_across_tiles(spark, diagonal):
    cells = _mask(5, share=0.45 if diagonal else 0.6)
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (diagonal or not (i and j))]
    label, left = {}, set(cells)
    while left:
        seen = [min(left, key=lambda c: (c[1], c[0]))]
        first = seen[0]
        left.discard(first)
        for x, y in seen:
            label[x, y] = (first[1], first[0])
            for i, j in steps:
                if (x + i, y + j) in left:
                    left.discard((x + i, y + j))
                    seen.append((x + i, y + j))
    shifted = lambda c: (c[0] - 7, c[1] - 4)
    got = {(r["x"], r["y"]): tuple(r["comp"]) for r in grid.components(_frame(spark, map(shifted, cells)), diagonal, tile=5).collect()}
    assert got == {shifted(c): (b - 4, a - 7) for c, (b, a) in label.items()}


def _ways(cells, seeds, costs, limit):
    dist, heap = {c: float("inf") for c in cells}, []
    for c in seeds:
        dist[c] = 0.0
        heap.append((0.0, c))
    while heap:
        d, (x, y) = heapq.heappop(heap)
        for (i, j), cost in costs.items():
            if (n := (x + i, y + j)) in dist and d + cost < dist[n] and d + cost <= limit:
                dist[n] = d + cost
                heapq.heappush(heap, (d + cost, n))
    return dist


@pytest.mark.parametrize(("diagonal", "limit"), [(1.562, float("inf")), (None, float("inf")), (1.562, 9.0)])
def test_distances_across_tiles_with_unequal_steps(spark, diagonal, limit):
    cells = _mask(8, share=0.72)
    costs = {(i, j): 1.0 if not j else 1.2 if not i else diagonal for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (diagonal or not (i and j))}
    want = _ways(cells, [c for c in cells if c[0] == 0], costs, limit)
    got = {(r["x"], r["y"]): r["dist"] for r in grid.distance(_frame(spark, cells), F.col("x") == 0, 1.0, 1.2, diagonal, tile=4, limit=limit).collect()}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c], abs=1e-9) for c in want)
    assert max(d for d in want.values() if d < float("inf")) > 8


@pytest.mark.parametrize("grows", [True, False])
def test_morphology_across_tiles(spark, grows):
    on, radius = _mask(2, share=0.1 if grows else 0.93), 3
    frame = spark.createDataFrame([(x, y, int((x, y) in on)) for x in range(23) for y in range(19)], "x int, y int, m int")
    ball = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius]
    check = any if grows else all
    got = (grid.dilate if grows else grid.erode)(frame, "m", radius, tile=4).collect()
    assert len(got) == 23 * 19 and all(r["m"] == check((r["x"] + i, r["y"] + j) in on for i, j in ball) for r in got)


def test_gaps_of_any_width_are_filled_from_the_nearest(spark):
    rng = random.Random(9)
    cells = {(x, y): float(rng.randrange(90)) if rng.random() < 0.05 else None for x in range(31) for y in range(17)}
    known = {c: v for c, v in cells.items() if v is not None}
    want = {(x, y): known[min(known, key=lambda c: ((c[0] - x) ** 2 + (c[1] - y) ** 2, c[1], c[0]))] for (x, y), v in cells.items() if v is None}
    got = focal.fill_nearest(spark.createDataFrame([(*c, v) for c, v in cells.items()], "x int, y int, v double"), "v").collect()
    assert {(r["x"], r["y"]): r["v"] for r in got} == want
    assert not focal.fill_nearest(spark.createDataFrame([(0, 0, None), (1, 0, None)], "x int, y int, v double"), "v").collect()


def test_nearest_targets_near_and_far(spark):
    rng = random.Random(11)
    targets = [(rng.random() * 5, rng.random() * 5) for _ in range(60)] + [(300.0, 300.0)]
    points = [(i, rng.random() * s, rng.random() * s) for i, s in enumerate([4, 20, 90, 500] * 40)]
    got = {r["id"]: r["d2"] for r in focal.nearest_distance(spark.createDataFrame(points, "id int, px double, py double"), spark.createDataFrame(targets, "px double, py double"), "id", 2.0, 150.0).collect()}
    want = {i: min((x - a) ** 2 + (y - b) ** 2 for a, b in targets) for i, x, y in points}
    assert got.keys() == {i for i, d in want.items() if d <= 150.0**2} and all(got[i] == pytest.approx(want[i]) for i in got)


def test_ranks_without_sorting_a_key(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([1e9, -5.0, 0.0, 3.25]) if rng.random() < 0.3 else rng.gauss(0, 1)) for _ in range(5000)] + [("flat", 2.0)] * 900 + [("few", float(i)) for i in range(7)] + [(None, float(i % 50)) for i in range(400)]
    frame = spark.createDataFrame(rows, "k string, v double")
    for rank, place in ((F.floor(F.col("n") / 2), lambda n: n // 2), (F.lit(0), lambda n: 0), (F.col("n") - 1, lambda n: n - 1), (F.floor(F.col("n") * 0.985), lambda n: int(n * 0.985))):
        got = {r["k"]: r["v"] for r in scenes.at_rank(frame, ["k"], "v", rank, most=40).collect()}
        mine = {k: sorted(v for j, v in rows if j == k) for k in ("hot", "flat", "few", None)}
        assert got == {k: v[place(len(v))] for k, v in mine.items()}


def test_numbers_of_a_hot_key(spark):
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 7}", i * 7919 % 1009, i) for i in range(1200)]
    got = scenes.numbered(spark.createDataFrame(rows, "k string, a int, b int").repartition(5), ["k"], ["a", "b"], "n").collect()
    for key in {r[0] for r in rows}:
        assert [r["n"] for r in sorted((r for r in got if r["k"] == key), key=lambda r: (r["a"], r["b"]))] == list(range(sum(r[0] == key for r in rows)))


def test_furthest_partners(spark):
    rng = random.Random(2)
    rows = [(v, rng.randrange(400) if v % 4 else 77) for v in range(300)]
    want = {}
    for v, level in rows:
        if v % 2 == 0:
            near = [(abs(v - u), -u) for u, other in rows if u % 2 and abs(level - other) <= 6]
            if near:
                gap, u = max(near)
                want[v] = (-u, gap)
    got = scenes.furthest_partner(spark.createDataFrame(rows, "value long, level long"), F.col("value") % 2 == 0, F.col("value") % 2 == 1, "level", "value", 6)
    assert {r["id"]: (r["partner"], r["gap"]) for r in got.collect()} == want


def test_streamlines_from_tile_to_tile(spark):
    """Against the same steps on the whole field at once."""
    width, height, steps = 40, 30, 45
    u = np.cos(np.arange(width) / 9)[None, :] + np.zeros((height, 1))
    v = np.sin(np.arange(height) / 5)[:, None] + np.zeros((1, width))
    field = np.stack([u, v], axis=2)
    cells = spark.createDataFrame([(x, y, float(u[y, x]), float(v[y, x])) for x in range(width) for y in range(height)], "x int, y int, u double, v double")
    seeds = [(k, (k * 7 % 37) + 0.5, (k * 5 % 27) + 0.25) for k in range(25)]
    want = {}
    for sign in (1, -1):
        for k, px, py in seeds:
            p, last = np.array([px, py]), sign * flow._sample(field, np.array([px]), np.array([py]))
            for i in range(steps + 1):
                want[k, sign * i] = tuple(p)
                d = flow._turned(flow._sample(field, p[:1], p[1:]), last)
                last = flow._turned(flow._sample(field, p[:1] + d[0, 0] * 0.3, p[1:] + d[0, 1] * 0.3), d)
                p = p + last[0] * 0.6
                if not (0 <= p[0] <= width - 1 and 0 <= p[1] <= height - 1) or i == steps:
                    break
    got = flow.streamlines(spark.createDataFrame(seeds, "k long, px double, py double"), "k", cells, ("u", "v"), (width, height), 0.6, steps, tile=6).collect()
    assert {(r["k"], r["i"]) for r in got} == want.keys()
    assert all((r["x"], r["y"]) == pytest.approx(want[r["k"], r["i"]], abs=1e-9) for r in got)


def test_darts_with_radii_of_their_own(spark):
    rng = random.Random(6)
    points = [(i, rng.random() * 40, rng.random() * 40, rng.random() * 6) for i in range(250)]
    stay = []
    for k, x, y, r in points:
        if all((x - a) ** 2 + (y - b) ** 2 >= r * r for _, a, b in stay):
            stay.append((k, x, y))
    got = flow.darts(spark.createDataFrame([(*p, p[0]) for p in points], "k int, px double, py double, r0 double, priority int"), "k", "priority", 6.0, F.col("r0"))
    assert {r["k"] for r in got.collect()} == {k for k, _, _ in stay}


def test_hashes_and_draws(spark):
    def mulberry(seed):
        while True:
            seed = (seed + 0x6D2B79F5) & 0xFFFFFFFF
            t = (seed ^ seed >> 15) * (1 | seed) & 0xFFFFFFFF
            t = (t + ((t ^ t >> 7) * (61 | t) & 0xFFFFFFFF) & 0xFFFFFFFF) ^ t
            yield (t ^ t >> 14) / 4294967296

    draws = mulberry(42)
    want = [next(draws) for _ in range(50)]
    got = spark.range(1, 51).select(scalars.mulberry(scalars.mulberry_state(F.lit(42).cast("long"), F.col("id"))).alias("d")).collect()
    assert [r["d"] for r in got] == want
    text = "scene S2 ünï"
    row = spark.range(1).select(F.crc32(F.lit(text).cast("binary")).alias("c"), F.base64(F.lit(text).cast("binary")).alias("b")).first()
    assert row["c"] == zlib.crc32(text.encode())
    shade = spark.range(0, 400).select((F.col("id") / 10).alias("d")).select("d", scalars.depth_of_shade(scalars.depth_shade(F.col("d"))).alias("back"))
    assert all(abs(r["d"] - r["back"]) < 1e-6 for r in shade.collect())


def test_pages_are_followed_once(spark):
    page = lambda k, n: (f"p{k}", f'{{"features":[{{"id":"s{k}","properties":{{"datetime":"2024-01-0{k + 1}","cloud":{k},"nodata":0}}}}],"next":{n}}}')
    pages = spark.createDataFrame([page(0, '"p1"'), page(1, '"p2"'), page(2, '"p0"'), page(3, "null")], "name string, body string")
    ids = lambda **how: sorted(r["id"] for r in rasters.follow_pages(pages, "p0", **how).collect())
    assert ids() == ["s0", "s1", "s2"] and ids(most=2) == ["s0", "s1"]


def test_fetching_again(spark):
    waits, answers = [], [OSError(), b"", b"xx", b"enough"]

    def read():
        got = answers.pop(0)
        if isinstance(got, OSError):
            raise got
        return got

    assert rasters.fetched(read, 4, wait=waits.append) == b"enough" and waits == [2.0, 8.0, 18.0]
    assert rasters.fetched(lambda: b"", 1, 3, wait=waits.append) is None


def _tiff(values, west, north, size, nodata):
    body, text = values.astype("<f4").tobytes(), f"{nodata}\0".encode()
    tags = [(256, 3, 1, values.shape[1]), (257, 3, 1, values.shape[0]), (258, 3, 1, 32), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (279, 4, 1, len(body)), (339, 3, 1, 3)]
    extra = [(33550, 12, struct.pack("<3d", size, size, 0)), (33922, 12, struct.pack("<6d", 0, 0, 0, west, north, 0)), (42113, 2, text)]
    at, tail, rows = 8 + len(body), b"", []
    for tag, kind, data in extra:
        n = len(data) // 8 if kind == 12 else len(data)
        where = at + len(tail)
        rows.append(struct.pack("<HHI", tag, kind, n) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", where)))
        tail += data if len(data) > 4 else b""
    rows = [struct.pack("<HHI", t, k, n) + struct.pack("<I", v) for t, k, n, v in tags] + rows
    return b"II" + struct.pack("<HI", 42, at + len(tail)) + body + tail + struct.pack("<H", len(rows)) + b"".join(rows) + struct.pack("<I", 0)


def test_sheets_are_read_with_their_places(spark, tmp_path):
    values = np.arange(12, dtype=float).reshape(3, 4)
    values[1, 2] = -99
    for k in range(2):
        (tmp_path / f"sheet{k}.tif").write_bytes(_tiff(values + k, 176.0 + k, -37.0, 0.25, -99 + k))
    got = rasters.read_tiffs(spark, f"{tmp_path}/*.tif").collect()
    assert len(got) == 22
    for r in got:
        k = int(r["path"].endswith("1.tif"))
        assert r["value"] == values[r["y"], r["x"]] + k and (r["lon"], r["lat"]) == (176.0 + k + (r["x"] + 0.5) * 0.25, -37.0 - (r["y"] + 0.5) * 0.25)
    with pytest.raises(ValueError, match="TIFF"):
        rasters.decode_tiff(b"II*" * 9)


def test_grids_of_the_wrong_size_are_refused(spark, tmp_path):
    values = np.arange(20, dtype="<f4").reshape(4, 5)
    (tmp_path / "a.f32").write_bytes(values.tobytes())
    assert {(r["x"], r["y"]): r["value"] for r in rasters.read_grids(spark, f"{tmp_path}/*.f32", 5, 4).collect()} == {(x, y): values[y, x] for x in range(5) for y in range(4)}
    with pytest.raises(Exception, match="no grid of 5 by 5"):
        rasters.read_grids(spark, f"{tmp_path}/*.f32", 5, 5).collect()


def test_mirrors_and_pages_of_features(spark, tmp_path):
    assert rasters.from_mirrors([lambda: b"", lambda: b"ok"], 1, wait=lambda _: None) == b"ok" and rasters.from_mirrors([lambda: b""], 1, wait=lambda _: None) is None
    for k in range(2):
        (tmp_path / f"{k}.json").write_text('{"features":[' + ",".join(f'{{"id":"f{i}","geometry":{{"type":"Point","coordinates":[{i}.5,{-i}]}}}}' for i in range(k * 3, k * 3 + 4)) + "]}")
    assert sorted(map(tuple, rasters.read_feature_pages(spark, f"{tmp_path}/*.json").collect())) == [(f"f{i}", i + 0.5, float(-i)) for i in range(7)]


def test_images_of_bytes_with_filtered_rows():
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (6, 9, 3), dtype=np.uint8)
    plain = planes.encode_png8(image)
    assert all((planes.decode_png8(plain, c) == image[:, :, c]).all() for c in range(3))
    wide, rows = image.astype(int), []
    for y in range(6):
        kind, line = y % 5, []
        for x in range(9):
            left, up = wide[y, x - 1] if x else np.zeros(3, int), wide[y - 1, x] if y else np.zeros(3, int)
            corner = wide[y - 1, x - 1] if x and y else np.zeros(3, int)
            far = [np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)]
            paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
            line.append((wide[y, x] - [0, left, up, (left + up) // 2, paeth][kind]) % 256)
        rows.append(bytes([kind]) + np.array(line, np.uint8).tobytes())
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    filtered = plain[:33] + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert all((planes.decode_png8(filtered, c) == image[:, :, c]).all() for c in range(3))


def test_images_keep_all_codes():
    codes = np.array([[0, 1, 65535], [256, 255, 4097]], np.uint16)
    assert (planes.decode_png16(planes.encode_png16(codes)) == codes).all()


def test_windows_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", 1, 2.0), ("2024-01-01 00:50:00", 1, 3.0), ("2024-01-01 01:05:00", 2, 5.0)], "at string, pixel int, value double").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = accumulate.windowed_totals(stream, "at").writeStream.outputMode("update").format("memory").queryName("totals").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["window"]["start"].hour, r["pixel"], r["n"], r["total"]) for r in spark.table("totals").collect()) == [(0, 1, 2, 5.0), (1, 2, 1, 5.0)]


def test_species_of_the_model_are_its_terms(spark):
    n = tide.node_angle(F.lit(9000.0))
    row = spark.range(1).select(*[c.alias(f"{name}{k}") for name in ("M6", "MK3", "MSF", "S2") for k, c in zip("fu", tide.species(name, n), strict=True)], tide.nodal_factor("M2", n).alias("m"), tide.nodal_phase("M2", n).alias("p"), tide.nodal_factor("K1", n).alias("k")).first()
    assert row["M6f"] == pytest.approx(row["m"] ** 3) and row["M6u"] == pytest.approx(3 * row["p"]) and row["MK3f"] == pytest.approx(row["m"] * row["k"]) and row["MSFu"] == pytest.approx(-row["p"]) and row["S2f"] == 1
