"""Core operators: every query with SQL against DuckDB, and properties that SQL can't check."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalgrid.functions import scalars, tide
from shoalgrid.operators import flow, focal, grid, harmonic, series, stepfit
from shoalgrid.plans import catalogue, waterline
from shoalgrid.sources import planes, tables
from shoalgrid.streaming import accumulate

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v


def rows(columns, data):
    return sorted((tuple(plain(r[c]) for c in columns) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql(spark, duck, name):
    want = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(want.columns)
    got = catalogue.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    a, b = rows(columns, [r.asDict() for r in got.collect()]), rows(columns, [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()])
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=1e-4) if all(isinstance(v, (int, float)) for v in x) else x == y


@pytest.mark.parametrize("name", sorted(catalogue.queries().keys() - catalogue.oracle_sql().keys()))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_fast_leave_one_out_is_the_naive_one(spark):
    rng, n = random.Random(7), 13
    stack = [(pixel, p, v, int(v and (rng.random() < 0.15) != (p >= cut))) for pixel in range(60) for cut in [rng.randrange(n + 1)] for p in range(n) for v in [int(rng.random() < 0.9)]]
    got = {(r["pixel"], r["p"]): r["k"] for r in stepfit.leave_one_out(spark.createDataFrame(stack, "pixel int, p int, v int, w int"), n).collect()}
    for pixel in range(60):
        obs = [o for o in stack if o[0] == pixel]
        for left in range(n):
            errors = [sum(v and (w != (p >= k)) for _, p, v, w in obs if p != left) for k in range(n + 1)]
            best = [k for k, e in enumerate(errors) if e == min(errors)]
            assert got[pixel, left] == (best[0] + best[-1]) // 2


def test_distance_through_a_corridor(spark):
    """A U-shaped channel over several tiles, against relaxation to a fixed point."""
    free = {(x, y) for x in range(20) for y in range(20) if x in (2, 3, 15) or y == 17 or (x == 10 and y == 3)}
    want = {c: 0.0 if c == (2, 0) else float("inf") for c in free}
    for _ in range(100):
        for (x, y), _ in list(want.items()):
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    if (x + i, y + j) in want:
                        want[x, y] = min(want[x, y], want[x + i, y + j] + (i * i + j * j) ** 0.5)
    got = grid.distance(spark.createDataFrame(sorted(free), "x int, y int"), (F.col("x") == 2) & (F.col("y") == 0), tile=6)
    assert {(r["x"], r["y"]): pytest.approx(r["dist"]) for r in got.collect()} == want
    assert want[10, 3] == float("inf")


def test_components_of_awkward_shapes(spark):
    picture = ["#..#.###", ".##..#.#", "....####", "#.......", ".#.#.#.#", "..#....."]
    cells = [(x, y) for y, line in enumerate(picture) for x, c in enumerate(line) if c == "#"]
    for diagonal in (True, False):
        label = {c: c for c in cells}
        for _ in cells:
            for x, y in cells:
                for i in (-1, 0, 1):
                    for j in (-1, 0, 1):
                        if (x + i, y + j) in label and (diagonal or not i or not j):
                            label[x, y] = min(label[x, y], label[x + i, y + j], key=lambda c: (c[1], c[0]))
        got = {(r["x"], r["y"]): (r["comp"]["x"], r["comp"]["y"]) for r in grid.components(spark.createDataFrame(cells, "x int, y int"), diagonal).collect()}
        assert got == label


def test_tile_kernel_sees_the_halo(spark):
    values = [(x, y, float((x * 7 + y * 13) % 11)) for x in range(10) for y in range(9)]
    shifted = grid.tile_kernel(spark.createDataFrame(values, "x int, y int, v double"), lambda a: np.roll(a, 1, axis=1), "v", 4, 1)
    want = {(x, y): v for x, y, v in values}
    assert all(r["v"] == want[r["x"] - 1, r["y"]] for r in shifted.filter("x > 0").collect())


def test_spline_is_the_interpolating_one():
    n, p = 12, 31
    values = np.cos(np.arange(n)) + np.arange(n) / 5
    system = np.eye(n) * 4 / 6 + (np.eye(n, k=1) + np.eye(n, k=-1)) / 6
    system[0, 1] = system[-1, -2] = 2 / 6  # mirrored
    c = np.linalg.solve(system, values)
    weights = np.zeros((p, n))
    for o, s, w in focal.spline_taps(n, p):
        weights[o, s] = w
    for o in range(p):
        t, want = (o + 0.5) * n / p - 0.5, 0.0
        for k in range(int(np.floor(t)) - 1, int(np.floor(t)) + 3):
            u, at = abs(t - k), abs(k) if k < n else 2 * n - 2 - k
            want += c[at] * ((4 - 6 * u * u + 3 * u**3) / 6 if u < 1 else max(0.0, 2 - u) ** 3 / 6)
        assert abs(weights[o] @ values - want) < 1e-8


def test_darts_are_the_greedy_choice(spark):
    rng = random.Random(4)
    points = [(i, rng.random() * 50, rng.random() * 50, rng.randrange(40)) for i in range(300)]
    stay = []
    for k, x, y, _ in sorted(points, key=lambda p: (p[3], p[0])):
        if all((x - a) ** 2 + (y - b) ** 2 >= 25 for _, a, b in stay):
            stay.append((k, x, y))
    got = flow.darts(spark.createDataFrame(points, "k int, px double, py double, priority int"), "k", "priority", 5.0)
    assert {r["k"] for r in got.collect()} == {k for k, _, _ in stay}


def test_streamlines_follow_a_line_field(spark):
    cells = spark.createDataFrame([(x, y, 1.0 if y % 2 else -1.0, 0.0) for x in range(20) for y in range(20)], "x int, y int, u double, v double")  # opposite directions are one line
    seed = spark.createDataFrame([(1, 10.0, 5.0)], "k int, px double, py double")
    for tile in (4, 256):
        got = flow.streamlines(seed, "k", cells, ("u", "v"), (20, 20), 1.0, 4, tile).collect()
        assert sorted((r["i"], r["x"], r["y"]) for r in got) == [(i, 10.0 + i, 5.0) for i in range(-4, 5)]


def test_turning_points_have_no_slope(spark):
    got = harmonic.turning_points(spark.createDataFrame([(1, 9000.0)], "k long, h double"), "k", "h", 26.0).collect()
    kinds = [r["kind"] for r in got]
    assert len(kinds) in (4, 5) and all(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    assert max(abs(harmonic.slope_at([r["at"] for r in got]))) < 1e-9
    check = spark.range(50).select((F.col("id") * 31.7).alias("h")).select("h", tide.slope(F.col("h")).alias("s")).toPandas()
    assert np.allclose(harmonic.slope_at(check.h.to_numpy()), check.s, atol=1e-9)


def test_fit_finds_what_was_put_in(spark):
    speeds = {"A": 0.5, "B": 0.26, "C": 1.01}
    t = F.col("id") * 0.7
    rows = spark.range(2000).select(t.alias("t"), (F.lit(2.0) + 0.8 * F.cos(0.5 * t - 1.0) + 0.3 * F.cos(0.26 * t + 0.5) + 0.001 * F.cos(1.01 * t)).alias("h"))
    mean, found = harmonic.fit_pruned(rows, speeds)
    assert mean == pytest.approx(2.0, abs=1e-3) and set(found) == {"A", "B"}
    assert found["A"] == pytest.approx((0.8, 1.0), abs=1e-3) and found["B"] == pytest.approx((0.3, -0.5), abs=2e-3)


def test_asof_ends(spark):
    knots = spark.createDataFrame([(1, 0.0, 2.0), (1, 10.0, 4.0), (1, 20.0, 1.0)], "k int, t double, h double")
    points = spark.createDataFrame([(1, t) for t in (-1.0, 0.0, 5.0, 10.0, 20.0, 21.0)] + [(2, 3.0)], "k int, t double")
    got = {(r["k"], r["t"]): r["h"] for r in series.asof_interpolate(points, knots, ["k"]).collect()}
    assert got == {(1, -1.0): None, (1, 0.0): 2.0, (1, 5.0): pytest.approx(3.0), (1, 10.0): 4.0, (1, 20.0): 1.0, (1, 21.0): None, (2, 3.0): None}


def test_rounding_and_codes(spark):
    got = spark.range(1).select(*[scalars.half_up(F.lit(x)).alias(f"r{k}") for k, x in enumerate((-0.5, 0.5, 1.5, 2.5))], scalars.encode_height(F.lit(-1.0)).alias("lo"), scalars.encode_height(F.lit(9.0)).alias("hi")).first()
    assert tuple(got) == (0, 1, 2, 3, 1, 65534)


def test_images_and_planes(spark, tmp_path):
    values = np.random.default_rng(0).integers(0, 65536, (7, 11)).astype(np.uint16)
    data = planes.encode_png16(values)
    assert (planes.decode_png16(data) == values).all()
    with pytest.raises(ValueError, match="checksum"):
        planes.decode_png16(data[:30] + b"\x01" + data[31:])
    (tmp_path / "a.png").write_bytes(data)
    assert {(r["x"], r["y"], r["code"]) for r in planes.read_png16(spark, str(tmp_path)).collect()} == {(x, y, int(values[y, x])) for x in range(11) for y in range(7)}


def test_text_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿head\n,,\nx,y,z\n1,We,1,2025,02:40,0.3,09:10,1.8,15:10,0.5,21:17,1.8\n5,Su,1,2025,05:42,0.3,12:11,2.0,18:19,0.3,,\n")
    got = [(str(r["time"]), r["height"]) for r in tables.read_tide_table(spark, str(tmp_path / "t.csv")).orderBy("time").collect()]
    assert len(got) == 7 and got[0] == ("2025-01-01 02:40:00", 0.3) and got[-1] == ("2025-01-05 18:19:00", 0.3)
    way = '{"type":"way","id":%d,"tags":{"n":"%s"},"geometry":[{"lat":1,"lon":2},%s]}'
    (tmp_path / "a.json").write_text('{"elements":[%s,%s]}' % (way % (1, "first", '{"lat":3,"lon":4}'), way % (2, "hole", "null")))
    (tmp_path / "b.json").write_text('{"elements":[%s]}' % (way % (1, "second", '{"lat":3,"lon":4}')))
    assert [(r["id"], r["tags"]) for r in tables.read_ways(spark, str(tmp_path / "*.json")).collect()] == [(1, {"n": "first"})]
    feature = '{"properties":%s,"geometry":{"type":"%s","coordinates":%s}}'
    (tmp_path / "f").mkdir()
    (tmp_path / "f/f.json").write_text('{"features":[%s,%s,%s]}' % (feature % ('{"valdco":2}', "MultiLineString", "[[[0,0],[1,1]],[[5,5],[6,6]]]"), feature % ('{"depth":7}', "Point", "[3,4]"), feature % ("{}", "Point", "[9,9]")))
    got = sorted((r["feature"], r["part"], r["i"], r["x"], r["depth"]) for r in tables.read_features(spark, str(tmp_path / "f")).collect())
    assert got == [(0, 0, 0, 0.0, 2.0), (0, 0, 1, 1.0, 2.0), (0, 1, 0, 5.0, 2.0), (0, 1, 1, 6.0, 2.0), (1, 0, 0, 3.0, 7.0)]


def test_stream_totals_are_the_table_s(spark, tmp_path):
    source = waterline.stack(spark, SF).select(F.col("pixel"), F.col("w").cast("double").alias("value"))
    source.write.parquet(str(tmp_path / "in"))
    stream = accumulate.pixel_totals(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, accumulate.pixel_totals(source).collect()))
    finally:
        query.stop()
