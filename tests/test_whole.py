"""Queries that take the whole table, against brute force in Python on small tables."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from shoalgrid.operators import focal, harmonic
from shoalgrid.plans import catalogue, waterline
from shoalgrid.plans.series import _orders

SF = "/root/testdata/sf0.001"
LARGE = "/root/testdata/sf0.1"


def run(spark, name, d=SF):
    return catalogue.queries()[name](spark, d).collect()


def _grid_by_hand():
    """{(tau0, slope, scene): iou} by naive refits of every pixel."""
    n, part = waterline.N, pq.read_table(f"{SF}/part.parquet", columns=["p_partkey", "p_size"]).to_pylist()
    tide, done, counts = [p * 2300 // 29 for p in range(n)], {}, {}
    for r in part:
        pixel = r["p_partkey"]
        v = np.array([int((pixel * 7 + p * 13) % 37 != 0) for p in range(n)])
        w = np.array([v[p] * int(r["p_size"] * 60 - 400 + ((pixel * 31 + p * 17) % 11 - 5) * 40 <= tide[p]) for p in range(n)])
        for tau0 in (20, 30, 40, 50, 60, 70, 80):
            for slope in (0, 1, 2, 3, 4, 5, 6):
                b = int((tau0 + slope * (pixel % 13)) / 5 + 0.5)
                if (pixel, b) not in done:
                    order = sorted(range(n), key=lambda p: (tide[p] * 10 - b * (p % 3) * 40, p))
                    vo, wo, at = v[order], w[order], np.arange(n)
                    wrong = np.array([vo * (wo != (at >= k)) for k in range(n + 1)])
                    said = {}
                    for left, scene in enumerate(order):
                        errors = wrong.sum(axis=1) - wrong[:, left]
                        best = np.flatnonzero(errors == errors.min())
                        said[scene] = left >= (best[0] + best[-1]) // 2
                    done[pixel, b] = said
                for scene, wet in done[pixel, b].items():
                    if v[scene]:
                        c = counts.setdefault((tau0, slope, scene), [0, 0])
                        c[0] += bool(wet and w[scene])
                        c[1] += bool(wet or w[scene])
    return {k: a / b if b else 1.0 for k, (a, b) in counts.items()}


def test_lag_grid_takes_every_pixel_and_pair(spark):
    iou = _grid_by_hand()
    mean = lambda t, s, half: np.mean([x for (a, b, p), x in iou.items() if (a, b) == (t, s) and half in (None, p % 2)])
    got = {(r["tau0"], r["slope"]): r["iou"] for r in run(spark, "lag_grid_search")}
    assert len(got) == 49 and all(x == pytest.approx(mean(*k, None), abs=2e-6) for k, x in got.items())
    for r in run(spark, "nested_split_half"):
        scores = {k: round(mean(*k, 1 - r["half"]), 6) for k in got}
        best = min(scores, key=lambda k: (-scores[k], k))
        assert (r["tau0"], r["slope"]) == best and r["held_out"] == pytest.approx(mean(*best, r["half"]), abs=2e-6)


def test_turning_points_of_every_order(spark):
    orders = {r["o_orderkey"]: r["h"] for r in _orders(spark, SF).collect()}
    got = {}
    for r in run(spark, "turning_points_refined"):
        got.setdefault(r["o_orderkey"], []).append((r["at"], r["kind"]))
    assert set(got) == set(orders)
    assert max(abs(harmonic.slope_at([at for points in got.values() for at, _ in points]))) < 1e-9
    for key, h in orders.items():
        s = harmonic.slope_at(h + np.arange(0, 26 + 1 / 60, 1 / 30))
        want = ["high" if a > 0 else "low" for a, b in zip(s[:-1], s[1:], strict=True) if (a > 0 >= b) or (a < 0 <= b)]
        assert [kind for _, kind in sorted(got[key])] == want


def test_streamlines_from_every_supplier_over_the_whole_raster(spark):
    got = run(spark, "streamlines", LARGE)
    keys = pq.read_table(f"{LARGE}/supplier.parquet", columns=["s_suppkey"])["s_suppkey"].to_pylist()
    height = max(pq.read_table(f"{LARGE}/part.parquet", columns=["p_partkey"])["p_partkey"].to_pylist()) // 50 + 1
    assert {(r["s_suppkey"], r["x"], r["y"]) for r in got if r["i"] == 0} == {(k, k * 7 % 49, k * 3 % (height - 1)) for k in keys}
    moved = {int(r["y"]) // 50 for r in got if abs(r["i"]) > 1}
    assert moved >= set(range(height // 50))


def _raster_by_hand(d):
    """{(x, y): value}, rows and supplier keys."""
    part = pq.read_table(f"{d}/part.parquet", columns=["p_partkey", "p_size"]).to_pylist()
    cells = {(r["p_partkey"] % 50, r["p_partkey"] // 50): float(r["p_size"]) for r in part}
    return cells, max(y for _, y in cells) + 1, pq.read_table(f"{d}/supplier.parquet", columns=["s_suppkey"])["s_suppkey"].to_pylist()


def test_resampling_takes_the_whole_raster(spark):
    cells, height, keys = _raster_by_hand(LARGE)
    down = height * 17 // 40
    want = {(x, y): cells[at] for x in range(33) for y in range(down) if (at := (x * 50 // 33, y * height // down)) in cells}
    assert {(r["x"], r["y"]): r["v"] for r in run(spark, "nearest_resize", LARGE)} == want

    got = {r["s_suppkey"]: r["v"] for r in run(spark, "bilinear", LARGE)}
    assert set(got) == set(keys)
    for k in keys:
        px, py = k * 0.49 % 49, k * 7 % (height - 1) + 0.25
        x, y = int(px), int(py)
        sum_ = sum(cells.get((min(x + i, 49), min(y + j, height - 1)), 0.0) * (px - x if i else 1 - px + x) * (py - y if j else 1 - py + y) for i in (0, 1) for j in (0, 1))
        assert got[k] == pytest.approx(sum_, abs=2e-6)

    a = np.zeros((height, 50))
    for (x, y), v in cells.items():
        a[y, x] = v
    dense = lambda taps, n, p: np.array([sum(w * (np.arange(n) == s) for _, s, w in taps[i * 4 : i * 4 + 4]) for i in range(p)])
    p = height * 8 // 5
    want = dense(focal.taps(height, p), height, p) @ a @ dense(focal.taps(50, 80), 50, 80).T
    got = run(spark, "mitchell", LARGE)
    assert len(got) == 80 * p and all(abs(want[r["y"], r["x"]] - r["v"]) < 2e-6 for r in got)


def test_transects_take_the_whole_raster(spark):
    cells, height, keys = _raster_by_hand(LARGE)
    want = {}
    for s in keys:
        x0, y0, x1, y1 = s % 50, s * 7 % (height + 1), s * 3 % 53, s * 11 % (height - 3)
        for k in range(17):
            at = tuple(int(min(max(np.floor(a + (b - a) * (k / 16)), 0), m - 1)) for a, b, m in ((x0, x1, 50), (y0, y1, height)))
            if at in cells:
                want[s, k] = cells[at]
    assert {(r["s_suppkey"], r["k"]): r["v"] for r in run(spark, "transect", LARGE)} == want


def test_splines_take_the_whole_raster(spark):
    """Against the same smoothing and taps applied to an array; the last row, of one cell, mixes into the rows near it and is left out with them."""
    cells, height, _ = _raster_by_hand(LARGE)
    p, inner = height * 33 // 20, height - 30
    a = np.full((height, 50), np.nan)
    for (x, y), v in cells.items():
        a[y, x] = v
    weights = focal.gaussian(0.75)
    r = len(weights) // 2
    for axis in (1, 0):
        n = a.shape[axis]
        a = sum(w * np.take(a, np.clip(np.arange(n) + k - r, 0, n - 1), axis) for k, w in enumerate(weights))

    def matrix(n, m):
        out = np.zeros((m, n))
        for o, s, w in focal.spline_taps(n, m):
            out[o, s] += w
        return out

    want = matrix(height, p) @ np.nan_to_num(a) @ matrix(50, 80).T
    got = {(q["x"], q["y"]): q["v"] for q in run(spark, "spline_resample", LARGE)}
    assert len(got) == 80 * p
    rows = [y for y in range(p) if 30 < (y + 0.5) * height / p < inner]
    assert all(abs(got[x, y] - want[y, x]) < 2e-6 for y in rows for x in range(80))


def test_all_lines_are_rasterised(spark):
    _, _, keys = _raster_by_hand(LARGE)
    want = {}
    px, py = np.meshgrid(np.arange(-2, 80), np.arange(-2, 80))
    for line in keys:
        v = [(line * 3 % 47 + i * 5, line * 11 % 31 + i * i * 3) for i in range(4)]
        for (x1, y1), (x2, y2) in zip(v[:-1], v[1:], strict=True):
            dx, dy = x2 - x1, y2 - y1
            t = np.clip(((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy), 0, 1)
            for x, y in np.argwhere((np.hypot(px - x1 - t * dx, py - y1 - t * dy) <= 0.75).T) - 2:
                want[x, y] = max(want.get((x, y), 0.0), float(line % 9))
    assert {(r["x"], r["y"]): r["weight"] for r in run(spark, "line_raster", LARGE)} == want
