"""Grid topology on rasters in long form (x, y and values): morphology, components, distances.

A raster's cells are rows, one for each (x, y). Neighbours along an axis come from range windows partitioned by the other axis, so a raster is never in
one task as a whole. What reaches further than a cell works on tiles: morphology on tiles with the cells around them, one exchange for any radius; components label each tile by itself
and join labels across tile edges only; distances solve each tile and hand its edge to its neighbours until no edge changes.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.lineage import cut, drop
from shoalgrid.operators import stars
from shoalgrid.shipping import ship

TILE = 256


def along(axis: str, reach: int):
    """The cells within reach of a cell along an axis, by coordinate (gaps are gaps)."""
    return Window.partitionBy("y" if axis == "x" else "x").orderBy(axis).rangeBetween(-reach, reach)


def _diamond(grow: bool, radius: int) -> Callable[[np.ndarray], np.ndarray]:
    """A kernel of radius passes over the four neighbours; cells that are missing are background."""

    def kernel(dense: np.ndarray) -> np.ndarray:
        m = np.nan_to_num(dense) > 0
        join = np.logical_or if grow else np.logical_and
        for _ in range(radius):
            wide = np.pad(m, 1)
            m = join.reduce([wide[1:-1, 1:-1], wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]])
        return m.astype(float)

    return kernel


def dilate(cells: DataFrame, mask: str, radius: int, tile: int = TILE) -> DataFrame:
    """x, y and the mask (0 or 1) grown by radius passes over the four neighbours."""
    return tile_kernel(cells, _diamond(True, radius), mask, max(tile, radius), radius).withColumn(mask, F.col(mask).cast("int"))


def erode(cells: DataFrame, mask: str, radius: int, tile: int = TILE) -> DataFrame:
    """x, y and the mask shrunk by radius passes; what lies beyond the raster is background."""
    return tile_kernel(cells, _diamond(False, radius), mask, max(tile, radius), radius).withColumn(mask, F.col(mask).cast("int"))


def boundary(cells: DataFrame, mask: str) -> Column:
    """Whether one of the four neighbours has another value."""
    spread = [F.max(mask).over(along(a, 1)) - F.min(mask).over(along(a, 1)) for a in ("x", "y")]
    return F.greatest(*spread) > 0


def touches(cells: DataFrame, flag: str) -> DataFrame:
    """cells with _near: whether one of the eight neighbours or the cell itself has the flag (0 or 1)."""
    return cells.withColumn("_row", F.max(flag).over(along("x", 1))).withColumn("_near", F.max("_row").over(along("y", 1))).drop("_row")


def disc_dilate(cells: DataFrame, mask: str, radius: int) -> DataFrame:
    """x and y of all cells within a disc around the mask. Only the mask's edge is stamped; the stamp has a fixed number of cells."""
    disc = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    own = cells.filter(F.col(mask) == 1).select("x", "y")
    edge = cells.withColumn("_edge", boundary(cells, mask)).filter(F.col("_edge") & (F.col(mask) == 1))
    stamped = edge.select(F.explode(F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i, j in disc])).alias("c")).select("c.*")
    return own.unionByName(stamped).distinct().join(cells.select("x", "y"), ["x", "y"], "left_semi")


def _labels(x: np.ndarray, y: np.ndarray, diagonal: bool) -> np.ndarray:
    """For each cell the number of its component's first cell in raster order. Runs of a row are joined with those of the row above that they touch."""
    order = np.lexsort((x, y))
    xs, ys = x[order], y[order]
    new = np.concatenate(([True], (ys[1:] != ys[:-1]) | (xs[1:] != xs[:-1] + 1)))
    first = np.flatnonzero(new)
    row, lo, hi = ys[first].tolist(), xs[first].tolist(), xs[np.append(first[1:], len(xs)) - 1].tolist()
    parent = list(range(len(first)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    reach, k = int(diagonal), 0
    for i in range(len(first)):
        while k < i and (row[k] < row[i] - 1 or (row[k] == row[i] - 1 and hi[k] < lo[i] - reach)):
            k += 1
        j = k
        while j < i and row[j] == row[i] - 1 and lo[j] <= hi[i] + reach:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
            j += 1
    found = first[[root(i) for i in range(len(first))]]
    out = np.empty(len(x), np.int64)
    out[order] = order[np.repeat(found, np.diff(np.append(first, len(xs))))]
    return out


def components(cells: DataFrame, diagonal: bool = True, tile: int = TILE) -> DataFrame:
    """x, y and comp (struct of y and x of the component's first cell in raster order) of every cell given."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        at = _labels(pdf.x.to_numpy(), pdf.y.to_numpy(), diagonal)
        return pd.DataFrame({"x": pdf.x, "y": pdf.y, "ry": pdf.y.to_numpy()[at], "rx": pdf.x.to_numpy()[at]})

    ship(cells.sparkSession)
    own = lambda c: F.floor(F.col(c) / tile).cast("int")
    rows = cells.select(F.col("x").cast("int"), F.col("y").cast("int"), own("x").alias("tx"), own("y").alias("ty"))
    local = cut(rows.groupBy("tx", "ty").applyInPandas(label, "x int, y int, ry int, rx int"), "labels")
    # Components meet where neighbouring cells lie in different tiles: only cells on the edge of a tile look for neighbours, right and below.
    edge = local.filter((F.pmod("x", F.lit(tile)).isin(0, tile - 1)) | F.pmod("y", F.lit(tile)).isin(0, tile - 1)).select("x", "y", F.struct("ry", "rx").alias("a"))
    steps = [(1, 0), (0, 1), *([(1, 1), (-1, 1)] if diagonal else [])]
    there = edge.select(F.explode(F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i, j in steps])).alias("c"), F.col("a").alias("b")).select("c.*", "b")
    roots = stars.components(edge.join(there, ["x", "y"]).filter("a <> b").select("a", "b"))
    named = local.select("x", "y", F.struct("ry", "rx").alias("node")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return named.select("x", "y", F.struct(F.col("root.ry").alias("y"), F.col("root.rx").alias("x")).alias("comp"))


def component_stats(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("comp").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("west"), F.max("x").alias("east"), F.min("y").alias("north"), F.max("y").alias("south")
    )


def despeckle(cells: DataFrame, least: int, diagonal: bool = True) -> DataFrame:
    """Cells of components of at least so many cells."""
    labelled = components(cells, diagonal)
    large = labelled.groupBy("comp").count().filter(F.col("count") >= least).select("comp")
    return labelled.join(large, "comp", "left_semi").select("x", "y")


def connected_to(cells: DataFrame, seeds: Column, diagonal: bool = True) -> DataFrame:
    """Cells of components that hold a seed cell (a condition on x and y)."""
    labelled = components(cells, diagonal)
    return labelled.join(labelled.filter(seeds).select("comp").distinct(), "comp", "left_semi").select("x", "y")


#: The ways out of a tile, as steps of tiles, and which of a tile's edge cells (rows, columns) go that way.
_WAYS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def _strip(way: int, tile: int) -> slice:
    return slice(tile - 1, tile) if way == 1 else slice(0, 1) if way == -1 else slice(0, tile)


def _spread(dist: np.ndarray, start: np.ndarray, steps: list[tuple[int, int, float]], limit: float) -> None:
    """Shortest ways in a tile with a rim of one cell, in place, from the cells marked in start. Cells that are no way are -inf: nothing gets below that."""
    width = dist.shape[1]
    flat = dist.ravel().tolist()
    moves = [(dy * width + dx, cost) for dx, dy, cost in steps]
    heap = [(flat[i], i) for i in np.flatnonzero(start.ravel()).tolist()]
    heapq.heapify(heap)
    while heap:
        d, i = heapq.heappop(heap)
        if d > flat[i]:
            continue
        for move, cost in moves:
            j, e = i + move, d + cost
            if e < flat[j] - 1e-12 and e <= limit:
                flat[j] = e
                heapq.heappush(heap, (e, j))
    dist[:] = np.array(flat).reshape(dist.shape)


def distance(cells: DataFrame, seeds: Column, across: float = 1.0, down: float = 1.0, diagonal: float | None = 2**0.5, tile: int = TILE, limit: float = float("inf")) -> DataFrame:
    """x, y and dist: the shortest way through the given cells from any seed (a condition), up to limit; infinite where there is none.

    Each tile is solved by itself, then hands its edge to its neighbours, which go on from what that improves; until no edge changes. Tiles that nothing reaches are not solved again. Memory is one tile."""
    steps = [(1, 0, across), (-1, 0, across), (0, 1, down), (0, -1, down)] + ([(i, j, diagonal) for i in (1, -1) for j in (1, -1)] if diagonal else [])
    side = tile + 2
    schema = "tx int, ty int, dist binary, changed boolean"

    def rows(found: list[tuple[int, int, np.ndarray, bool]]) -> pd.DataFrame:
        return pd.DataFrame([(x, y, d.tobytes(), c) for x, y, d, c in found], columns=["tx", "ty", "dist", "changed"])

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(pdf.tx.iloc[0]), int(pdf.ty.iloc[0])
        dist = np.full((side, side), -np.inf)
        at = pdf.y.to_numpy() - ty * tile + 1, pdf.x.to_numpy() - tx * tile + 1
        dist[at] = pdf.dist.to_numpy()
        _spread(dist, dist == 0, steps, limit)
        return rows([(tx, ty, dist[1:-1, 1:-1], bool(np.isfinite(dist[1:-1, 1:-1]).any()))])

    def offer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """To each neighbour the edge that lies next to it."""
        for pdf in batches:
            out = []
            for tx, ty, packed in zip(pdf.tx, pdf.ty, pdf.dist, strict=True):
                dist = np.frombuffer(packed, float).reshape(tile, tile)
                for i, j in _WAYS:
                    edge = dist[_strip(j, tile), _strip(i, tile)]
                    if np.isfinite(edge).any():
                        out.append((tx + i, ty + j, i, j, edge.tobytes()))
            yield pd.DataFrame(out, columns=["tx", "ty", "i", "j", "edge"])

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for tx, ty, packed, offers in zip(pdf.tx, pdf.ty, pdf.dist, pdf.offers, strict=True):
                dist = np.full((side, side), -np.inf)
                dist[1:-1, 1:-1] = np.frombuffer(packed, float).reshape(tile, tile)
                before, rim = dist.copy(), np.full((side, side), np.inf)
                for o in offers:
                    # The neighbour's edge lies in the rim, on the side that it came from.
                    edge = np.frombuffer(o["edge"], float)
                    ys, xs = ({1: slice(0, 1), -1: slice(side - 1, side), 0: slice(1, -1)}[w] for w in (o["j"], o["i"]))
                    rim[ys, xs] = np.where(np.isfinite(edge), edge, np.inf).reshape(rim[ys, xs].shape)
                for dx, dy, cost in steps:
                    come = rim[1 - dy : side - 1 - dy, 1 - dx : side - 1 - dx] + cost
                    own = dist[1:-1, 1:-1]
                    np.copyto(own, come, where=(come < own - 1e-12) & (come <= limit))
                _spread(dist, dist < before, steps, limit)
                moved = dist < before
                moved[2:-2, 2:-2] = False
                out.append((tx, ty, dist[1:-1, 1:-1], bool(moved.any())))
            yield rows(out)

    def cells_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tx, ty, packed in zip(pdf.tx, pdf.ty, pdf.dist, strict=True):
                dist = np.frombuffer(packed, float).reshape(tile, tile)
                y, x = np.nonzero(dist != -np.inf)
                yield pd.DataFrame({"x": x + tx * tile, "y": y + ty * tile, "dist": dist[y, x]})

    ship(cells.sparkSession)
    own = lambda c: F.floor(F.col(c) / tile).cast("int")
    given = cells.select(F.col("x").cast("int"), F.col("y").cast("int"), F.when(seeds, 0.0).otherwise(float("inf")).alias("dist"), own("x").alias("tx"), own("y").alias("ty"))
    state = cut(given.groupBy("tx", "ty").applyInPandas(start, schema), "distance")
    while state.filter("changed").limit(1).count():
        offers = state.filter("changed").select("tx", "ty", "dist").mapInPandas(offer, "tx int, ty int, i int, j int, edge binary")
        offers = offers.groupBy("tx", "ty").agg(F.collect_list(F.struct("i", "j", "edge")).alias("offers"))  # eight at most
        met = state.join(offers, ["tx", "ty"], "left")
        solved = met.filter("offers is not null").select("tx", "ty", "dist", "offers").mapInPandas(take, schema)
        before, state = state, cut(met.filter("offers is null").select("tx", "ty", "dist", F.lit(False).alias("changed")).unionByName(solved), "distance")
        drop(before)
    return state.select("tx", "ty", "dist").mapInPandas(cells_of, "x int, y int, dist double")


def grow(cells: DataFrame, seeds: Column, steps: int) -> DataFrame:
    """x, y of cells at most `steps` four-neighbour steps from a seed, through cells only; nothing beyond them is looked at."""
    return distance(cells, seeds, 1.0, 1.0, None, limit=float(steps)).filter(F.col("dist") <= steps).select("x", "y")


def separating_radius(water: DataFrame, sea: tuple[int, int], inland: tuple[int, int], radii: tuple[int, ...]) -> tuple[int, DataFrame] | None:
    """The first radius by which the water must shrink for the sea's cell and the inland one (or the remaining cell nearest to it: by growing squares, first in raster order) to be apart, and
    the components (x, y, comp) of the water shrunk so; None if no radius parts them. water: x, y."""
    cells = cut(water.select("x", "y", F.lit(1).alias("m")), "water")
    for radius in radii:
        left = cut(components(erode(cells, "m", radius).filter("m = 1")), "eroded")
        there = left.filter((F.col("x") == sea[0]) & (F.col("y") == sea[1])).first()
        away = F.greatest(F.abs(F.col("x") - inland[0]), F.abs(F.col("y") - inland[1]))
        near = left.agg(F.min_by("comp", F.struct(away, F.col("y"), F.col("x"))).alias("comp")).first()
        if there and near["comp"] is not None and there["comp"] != near["comp"]:
            drop(cells)
            return radius, left.withColumn("sea", F.col("comp") == F.struct(F.lit(there["comp"]["y"]).alias("y"), F.lit(there["comp"]["x"]).alias("x")))
        drop(left)
    drop(cells)
    return None


def enclosed_water(water: DataFrame, sea: tuple[int, int], inland: tuple[int, int], radii: tuple[int, ...], margin: int = 2) -> DataFrame:
    """x, y of the water that belongs to the inland cell once the open sea is taken away, with a margin of so many cells (land included, if water's frame holds it as m = 0).

    The sea is the component of its cell after the water has shrunk enough to part both, grown back within the water; of what is left the inland cell's component stays, or the largest (first in raster order on ties)
    if that cell went with the sea; no cells if no radius parts them. water: x, y, m."""
    wet = cut(water.filter("m = 1").select("x", "y"), "wet")
    found = separating_radius(wet, sea, inland, radii)
    if found is None:
        return wet.limit(0)
    radius, parts = found
    core = parts.filter("sea").select("x", "y", F.lit(1).alias("core"))
    back = dilate(water.select("x", "y").join(core, ["x", "y"], "left").select("x", "y", F.coalesce("core", F.lit(0)).alias("m")), "m", radius)
    rest = wet.join(back.filter("m = 1").select("x", "y"), ["x", "y"], "left_anti")
    labelled = cut(components(rest), "inland")
    sizes = labelled.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.max(((F.col("x") == inland[0]) & (F.col("y") == inland[1])).cast("int")).alias("own"))
    best = sizes.agg(F.min_by("comp", F.struct(-F.col("own"), -F.col("n"), F.col("comp"))).alias("comp"))
    kept = labelled.join(best, "comp", "left_semi").select("x", "y", F.lit(1).alias("kept"))
    return dilate(water.select("x", "y").join(kept, ["x", "y"], "left").select("x", "y", F.coalesce("kept", F.lit(0)).alias("m")), "m", margin).filter("m = 1").select("x", "y")


def tile_kernel(cells: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], value: str, tile: int, halo: int) -> DataFrame:
    """x, y and value after a numpy kernel on dense tiles with a halo; cells that are missing are NaN. For radii that windows make slow."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(pdf.tx.iloc[0]) * tile - halo, int(pdf.ty.iloc[0]) * tile - halo
        dense = np.full((tile + 2 * halo, tile + 2 * halo), np.nan)
        dense[pdf.y - y0, pdf.x - x0] = pdf[value]
        out = kernel(dense)
        mine = (pdf.x // tile == pdf.tx) & (pdf.y // tile == pdf.ty)
        return pd.DataFrame({"x": pdf.x[mine], "y": pdf.y[mine], value: out[pdf.y[mine] - y0, pdf.x[mine] - x0]})

    ship(cells.sparkSession)
    spread = [F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)) for c in ("x", "y")]
    rows = cells.select(F.col("x").cast("int"), F.col("y").cast("int"), F.col(value).cast("double"), spread[0].alias("a"), spread[1].alias("b"))
    rows = rows.select("x", "y", value, F.explode("a").alias("tx"), "b").select("x", "y", value, "tx", F.explode("b").alias("ty"))
    return rows.groupBy("tx", "ty").applyInPandas(run, f"x int, y int, {value} double")
