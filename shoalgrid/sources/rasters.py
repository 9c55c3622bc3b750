"""Raster files: tiles put together, packed grids and stacks, paged catalogues, candidates in order of preference, tiny uncompressed images. Schemas are given and sizes are checked."""

from __future__ import annotations

import struct
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.shipping import ship

SCENE_PAGE = "features array<struct<id:string,properties:struct<datetime:string,cloud:double,nodata:double>>>, next string"


def composite(tiles: DataFrame, size: int) -> DataFrame:
    """x, y and value of tiles (gx, gy, values: rows of size by size cells, alpha alike) laid side by side; cells whose alpha is 0 are null."""
    cells = tiles.select("gx", "gy", F.posexplode(F.arrays_zip("values", "alpha")).alias("i", "c"))
    return cells.select((F.col("gx") * size + F.col("i") % size).cast("int").alias("x"), (F.col("gy") * size + F.floor(F.col("i") / size)).cast("int").alias("y"), F.when(F.col("c.alpha") != 0, F.col("c.values")).alias("value"))


def pack_rows(cells: DataFrame, by: str, value: str, width: int, height: int, kind: str = "<f4") -> DataFrame:
    """by and data: the cells of each key as raw numbers of that kind, row after row; missing cells are 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((height, width), kind)
        out[pdf.y, pdf.x] = pdf[value]
        return pd.DataFrame({by: [pdf[by].iloc[0]], "data": [out.tobytes()]})

    ship(cells.sparkSession)
    return cells.select(by, "x", "y", value).groupBy(by).applyInPandas(run, f"{by} {dict(cells.dtypes)[by]}, data binary")


def unpack_rows(files: DataFrame, by: str, width: int, height: int, kind: str = "<f4") -> DataFrame:
    """by, x, y and value of raw grids; one of another size is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, data in zip(pdf[by], pdf.data, strict=True):
                if len(data) != width * height * np.dtype(kind).itemsize:
                    raise ValueError(f"{key}: {len(data)} bytes are no grid of {width} by {height}")
                v = np.frombuffer(bytes(data), kind).reshape(height, width)
                y, x = np.indices(v.shape)
                yield pd.DataFrame({by: key, "x": x.ravel(), "y": y.ravel(), "value": v.ravel().astype(float)})

    ship(files.sparkSession)
    return files.select(by, "data").mapInPandas(run, f"{by} {dict(files.dtypes)[by]}, x int, y int, value double")


def read_grids(spark: SparkSession, path: str, width: int, height: int, kind: str = "<f4") -> DataFrame:
    """path, x, y and value of every raw grid that a path names."""
    return unpack_rows(spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data")), "path", width, height, kind)


def pack_masked(cells: DataFrame, by: str) -> DataFrame:
    """by and data: a byte a pixel (index i from 0 on, gray), then a bit a pixel (valid) in words of 32, of each key. cells: by, i, gray, valid."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = (int(pdf.i.max()) // 32 + 1) * 32
        gray, valid = np.zeros(n, np.uint8), np.zeros(n, bool)
        gray[pdf.i], valid[pdf.i] = pdf.gray, pdf.valid == 1
        return pd.DataFrame({by: [pdf[by].iloc[0]], "data": [gray.tobytes() + np.packbits(valid, bitorder="little").tobytes()]})

    ship(cells.sparkSession)
    return cells.select(by, "i", "gray", "valid").groupBy(by).applyInPandas(run, f"{by} {dict(cells.dtypes)[by]}, data binary")


def unpack_masked(files: DataFrame, by: str) -> DataFrame:
    """by, i and gray of the valid pixels; data whose length fits no number of pixels is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, data in zip(pdf[by], pdf.data, strict=True):
                if len(data) % 36:
                    raise ValueError(f"{key}: {len(data)} bytes are no gray levels with their mask")
                n = len(data) // 36 * 32
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(data[n:]), np.uint8), bitorder="little"))
                yield pd.DataFrame({by: key, "i": at, "gray": np.frombuffer(bytes(data[:n]), np.uint8)[at].astype(np.int32)})

    ship(files.sparkSession)
    return files.select(by, "data").mapInPandas(run, f"{by} {dict(files.dtypes)[by]}, i long, gray int")


def from_mirrors(mirrors: list[Callable[[], bytes]], least: int, tries: int = 2, wait: Callable[[float], None] = time.sleep) -> bytes | None:
    """What the first mirror gives that gives anything, each tried so often."""
    for read in mirrors:
        got = fetched(read, least, tries, wait)
        if got is not None:
            return got
    return None


def read_feature_pages(spark: SparkSession, path: str) -> DataFrame:
    """id, lon and lat of the points on all pages (GeoJSON files) that a path names; a feature on two pages is one."""
    pages = spark.read.schema("features array<struct<id:string,geometry:struct<type:string,coordinates:array<double>>>>").json(path, multiLine=True)
    rows = pages.select(F.explode("features").alias("f")).filter("f.geometry.type = 'Point'")
    return rows.groupBy("f.id").agg(F.min("f.geometry.coordinates").alias("c")).select("id", F.col("c")[0].alias("lon"), F.col("c")[1].alias("lat"))


#: Height code, class and misfit of a pixel, as they lie in a packed fit.
FIT = np.dtype([("code", "<u2"), ("cls", "u1"), ("misfit", "u1")])


def pack_fits(fits: DataFrame, by: str) -> DataFrame:
    """by, first and data: fits (pixel, code, cls, misfit) of each key as the three columns one after the other, from the least pixel on; pixels in between that are missing are all 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf.pixel.min())
        out = np.zeros(int(pdf.pixel.max()) - first + 1, FIT)
        for name in FIT.names:
            out[name][pdf.pixel - first] = pdf[name]
        return pd.DataFrame({by: [pdf[by].iloc[0]], "first": [first], "data": [b"".join(out[name].tobytes() for name in FIT.names)]})

    ship(fits.sparkSession)
    return fits.select(by, "pixel", "code", "cls", "misfit").groupBy(by).applyInPandas(run, f"{by} {dict(fits.dtypes)[by]}, first long, data binary")


def unpack_fits(files: DataFrame, by: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, first, data in zip(pdf[by], pdf["first"], pdf.data, strict=True):
                n, at, out = len(data) // FIT.itemsize, 0, {}
                for name in FIT.names:
                    kind = FIT.fields[name][0]
                    out[name] = np.frombuffer(bytes(data[at : at + n * kind.itemsize]), kind).astype(np.int32)
                    at += n * kind.itemsize
                yield pd.DataFrame({by: key, "pixel": np.arange(first, first + n), **out})

    ship(files.sparkSession)
    return files.select(by, "first", "data").mapInPandas(run, f"{by} {dict(files.dtypes)[by]}, pixel long, code int, cls int, misfit int")


def stack_of_planes(planes: DataFrame, scenes: Column) -> DataFrame:
    """scene, pixel, v, w from planes (scene, kind 'valid' or 'water', word, bits) of the scenes that a JSON list names."""
    named = planes.join(planes.sparkSession.range(1).select(F.explode(F.from_json(scenes, "array<struct<id:int,tide:int>>")).alias("s")).select(F.col("s.id").alias("scene"), "s.tide"), "scene")
    bit = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("bits")))
    words = named.groupBy("scene", "tide", "word").agg(bit("valid").alias("valid"), bit("water").alias("water"))
    each = words.select("scene", "tide", "word", F.coalesce("valid", F.lit(0)).alias("valid"), F.coalesce("water", F.lit(0)).alias("water"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("k"))
    v = F.getbit("valid", F.col("k")).cast("int")
    return each.select("scene", "tide", (F.col("word") * 32 + F.col("k")).alias("pixel"), v.alias("v"), (v * F.getbit("water", F.col("k")).cast("int")).alias("w")).filter("v = 1")


def follow_pages(pages: DataFrame, first: str, most: int = 40) -> DataFrame:
    """id, datetime, cloud and nodata of the scenes on a catalogue's pages (name, body), from the first on by the name of the next, `most` pages at the longest.

    Only names are followed on the driver; a page's scenes stay where they are."""
    parsed = pages.select("name", F.from_json("body", SCENE_PAGE).alias("p"))
    nexts = {r["name"]: r["next"] for r in parsed.select("name", F.col("p.next").alias("next")).collect()}  # a name a page
    chain, at = [], first
    while at in nexts and at not in chain and len(chain) < most:
        chain.append(at)
        at = nexts[at]
    return parsed.filter(F.col("name").isin(chain)).select(F.explode("p.features").alias("f")).select("f.id", "f.properties.datetime", "f.properties.cloud", "f.properties.nodata")


def first_good(candidates: DataFrame, by: list[str], rank: str, good: Column) -> DataFrame:
    """For each key the first candidate by rank that is good; keys without one are left out."""
    return candidates.filter(good).groupBy(*by).agg(F.min_by(F.struct(*[c for c in candidates.columns if c not in by]), rank).alias("c")).select(*by, "c.*")


def fetched(read: Callable[[], bytes], least: int, tries: int = 5, wait: Callable[[float], None] = time.sleep) -> bytes | None:
    """What read() gives, tried again after 2 a^2 seconds (a the attempt) if it fails or gives fewer than `least` bytes; None if it never does better, which a cache can keep as a tombstone."""
    for attempt in range(1, tries + 1):
        try:
            got = read()
        except OSError:
            got = b""
        if len(got) >= least:
            return got
        if attempt < tries:
            wait(2.0 * attempt * attempt)
    return None


_TIFF = {1: "B", 2: "s", 3: "H", 4: "I", 12: "d"}


def decode_tiff(data: bytes) -> tuple[np.ndarray, tuple[float, float, float, float], float | None]:
    """(values, (west, north, cell width, cell height), nodata) of a one-band TIFF without compression, in strips, with the usual geographic tags."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind not in _TIFF:
            continue
        size = struct.calcsize(_TIFF[kind]) * n
        place = at + 10 + 12 * k if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
        tags[tag] = data[place : place + n].rstrip(b"\0") if kind == 2 else struct.unpack(f"{order}{n}{_TIFF[kind]}", data[place : place + size])
    width, height, bits = tags[256][0], tags[257][0], tags[258][0]
    if tags.get(259, (1,))[0] != 1 or tags.get(277, (1,))[0] != 1:
        raise ValueError("only one band without compression")
    body = b"".join(data[a : a + n] for a, n in zip(tags[273], tags[279], strict=True))
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]]
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    nodata = float(tags[42113]) if 42113 in tags else None
    return np.frombuffer(body, f"{order}{kind}{bits // 8}").reshape(height, width), (tie[3], tie[4], scale[0], scale[1]), nodata


def read_tiffs(spark: SparkSession, path: str) -> DataFrame:
    """path, x, y, lon, lat (of the cell's middle) and value of every cell with a value of the images that a path names; many sheets are one table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf.path, pdf.content, strict=True):
                v, (west, north, w, h), nodata = decode_tiff(bytes(content))
                y, x = np.nonzero(np.isfinite(v) & (v != nodata if nodata is not None else True))
                yield pd.DataFrame({"path": p, "x": x, "y": y, "lon": west + (x + 0.5) * w, "lat": north - (y + 0.5) * h, "value": v[y, x].astype(float)})

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, x int, y int, lon double, lat double, value double")
