"""Binary rasters: 16-bit gray images and bit planes, a row a file."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.shipping import ship

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def encode_png16(values: np.ndarray, level: int = 9) -> bytes:
    """A gray image of 16 bits, no filter."""
    h, w = values.shape
    rows = np.zeros((h, 1 + 2 * w), np.uint8)
    rows[:, 1:] = values.astype(">u2").view(np.uint8).reshape(h, 2 * w)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def decode_png16(data: bytes) -> np.ndarray:
    """The values of a gray image of 16 bits without filter or interlace; checksums are verified."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, size = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("checksum")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    if size is None or size[2:] != (16, 0, 0, 0, 0):
        raise ValueError("not 16-bit gray")
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], 1 + 2 * size[0])
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return np.ascontiguousarray(rows[:, 1:]).view(">u2").astype(np.uint16)


def encode_png8(values: np.ndarray, level: int = 9) -> bytes:
    """A gray (height, width) or colour (height, width, 3 or 4) image of bytes, no filter."""
    h, w, c = (*values.shape, 1)[:3]
    rows = np.zeros((h, 1 + w * c), np.uint8)
    rows[:, 1:] = values.reshape(h, w * c)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def decode_png8(data: bytes, channel: int = 0) -> np.ndarray:
    """One channel of an image of bytes, without interlace; the usual five row filters are undone."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, size = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", data[at + 8 : at + 8 + n])
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    if size is None or size[2] != 8 or size[3] not in (0, 2, 6) or size[4:] != (0, 0, 0):
        raise ValueError("not gray or colour of bytes")
    c = {0: 1, 2: 3, 6: 4}[size[3]]
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], 1 + size[0] * c)
    out = np.zeros((size[1], size[0], c), np.uint8)
    above = np.zeros((size[0], c), np.int64)
    for y in range(size[1]):
        kind, line = rows[y, 0], rows[y, 1:].reshape(size[0], c).astype(np.int64)
        if kind in (0, 2):
            above = (line + (above if kind == 2 else 0)) % 256
        elif kind == 1:
            above = np.cumsum(line, axis=0) % 256
        elif kind in (3, 4):
            left = corner = np.zeros(c, np.int64)
            now = np.zeros_like(line)
            for x in range(size[0]):
                up = above[x]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    far = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
                    guess = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
                now[x] = left = (line[x] + guess) % 256
                corner = up
            above = now
        else:
            raise ValueError("unknown row filter")
        out[y] = above
    return out[:, :, channel]


def read_png16(spark: SparkSession, path: str) -> DataFrame:
    """path, x, y and code of every pixel of the images that a path names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf.path, pdf.content, strict=True):
                v = decode_png16(bytes(content))
                y, x = np.indices(v.shape)
                yield pd.DataFrame({"path": p, "x": x.ravel(), "y": y.ravel(), "code": v.ravel().astype(np.int32)})

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, x int, y int, code int")


def to_png16(cells: DataFrame, by: str, value: str, width: int, height: int) -> DataFrame:
    """by and png: an image for each key (a layer or tile of width by height cells; missing cells are 0)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((height, width), np.uint16)
        out[pdf.y, pdf.x] = pdf[value]
        return pd.DataFrame({by: [pdf[by].iloc[0]], "png": [encode_png16(out)]})

    ship(cells.sparkSession)
    kind = dict(cells.dtypes)[by]
    return cells.select(by, "x", "y", value).groupBy(by).applyInPandas(run, f"{by} {kind}, png binary")


def pack_plane(cells: DataFrame, by: str, index: str, flag: str) -> DataFrame:
    """by, word and bits: flags (0 or 1) packed 32 to a word."""
    bit = F.expr(f"shiftleft(cast({flag} as bigint), cast({index} % 32 as int))")
    return cells.groupBy(by, F.floor(F.col(index) / 32).alias("word")).agg(F.bit_or(bit).alias("bits"))


def unpack_plane(words: DataFrame, by: str, index: str, flag: str) -> DataFrame:
    rows = words.select(by, "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("k"))
    return rows.select(by, (F.col("word") * 32 + F.col("k")).alias(index), F.getbit("bits", F.col("k")).cast("int").alias(flag))
