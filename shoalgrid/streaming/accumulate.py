"""The per-pixel fold (sum and count of what each new scene shows) as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pixel_totals(scenes: DataFrame, value: str = "value") -> DataFrame:
    """pixel, n and total over all scenes so far; scenes is a stream (or a table) of rows with pixel and a value. Write it in update mode."""
    return scenes.groupBy("pixel").agg(F.count(value).alias("n"), F.sum(value).alias("total"))


def windowed_totals(scenes: DataFrame, time: str, value: str = "value", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """The same by window of time; rows later than the watermark don't count, and windows behind it are final."""
    return scenes.withWatermark(time, late).groupBy(F.window(time, width), "pixel").agg(F.count(value).alias("n"), F.sum(value).alias("total"))
