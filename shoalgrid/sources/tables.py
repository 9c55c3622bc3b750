"""Text sources: tide tables, vector features, ways. Every schema is given, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WAYS = "elements array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"
FEATURES = "features array<struct<properties:struct<valdco:double,depth:double>,geometry:struct<type:string,coordinates:string>>>"


def read_tide_table(spark: SparkSession, path: str) -> DataFrame:
    """time (local civil, as written) and height of a yearly table: day, weekday, month, year, then up to four pairs of time and height a line.

    Lines whose day isn't a number, and pairs whose time isn't HH:MM, are left out, so header lines and a byte order mark don't matter."""
    cells = spark.read.text(path).select(F.split("value", ",").alias("c"))
    cells = cells.filter(F.trim(F.col("c")[0]).rlike("^[0-9]+$") & (F.size("c") >= 6))
    pairs = F.transform(F.sequence(F.lit(4), F.lit(10), F.lit(2)), lambda k: F.struct(F.trim(F.get("c", k)).alias("at"), F.trim(F.get("c", k + 1)).alias("h")))
    rows = cells.select("c", F.explode(pairs).alias("p")).filter(F.col("p.at").rlike("^[0-9]{2}:[0-9]{2}$") & F.col("p.h").rlike("^-?[0-9.]+$"))
    day = F.make_date(F.trim(F.col("c")[3]).cast("int"), F.trim(F.col("c")[2]).cast("int"), F.trim(F.col("c")[0]).cast("int"))
    return rows.select(F.to_timestamp_ntz(F.concat_ws(" ", day.cast("string"), F.col("p.at")), F.lit("yyyy-MM-dd HH:mm")).alias("time"), F.col("p.h").cast("double").alias("height"))


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """id, tags and geometry of ways whose geometry is complete; of ways with the same id the one from the first file name stays."""
    elements = spark.read.schema(WAYS).json(path, multiLine=True).select(F.input_file_name().alias("file"), F.posexplode("elements").alias("place", "e"))
    whole = (F.col("e.type") == "way") & (F.size("e.geometry") >= 2) & ~F.exists("e.geometry", lambda p: p.isNull() | p["lat"].isNull() | p["lon"].isNull())
    first = F.min_by(F.col("e"), F.struct("file", "place"))
    return elements.filter(whole).groupBy("e.id").agg(first.alias("e")).select("id", "e.tags", "e.geometry")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """feature, part, i, x, y and depth (m, positive down) of points and lines; features without a depth are left out."""
    rows = spark.read.schema(FEATURES).json(path, multiLine=True).select(F.posexplode("features").alias("feature", "f"))
    depth = F.coalesce("f.properties.valdco", "f.properties.depth")
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    as_parts = (
        F.when(kind == "MultiLineString", F.from_json(text, "array<array<array<double>>>"))
        .when(kind == "LineString", F.array(F.from_json(text, "array<array<double>>")))
        .when(kind == "Point", F.array(F.array(F.from_json(text, "array<double>"))))
    )
    parts = rows.filter(depth.isNotNull()).select("feature", depth.alias("depth"), F.posexplode(as_parts).alias("part", "line"))
    return parts.select("feature", "part", "depth", F.posexplode("line").alias("i", "p")).select("feature", "part", "i", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), "depth")
