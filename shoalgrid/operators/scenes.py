"""Choosing and counting scenes: duplicates, bins, histograms, thresholds, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.lineage import cut, drop

#: Rows of a key that are sorted in one task.
SORTED = 1 << 18


def first_by(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the given order (which must be total for a defined result). Spark keeps a row a key of each task before it shuffles (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def numbered(rows: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    """rows with their number from 0 within the key, in order. Rows are dealt out by range of key and order, numbered within a range, and moved by what lies before: a key may hold all rows."""
    placed = cut(rows.repartitionByRange(*by, *order).withColumn("_place", F.spark_partition_id()), "numbered")
    counts = placed.groupBy(*by, "_place").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range that a key lies in
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*[F.col(c).alias(f"_{c}") for c in by], "_place", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_place", *by).orderBy(*order)) - 1
    same = [placed["_place"] == starts["_place"], *[placed[c].eqNullSafe(starts[f"_{c}"]) for c in by]]
    return placed.withColumn("_within", within).join(starts, same).select(*rows.columns, (F.col("_before") + F.col("_within")).alias(name))


def every_kth(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """Rows 0, k, 2k ... of each key, in order; not a random sample."""
    return numbered(rows, by, order, "_i").filter(F.col("_i") % k == 0).drop("_i")


def clamped_bins(rows: DataFrame, value: Column, width: float, bins: int) -> DataFrame:
    """bin and n for each of `bins` bins, empty ones too; the first and last take what lies beyond."""
    spark = rows.sparkSession
    counts = rows.select(F.least(F.greatest(F.floor(value / F.lit(width)), F.lit(0)), F.lit(bins - 1)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return spark.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def dropped_bins(rows: DataFrame, value: Column, lo: float, width: float, bins: int) -> DataFrame:
    """bin and n of the bins that have rows; rows beyond the range are ignored."""
    b = F.floor((value - F.lit(lo)) / F.lit(width))
    return rows.select(b.alias("bin")).filter((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def histogram(rows: DataFrame, by: list[str], gray: Column) -> DataFrame:
    return rows.groupBy(*by, gray.cast("int").alias("gray")).agg(F.count(F.lit(1)).alias("n"))


def otsu(hist: DataFrame, by: list[str], initial: int = 128) -> DataFrame:
    """The threshold of each key's histogram (gray, n) with the largest variance between the classes, the first on ties; `initial` if one class is always empty.

    Works on at most 256 rows a key, not on pixels."""
    run = Window.partitionBy(*by).orderBy("gray")
    whole = Window.partitionBy(*by)
    weighted = F.col("gray") * F.col("n")
    t = hist.select(*by, "gray", F.sum("n").over(run).alias("wb"), F.sum(weighted).over(run).alias("sb"), F.sum("n").over(whole).alias("w"), F.sum(weighted).over(whole).alias("s"))
    wf = F.col("w") - F.col("wb")
    gap = F.try_divide(F.col("sb"), F.col("wb")) - F.try_divide(F.col("s") - F.col("sb"), wf)
    t = t.withColumn("between", F.when((F.col("wb") > 0) & (wf > 0), F.col("wb").cast("double") * wf * gap * gap))
    best = F.max(F.when(F.col("between") > 0, F.struct(F.col("between"), (-F.col("gray")).alias("g"))))
    return t.groupBy(*by).agg(F.coalesce(-best["g"], F.lit(initial)).cast("int").alias("threshold"))


def smoothed(hist: DataFrame, by: list[str], radius: int = 4, levels: int = 256) -> DataFrame:
    """by, gray, n and smooth for every level: the mean of the levels within radius, cut off at the ends."""
    spine = hist.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("gray"))
    dense = spine.join(hist, [*by, "gray"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return dense.withColumn("smooth", F.avg("n").over(Window.partitionBy(*by).orderBy("gray").rowsBetween(-radius, radius)))


def valley(smooth: DataFrame, by: list[str], split: int = 128) -> DataFrame:
    """The two modes (below and from split, first on ties), the lowest level between them, and its height against the lower mode."""
    top = lambda side: F.max(F.when(side, F.struct("smooth", (-F.col("gray")).alias("g"))))
    modes = smooth.groupBy(*by).agg(top(F.col("gray") < split).alias("a"), top(F.col("gray") >= split).alias("b"))
    modes = modes.select(*by, (-F.col("a.g")).alias("low_mode"), (-F.col("b.g")).alias("high_mode"), F.least("a.smooth", "b.smooth").alias("lower"))
    between = smooth.join(modes, by).filter((F.col("gray") >= F.col("low_mode")) & (F.col("gray") <= F.col("high_mode")))
    out = between.groupBy(*by, "low_mode", "high_mode", "lower").agg(F.min(F.struct("smooth", "gray")).alias("v"))
    return out.select(*by, "low_mode", "high_mode", F.col("v.gray").alias("valley"), F.coalesce(F.try_divide(F.col("v.smooth"), F.col("lower")), F.lit(1.0)).alias("ratio"))


def at_rank(rows: DataFrame, by: list[str], value: str, rank: Column, most: int = SORTED) -> DataFrame:
    """The value at a rank from 0 (a function of n, the rows of the key) in ascending order. value: a number, without nulls.

    While a key has more than `most` rows left in question, values are counted in 1,024 bins between their least and greatest and only the bin that holds the rank is looked at
    again; so no task sorts a large key. What is left is sorted."""
    out = cut(rows.select(*by, F.col(value).alias("_v")), "ranked")
    sizes = out.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    left = cut(sizes.select(*by, rank.cast("long").alias("_rank"), F.col("n").alias("_n"), F.col("_lo").cast("double"), F.col("_hi").cast("double")), "ranked")
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in by]
    while left.filter((F.col("_n") > most) & (F.col("_lo") < F.col("_hi"))).limit(1).count():
        met = out.join(left, same(out, left)).select(*[out[c] for c in by], "_v", "_rank", "_lo", "_hi")
        share = F.when(F.col("_hi") > F.col("_lo"), (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
        binned = met.withColumn("_bin", F.least(F.floor(share * 1024), F.lit(1023)))
        counts = binned.groupBy(*by, "_bin", "_rank").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_bin"))  # at most 1,024 rows a key
        edge = counts.withColumn("_upto", upto).filter((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_n") <= F.col("_rank")))
        edge = edge.select(*by, (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"), "_n", F.col("_lo").cast("double"), F.col("_hi").cast("double"))
        old, left = (out, left), cut(edge, "ranked")
        out = cut(old[0].join(left, same(old[0], left)).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).select(*[old[0][c] for c in by], "_v"), "ranked")
        drop(*old)
    # A key whose values are all equal needs no order.
    flat = left.filter((F.col("_n") > most) & (F.col("_rank") < F.col("_n")))
    done = out.join(flat, same(out, flat), "left_semi").groupBy(*by).agg(F.min("_v").alias(value))
    few = left.filter(F.col("_n") <= most)
    ranked = out.join(few, same(out, few)).select(*[out[c] for c in by], "_v", "_rank").withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("_v")) - 1)
    return ranked.filter("_i = _rank").select(*by, F.col("_v").alias(value)).unionByName(done)


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The element at n div 2 of the sorted values."""
    return at_rank(rows, by, value, F.floor(F.col("n") / 2))


def detrend(rows: DataFrame, x: str, y: str) -> DataFrame:
    """rows with the residual of the straight line through them."""
    line = rows.agg(F.regr_slope(y, x).alias("_slope"), F.regr_intercept(y, x).alias("_cut"))
    return rows.crossJoin(F.broadcast(line)).withColumn("residual", F.col(y) - F.col("_slope") * F.col(x) - F.col("_cut")).drop("_slope", "_cut")


def furthest_partner(rows: DataFrame, left: Column, right: Column, key: str, value: str, within: int, id: str | None = None) -> DataFrame:
    """For every left row the right row whose key is at most `within` away (both whole numbers) and whose value lies furthest, the smaller value, then the smaller id, on ties: id, partner, gap.
    id: a whole number; the value itself if none is given.

    The furthest value is the least or the greatest one in reach, so no pairs are made. Keys are cut into cells of that width: a row reaches the whole of its own cell, the end of the
    one before and the beginning of the one after, whose running extremes are read off where its reach ends."""
    cell, id = F.floor(F.col(key) / within).cast("long"), id or value
    named = rows.select(cell.alias("cell"), F.col(key).alias("at"), F.col(value).alias("v"), F.col(id).cast("long").alias("id"), left.alias("left"), right.alias("right"))
    ends = named.filter("right").select("cell", "at", F.struct("v", "id").alias("lo"), F.struct(F.col("v"), (-F.col("id")).alias("id")).alias("hi"), F.lit(None).cast("long").alias("of"), F.lit(None).cast(dict(named.dtypes)["v"]).alias("own"), F.lit(0).alias("side"))
    mine, none = named.filter("left"), {c: F.lit(None).cast(dict(ends.dtypes)[c]).alias(c) for c in ("lo", "hi")}
    probe = lambda step, reach, side: mine.select((F.col("cell") + step).alias("cell"), (F.col("at") + reach).alias("at"), none["lo"], none["hi"], F.col("id").alias("of"), F.col("v").alias("own"), F.lit(side).alias("side"))
    # side: 1 takes all keys from `at` on, 2 all up to `at`, 3 the whole cell.
    both = ends.unionByName(probe(-1, -within, 1)).unionByName(probe(1, within, 2)).unionByName(probe(0, 0, 3))
    up = Window.partitionBy("cell").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("cell").orderBy(F.col("at").desc(), "side").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("cell")
    pick = lambda f, c: F.when(F.col("side") == 1, f(c).over(down)).when(F.col("side") == 2, f(c).over(up)).otherwise(f(c).over(whole))
    seen = both.select("of", "own", "side", pick(F.min, "lo").alias("lo"), pick(F.max, "hi").alias("hi")).filter("side > 0")
    best = seen.groupBy("of").agg(F.first("own").alias("own"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo is not null")
    below, above = F.abs(F.col("own") - F.col("lo.v")), F.abs(F.col("own") - F.col("hi.v"))
    return best.select(F.col("of").alias("id"), F.when(below >= above, F.col("lo.id")).otherwise(-F.col("hi.id")).alias("partner"), F.greatest(below, above).alias("gap"))
