"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight; a source that would get more than max_epochs times its size is clamped there, and the excess goes to the
others by weight, until none is above its cap. Each round is one aggregate over the table of sources. A source then takes whole repetitions of all its documents
plus a seeded fraction: its documents in the order of a seeded hash, as long as taking the next whole document brings it nearer to its target.

The order is never built for a whole source: sizes are summed by hash bin (map-side first), the bin in which the target is reached is found from the sums and
split into finer bins, and only the last of these is looked at hash by hash. Rows with one hash, as repeated rows have, are counted, and so many of them are taken as the target
asks for. So a source, and a group of equal rows, may hold any share of all rows. Sources are numbered by range partitions, so there may be any number of them.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a source without words has
target 0 and takes nothing; ties of the hash are rows equal in doc_id, text and source: which of them are taken follows from a hash of the whole row; repeated rows count as
documents of their own, each taken or left for itself; very long texts count whole, and one document can be as far from the target as half its size; extra columns, also of clashing names,
pass through mix(); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoalgrid.llm.common import materialize, table

HASH_BITS = 60
#: Bits of the hash that each round of bins resolves: a source has at most 2^12 bins a round.
LEVELS = (12, 12)
#: Equal rows that are written out by one task at a time.
CHUNK = 4096


@dataclass(frozen=True)
class Mix:
    #: Weights of the sources in code point order, null last, repeating.
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    #: Words to share, as a multiple of all words.
    budget: float = 1.5
    max_epochs: float = 2.0
    seed: int = 42


def sized(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """docs' columns, with _size (words), _known and _source (a key without null) and _h (seeded hash)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{mix.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    return (
        docs.withColumn("_size", F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"))
        .withColumn("_known", F.col("source").isNotNull())
        .withColumn("_source", F.coalesce("source", F.lit("")))
        .withColumn("_h", F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long"))
    )


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with _i, their place in order (nulls last) from 1: numbered within range partitions, then moved by what comes before."""
    order = [F.col("_known").desc(), F.col("_source")]
    placed = materialize(sources.repartitionByRange(*order).withColumn("_place", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = placed.groupBy("_place").agg(F.count(F.lit(1)).alias("_n")).select("_place", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_place").orderBy(*order))
    return placed.withColumn("_within", within).join(offsets, "_place").withColumn("_i", F.col("_offset") + F.col("_within")).drop("_place", "_within", "_offset")


def water_level(ranked: DataFrame, budget: float) -> float | None:
    """Words a unit of weight that sources which aren't clamped get; None if all are (or there are none). ranked: _cap, _weight, _level, source_size."""
    level, clamped = None, -1
    while True:
        over = F.lit(False) if level is None else F.lit(level) > F.col("_level")
        now = ranked.agg(
            (F.sum("source_size") * F.lit(float(budget))).alias("total"),
            F.sum(F.when(over, F.col("_cap")).otherwise(0.0)).alias("caps"),
            F.sum(F.when(over, F.lit(0.0)).otherwise(F.col("_weight"))).alias("free"),
            F.sum(over.cast("long")).alias("n"),
        ).first()
        if not now["free"]:
            return None
        if now["n"] == clamped:
            return level
        level, clamped = (now["total"] - now["caps"]) / now["free"], now["n"]


def targets(slim: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per source: _known, _source, source_size, target."""
    ranked = _numbered(slim.groupBy("_known", "_source").agg(F.sum("_size").alias("source_size")))
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    ranked = ranked.withColumn("_weight", F.get(weights, ((F.col("_i") - 1) % len(mix.weights)).cast("int")))
    ranked = ranked.withColumn("_cap", F.lit(float(mix.max_epochs)) * F.col("source_size")).withColumn("_level", F.col("_cap") / F.col("_weight"))
    ranked = materialize(ranked, "mix-ranked")
    level = water_level(ranked, mix.budget)
    target = F.col("_cap") if level is None else F.when(F.lit(level) > F.col("_level"), F.col("_cap")).otherwise(F.lit(level) * F.col("_weight"))
    return ranked.select("_known", "_source", "source_size", target.alias("target"))


_KEYS = ["_known", "_source"]


def cut_by_hash(rows: DataFrame, want: DataFrame) -> DataFrame:
    """Where the running sum of _size in the order of _h comes nearest to _part, for each source. rows: _known, _source, _h, _size; want: _known, _source, _part.

    One row per source: rows with _h up to _cut are taken; of those with _h = _tie (null: none), which are equal, _take are."""
    want = want.select(*_KEYS, "_part")
    edge, shift, full = want.withColumn("_base", F.lit(0.0)), HASH_BITS, None
    running = Window.partitionBy(*_KEYS).orderBy("_bin")
    for bits in LEVELS:
        some = rows if full is None else rows.withColumn("_above", F.shiftright("_h", shift)).join(edge.select(*_KEYS, F.col("_bin").alias("_above")), [*_KEYS, "_above"])
        shift -= bits
        sums = some.groupBy(*_KEYS, F.shiftright("_h", shift).alias("_bin")).agg(F.sum("_size").cast("double").alias("_in"))  # at most 2^bits rows a source
        sums = sums.join(edge.select(*_KEYS, "_part", "_base"), _KEYS).withColumn("_upto", F.col("_base") + F.sum("_in").over(running))
        sums = materialize(sums, "mix-bins")
        taken = sums.filter(F.col("_upto") <= F.col("_part")).groupBy(*_KEYS).agg((F.shiftleft(F.max("_bin") + 1, shift) - 1).alias("_cut"))
        full = taken if full is None else full.unionByName(taken)
        edge = sums.filter((F.col("_upto") > F.col("_part")) & (F.col("_upto") - F.col("_in") < F.col("_part")))
        edge = edge.select(*_KEYS, "_bin", "_part", (F.col("_upto") - F.col("_in")).alias("_base"))
    inside = rows.withColumn("_bin", F.shiftright("_h", shift)).join(edge, [*_KEYS, "_bin"])
    classes = inside.groupBy(*_KEYS, "_h", "_size", "_part", "_base").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum(F.col("_n") * F.col("_size")).over(Window.partitionBy(*_KEYS).orderBy("_h", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.col("_base") + upto - F.col("_n") * F.col("_size")
    # A document is taken if its middle lies before the target: taking it whole comes nearer than leaving it.
    many = F.when(F.col("_size") == 0, F.when(before < F.col("_part"), F.col("_n")).otherwise(0)).otherwise(F.ceil((F.col("_part") - before) / F.col("_size") + F.lit(0.5)) - 1)
    classes = classes.withColumn("_m", F.least(F.greatest(many, F.lit(0)), F.col("_n")))
    tie = F.min(F.when((F.col("_m") > 0) & (F.col("_m") < F.col("_n")), F.struct("_h", "_m")))
    last = classes.groupBy(*_KEYS).agg(F.max(F.when(F.col("_m") == F.col("_n"), F.col("_h"))).alias("_within"), tie.alias("_at"))
    whole = full.groupBy(*_KEYS).agg(F.max("_cut").alias("_cut"))
    out = want.join(whole, _KEYS, "left").join(last, _KEYS, "left")
    return out.select(*_KEYS, F.coalesce(F.greatest("_cut", "_within"), F.lit(-1)).cast("long").alias("_cut"), F.col("_at._h").alias("_tie"), F.col("_at._m").cast("long").alias("_take"))


def cuts(slim: DataFrame, per_source: DataFrame) -> DataFrame:
    """per_source with _whole (repetitions of all documents), _cut, _tie and _take (see cut_by_hash)."""
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    want = per_source.withColumn("_whole", F.floor(ratio).cast("long")).withColumn("_part", F.col("target") - F.col("_whole") * F.col("source_size"))
    return want.drop("_part").join(cut_by_hash(slim.select(*_KEYS, "_h", "_size"), want), _KEYS)


def plan(docs: DataFrame, mix: Mix = Mix(), slim_columns: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame, bool]:
    """(slim table of all documents, one row per source with its target, whole repetitions and cut, whether a source has equal rows of which some are taken)."""
    slim = materialize(sized(docs, mix).select(*slim_columns, "_known", "_source", "_size", "_h"), "mix-sizes")
    per_source = materialize(cuts(slim, materialize(targets(slim, mix), "mix-targets")), "mix-cuts")
    return slim, per_source, per_source.filter("_tie is not null").limit(1).count() > 0


def _tied() -> Column:
    return F.col("_h").eqNullSafe(F.col("_tie"))


def _copies() -> Column:
    return F.col("_whole") + (F.col("_h") <= F.col("_cut")).cast("long")


def _each(counted: DataFrame) -> DataFrame:
    """_n rows for every row of counted, with _copies: one more than _whole for _take of them. Dealt out in chunks, so that no task writes all rows of a hot group."""
    chunks = counted.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / CHUNK)))).repartition("_k")
    each = F.sequence(F.col("_k") * CHUNK, F.least((F.col("_k") + 1) * CHUNK, F.col("_n")) - 1)
    return chunks.withColumn("_j", F.explode(each)).withColumn("_copies", F.col("_whole") + (F.col("_j") < F.col("_take")).cast("long")).drop("_k", "_j", "_n")


def decisions(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    slim, per_source, ties = plan(docs, mix)
    joined = slim.join(per_source, _KEYS)
    rows = (joined.filter(~_tied()) if ties else joined).withColumn("_copies", _copies())
    if ties:
        columns = ["doc_id", "_size", "source_size", "target", "_whole", "_take"]
        rows = rows.select(*columns, "_copies").unionByName(_each(joined.filter(_tied()).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))).select(*columns, "_copies"))
    return rows.select("doc_id", F.col("_size").alias("size"), "source_size", F.col("target").cast("double").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def mix(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """docs as mixed: each row as many times as the mix takes it."""
    _, per_source, ties = plan(docs, how)
    # The row travels as one value, so that its columns' names can't clash with ours.
    rows = sized(docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), how)
    rows = rows.join(per_source.select(*_KEYS, "_whole", "_cut", "_tie", "_take"), _KEYS)
    out = (rows.filter(~_tied()) if ties else rows).select("row", _copies().alias("_copies"))
    if ties:
        # Rows that are equal in doc_id, text and source; those that differ elsewhere are told apart by a hash of all columns, the rest are counted.
        tied = rows.filter(_tied()).select(*_KEYS, "row", "_whole", "_take", F.xxhash64("row").bitwiseAND(F.lit((1 << HASH_BITS) - 1)).alias("_h"), F.lit(1).cast("long").alias("_size"))
        want = per_source.filter("_tie is not null").select(*_KEYS, F.col("_take").cast("double").alias("_part"))
        inner = materialize(cut_by_hash(tied.select(*_KEYS, "_h", "_size"), want), "mix-ties")
        counted = tied.groupBy(*_KEYS, "_whole", "_h").agg(F.count(F.lit(1)).alias("_n"), F.first("row").alias("row")).join(inner, _KEYS)
        take = F.when(F.col("_h") <= F.col("_cut"), F.col("_n")).when(_tied(), F.col("_take")).otherwise(0)
        out = out.unionByName(_each(counted.select("row", "_whole", "_n", take.alias("_take"))).select("row", "_copies"))
    return out.filter("_copies > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents"))


def oracle(how: Mix = Mix()) -> str:
    weights = ", ".join(f"{float(w)}" for w in how.weights)
    return f"""
with d as (select doc_id, source, cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as bigint) size,
  cast('0x' || substr(md5('{how.seed}:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, {HASH_BITS // 4}) as bigint) h from documents),
s as (select source, cast(sum(size) as bigint) source_size from d group by 1),
r as (select *, row_number() over (order by source is null, source collate "binary") i from s),
w as (select *, list_extract([{weights}], cast((i - 1) % {len(how.weights)} + 1 as bigint)) weight, {how.max_epochs}::double * source_size cap from r),
v as (select *, cap / weight lvl, {how.budget}::double * sum(source_size) over () total from w),
a as (select *, (total - coalesce(sum(cap) over (order by lvl, i rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by lvl, i rows between current row and unbounded following) rest from v),
water as (select rest water from a where rest <= lvl order by lvl, i limit 1),
t as (select source, source_size, case when coalesce(water > lvl, true) then cap else water * weight end target from a left join water on true),
f as (select *, cast(floor(coalesce(target / nullif(cast(source_size as double), 0), 0)) as bigint) whole_times, target - floor(coalesce(target / nullif(cast(source_size as double), 0), 0)) * source_size part from t),
u as (select d.*, source_size, target, whole_times, part, sum(size) over (partition by d.source order by h, size rows between unbounded preceding and current row) upto from d join f on d.source is not distinct from f.source)
select doc_id, size, source_size, cast(target as double) target, size * (whole_times + case when upto - size / 2.0 < part then 1 else 0 end) taken from u
""".replace(' collate "binary"', "")


QUERIES = {"op2_mixing": op2_mixing}
ORACLES = {"op2_mixing": oracle()}
