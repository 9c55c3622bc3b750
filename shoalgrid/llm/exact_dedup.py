"""Exact dedup by progressive refinement (DataFrame functions only).

Three rounds, each narrowing what the next one looks at: byte length, then a hash of the first characters, then SHA-256 of the
whole text. Length and prefix hash are read once, into a slim table. A round counts its keys (eight bytes each, map-side first) and passes on those that two rows share, as bits of a table with at most
BIT_ROWS rows of 64: that bound holds whatever the input, so the table can be broadcast and no text is shuffled to find duplicates. Only
shared keys set bits, so unique texts are seldom let through; two keys that meet in a bit only cost one more hash. Text is shuffled by one path
only: rows of true groups (and those few), to keep one of each, and map-side first, so that a hot group is one row per task.

Defined cases: a null text equals the empty text; texts, also very long ones, are compared byte for byte, unchanged; of equal texts the row with the largest
doc_id stays (null doc_ids are the smallest), and of rows that repeat that doc_id too exactly one, in decisions() as in keep_one(); extra columns, also of clashing names, pass
through keep_one() (of rows that repeat text and doc_id the one whose other columns hash lowest); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.llm.common import materialize, table

#: Rows of the table of shared keys that is broadcast, 64 bits each.
BIT_ROWS = 1 << 20
PREFIX_CHARS = 256
#: Equal rows that are written out by one task at a time.
CHUNK = 4096

_KEYS = ("_len", "_prefix", "_sha")


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BIT_ROWS * 64))


def _shared(keyed: DataFrame, key: Column) -> DataFrame:
    """_row and _bits: a bit is set if a key of that slot is found in two rows or more."""
    several = keyed.groupBy(key.alias("_key")).count().filter("count > 1").select(_slot(F.col("_key")).alias("_slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_slot") % 64).cast("int"))
    return several.groupBy(F.shiftright("_slot", 6).cast("int").alias("_row")).agg(F.bit_or(bit).alias("_bits"))


def _flagged(rows: DataFrame, shared: DataFrame, key: Column) -> DataFrame:
    """rows with _may: whether another row may have the same key."""
    placed = rows.withColumn("_slot", _slot(key)).withColumn("_row", F.shiftright("_slot", 6).cast("int"))
    may = F.coalesce(F.getbit("_bits", (F.col("_slot") % 64).cast("int")) == 1, F.lit(False))
    return placed.join(shared, "_row", "left").withColumn("_may", may).drop("_slot", "_row", "_bits")


def _len_and_prefix() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.octet_length(text).alias("_len"), F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("_prefix")]


def _sha() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("_sha")


def _pair() -> Column:
    return F.xxhash64("_len", "_prefix")


def shared_pairs(docs: DataFrame) -> DataFrame:
    """The bits of every pair of length and prefix that two rows share: rows are first thinned by length alone."""
    slim = materialize(docs.select(*_len_and_prefix()), "exact-keys")
    several = _flagged(slim, F.broadcast(_shared(slim, F.col("_len"))), F.col("_len")).filter("_may")
    return materialize(_shared(several, _pair()), "exact-pairs")


def survivors(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose length and prefix another row may share, with _len, _prefix; all other rows, which are unique)."""
    pairs = F.broadcast(shared_pairs(docs.select("text")))  # at most BIT_ROWS rows
    flagged = _flagged(docs.select("*", *_len_and_prefix()), pairs, _pair())
    return flagged.filter("_may").drop("_may"), flagged.filter(~F.col("_may")).select(*docs.columns)


def groups(rows: DataFrame) -> DataFrame:
    """One row per group of equal texts: _len, _prefix, _sha, keep_id, group_size, and _top, the rows that have keep_id. rows: doc_id and the three keys.

    Counted map-side first, by key and doc_id, then by key."""
    each = rows.groupBy(*_KEYS, "doc_id").agg(F.count(F.lit(1)).alias("_n"))
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"), F.col("_n"))).alias("_best")
    return each.groupBy(*_KEYS).agg(best, F.sum("_n").alias("group_size")).filter("group_size > 1").select(*_KEYS, F.col("_best.doc_id").alias("keep_id"), "group_size", F.col("_best._n").alias("_top"))


def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row; only keys and hashes are shuffled, never texts."""
    pairs = F.broadcast(shared_pairs(docs.select("text")))
    # The result names every row's hash, so here the last round hashes all rows; only those that may be in a group are counted.
    rows = materialize(_flagged(docs.select("doc_id", *_len_and_prefix(), _sha()), pairs, _pair()), "exact-rows")
    many = materialize(groups(rows.filter("_may").select("doc_id", *_KEYS)), "exact-groups")
    joined = rows.join(many, list(_KEYS), "left")
    top = F.coalesce(F.col("_top"), F.lit(1)) > 1
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    same = keep.eqNullSafe(F.col("doc_id"))
    size = F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")
    repeated = many.filter("_top > 1")
    if not repeated.limit(1).count():
        return joined.select("doc_id", keep.alias("keep_id"), size, same.alias("kept"), F.col("_sha").alias("text_sha256"))
    out = joined.filter(~(top & same)).select("doc_id", keep.alias("keep_id"), size, same.alias("kept"), F.col("_sha").alias("text_sha256"))
    # Rows that repeat the doc_id that stays: one of them stays. Written from their number, in chunks, so that no task writes all rows of a hot group.
    chunks = repeated.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_top") - 1) / CHUNK)))).repartition("_k")
    each = chunks.withColumn("_j", F.explode(F.sequence(F.col("_k") * CHUNK, F.least((F.col("_k") + 1) * CHUNK, F.col("_top")) - 1)))
    return out.unionByName(each.select(F.col("keep_id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("_j") == 0).alias("kept"), F.col("_sha").alias("text_sha256")))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without its exact duplicates: unique rows pass unshuffled, of each group the row with the largest doc_id stays."""
    # The row travels as one value, so that its columns' names can't clash with ours.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    many, unique = survivors(docs.select("doc_id", "text", whole))
    order = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), -F.shiftright(F.xxhash64("whole"), 1))
    first = many.select("*", _sha()).groupBy(*_KEYS).agg(F.max_by("whole", order).alias("whole"))
    return unique.select("whole").unionByName(first.select("whole")).select("whole.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents"))


QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLES = {
    "op10_exact_dedup": """
with d as (select doc_id, sha256(coalesce(text, '')) text_sha256 from documents),
g as (select text_sha256, max(doc_id) keep_id, count(*) group_size from d group by 1)
select doc_id, keep_id, cast(group_size as bigint) group_size, row_number() over (partition by text_sha256 order by doc_id desc nulls last) = 1 as kept, text_sha256 from d join g using (text_sha256)
"""
}
