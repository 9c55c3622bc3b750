"""SimHash near-dedup by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; two documents link at RADIUS or fewer differing bits. Every distinct fingerprint emits all its
variants within RADIUS / 2 bits (1 + 64 + 2016); two fingerprints share a variant exactly if they link. Variants are shuffled
as packed arrays of ten bytes a variant (the variant, and which difference made it: their XOR is the
fingerprint again), a row per task block and part. All fingerprints that meet in a variant link to each other by the triangle inequality, so
each links to the smallest of them only: no link between components is lost and a group of n near copies gives n - 1 edges
a variant, not n squared. The edges are deduplicated and verified, then components follow by star contraction.

The variants of all fingerprints are many times the fingerprints, so they are made in PASSES slices of the variant space, one job each;
only one slice is on disk at a time. The number of shuffle parts follows from the number of fingerprints, so a task's memory is bounded; beyond a few thousand
parts variants are dealt out in two steps, so that packed rows stay large and their number in proportion to the input.

Copies share a fingerprint and are one row from the start, so a hot group costs nothing.

Defined cases: a null or empty text has fingerprint zero, linked like any other; fewer words than a shingle make one shingle; a component's id is
its smallest doc_id that is not null; ties can't change that; documents are known by doc_id, so rows that repeat one share its fate in keep_one(); very long texts are read whole, a chunk of
shingles at a time; extra columns, also of clashing names, pass through keep_one(); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.lineage import scratch_path
from shoalgrid.llm.common import COARSE, arrow_batches, groups_of, materialize, partitions, release, share_out, table
from shoalgrid.operators.stars import components

SHINGLE = 4
SEED = 42
RADIUS = 4
PASSES = 6
#: Variants that one task of the meeting stage holds, and fingerprints of one emitted block.
TASK_VARIANTS = 1 << 21
BLOCK = 1024
_CHUNK = 1 << 16
#: An odd constant: multiplying by it is a bijection of 64-bit words that mixes low bits into high ones.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_UNSPREAD = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def fingerprint(text: bytes) -> int:
    """SimHash of a UTF-8 text; bytes.split() splits at exactly the six separators, bytes.lower() lowers A-Z only."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > SHINGLE:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, n, ones = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        a, b = starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist()
        h = np.fromiter([digest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)], np.uint64, len(a))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row."""
    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def masks(radius: int) -> np.ndarray:
    """All differences of up to radius bits."""
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)], np.uint64)


def _part(spread: np.ndarray, passes: int, parts: int) -> np.ndarray:
    return (spread >> np.uint64(32)).astype(np.uint32) // np.uint32(passes) % np.uint32(parts)


def _packed(spread: np.ndarray, which: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """A row for each part that gets something: its variants, then which difference made each."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    spread, which, part = spread[order], which[order], part[order]
    ids, first = np.unique(part, return_index=True)
    ends = [*first[1:].tolist(), len(part)]
    packed = [spread[a:b].tobytes() + which[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(packed, pa.binary())], ["part", "packed"])


def _emit(step: int, passes: int, parts: int, radius: int, coarse: int):
    together = np.uint32(groups_of(parts, coarse))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = masks(radius // 2)
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), BLOCK):
                spread = (every[at : at + BLOCK, None] ^ ball[None, :]) * _SPREAD
                row, col = np.nonzero((spread >> np.uint64(32)).astype(np.uint32) % np.uint32(passes) == step)
                spread = spread[row, col]
                yield _packed(spread, col.astype(np.uint16), _part(spread, passes, parts) // together)

    return run


def _unpacked(buffers: list[pa.Buffer]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [x.size // 10 for x in buffers]
    spread = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(buffers, sizes, strict=True)])
    return spread, np.concatenate([np.frombuffer(x, np.uint16, n, 8 * n) for x, n in zip(buffers, sizes, strict=True)])


def _refine(passes: int, parts: int):
    """Variants of a group of parts, packed anew for each part, from up to TASK_VARIANTS at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            spread, which = _unpacked(held)
            return _packed(spread, which, _part(spread, passes, parts))

        for batch in batches:
            for x in batch.column("packed"):
                held.append(pa.py_buffer(x.as_buffer().to_pybytes()))
                size += held[-1].size // 10
                if size >= TASK_VARIANTS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def _meet(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spreads, marks = [], []
        for batch in batches:
            for x in batch.column("packed"):
                buffer = x.as_buffer()
                n = buffer.size // 10
                spreads.append(np.frombuffer(buffer, np.uint64, n).copy())
                marks.append(np.frombuffer(buffer, np.uint16, n, 8 * n).copy())
        if not spreads:
            return
        spread, which = np.concatenate(spreads), np.concatenate(marks)
        del spreads, marks
        order = np.argsort(spread)
        spread = spread[order]
        same = spread[1:] == spread[:-1]
        met = np.concatenate((same, [False])) | np.concatenate(([False], same))
        if not met.any():
            return
        spread, which = spread[met], which[order[met]]
        own = spread * _UNSPREAD ^ masks(radius // 2)[which]
        order = np.lexsort((own, spread))
        spread, own = spread[order], own[order]
        new = np.concatenate(([True], spread[1:] != spread[:-1]))
        least = own[np.nonzero(new)[0][np.cumsum(new) - 1]]
        real = ~new & (np.bitwise_count(least ^ own) <= radius) & (least != own)
        pairs = np.unique(np.stack((least[real], own[real]), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], ["a", "b"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS, passes: int = PASSES, parts: int | None = None, coarse: int = COARSE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints: within radius bits each, and connecting all that are. distinct: a materialised table of fp."""
    spark = distinct.sparkSession
    n, size = distinct.count(), len(masks(radius // 2))
    parts = parts or max(partitions(spark), -(-n * size // passes // TASK_VARIANTS))
    path = scratch_path(spark, "simhash-links")
    tasks = max(1, min(parts, -(-n // BLOCK)))
    for step in range(passes):
        spread = distinct.select("fp").repartition(tasks).mapInArrow(_emit(step, passes, parts, radius, coarse), "part int, packed binary")
        share_out(spread, parts, _refine(passes, parts), coarse).mapInArrow(_meet(radius), "a long, b long").distinct().write.parquet(f"{path}/{step}")
        del spread
        release(spark)
    return spark.read.schema("a long, b long").parquet(*[f"{path}/{step}" for step in range(passes)])


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    rows = materialize(fingerprints(docs), "simhash-rows")
    each = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = materialize(components(links(each, radius)), "simhash-roots")
    members = each.join(roots, each.fp == roots.node).select("fp", "least", "root")
    lowest = members.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = members.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    of = materialize(each.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "simhash-components")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one document of each group: the one whose doc_id names the group."""
    stays = near_groups(docs.select("doc_id", "text"), radius).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays")).distinct()
    # The row travels as one value, so that its columns' names can't clash with ours.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(stays, F.col("id").eqNullSafe(F.col("stays")), "left_semi").select("row.*")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash_near_dedup": op8_simhash_near_dedup}
ORACLES: dict[str, str] = {}
