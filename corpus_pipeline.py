"""The corpus pipeline: from raw documents to the token ids of a deduplicated mix. Counted as part of the training-data subpackage.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, but for the last, which returns the encoded rows. run() writes
each stage's rows to the shared folder and reads them again, so a stage is never computed twice and a lost executor costs one task; what a stage had written for itself, and its
predecessor's rows, are deleted when its own are there.

Defined cases, for every stage: null and empty texts are texts without words; texts of any length pass whole; extra columns, also of clashing names, pass unchanged; an empty table
gives an empty result with the same columns. What stages do with ties and repeated rows is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoalgrid.lineage import drop, swept
from shoalgrid.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from shoalgrid.llm.common import materialize, release, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept. Texts under ten words go, null and empty ones among them; repeated rows are judged each for itself, alike."""
    return quality_rules.accepted(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the largest doc_id, and one of those that repeat it. A null doc_id is the smallest, a null text equals the empty one."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id; all rows that repeat it stay (none do after the stage before but those with different texts). Documents without words
    have one fingerprint and so are one group."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for: never, once or twice. A null source is one of its own; repeated rows are taken or left each for itself; documents without
    words change no target and come as often as their place in the seeded order says."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_tokens, token_ids and the decoded text of every row, beside what identifies it. A null text has no tokens; repeated rows are encoded each for itself."""
    return bpe.encode_documents(docs, output="ids").drop("text", "n_chars")


STAGES = [
    ("quality_rules", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: Seeded 64-bit hashes, component search and BPE have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with swept(spark) as keep:
            done = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.append(done)
        drop(docs)
        docs = done
        release(spark)
    return docs
