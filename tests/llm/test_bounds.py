"""What a task holds of tables with large rows."""

import glob

import pyarrow.parquet as pq

from shoalgrid import lineage
from shoalgrid.llm import substring_dedup


def test_blocks_are_written_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 64)
    docs = spark.createDataFrame([(i, f"words of document {i} " * 4) for i in range(30)], "doc_id long, text string").coalesce(1)
    assert substring_dedup.remove_repeats(docs, 5).count() == 30
    path = [p for p in lineage._made[spark.sparkContext.applicationId] if "/substring-blocks-" in p][-1]
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path.removeprefix('file:')}/*.parquet")]
    assert sum(m.num_rows for m in files) == 30
    assert all(m.row_group(g).num_rows <= substring_dedup.TOGETHER for m in files for g in range(m.num_row_groups))
