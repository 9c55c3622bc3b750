"""What shows on larger tables only."""

import base64

import pytest

from shoalgrid.operators import stepfit
from shoalgrid.plans import catalogue, waterline


def test_long_texts_are_coded_in_one_line(spark, tmp_path):
    urls = ["a" * 57, "b" * 58, "http://example.org/" + "é" * 200, "", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["code"] for r in catalogue.queries()["text_codes"](spark, str(tmp_path)).collect()}
    assert got == {i: None if u is None else base64.b64encode(u.encode()).decode() for i, u in enumerate(urls)}


@pytest.mark.parametrize("name", ["hypsometry", "place_scores", "wet_mean", "two_pass_fit", "fair_compare", "cloud_lag_grid"])
def test_no_table_of_pixels_is_broadcast(spark, name):
    """Spark guesses the stack's size from the file of pixels, so on any small file it would."""
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "pixel" in line]
    assert not joins


def test_a_pixel_of_several_parts_keeps_all_observations(spark, tmp_path):
    parts = [(1, 10), (1, 40), (2, None), (None, 5), (3, 7)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want = {r["pixel"]: r["codes"] for r in stepfit.packed(waterline.stack(spark, str(tmp_path))).collect()}
    assert {r["pixel"]: r["codes"] for r in waterline.packed_stack(spark, str(tmp_path)).collect()} == want
    assert len(want[1]) == 60 and want[2] == want[None] == []
