"""Words without a place meet their page in the clip's row, and a token's parts are made and put together in its own."""

import pytest

from lectern import registered as own


@pytest.mark.parametrize("name", ["a4_split_rates", "j9_split_unmatched"])
def test_no_form_travels(spark, sf, name):
    plan = own.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "hashpartitioning(clip_id" in x and "REPARTITION_BY_NUM" not in x]
    assert not any("form#" in x or "number#" in x for x in plan.splitlines() if "hashpartitioning" in x), plan
    assert all("cause#" in x for x in dealt), dealt


@pytest.mark.parametrize("name, sums", [("j18_expansion_round_trip", 1), ("f15_expanded_tokens", 0)])
def test_no_part_travels(spark, sf, name, sums):
    plan = own.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 + sums and plan.count("ArrowEvalPython") == 1 and "documents.parquet" in plan, plan
