"""Texts are dealt by clip while they are whole: what follows within a clip moves no tokens, and placements need no join."""

import pytest

from lectern import registered as own
from lectern.plans import derived
from lectern.queries import _display


@pytest.mark.parametrize("name", ["a7_causes", "t1_worst_drifts", "w3_drift_bound", "a3_character_coverage"])
def test_no_shuffle_of_tokens(spark, sf, name):
    plan = own.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(clip_id#" in plan and plan.count("hashpartitioning(clip_id#") == plan.count("REPARTITION_BY_NUM"), plan
    assert "SortMergeJoin" not in plan or name == "a3_character_coverage"


def test_placed_tokens_are_the_join(spark, sf):
    d = _display(spark, sf)
    joined = derived.placements(d, derived.observed_tokens(d)).toArrow().to_pylist()
    plain = derived.placed_tokens(d).toArrow().to_pylist()
    key = lambda r: (r["clip_id"], r["disp_idx"])
    assert sorted(joined, key=key) == sorted(plain, key=key) and plain
