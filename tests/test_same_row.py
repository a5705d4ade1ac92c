"""What a placement's own row knows needs no join, each text is cut once, and values are rounded close to a bound only."""

import pytest
from pyspark.sql import functions as F

from lectern import registered as own
from lectern.functions import text as t
from lectern.operators import contracts, stats
from lectern.plans import derived
from lectern.queries import _display, _placed
from lectern.queries_contract import _truth


@pytest.mark.parametrize("name", ["a20_calibration", "a21_offset_sweep", "a8_sign_summary"])
def test_cut_and_dealt_once(spark, sf, name):
    plan = own.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "Join" not in plan, plan


def test_pairs_and_deltas_are_the_joins(spark, sf):
    key = lambda df: sorted(map(str, df.collect()))
    d = _display(spark, sf).where("clip_id % 7 = 1")
    want = stats.pair_engines(derived.placed_tokens(d), derived.placed_tokens(d, 19, 29, 0.09))
    assert key(want) == key(stats.compared(derived.paired_tokens(d, 19, 29, 0.09)).select(*want.columns)) != []
    p = _placed(spark, sf).where("clip_id % 7 = 1")
    known = contracts.deltas_of(p.withColumn("true_s", F.col("cs") * F.lit(0.065) + F.lit(0.03)))
    want = contracts.truth_deltas(p, _truth(spark, sf)).select("clip_id", "disp_idx", "delta_ms")
    assert key(want) == key(known.select(*want.columns)) != []


def test_close_to_a_bound(spark):
    values = [None, float("nan"), float("inf"), float("-inf"), 0.0, 49.0, 49.9999, 49.99994, 49.99995, 49.999951, 49.9999999, 50.0, 50.00004, 50.00005, 50.000051, 50.0001, 50.0002, -50.00005]
    rows = spark.createDataFrame([(x,) for x in values], "x double")
    for bound in (50, -50, 250.0):
        r = F.round("x", 4)
        cells = rows.select("x", t.at_most(F.col("x"), bound, 4).alias("a"), (r <= bound).alias("b"), t.at_least(F.col("x"), bound, 4).alias("c"), (r >= bound).alias("d")).collect()
        assert all(c.a == c.b and c.c == c.d for c in cells), cells
