"""A page travels once: orders are scored, and candidates found and weighed, in the row that holds it."""

import random

from lectern import registered as own
from lectern.operators import layout
from lectern.queries_tables import _folded, _ordered


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_orders_are_made_and_dealt_once(spark, sf):
    plan = _plan(own.QUERIES["a22_order_scores"](spark, sf))
    assert plan.count("FileScan") == 1 and plan.count("hashpartitioning(page_id") == 1 and "FlatMapGroupsInPandas" not in plan


def test_no_candidate_travels(spark, sf):
    for name in ("j6_candidates", "j7_resolved"):
        plan = _plan(own.QUERIES[name](spark, sf))
        assert "hashpartitioning(page_id" in plan and ", f#" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x), plan
    assert ", place#" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)


def test_chosen_in_the_page_as_by_candidates(spark):
    rng = random.Random(3)
    words = ["a", "b", "ab", "ba", "aba", "c"]
    truth = [(p, i, rng.choice(words)) for p in "xyz" for i in range(30)] + [("lone", 0, "a")]
    output = [(p, 3 * i, rng.choice(words)) for p in "xyw" for i in range(25)]
    o, t = spark.createDataFrame(output, "page_id string, place int, f string"), spark.createDataFrame(truth, "page_id string, seq int, f string")
    found = layout.assign(o, t)
    want = {(p, place, i, k) for p, place, f in output for q, i, _ in truth if p == q for k in range(1, 9) if "".join(x for r, j, x in truth if r == q and i <= j < i + k) == f and i + k <= 30}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    key = lambda df: sorted(df.collect(), key=str)
    assert key(layout.resolved(o, t)) == key(layout.resolve(found, o, t))


def test_every_place_of_the_page_is_looked_at(spark, sf):
    """Each token that has a fold is an output token: it meets itself at least, so that it has a candidate and a row."""
    want = {(r.page_id, r.place) for r in _folded(spark, sf)[1].join(_ordered(spark, sf).select("page_id", "seq", "place"), ["page_id", "seq"]).collect()}
    for name in ("j6_candidates", "j7_resolved"):
        assert {(r.page_id, r.place) for r in own.QUERIES[name](spark, sf).collect()} == want
        assert "place % 3" not in own.SQL[name].split("), op AS", 1)[1]
