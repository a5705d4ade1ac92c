"""Elisions are told apart among tokens with an apostrophe only."""

from lectern import registered as own


def test_only_tokens_with_an_apostrophe_are_told_apart(spark, sf):
    plan = own.QUERIES["f8_elisions"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan.split("Aggregate", 1)[1], plan
