"""Queries over the matcher's placements shuffle whole texts only: page, words, placements and their neighbours meet in the clip's row."""

import random

import pytest
from pyspark.sql import functions as F

from lectern import registered as own
from lectern.operators import align, contracts, drift, matcher
from lectern.plans import derived
from lectern.queries import _display
from lectern.queries_matched import _matched


@pytest.mark.parametrize("name", ["m1_resyncs", "w1_matched_drift", "a3_matched_coverage", "m6_matched_gaps", "a7_matched_causes", "j9_matched_split", "q1_matched_contract"])
def test_no_token_travels(spark, sf, name):
    plan = own.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "documents.parquet" in plan and "Join" not in plan and "Window" in plan, plan
    sums = {"a7_matched_causes": 1, "j9_matched_split": 1, "q1_matched_contract": 1}.get(name, 0)
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") + sums and plan.count("REPARTITION_BY_NUM") == 1, plan


@pytest.fixture(scope="module")
def both(spark):
    """Clips with holes in the page, words out of order, invented ones and none at all, and what the tables of the operators hold of them."""
    rng = random.Random(5)
    rows = []
    for c in range(60):
        said = 0.0
        for i in range(rng.randrange(1, 60)):
            if rng.random() < 0.1:
                continue
            text = rng.choice(["a", "b", "c", "d.", "e", "1", "250", "1,250", "Dr.", "l'eau", "colour", "naïve", "—", *(f"w{k}" for k in range(20))])
            r = rng.random()
            heard = [] if r < 0.2 or c % 9 == 0 else ["zzq"] if r < 0.25 else [text, "1250"] if r < 0.35 else [text]
            said += 0.3
            rows.append((c, rng.choice(["en", "fr"]), i, text, 7 * i, 7 * i + len(text), [(w, said + rng.choice([0.0, 0.0, -0.7, 2.0]), said + 5.0) for w in heard]))
    tokens = spark.createDataFrame(rows, "clip_id long, lang string, disp_idx int, text string, cs int, ce int, heard array<struct<w:string,s:double,e:double>>")
    d = tokens.drop("heard")
    m = matcher.match_tokens(d, tokens.select("clip_id", F.inline("heard"))).persist()
    return matcher.followed(matcher.clips(tokens)), d, m, matcher.placed(d, m)


def key(df):
    return sorted(map(str, df.collect()))


def test_rows_are_the_tables(both):
    clips, d, m, p = both
    unmatched = matcher.unmatched(m)
    asr = F.when(F.col("clip_id") % 6 == 0, F.col("match_conf")).when(F.col("disp_idx") % 9 == 0, None).otherwise(0.9)
    pairs = [
        (matcher.matched_rows(clips).select(*m.columns), m),
        (matcher.placed_rows(clips).select(*p.columns), p),
        (drift.local_drift(matcher.placed_rows(clips)).select("clip_id", "disp_idx", "drift_ms"), drift.local_drift(p).select("clip_id", "disp_idx", "drift_ms")),
        (drift.causes(matcher.placed_rows(clips)), drift.causes(p)),
        (drift.row_coverage(clips), drift.character_coverage(d, p)),
        (align.row_gaps(clips), align.align_gaps(d, p, unmatched)),
        (contracts.row_causes(clips), contracts.split_unmatched(unmatched, d).select("clip_id", "w", "cause")),
        (contracts.row_violations(clips, asr, 60.0, 96.0), contracts.contract_violations(d, p.transform(align.confidences).withColumn("asr_conf", asr), 60.0, 96.0)),
    ]
    for got, want in pairs:
        assert key(got) == key(want) != [], got
    assert {r.invariant for r in pairs[-1][1].collect()} == {"drift_bound", "coverage_floor", "confidence_collapse"}  # words come in order of their starts


def test_heard_words_are_the_observed(spark, sf):
    d = _display(spark, sf)
    want = derived.observed_tokens(d).select("clip_id", "w", "s", "e")
    assert key(derived.with_heard(d).select("clip_id", F.inline("heard"))) == key(want) != []
    assert _matched(spark, sf).agg(F.sum("words")).first()[0] == want.count()
