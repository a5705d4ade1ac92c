"""Queries over the matcher's placements: the plain matcher's placements under the SQL of the planted ones."""

import re

import pyarrow as pa
import pytest

import oracle
import plain_matcher as plain
from lectern import registered as own
from lectern.plans import derived


@pytest.fixture(scope="module")
def con(sf):
    con = oracle.connect(sf)
    tokens = f"WITH {derived.SQL.strip()}"
    page, said, langs = {}, {}, {}
    for c, lang, i, t, cs, ce in con.execute(f"{tokens} SELECT clip_id, lang, disp_idx, text, cs, ce FROM disp ORDER BY clip_id, disp_idx").fetchall():
        page.setdefault(c, []).append((t, cs, ce))
        langs[c] = lang
    for c, w, s, e in con.execute(f"{tokens} SELECT clip_id, w, s, e FROM obs ORDER BY clip_id, s, w").fetchall():
        said.setdefault(c, []).append((w, s, e))
    placed, words, jumps = [], [], []
    for c, lang in langs.items():
        kept = [o for o in said.get(c, []) if plain.fold(o[0])]
        matched, lost, resyncs = plain.match([t for t, _, _ in page[c]], said.get(c, []), lang)
        placed += [(c, j, lang, *page[c][j], kept[i][0], s, e) for i, j, _, s, e, _ in matched]
        gone = set(lost)
        words += [(c, lang, None if i in gone else 0, w, s, e) for i, (w, s, e) in enumerate(kept)] + [(c, lang, 0, *o) for o in said.get(c, []) if not plain.fold(o[0])]
        jumps += [(c, *r[:4], list(r[4])) for r in resyncs]
    table = lambda rows, names: pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})
    con.register("placed_m1", table(placed, ["clip_id", "disp_idx", "lang", "text", "cs", "ce", "w", "s", "e"]))
    con.register("obs_m1", table(words, ["clip_id", "lang", "disp_idx", "w", "s", "e"]))
    con.register("jumps", table(jumps, ["clip_id", "at_observed", "from_disp", "to_disp", "skipped", "anchor"]))
    return con


def on_matched(sql):
    sql = re.sub(r"placed AS \(SELECT d\.clip_id.*?\)\n", "placed AS (SELECT * FROM placed_m1)\n", sql)
    return re.sub(r"obs AS \(SELECT \* FROM timed.*?\),\n", "obs AS (SELECT * FROM obs_m1),\n", sql)


@pytest.mark.parametrize("name, base", [("w1_matched_drift", "w1_local_drift"), ("w3_matched_bound", "w3_drift_bound"), ("a1_matched_scores", "a1_clip_scores"), ("a3_matched_coverage", "a3_character_coverage"), ("a6_matched_thirds", "a6_thirds"), ("a7_matched_causes", "a7_causes")])
def test_matched(spark, sf, con, name, base):
    sql = on_matched(own.SQL[base])
    assert sql.count("_m1") == 2
    assert oracle.compare(spark, con, sf, own.QUERIES[name], sql)


def test_gaps_have_both_halves(spark, sf, con):
    halves = f"""SELECT clip_id, 'display_skipped' AS reason, char_start, char_end, words, NULL::DOUBLE AS s, NULL::DOUBLE AS e FROM ({on_matched(own.SQL['m6_align_gaps'])})
      UNION ALL SELECT clip_id, 'observed_unmatched', NULL, NULL, 1, s, e FROM obs_m1 WHERE disp_idx IS NULL"""
    assert oracle.compare(spark, con, sf, own.QUERIES["m6_matched_gaps"], halves)


def test_resyncs(spark, sf, con):
    assert oracle.compare(spark, con, sf, own.QUERIES["m1_resyncs"], "SELECT * FROM jumps")


def test_probe_counts(spark, sf):
    rows = {r.lang: r for r in own.QUERIES["a37_respelling"](spark, sf).collect()}
    assert all(r.absent >= r.absent_respelled for r in rows.values()) and rows["fr"].recovered_pp == 0
