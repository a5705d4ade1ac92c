"""Queries of cuts into regions, corruptions and their gate, recall by kind, and folds of decomposed text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.operators import corrupt, layout, regions
from lectern.plans.folders import stored
from lectern.queries import FOLD, _display, query
from lectern.queries_tables import BOXES


def _boxes(spark, sf):
    return stored(layout.boxes(_display(spark, sf)), "boxes")


@query()
def t3_recursive_cuts(spark, sf):
    """Reading order of all pages by recursive cuts; tested against plain recursion."""
    return regions.recursive_cuts(_boxes(spark, sf)).select("page_id", "seq", "path", "place")


@query()
def t3_cut_stats(spark, sf):
    return regions.cut_stats(regions.recursive_cuts(_boxes(spark, sf)))


def _corrupted(spark, sf):
    body = stored(corrupt.of_page(_boxes(spark, sf)), "body")
    idx = F.explode(F.array(*[F.struct(F.lit(k).alias("idx"), F.lit(x).alias("text")) for k, x in enumerate(("Quarterly", "217", "S4"))]))
    furniture = body.select("page_id").distinct().select("page_id", idx.alias("x")).select("page_id", "x.*")
    return body, furniture


@query()
def q12_corruptions(spark, sf):
    """For each corruption: pages, tokens, and tokens that stand elsewhere or are no longer the page's."""
    rows = corrupt.corrupt(*_corrupted(spark, sf))
    return rows.groupBy("mutation").agg(F.count_distinct("page_id").alias("pages"), F.count("*").alias("tokens"), F.count_if(F.col("seq") != F.col("place")).alias("moved"), F.count_if(F.col("seq").isNull()).alias("altered"))


@query()
def q13_mutation_gate(spark, sf):
    body, furniture = _corrupted(spark, sf)
    # The gate reads scores twice, a row for each page and corruption.
    gate = corrupt.mutation_gate(stored(corrupt.packed_scores(body, furniture), "scores"))
    return gate.select("page_id", "mutation", "n", *[F.round(c, 6).alias(c) for c in ("order", "adjacency", "recall")], "furniture_inline", "verdict", "status", "detail", "held")


@query(BOXES + f""", tr AS (SELECT page_id, seq, text, {FOLD.format('text')} AS st, strip_accents(text) <> text AS ac FROM box), ou AS (SELECT page_id, seq, CASE WHEN seq % 11 = 3 THEN {FOLD.format('strip_accents(text)')} ELSE st END AS said, CASE WHEN seq % 19 = 4 THEN 2 ELSE 1 END AS k FROM tr WHERE seq % 13 <> 7),
sp AS (SELECT page_id, said, k, unnest(range(seq, seq + k)) AS seq FROM ou), m AS (SELECT sp.page_id, sp.seq, k, ac AND k = 1 AND said = st AS hit FROM sp JOIN tr ON tr.page_id = sp.page_id AND tr.seq = sp.seq),
g AS (SELECT page_id, count(DISTINCT seq) AS there, count(*) FILTER (k > 1) AS merged, count(*) FILTER (hit) AS hits FROM m GROUP BY 1), a AS (SELECT page_id, count(*) AS tokens, count(*) FILTER (ac) AS accents FROM tr GROUP BY 1)
SELECT page_id, round(coalesce(there, 0) / tokens, 6) AS recall, round(coalesce(merged, 0) / tokens, 6) AS space_loss, CASE WHEN accents > 0 THEN round(coalesce(hits, 0) / accents, 6) END AS accent_recall FROM a LEFT JOIN g USING (page_id)""", True)  # fmt: skip
def a23_recall_by_kind(spark, sf):
    """One token in thirteen is lost, one in nineteen runs into the next, and one in eleven lost its accents."""
    truth = layout.boxes(_display(spark, sf)).select("page_id", "seq", "text")
    s = F.col("seq")
    bare = F.translate("text", t.MARKED, t.BARE)
    out = truth.where(s % 13 != 7).select("page_id", F.when(s % 11 == 3, bare).otherwise(F.col("text")).alias("text"), "seq", F.when(s % 19 == 4, 2).otherwise(1).alias("k"))
    return corrupt.recall_by_kind(out, truth, t.accented(F.col("text")), t.fold(F.col("text")))


# Letters of other alphabets, composed and in parts, which stand for every sixth token.
_LETTERS = ["Łódź", "žluťoučký", "őszi", "Ёлка", "Ελλάς", "ñandú", "élève", "Ạ̊ngström", "Ṩ", "ø", "ǟ", "крӑй"]
_SQL_LETTERS = "[" + ", ".join(f"'{x}'" for x in _LETTERS) + "]"


@query(f", d AS (SELECT DISTINCT lang, CASE WHEN disp_idx % 6 = 0 THEN {_SQL_LETTERS}[(clip_id + disp_idx // 6) % {len(_LETTERS)} + 1] ELSE text END AS token FROM disp), f AS (SELECT lang, token, {FOLD.format('nfc_normalize(token)')} AS fold FROM d) SELECT lang, token, fold, strip_accents(fold) AS loose FROM f", True)
def f1_composed_folds(spark, sf):
    """Folds of any letter, with marks as parts of it or after it; loose folds by Unicode's decompositions."""
    word = F.array(*map(F.lit, _LETTERS))[((F.col("clip_id") + F.floor(F.col("disp_idx") / 6)) % len(_LETTERS)).cast("int")]
    rows = _display(spark, sf).select("lang", F.when(F.col("disp_idx") % 6 == 0, word).otherwise(F.col("text")).alias("token")).distinct()
    folded = t.composed(rows.withColumn("whole", F.col("token")), "whole").withColumn("fold", t.fold(F.col("whole")))
    return folded.select("lang", "token", "fold", t.loose(F.col("fold")).alias("loose"))
