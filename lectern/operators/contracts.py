"""The match contract and what is measured against a known truth."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.spoken import normalized
from lectern.functions.text import at_least, at_most, digits, fold
from lectern.operators.align import confidences, some_clips
from lectern.operators.drift import BOUND_MS, bound_violations, character_coverage, characters, covered_pct, local_drift, monotone_violations
from lectern.operators.matcher import each_clip, placed_rows, words_of

FLOOR_PCT = 95.0


def confidence_collapse(rows: DataFrame) -> DataFrame:
    """clip_id, rows of clips of two rows and more whose recogniser confidences are all there and all equal to the match confidences."""
    same = F.bool_and(F.coalesce(F.col("asr_conf") == F.col("match_conf"), F.lit(False)))
    return rows.groupBy("clip_id").agg(F.count("*").alias("rows"), same.alias("same")).where("rows >= 2 and same").select("clip_id", "rows")


def coverage_floor(display: DataFrame, placed: DataFrame, floor: float = FLOOR_PCT) -> DataFrame:
    """Clips whose placed characters stay below the floor."""
    return character_coverage(display, placed).where(F.col("covered_pct") < floor)


def contract_violations(display: DataFrame, placed: DataFrame, bound: float = BOUND_MS, floor: float = FLOOR_PCT) -> DataFrame:
    """clip_id, invariant, at: all violations of order, drift bound, coverage and separate confidences, tagged."""
    one = lambda df, name, at: df.select("clip_id", F.lit(name).alias("invariant"), at.cast("int").alias("at"))
    none = F.lit(None)
    return (
        one(monotone_violations(placed), "monotone", F.col("disp_idx")).unionByName(one(bound_violations(placed, bound), "drift_bound", F.col("disp_idx")))
        .unionByName(one(coverage_floor(display, placed, floor), "coverage_floor", none)).unionByName(one(confidence_collapse(placed), "confidence_collapse", none))
    )


def row_violations(clip_rows: DataFrame, asr_conf: Column, bound: float = BOUND_MS, floor: float = FLOOR_PCT) -> DataFrame:
    """contract_violations() of rows of matcher.followed(), in one pass over the placements; asr_conf may read match_conf."""
    rows = placed_rows(clip_rows.withColumn("chars", characters(F.col("page"))), "chars").transform(confidences)
    rows = local_drift(rows.withColumn("asr_conf", asr_conf))
    there, at = F.col("disp_idx").isNotNull(), F.col("disp_idx").cast("int")
    each = rows.groupBy("clip_id").agg(
        F.collect_list(F.when(F.col("cs") < F.col("cs_before"), at)).alias("early"), F.collect_list(F.when(F.col("drift_ms") > bound, at)).alias("far"), F.first("chars").alias("chars"),
        F.sum(F.greatest(F.col("ce") - F.col("cs"), F.lit(0))).alias("got"), F.count_if(there).alias("n"), F.bool_and(F.coalesce(F.col("asr_conf") == F.col("match_conf"), F.lit(False))).alias("same"),
    )
    named = lambda name: lambda x: F.struct(F.lit(name).alias("invariant"), x.alias("at"))
    whole = lambda bad: F.when(bad, F.array(F.lit(None).cast("int"))).otherwise(F.array().cast("array<int>"))
    low = whole(covered_pct(F.col("chars"), F.col("got")) < floor)
    every = [("monotone", F.col("early")), ("drift_bound", F.col("far")), ("coverage_floor", low), ("confidence_collapse", whole((F.col("n") >= 2) & F.col("same")))]
    return each.select("clip_id", F.inline(F.concat(*[F.transform(x, named(name)) for name, x in every])))


def signed_drift(placed: DataFrame) -> DataFrame:
    """placed with the contract drift and its sign: positive where a start is late."""
    w = Window.partitionBy("clip_id").orderBy("disp_idx")
    lag, lead = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    want = lag("s") + (F.col("cs") - lag("cs")) / (lead("cs") - lag("cs")) * (lead("s") - lag("s"))
    return local_drift(placed).withColumn("signed_ms", F.when(F.col("drift_ms").isNotNull(), (F.col("s") - want) * 1000)).where("drift_ms is not null")


def sign_summary(placed: DataFrame, bound: float) -> DataFrame:
    """For each language: mean signed drift, and failures that are early or late."""
    d = F.col("signed_ms")
    return signed_drift(placed).groupBy("lang").agg(F.count("*").alias("rows"), F.round(F.avg("signed_ms"), 4).alias("mean_ms"), F.count_if(~at_least(d, -bound, 4)).alias("early"), F.count_if(~at_most(d, bound, 4)).alias("late"))


def sentence_interior(placed: DataFrame, bound: float) -> DataFrame:
    """In-bound placements inside sentences and at their ends, and of both (null)."""
    w = Window.partitionBy("clip_id").orderBy("disp_idx")
    ends = F.coalesce(F.lag("text").over(w).rlike("[.!?]$") | F.col("text").rlike("[.!?]$"), F.lit(False))
    rows = local_drift(placed).withColumn("at_end", ends).where("drift_ms is not null")
    return rows.rollup("at_end").agg(F.count("*").alias("rows"), F.count_if(F.round("drift_ms", 4) <= bound).alias("in_bound"))


def split_unmatched(unmatched: DataFrame, display: DataFrame) -> DataFrame:
    """unmatched words (clip_id, w) with their cause: a word that the page has, as a fold, as digits or as a spoken form of one word, was missed by the matcher; any other was invented by the engine."""
    named = display if "lang" in display.columns else display.withColumn("lang", F.lit("en"))
    single = F.transform(F.filter("more", lambda x: F.size(x) == 1), lambda x: x[0])
    forms = F.concat(F.array("f", "n"), F.coalesce(single, F.array().cast("array<string>")))
    known = normalized(named, "text", "lang").select("clip_id", forms.alias("forms")).groupBy("clip_id").agg(F.flatten(F.collect_list("forms")).alias("known"))
    own = [c for c in unmatched.columns if c != "clip_id"]
    lost = unmatched.select("clip_id", F.struct(*own, fold(F.col("w")).alias("form"), digits(F.col("w")).alias("number")).alias("x")).groupBy("clip_id").agg(F.collect_list("x").alias("lost"))
    # Both sides meet in the clip's row: texts dealt by clip move no tokens.
    both = lost.join(known, "clip_id", "left").withColumn("there", F.arrow_udf(_known, "array<boolean>")("known", "lost.form", "lost.number"))
    cause = lambda x, there: F.struct(*[x[c].alias(c) for c in own], F.when(there, "matcher_miss").otherwise("engine_invention").alias("cause"))
    return both.select("clip_id", F.inline(F.zip_with("lost", "there", cause)))


def _known(known: pa.Array, form: pa.Array, number: pa.Array) -> pa.Array:
    """Of each clip's words whether its page has the form or the number."""
    out = []
    for page, forms, numbers in some_clips(known, form, number):
        there = {*(page or ())} - {""}
        out.append([f in there or n in there for f, n in zip(forms, numbers, strict=True)])
    return pa.array(out, pa.list_(pa.bool_()))


def _causes(page: pa.Array, said: pa.Array, matched: pa.Array) -> pa.Array:
    """Of each clip's words without a place (w, cause), as split_unmatched() finds it."""
    words, causes, ends = [], [], [0]
    kinds, index = (matched.flatten().field(c) for c in ("kind", "obs_idx"))
    at = 0
    for (_, shown, heard), n in zip(each_clip(page, said), matched.value_lengths().to_pylist(), strict=True):
        lost = [i for k, i in zip(kinds.slice(at, n).to_pylist(), index.slice(at, n).to_pylist(), strict=True) if k == "unmatched"]
        at += n
        if lost:
            known = {*shown.column("f").to_pylist(), *shown.column("n").to_pylist()} | {x[0] for forms in shown.column("more").drop_null().to_pylist() for x in forms if len(x) == 1}
            every = words_of(heard)
            known.discard("")
            words += [every[i].w for i in lost]
            causes += ["matcher_miss" if every[i].fold in known or every[i].digits in known else "engine_invention" for i in lost]
        ends.append(len(words))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(causes, pa.string())], names=["w", "cause"]))


def row_causes(clip_rows: DataFrame) -> DataFrame:
    """clip_id, w and cause of each word without a place, from rows of matcher.followed(); page and words meet in the clip's row."""
    return clip_rows.select("clip_id", F.inline(F.arrow_udf(_causes, "array<struct<w:string,cause:string>>")("page", "said", "matched")))


def split_rates(observed: DataFrame, causes: DataFrame) -> DataFrame:
    """For each language: shares of all words that the engine invented and that the matcher missed, and whether each is within its bar (2 and 0 percent)."""
    total = observed.groupBy("lang").agg(F.count("*").alias("words"))
    bad = causes.groupBy("lang").agg(F.count_if(F.col("cause") == "engine_invention").alias("invented"), F.count_if(F.col("cause") == "matcher_miss").alias("missed"))
    both = total.join(bad, "lang", "left").na.fill(0, ["invented", "missed"])
    pct = lambda c: F.round(100.0 * F.col(c) / F.col("words"), 4)
    return both.select("lang", "words", "invented", "missed", pct("invented").alias("invented_pct"), pct("missed").alias("missed_pct"), (pct("invented") <= 2.0).alias("engine_ok"), (pct("missed") <= 0.0).alias("matcher_ok"))


def last_placement(matched: DataFrame, order: str) -> DataFrame:
    """Of each display token the placement that comes last."""
    return matched.groupBy("clip_id", "disp_idx").agg(F.max_by(F.struct("s", "e"), order).alias("x")).select("clip_id", "disp_idx", "x.*")


def owner_spans(parts: DataFrame) -> DataFrame:
    """parts (clip_id, disp_idx, s, e) of expanded tokens back to one span a display token: first start to last end, and how many parts."""
    return parts.groupBy("clip_id", "disp_idx").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("parts"))


def row_span(parts: Column) -> Column:
    """owner_spans() of one token's array of parts (s, e)."""
    return F.struct(F.array_min(parts["s"]).alias("s"), F.array_max(parts["e"]).alias("e"), F.size(parts).cast("long").alias("parts"))


def truth_deltas(placed: DataFrame, truth: DataFrame) -> DataFrame:
    """placed with delta_ms against the true starts (clip_id, disp_idx, true_s)."""
    return deltas_of(placed.join(truth, ["clip_id", "disp_idx"]))


def deltas_of(rows: DataFrame) -> DataFrame:
    """rows (s, true_s) with delta_ms, for placements that know their true start."""
    return rows.withColumn("delta_ms", F.round((F.col("s") - F.col("true_s")) * 1000, 4))


def truth_scores(deltas: DataFrame, display: DataFrame, bound: float) -> DataFrame:
    """For each clip: median signed difference, in-bound share of all display words as they are, and once the median is taken off every word."""
    mid = deltas.groupBy("clip_id").agg(F.round(F.median("delta_ms"), 4).alias("median_ms"))
    total = display.groupBy("clip_id").agg(F.count("*").alias("tokens"))
    off = deltas.join(mid, "clip_id")
    agg = off.groupBy("clip_id", "median_ms").agg(F.count_if(F.abs("delta_ms") <= bound).alias("plain"), F.count_if(F.abs(F.round(F.col("delta_ms") - F.col("median_ms"), 3)) <= bound).alias("shifted"))
    pct = lambda c: F.round(100.0 * F.col(c) / F.col("tokens"), 4)
    return agg.join(total, "clip_id").select("clip_id", "median_ms", pct("plain").alias("in_bound_pct"), pct("shifted").alias("offset_free_pct"))


def silence_tolerant(placed: DataFrame, truth: DataFrame, bound: float) -> DataFrame:
    """For each language: placements by where the start falls against the silence before the true word, and in-bound ones if no drift counts within that silence."""
    w = Window.partitionBy("clip_id").orderBy("disp_idx")
    t = truth.withColumn("before", F.coalesce(F.lag("true_e").over(w), F.lit(0.0)))
    ms = lambda a, b: F.round((a - b) * 1000, 4)
    rows = placed.join(t, ["clip_id", "disp_idx"])
    s, start, before = F.col("s"), F.col("true_s"), F.col("before")
    drift = F.when(s >= start, ms(s, start)).when(s >= before, F.lit(0.0)).otherwise(ms(before, s))
    return rows.groupBy("lang").agg(F.count_if(s >= start).alias("at_or_after"), F.count_if((s < start) & (s >= before)).alias("in_silence"), F.count_if(s < before).alias("before_previous_end"), F.count_if(drift <= bound).alias("in_bound"))


def cursor_check(rows: DataFrame, gap: Column) -> DataFrame:
    """Rows that don't begin where the one before ended plus its gap, or last over six times the clip's median."""
    w = Window.partitionBy("clip_id").orderBy("disp_idx")
    size = F.round(F.col("e") - F.col("s"), 6)
    mid = rows.groupBy("clip_id").agg(F.median(size).alias("mid"))
    at = F.round(F.lag("e").over(w) + gap, 6)
    flagged = rows.join(mid, "clip_id").withColumn("want", at).withColumn("fault", F.when(F.round("s", 6) != F.col("want"), "cursor").when(size > 6 * F.col("mid"), "long"))
    return flagged.where("fault is not null").select("clip_id", "disp_idx", "fault")


def perturb(observed: DataFrame, every: int, shift_s: float, keep: int, gap: tuple[int, int]) -> DataFrame:
    """observed words with every n-th start moved, all from index keep on cut off, and those of a middle run left out."""
    moved = F.when(F.col("obs_idx") % every == 0, F.col("s") + shift_s).otherwise(F.col("s"))
    return observed.where((F.col("obs_idx") < keep) & ~F.col("obs_idx").between(*gap)).withColumn("s", moved)
