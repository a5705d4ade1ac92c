"""Timing drift of placements between their neighbours, and clip scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import at_most

BOUND_MS = 250.0


def _clip() -> Window:
    return Window.partitionBy("clip_id").orderBy("disp_idx")


def _near(placed: DataFrame) -> tuple[Callable[[str], Column], Callable[[str], Column]]:
    """lag and lead over a clip's placements; placements that bring their neighbours, as those of matcher.placed_rows(), need no window."""
    if {"before", "after"} <= set(placed.columns):
        return (lambda c: F.col(f"before.{c}")), (lambda c: F.col(f"after.{c}"))
    return (lambda c: F.lag(c).over(_clip())), (lambda c: F.lead(c).over(_clip()))


def local_drift(placed: DataFrame, mode: str = "contract") -> DataFrame:
    """placed with drift_ms: how far a start lies from where its neighbours' character offsets put it.

    contract: null without neighbours or a positive span; harness: spans are at least one character and a microsecond.
    """
    lag, lead = _near(placed)
    chars, time = lead("cs") - lag("cs"), lead("s") - lag("s")
    if mode == "harness":
        chars, time = F.greatest(chars, F.lit(1)), F.greatest(time, F.lit(1e-6))
    want = lag("s") + (F.col("cs") - lag("cs")) / chars * time
    ok = lag("s").isNotNull() & lead("s").isNotNull() & (chars > 0) & (time > 0)
    return placed.withColumn("drift_ms", F.when(ok, F.abs(F.col("s") - want) * 1000))


def floor_quantile(values: Column, q: float) -> Column:
    """The value at index floor(q * (n - 1)) of a group's sorted values, nulls left out."""
    return F.element_at(F.sort_array(F.collect_list(values)), (F.floor(F.lit(q) * (F.count(values) - 1)) + 1).cast("int"))


def clip_scores(display: DataFrame, placed: DataFrame, observed: DataFrame, unmatched: DataFrame | None = None) -> DataFrame:
    """A row for each clip: in-bound share of all display tokens, match rate, unmatched share of words, and drift quantiles.

    Words count as unmatched if they are rows of unmatched; without it, if observed knows no display index for them.
    """
    total = display.groupBy("clip_id").agg(F.count("*").alias("tokens"))
    if unmatched is None:
        words = observed.groupBy("clip_id").agg(F.count("*").alias("words"), F.count_if(F.col("disp_idx").isNull()).alias("invented"))
    else:
        words = observed.groupBy("clip_id").agg(F.count("*").alias("words")).join(unmatched.groupBy("clip_id").agg(F.count("*").alias("invented")), "clip_id", "left")
    d = local_drift(placed, "harness").groupBy("clip_id").agg(
        F.count("*").alias("placed"), F.count_if(F.col("drift_ms") <= BOUND_MS).alias("in_bound"),
        F.when(F.count("drift_ms") > 0, F.round(floor_quantile(F.col("drift_ms"), 0.95), 6)).alias("p95_ms"), F.round(F.median("drift_ms"), 6).alias("median_ms"),
    )
    pct = lambda a, b: F.round(100.0 * F.coalesce(a, F.lit(0)) / b, 4)
    return total.join(words, "clip_id", "left").join(d, "clip_id", "left").select("clip_id", "tokens", pct(F.col("in_bound"), F.col("tokens")).alias("within_pct"), pct(F.col("placed"), F.col("tokens")).alias("match_pct"), pct(F.col("invented"), F.col("words")).alias("invented_pct"), "median_ms", "p95_ms")


def monotone_violations(placed: DataFrame) -> DataFrame:
    """Placements that begin before the one before them in time."""
    before = F.lag("cs").over(Window.partitionBy("clip_id").orderBy("s", "disp_idx"))
    return placed.withColumn("before", before).where("cs < before").select("clip_id", "disp_idx", "cs", "before")


def bound_violations(placed: DataFrame, bound: float = BOUND_MS) -> DataFrame:
    return local_drift(placed).where(F.col("drift_ms") > bound).select("clip_id", "disp_idx", F.round("drift_ms", 4).alias("drift_ms"))


def worst(placed: DataFrame, k: int = 15) -> DataFrame:
    """The k largest drifts of each language."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.round("drift_ms", 4).desc(), "clip_id", "disp_idx"))
    return local_drift(placed).where("drift_ms is not null").withColumn("rank", rank).where(F.col("rank") <= k).select("lang", "rank", "clip_id", "disp_idx", F.round("drift_ms", 4).alias("drift_ms"))


def character_coverage(display: DataFrame, placed: DataFrame) -> DataFrame:
    """clip_id, covered_pct: characters of distinct placed ranges against those of the page, at most 100."""
    chars = display.groupBy("clip_id").agg(F.sum(F.col("ce") - F.col("cs")).alias("chars"))
    got = placed.dropDuplicates(["clip_id", "cs", "ce"]).groupBy("clip_id").agg(F.sum(F.greatest(F.col("ce") - F.col("cs"), F.lit(0))).alias("got"))
    return chars.join(got, "clip_id", "left").select("clip_id", covered_pct(F.col("chars"), F.col("got")).alias("covered_pct"))


def covered_pct(chars: Column, got: Column) -> Column:
    return F.round(F.when(chars > 0, F.least(100.0 * F.coalesce(got, F.lit(0)) / chars, F.lit(100.0))).otherwise(0.0), 4)


def characters(tokens: Column) -> Column:
    """Characters of an array of tokens (cs, ce)."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda n, x: n + (x["ce"] - x["cs"]))


def row_coverage(clip_rows: DataFrame) -> DataFrame:
    """character_coverage() of rows of matcher.followed(): a token is placed once, and its range is no other's."""
    got = characters(F.filter("matched", lambda x: (x["kind"] == "match") & (x["ce"] > x["cs"])))
    return clip_rows.select("clip_id", covered_pct(characters(F.col("page")), got).alias("covered_pct"))


def causes(placed: DataFrame, pause_ms: float = 150.0) -> DataFrame:
    """primary_cause, rows, failing, and the share of failing and of passing placements that show the condition, whatever their first cause.

    A placement goes to the first neighbourhood flag that holds; for "none" the shares are those without any.
    """
    lag, lead = _near(placed)
    flags = [
        ("sentence_end", lag("text").rlike("[.!?]$") | F.col("text").rlike("[.!?]$")),
        ("skipped_token", (F.col("disp_idx") - lag("disp_idx") > 1) | (lead("disp_idx") - F.col("disp_idx") > 1)),
        ("pause", ((F.col("s") - lag("e")) * 1000 > pause_ms) | ((lead("s") - F.col("e")) * 1000 > pause_ms)),
    ]
    names = [n for n, _ in flags] + ["none"]
    rows = local_drift(placed).withColumns({f"is_{n}": F.coalesce(c, F.lit(False)) for n, c in flags}).where("drift_ms is not null")
    rows = rows.withColumn("is_none", ~(F.col("is_sentence_end") | F.col("is_skipped_token") | F.col("is_pause"))).withColumn("bad", F.col("drift_ms") > BOUND_MS)
    rows = rows.withColumn("cause", F.coalesce(*[F.when(F.col(f"is_{n}"), F.lit(n)) for n in names]))
    one = rows.agg(
        F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"),
        F.array(*[F.struct(
            F.lit(n).alias("primary_cause"), F.count_if(F.col("cause") == n).alias("rows"), F.count_if((F.col("cause") == n) & F.col("bad")).alias("failing"),
            F.count_if(F.col(f"is_{n}") & F.col("bad")).alias("in_bad"), F.count_if(F.col(f"is_{n}") & ~F.col("bad")).alias("in_good"),
        ) for n in names]).alias("x"),
    )
    pct = lambda k, n: F.when(F.col(n) > 0, F.round(100.0 * F.col(k) / F.col(n), 4)).otherwise(0.0)
    return one.select("bad", "good", F.explode("x").alias("x")).select("bad", "good", "x.*").where("rows > 0 or in_bad + in_good > 0").select("primary_cause", "rows", "failing", pct("in_bad", "bad").alias("failing_with_pct"), pct("in_good", "good").alias("passing_with_pct"))


def thirds(display: DataFrame, placed: DataFrame) -> DataFrame:
    """clip_id, head, tail, ratio, last_matched, desynced: coverage of the first and last third, and the last placed token; a tail under half the head tells a lost track."""
    n = display.groupBy("clip_id").agg(F.count("*").alias("n"))
    both = n.withColumn("third", F.greatest(F.floor(F.col("n") / 3), F.lit(1))).join(placed.select("clip_id", "disp_idx"), "clip_id", "left")
    agg = both.groupBy("clip_id", "third").agg(F.count_if(F.col("disp_idx") < F.col("third")).alias("h"), F.count_if(F.col("disp_idx") >= F.col("n") - F.col("third")).alias("t"), F.max("disp_idx").alias("last_matched"))
    head, tail = F.col("h") / F.col("third"), F.col("t") / F.col("third")
    ratio = F.when(F.col("h") > 0, F.round(F.col("t") / F.col("h"), 6))
    return agg.select("clip_id", F.round(head, 6).alias("head"), F.round(tail, 6).alias("tail"), ratio.alias("ratio"), "last_matched", ((F.col("h") > 0) & (tail < 0.5 * head)).alias("desynced"))


def offset_sweep(placed: DataFrame, step: int = 25, most: int = 250) -> DataFrame:
    """shift_ms, within: in-bound placements with all starts moved; the local drift doesn't move with them."""
    w = _clip()
    rows = placed.select(*[f(c).over(w).alias(f"{c}{k}") for k, f in ((0, F.lag), (2, F.lead)) for c in ("cs", "s")], "cs", "s")

    def within(ms: int) -> Column:
        s0, s, s2 = (F.col(c) + ms / 1000.0 for c in ("s0", "s", "s2"))
        want = s0 + (F.col("cs") - F.col("cs0")) / (F.col("cs2") - F.col("cs0")) * (s2 - s0)
        return F.struct(F.lit(ms).alias("shift_ms"), F.count_if(at_most(F.abs(s - want) * 1000, BOUND_MS, 4)).alias("within"))

    # One row of as many conditional counts as there are shifts; no row is copied.
    counts = rows.agg(F.array(*[within(ms) for ms in range(-most, most + 1, step)]).alias("x"))
    return counts.select(F.explode("x").alias("x")).select("x.*")
