"""Paired statistics over outcomes and engines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import at_least, mcnemar, overlap_pct, wilson
from lectern.plans.folders import stored


def paired_outcomes(rows: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """One row for each value of by: discordant counts of two 0/1 outcomes, their exact McNemar p, and the Wilson interval of each rate."""
    agg = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(a).alias("ka"), F.sum(b).alias("kb"), F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("b"), F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("c"))
    wa, wb = wilson(F.col("ka"), F.col("n")), wilson(F.col("kb"), F.col("n"))
    return agg.select(by, "n", "b", "c", F.round(mcnemar(F.col("b"), F.col("c")), 9).alias("p"), wa["low"].alias("a_low"), wa["high"].alias("a_high"), wb["low"].alias("b_low"), wb["high"].alias("b_high"))


def pair_engines(a: DataFrame, b: DataFrame) -> DataFrame:
    """Placements of two engines on the same display token, with their overlap and start difference."""
    r = b.select("clip_id", "disp_idx", F.col("s").alias("s2"), F.col("e").alias("e2"))
    return compared(a.join(r, ["clip_id", "disp_idx"]))


def compared(pairs: DataFrame) -> DataFrame:
    """pairs (s, e, s2, e2) with overlap and delta_ms, the start difference."""
    return pairs.withColumn("overlap", overlap_pct(F.col("s"), F.col("e"), F.col("s2"), F.col("e2"))).withColumn("delta_ms", (F.col("s2") - F.col("s")) * 1000)


def pair_sheet(pairs: DataFrame, by: str = "lang", worst: int = 3) -> DataFrame:
    """A row for each value of by: overlap and start difference of its pairs, and the display tokens of the least overlaps.

    Overlaps count to a ten-thousandth of a percent and differences to a microsecond, so that a group of any
    size has a bounded number of distinct values and its quantiles come from their counts.
    """
    both = pairs.withColumn("overlap", F.round("overlap", 4)).withColumn("d", F.round("delta_ms", 3)).withColumn("abs_d", F.abs("d"))
    both = stored(both.select(by, "clip_id", "disp_idx", "text", "overlap", "d", "abs_d"), "pairs")  # three ways of summing up read it
    sheet = both.groupBy(by).agg(
        F.count("*").alias("pairs"), F.round(F.median("overlap"), 4).alias("median_overlap"), F.round(100.0 * F.count_if(F.col("overlap") >= 50) / F.count("*"), 4).alias("pct_50"),
        F.round(F.median("d"), 4).alias("median_delta_ms"), F.round(F.median("abs_d"), 4).alias("median_abs_ms"), F.round(100.0 * F.count_if(F.col("d").between(-250, 250)) / F.count("*"), 4).alias("agree_250_pct"),
    )
    # The 95th percentile at index floor(0.95 * (n - 1)): the first value with more pairs up to it than that.
    counts = both.groupBy(by, "abs_d").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(by).orderBy("abs_d"))
    total = F.sum("k").over(Window.partitionBy(by))
    p95 = counts.withColumn("upto", upto).withColumn("n", total).where(F.col("upto") > F.floor(F.lit(0.95) * (F.col("n") - 1))).groupBy(by).agg(F.min("abs_d").alias("p95_abs_ms"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("overlap", "clip_id", "disp_idx"))
    least = both.withColumn("rank", rank).where(F.col("rank") <= worst).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("w"))
    return sheet.join(p95, by).join(least.select(by, F.array_join("w", " ").alias("worst_tokens")), by)


#: The 97.5 % quantile of Student's t for 2 to 12 degrees of freedom.
T_975 = (4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139, 2.200985, 2.178813)
Z_975 = 1.959963984540054


def t_critical(df: Column) -> Column:
    """The 97.5 % quantile of Student's t: listed up to 12 degrees of freedom, beyond by the expansion around the normal quantile in powers of 1 / df."""
    z = Z_975
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
    far = sum((F.lit(c) / F.pow(df, F.lit(float(i + 1))) for i, c in enumerate(terms)), F.lit(z))
    return F.when(df <= 12, F.element_at(F.array(*map(F.lit, T_975)), (df - 1).cast("int"))).otherwise(far)


def two_sided(z: Column) -> Column:
    """The chance of a standard normal value at least as far from 0 as z, to 1.5e-7 (a polynomial times exp(-x * x), x = |z| / sqrt(2))."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    return poly * F.exp(-x * x)


def slope(pairs: DataFrame, by: str = "clip_id") -> DataFrame:
    """Least-squares slope of the start difference over time for each clip of four pairs and more: its standard error and 95 % t interval, Pearson's r (within 0.999999) and the p of its Fisher z."""
    agg = pairs.groupBy(by).agg(F.count("*").alias("n"), F.regr_slope("delta_ms", "s").alias("m"), F.regr_sxx("delta_ms", "s").alias("sxx"), F.regr_syy("delta_ms", "s").alias("syy"), F.regr_sxy("delta_ms", "s").alias("sxy"))
    rest = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    fit = agg.where("n >= 4 and sxx > 0 and syy > 0").withColumn("se", F.sqrt(rest / (F.col("n") - 2) / F.col("sxx")))
    fit = fit.withColumn("r", F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")))))
    z = F.lit(0.5) * F.log((1 + F.col("r")) / (1 - F.col("r"))) * F.sqrt(F.col("n") - 3)
    half = t_critical(F.col("n") - 2) * F.col("se")
    return fit.select(by, "n", F.round("m", 5).alias("slope"), F.round("se", 5).alias("slope_se"), F.round(F.col("m") - half, 4).alias("slope_low"), F.round(F.col("m") + half, 4).alias("slope_high"), F.round("r", 5).alias("r"), F.round(two_sided(z), 5).alias("p"))


def calibrate(pairs: DataFrame, shifts: list[int], scales: list[float]) -> DataFrame:
    """lang, shift_ms, scale of the best grid cell: most pairs at half overlap, then the smaller shift and scale."""
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("shift_ms"), F.lit(b).alias("scale")) for a in shifts for b in scales])).alias("g")
    moved = pairs.select("lang", "s", "e", "s2", "e2", grid).select("lang", "g.*", (F.col("s") + F.col("g.shift_ms") / 1000.0).alias("a"), ((F.col("e") - F.col("s")) * F.col("g.scale")).alias("d"), "s2", "e2")
    ok = F.count_if(at_least(overlap_pct(F.col("a"), F.col("a") + F.col("d"), F.col("s2"), F.col("e2")), 50, 6))
    cells = moved.groupBy("lang", "shift_ms", "scale").agg(ok.alias("hits"))
    best = F.max_by(F.struct("shift_ms", "scale", "hits"), F.struct("hits", -F.col("shift_ms"), -F.col("scale")))
    return cells.groupBy("lang").agg(best.alias("x")).select("lang", "x.*")


#: The grid of a calibration: shifts in milliseconds, evenly spaced, and scales of a word's length.
SHIFTS_MS, SCALES = list(range(0, 261, 10)), [x / 100 for x in range(90, 156, 5)]


def grid_hits(pairs: DataFrame, shifts: list[int] = SHIFTS_MS, scales: list[float] = SCALES) -> DataFrame:
    """lang, shift_ms, scale, hits: for each cell the pairs (lang, s, e, s2, e2) that overlap by half once the first interval is moved and stretched.

    For one scale, two intervals of lengths d and l overlap by half on a stretch of shifts, where they share a third of d + l. So
    a pair adds one at the stretch's first shift and takes one away behind its last; no pair is copied, and a task sends a row a cell.
    """
    first, step, n = shifts[0], (shifts[1] - shifts[0]) if len(shifts) > 1 else 1, len(shifts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            s, e, s2, e2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("s", "e", "s2", "e2"))
            code = lang.indices.to_numpy()
            for k, name in enumerate(lang.dictionary.to_pylist()):
                change = held.setdefault(name, np.zeros((len(scales), n + 1), dtype=np.int64))
                mine = code == k
                for j, scale in enumerate(scales):
                    d, other = (e[mine] - s[mine]) * scale, e2[mine] - s2[mine]
                    third = (d + other) / 3
                    low = np.ceil(((s2[mine] + third - d - s[mine]) * 1000 - first) / step - 1e-6)
                    high = np.floor(((e2[mine] - third - s[mine]) * 1000 - first) / step + 1e-6)
                    low, high = np.maximum(low, 0), np.minimum(high, n - 1)
                    ok = (third > 0) & (d >= third - 1e-9) & (other >= third - 1e-9) & (low <= high)
                    np.add.at(change[j], low[ok].astype(np.int64), 1)
                    np.add.at(change[j], high[ok].astype(np.int64) + 1, -1)
        rows = [(name, a, b, int(h)) for name, change in held.items() for b, line in zip(scales, np.cumsum(change[:, :-1], axis=1), strict=True) for a, h in zip(shifts, line, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.float64(), pa.int64()))], names=["lang", "shift_ms", "scale", "hits"])

    some = pairs.select("lang", "s", "e", "s2", "e2").na.drop()
    return some.mapInArrow(count, "lang string, shift_ms int, scale double, hits long").groupBy("lang", "shift_ms", "scale").agg(F.sum("hits").alias("hits"))


def _moved(shift_ms: Column, scale: Column) -> Column:
    a = F.col("s") + shift_ms / 1000.0
    return F.round(overlap_pct(a, a + (F.col("e") - F.col("s")) * scale, F.col("s2"), F.col("e2")), 6)


def fit_grid(pairs: DataFrame, shifts: list[int] = SHIFTS_MS, scales: list[float] = SCALES) -> DataFrame:
    """lang, shift_ms, scale, hits, median_overlap of the best cell: most pairs at half overlap, then the greatest median overlap, then the smaller shift and scale. Medians are taken only where cells tie."""
    cells = grid_hits(pairs, shifts, scales)
    most = F.max("hits").over(Window.partitionBy("lang"))
    tied = cells.withColumn("most", most).where("hits = most").drop("most")  # as many as there are cells at most
    each = pairs.join(F.broadcast(tied), "lang").groupBy("lang", "shift_ms", "scale", "hits").agg(F.round(F.median(_moved(F.col("shift_ms"), F.col("scale"))), 4).alias("median_overlap"))
    best = F.max_by(F.struct("shift_ms", "scale", "hits", "median_overlap"), F.struct("median_overlap", -F.col("shift_ms"), -F.col("scale")))
    return each.groupBy("lang").agg(best.alias("x")).select("lang", "x.*")


def calibration_holdout(fit: DataFrame, holdout: DataFrame, bar: float = 95.0) -> DataFrame:
    """A row for each language of holdout pairs (lang, voice, s, e, s2, e2): the cell fitted on other pairs, overlap with and without it, and whether the voice changed too.

    Where fit and holdout differ in voice, a fall of the score can't be laid to the text alone: the row is marked as confounded.
    """
    voices = lambda df, name: df.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("voice")), ",").alias(name))
    cell = fit_grid(fit).select("lang", "shift_ms", "scale")
    pct = lambda x: F.round(100.0 * F.count_if(x >= 50) / F.count("*"), 4)
    on = holdout.join(F.broadcast(cell), "lang")
    plain, moved = _moved(F.lit(0), F.lit(1.0)), _moved(F.col("shift_ms"), F.col("scale"))
    scored = on.groupBy("lang", "shift_ms", "scale").agg(F.count("*").alias("words"), pct(plain).alias("uncalibrated_pct"), pct(moved).alias("calibrated_pct"), F.round(F.median(moved), 4).alias("median_overlap"))
    both = scored.join(voices(fit, "fit_voice"), "lang").join(voices(holdout, "holdout_voice"), "lang")
    return both.withColumn("passes", F.col("calibrated_pct") >= bar).withColumn("voice_confounded", F.col("fit_voice") != F.col("holdout_voice"))
