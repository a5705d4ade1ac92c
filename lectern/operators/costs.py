"""Costs of runs, statistics of samples, comparisons of voices, and intervals of paired outcomes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import wilson

Z, POWER = 1.959963985, 0.8416212336


def cost_block(runs: DataFrame, usd_per_hour: float) -> DataFrame:
    """runs (run_id, cpu_s, load_s, audio_s) with CPU seconds a second of audio, real-time factors with and without loading, and USD an hour of audio."""
    ratio = F.when(F.col("audio_s") > 0, F.col("cpu_s") / F.col("audio_s"))
    return runs.select(
        "run_id", F.round(ratio, 6).alias("cpu_per_audio"), F.round(F.when(F.col("audio_s") > 0, (F.col("cpu_s") + F.col("load_s")) / F.col("audio_s")), 6).alias("rtf_with_load"),
        F.round(F.when(F.col("cpu_s") > 0, F.col("audio_s") / F.col("cpu_s")), 6).alias("speed"), F.round(ratio * usd_per_hour, 6).alias("usd_per_audio_hour"),
    )


def pipeline_cost(runs: DataFrame, refuse: float = 0.25) -> DataFrame:
    """For each group the run of the best thread efficiency (then the smallest id): alignment against recognition, the multiplier, and whether starting up takes so much that its figures are refused."""
    best = F.max_by(F.struct("run_id", "efficiency", "align_s", "asr_s", "startup_s"), F.struct("efficiency", -F.col("run_id")))
    one = runs.groupBy("grp").agg(best.alias("x")).select("grp", "x.*")
    ratio, share = F.col("align_s") / F.col("asr_s"), F.col("startup_s") / (F.col("startup_s") + F.col("align_s") + F.col("asr_s"))
    return one.select("grp", "run_id", F.round(ratio, 6).alias("align_to_asr"), F.round(1 + ratio, 6).alias("multiplier"), F.round(share, 6).alias("startup_share"), (F.round(share, 6) >= refuse).alias("refused"))


def two_windows(samples: DataFrame, steady: Column) -> DataFrame:
    """run, window (whole, steady), n, mean, largest, span of each run's samples, and of those from its steady state on."""
    both = samples.select("run", "value", F.explode(F.when(steady, F.array(F.lit("whole"), F.lit("steady"))).otherwise(F.array(F.lit("whole")))).alias("window"))
    return both.groupBy("run", "window").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("largest"), F.round(F.max("value") - F.min("value"), 6).alias("span"))


def pct_error(estimate: Column, measured: Column) -> Column:
    """Percent by which an estimate misses what was measured; null without either or over nothing."""
    return F.when(measured != 0, F.round(100.0 * (estimate - measured) / measured, 4))


def cost_range(costs: DataFrame, claims: DataFrame, hours: float = 9.0, slack: float = 0.005) -> DataFrame:
    """claims (file, low, high) with the range recomputed from costs (file, usd); a file that has no costs is a failure, never left out."""
    got = costs.groupBy("file").agg(F.round(F.min("usd") * hours, 6).alias("got_low"), F.round(F.max("usd") * hours, 6).alias("got_high"))
    both = claims.join(got, "file", "left")
    near = (F.abs(F.col("low") - F.col("got_low")) <= slack) & (F.abs(F.col("high") - F.col("got_high")) <= slack)
    return both.select("file", "got_low", "got_high", F.when(F.col("got_low").isNull(), "unreadable").when(near, "ok").otherwise("wrong").alias("state"))


def paired_diff(rows: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """by, n, b, c, low, high: interval of the difference of two paired 0/1 outcomes, Wilson on the discordant pairs; none gives [0, 0]."""
    agg = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("b"), F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("c"))
    d = F.col("b") + F.col("c")
    w = wilson(F.col("b"), d, Z)
    side = lambda s: F.when(d == 0, 0.0).otherwise(F.bround((2 * w[s] / 100.0 - 1) * (d / F.col("n")) * 100.0, 1))
    return agg.select(by, "n", "b", "c", side("low").alias("low"), side("high").alias("high"))


def sample_sizes(rates: DataFrame) -> DataFrame:
    """rates (delta_pp, discordance, p1, p2) with the tokens a paired test needs and the group size for two proportions; -1 where no number suffices."""
    d = F.col("delta_pp") / 100.0
    phi = F.when(d >= F.col("discordance"), 1.0).otherwise(0.5 * (1 + d / F.col("discordance")))
    pairs = F.pow((Z * 0.5 + POWER * F.sqrt(phi * (1 - phi))) / (phi - 0.5), 2) / F.col("discordance")
    ok = (F.col("delta_pp") > 0) & (F.col("discordance") > 0)
    mean = (F.col("p1") + F.col("p2")) / 2
    top = Z * F.sqrt(2 * mean * (1 - mean)) + POWER * F.sqrt(F.col("p1") * (1 - F.col("p1")) + F.col("p2") * (1 - F.col("p2")))
    two = F.ceil(F.round(F.pow(top, 2) / F.pow(F.col("p1") - F.col("p2"), 2), 6))
    return rates.withColumn("n_paired", F.when(ok, F.ceil(F.round(pairs, 6))).otherwise(-1).cast("long")).withColumn("n_two", F.when(F.col("p1") == F.col("p2"), -1).otherwise(two).cast("long"))


def block_bootstrap(rows: DataFrame, a: str, b: str, block: str, iters: int = 10_000, seed: int = 20260809) -> DataFrame:
    """n, low, high: interval of the difference of two outcomes in percentage points, whole blocks drawn again.

    Rows become one row a block first. How often a round draws a block is a Poisson(1) number of a generator that counts
    from the seed and the block's hash: the same on any cluster, independent from block to block and from round to
    round, and on average as many blocks as there are. Each task adds its blocks to the sums of all rounds, and only
    those sums, `iters` a task, are brought together. Rounds that draw no block don't count; no rows give no row.
    """
    blocks = rows.groupBy(block).agg(F.count("*").alias("t"), F.sum(F.col(a) - F.col(b)).cast("long").alias("d")).select(F.xxhash64(block).alias("k"), "t", "d")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, d = np.zeros(iters, dtype=np.int64), np.zeros(iters, dtype=np.int64)
        for batch in batches:
            for k, size, diff in zip(*(batch.column(c).to_pylist() for c in ("k", "t", "d")), strict=True):
                times = np.random.Generator(np.random.Philox(key=[seed, k % (1 << 64)])).poisson(1.0, iters)
                t += times * size
                d += times * (diff or 0)
        at = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(t[at]), pa.array(d[at])], names=["i", "t", "d"])

    rounds = blocks.mapInArrow(draw, "i long, t long, d long").groupBy("i").agg((100.0 * F.sum("d") / F.sum("t")).alias("diff"))
    every = rounds.agg(F.array_sort(F.collect_list("diff")).alias("x"))  # one number a round
    pick = lambda q: F.round(F.element_at("x", (F.floor(F.lit(q) * (F.size("x") - 1)) + 1).cast("int")), 4)
    total = rows.agg(F.count("*").alias("n"))
    return total.join(F.broadcast(every.where(F.size("x") > 0))).select("n", pick(0.025).alias("low"), pick(0.975).alias("high"))


def voice_pairs(rates: DataFrame) -> DataFrame:
    """rates (lang, voice, part, pct) in pairs of one language: within a voice (its parts) or between voices. Rates are few: one for each voice and part."""
    side = lambda n: rates.select("lang", *[F.col(c).alias(f"{c}_{n}") for c in ("voice", "part", "pct")])
    first = F.struct("voice_a", "part_a") < F.struct("voice_b", "part_b")
    kind = F.when(F.col("voice_a") == F.col("voice_b"), "within").otherwise("between")
    return side("a").join(side("b"), "lang").where(first).select("lang", kind.alias("kind"), "voice_a", "part_a", "voice_b", "part_b", F.round(F.abs(F.col("pct_a") - F.col("pct_b")), 6).alias("diff"))


def voice_verdict(pairs: DataFrame) -> DataFrame:
    """For each language the noise floor within voices against the largest difference between them."""
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("diff")))
    agg = pairs.groupBy("lang").agg(of("within").alias("floor"), of("between").alias("most"), F.count_if(F.col("kind") == "between").alias("between_pairs"), F.count_if(F.col("kind") == "within").alias("within_pairs"))
    return agg.withColumn("verdict", F.when(F.col("floor").isNull() | F.col("most").isNull(), "unestablished").when(F.col("most") > F.col("floor"), "voices_differ").otherwise("within_noise"))


def language_verdict(rates: DataFrame, bar: float) -> DataFrame:
    """lang, bound_by, headroom: whether recognition or drift keeps a language's in-bound share down, and how far it is from the bar."""
    lost, late = 100.0 - F.col("match_pct"), F.col("match_pct") - F.col("within_pct")
    return rates.select("lang", F.when(lost >= late, "recognition").otherwise("drift").alias("bound_by"), F.round(F.col("within_pct") - bar, 4).alias("headroom"))
