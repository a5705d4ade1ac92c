"""Data-quality rules: pass, fail or unestablished; what was never observed never passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.plans.folders import folder


def expectations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, rows, failed, state. As in a check constraint, a null condition is no failure; no rows leave a rule unestablished."""
    aggs = [F.struct(F.lit(n).alias("rule"), F.count("*").alias("rows"), F.count_if(F.coalesce(~c, F.lit(False))).alias("failed")).alias(f"r{i}") for i, (n, c) in enumerate(rules.items())]
    rows = df.agg(*[a for a in aggs])
    flat = rows.select(F.explode(F.array(*[F.col(f"r{i}") for i in range(len(rules))])).alias("x")).select("x.*")
    return flat.withColumn("state", F.when(F.col("rows") == 0, "unestablished").when(F.col("failed") > 0, "fail").otherwise("pass"))


def grade(evidence: DataFrame, bar: float = 95.0) -> DataFrame:
    """sync_grade from evidence (words, longest_ms, pct): unmeasured without words, provisional below the floor of 200 words and 300 s."""
    enough = F.coalesce((F.col("words") >= 200) & (F.col("longest_ms") >= 300_000), F.lit(False))
    g = F.when(F.col("words").isNull(), "unmeasured").when(~enough, "provisional").when(F.col("pct") >= bar, "at_or_above_bar").otherwise("below_bar")
    return evidence.withColumn("sync_grade", g)


def lookup_grade(wanted: DataFrame, grades: DataFrame) -> DataFrame:
    """The grade of each (voice, lang); a pair without a row is unmeasured, never null."""
    return wanted.join(grades.select("voice", "lang", "sync_grade"), ["voice", "lang"], "left").withColumn("sync_grade", F.coalesce("sync_grade", F.lit("unmeasured")))


def domain_difference(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """value, side: what only the actual (extra) or only the expected domain (missing) holds."""
    a, e = actual.distinct(), expected.distinct()
    return a.exceptAll(e).withColumn("side", F.lit("extra")).unionByName(e.exceptAll(a).withColumn("side", F.lit("missing")))


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Names that reach one of start over edges (child, parent), start included, however far.

    Each round goes on from new names alone, so cycles end; its names are checkpointed, which cuts the lineage.
    """
    folder(edges.sparkSession)
    new = seen = start.distinct().checkpoint()
    while True:
        new = edges.join(new.withColumnRenamed("name", "parent"), "parent").select(F.col("child").alias("name")).distinct().join(seen, "name", "left_anti").checkpoint()
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)


def permanence(reasons: Column) -> Column:
    """The most lasting of an array of reasons: permanent, then render_specific, then retryable; null for none, an error for an unknown one."""
    rank = lambda r: F.when(r.isin("image_only", "no_text", "unsupported_script"), 3).when(r.isin("voice_mismatch", "render_failed"), 2).when(r.isin("timeout", "rate_limited", "engine_error"), 1).otherwise(F.raise_error(F.concat(F.lit("unknown reason "), r)).cast("int"))
    top = F.array_max(F.transform(reasons, rank))
    return F.when(top == 3, "permanent").when(top == 2, "render_specific").when(top == 1, "retryable")
