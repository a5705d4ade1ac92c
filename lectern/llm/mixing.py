"""Mixing sources to target weights by temperature.

A source's token share p becomes a weight proportional to p**t; the exponent t, bisected on
the grid k/4096, is the largest that meets the target entropy, or the smallest that keeps the
largest repetition within a limit. Weights become whole and partial passes over each source,
the partial ones cut from a block permutation by a token budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import table

GRID, SALT = 4096, "mix|"
WORD = r"[^\x20\x09-\x0D]+"


def _exponent(shares: DataFrame, repeat_limit: float | None, entropy: float | None) -> float:
    """The grid's exponent. Each bisection step is an aggregate over the sources' shares p; one row comes back."""

    def met(k: int) -> bool:
        q = F.pow("p", F.lit(k / GRID))
        r = shares.agg(F.sum(q).alias("z"), F.sum(q * F.log(q)).alias("l"), F.max(q / F.col("p")).alias("hi"), F.min(q / F.col("p")).alias("lo")).first()
        if entropy is not None:
            import math

            return math.log(r.z) - r.l / r.z >= entropy - 1e-9
        return r.hi / r.lo <= repeat_limit * (1 + 1e-9)

    low, high = 0, GRID
    if entropy is not None:  # entropy falls as the exponent grows: the largest that still meets it, or 0
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if met(mid) else (low, mid - 1)
    else:  # repetition falls as the exponent grows: the smallest within the limit
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if met(mid) else (mid + 1, high)
    return low / GRID


def place(doc_id: Column) -> Column:
    """A document's place in the permutation, the same on any engine; its first three digits are the block."""
    return F.md5(F.concat(F.lit(SALT), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, repeat_limit: float | None = 2.0, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """doc_id, source, n_tokens, weight and copies of each row of docs (doc_id, text, source).

    budget is in tokens; None takes the least at which every source gives each document once, so
    that mixing only repeats. A source's passes are weight * budget / its tokens; the whole passes
    give each document a copy, the rest gives one more to those whose place in the source's
    permutation, counted in tokens, lies before the rest's budget. A null source is a source of its
    own. Sources without tokens have weight 0 and keep one copy of each document. Null texts have no
    tokens; repeated rows count each; no rows give no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"))
    rows = table(rows.withColumn("key", place(F.col("doc_id"))).withColumn("block", F.substring("key", 1, 3)), "mix")
    blocks = table(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")), "mix")
    total = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    whole = blocks.agg(F.sum("tokens")).first()[0] or 0
    shares = table(total.withColumn("p", F.col("tokens") / F.lit(float(max(whole, 1)))), "mix")
    some = shares.where("tokens > 0")
    t = _exponent(some, repeat_limit, entropy) if whole else 1.0
    z = some.agg(F.sum(F.pow("p", F.lit(t))), F.max(F.col("p") / F.pow("p", F.lit(t)))).first()
    # The least budget has one pass at the source that gains least: passes are q / p over their minimum.
    size = float(budget) if budget is not None else (z[1] or 0.0) * (z[0] or 0.0) * whole
    q = F.pow("p", F.lit(t)) / F.lit(z[0] or 1.0)
    passes = F.round(q * F.lit(size) / F.col("tokens"), 9)
    plan = shares.select(F.col("source").alias("s"), F.when(F.col("tokens") > 0, F.round(q, 9)).otherwise(0.0).alias("weight"), F.when(F.col("tokens") > 0, F.floor(passes)).otherwise(1).alias("whole"), F.when(F.col("tokens") > 0, F.floor((passes - F.floor(passes)) * F.col("tokens"))).otherwise(0).alias("rest"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset"))
    offsets = offsets.join(plan, offsets["s"].eqNullSafe(plan["s"])).drop(plan["s"])
    inside = Window.partitionBy("source", "block").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    out = placed.join(offsets, placed["source"].eqNullSafe(offsets["s"]) & (placed["block"] == offsets["b"]))
    return out.select("doc_id", "source", "n_tokens", "weight", (F.col("whole") + (F.col("offset") + F.col("within") < F.col("rest")).cast("long")).cast("long").alias("copies"))


SQL = r"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens, md5('mix|' || doc_id::VARCHAR) AS key FROM documents
), s AS (
  SELECT source, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE / sum(sum(n_tokens)) OVER () AS p FROM r GROUP BY source
), g AS (
  SELECT min(k) / 4096.0 AS t FROM (SELECT k, max(pow(p, k / 4096.0) / p) / min(pow(p, k / 4096.0) / p) AS spread FROM s, range(0, 4097) x(k) WHERE tokens > 0 GROUP BY k) WHERE spread <= 2.0 * (1 + 1e-9)
), z AS (
  SELECT t, sum(pow(p, t)) AS z, max(p / pow(p, t)) AS m, sum(tokens) AS total FROM s, g WHERE tokens > 0 GROUP BY t
), plan AS (
  SELECT source, tokens, round(pow(p, t) / z, 9) AS weight, round(pow(p, t) / z * (m * z * total) / tokens, 9) AS passes FROM s, z
), w AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r
)
SELECT w.doc_id, w.source, w.n_tokens, plan.weight, (floor(passes) + (before < floor((passes - floor(passes)) * tokens))::INT)::BIGINT AS copies
FROM w JOIN plan ON w.source IS NOT DISTINCT FROM plan.source
"""
