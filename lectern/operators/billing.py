"""Billing units, run costs, ledgers and quotes; money is decimal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = "0.000015"


def corpus_totals(docs: DataFrame) -> DataFrame:
    """For each language: characters, UTF-8 bytes, bytes a character, and the cost by either unit."""
    agg = docs.groupBy("lang").agg(F.count("*").alias("texts"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"))
    cost = lambda c: F.round(F.col(c).cast("decimal(18,0)") * F.lit(RATE).cast("decimal(18,6)"), 6).cast("double")
    return agg.select("lang", "texts", "chars", "bytes", F.round(F.col("bytes") / F.col("chars"), 6).alias("bytes_per_char"), cost("chars").alias("cost_chars"), cost("bytes").alias("cost_bytes"))


def judge(calls: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """verdict of each billed call (text, debit): which unit explains the debit within the tolerance; without a debit it is inconclusive."""
    chars, size = F.length("text") * 15, F.octet_length("text") * 15  # millionths
    near = lambda m: F.abs(F.col("debit") - m) <= m * tolerance
    verdict = F.when(F.col("debit").isNull(), "INCONCLUSIVE").when(near(chars) & near(size), "INCONCLUSIVE").when(near(size), "UTF8_BYTES").when(near(chars), "CHARACTERS").otherwise("NEITHER")
    return calls.withColumn("verdict", verdict)


def runs_with_measurement(meta: DataFrame, measured: DataFrame) -> DataFrame:
    """Every run with its measurement if there is one; state says what is missing."""
    both = meta.join(measured, "run_id", "left")
    return both.withColumn("state", F.when(F.col("exit_code") == 137, "out of memory").when(F.col("exit_code") != 0, "failed").when(F.col("cpu_s").isNull(), "not measured").otherwise("ok"))


def quotes(segments: DataFrame, balances: DataFrame) -> DataFrame:
    """Segments, characters, credits and the balance after, which may fall below zero, for each document's customer."""
    q = segments.groupBy("doc_id", "cust_id").agg(F.count("*").alias("segments"), F.sum("spoken").alias("spoken_characters"), F.count_if(F.col("routed")).alias("speech_available"), F.count_if(~F.col("routed")).alias("speech_blocked"))
    credits = F.ceil(F.col("spoken_characters") / 1000)
    return q.join(balances, "cust_id").select("doc_id", "segments", "spoken_characters", credits.alias("credits"), (F.floor("balance") - credits).alias("balance_after"), "speech_available", "speech_blocked")
