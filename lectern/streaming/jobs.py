"""Jobs over event streams; each also runs over a bounded table with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(events: DataFrame, delay: str | None = None) -> DataFrame:
    """events with ts as a timestamp (a watermark refuses one without time zone) and, for a stream, a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay) if delay else timed


def silence_sessions(events: DataFrame, gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """A session for each user until a gap of silence: user_id, start, end, events."""
    w = F.session_window("ts", gap)
    return event_time(events, delay).groupBy("user_id", w).agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def chunks(events: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Counts of fixed-length chunks by type."""
    w = F.window("ts", length, slide or length)
    return event_time(events, delay).groupBy(w, "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "events", "total")


def rolling_stats(samples: DataFrame, length: str = "1 day", delay: str | None = None) -> DataFrame:
    """Samples, mean and largest value of each window and type."""
    return event_time(samples, delay).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("largest")).select(F.col("window.start").alias("start"), "event_type", "n", "mean", "largest")


def dedupe(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Each key's first delivery within the watermark."""
    return event_time(events, delay).dropDuplicatesWithinWatermark(keys)


def reconcile(calls: DataFrame, ledger: DataFrame, settle: str = "2 minutes") -> DataFrame:
    """Calls (call_id, ts) with the debit (call_id, debited_at, debit) that settles within the interval, if one does."""
    a, b = event_time(calls, settle).alias("a"), ledger.withColumn("debited_at", F.col("debited_at").cast("timestamp")).withWatermark("debited_at", settle).alias("b")
    ok = (F.col("a.call_id") == F.col("b.call_id")) & (F.col("b.debited_at") >= F.col("a.ts")) & (F.col("b.debited_at") <= F.col("a.ts") + F.expr(f"interval {settle}"))
    return a.join(b, ok, "leftOuter").select("a.call_id", "a.ts", "b.debit")
