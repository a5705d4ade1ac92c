"""The contracts' rules as conditions over named columns, for quality.expectations(), and faults that need more than one row.

As in a check constraint a null condition is no failure, so each rule says itself what a missing value means.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The evidence behind a grade: all of it is there, or none.
EVIDENCE = ("sync_metric", "sync_drift_bound_ms", "sync_pct", "sync_matched_words", "sync_longest_clip_ms", "sync_measured_at", "sync_evidence_path")
LANG = "^[a-z]{2,3}(-[A-Za-z0-9]{1,8})*$"


def _there(*columns: str) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])


def evidence_iff_measured(grade: str = "sync_grade", columns: tuple[str, ...] = EVIDENCE) -> dict[str, Column]:
    """As many of the evidence columns are null as there are where the grade is unmeasured, and none elsewhere."""
    nulls = reduce(Column.__add__, [F.col(c).isNull().cast("int") for c in columns])
    return {"evidence_iff_measured": nulls == F.when(F.col(grade) == "unmeasured", len(columns)).otherwise(0)}


def evidence_floor(metric: str = "matched_within_drift_pct", bound_ms: int = 250, words: int = 200, clip_ms: int = 300_000) -> dict[str, Column]:
    """A grade at or above the bar needs the bar's own metric and bound, and enough words and length; what is missing doesn't count as enough."""
    ok = (F.col("sync_metric") == metric) & (F.col("sync_drift_bound_ms") == bound_ms) & (F.col("sync_matched_words") >= words) & (F.col("sync_longest_clip_ms") >= clip_ms)
    return {"evidence_floor": (F.col("sync_grade") != "at_or_above_bar") | F.coalesce(ok, F.lit(False))}


def grade_domains() -> dict[str, Column]:
    """Shapes and ranges of a grade row."""
    return {
        "lang_shape": F.col("lang").rlike(LANG), "sample_path_not_empty": F.col("sample_audio_path") != "", "sample_text_length": F.length("sample_text").between(1, 2000), "evidence_path_not_empty": F.col("sync_evidence_path") != "",
        "pct_range": F.col("sync_pct").between(0, 100), "words_not_negative": F.col("sync_matched_words") >= 0, "clip_not_negative": F.col("sync_longest_clip_ms") >= 0, "bound_positive": F.col("sync_drift_bound_ms") > 0,
    }


def gap_address() -> dict[str, Column]:
    """A gap is addressed by characters or by time, as its reason says, and never by both."""
    chars, times = _there("cs", "ce"), _there("s", "e")
    no_chars, no_times = F.col("cs").isNull() & F.col("ce").isNull(), F.col("s").isNull() & F.col("e").isNull()
    return {"char_half": (F.col("reason") != "display_skipped") | (chars & no_times), "time_half": (F.col("reason") != "observed_unmatched") | (times & no_chars)}


def chapter_length(words: int = 1000, ms: int = 300_000) -> dict[str, Column]:
    """A claim about a chapter needs a chapter's words and length."""
    return {"claim_has_length": ~F.col("claimed") | ((F.col("words") >= words) & (F.col("seconds") * 1000 >= ms))}


def quote_identities(bar: str = "at_or_above_bar") -> dict[str, Column]:
    """The buckets of a quote divide its segments, for speech and for word sync; blockers are maps of counts; word sync is offered only where the pair is graded."""
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda s, x: s + x)
    speech = F.col("speech_available_segments") + total("speech_blocker")
    sync = F.col("word_sync_available_segments") + F.col("word_sync_unmeasured_segments") + total("align_blocker")
    return {
        "speech_identity": speech == F.col("segments"), "sync_identity": sync == F.col("segments"), "inserted_within_spoken": F.col("inserted_characters") <= F.col("spoken_characters"),
        "sync_needs_grade": (F.col("word_sync_available_segments") == 0) | F.coalesce(F.col("sync_grade") == bar, F.lit(False)), "balance_after": F.col("balance_after") == F.col("balance") - F.col("credits"),
    }


def block_fidelity() -> dict[str, Column]:
    """What a client can't make up: language of every block, level of headings, alternative text of figures, rows of tables."""
    kind = lambda k, c: (F.col("type") != k) | F.col(c).isNotNull()
    return {"lang_there": F.coalesce(F.col("lang") != "", F.lit(False)), "heading_level": kind("heading", "heading_level"), "alt_text": kind("figure", "alt_text"), "table_rows": kind("table", "rows")}


def span_domains(kinds: tuple[str, ...], reasons: tuple[str, ...]) -> dict[str, Column]:
    """Kind and reason of every span are known ones, all four parts of its address are there, and a dropped marker has a row of its own."""
    address = ("start_block_ord", "end_block_ord", "segment_ord", "char_offset")
    return {
        "kind_known": F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "reason_known": F.coalesce(F.col("reason").isin(*reasons), F.lit(False)), "positioned": _there(*address),
        "one_per_marker": (F.col("kind") != "dropped") | F.coalesce(F.col("count") == 1, F.lit(False)),
    }


def span_totals(spans: DataFrame, totals: DataFrame, reasons: tuple[str, ...]) -> DataFrame:
    """doc_id, reason, fault: totals under an unknown reason, reasons of spans without a total, and totals that differ from their spans' count."""
    n = spans.groupBy("doc_id", "reason").agg(F.count("*").alias("spans"))
    both = n.join(totals.select("doc_id", "reason", "total"), ["doc_id", "reason"], "full")
    fault = F.when(F.col("total").isNull(), "absent").when(~F.col("reason").isin(*reasons), "unknown reason").when(F.col("total") != F.coalesce("spans", F.lit(0)), "wrong total")
    return both.withColumn("fault", fault).where("fault is not null").select("doc_id", "reason", "fault")


def align_reasons(causes: tuple[str, ...], contexts: tuple[str, ...], statuses: tuple[str, ...]) -> dict[str, Column]:
    """align_reason is a list with one cause and one context at most and nothing unknown; align_status is a known one; a segment knows its blocks."""
    of = lambda names: F.size(F.filter("align_reason", lambda r: F.coalesce(r.isin(*names), F.lit(False))))
    return {
        "status_known": F.coalesce(F.col("align_status").isin(*statuses), F.lit(False)), "reasons_there": F.col("align_reason").isNotNull(), "one_cause": of(causes) <= 1, "one_context": of(contexts) <= 1,
        "no_unknown": of((*causes, *contexts)) == F.size("align_reason"), "provenance": _there("start_block_ord", "end_block_ord", "skipped_block_ords", "block_start_offsets"),
    }


def degraded_rows() -> dict[str, Column]:
    """A degraded segment keeps its audio, and text never waits for audio."""
    return {"degraded_keeps_audio": (F.col("align_status") != "degraded") | F.coalesce(F.col("audio_url") != "", F.lit(False)), "text_before_audio": F.col("audio_ready_at").isNull() | F.coalesce(F.col("text_ready_at") <= F.col("audio_ready_at"), F.lit(False))}


def key_tokens(key: Column) -> Column:
    """The set of tokens that a catalogue key is made of."""
    return F.array_sort(F.array_distinct(F.filter(F.split(key, r"[.:+/\s-]+"), lambda x: x != "")))


def catalogue_faults(messages: DataFrame, emitted: DataFrame, locales: list[str], english: str = "en", least_words: int = 3) -> DataFrame:
    """locale, what, fault over messages (locale, key, message) for what was emitted (tokens, a list).

    Each set of tokens must resolve to one key of each locale that has a text; a text that is its key or a bare token is no
    translation, and neither is a sentence of least_words and more that is the English one.
    """
    keyed = messages.withColumn("set", key_tokens(F.col("key")))
    text = F.trim(F.coalesce("message", F.lit("")))
    wanted = emitted.select(F.array_sort(F.array_distinct("tokens")).alias("set")).distinct().withColumn("locale", F.explode(F.array(*map(F.lit, locales))))
    n = keyed.where(text != "").groupBy("locale", "set").agg(F.count("*").alias("n"))
    unresolved = wanted.join(n, ["locale", "set"], "left").where(F.coalesce("n", F.lit(0)) != 1)
    unresolved = unresolved.select("locale", F.array_join("set", "+").alias("what"), F.concat(F.lit("resolves to "), F.coalesce("n", F.lit(0)).cast("string")).alias("fault"))
    bad = F.when(text == "", "no text").when(text == F.col("key"), "echo of its key").when(text.rlike("^[a-z0-9_]+$"), "bare token")
    alone = keyed.withColumn("fault", bad).where("fault is not null").select("locale", F.col("key").alias("what"), "fault")
    source = messages.where((F.col("locale") == english) & (F.size(F.split(text, r"\s+")) >= least_words)).select("key", F.col("message").alias("source"))
    copied = messages.where(F.col("locale") != english).join(source, "key").where("message = source").select("locale", F.col("key").alias("what"), F.lit("copied from English").alias("fault"))
    return unresolved.unionByName(alone).unionByName(copied)
