"""Every rule against a row that keeps it and one that breaks it."""

import datetime

from lectern.operators import rules
from lectern.operators.quality import expectations

GRADE = "lang string, sample_audio_path string, sample_text string, sync_grade string, sync_metric string, sync_drift_bound_ms int, sync_pct double, sync_matched_words int, sync_longest_clip_ms int, sync_measured_at date, sync_evidence_path string"
DAY = datetime.date(2026, 1, 1)
GOOD = ("en-GB", "a.wav", "text", "at_or_above_bar", "matched_within_drift_pct", 250, 96.0, 300, 400_000, DAY, "out/x.json")


def failed(df, checks):
    return {r.rule: r.failed for r in expectations(df, checks).collect()}


def broken(i, value):
    return (*GOOD[:i], value, *GOOD[i + 1 :])


def test_grade_rows(spark):
    unmeasured = ("fr", None, "x", "unmeasured", *[None] * 7)
    half = [broken(i, None) for i in range(4, 11)] + [broken(3, "unmeasured"), ("fr", None, "x", "unmeasured", *[None] * 6, "p")]
    df = spark.createDataFrame([GOOD, unmeasured, *half], GRADE)
    assert failed(df, rules.evidence_iff_measured()) == {"evidence_iff_measured": 9}
    low = [broken(4, "other"), broken(5, 300), broken(7, 199), broken(8, 299_999), broken(7, None), broken(4, None)]
    df = spark.createDataFrame([GOOD, unmeasured, (*GOOD[:3], "below_bar", "other", *GOOD[5:]), *low], GRADE)
    assert failed(df, rules.evidence_floor()) == {"evidence_floor": 6}
    odd = [broken(0, "EN"), broken(0, "english"), broken(1, ""), broken(2, ""), broken(2, "x" * 2001), broken(10, ""), broken(6, 100.5), broken(6, -1.0), broken(7, -1), broken(8, -1), broken(5, 0)]
    got = failed(spark.createDataFrame([GOOD, unmeasured, *odd], GRADE), rules.grade_domains())
    assert got == {"lang_shape": 2, "sample_path_not_empty": 1, "sample_text_length": 2, "evidence_path_not_empty": 1, "pct_range": 2, "words_not_negative": 1, "clip_not_negative": 1, "bound_positive": 1}


def test_gaps_claims_and_quotes(spark):
    gaps = [("display_skipped", 1, 2, None, None), ("observed_unmatched", None, None, 1.0, 2.0), ("display_skipped", 1, None, None, None), ("display_skipped", 1, 2, 1.0, None), ("observed_unmatched", 1, None, 1.0, 2.0)]
    assert failed(spark.createDataFrame(gaps, "reason string, cs int, ce int, s double, e double"), rules.gap_address()) == {"char_half": 2, "time_half": 1}
    claims = [(1000, 300.0, True), (999, 400.0, True), (1000, 299.9, True), (1, 1.0, False)]
    assert failed(spark.createDataFrame(claims, "words int, seconds double, claimed boolean"), rules.chapter_length()) == {"claim_has_length": 2}
    shape = "segments long, speech_available_segments long, speech_blocker map<string,long>, word_sync_available_segments long, word_sync_unmeasured_segments long, align_blocker map<string,long>, inserted_characters long, spoken_characters long, sync_grade string, balance long, credits long, balance_after long"
    good = (10, 7, {"a": 1, "b": 2}, 3, 5, {"x": 2}, 4, 90, "at_or_above_bar", 5, 8, -3)
    change = lambda i, v: (*good[:i], v, *good[i + 1 :])
    quotes = [good, change(2, {}), change(4, 4), change(6, 91), change(8, "provisional"), change(8, None), change(11, 0)]
    assert failed(spark.createDataFrame(quotes, shape), rules.quote_identities()) == {"speech_identity": 1, "sync_identity": 1, "inserted_within_spoken": 1, "sync_needs_grade": 2, "balance_after": 1}


def test_blocks_spans_and_segments(spark):
    blocks = [("paragraph", "en", None, None, None), ("heading", "en", 2, None, None), ("heading", "en", None, None, None), ("figure", "", None, "", None), ("figure", None, None, None, None), ("table", "en", None, None, None), ("table", "en", None, None, [])]
    assert failed(spark.createDataFrame(blocks, "type string, lang string, heading_level int, alt_text string, rows array<int>"), rules.block_fidelity()) == {"lang_there": 2, "heading_level": 1, "alt_text": 1, "table_rows": 1}
    spans = [("dropped", "no_text", 1, 1, 0, 5, 1), ("dropped", "no_text", 1, 1, 0, 5, 18), ("dropped", "no_text", 1, 1, 0, 5, None), (None, "no_text", 1, 1, 0, 5, 1), ("figure", "odd", 1, 1, 0, None, 1)]
    df = spark.createDataFrame(spans, "kind string, reason string, start_block_ord int, end_block_ord int, segment_ord int, char_offset int, count int")
    assert failed(df, rules.span_domains(("dropped", "figure"), ("no_text",))) == {"kind_known": 1, "reason_known": 1, "positioned": 1, "one_per_marker": 2}
    n = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a")], "doc_id long, reason string")
    t = spark.createDataFrame([(1, "a", 2), (2, "a", 5), (2, "z", 1)], "doc_id long, reason string, total long")
    assert {tuple(r) for r in rules.span_totals(n, t, ("a", "b")).collect()} == {(1, "b", "absent"), (2, "a", "wrong total"), (2, "z", "unknown reason")}
    segments = [("ok", [], 0, 1, [], [0]), ("degraded", ["low", "substituted"], 0, 1, [], [0]), ("odd", ["low", "late"], 0, 1, [], [0]), ("ok", ["substituted", "other_voice"], 0, 1, [], [0]), ("ok", ["what"], 0, 1, [], None), ("ok", None, None, 1, [], [0])]
    df = spark.createDataFrame(segments, "align_status string, align_reason array<string>, start_block_ord int, end_block_ord int, skipped_block_ords array<int>, block_start_offsets array<int>")
    got = failed(df, rules.align_reasons(("low", "late"), ("substituted", "other_voice"), ("ok", "degraded")))
    assert got == {"status_known": 1, "reasons_there": 1, "one_cause": 1, "one_context": 1, "no_unknown": 1, "provenance": 2}
    rows = [("degraded", "u", 1, 2), ("degraded", None, 1, 2), ("ok", None, 3, 2), ("ok", None, 3, None)]
    assert failed(spark.createDataFrame(rows, "align_status string, audio_url string, text_ready_at int, audio_ready_at int"), rules.degraded_rows()) == {"degraded_keeps_audio": 1, "text_before_audio": 1}


def test_catalogue(spark):
    messages = [
        ("en", "pending", "Still being made ready"), ("es", "pending", "Still being made ready"), ("fr", "pending", "En cours"), ("en", "degraded+low", "Some words are unsure"), ("es", "low:degraded", "Algunas palabras"), ("es", "degraded.low", "Palabras"),
        ("fr", "degraded+low", " "), ("en", "ok", "ok"), ("es", "ok", "fine_token"), ("fr", "ok", "Bien"),
    ]
    df = spark.createDataFrame(messages, "locale string, key string, message string")
    emitted = spark.createDataFrame([(["pending"],), (["low", "degraded"],), (["degraded", "low", "low"],)], "tokens array<string>")
    got = {tuple(r) for r in rules.catalogue_faults(df, emitted, ["en", "es", "fr"]).collect()}
    assert got == {("es", "pending", "copied from English"), ("es", "degraded+low", "resolves to 2"), ("fr", "degraded+low", "resolves to 0"), ("fr", "degraded+low", "no text"), ("en", "ok", "echo of its key"), ("es", "ok", "bare token")}
