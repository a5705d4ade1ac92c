"""Queries of the rules over rows derived from the documents, one fault planted for each; the SQL states the rules again in its own words."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import quality, rules
from lectern.queries import query, read

_GRADE = """SELECT doc_id, CASE WHEN doc_id % 53 = 9 THEN 'EN' ELSE lang END AS lang, CASE WHEN doc_id % 61 = 3 THEN '' ELSE source END AS sample_audio_path, text AS sample_text,
  CASE WHEN doc_id % 5 = 0 THEN 'unmeasured' WHEN doc_id % 5 = 1 THEN 'at_or_above_bar' ELSE 'below_bar' END AS sync_grade, CASE WHEN doc_id % 5 > 0 AND doc_id % 31 <> 7 THEN CASE WHEN doc_id % 41 = 6 THEN 'other' ELSE 'matched_within_drift_pct' END END AS sync_metric,
  CASE WHEN doc_id % 5 > 0 THEN CASE WHEN doc_id % 71 = 6 THEN 0 ELSE 250 END END AS sync_drift_bound_ms, CASE WHEN doc_id % 5 > 0 THEN 90 + doc_id % 12 END AS sync_pct, CASE WHEN doc_id % 5 > 0 THEN length(text) END AS sync_matched_words,
  CASE WHEN doc_id % 5 > 0 THEN length(text) * 650 END AS sync_longest_clip_ms, CASE WHEN doc_id % 5 > 0 THEN '2026-01-01' END AS sync_measured_at, CASE WHEN doc_id % 5 > 0 THEN 'out.json' WHEN doc_id % 35 = 5 THEN 'left' END AS sync_evidence_path FROM documents"""


def _state(preds: dict[str, str], rows: str = "r") -> str:
    each = (f"SELECT '{n}' AS rule, count(*) AS rows, count(*) FILTER (NOT ({p})) AS failed, CASE WHEN count(*) = 0 THEN 'unestablished' WHEN count(*) FILTER (NOT ({p})) > 0 THEN 'fail' ELSE 'pass' END AS state FROM {rows}" for n, p in preds.items())
    return " UNION ALL ".join(each)


def _grades(spark, sf):
    read(spark, sf, "documents").createOrReplaceTempView("rule_documents")
    return spark.sql(_GRADE.replace("FROM documents", "FROM rule_documents"))


_NULLS = " + ".join(f"({c} IS NULL)::INT" for c in rules.EVIDENCE)


@query(f"WITH r AS ({_GRADE}) " + _state({
    "evidence_iff_measured": f"{_NULLS} = CASE WHEN sync_grade = 'unmeasured' THEN 7 ELSE 0 END",
    "evidence_floor": "sync_grade <> 'at_or_above_bar' OR coalesce(sync_metric = 'matched_within_drift_pct' AND sync_drift_bound_ms = 250 AND sync_matched_words >= 200 AND sync_longest_clip_ms >= 300000, false)",
    "lang_shape": "regexp_matches(lang, '^[a-z]{2,3}(-[A-Za-z0-9]{1,8})*$')", "sample_path_not_empty": "sample_audio_path <> ''", "sample_text_length": "length(sample_text) BETWEEN 1 AND 2000", "evidence_path_not_empty": "sync_evidence_path <> ''",
    "pct_range": "sync_pct >= 0 AND sync_pct <= 100", "words_not_negative": "sync_matched_words >= 0", "clip_not_negative": "sync_longest_clip_ms >= 0", "bound_positive": "sync_drift_bound_ms > 0",
}))
def p4_grade_contract(spark, sf):
    """All seven evidence columns, the floor and the domains of grade rows."""
    return quality.expectations(_grades(spark, sf), rules.evidence_iff_measured() | rules.evidence_floor() | rules.grade_domains())


@query("""WITH b AS (SELECT doc_id, 1 + length(text) // 1000 AS segments, lang, length(text) AS spoken FROM documents), r AS (SELECT *, lang IN ('en', 'es', 'fr') AS routed, doc_id % 3 = 0 AS graded FROM b),
q AS (SELECT segments, CASE WHEN routed THEN segments ELSE 0 END AS avail, CASE WHEN routed THEN 0 ELSE segments END AS blocked, CASE WHEN graded AND routed THEN segments ELSE 0 END AS sync, CASE WHEN graded AND routed THEN 0 WHEN doc_id % 29 = 4 THEN segments + 1 ELSE segments END AS un,
  CASE WHEN doc_id % 43 = 1 THEN spoken + 1 ELSE doc_id % 10 END AS ins, spoken, CASE WHEN doc_id % 3 = 0 AND doc_id % 21 > 0 THEN 'at_or_above_bar' WHEN doc_id % 3 = 0 THEN 'provisional' END AS sync_grade, doc_id % 7 - spoken + CASE WHEN doc_id % 37 = 2 THEN 1 ELSE 0 END AS after, doc_id % 7 AS balance FROM r)
""" + _state({"speech_identity": "avail + blocked = segments", "sync_identity": "sync + un = segments", "inserted_within_spoken": "ins <= spoken", "sync_needs_grade": "sync = 0 OR coalesce(sync_grade = 'at_or_above_bar', false)", "balance_after": "after = balance - spoken"}, "q"))  # fmt: skip
def q5_quote_buckets(spark, sf):
    """Speech and word-sync identities, insertions, grades and balances of quotes; blockers are maps of counts."""
    d, n = F.col("doc_id"), F.length("text").cast("long")
    segments = (1 + F.floor(n / 1000)).cast("long")
    routed, graded = F.col("lang").isin("en", "es", "fr"), d % 3 == 0
    zero = F.lit(0).cast("long")
    no_route = F.when(routed, F.create_map().cast("map<string,bigint>")).otherwise(F.create_map(F.lit("language"), F.floor(segments / 2), F.lit("voice"), segments - F.floor(segments / 2)))
    rows = read(spark, sf, "documents").select(
        segments.alias("segments"), F.when(routed, segments).otherwise(zero).alias("speech_available_segments"), no_route.alias("speech_blocker"), F.when(graded & routed, segments).otherwise(zero).alias("word_sync_available_segments"),
        F.when(graded & routed, zero).when(d % 29 == 4, segments + 1).otherwise(zero).alias("word_sync_unmeasured_segments"), F.when((graded & routed) | (d % 29 == 4), F.create_map().cast("map<string,bigint>")).otherwise(F.create_map(F.lit("ungraded"), segments)).alias("align_blocker"),
        F.when(d % 43 == 1, n + 1).otherwise(d % 10).alias("inserted_characters"), n.alias("spoken_characters"), F.when(graded & (d % 21 > 0), "at_or_above_bar").when(graded, "provisional").alias("sync_grade"),
        (d % 7).alias("balance"), n.alias("credits"), (d % 7 - n + F.when(d % 37 == 2, 1).otherwise(0)).alias("balance_after"),
    )
    return quality.expectations(rows, rules.quote_identities())


CAUSES, CONTEXTS, STATUSES = ("low_confidence", "engine_failed"), ("voice_substituted", "language_guessed"), ("ok", "degraded", "unavailable", "pending")


@query("""WITH r AS (SELECT CASE WHEN doc_id % 59 = 8 THEN 'odd' WHEN doc_id % 4 = 0 THEN 'degraded' ELSE 'ok' END AS st, CASE WHEN doc_id % 47 = 5 THEN NULL ELSE list_filter([CASE WHEN doc_id % 4 = 0 THEN 'low_confidence' END, CASE WHEN doc_id % 44 = 0 THEN 'engine_failed' END, CASE WHEN doc_id % 6 = 0 THEN 'voice_substituted' END, CASE WHEN doc_id % 66 = 0 THEN 'language_guessed' END, CASE WHEN doc_id % 51 = 2 THEN source END], lambda x: x IS NOT NULL) END AS a, doc_id % 34 = 1 AS lost FROM documents)
""" + _state({"status_known": "st IN ('ok', 'degraded', 'unavailable', 'pending')", "reasons_there": "a IS NOT NULL", "one_cause": "len(list_filter(a, lambda x: x IN ('low_confidence', 'engine_failed'))) <= 1", "one_context": "len(list_filter(a, lambda x: x IN ('voice_substituted', 'language_guessed'))) <= 1", "no_unknown": "len(list_filter(a, lambda x: x NOT IN ('low_confidence', 'engine_failed', 'voice_substituted', 'language_guessed'))) = 0", "provenance": "NOT lost"}))  # fmt: skip
def q8_reason_arrays(spark, sf):
    """Reason lists of segments: known statuses, one cause and one context at most, nothing unknown, and their blocks."""
    d = F.col("doc_id")
    each = [F.when(d % 4 == 0, "low_confidence"), F.when(d % 44 == 0, "engine_failed"), F.when(d % 6 == 0, "voice_substituted"), F.when(d % 66 == 0, "language_guessed"), F.when(d % 51 == 2, F.col("source"))]
    rows = read(spark, sf, "documents").select(
        F.when(d % 59 == 8, "odd").when(d % 4 == 0, "degraded").otherwise("ok").alias("align_status"), F.when(d % 47 != 5, F.array_compact(F.array(*each))).alias("align_reason"),
        F.lit(0).alias("start_block_ord"), F.when(d % 34 != 1, 1).alias("end_block_ord"), F.array(F.lit(2)).alias("skipped_block_ords"), F.array(F.lit(0)).alias("block_start_offsets"),
    )
    return quality.expectations(rows, rules.align_reasons(CAUSES, CONTEXTS, STATUSES))


@query("""WITH k AS (SELECT DISTINCT lang AS locale, source FROM documents), m AS (SELECT locale, source || '+low' AS key, CASE WHEN source LIKE '%1' AND locale = 'es' THEN 'The words of this part are unsure' WHEN source LIKE '%2' AND locale = 'fr' THEN source || '+low' WHEN source LIKE '%3' THEN '' WHEN locale = 'en' THEN 'The words of this part are unsure' ELSE 'Text in ' || locale END AS message FROM k
  UNION ALL SELECT locale, 'low.' || source, 'Once more, in other words' FROM k WHERE source LIKE '%4' AND locale = 'de'),
w AS (SELECT DISTINCT source, unnest(['en', 'es', 'fr', 'de']) AS locale FROM documents), n AS (SELECT locale, list_sort(list_filter(string_split_regex(key, '[.+]'), lambda x: x <> '')) AS s, count(*) AS n FROM m WHERE message <> '' GROUP BY ALL)
SELECT w.locale, array_to_string(list_sort([source, 'low']), '+') AS what, 'resolves to ' || coalesce(n, 0) AS fault FROM w LEFT JOIN n ON n.locale = w.locale AND n.s = list_sort([source, 'low']) WHERE coalesce(n, 0) <> 1
UNION ALL SELECT locale, key, CASE WHEN message = '' THEN 'no text' WHEN message = key THEN 'echo of its key' ELSE 'bare token' END FROM m WHERE message = '' OR message = key OR regexp_matches(message, '^[a-z0-9_]+$')
UNION ALL SELECT m.locale, m.key, 'copied from English' FROM m JOIN m e ON e.key = m.key AND e.locale = 'en' AND len(string_split(e.message, ' ')) >= 3 WHERE m.locale <> 'en' AND m.message = e.message""")
def q10_catalogue_faults(spark, sf):
    """Messages of each language for each source: unresolved and doubly resolved sets of tokens, echoes, missing texts and copies of the English."""
    docs = read(spark, sf, "documents")
    k = docs.select(F.col("lang").alias("locale"), "source").distinct()
    key = F.concat("source", F.lit("+low"))
    english = "The words of this part are unsure"
    text = F.when(F.col("source").endswith("1") & (F.col("locale") == "es"), english).when(F.col("source").endswith("2") & (F.col("locale") == "fr"), key).when(F.col("source").endswith("3"), "")
    one = k.select("locale", key.alias("key"), text.when(F.col("locale") == "en", english).otherwise(F.concat(F.lit("Text in "), "locale")).alias("message"))
    two = k.where(F.col("source").endswith("4") & (F.col("locale") == "de")).select("locale", F.concat(F.lit("low."), "source").alias("key"), F.lit("Once more, in other words").alias("message"))
    emitted = docs.select(F.array("source", F.lit("low")).alias("tokens")).distinct()
    return rules.catalogue_faults(one.unionByName(two), emitted, ["en", "es", "fr", "de"])
