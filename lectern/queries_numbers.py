"""Queries of spoken forms, costs, samples and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import spelling, spoken
from lectern.functions import text as t
from lectern.operators import billing, costs
from lectern.plans import derived
from lectern.queries import DRIFT, FOLD, _display, _placed, query, read

ELISION = "CASE WHEN instr(f, '''') > 1 AND instr(f, '''') < length(f) THEN [[f[1:instr(f, '''') - 1], f[instr(f, ''''):]], [f[1:instr(f, '''')], f[instr(f, '''') + 1:]]] ELSE [] END"


def _sql_map(entries: dict, value=lambda v: f"'{v}'") -> str:
    return "MAP {" + ", ".join(f"{k if isinstance(k, int) else repr(k)}: {value(v)}" for k, v in entries.items()) + "}"


def _sql_by_lang(tables: dict, key: str, value=lambda v: f"'{v}'") -> str:
    return "CASE lang " + " ".join(f"WHEN '{lang}' THEN {_sql_map(e, value)}[{key}]" for lang, e in tables.items()) + " END"


def _spelling_pairs() -> str:
    """VALUES rows (k, a, b) of the closed families: b is another spelling of a, in the order in which they are tried."""
    single = [*spelling.PAIRS.items(), *[(a + s, b + s) for a, b in spelling.DIGRAPHS.items() for s in ("", "s")]]
    rows = [(0, a, b) for a, b in single] + [(1, b, a) for a, b in single]
    for i, (stems, gb, us, rest) in enumerate(spelling.FAMILIES):
        both = [(x + gb + r, x + us + r) for x in stems for r in rest]
        rows += [(2 + 2 * i, a, b) for a, b in both] + [(3 + 2 * i, b, a) for a, b in both]
    return ", ".join(f"({k}, '{a}', '{b}')" for k, a, b in rows)


_STAYS = "('" + "', '".join(x[:-1] + e for x in [*spelling.KEEP_S, *spelling.KEEP_Z] for e in ("e", "ed", "es", "er", "ers", "ing")) + "')"
#: The other spellings of each English fold of a table fd, as lists by fold.
SPELLINGS = f"""
, sw AS (SELECT DISTINCT f, CASE WHEN regexp_matches(f, 'i[sz](ations?|ed|es|ing|ers?|e)$') OR regexp_matches(f, 'y[sz](ed|es|ing|e)$') THEN
  CASE WHEN regexp_matches(f, 's(ations?|ed|es|ing|ers?|e)$') THEN regexp_replace(f, 's(ations?|ed|es|ing|ers?|e)$', 'z\\1') ELSE regexp_replace(f, 'z(ations?|ed|es|ing|ers?|e)$', 's\\1') END END AS b FROM fd WHERE lang = 'en'),
pr AS (SELECT * FROM (VALUES {_spelling_pairs()}) v(k, a, b) UNION ALL SELECT 99, f, b FROM sw WHERE b IS NOT NULL AND f NOT IN {_STAYS} AND b NOT IN {_STAYS}),
sp AS (SELECT a AS f, list(b ORDER BY k) AS other FROM (SELECT a, b, min(k) AS k FROM pr WHERE a <> b AND a IN (SELECT f FROM fd WHERE lang = 'en') GROUP BY a, b) GROUP BY a)
"""


# Page tokens with numbers, abbreviations and elisions among them: a sixth of each stands for the token itself.
TOKENS = f"""
, tk AS (SELECT DISTINCT lang, CASE (length(text) + cs) % 12 WHEN 0 THEN ((cs * 37) % 2300)::VARCHAR WHEN 1 THEN (cs % 120)::VARCHAR WHEN 2 THEN 'Dr.' WHEN 3 THEN concat('l''', text) WHEN 4 THEN concat((cs % 9 + 1)::VARCHAR, ',', (100 + cs % 900)::VARCHAR) WHEN 5 THEN 'st' ELSE text END AS token FROM disp),
fd AS (SELECT lang, token, {FOLD.format('token')} AS f, regexp_replace(token, '[^0-9]', '', 'g') AS g FROM tk), nm AS (SELECT *, CASE WHEN length(g) BETWEEN 1 AND 15 THEN g::BIGINT END AS n FROM fd),
wd AS (SELECT *, {_sql_by_lang(spoken.NUMBERS, 'n')} AS whole, {_sql_by_lang(spoken.NUMBERS, 'n // 100')} AS head, {_sql_by_lang(spoken.NUMBERS, 'n % 100')} AS low, {_sql_by_lang(spoken.NUMBERS, 'n % 100 - n % 10')} AS tens, {_sql_by_lang(spoken.NUMBERS, 'n % 10')} AS units, {_sql_by_lang(spoken.ABBREVIATIONS, 'f', lambda v: str(v))} AS abbr FROM nm),
yr AS (SELECT *, CASE WHEN n BETWEEN 1100 AND 2099 AND head IS NOT NULL THEN CASE WHEN n % 100 = 0 THEN [head] WHEN low IS NOT NULL THEN [head, low] WHEN tens IS NOT NULL AND units IS NOT NULL THEN [head, tens, units] END END AS year FROM wd)
"""


def _each_token(spark, sf):
    cs, kind = F.col("cs"), (F.length("text") + F.col("cs")) % 12
    text = F.when(kind == 0, ((cs * 37) % 2300).cast("string")).when(kind == 1, (cs % 120).cast("string")).when(kind == 2, "Dr.").when(kind == 3, F.concat(F.lit("l'"), "text"))
    text = text.when(kind == 4, F.concat((cs % 9 + 1).cast("string"), F.lit(","), (100 + cs % 900).cast("string"))).when(kind == 5, "st").otherwise(F.col("text"))
    return _display(spark, sf).select("lang", text.alias("token"))


def _tokens(spark, sf):
    return _each_token(spark, sf).distinct()


def _number():
    g = t.digits(F.col("token"))
    return F.when(F.length(g).between(1, 15), g.cast("bigint"))


@query(TOKENS + "SELECT lang, token, whole FROM wd WHERE whole IS NOT NULL", True)
def f5_number_words(spark, sf):
    return _tokens(spark, sf).withColumn("whole", spoken.number_word(_number(), F.col("lang"))).where("whole is not null")


@query(TOKENS + "SELECT lang, token, array_to_string(year, ' ') AS year FROM yr WHERE year IS NOT NULL", True)
def f4_years(spark, sf):
    return _tokens(spark, sf).withColumn("year", F.array_join(spoken.year(_number(), F.col("lang")), " ")).where("year is not null")


@query(TOKENS + "SELECT lang, token, array_to_string(abbr, '|') AS words FROM wd WHERE abbr IS NOT NULL", True)
def f6_abbreviations(spark, sf):
    return _tokens(spark, sf).withColumn("words", F.array_join(spoken.abbreviations(t.fold(F.col("token")), F.col("lang")), "|")).where("words is not null")


@query(TOKENS + "SELECT lang, token, array_to_string(regexp_extract_all(token, '[0-9]+'), ' ') AS runs FROM tk WHERE len(regexp_extract_all(token, '[0-9]+')) > 0", True)
def f3_digit_runs(spark, sf):
    runs = spoken.digit_runs(F.col("token"))
    return _tokens(spark, sf).where(F.size(runs) > 0).select("lang", "token", F.array_join(runs, " ").alias("runs"))


@query(TOKENS + f"SELECT lang, token, e[1][1] AS head, e[1][2] AS tail FROM (SELECT lang, token, {ELISION} AS e FROM fd) WHERE len(e) > 0", True)
def f8_elisions(spark, sf):
    e = t.elisions(t.fold(F.col("token")))
    # A fold keeps apostrophes and adds none: only tokens with one are told apart.
    return _each_token(spark, sf).where(F.col("token").contains("'")).distinct().where(F.size(e) > 0).select("lang", "token", e[0][0].alias("head"), e[0][1].alias("tail"))


@query(
    TOKENS + SPELLINGS + f""", al AS (SELECT lang, token, f, list_concat(list_concat(list_concat(list_concat(list_concat(list_concat([[f]], CASE WHEN g <> '' THEN [[g]] ELSE [] END), CASE WHEN whole IS NOT NULL THEN [[whole]] ELSE [] END), CASE WHEN year IS NOT NULL THEN [year] ELSE [] END), CASE WHEN len(regexp_extract_all(token, '[0-9]+')) > 0 THEN [regexp_extract_all(token, '[0-9]+')] ELSE [] END), CASE WHEN abbr IS NOT NULL THEN list_transform(abbr, lambda w: [w]) ELSE [] END), list_concat(CASE WHEN lang = 'en' AND sp.other IS NOT NULL THEN list_transform(sp.other, lambda w: [w]) ELSE [] END, {ELISION})) AS every FROM yr LEFT JOIN sp USING (f) WHERE f <> ''),
js AS (SELECT lang, token, list_transform(every, lambda s: array_to_string(s, ' ')) AS j FROM al)
SELECT lang, token, array_to_string(list_filter(j, lambda x, i: list_position(j, x) = i), '|') AS forms FROM js""", True)  # fmt: skip
def f9_spoken_forms(spark, sf):
    forms = F.transform(spoken.forms(F.col("token"), F.col("lang")), lambda s: F.array_join(s, " "))
    return _tokens(spark, sf).where(t.fold(F.col("token")) != "").select("lang", "token", F.array_join(forms, "|").alias("forms"))


RUNS = "runs AS (SELECT l_orderkey AS run_id, l_orderkey % 40 AS grp, sum(l_quantity)::DOUBLE AS cpu_s, count(*) * 1.5::DOUBLE AS load_s, sum(l_extendedprice)::DOUBLE / 1000 AS audio_s, sum(l_discount)::DOUBLE AS align_s, sum(l_tax)::DOUBLE + 0.01 AS asr_s, count(*) * 0.02::DOUBLE AS startup_s, round(sum(l_quantity)::DOUBLE / count(*), 4) AS efficiency FROM lineitem GROUP BY 1)"


def _runs(spark, sf):
    return read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), (F.col("l_orderkey") % 40).alias("grp")).agg(
        F.sum("l_quantity").cast("double").alias("cpu_s"), (F.count("*") * 1.5).alias("load_s"), (F.sum("l_extendedprice").cast("double") / 1000).alias("audio_s"), F.sum("l_discount").cast("double").alias("align_s"),
        (F.sum("l_tax").cast("double") + 0.01).alias("asr_s"), (F.count("*") * 0.02).alias("startup_s"), F.round(F.sum("l_quantity").cast("double") / F.count("*"), 4).alias("efficiency"),
    )


@query(f"WITH {RUNS} SELECT run_id, round(cpu_s / audio_s, 6) AS cpu_per_audio, round((cpu_s + load_s) / audio_s, 6) AS rtf_with_load, round(audio_s / cpu_s, 6) AS speed, round(cpu_s / audio_s * 0.34, 6) AS usd_per_audio_hour FROM runs")
def a27_cost_block(spark, sf):
    return costs.cost_block(_runs(spark, sf), 0.34)


@query(f"WITH {RUNS}, o AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY grp ORDER BY efficiency DESC, run_id) = 1) SELECT grp, run_id, round(align_s / asr_s, 6) AS align_to_asr, round(1 + align_s / asr_s, 6) AS multiplier, round(startup_s / (startup_s + align_s + asr_s), 6) AS startup_share, round(startup_s / (startup_s + align_s + asr_s), 6) >= 0.25 AS refused FROM o")
def a28_pipeline_cost(spark, sf):
    return costs.pipeline_cost(_runs(spark, sf))


@query("WITH s AS (SELECT user_id AS run, value, hour(ts) >= 6 AS steady FROM events), b AS (SELECT run, value, 'whole' AS window FROM s UNION ALL SELECT run, value, 'steady' FROM s WHERE steady) SELECT run, \"window\", count(*) AS n, round(avg(value), 6) AS mean, max(value) AS largest, round(max(value) - min(value), 6) AS span FROM b GROUP BY ALL")
def a29_sample_windows(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("run"), "value", (F.hour("ts") >= 6).alias("steady"))
    return costs.two_windows(e, F.col("steady"))


@query("WITH m AS (SELECT l_orderkey AS k, sum(l_extendedprice)::DOUBLE AS est FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN o_totalprice <> 0 THEN round(100.0 * (est - o_totalprice::DOUBLE) / o_totalprice::DOUBLE, 4) END AS error_pct FROM orders LEFT JOIN m ON k = o_orderkey")
def a41_estimate_error(spark, sf):
    m = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").cast("double").alias("est"))
    return read(spark, sf, "orders").join(m, "o_orderkey", "left").select("o_orderkey", costs.pct_error(F.col("est"), F.col("o_totalprice").cast("double")).alias("error_pct"))


@query("WITH c AS (SELECT event_type AS file, abs(value) AS usd FROM events), g AS (SELECT file, round(min(usd) * 9, 6) AS got_low, round(max(usd) * 9, 6) AS got_high FROM c GROUP BY 1), k AS (SELECT event_type AS file, min(abs(value)) * 9 + CASE WHEN length(event_type) % 2 = 0 THEN 0.1 ELSE 0 END AS low, max(abs(value)) * 9 AS high FROM events GROUP BY 1 UNION ALL SELECT concat(event_type, '.lost'), 0, 0 FROM events GROUP BY 1) SELECT k.file, got_low, got_high, CASE WHEN got_low IS NULL THEN 'unreadable' WHEN abs(low - got_low) <= 0.005 AND abs(high - got_high) <= 0.005 THEN 'ok' ELSE 'wrong' END AS state FROM k LEFT JOIN g USING (file)")
def a42_cost_ranges(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("file"), F.abs("value").alias("usd"))
    agg = e.groupBy("file").agg(F.min("usd").alias("a"), F.max("usd").alias("b"))
    told = agg.select("file", (F.col("a") * 9 + F.when(F.length("file") % 2 == 0, 0.1).otherwise(0.0)).alias("low"), (F.col("b") * 9).alias("high"))
    lost = agg.select(F.concat("file", F.lit(".lost")).alias("file"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    return costs.cost_range(e, told.unionByName(lost))


LABELS = "WITH l AS (SELECT doc_id % 20 AS block, quality, toxic FROM labels), g AS (SELECT block, count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c FROM l GROUP BY 1)"
_Z = "1.959963985::DOUBLE"


def _wilson(side: str) -> str:
    sign = "-" if side == "low" else "+"
    cap = "greatest({0}, 0)" if side == "low" else "least({0}, 1)"
    inner = f"(b / d + {_Z} * {_Z} / (2 * d)) / (1 + {_Z} * {_Z} / d) {sign} {_Z} * sqrt(b / d * (1 - b / d) / d + {_Z} * {_Z} / (4 * d * d)) / (1 + {_Z} * {_Z} / d)"
    return f"round_even({cap.format(inner)} * 100, 1)"


@query(f"{LABELS}, d AS (SELECT *, (b + c)::DOUBLE AS d FROM g) SELECT block, n, b, c, CASE WHEN d = 0 THEN 0 ELSE round_even((2 * {_wilson('low')} / 100 - 1) * (d / n) * 100, 1) END AS low, CASE WHEN d = 0 THEN 0 ELSE round_even((2 * {_wilson('high')} / 100 - 1) * (d / n) * 100, 1) END AS high FROM d")
def a13_paired_difference(spark, sf):
    return costs.paired_diff(read(spark, sf, "labels").withColumn("block", F.col("doc_id") % 20), "quality", "toxic", "block")


@query(f"""{LABELS}, r AS (SELECT block, 100.0::DOUBLE * (b - c) / n AS delta_pp, (b + c)::DOUBLE / n AS discordance, b::DOUBLE / n AS p1, c::DOUBLE / n AS p2 FROM g), p AS (SELECT *, CASE WHEN delta_pp / 100 >= discordance THEN 1 ELSE 0.5 * (1 + delta_pp / 100 / discordance) END AS phi, (p1 + p2) / 2 AS m FROM r)
SELECT block, CASE WHEN delta_pp > 0 AND discordance > 0 THEN ceil(round(pow(({_Z} * 0.5 + 0.8416212336::DOUBLE * sqrt(phi * (1 - phi))) / (phi - 0.5), 2) / discordance, 6)) ELSE -1 END::BIGINT AS n_paired, CASE WHEN p1 = p2 THEN -1 ELSE ceil(round(pow({_Z} * sqrt(2 * m * (1 - m)) + 0.8416212336::DOUBLE * sqrt(p1 * (1 - p1) + p2 * (1 - p2)), 2) / pow(p1 - p2, 2), 6)) END::BIGINT AS n_two FROM p""")  # fmt: skip
def a15_sample_sizes(spark, sf):
    g = costs.paired_diff(read(spark, sf, "labels").withColumn("block", F.col("doc_id") % 20), "quality", "toxic", "block")
    r = g.select("block", (100.0 * (F.col("b") - F.col("c")) / F.col("n")).alias("delta_pp"), ((F.col("b") + F.col("c")) / F.col("n")).alias("discordance"), (F.col("b") / F.col("n")).alias("p1"), (F.col("c") / F.col("n")).alias("p2"))
    return costs.sample_sizes(r).select("block", "n_paired", "n_two")


@query()
def a14_block_bootstrap(spark, sf):
    """Interval by drawing blocks again; tested against intervals of another generator's draws."""
    return costs.block_bootstrap(read(spark, sf, "labels").withColumn("block", F.col("doc_id") % 50), "quality", "toxic", "block")


RATES = "rates AS (SELECT d.lang, d.source AS voice, d.doc_id % 3 AS part, round(100.0 * sum(l.quality) / count(*), 6) AS pct FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL), pr AS (SELECT a.lang, CASE WHEN a.voice = b.voice THEN 'within' ELSE 'between' END AS kind, a.voice AS voice_a, a.part AS part_a, b.voice AS voice_b, b.part AS part_b, round(abs(a.pct - b.pct), 6) AS diff FROM rates a JOIN rates b ON a.lang = b.lang AND (a.voice < b.voice OR a.voice = b.voice AND a.part < b.part))"


def _rates(spark, sf):
    both = read(spark, sf, "documents").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return both.groupBy("lang", F.col("source").alias("voice"), (F.col("doc_id") % 3).alias("part")).agg(F.round(100.0 * F.sum("quality") / F.count("*"), 6).alias("pct"))


@query(f"WITH {RATES} SELECT * FROM pr")
def j10_voice_pairs(spark, sf):
    return costs.voice_pairs(_rates(spark, sf))


@query(f"WITH {RATES} SELECT lang, max(diff) FILTER (kind = 'within') AS floor, max(diff) FILTER (kind = 'between') AS most, count(*) FILTER (kind = 'between') AS between_pairs, count(*) FILTER (kind = 'within') AS within_pairs, CASE WHEN max(diff) FILTER (kind = 'within') IS NULL OR max(diff) FILTER (kind = 'between') IS NULL THEN 'unestablished' WHEN max(diff) FILTER (kind = 'between') > max(diff) FILTER (kind = 'within') THEN 'voices_differ' ELSE 'within_noise' END AS verdict FROM pr GROUP BY lang")
def a35_voice_verdict(spark, sf):
    return costs.voice_verdict(costs.voice_pairs(_rates(spark, sf)))


@query(DRIFT + ", n AS (SELECT lang, count(*) AS tokens FROM disp GROUP BY 1), g AS (SELECT lang, round(100.0 * count(*) / any_value(tokens), 4) AS match_pct, round(100.0 * count(*) FILTER (round(harness_ms, 4) <= 40) / any_value(tokens), 4) AS within_pct FROM w JOIN n USING (lang) GROUP BY 1) SELECT lang, CASE WHEN 100.0 - match_pct >= match_pct - within_pct THEN 'recognition' ELSE 'drift' END AS bound_by, round(within_pct - 95, 4) AS headroom FROM g".replace(", n AS", ", nn AS").replace("JOIN n USING", "JOIN nn USING"), True)
def a36_language_verdict(spark, sf):
    from lectern.operators import drift

    total = _display(spark, sf).groupBy("lang").agg(F.count("*").alias("tokens"))
    d = drift.local_drift(_placed(spark, sf), "harness").groupBy("lang").agg(F.count("*").alias("placed"), F.count_if(F.round("drift_ms", 4) <= 40).alias("ok"))
    pct = lambda c: F.round(100.0 * F.col(c) / F.col("tokens"), 4)
    return costs.language_verdict(total.join(d, "lang").select("lang", pct("placed").alias("match_pct"), pct("ok").alias("within_pct")), 95.0)


@query(", x AS (SELECT clip_id, disp_idx, cs, s, lag(cs) OVER q AS c0, lead(cs) OVER q AS c2, lag(s) OVER q AS s0, lead(s) OVER q AS s2 FROM placed WINDOW q AS (PARTITION BY clip_id ORDER BY disp_idx)), m AS (SELECT sh AS shift_ms, abs(s + sh / 1000.0::DOUBLE - (s0 + sh / 1000.0::DOUBLE + (cs - c0) / (c2 - c0) * (s2 - s0))) * 1000 AS d FROM x, range(-250, 251, 25) r(sh)) SELECT shift_ms::INT AS shift_ms, count(*) FILTER (round(d, 4) <= 250) AS within FROM m GROUP BY 1", True)
def a21_offset_sweep(spark, sf):
    from lectern.operators import drift

    return drift.offset_sweep(_placed(spark, sf))


@query("WITH s AS (SELECT doc_id, o.o_custkey AS cust_id, length(text) AS spoken, lang IN ('en', 'es', 'fr') AS routed FROM documents JOIN orders o ON o.o_orderkey = doc_id), q AS (SELECT doc_id, cust_id, count(*) AS segments, sum(spoken)::BIGINT AS spoken_characters, count(*) FILTER (routed) AS speech_available, count(*) FILTER (NOT routed) AS speech_blocked FROM s GROUP BY 1, 2) SELECT doc_id, segments, spoken_characters, ceil(spoken_characters / 1000)::BIGINT AS credits, (floor(c_acctbal) - ceil(spoken_characters / 1000))::BIGINT AS balance_after, speech_available, speech_blocked FROM q JOIN customer ON c_custkey = cust_id")
def a32_quotes(spark, sf):
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("cust_id"))
    segments = read(spark, sf, "documents").join(orders, "doc_id").select("doc_id", "cust_id", F.length("text").alias("spoken"), F.col("lang").isin(*derived.LANGUAGES).alias("routed"))
    return billing.quotes(segments, read(spark, sf, "customer").select(F.col("c_custkey").alias("cust_id"), F.col("c_acctbal").alias("balance")))
