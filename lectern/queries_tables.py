"""Queries over artifacts, ledgers, catalogues, segments and page layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import spoken
from lectern.functions import text as t
from lectern.operators import artifacts, layout, quality, segments
from lectern.plans import derived
from lectern.plans.folders import stored
from lectern.queries import FOLD, _display, _placed, _segments, query, read
from lectern.queries_contract import CONF, _confident
from lectern.queries_numbers import ELISION, TOKENS, _tokens
from lectern.sources import files


@query("SELECT doc_id, length(text) AS chars, octet_length(encode(text)) AS bytes, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS non_ascii, sha256(text) AS sha FROM documents")
def f11_text_counts(spark, sf):
    ascii_ = F.regexp_replace("text", r"[\x00-\x7F]", "")
    return read(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), F.octet_length("text").alias("bytes"), F.length(ascii_).cast("long").alias("non_ascii"), F.sha2("text", 256).alias("sha"))


@query("SELECT doc_id, sha256(replace(replace(replace(replace(text, '''', '’'), '...', '…'), ' %', ' %'), ' - ', ' – ')) AS sha FROM documents")
def f13_typography(spark, sf):
    """Texts as a book sets them: curly apostrophes, ellipses, narrow no-break spaces, dashes."""
    text = F.col("text")
    for a, b in (("'", "’"), ("...", "…"), (" %", " %"), (" - ", " – ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return read(spark, sf, "documents").select("doc_id", F.sha2(text, 256).alias("sha"))


@query("SELECT o_custkey, sha256(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey)) AS fingerprint FROM orders GROUP BY 1")
def f23_fingerprints(spark, sf):
    """One digest for each customer's sorted order tuples."""
    pairs = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(p["o_orderkey"].cast("string"), F.lit(":"), p["o_orderstatus"])), ",")
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.sha2(text, 256).alias("fingerprint"))


STATE = f", {CONF}, st AS (SELECT clip_id, disp_idx, CASE WHEN asr_conf IS NOT NULL AND match_conf IS NOT NULL THEN least(asr_conf, match_conf) END AS align_conf FROM conf), sx AS (SELECT *, CASE WHEN align_conf IS NULL THEN 'unavailable' WHEN align_conf < 0.7 THEN 'degraded' ELSE 'ok' END AS state FROM st)"


@query(STATE + "SELECT clip_id, state, count(*) AS words, round(min(align_conf), 4) AS least FROM sx GROUP BY 1, 2", True)
def f24_align_state(spark, sf):
    return artifacts.align_state(_confident(spark, sf)).groupBy("clip_id", "state").agg(F.count("*").alias("words"), F.round(F.min("align_conf"), 4).alias("least"))


@query(", n AS (SELECT clip_id, count(*) AS tokens FROM disp GROUP BY 1), p AS (SELECT clip_id, count(*) AS placed FROM placed GROUP BY 1) SELECT clip_id, CASE WHEN coalesce(placed, 0) = 0 THEN 'unavailable' WHEN 100.0 * placed / tokens < 95.4 THEN 'degraded' ELSE 'ok' END AS status FROM n LEFT JOIN p USING (clip_id)", True)
def d6_align_status(spark, sf):
    n = _display(spark, sf).groupBy("clip_id").agg(F.count("*").alias("tokens"))
    p = _placed(spark, sf).groupBy("clip_id").agg(F.count("*").alias("placed"))
    placed = F.coalesce("placed", F.lit(0))
    return n.join(p, "clip_id", "left").select("clip_id", F.when(placed == 0, "unavailable").when(100.0 * placed / F.col("tokens") < 95.4, "degraded").otherwise("ok").alias("status"))


@query("SELECT lang, round(sum(length(text)) / 1000.0, 3)::DOUBLE AS credits FROM documents GROUP BY 1")
def f25_credits(spark, sf):
    return read(spark, sf, "documents").groupBy("lang").agg(F.round(F.sum(F.length("text")).cast("decimal(18,0)") / 1000, 3).cast("double").alias("credits"))


@query(TOKENS + f", al AS (SELECT lang, f, [f] || CASE WHEN g <> '' THEN [g] ELSE [] END || CASE WHEN whole IS NOT NULL THEN [whole] ELSE [] END || CASE WHEN year IS NOT NULL THEN [array_to_string(year, ' ')] ELSE [] END || CASE WHEN g <> '' THEN [array_to_string(regexp_extract_all(token, '[0-9]+'), ' ')] ELSE [] END || coalesce(abbr, []) || list_transform({ELISION}, lambda s: array_to_string(s, ' ')) AS every FROM yr WHERE f <> ''), m AS (SELECT lang, list_max(list_transform(every, lambda x: length(x))) AS n, list_max(list_transform(every, lambda x: octet_length(encode(x)))) AS b FROM al) SELECT lang, sum(n)::BIGINT AS spoken_characters, sum(b)::BIGINT AS spoken_bytes FROM m GROUP BY 1", True)
def d7_spoken_estimate(spark, sf):
    """Characters and bytes of the longest spoken form of each distinct token."""
    joined = F.transform(spoken.forms(F.col("token"), F.col("lang")), lambda s: F.array_join(s, " "))
    each = _tokens(spark, sf).where(t.fold(F.col("token")) != "").select("lang", F.array_max(F.transform(joined, F.length)).alias("n"), F.array_max(F.transform(joined, F.octet_length)).alias("b"))
    return each.groupBy("lang").agg(F.sum("n").alias("spoken_characters"), F.sum("b").alias("spoken_bytes"))


@query("SELECT reason, source, count(*) AS spans, sum(n)::BIGINT AS characters FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN 'image_only' WHEN doc_id % 7 < 3 THEN 'footnote' ELSE 'no_text' END AS reason, source, length(text) AS n FROM documents) GROUP BY ROLLUP (reason, source)")
def a33_skip_totals(spark, sf):
    reason = F.when(F.col("doc_id") % 7 == 0, "image_only").when(F.col("doc_id") % 7 < 3, "footnote").otherwise("no_text")
    return read(spark, sf, "documents").select(reason.alias("reason"), "source", F.length("text").alias("n")).rollup("reason", "source").agg(F.count("*").alias("spans"), F.sum("n").alias("characters"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'permanent' WHEN doc_id % 4 = 1 THEN 'render_specific' WHEN doc_id % 4 = 2 THEN 'retryable' END AS permanence FROM documents")
def a38_permanence(spark, sf):
    k = F.col("doc_id") % 4
    lits = lambda *x: F.array(*map(F.lit, x))
    reasons = F.when(k == 0, lits("timeout", "image_only", "render_failed")).when(k == 1, lits("engine_error", "voice_mismatch")).when(k == 2, lits("rate_limited", "timeout")).otherwise(F.array().cast("array<string>"))
    return read(spark, sf, "documents").select("doc_id", quality.permanence(reasons).alias("permanence"))


@query("WITH k AS (SELECT DISTINCT lang AS locale, concat(source, '.', doc_id % 40) AS key FROM documents) SELECT l.locale, k.key FROM (SELECT DISTINCT locale FROM k) l CROSS JOIN (SELECT DISTINCT key FROM k) k WHERE NOT EXISTS (SELECT 1 FROM k x WHERE x.locale = l.locale AND x.key = k.key)")
def u3_key_gaps(spark, sf):
    return artifacts.key_gaps(read(spark, sf, "documents").select(F.col("lang").alias("locale"), F.concat("source", F.lit("."), (F.col("doc_id") % 40).cast("string")).alias("key")))


@query("SELECT doc_id, doc_id % 11 AS start_ord FROM documents WHERE doc_id % 6 = 2 AND doc_id % 17 = 0")
def u6_lost_spans(spark, sf):
    """Span addresses that are there and gone once verbosity is off."""
    on = read(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 11).alias("start_ord"))
    off = on.where("not (doc_id % 6 = 2 and doc_id % 17 = 0)")
    return on.join(off, ["doc_id", "start_ord"], "left_anti")


@query("WITH l AS (SELECT l_orderkey AS call_id, last(l_extendedprice ORDER BY l_linenumber, l_extendedprice)::DOUBLE AS after FROM lineitem WHERE l_orderkey % 9 <> 4 GROUP BY 1) SELECT o_orderkey AS call_id, o_totalprice::DOUBLE AS before, after, round(o_totalprice::DOUBLE - after, 2) AS charged FROM orders LEFT JOIN l ON call_id = o_orderkey")
def j17_ledger_readings(spark, sf):
    calls = read(spark, sf, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_totalprice").cast("double").alias("before"))
    ledger = read(spark, sf, "lineitem").where("l_orderkey % 9 <> 4").select(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("at"), F.col("l_extendedprice").cast("double").alias("credit"))
    return artifacts.latest_reading(calls, ledger)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN quality ELSE toxic END AS value, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'prior' END AS origin FROM labels WHERE doc_id % 3 = 0 OR doc_id % 3 = 1")
def s12_carry_forward(spark, sf):
    rows = read(spark, sf, "labels")
    return artifacts.carry_forward(rows.where("doc_id % 3 = 0").select("doc_id", F.col("quality").alias("value")), rows.where("doc_id % 3 = 1").select("doc_id", F.col("toxic").alias("value")), ["doc_id"], "value")


@query("WITH v AS (SELECT DISTINCT source AS voice, lang FROM documents), g AS (SELECT source AS voice, lang, CASE WHEN count(*) >= 12 THEN 'provisional' END AS grade FROM documents GROUP BY 1, 2) SELECT voice, lang, coalesce(grade, 'unmeasured') AS grade, CASE WHEN grade IS NULL THEN 'no evidence' END AS reason FROM v LEFT JOIN g USING (voice, lang)")
def s13_catalogue(spark, sf):
    docs = read(spark, sf, "documents").groupBy(F.col("source").alias("voice"), "lang").agg(F.count("*").alias("n"))
    return artifacts.catalogue(docs.select("voice", "lang"), docs.where("n >= 12").select("voice", "lang", F.lit("provisional").alias("grade")))


@query("WITH r AS (SELECT lang, source AS voice_class FROM documents WHERE doc_id % 15 = 0), n AS (SELECT lang, voice_class, count(*) AS n FROM r GROUP BY 1, 2) SELECT lang, voice_class, 'ambiguous' AS fault FROM n WHERE n > 1 UNION ALL SELECT DISTINCT d.lang, d.source, 'unrouted' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.lang = d.lang AND n.voice_class = d.source)")
def q16_route_faults(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "lang", F.col("source").alias("voice_class"))
    return artifacts.route_faults(docs.where("doc_id % 15 = 0").select("lang", "voice_class"), docs.select("lang", "voice_class"))


LEAVES = "leaves AS (SELECT concat('run-', l_orderkey) AS file, CASE WHEN l_linenumber % 5 = 4 THEN 'lines.1.qty' ELSE concat('lines.', l_linenumber, '.qty') END AS path, l_quantity::BIGINT::VARCHAR AS value FROM lineitem)"


def _leaves(spark, sf):
    n = F.col("l_linenumber")
    return read(spark, sf, "lineitem").select(F.concat(F.lit("run-"), F.col("l_orderkey").cast("string")).alias("file"), F.when(n % 5 == 4, "lines.1.qty").otherwise(F.concat(F.lit("lines."), n.cast("string"), F.lit(".qty"))).alias("path"), F.col("l_quantity").cast("bigint").cast("string").alias("value"))


@query(f"WITH {LEAVES}, c AS (SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 10 = 3 THEN 'run-none' ELSE concat('run-', o_orderkey) END AS file, CASE WHEN o_orderkey % 11 = 5 THEN '' ELSE concat('lines.', 1 + o_orderkey % 4, '.qty') END AS path, (o_orderkey % 50)::VARCHAR AS want FROM orders), f AS (SELECT file, path, count(*) AS n, min(value) AS value FROM leaves GROUP BY 1, 2), k AS (SELECT DISTINCT file AS known FROM leaves) SELECT claim_id, CASE WHEN c.path = '' THEN 'MALFORMED' WHEN known IS NULL THEN 'NO SUCH ARTIFACT' WHEN n IS NULL THEN 'NO SUCH KEY' WHEN n > 1 THEN concat('SELECTOR MATCHED ', n) WHEN value <> want THEN 'WRONG VALUE' ELSE 'OK' END AS status FROM c LEFT JOIN k ON known = c.file LEFT JOIN f ON f.file = c.file AND f.path = c.path")
def f17_claims(spark, sf):
    k = F.col("o_orderkey")
    claims = read(spark, sf, "orders").select(k.alias("claim_id"), F.when(k % 10 == 3, "run-none").otherwise(F.concat(F.lit("run-"), k.cast("string"))).alias("file"), F.when(k % 11 == 5, "").otherwise(F.concat(F.lit("lines."), (1 + k % 4).cast("string"), F.lit(".qty"))).alias("path"), (k % 50).cast("string").alias("want"))
    return artifacts.claim_status(claims, _leaves(spark, sf))


@query("WITH h AS (SELECT DISTINCT l_suppkey AS file, l_returnflag AS basis, round(l_quantity::DOUBLE, 1) AS value FROM lineitem), w AS (SELECT DISTINCT l_orderkey AS set_id, round(l_quantity::DOUBLE, 1) AS value FROM lineitem WHERE l_linenumber <= 3), s AS (SELECT set_id, count(*) AS size FROM w GROUP BY 1), m AS (SELECT set_id, file, basis, count(*) AS met FROM w JOIN h USING (value) GROUP BY 1, 2, 3) SELECT s.set_id, size, coalesce(max(met), 0) = size AS consistent FROM s LEFT JOIN m USING (set_id) GROUP BY 1, 2")
def f18_one_basis(spark, sf):
    rows = read(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("double").alias("value")
    return artifacts.one_basis(rows.select(F.col("l_suppkey").alias("file"), F.col("l_returnflag").alias("basis"), q), rows.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("set_id"), q))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, CASE WHEN doc_id % 2 = 1 THEN concat(lang, '-x') END) AS lang, coalesce(CASE WHEN doc_id % 3 = 0 THEN length(text) END, CASE WHEN doc_id % 3 = 1 THEN length(text) * 2 END)::BIGINT AS seconds FROM documents")
def f19_scored_rows(spark, sf):
    """Rows under either of two field names."""
    d = read(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 2 == 1, F.concat("lang", F.lit("-x"))).alias("lang_code"), F.when(F.col("doc_id") % 3 == 0, F.length("text")).alias("audio_seconds"), F.when(F.col("doc_id") % 3 == 1, F.length("text") * 2).alias("clip_seconds"))
    return d.select("doc_id", F.coalesce("lang", "lang_code").alias("lang"), F.coalesce("audio_seconds", "clip_seconds").cast("long").alias("seconds"))


@query(f"WITH {LEAVES}, lb AS (SELECT DISTINCT file, path FROM leaves WHERE value::BIGINT % 3 = 0 UNION SELECT DISTINCT file, 'lines.2' FROM leaves WHERE value::BIGINT % 5 = 0) SELECT DISTINCT l.file, l.path FROM leaves l WHERE NOT EXISTS (SELECT 1 FROM lb WHERE lb.file = l.file AND (lb.path = l.path OR starts_with(l.path, concat(lb.path, '.'))))")
def f20_unlabelled(spark, sf):
    leaves = _leaves(spark, sf)
    v = F.col("value").cast("bigint")
    labels = leaves.where(v % 3 == 0).select("file", "path").unionByName(leaves.where(v % 5 == 0).select("file", F.lit("lines.2").alias("path")))
    return artifacts.unlabelled(leaves, labels)


@query("SELECT doc_id AS path, CASE WHEN doc_id % 13 = 0 THEN 'undescribed' WHEN doc_id % 17 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'reconstructible' ELSE 'missing' END WHEN doc_id % 19 = 0 THEN 'hash_mismatch' WHEN doc_id % 23 = 0 THEN 'size_mismatch' ELSE 'ok' END AS status FROM documents")
def j16_provenance(spark, sf):
    k = F.col("doc_id")
    d = read(spark, sf, "documents").select(k.alias("path"), F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("bytes"))
    files = d.where("not (path % 17 = 0 and path % 13 <> 0)")
    manifest = d.where("path % 13 <> 0").select("path", F.when((F.col("path") % 19 == 0), F.lit("other")).otherwise(F.col("sha")).alias("sha"), F.when(F.col("path") % 23 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), (F.col("path") % 2 == 0).alias("reconstructible"))
    return artifacts.provenance(files, manifest)


@query("SELECT o_orderkey AS run_id FROM orders WHERE o_orderkey % 20 = 0 AND NOT (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))")
def q11_required_runs(spark, sf):
    """Required runs that no measured row shows."""
    wanted = read(spark, sf, "orders").where("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("run_id"))
    return wanted.join(read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_id")), "run_id", "left_anti")


@query(""", hard AS (SELECT clip_id, disp_idx, text FROM disp WHERE disp_idx % 37 = 5), j AS (SELECT h.clip_id, CASE WHEN p.disp_idx IS NULL THEN 'unmatched' WHEN p.w = h.text THEN 'verbatim' ELSE 'normalized' END AS how FROM hard h LEFT JOIN placed p ON p.clip_id = h.clip_id AND p.disp_idx = h.disp_idx) SELECT clip_id, count(*) FILTER (how = 'verbatim') AS verbatim, count(*) FILTER (how = 'normalized') AS normalized, count(*) FILTER (how = 'unmatched') AS unmatched, count(*) FILTER (how = 'unmatched') > 0 AS falsified FROM j GROUP BY 1""", True)
def a39_hard_tokens(spark, sf):
    """How each clip's hard tokens were placed; a claim of a full match with one unresolved is falsified."""
    hard = _display(spark, sf).where("disp_idx % 37 = 5").select("clip_id", "disp_idx", "text")
    both = hard.join(_placed(spark, sf).select("clip_id", "disp_idx", "w"), ["clip_id", "disp_idx"], "left")
    n = lambda c: F.count_if(c)
    lost = F.col("w").isNull()
    return both.groupBy("clip_id").agg(n(F.col("w") == F.col("text")).alias("verbatim"), n(F.col("w") != F.col("text")).alias("normalized"), n(lost).alias("unmatched"), (n(lost) > 0).alias("falsified"))


@query(r", b AS (SELECT clip_id, disp_idx, coalesce(sum(CASE WHEN e THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY disp_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block FROM (SELECT clip_id, disp_idx, regexp_matches(text, '[.!?]$') AS e FROM disp)) SELECT clip_id, block, min(disp_idx) AS first, count(*) AS words FROM b GROUP BY 1, 2", True)
def w8_sentence_blocks(spark, sf):
    return segments.sentence_blocks(_display(spark, sf))


BLOCKS = "WITH y AS (SELECT doc_id, flatten(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?\\n]*'), lambda y: list_transform(range(0, length(y), 2000), lambda i: substr(y, i + 1, 2000)))) AS s FROM documents), x AS (SELECT doc_id, unnest(s) AS sentence, unnest(range(0, len(s)))::INT AS ord FROM y) "


@query(BLOCKS + "SELECT doc_id, ord // 5 AS segment_ord, ord, coalesce(sum(length(sentence)) OVER (PARTITION BY doc_id, ord // 5 ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM x")
def d3_block_offsets(spark, sf):
    blocks = segments.sentences(read(spark, sf, "documents")).withColumn("segment_ord", F.floor(F.col("ord") / 5).cast("int"))
    return segments.block_offsets(blocks).select("doc_id", "segment_ord", "ord", F.col("offset").cast("long").alias("offset"))


@query(BLOCKS + "SELECT doc_id, ord, CASE WHEN ord % 9 = 4 THEN 0 ELSE 2 END::BIGINT AS times FROM x WHERE ord % 9 = 4 OR ord % 9 = 7")
def d2_planted_tiling(spark, sf):
    """Blocks that no segment covers, or two do: segments of one block each, with some left out and some twice."""
    blocks = segments.sentences(read(spark, sf, "documents"))
    one = blocks.select("doc_id", F.col("ord").alias("first_ord"), F.col("ord").alias("last_ord"))
    planted = one.where("first_ord % 9 <> 4").unionByName(one.where("first_ord % 9 = 7"))
    return segments.tiling_violations(planted, blocks).select("doc_id", "ord", F.col("times").cast("long").alias("times"))


# --- layout ---------------------------------------------------------------

BOXES = ", bx AS (SELECT concat_ws('-', clip_id, disp_idx // 240) AS page_id, (disp_idx % 240)::INT AS seq, text, ((disp_idx % 240) // 120) * 320.0::DOUBLE + (disp_idx % 240 % 6) * 50.0::DOUBLE AS x0, (((disp_idx % 240) // 6) % 20) * 14.0::DOUBLE + (disp_idx * 7 % 3) AS y0, length(text) AS n FROM disp), box AS (SELECT page_id, seq, text, x0, y0, x0 + least(n * 5.0, 46.0)::DOUBLE AS x1, y0 + 10.0 AS y1 FROM bx), ord AS (SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY round_even((y0 + y1) / 2 / 6.0::DOUBLE, 0), x0, seq) - 1)::INT AS place FROM box)"


def _ordered(spark, sf):
    return layout.band_order(layout.boxes(_display(spark, sf)))


@query(BOXES + "SELECT page_id, seq, place FROM ord", True)
def t2_band_order(spark, sf):
    return _ordered(spark, sf).select("page_id", "seq", "place")


@query(BOXES + ", g AS (SELECT page_id, x0, round(x0 - max(x1) OVER (PARTITION BY page_id ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS gap FROM box) SELECT page_id, x0 AS at, gap FROM g WHERE gap > 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY gap DESC, x0) = 1", True)
def w7_widest_gap(spark, sf):
    return layout.widest_gap(layout.boxes(_display(spark, sf)), "x0", "x1")


LINES = BOXES + ", ln AS (SELECT *, sum(CASE WHEN py IS NULL OR abs(y0 - py) > 6 OR x0 <= px THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY place)::BIGINT AS line FROM (SELECT *, lag(y0) OVER (PARTITION BY page_id ORDER BY place) AS py, lag(x0) OVER (PARTITION BY page_id ORDER BY place) AS px FROM ord))"


@query(LINES + "SELECT page_id, line, count(*) AS words, min(place) AS first FROM ln GROUP BY 1, 2", True)
def w6_emitted_lines(spark, sf):
    return layout.emitted_lines(_ordered(spark, sf)).groupBy("page_id", "line").agg(F.count("*").alias("words"), F.min("place").alias("first"))


@query(LINES + ", gp AS (SELECT *, coalesce(x0 - lag(x1) OVER (PARTITION BY page_id, line ORDER BY place), 0) AS gap FROM ln), li AS (SELECT page_id, line, max(gap) AS gap, count(*) AS n FROM gp GROUP BY 1, 2) SELECT page_id, round(sum(CASE WHEN gap > 15 THEN 0 ELSE n END) / sum(n), 6) AS confidence FROM li GROUP BY 1", True)
def a40_order_confidence(spark, sf):
    return layout.order_confidence(_ordered(spark, sf))


ADJ = BOXES + ", nx AS (SELECT page_id, seq, lead(seq) OVER (PARTITION BY page_id ORDER BY place) AS nx FROM ord), adj AS (SELECT page_id, count(*) AS n, round(100.0 * coalesce(avg(CASE WHEN nx IS NOT NULL THEN CASE WHEN nx = seq + 1 THEN 1.0 ELSE 0.0 END END), 1.0), 4)::DOUBLE AS adjacent_pct FROM nx GROUP BY 1)"


@query(ADJ + "SELECT page_id, n, adjacent_pct FROM adj", True)
def a22_adjacency(spark, sf):
    return layout.adjacency(_ordered(spark, sf))


@query()
def a22_order_scores(spark, sf):
    """Longest increasing run, inversions and concordance; tested against plain loops."""
    return layout.order_scores(_ordered(spark, sf))


NEAR = BOXES + ", ag AS (SELECT *, CASE WHEN seq % 4 = 1 OR seq % 17 = 3 THEN NULL ELSE seq END AS assigned, seq % 4 = 1 AS furniture FROM ord), nr AS (SELECT page_id, place, furniture, last_value(assigned IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(assigned IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM ag)"


def _assigned(spark, sf):
    s = F.col("seq")
    return _ordered(spark, sf).withColumn("assigned", F.when(~((s % 4 == 1) | (s % 17 == 3)), s)).withColumn("furniture", s % 4 == 1)


@query(NEAR + "SELECT page_id, place, before, after FROM nr", True)
def w5_nearest_assigned(spark, sf):
    return layout.nearest_assigned(_assigned(spark, sf)).select("page_id", "place", "before", "after")


@query(NEAR + ", g AS (SELECT *, sum(CASE WHEN furniture THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY place)::BIGINT AS run FROM nr), r AS (SELECT page_id, run, count(*) AS tokens, min(after) - max(before) AS step FROM g WHERE furniture GROUP BY 1, 2) SELECT page_id, run, tokens, coalesce(step > 0 AND step <= 3, false) AS inline FROM r", True)
def a24_furniture_runs(spark, sf):
    return layout.furniture_runs(_assigned(spark, sf))


@query(ADJ + ", m AS (SELECT CASE WHEN length(page_id) % 2 = 0 THEN 'digital' ELSE 'image' END AS medium, CASE WHEN n % 2 = 0 THEN 'a' ELSE 'b' END AS engine, adjacent_pct FROM adj) SELECT medium, engine, count(*) AS pages, count(*) FILTER (adjacent_pct >= 80) AS passed, min(adjacent_pct) AS low, max(adjacent_pct) AS high FROM m GROUP BY CUBE (medium, engine)", True)
def a25_pass_tally(spark, sf):
    s = layout.adjacency(_ordered(spark, sf)).select(F.when(F.length("page_id") % 2 == 0, "digital").otherwise("image").alias("medium"), F.when(F.col("n") % 2 == 0, "a").otherwise("b").alias("engine"), "adjacent_pct")
    return layout.tally(s, 80.0)


@query(ADJ + ", m AS (SELECT CASE WHEN length(page_id) % 3 = 0 THEN 'a' ELSE 'b' END AS engine, adjacent_pct >= 80 AS good, adjacent_pct AS signal FROM adj) SELECT engine, min(signal) FILTER (good) AS good_min, max(signal) FILTER (good) AS good_max, min(signal) FILTER (NOT good) AS bad_min, max(signal) FILTER (NOT good) AS bad_max, min(signal) FILTER (good) > max(signal) FILTER (NOT good) AS separates FROM m GROUP BY 1", True)
def a26_separability(spark, sf):
    s = layout.adjacency(_ordered(spark, sf)).select(F.when(F.length("page_id") % 3 == 0, "a").otherwise("b").alias("engine"), (F.col("adjacent_pct") >= 80).alias("good"), F.col("adjacent_pct").alias("signal"))
    return layout.separability(s)


FOLDED = BOXES + f", tf AS (SELECT page_id, seq, place, {FOLD.format('text')} AS f FROM ord), tr AS (SELECT page_id, seq, f FROM tf WHERE f <> ''), ot AS (SELECT page_id, place, f FROM tf WHERE f <> '' AND place % 3 = 0)"
CANDS = FOLDED + ", op AS (SELECT page_id, place, f FROM tf WHERE f <> ''), nx8 AS (SELECT page_id, seq, list(f) OVER (PARTITION BY page_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS l FROM tr), ru AS (SELECT page_id, seq, k, array_to_string(l[1:k], '') AS f FROM (SELECT page_id, seq, l, unnest(range(1, len(l) + 1)) AS k FROM nx8)), cd AS (SELECT op.page_id, op.place, ru.seq, ru.k::INT AS k FROM op JOIN ru ON ru.page_id = op.page_id AND ru.f = op.f)"


def _folded(spark, sf):
    rows = stored(_ordered(spark, sf).withColumn("f", t.fold(F.col("text"))).where("f <> ''").select("page_id", "place", "seq", "f"), "ordered")
    return rows.select("page_id", "place", "f"), rows.select("page_id", "seq", "f")


@query(CANDS + "SELECT page_id, place, count(*) AS candidates, min(seq) AS first, max(k) AS longest FROM cd GROUP BY 1, 2", True)
def j6_candidates(spark, sf):
    return layout.assign(*_folded(spark, sf)).groupBy("page_id", "place").agg(F.count("*").alias("candidates"), F.min("seq").alias("first"), F.max("k").alias("longest"))


def _cells(key: str) -> str:
    return ", ".join(f"{'lag' if s == 'b' else 'lead'}(f, {d}) OVER (PARTITION BY page_id ORDER BY {key}) AS {key}_{s}{d}" for s in "ba" for d in (1, 2, 3))


_SCORE = " + ".join(f"CASE WHEN place_{s}{d} = seq_{s}{d} THEN {w} ELSE 0 END" for s in "ba" for d, w in ((1, 4), (2, 2), (3, 1)))


@query(CANDS + f", oc AS (SELECT page_id, place, {_cells('place')} FROM op), tc AS (SELECT page_id, seq, {_cells('seq')} FROM tr), sc AS (SELECT cd.page_id, cd.place, cd.seq, {_SCORE} AS score FROM cd JOIN oc ON oc.page_id = cd.page_id AND oc.place = cd.place JOIN tc ON tc.page_id = cd.page_id AND tc.seq = cd.seq), tp AS (SELECT page_id, place, seq FROM sc QUALIFY score = max(score) OVER (PARTITION BY page_id, place)) SELECT page_id, place, CASE WHEN count(*) = 1 THEN min(seq) END AS seq FROM tp GROUP BY 1, 2", True)
def j7_resolved(spark, sf):
    return layout.resolved(*_folded(spark, sf))


_KEY = lambda k: ", ".join(f"coalesce({f'lag(f, {d})' if d > 0 else f'lead(f, {-d})' if d < 0 else 'lag(f, 0)'} OVER q, '')" for d in range(k, -k - 1, -1))


@query(FOLDED + ", ky AS (SELECT page_id, " + ", ".join(f"[{_KEY(k)}] AS k{k}" for k in (1, 2, 3, 4)) + " FROM tr WINDOW q AS (PARTITION BY page_id ORDER BY seq)), ct AS (SELECT page_id, count(*) AS n, count(DISTINCT k1) AS d1, count(DISTINCT k2) AS d2, count(DISTINCT k3) AS d3, count(DISTINCT k4) AS d4 FROM ky GROUP BY 1) SELECT page_id, CASE WHEN d1 = n THEN 1 WHEN d2 = n THEN 2 WHEN d3 = n THEN 3 WHEN d4 = n THEN 4 END AS radius FROM ct", True)
def w9_unique_radius(spark, sf):
    return layout.unique_radius(_folded(spark, sf)[1])


@query(", d AS (SELECT DISTINCT text FROM disp) SELECT text, lower(regexp_replace(strip_accents(text), '[^\\p{L}\\p{N}_'']', '', 'g')) AS f FROM d", True)
def f2b_layout_folds(spark, sf):
    return layout.layout_fold(_display(spark, sf))


@query("SELECT lang, count(*) AS tokens, count(*) FILTER (text <> strip_accents(text)) AS accented FROM disp GROUP BY 1", True)
def f16_accented(spark, sf):
    return _display(spark, sf).groupBy("lang").agg(F.count("*").alias("tokens"), F.count_if(F.col("text").rlike("[À-ÖØ-Ýà-öø-ýÿ-ďĒ-ĥ]")).alias("accented"))


# A sound file for each document: its text's bytes as samples, some behind other chunks, some with a header that declares no length.
@query("""SELECT doc_id, 12 + 24 + 8 + CASE WHEN doc_id % 3 = 0 THEN 14 ELSE 0 END + octet_length(encode(text)) AS bytes, 8000 + doc_id % 4 * 4000 AS sample_rate, 1 + doc_id % 2 AS channels, 16 AS bits,
  CASE WHEN doc_id % 5 = 0 THEN 4294967292 ELSE octet_length(encode(text)) END AS declared_data_bytes, octet_length(encode(text)) AS actual_data_bytes, round(octet_length(encode(text)) / ((8000 + doc_id % 4 * 4000) * 2 * (1 + doc_id % 2)), 10) AS seconds,
  doc_id % 5 = 0 AS header_length_bogus, CASE WHEN doc_id % 7 = 6 THEN 'no fmt or data chunk' END AS fault FROM documents WHERE doc_id % 7 <> 6
UNION ALL SELECT doc_id, 12 + CASE WHEN doc_id % 3 = 0 THEN 14 ELSE 0 END + 24, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no fmt or data chunk' FROM documents WHERE doc_id % 7 = 6""")
def s6_wav_facts(spark, sf):
    def little(n, size):
        h = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
        return F.concat(*[F.substr(h, F.lit(2 * i + 1), F.lit(2)) for i in reversed(range(size))])

    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    rate, channels, size = 8000 + d % 4 * 4000, 1 + d % 2, F.octet_length(text)
    other = F.when(d % 3 == 0, F.concat(F.lit("4C495354"), little(F.lit(5), 4), F.lit("414243444500"))).otherwise("")  # five bytes and one to make them even
    fmt = F.concat(F.lit("666D7420"), little(F.lit(16), 4), little(F.lit(1), 2), little(channels, 2), little(rate, 4), little(rate * 2 * channels, 4), little(2 * channels, 2), little(F.lit(16), 2))
    data = F.when(d % 7 == 6, "").otherwise(F.concat(F.lit("64617461"), little(F.when(d % 5 == 0, 4294967292).otherwise(size), 4), F.hex(text)))
    head = F.concat(F.lit("52494646"), little(F.lit(0), 4), F.lit("57415645"))
    found = files.wav_facts(read(spark, sf, "documents").select("doc_id", F.unhex(F.concat(head, other, fmt, data)).alias("content")))
    return found.withColumn("seconds", F.round("seconds", 10)).drop("sha256")


@query("""SELECT doc_id * 10 + k AS claim_id, CASE k WHEN 0 THEN 'OK' WHEN 1 THEN 'WRONG VALUE' WHEN 2 THEN 'NO SUCH KEY' WHEN 3 THEN 'NO SUCH ARTIFACT' WHEN 4 THEN 'NOT A LIST' WHEN 5 THEN CASE WHEN n > 2 THEN 'OK' ELSE 'NO SUCH INDEX' END
  WHEN 6 THEN 'SELECTOR MATCHED ' || (1 + (n > 1)::INT + (n > 2)::INT) WHEN 7 THEN 'OK' WHEN 8 THEN 'MALFORMED' ELSE 'AMBIGUOUS' END AS status
FROM (SELECT doc_id, least(1 + length(text) // 500, 3) AS n FROM documents), range(10) r(k) WHERE NOT (k = 6 AND n = 1)""")
def f17_written_claims(spark, sf):
    """Ten claims on the JSON of each document's figures: two folders hold one of the same name."""
    docs = read(spark, sf, "documents").select("doc_id", "lang", F.least(1 + F.floor(F.length("text") / 500), F.lit(3)).cast("int").alias("n"))
    named = lambda **fields: F.named_struct(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    clip = lambda i: named(kind=F.concat(F.lit("c"), i.cast("string")), idx=i, group=F.lit("same"), score=named(pct=i * 1.5))
    body = F.to_json(named(doc_id=F.col("doc_id"), lang=F.col("lang"), clips=F.transform(F.sequence(F.lit(1), F.col("n")), clip)))
    file = F.concat(F.lit("out/a/d"), F.col("doc_id").cast("string"), F.lit(".json"))
    both = F.explode(F.array(file, F.concat(F.lit("out/b/x"), F.col("doc_id").cast("string"), F.lit(".json")), F.concat(F.lit("out/c/x"), F.col("doc_id").cast("string"), F.lit(".json"))))
    tree = stored(artifacts.nodes(docs.select(both.alias("file"), F.parse_json(body).alias("doc"))), "nodes")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".json#"))
    texts = [
        F.concat(name, F.lit("clips[kind=c1].score.pct=1.5")), F.concat(name, F.lit("clips[0].score.pct=2")), F.concat(name, F.lit("clips[0].no=1")), F.concat(F.lit("none"), name, F.lit("lang=x")), F.concat(name, F.lit("lang[0]=x")),
        F.concat(name, F.lit("clips[2].idx=3")), F.concat(name, F.lit("clips[group=same].idx=1")), F.concat(name, F.lit("lang="), "lang"), F.concat(name, F.lit("clips[odd].idx=1")),
        F.concat(F.lit("x"), F.col("doc_id").cast("string"), F.lit(".json#lang=x")),
    ]
    claims = docs.select("doc_id", "n", F.posexplode(F.array(*texts)).alias("k", "claim")).where("not (k = 6 and n = 1)")
    return artifacts.check_claims(claims.select((F.col("doc_id") * 10 + F.col("k")).alias("claim_id"), "claim"), tree)
