"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import byte_bpe, media, mixing, token_files
from lectern.llm.common import read
from lectern.llm.line_dedup import BANDS, line_classes
from lectern.llm.near_dedup import near_duplicates
from lectern.llm.periodic import periodic_runs
from lectern.llm.quality import quality
from lectern.llm.resampling import resample
from lectern.llm.secrets import find_secrets
from lectern.llm.top_k import top_k
from lectern.llm.toxicity import toxicity
from lectern.llm.url_filters import judge

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("set_key")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(read(spark, sf_dir, "documents"), BANDS, 1)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors, 10).drop("query_key")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store(read(spark, sf_dir, "documents")))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_tokens(token_files.write_tokens(read(spark, sf_dir, "documents"), WORD_BPE))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(read(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("quality = 1"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which one document in ten, by its id's CRC, repeats a stretch of its words from some place on to its end."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    trimmed = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    words = F.when((crc % 10 == 0) & (trimmed != ""), F.split(trimmed, r"[\x20\x09-\x0D]+"))
    rows = docs.select("doc_id", "text", words.alias("words"), F.floor(crc / 10).cast("long").alias("g")).withColumn("n", F.size("words"))
    a = (F.col("g") % F.col("n")).cast("int")
    p = (1 + F.floor((F.col("n") - a) / (3 + F.col("g") % 8))).cast("int")
    rows = rows.withColumn("a", a).withColumn("p", p)
    rest = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), rest)), " ")
    return rows.select("doc_id", F.when(F.col("words").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(read(spark, sf_dir, "documents")))
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("top", top)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), (-F.col("top.l")).alias("length"), F.col("top.period").alias("period"),
        F.floor(1000 * -F.col("top.l") / F.col("top.period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: (host, path, verdict), as the contract gives them.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the labels of a page's number: bad is low quality or toxic."""
    outcomes = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge(read(spark, sf_dir, "pages"), outcomes, RULES)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_minhash_near_dedup, op2_line_dedup, op3_exact_top_k, op4_media_columns, op5_secret_scans, op6_token_files, op7_toxicity, op8_byte_bpe, op9_quality, op10_mixing, op11_periodic_runs, op12_url_filters, op13_importance_resampling)
    return {f.__name__: f for f in every}


TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


URLS = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), k AS (
  SELECT doc_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id
), h AS (
  SELECT host, count(k.bad)::DOUBLE AS n, coalesce(sum(k.bad), 0)::DOUBLE AS bad, regexp_replace(host, ':[0-9]*$', '') AS name FROM p LEFT JOIN k ON p.page_id = k.doc_id GROUP BY host
), l AS (
  SELECT *, string_split(name, '.') AS labels, CASE WHEN array_to_string(string_split(name, '.')[-2:], '.') IN
    ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'co.za', 'com.ar', 'com.au', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'gov.uk', 'ne.jp', 'net.au', 'or.jp', 'org.au', 'org.uk') THEN 2 ELSE 1 END AS ends FROM h
), named AS (
  SELECT host, n, bad, CASE WHEN alone THEN name ELSE array_to_string(labels[-(ends + 1):], '.') END AS domain, CASE WHEN alone THEN name ELSE array_to_string(labels[-ends:], '.') END AS suffix
  FROM (SELECT *, regexp_matches(name, '^[0-9.]*$') OR starts_with(name, '[') OR len(labels) <= ends AS alone FROM l)
), domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY ALL), suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
whole AS (SELECT coalesce(sum(bad), 0) / greatest(coalesce(sum(n), 0), 1) AS overall FROM suffixes),
kids AS (SELECT 1 AS level, '' AS parent, n, bad FROM suffixes UNION ALL SELECT 2, suffix, n, bad FROM domains UNION ALL SELECT 3, domain, n, bad FROM named),
spread AS (SELECT level, parent, count(*) AS c, sum(n) AS nn, sum(n * n) AS n2, sum(bad) AS k, sum(bad * bad / n) AS kk FROM kids WHERE n > 0 GROUP BY ALL),
terms AS (SELECT level, sum(kk - k * k / nn) AS s, sum(k / nn * (1 - k / nn) * (c - 1)) AS chance, sum(k / nn * (1 - k / nn) * (nn - n2 / nn - c + 1)) AS room FROM spread GROUP BY level),
prior AS (SELECT level, CASE WHEN room > 0 AND s > chance THEN least(greatest(room / (s - chance) - 1, 1.0), 1e6) ELSE 1e6 END AS m FROM terms),
m AS (SELECT coalesce(max(m) FILTER (level = 1), 1e6) AS m1, coalesce(max(m) FILTER (level = 2), 1e6) AS m2, coalesce(max(m) FILTER (level = 3), 1e6) AS m3 FROM prior),
s AS (SELECT suffix, (bad + m1 * overall) / (n + m1) AS share FROM suffixes, m, whole),
d AS (SELECT domain, (bad + m2 * share) / (n + m2) AS mean FROM domains JOIN s USING (suffix), m),
r AS (SELECT host, (bad + m3 * mean) / (n + m3) AS mean, n + m3 AS size, overall FROM named JOIN d USING (domain), m, whole),
b AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (size + 1)) > 1.25 * overall AS blocked FROM r),
rules AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(rh, rp, verdict)),
hits AS (SELECT url.host, url.path, max_by(struct_pack(rule := rh || rp, verdict := verdict), length(rh || rp)) AS r
  FROM (SELECT DISTINCT host, path FROM p) url JOIN rules ON (url.host = rh OR ends_with(url.host, '.' || rh)) AND starts_with(url.path, rp) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, hits.r.rule AS rule, coalesce(hits.r.verdict, CASE WHEN b.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN b USING (host) LEFT JOIN hits ON hits.host = p.host AND hits.path = p.path
"""

RESAMPLED = r"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), texts AS (
  SELECT 'd' AS side, doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'b', NULL, 0, coalesce(text, '') FROM benchmark
), w AS (
  SELECT side, doc_id, row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts
), counted AS (SELECT side, row, word, count(*) AS n FROM (SELECT side, row, unnest(words) AS word FROM w) GROUP BY ALL),
bytes AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM counted)),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda k: (instr('0123456789ABCDEF', x[2 * k + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * k + 2]) - 1)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc
), f AS (SELECT side, row, bucket, n FROM counted JOIN hashed USING (word)),
s AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM f GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM s),
weight AS (SELECT row, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM f JOIN gain USING (bucket) WHERE side = 'd' GROUP BY row),
scored AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN weight ON w.row = weight.row WHERE side = 'd'
), placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features, weight) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_top_k": TOP_K, "op10_mixing": mixing.SQL, "op12_url_filters": URLS, "op13_importance_resampling": RESAMPLED}
