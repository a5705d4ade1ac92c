"""Empty tables, null and repeated rows, and clashing columns in operators whose tests lacked them."""

import public_tokenizers

from lectern.llm import byte_bpe, media, token_files
from lectern.llm.resampling import resample
from lectern.llm.url_filters import judge

ROWS = [(1, "a b", "x", 1), (1, "a b", "x", 1), (None, "c", "y", 2), (2, None, None, None), (3, "", "z", 0)]
SHAPE = "doc_id long, text string, n_tokens string, feature int"


def test_media(spark):
    df = spark.createDataFrame(ROWS, SHAPE)
    got = media.describe(media.store(df))
    rows = got.collect()
    assert len(rows) == 5 and sum(r.doc_id is None for r in rows) == 1
    assert len({r.payload_sha256 for r in rows if r.doc_id in (2, 3)}) == 1  # null and empty texts are the same payload
    assert media.describe(media.store(df.limit(0))).count() == 0


def test_byte_bpe(spark):
    df = spark.createDataFrame(ROWS, SHAPE)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = byte_bpe.digests(df, path, public_tokenizers.PATTERN).collect()
    assert len(got) == 5 and {r.n_tokens for r in got if r.doc_id in (2, 3)} == {0}
    assert byte_bpe.digests(df.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_token_files(spark):
    df = spark.createDataFrame([r for r in ROWS if r[0] is not None], SHAPE)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_files.read_tokens(token_files.write_tokens(df, path)).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2, 3] and sorted(r.start for r in got)[0] == 0
    assert token_files.read_tokens(token_files.write_tokens(df.limit(0), path)).count() == 0


def test_new_operators_on_nulls(spark):
    nulls = spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")
    assert [(r.n_features, r.weight, r["rank"]) for r in resample(nulls, nulls).collect()] == [(0, 0, None)] * 3
    pages = spark.createDataFrame([(None, None)] * 3, "page_id long, url string")
    got = judge(pages, spark.createDataFrame([(None, None)], "page_id long, bad boolean"), []).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [("", "", None, "allow")] * 3
