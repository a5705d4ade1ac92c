"""Letters whose upper case is more than one letter: recognised words and what is derived from them, against SQL."""

import unicodedata

import oracle
import pytest

from lectern import registered as own
from lectern.functions import text as t
from pyspark.sql import functions as F


def test_upper_of_every_letter(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    chars = pa.table({"c": [chr(i) for i in range(1, 0x20000) if not 0xD800 <= i <= 0xDFFF and unicodedata.category(chr(i)) != "Cn"]})
    pq.write_table(chars, tmp_path / "c.parquet")
    got = {r["c"]: r["u"] for r in spark.read.parquet(str(tmp_path / "c.parquet")).select("c", t.upper(F.col("c")).alias("u")).toArrow().to_pylist()}
    assert got == dict(duckdb.sql(f"SELECT c, upper(c) FROM '{tmp_path}/c.parquet'").fetchall())


@pytest.fixture(scope="module")
def sharp(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sharp")
    # Tokens 0, 53, 106, ... are in capitals; clip 31 loses its own 0 as unmatched, and so on through the multiples of 31.
    texts = [(i, " ".join(("Straße", "ﬁn", "ŉ", "ᾳ")[(i + k) % 4] if k % 53 == 0 else f"wort{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(220)), ("en", "es", "fr")[i % 3], "web", 0) for i in range(64)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", ["s3_observed_words", "q14_perturbed_words", "j8_absent_tokens", "m5_coverage_ceiling", "j9_split_unmatched", "a4_split_rates", "q2_confidence_collapse"])
def test_words_in_capitals(spark, sharp, name):
    assert oracle.compare(spark, oracle.connect(sharp), sharp, own.QUERIES[name], own.SQL[name]) > 0
