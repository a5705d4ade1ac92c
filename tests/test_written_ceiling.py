"""The registered ceiling asks for words written like a token, as its SQL does: a group of digits gives none."""

import pytest

import oracle
from lectern import registered as own

# The recogniser drops 200 to 207 of 400 tokens: "+1" at 201, which only the group +1, 555 makes of 1555.
TEXT = " ".join({10: "1555", 12: "nineteen", 13: "eighty", 14: "four", 15: "doctor", 201: "+1", 202: "555", 204: "1984", 206: "Dr."}.get(i, f"w{chr(97 + i % 26)}") for i in range(210))


@pytest.mark.parametrize("name", ["j8_absent_tokens", "m5_coverage_ceiling"])
def test_as_the_sql(spark, tmp_path, name):
    spark.createDataFrame([(3, "en", TEXT), (4, "fr", TEXT)], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = oracle.connect(str(tmp_path))
    assert oracle.compare(spark, con, str(tmp_path), own.QUERIES[name], own.SQL[name])
    gone = {r[0] for r in con.execute(own.SQL["j8_absent_tokens"].replace("SELECT clip_id, lang, disp_idx, text FROM gone", "SELECT text FROM gone")).fetchall()}
    assert {"+1", "1984", "Dr."} <= gone
