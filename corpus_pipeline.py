"""From raw documents to token ids: each stage calls one operator and works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import byte_bpe
from lectern.llm.common import read, table
from lectern.llm.line_dedup import BANDS, drop_repeated_lines
from lectern.llm.mixing import mix
from lectern.llm.near_dedup import near_duplicates
from lectern.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs' rows whose doc_id is among ids, null like any other."""
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go, each row by its own text; null and empty texts stay."""
    return toxicity(docs, read(spark, sf_dir, "labels"), keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents made of nothing else."""
    left = drop_repeated_lines(docs.select(*COLUMNS), BANDS, 1)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest doc_id."""
    return _of(docs, near_duplicates(docs).where("kept").select("doc_id").distinct()).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture asks: once at least, at most about twice."""
    copies = mix(docs).groupBy(F.col("doc_id").alias("id")).agg(F.max("copies").cast("int").alias("copies"))
    both = docs.join(copies, docs["doc_id"].eqNullSafe(copies["id"]))
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers and digests of each row's byte-level BPE ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = byte_bpe.digests(docs, path, public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", not_toxic),
    ("line dedup", line_dedup),
    ("minhash near-dedup", near_dedup),
    ("mixing sources to target weights", mixed),
    ("byte-level bpe", token_ids),
]

#: The stages use a learned score and an edit join, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table; each result is written as Parquet and read back."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = table(docs, f"stage{i}")
    return docs
