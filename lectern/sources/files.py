"""Sources and sinks of audio manifests and JSON artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.artifacts import nodes


def recogniser_words(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of recognised words under either set of names: w, s, e, p."""
    raw = spark.read.schema("clip_id long, w string, word string, text string, s double, start double, start_time double, e double, `end` double, end_time double, p double").json(path)
    return raw.select("clip_id", F.trim(F.coalesce("w", "word", "text")).alias("w"), F.coalesce("s", "start", "start_time").alias("s"), F.coalesce("e", "end", "end_time").alias("e"), "p")


#: Chunks of a RIFF file that are walked before its data chunk.
CHUNKS = 64


def wav_facts(files: DataFrame) -> DataFrame:
    """files (path, content) with what their RIFF chunks say, one step a chunk from the twelfth byte until the data chunk.

    sample_rate, channels, bits, declared_data_bytes, actual_data_bytes (to the end of the file, whatever the header
    declares), seconds of these, header_length_bogus, and fault: not RIFF/WAVE, or no fmt or data chunk. Chunks begin at
    even places. Nulls stand for what a faulty file doesn't tell.
    """
    content, size = F.col("content"), F.octet_length("content")

    def number(at: Column, n: int) -> Column:
        h = F.hex(F.substr(content, (at + 1).cast("int"), F.lit(n)))
        return F.conv(F.concat(*[F.substr(h, F.lit(2 * i + 1), F.lit(2)) for i in reversed(range(n))]), 16, 10).cast("long")

    name = lambda at: F.hex(F.substr(content, (at + 1).cast("int"), F.lit(4)))
    fmt, data = "666D7420", "64617461"

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        there = (at + 8 <= size) & s["data"].isNull()
        told = number(at + 4, 4)
        # Behind the data chunk, or at the file's end, the state stays as it is.
        is_fmt, is_data = there & (name(at) == fmt), there & (name(at) == data)
        return F.struct(
            F.when(there & ~is_data, at + 8 + told + told % 2).otherwise(at).alias("at"), F.when(is_fmt, at + 8).otherwise(s["fmt"]).alias("fmt"),
            F.when(is_data, at + 8).otherwise(s["data"]).alias("data"), F.when(is_data, told).otherwise(s["declared"]).alias("declared"),
        )

    none = F.lit(None).cast("long")
    start = F.struct(F.lit(12).cast("long").alias("at"), none.alias("fmt"), none.alias("data"), none.alias("declared"))
    riff = F.coalesce((F.hex(F.substr(content, F.lit(1), F.lit(4))) == "52494646") & (F.hex(F.substr(content, F.lit(9), F.lit(4))) == "57415645"), F.lit(False))
    rows = files.withColumn("w", F.when(riff, F.aggregate(F.sequence(F.lit(1), F.lit(CHUNKS)), start, step)))
    ok = F.col("w.fmt").isNotNull() & F.col("w.data").isNotNull()
    f = F.col("w.fmt")
    rows = rows.withColumns({"channels": F.when(ok, number(f + 2, 2)), "sample_rate": F.when(ok, number(f + 4, 4)), "align": F.when(ok, number(f + 12, 2)), "bits": F.when(ok, number(f + 14, 2))})
    align = F.when(F.col("align") > 0, F.col("align")).otherwise(F.greatest(F.floor(F.col("channels") * F.col("bits") / 8), F.lit(1)))
    actual = F.when(ok, size - F.col("w.data"))
    return rows.select(
        *[c for c in files.columns if c != "content"], size.cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), "sample_rate", "channels", "bits",
        F.when(ok, F.col("w.declared")).alias("declared_data_bytes"), actual.cast("long").alias("actual_data_bytes"), F.when(F.col("sample_rate") > 0, actual / (F.col("sample_rate") * align)).alias("seconds"),
        (F.col("w.declared") != actual).alias("header_length_bogus"), F.when(~riff, "not RIFF/WAVE").when(~ok, "no fmt or data chunk").alias("fault"),
    )


def audio_manifest(spark: SparkSession, path: str, reconstructible: Column | None = None) -> DataFrame:
    """A row for every file under path: its size, hash and facts, seconds to the hundredth, and whether it can be made again."""
    facts = wav_facts(spark.read.format("binaryFile").load(path).select("path", "content"))
    again = F.lit(False) if reconstructible is None else reconstructible
    return facts.withColumn("seconds", F.round("seconds", 2)).withColumn("header_bogus", F.col("header_length_bogus")).withColumn("reconstructible", again)


def flat_words(spark: SparkSession, path: str) -> DataFrame:
    """clip_id, w, s, e, p of JSON lines whose words stand in their segments, or beside them.

    A line with timings of segments only is an error and never taken for words: what reads this fails.
    """
    word = "struct<w: string, word: string, s: double, start: double, e: double, `end`: double, p: double>"
    raw = spark.read.schema(f"clip_id long, words array<{word}>, segments array<struct<start: double, `end`: double, text: string, words: array<{word}>>>").json(path)
    inside = F.flatten(F.transform(F.filter("segments", lambda s: s["words"].isNotNull()), lambda s: s["words"]))
    rows = raw.select("clip_id", F.when(F.size(inside) > 0, inside).otherwise(F.col("words")).alias("x"))
    checked = F.when(F.coalesce(F.size("x"), F.lit(0)) > 0, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("no word timings in clip "), F.coalesce(F.col("clip_id").cast("string"), F.lit("?")))))
    one = rows.select("clip_id", F.explode(checked).alias("x"))
    return one.select("clip_id", F.trim(F.coalesce("x.w", "x.word")).alias("w"), F.coalesce("x.s", "x.start").alias("s"), F.coalesce("x.e", "x.end").alias("e"), "x.p")


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Every node of a folder's JSON files, however deep, keyed by the file's full path; what isn't JSON has one null node."""
    docs = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return nodes(docs.select(F.col("_metadata.file_path").alias("file"), F.coalesce(F.expr("try_parse_json(value)"), F.expr("parse_json('null')")).alias("doc")))


def write_artifact(df: DataFrame, path: str, order: list[str]) -> None:
    """Overwrites a folder of JSON lines, in a stable order."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)
