"""Segments of documents: packing, offsets, tiling, change."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENTENCE = r"[^.!?\n]+[.!?\n]*"
#: Characters of a segment at most.
CAP = 2000


def _blocks(cap: int) -> Column:
    """The sentences of a text in order; one of more than cap characters is cut every cap characters."""
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.length(x) - 1, F.lit(cap)), lambda i: F.substring(x, i + 1, F.lit(cap)))
    return F.flatten(F.transform(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)), cut))


def sentences(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """doc_id, lang, ord, sentence: what ends in a full stop, exclamation or question mark or a line's end, and pieces of at most cap characters of a longer one."""
    return docs.select("doc_id", "lang", F.posexplode(_blocks(cap)).alias("ord", "sentence"))


def _pack(batches: Iterator[pa.RecordBatch], target: int) -> Iterator[pa.RecordBatch]:
    """The segment of each size, in order: a new one when the running size would pass the target; a larger block stands alone."""
    for batch in batches:
        out = []
        for sizes in batch.column("sizes").to_pylist():
            seg, run, mine = 0, 0, []
            for n in sizes or ():
                if run and run + n > target:
                    seg, run = seg + 1, 0
                run += n
                mine.append(seg)
            out.append(mine)
        yield batch.append_column("seg", pa.array(out, pa.list_(pa.int32())))


def segment(docs: DataFrame, target: int = 1000, cap: int = CAP) -> DataFrame:
    """doc_id, lang, segment_ord, first_ord, last_ord, chars: whole sentences packed up to the target, never across documents.

    A sentence over the target stands alone; no segment has more than cap characters (cap >= target),
    since sentences() cuts what is longer. Null and empty texts have no segments.
    """
    one = docs.select("doc_id", "lang", F.transform(_blocks(cap), lambda x: F.length(x)).alias("sizes"))
    kinds = ", ".join(f"{c} {t}" for c, t in one.dtypes)
    packed = one.mapInArrow(lambda it: _pack(it, target), f"{kinds}, seg array<int>")
    rows = packed.select("doc_id", "lang", F.posexplode(F.arrays_zip(F.col("seg"), F.col("sizes").alias("n"))).alias("ord", "x"))
    return rows.groupBy("doc_id", "lang", F.col("x.seg").alias("segment_ord")).agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.sum("x.n").alias("chars"))


def block_offsets(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, segment_ord, ord, sentence) with each one's character offset in its segment."""
    w = Window.partitionBy("doc_id", "segment_ord").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("offset", F.coalesce(F.sum(F.length("sentence")).over(w), F.lit(0)))


def tiling_violations(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, ord, times: blocks that no segment covers, or several do."""
    covered = segments.select("doc_id", F.explode(F.sequence("first_ord", "last_ord")).alias("ord")).groupBy("doc_id", "ord").agg(F.count("*").alias("times"))
    both = blocks.select("doc_id", "ord").join(covered, ["doc_id", "ord"], "full")
    return both.select("doc_id", "ord", F.coalesce("times", F.lit(0)).alias("times")).where("times <> 1")


def changed(old: DataFrame, new: DataFrame, keys: list[str], content: str) -> DataFrame:
    """keys and state (added, removed, changed, same) of rows compared by a digest of their content."""
    a, b = (d.select(*keys, F.sha2(F.col(content), 256).alias(n)) for d, n in ((old, "a"), (new, "b")))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return a.join(b, keys, "full").select(*keys, state.alias("state"))


def route(docs: DataFrame, routed: tuple[str, ...] = ("en", "es", "fr")) -> DataFrame:
    """lang, status, documents: unrouted languages are counted, not dropped."""
    status = F.when(F.col("lang").isin(*routed), "ok").otherwise("blocked_language_unsupported")
    return docs.groupBy("lang", status.alias("status")).agg(F.count("*").alias("documents"))


def sentence_blocks(display: DataFrame) -> DataFrame:
    """clip_id, block, first, words: display tokens in blocks that close behind a sentence's end."""
    w = Window.partitionBy("clip_id").orderBy("disp_idx")
    block = F.coalesce(F.sum(F.col("text").rlike("[.!?]$").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return display.withColumn("block", block.cast("long")).groupBy("clip_id", "block").agg(F.min("disp_idx").alias("first"), F.count("*").alias("words"))
