"""Importance resampling of documents towards a target's distribution of hashed n-grams.

An untrained pre-tokenizer, a regular expression over text whose A-Z are lower-cased, gives words
with their offsets. Windows over pairs of offsets are the n-grams; the CRC of each picks one of a
fixed number of buckets. Buckets are counted in every task and summed; a document's weight is
the mean gain of its features' buckets, and the Gumbel-perturbed weights are drawn from the top.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from lectern.llm.common import Memo, joined, map_arrow, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20
#: Characters that go to the pre-tokenizer at once: its memory per character is many times the text's.
PIECE = 1 << 15
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def cut(text: str, by: pre_tokenizers.PreTokenizer) -> list[str]:
    """The words of a lower-cased text; a long one goes piece by piece, cut between words."""
    if len(text) <= PIECE:
        return [w for w, _ in by.pre_tokenize_str(text)]
    out, at = [], 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        out += [w for w, _ in by.pre_tokenize_str(text[at:end])]
        at = end
    return out


def windows(words: list[str], n: int) -> Iterator[bytes]:
    """All runs of n words joined by one space: what lies between the start of one and the end of the n-th."""
    each = [w.encode() for w in words]
    line = memoryview(b" ".join(each))
    size = np.fromiter(map(len, each), np.int64, len(each))
    end = np.cumsum(size + 1) - 1
    for s, e in zip((end - size)[: len(each) - n + 1].tolist(), end[n - 1 :].tolist(), strict=True):
        yield line[s:e]


def _features(batches: Iterator[pa.RecordBatch], most: int, buckets: int) -> Iterator[pa.RecordBatch]:
    by = pre_tokenizers.Split(Regex(WORD), "removed", invert=True)
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    memo = Memo(lambda words: [zlib.crc32(w.encode()) % buckets for w in words], 200_000)
    for batch in batches:
        data, offsets = joined(batch.column("text"))
        low = _LOWER[data].tobytes()
        n_words, n_features, found = [], [], []
        for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            words = cut(low[s:e].decode("utf-8", "replace"), by)
            each = memo(words)
            for n in range(2, min(most, len(words)) + 1):
                each += [zlib.crc32(x) % buckets for x in windows(words, n)]
            n_words.append(len(words))
            n_features.append(len(each))
            found.append(np.array(each, dtype=kind).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "n_words", "n_features", "found"])


def features(docs: DataFrame, most: int, buckets: int) -> DataFrame:
    """doc_id, n_words, n_features and found, the buckets of a text's 1- to `most`-word features as packed numbers."""
    return docs.transform(map_arrow, lambda it: _features(it, most, buckets), "doc_id long, n_words long, n_features long, found binary")


def histogram(found: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: how often each bucket occurs; a task sends each bucket once."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for x in batch.column("found"):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return found.select("found").transform(map_arrow, count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Each bucket's gain in thousandths; the driver gets `buckets` counts of each side and no more."""
    s, t = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    for counts, found in ((s, raw), (t, target)):
        rows = histogram(found, buckets).toArrow()
        counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    all_s, all_t = int(s.sum()) + buckets, int(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((float(y + 1) * float(all_s)) / (float(x + 1) * float(all_t)))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], dtype=np.int64)


def gumbel(seed: int, doc_id: Column) -> Column:
    """Standard Gumbel noise in thousandths, from the first 32 bits of a hash of the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their number `place` in this order, from 1: sorted by ranges, numbered within each, and moved on by the sizes of the ranges before. No task gets more than a range."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ordered = table(ordered.withColumn("part", F.shiftright("at", 33)), name)
    size = ordered.groupBy("part").agg(F.count("*").alias("size"))  # a row a partition
    before = size.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return ordered.join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("part", "at", "before")


def resample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs (doc_id, text); target holds the texts (text) whose distribution is wanted.

    Features are all runs of 1 to `most` words, repeats counted. Of the rows with at least `least` words the
    floor(percent / 100) of highest score are drawn; rank is their place by score, then smaller
    doc_id, and null for all others. Null, empty and wordless texts have no features, weight 0, and
    are never drawn with least > 0. A null doc_id draws the noise of an empty id and comes after
    other ids of equal score. Repeated rows count and are ranked each, one after the other. Empty
    tables are no error: without documents there are no rows, without target texts all t are 0.
    Other columns, whatever their names, are not read.
    """
    text = F.col("text").cast("string").alias("text")
    found = table(features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), most, buckets), "features")
    wanted = table(features(target.select(F.lit(None).cast("long").alias("doc_id"), text), most, buckets), "features")
    gain, kind = gains(found, wanted, buckets), "<u2" if buckets <= 1 << 16 else "<u4"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = (gain[np.frombuffer(x.as_buffer(), kind)] for x in batch.column("found"))
            weight = [int(g.sum()) // len(g) if len(g) else 0 for g in each]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    rows = found.transform(map_arrow, weigh, "doc_id long, n_words long, n_features long, weight long")
    rows = rows.withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id"))).withColumn("open", F.col("n_words") >= least)
    order = [F.col("open").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = ranked(rows, order, "ranked")
    drawn = found.where(F.col("n_words") >= least).agg(F.floor(F.count("*") * percent / 100).cast("long").alias("drawn"))
    rank = F.when(F.col("open") & (F.col("place") <= F.col("drawn")), F.col("place").cast("long"))
    return placed.crossJoin(F.broadcast(drawn)).select("doc_id", "n_features", "weight", "score", rank.alias("rank"))  # drawn is one row
