"""Runs of words with a period, by seed and extend.

A run of period q and length l holds l - q words that equal the word q before them. Periods go
in classes whose longest is no longer than the overlap that each of their runs guarantees; the
k-grams of that overlap are the seeds. As k >= q, a k-gram inside a run comes again q words later
and never sooner, so each occurrence meets only the next one in its document: their distance is
the lag of a diagonal. Diagonals are extended to both sides, and a table of how far each lag is
covered keeps a stretch from being extended twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import joined, map_arrow

#: The least length of a run in words, and how often its period goes into it at least.
LEAST, TIMES = 6, 4
_GAPS = np.arange(256, dtype=np.uint8)
_GAPS[9:14] = 32
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words `[^\\x20\\x09-\\x0D]+` of an Arrow column of strings in order, and where each string's begin and the last one's end; nulls have none."""
    data, offsets = joined(column)
    spaced = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_GAPS[data]))
    cut = pc.split_pattern(spaced, " ")
    every, at = cut.flatten(), cut.offsets.to_numpy()
    full = pc.greater(pc.binary_length(every), 0)
    before = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))]
    return every.filter(full), before[at - at[0]]


def classes(longest: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(first period, last period, k): runs of these periods overlap their own shift in k words at least, and k is at least the last period."""
    low = 1
    while max(least, times * low) <= longest:
        k = min(max(least, times * q) - q for q in range(low, low + least + 1))
        yield low, k, k
        low = k + 1


def _repeated(keys: np.ndarray) -> np.ndarray:
    """A number for each key that occurs more than once, -1 for the others."""
    code, _ = pd.factorize(keys)
    return np.where(np.bincount(code, minlength=1)[code] > 1, code, -1) if len(code) else code


def _longer(name: np.ndarray, shift: int) -> np.ndarray:
    """Names of what two k-grams `shift` apart span together; -1 where that occurs once, as it does wherever either part does."""
    out = np.full(len(name), -1, dtype=np.int64)
    if shift < len(name):
        at = np.flatnonzero((name[: len(name) - shift] >= 0) & (name[shift:] >= 0))
        if len(at):
            out[at] = _repeated(name[at] * (int(name.max()) + 1) + name[at + shift])
    return out


def _reach(word: np.ndarray, at: int, lag: int, step: int) -> int:
    """The first place from `at` on in the direction of step (1 or -1) whose word differs from that `lag` later, or the end of all words."""
    width = 64
    while 0 <= at < len(word) - lag:
        if step > 0:
            there = np.flatnonzero(word[at : min(at + width, len(word) - lag)] != word[at + lag : at + lag + width])
            if len(there):
                return at + int(there[0])
            at = min(at + width, len(word) - lag)
        else:
            low = max(at - width + 1, 0)
            there = np.flatnonzero(word[low : at + 1] != word[low + lag : at + 1 + lag])
            if len(there):
                return low + int(there[-1])
            at = low - 1
        width = min(2 * width, 1 << 20)
    return at


def find_runs(word: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs by start, then period. word: numbers of the words of documents one after the other, none shared by two documents; longest: words of the longest document."""
    out, name, m = [], _repeated(word), 1
    for low, high, k in classes(longest, least, times):
        while 2 * m <= k:
            name, m = _longer(name, m), 2 * m
        gram = _longer(name, k - m) if k > m else name
        at = np.flatnonzero(gram >= 0)
        if not (name >= 0).any():
            break
        at = at[np.argsort(gram[at], kind="stable")]
        lag = np.diff(at)
        seed = (np.diff(gram[at]) == 0) & (lag >= low) & (lag <= high)
        place, lag = at[:-1][seed], lag[seed]
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        first = np.r_[True, (np.diff(lag) != 0) | (np.diff(place) != 1)] if len(place) else np.empty(0, bool)
        covered: dict[int, int] = {}  # by lag, the place that ends the furthest stretch seen
        for i, q in zip(place[first].tolist(), lag[first].tolist(), strict=True):
            if i < covered.get(q, 0):
                continue
            end, start = _reach(word, i + k, q, 1), _reach(word, i - 1, q, -1) + 1
            covered[q] = end
            if end + q - start >= max(least, times * q):
                out.append((start, end + q - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _scan(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, begin = words_of(batch.column("text"))
        codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        size = np.diff(begin)
        document = np.repeat(np.arange(len(size)), size)
        found = find_runs(document * (int(codes.max(initial=0)) + 1) + codes, int(size.max(initial=0)), least, times)
        start, length, period = np.array(found, dtype=np.int64).reshape(-1, 3).T
        # A word goes where a run holds it after that run's first period.
        change = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        keep = np.cumsum(change[:-1]) == 0
        kept = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(keep)][begin]), words.filter(pa.array(keep)))
        owner = document[start] if len(start) else start
        rows = pa.StructArray.from_arrays([pa.array(start - begin[owner] if len(start) else start), pa.array(length), pa.array(period)], names=["start", "length", "period"])
        runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(size) + 1)), pa.int32()), rows).cast(_RUNS)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), runs, pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs and collapsed of each row of docs (doc_id, text).

    runs: start, length and period of every stretch of words with this smallest period that is at least
    `least` words and `times` periods long and that no neighbouring word extends, by start, then
    period. collapsed: the words, joined by one space, without those that a run holds after its first
    period. Null, empty and blank texts have no words, no runs and an empty collapsed text; a null
    doc_id stays null; repeated rows give a row each; an empty table gives none; other columns,
    whatever their names, are not read. times is 3 at least, so that classes of periods grow threefold or so.
    """
    if times < 3 or least < 2:
        raise ValueError("a run is at least 2 words and 3 periods long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.transform(map_arrow, lambda it: _scan(it, least, times), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
