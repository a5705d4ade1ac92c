"""Tables between steps, and shingles of Arrow strings as numpy arrays."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lectern.plans.folders import folder


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a session on this machine alone that names none gets a new temporary one."""
    return spark.conf.get("spark.checkpoint.dir", None) or folder(spark)


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: lineage ends there, and a lost executor costs only its own tasks."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with Arrow batches of 4 MB, so that a worker's memory doesn't depend on the texts' lengths; a session's own choice of their bytes holds."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(key, None) == "67108864b":  # as Spark comes
        conf.set(key, str(4 << 20))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def release() -> None:
    """Gives a Python worker's free memory back to the system: workers live on from task to task and share an executor's room with the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- words and shingles -----------------------------------------------------

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash base and of its inverse modulo 2**64, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, r, dtype=np.uint64)], dtype=np.uint64) for r in (_R, _R_INV)]
    return _powers[0], _powers[1]


def word_hashes(data: bytes | np.ndarray) -> np.ndarray:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes, A-Z lower-cased, in order."""
    b = np.frombuffer(data, dtype=np.uint8) if not isinstance(data, np.ndarray) else data
    if not len(b):
        return np.empty(0, dtype=np.uint64)
    gap = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.r_[True, gap, True].view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    power, inverse = powers(len(b) + 1)
    total = np.r_[np.uint64(0), np.cumsum((_LOWER[b].astype(np.uint64) + np.uint64(1)) * power[: len(b)], dtype=np.uint64)]
    return mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingle_set(data: bytes | np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words, of the whole sequence; without words, empty."""
    w = word_hashes(data)
    n = len(w)
    if not n:
        return w
    m = min(n, k)
    out = np.full(n - m + 1, np.uint64(m), dtype=np.uint64)
    for i in range(m):
        out = out * np.uint64(0xD6E8FEB86659FD93) + w[i : n - m + 1 + i]
    return np.unique(mix64(out))


def utf8(column: pa.Array) -> list[np.ndarray]:
    """Each string's UTF-8 bytes as a view of the Arrow buffer; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + column.offset + 1)[column.offset :]
    data = column.buffers()[2]
    b = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return [b[s:e] for s, e in zip(offsets[:-1], offsets[1:], strict=True)]


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All strings' UTF-8 bytes as one view of the Arrow buffer, and where each begins and the last one ends; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + column.offset + 1)[column.offset :]
    data = column.buffers()[2]
    b = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return b[offsets[0] : offsets[-1]], offsets - offsets[0]


class Memo:
    """What make(strings) gives for each of them: strings of up to `longest` characters are remembered, and of `most` and more of them those that recur."""

    def __init__(self, make: Callable[[list[str]], list], most: int, longest: int = 64):
        self.make, self.most, self.longest, self.now, self.old = make, most, longest, {}, {}

    def __call__(self, words: list[str]) -> list:
        new = [w for w in words if w not in self.now]
        if len(self.now) + len(new) > self.most:
            self.old, self.now, new = self.now, {}, words
        rest, found = [], {}
        for w in new:
            if w in self.old:
                found[w] = self.old[w]
            else:
                rest.append(w)
        found.update(zip(rest, self.make(rest), strict=True))
        self.now.update(found)
        out = [self.now[w] for w in words]
        for w in rest:
            if len(w) > self.longest:
                del self.now[w]
        return out


def spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts cut at every space: where each text's words begin and the last one's end, which of the distinct words each is, and those. Nulls are empty, an empty text is one empty word."""
    cut = pc.split_pattern(column.cast(pa.large_string()).fill_null(""), " ")
    words = cut.flatten().dictionary_encode()
    offsets = cut.offsets.to_numpy()
    return offsets - offsets[0], words.indices.to_numpy(), words.dictionary.to_pylist()


def gathered(each: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed 32-bit numbers each[i] of all i of which, one after the other, and how many come before each i and in all."""
    size = np.fromiter(map(len, each), np.int64, len(each)) // 4
    pool, start = np.frombuffer(b"".join(each), "<u4"), np.cumsum(size) - size
    count = size[which]
    before = np.r_[0, np.cumsum(count)]
    return pool[np.repeat(start[which] - before[:-1], count) + np.arange(before[-1])], before
