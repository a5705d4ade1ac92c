"""Texts as media columns: bytes stored as lossless WebP images, read back, and described."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import webp
from lectern.llm.common import map_arrow, table, utf8

LINE, TALLEST = 64, 1 << 14
#: Share of windows seen before from which copies are looked for.
REPEATED = 0.3


def _bits(values: np.ndarray) -> float:
    """The bits of values in an ideal code of their own frequencies."""
    n = np.bincount(values)
    n = n[n > 0]
    return float((n * np.log2(len(values) / n)).sum())


def _repeats(data: np.ndarray) -> float:
    """The share of 8-byte windows that have come before, by a hash."""
    if len(data) < 16:
        return 0.0
    b = np.ascontiguousarray(data)
    windows = np.ndarray((len(b) - 7,), "<u8", buffer=b.data, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    windows.sort()
    return float((windows[1:] == windows[:-1]).mean())


def choose(data: np.ndarray) -> dict:
    """How to encode a payload, by its numbers: the palette where pixels bundle by it (up to 16 values), copies where much repeats, the left pixel as predictor where steps take fewer bits than values."""
    if np.count_nonzero(np.bincount(data, minlength=256)) <= 16:
        return {"palette": True}
    if _repeats(data) >= REPEATED:
        return {"copies": True}
    steps = np.diff(data, prepend=data[:1])  # modulo 256
    return {"predict": True} if _bits(steps) < _bits(data) else {}


def to_image(data: bytes | np.ndarray) -> bytes:
    """A WebP file whose green samples are the bytes, zero-padded to a positive multiple of 64, in rows; choose() sets the transforms.

    Rows have 64 samples, more where the image would be too tall; a chunk PLEN then has the payload's length.
    """
    n = max(LINE, -(-len(data) // LINE) * LINE)
    width = LINE * -(-n // (LINE * TALLEST))
    green = np.zeros((-(-n // width), width), dtype=np.uint8)
    green.reshape(-1)[: len(data)] = np.frombuffer(data, np.uint8)
    how = choose(green.reshape(-1)[:n])
    if how.pop("predict", False):
        how |= {"predict": np.ones((-(-len(green) // 512), -(-width // 512)), dtype=np.uint8), "shift": 9}
    argb = green.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)
    return webp.encode(None, argb=argb, more={} if argb.size == n else {b"PLEN": struct.pack("<Q", n)}, **how)


def from_image(data: bytes) -> np.ndarray:
    """The payload of to_image(), from the decoded pixels."""
    green = (webp.decode(data, as_numbers=True) >> np.uint32(8)).astype(np.uint8).ravel()
    size = webp.chunks(data).get(b"PLEN")
    return green[: struct.unpack("<Q", size)[0]] if size else green


def features(payload: np.ndarray) -> str:
    """Whole numbers of the samples: sum, least, largest, how many differ, the commonest, and the sum of steps between neighbours."""
    count = np.bincount(payload, minlength=256)
    used = np.flatnonzero(count)
    steps = int(np.abs(np.diff(payload.astype(np.int64))).sum())
    return f"sum={int(payload.sum(dtype=np.int64))};min={used[0]};max={used[-1]};distinct={len(used)};mode={int(count.argmax())};steps={steps}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of each row of docs (doc_id, text), written as a table; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            for i in range(0, len(texts), 256):
                part = texts[i : i + 256]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 256), pa.array([len(b) for b in part], pa.int64()), pa.array([to_image(b) for b in part], pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return table(rows.transform(map_arrow, run, "doc_id long, n_bytes long, media binary"), "media")


_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of each stored image, from its decoded pixels. Equal texts give equal values, empty ones those of 64 zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m in batch.column("media"):
                data = m.as_py()
                p = from_image(data)
                raw = p.tobytes()
                out.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-LINE:]), len(data), hashlib.sha256(data).hexdigest(), features(p)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *cols], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.transform(map_arrow, run, _OUT)
