"""Token ids of documents in files of compressed byte or bit planes.

A file is a run of fixed-size blocks of 32-bit ids. A block is transposed into planes (all
lowest bytes, then all second bytes, ...; or single bits), each compressed with zstandard.
Behind the blocks stands the chunk index: every plane's place and size, and the documents
with their numbers of ids. The last bytes say where the index begins.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import Memo, gathered, joined, map_arrow, spaced, table

MAGIC = b"IDPLANE1"
BLOCK, SHARD, END = 1 << 15, 1 << 20, 1
#: Words whose ids a Python worker remembers in each of two halves; bounds its memory only.
MEMO = 250_000


def planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """A block's 4 byte planes or 32 bit planes."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        return [x.tobytes() for x in np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")]
    return [x.tobytes() for x in np.ascontiguousarray(raw.T)]


def unplanes(parts: list[bytes], n: int, bits: bool) -> np.ndarray:
    if bits:
        each = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in parts])
        return np.ascontiguousarray(np.packbits(each.T, axis=1, bitorder="little")).view("<u4").ravel()
    return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in parts]).T).view("<u4").ravel()


def encode_file(ids: np.ndarray, docs: list[tuple[int | None, int]], bits: bool = False, block: int = BLOCK) -> bytes:
    """A file's bytes. docs: (doc_id, number of ids), in the order of ids."""
    pack, out, index, at = zstandard.ZstdCompressor(level=3), [MAGIC], [], len(MAGIC)
    for i in range(0, len(ids), block):
        sizes = []
        for p in planes(ids[i : i + block], bits):
            out.append(pack.compress(p))
            sizes.append(len(out[-1]))
        index.append([at, min(block, len(ids) - i), sizes])
        at += sum(sizes)
    end = pack.compress(json.dumps({"bits": bits, "blocks": index, "docs": docs}).encode())
    return b"".join([*out, end, struct.pack("<QI", at, len(end)), MAGIC])


def decode_file(data: bytes) -> tuple[np.ndarray, list[tuple[int | None, int]]]:
    """The ids and (doc_id, number of ids) of a file; a block can be read alone by the index."""
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("not a file of id planes")
    at, size = struct.unpack("<QI", data[-20:-8])
    unpack = zstandard.ZstdDecompressor()
    index = json.loads(unpack.decompress(data[at : at + size]))
    parts = []
    for place, n, sizes in index["blocks"]:
        each = []
        for s in sizes:
            each.append(unpack.decompress(data[place : place + s]))
            place += s
        parts.append(unplanes(each, n, index["bits"]))
    return np.concatenate(parts) if parts else np.empty(0, "<u4"), [tuple(x) for x in index["docs"]]


#: Signs cut off the letter before them: the tokenizer never joins the two, nor do they compose with what may stand before.
_SIGNS = np.zeros(256, dtype=bool)
_SIGNS[list(b".,;:!?*$%#")] = True
_UPPER = np.arange(256) - 65 < 26
_UPPER[:65] = False
_LETTER = _UPPER | np.roll(_UPPER, 32)


def plain(texts: pa.Array) -> pa.Array:
    """Texts with fewer distinct words and the same ids: spaces for newlines and tabs and between an ASCII letter and a sign, lower-case ASCII letters.

    A capital before a non-ASCII character may compose with it and stays; so do all where `<|` could begin a special token.
    """
    b, moved = joined(texts)
    if not len(b):
        return texts
    b = b.copy()
    b[(b == 9) | (b == 10)] = 32
    cut = np.flatnonzero(_LETTER[b[:-1]] & _SIGNS[b[1:]]) + 1
    if not pc.any(pc.match_substring(texts, "<|")).as_py():
        b[_UPPER[b] & (np.r_[b[1:], np.uint8(0)] < 128)] += 32
    cut = cut[~np.isin(cut, moved)]  # a text's first character has none before it
    moved = moved + np.searchsorted(cut, moved)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(moved), pa.py_buffer(np.insert(b, cut, 32)))


class Words:
    """Ids by the library, of whole texts word by word: the tokenizer drops white space and merges nothing across it."""

    #: Stands between words that are encoded in one call; a word that has it goes alone.
    BETWEEN = "\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), Memo(self._encode, MEMO)
        self.between = self._ids([self.BETWEEN])[0].tolist()
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, dtype=bool)
        self.ends[[i for w, i in names.items() if w.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, words: list[str]) -> list[bytes]:
        """Each word's packed ids. Words of Latin letters alone have one end of word each and are cut there; others stand between marks."""
        out: dict[str, bytes] = {}
        latin = [w for w in words if w.isalpha() and max(w) < "\u0250"]
        for i in range(0, len(latin), 1000):
            some = latin[i : i + 1000]
            (ids,) = self._ids([" ".join(some)])
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                out.update(zip(some, self._cut(ids, ends.tolist(), 0), strict=True))
        rest = [w for w in words if w not in out]
        if len(self.between) == 1:
            some = [w for w in rest if self.BETWEEN not in w]
            for i in range(0, len(some), 1000):
                part = some[i : i + 1000]
                (ids,) = self._ids([f" {self.BETWEEN} ".join(part)])
                ends = np.flatnonzero(ids == self.between[0]).tolist()
                if len(ends) == len(part) - 1:
                    out.update(zip(part, self._cut(ids, [*ends, len(ids)], 1), strict=True))
        rest = [w for w in rest if w not in out]
        out.update(zip(rest, (x.tobytes() for x in self._ids(rest)), strict=True))
        return [out[w] for w in words]

    @staticmethod
    def _cut(ids: np.ndarray, ends: list[int], skip: int) -> Iterator[bytes]:
        raw, at = ids.tobytes(), 0
        for end in ends:
            yield raw[4 * at : 4 * end]
            at = end + skip

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in order, and how many come before each text and in all."""
        start, which, words = spaced(plain(texts))
        ids, before = gathered(self.memo(words), which)
        return ids, before[start]


_words: dict[str, Words] = {}


def held_words(tokenizer: str) -> Words:
    """This Python worker's Words of a tokenizer, kept from task to task."""
    if tokenizer not in _words:
        _words[tokenizer] = Words(tokenizer)
    return _words[tokenizer]


def write_tokens(docs: DataFrame, tokenizer: str, bits: bool = False) -> DataFrame:
    """Files of the ids of docs (doc_id, text) in ascending doc_id order: part, shard, n_ids, content.

    Each document's ids are followed by the end id. A range partitioning by doc_id gives parts in
    order; a part's shards close at a document's end beyond a million ids. Null doc_ids come first,
    equal ones in no set order; null texts are empty and have the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = held_words(tokenizer)
        end = np.array([END], "<u4")
        part, shard, ids, held, n = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            content = encode_file(np.concatenate(ids), held, bits)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([shard], pa.int64()), pa.array([n], pa.int64()), pa.array([content], pa.large_binary()).cast(pa.binary())], names=["part", "shard", "n_ids", "content"])

        for batch in batches:
            every, start = words(batch.column("text"))
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), start[:-1].tolist(), start[1:].tolist(), strict=True):
                ids += [every[a:b], end]
                held.append((doc, b - a + 1))
                n += b - a + 1
                if n >= SHARD:
                    yield close()
                    shard, ids, held, n = shard + 1, [], [], 0
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key, "text")
    return table(ordered.transform(map_arrow, run, "part long, shard long, n_ids long, content binary"), "ids")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and crc32 of each document's ids, from the files' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, content in zip(batch.column("part"), batch.column("shard"), batch.column("content"), strict=True):
                ids, docs = decode_file(content.as_py())
                size = np.array([n for _, n in docs], dtype=np.int64)
                at = np.cumsum(size) - size
                crc = [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(at, size, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(docs), pa.int64()), pa.array([shard.as_py()] * len(docs), pa.int64()), pa.array([d for d, _ in docs], pa.int64()), pa.array(at, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = files.select("part", "shard", "content").transform(map_arrow, run, "part long, shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.select("part", "shard", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("within")).join(parts, "part")
    return found.join(shards, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("within") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
