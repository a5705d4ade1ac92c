"""Near-duplicate documents by b-bit MinHash.

Of 128 minima of a document's shingle hashes, bands of four give the candidates, and
two bits of a hash of each minimum, packed into four longs, give a collision-corrected
estimate of the similarity by bit counts. What the estimate leaves is confirmed on the
full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_arrow, mix64, shingle_set, table, utf8
from lectern.llm.links import closure, components, fetch

PERMUTATIONS, ROWS, BITS = 128, 4, 2
BANDS = PERMUTATIONS // ROWS
WIDE = 1024
#: At a true similarity of 0.75 an estimate from 128 minima of 2 bits has a deviation of 0.046, from 1024 minima one of 0.0163; 5.4 deviations below, a link is missed less than once in ten million.
MARGIN, WIDE_MARGIN = 0.25, 0.088
_draw = np.random.default_rng(20240229)
_A = _draw.integers(0, 1 << 32, PERMUTATIONS + WIDE, dtype=np.uint32) | np.uint32(1)
_B = _draw.integers(0, 1 << 32, PERMUTATIONS + WIDE, dtype=np.uint32)
PACKED, FINE = ([f"{c}{i}" for i in range(n * BITS // 64)] for c, n in (("p", PERMUTATIONS), ("w", WIDE)))
_SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>, " + ", ".join(f"{c} long" for c in PACKED)


def minima(shingles: np.ndarray, which: slice = slice(PERMUTATIONS)) -> np.ndarray:
    """A minimum under each permutation of a non-empty set of 64-bit hashes; long sets go in slices, so memory stays bounded."""
    a, b = _A[which, None], _B[which, None]
    h, low = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(h), 2048):
        low = np.minimum(low, (a * h[None, i : i + 2048] + b).min(axis=1))
    return low


def packed(low: np.ndarray, first: int = 0) -> np.ndarray:
    """Two bits of each minimum, those of 32 minima in a 64-bit word; first is the number of the first slot.

    Under a * h + b with odd a, the low bits of two minima agree in all slots or in none, so the bits
    are those of a hash of the minimum and its slot's number: unlike minima agree in a quarter of the slots.
    """
    slot = np.arange(first, first + len(low), dtype=np.uint64) << np.uint64(32)
    bits = (mix64(low.astype(np.uint64) | slot) & np.uint64(3)).reshape(-1, 32)
    return np.bitwise_or.reduce(bits << (np.arange(32, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places = np.arange(BANDS, dtype=np.uint64)[:, None]
    for batch in batches:
        n, keys, bands, packs = [], [], [], []
        for b in utf8(batch.column("text")):
            s = shingle_set(b)
            n.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            if len(s):
                low = minima(s)
                rows = low.reshape(BANDS, ROWS).astype(np.uint64)
                hashed = places
                for j in range(ROWS):
                    hashed = (hashed ^ rows[:, j : j + 1]) * np.uint64(0x9FB21C651E98DF25)
                    hashed = hashed ^ (hashed >> np.uint64(28))
                bands.append(hashed[:, 0].view(np.int64))
                packs.append(packed(low).view(np.int64))
            else:
                bands.append(None)
                packs.append(np.zeros(len(PACKED), dtype=np.int64))
        each = np.array(packs, dtype=np.int64).reshape(-1, len(PACKED))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), *map(pa.array, each.T.copy())], names=["doc_id", "n_shingles", "set_key", "bands", *PACKED])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets), 32 band hashes and the packed bits; for an empty set the bands are null and the bits 0."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_arrow, _sign, _SIGNED)


def _widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wide = [packed(minima(s, slice(PERMUTATIONS, None)), PERMUTATIONS).view(np.int64) for s in map(shingle_set, utf8(batch.column("text")))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, np.array(wide, dtype=np.int64).reshape(-1, len(FINE)).T.copy())], names=["id", *FINE])


def estimate(a: list[Column], b: list[Column]) -> Column:
    """Similarity by bit counts of two packed signatures: the share of equal slots, less the quarter of the others that is equal by chance."""
    unequal, minima = F.lit(0), len(a) * 64 // BITS
    for of_a, of_b in zip(a, b, strict=True):
        x = of_a.bitwiseXOR(of_b)
        unequal = unequal + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return (F.lit(1.0) - unequal / F.lit(float(minima)) - F.lit(0.25)) / F.lit(0.75)


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for batch in batches:
        keep = []
        for a, b, ka, kb in zip(utf8(batch.column("ta")), utf8(batch.column("tb")), *(batch.column(c).to_pylist() for c in ("ka", "kb")), strict=True):
            sets = []
            for text, key in ((a, ka), (b, kb)):
                if key not in held:
                    if len(held) > 64:
                        held.pop(next(iter(held)))
                    held[key] = shingle_set(text)
                sets.append(held[key])
            both = len(np.intersect1d(*sets, assume_unique=True))
            keep.append(100 * both >= percent * (len(sets[0]) + len(sets[1]) - both) > 0)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and set_key of each row of docs (doc_id, text).

    Documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of distinct
    5-word shingles; component_id is the smallest doc_id reachable. Null, empty and wordless
    texts have no shingles and no links. Rows that repeat a doc_id are one node with the links
    of all of them. A row without doc_id takes no part: its component_id is null, it is kept.
    An empty table gives an empty result; other columns are not read.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = table(signatures(ids), "minhash")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    nodes = some.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", *PACKED, "bands")).alias("x"))
    nodes = table(nodes.select("set_key", F.col("x.doc_id").alias("id"), "x.n_shingles", *[f"x.{c}" for c in PACKED], "x.bands"), "minhash")
    firsts = nodes.select("set_key", F.col("id").alias("first"))
    buckets = nodes.select("id", F.explode("bands").alias("key")).select("key", "id")
    floor = percent / 100

    def near(a: Callable[[str], Column], b: Callable[[str], Column], fine: bool) -> Column:
        small, large = F.least(a("n_shingles"), b("n_shingles")), F.greatest(a("n_shingles"), b("n_shingles"))
        of = lambda names: estimate([a(c) for c in names], [b(c) for c in names])
        out = (small * 100 >= large * percent) & (of(PACKED) >= floor - MARGIN)
        return out & (of(FINE) >= floor - WIDE_MARGIN) if fine else out

    live: list[DataFrame] = []

    def verify(pairs: DataFrame) -> DataFrame:
        if not live:
            shared = buckets.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key")
            wanted = buckets.join(shared, "key", "left_semi").select("id").distinct()
            firsts = nodes.join(wanted, "id", "left_semi").select(F.col("id").alias("doc_id"), "set_key")
            live.append(table(ids.join(firsts.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text", F.xxhash64("text").alias("k")).dropDuplicates(["doc_id", "k"]), "minhash"))
        a, b = live[0].select(F.col("doc_id").alias("a"), F.col("text").alias("ta"), F.col("k").alias("ka")), live[0].select(F.col("doc_id").alias("b"), F.col("text").alias("tb"), F.col("k").alias("kb"))
        return fetch(pairs, a, b).select("a", "b", "ta", "tb", "ka", "kb").transform(map_arrow, lambda it: _confirm(it, percent), pairs.select("a", "b").schema)

    def wider(wanted: DataFrame) -> DataFrame:
        texts = live[0].select(F.col("doc_id").alias("id"), "text").join(wanted, "id", "left_semi")
        return texts.transform(map_arrow, _widen, "id long, " + ", ".join(f"{c} long" for c in FINE))

    label = closure(nodes.select("id", "n_shingles", *PACKED), buckets, near, verify, "minhash", wider)
    split = some.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi").select("doc_id")
    same = table(some.join(split, "doc_id", "left_semi").join(firsts, "set_key").select(F.col("doc_id").alias("a"), F.col("first").alias("b")), "minhash")
    if not same.isEmpty():  # ids with several texts join the classes of all of them
        label = components(same.unionByName(label.select(F.col("id").alias("a"), F.col("label").alias("b"))), "minhash")
    return _named(signed, firsts, label)


def _named(signed: DataFrame, firsts: DataFrame, label: DataFrame) -> DataFrame:
    label = label.select(F.col("id").alias("first"), "label")
    return (
        signed.join(firsts, "set_key", "left").join(label, "first", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "first"))).otherwise(F.col("doc_id")).alias("component_id"), "set_key")
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "set_key")
    )
