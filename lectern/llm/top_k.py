"""Exact top-k by inner product with norm buckets.

Candidates are sorted by length into buckets. A query's k-th best score so far, over its
length and a bucket's longest vector, is the cosine that a better candidate of the bucket
needs. Buckets whose cosine is beyond 1 are left out whole; in the others, either the
vectors' lengths or the feasible range of the query's largest coordinate prunes, whichever
the local cosine favours; what is left is verified by its product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import map_arrow, table

BUCKET, QUERIES, SCALE = 2048, 256, 1024
#: From this local cosine on, coordinates prune better than lengths.
COORDINATE = 0.7
_BLOCK = "block long, dim int, longest double, ids binary, sums binary, vectors binary"


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, v (floor(1024 x) as longs), dim and norm; without vectors that are null, empty or hold null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    v = F.transform(x, lambda e: F.floor(e * F.lit(float(SCALE))))
    good = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0").where(~bad)
    out = good.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size("embedding").alias("dim"))
    return out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    part, count = TaskContext.get().partitionId(), 0
    held: list[tuple] = []

    def close() -> pa.RecordBatch:
        nonlocal count, held
        rows, held = held, []
        count += 1
        one = [(part << 32) + count, rows[0][2], max(r[3] for r in rows), np.array([r[0] for r in rows], "<i8").tobytes(), np.array([r[3] for r in rows], "<f8").tobytes(), np.array([r[1] for r in rows], "<i8").tobytes()]
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, kinds, strict=True)], names=["block", "dim", "longest", "ids", "sums", "vectors"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "v", "dim", "norm")), strict=True):
            if held and (held[0][2] != row[2] or len(held) == size):
                yield close()
            held.append(row)
    if held:
        yield close()


def blocks(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Vectors of one dimension and like length side by side, up to size in a row, longest first."""
    order = [F.col("dim").asc(), F.col("norm").desc()]
    return table(vectors.repartitionByRange(*order, F.col("vec_id").asc()).sortWithinPartitions(*order, "vec_id").transform(map_arrow, lambda it: _blocks(it, size), _BLOCK), name)


def _arrays(ids: bytes, sums: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(sums, "<f8"), np.frombuffer(vectors, "<i8").reshape(-1, dim)


def _products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while every sum fits 53 bits."""
    if v.size and float(np.abs(v).max()) * float(np.abs(q).max()) * v.shape[1] < 2**53:
        return (v.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return v @ q


def bucket_top(q: np.ndarray, q_norm: float, least: float, ids: np.ndarray, norms: np.ndarray, v: np.ndarray, unit: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The up to k best (ids, scores) of a bucket (longest first) that can score least or more."""
    pick = np.arange(len(ids))
    if least > 0 and q_norm > 0:
        need = least / q_norm
        local = need / norms[0] if norms[0] > 0 else np.inf
        if local > 1 + 1e-9:
            return ids[:0], ids[:0]
        if local < COORDINATE:
            pick = pick[: np.searchsorted(-norms, -need * (1 - 1e-9), side="right")]
        else:
            f = int(np.abs(q).argmax())
            c = q[f] / q_norm
            wide = np.sqrt(max(0.0, (1 - local * local) * (1 - c * c))) + 1e-9
            low = c * local - wide if c > -local else -2.0
            high = c * local + wide if c < local else 2.0
            pick = np.flatnonzero((unit[:, f] >= low) & (unit[:, f] <= high))
    pick = pick[ids[pick] != own]
    score = _products(v[pick], q)
    if least > -np.inf:
        pick, score = pick[score >= least], score[score >= least]
    best = np.lexsort((ids[pick], -score))[:k]
    return ids[pick][best], score[best]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best integer inner products, ties to the smaller vec_id.

    queries and candidates have vec_id and embedding. A query isn't its own candidate; it is held
    against candidates of its own dimension only. Vectors null, empty or with null or non-finite
    components and rows without vec_id take no part. Repeated candidate rows count each; equal
    query rows count once, and different vectors of one query id are told apart by query_key.
    Fewer than k candidates give fewer rows; no rows give no rows.
    """
    found = blocks(integers(candidates), BUCKET, "buckets")
    asked = integers(queries).dropDuplicates(["vec_id", "v"])
    asked = blocks(asked, QUERIES, "queries").select("block", "dim", *[F.col(c).alias(f"q_{c}") for c in ("ids", "sums", "vectors")])
    # The first bucket of each dimension, its longest vectors, gives every query a first k-th score.
    first = found.join(found.groupBy("dim").agg(F.max(F.struct("longest", -F.col("block")))["col2"].alias("top")), "dim").where("-block = top").drop("top", "block")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qi, qn, qv = _arrays(r["q_ids"], r["q_sums"], r["q_vectors"], r["dim"])
                ids, norms, v = _arrays(r["ids"], r["sums"], r["vectors"], r["dim"])
                unit = v / np.maximum(norms, 1e-300)[:, None]
                least = []
                for i in range(len(qi)):
                    score = bucket_top(qv[i], qn[i], -np.inf, ids, norms, v, unit, qi[i], k)[1]
                    least.append(float(score[-1]) if len(score) == k else -np.inf)
                least = np.array(least)
                need = np.where((least > 0) & (qn > 0), least / np.maximum(qn, 1e-300), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([need.min() * (1 - 1e-9)], pa.float64()), pa.array([least.astype("<f8").tobytes()], pa.binary())], names=["block", "need", "least"])

    bound = asked.join(first, "dim").transform(map_arrow, begin, "block long, need double, least binary")
    asked = table(asked.join(bound, "block"), "queries")
    # Query blocks go to every shard of their dimension, buckets to one: as many shards as 16 buckets each need.
    shards = F.ceil(F.count("*") / F.lit(4)).cast("int").alias("shards")
    split = found.join(found.groupBy("dim").agg(shards), "dim").withColumn("shard", F.pmod(F.xxhash64("block"), F.col("shards")))
    spread = asked.join(found.groupBy("dim").agg(shards), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards").cast("long") - 1))).drop("shards")
    near = spread.join(split.drop("block", "shards"), ["dim", "shard"]).where("longest >= need")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qi, qn, qv = _arrays(r["q_ids"], r["q_sums"], r["q_vectors"], r["dim"])
                ids, norms, v = _arrays(r["ids"], r["sums"], r["vectors"], r["dim"])
                least, unit, out = np.frombuffer(r["least"], "<f8"), v / np.maximum(norms, 1e-300)[:, None], []
                for i in range(len(qi)):
                    got, score = bucket_top(qv[i], qn[i], least[i], ids, norms, v, unit, qi[i], k)
                    if len(got):
                        out.append((np.full(len(got), qi[i]), np.full(len(got), (r["block"] << 9) + i), got, score))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=["query_id", "query_key", "vec_id", "score"])

    hits = near.transform(map_arrow, search, "query_id long, query_key long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_key").orderBy(F.col("score").desc(), F.col("vec_id").asc()))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "query_key")
