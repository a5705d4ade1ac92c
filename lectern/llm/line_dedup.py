"""Line deduplication by a segment-partition edit join.

Lines within an edit distance t share one of t + 1 segments: a line is cut into t + 1
segments under keys of its length, the segment's number and its hash, and probes the keys
of every length up to t below its own with the substrings that could be such a segment.
Pairs that meet are held against each other by a parity sketch of their character pairs and
then by a banded bit-parallel edit distance. The threshold t may grow with the shorter line's
length; lines too short for it are linked where they are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import map_arrow, mix64, powers, table
from lectern.llm.links import closure, fetch

#: Edit distance of near lines, and the least length of a line that is compared at all.
DISTANCE, LEAST = 1, 20
#: Edit distance of near lines by the shorter one's least length: none below 20 characters, so that such lines are linked only where equal.
BANDS = ((0, 0), (20, 1), (128, 2), (512, 3))
SKETCH = 128
_LINES = "no_id boolean, doc_id long, row long, line_no int, n int, digest binary, keys array<long>, sketch array<long>"
#: A row without a doc_id comes last; rows of one doc_id are told apart by a hash of their texts.
_ROW = ("no_id", "doc_id", "row")


def allowed(length: int, t: int | tuple) -> int:
    """The threshold for a shorter line of this length: t itself, or that of the last of its bands (least length, threshold) that begins there or before."""
    return t if isinstance(t, int) else max((b for b in t if b[0] <= length), default=(0, 0))[1]


def most(t: int | tuple) -> int:
    return t if isinstance(t, int) else max(x for _, x in t)


def split(text: str) -> list[str]:
    return [x.strip() for x in text.split("\n")]


def segments(length: int, t: int) -> list[tuple[int, int]]:
    """(start, length) of t + 1 segments of nearly equal length, the longer ones last."""
    small, long = divmod(length, t + 1)
    out, at = [], 0
    for i in range(t + 1):
        n = small + (i >= t + 1 - long)
        out.append((at, n))
        at += n
    return out


def _plan(length: int, t: int | tuple, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and (length, segment) marks of all substrings under which a line of this length is indexed or probes."""
    found = set()
    for other in range(max(least, length - most(t)), length + 1):
        gap, d = length - other, allowed(other, t)
        if not d or gap > d:
            continue  # equal lines meet by their digest
        for i, (p, n) in enumerate(segments(other, d)):
            low = max(0, p - i, p + gap - (d - i))
            high = min(length - n, p + i, p + gap + (d - i))
            found |= {(s, s + n, other * (most(t) + 1) + i) for s in range(low, high + 1)}
    return tuple(np.array(sorted(found), dtype=np.int64).reshape(-1, 3).T)


def edits(batches: Iterator[pa.RecordBatch], t: int | tuple, least: int) -> Iterator[pa.RecordBatch]:
    plans: dict[int, tuple] = {}
    longs = pa.list_(pa.int64())
    for batch in batches:
        rows: list[tuple[tuple, int, str]] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal rows, size
            lines = [r[2] for r in rows]
            code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
            n = np.array(list(map(len, lines)), dtype=np.int64)
            start = np.cumsum(n) - n
            power, inverse = powers(len(code) + 1)
            total = np.r_[np.uint64(0), np.cumsum((code + np.uint64(1)) * power[: len(code)], dtype=np.uint64)]
            # Keys of each line's substrings.
            each = []
            for x in n.tolist():
                if x not in plans:
                    if len(plans) > 20_000:
                        plans.clear()
                    plans[x] = _plan(x, t, least)
                each.append(plans[x])
            count = np.array([len(p[0]) for p in each], dtype=np.int64)
            base = np.repeat(start, count)
            s, e, mark = (np.concatenate([p[k] for p in each]) for k in range(3))
            keys = mix64((total[base + e] - total[base + s]) * inverse[base + s] ^ mix64(mark.astype(np.uint64) + np.uint64(1))).view(np.int64)
            # Parity of each line's character pairs over 128 places.
            line = np.repeat(np.arange(len(lines)), n)
            pair = np.flatnonzero(line[1:] == line[:-1]) if len(code) else np.empty(0, np.int64)
            place = (mix64(code[pair] << np.uint64(32) | code[pair + 1]) >> np.uint64(57)).astype(np.int64)
            bits = np.bincount(line[pair] * SKETCH + place, minlength=len(lines) * SKETCH).astype(np.uint8) & 1
            sketch = np.packbits(bits.reshape(-1, 8), axis=1, bitorder="little").reshape(-1).view(np.int64)
            digest = [hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in lines]
            out = pa.RecordBatch.from_arrays([
                *(pa.array([r[0][k] for r in rows], t) for k, t in enumerate((pa.bool_(), pa.int64(), pa.int64()))), pa.array([r[1] for r in rows], pa.int32()), pa.array(n, pa.int32()), pa.array(digest, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(keys)).cast(longs),
                pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(lines) + 1, 2), pa.int32()), pa.array(sketch)).cast(longs),
            ], names=[*_ROW, "line_no", "n", "digest", "keys", "sketch"])
            rows, size = [], 0
            return out

        for *row, text in zip(*(batch.column(c).to_pylist() for c in _ROW), batch.column("text"), strict=True):
            for i, x in enumerate(split(text.as_py() or "")):
                if len(x) >= least:
                    rows.append((row, i, x))
                    size += len(x)
            if size > 1 << 19:
                yield close()
        if rows:
            yield close()


def within(a: list[str], b: list[str], t: int) -> np.ndarray:
    """Whether each pair of strings is within t edits: bit-parallel over the 2t + 1 diagonals around the main one.

    Bit k of the d-th row says that the pattern's first j - t + k characters match the text's first j
    with at most d edits; a text character moves all pairs of a batch on by one.
    """
    out = np.zeros(len(a), dtype=bool)
    order = sorted((i for i in range(len(a)) if abs(len(a[i]) - len(b[i])) <= t), key=lambda i: len(b[i]))
    at = 0
    while at < len(order):
        some = [order[at]]
        while at + len(some) < len(order) and len(some) < 4096 and (len(some) + 1) * len(b[order[at + len(some)]]) < 1 << 21:
            some.append(order[at + len(some)])
        at += len(some)
        n = np.array([len(b[i]) for i in some])
        m = np.array([len(a[i]) for i in some])
        width = int(n.max()) if len(n) else 0
        pattern, text = np.full((len(some), width + 4 * t + 2), 0xFFFFFFFF, dtype=np.uint32), np.full((len(some), width), 0xFFFFFFFE, dtype=np.uint32)
        for r, i in enumerate(some):
            pattern[r, t : t + len(a[i])] = np.frombuffer(a[i].encode("utf-32-le", "surrogatepass"), dtype="<u4")
            text[r, : len(b[i])] = np.frombuffer(b[i].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        full = (1 << (2 * t + 1)) - 1
        rows = [np.full(len(some), 1 << t, dtype=np.uint32)]
        for _ in range(t):
            rows.append((rows[-1] | rows[-1] << 1) & full)
        final = rows[t].copy()
        for j in range(1, width + 1):
            match = np.zeros(len(some), dtype=np.uint32)
            for k in range(2 * t + 1):
                match |= (pattern[:, j - 1 + k] == text[:, j - 1]).astype(np.uint32) << k
            new = [rows[0] & match]
            for d in range(1, t + 1):
                new.append(((rows[d] & match) | rows[d - 1] | rows[d - 1] >> 1 | new[d - 1] << 1) & full)
            rows = new
            final = np.where(n == j, rows[t], final)
        out[some] = (final >> (m - n + t).astype(np.uint32) & 1) == 1
    return out


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for *row, text, wanted in zip(*(batch.column(c).to_pylist() for c in _ROW), batch.column("text"), batch.column("lines").to_pylist(), strict=True):
            have = split(text.as_py() or "")
            out += [(*row, i, have[i]) for i in set(wanted) if i < len(have)]
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[*_ROW, "line_no", "line"])


def keyed(docs: DataFrame) -> DataFrame:
    """docs with what names a row: whether it has no doc_id, the doc_id or 0, and a hash of the text."""
    doc = F.col("doc_id").cast("long")
    return docs.select(doc.isNull().alias("no_id"), F.coalesce(doc, F.lit(0)).alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row"), F.col("text").cast("string").alias("text"))


def line_classes(docs: DataFrame, distance: int | tuple = DISTANCE, least: int = LEAST) -> DataFrame:
    """doc_id, row, line_no, class_doc_id, class_row, class_line_no and kept of each line of at least `least` characters of docs (doc_id, text).

    Lines are what newlines separate, without white space at either end, numbered from 0. Equal
    lines and lines within `distance` edits are linked; bands (least length, distance), such as BANDS,
    set the distance by the shorter line's length. A class is named by its first place, by
    doc_id, row and then line_no, and only the line there is kept; row is a hash of the whole text, so
    that rows of one doc_id stay apart. Rows without a doc_id come last. Rows equal in doc_id and text
    have the same places. Shorter lines, null and empty texts give no rows (with `least` 0, empty
    lines do); no documents give no rows; other columns are not read.
    """
    rows = keyed(docs)
    lines = table(rows.transform(map_arrow, lambda it: edits(it, distance, least), _LINES), "lines")
    place = F.struct(*_ROW, "line_no")
    # Equal lines meet within each task first: their first place, with what that line brings.
    firsts = lines.groupBy("digest").agg(F.min(F.struct(*_ROW, "line_no", "n", "sketch", "keys")).alias("f"))
    firsts = table(firsts.select("digest", F.struct(*[F.col(f"f.{c}").alias(c) for c in (*_ROW, "line_no")]).alias("id"), "f.n", "f.sketch", "f.keys"), "lines")
    nodes = firsts.drop("digest")
    buckets = nodes.select(F.explode("keys").alias("key"), "id")

    def near(a: Callable[[str], Column], b: Callable[[str], Column], fine: bool) -> Column:
        unlike = sum((F.bit_count(a(f"k{i}").bitwiseXOR(b(f"k{i}"))) for i in range(2)), F.lit(0))
        t = F.lit(distance) if isinstance(distance, int) else by_length(F.least(a("n"), b("n")))
        return (F.abs(a("n") - b("n")) <= t) & (unlike <= 4 * t)

    def by_length(n: Column) -> Column:
        t = F.lit(0)
        for start, d in sorted(distance):
            t = F.when(n >= start, d).otherwise(t)
        return t

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        asked = wanted.groupBy(*[F.col(f"id.{c}").alias(c) for c in _ROW]).agg(F.collect_set("id.line_no").alias("lines"))
        texts = rows.join(asked, list(_ROW)).select(*_ROW, "text", "lines").transform(map_arrow, _pick, "no_id boolean, doc_id long, row long, line_no int, line string")
        texts = table(texts.dropDuplicates([*_ROW, "line_no"]), "lines")
        a, b = texts.select(place.alias("a"), F.col("line").alias("ta")), texts.select(place.alias("b"), F.col("line").alias("tb"))

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ta, tb = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
                t = np.array([allowed(min(len(x), len(y)), distance) for x, y in zip(ta, tb, strict=True)], dtype=np.int64)
                keep = np.zeros(len(ta), dtype=bool)
                for d in np.unique(t).tolist():
                    at = np.flatnonzero(t == d)
                    keep[at] = within([ta[i] for i in at], [tb[i] for i in at], d)
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return fetch(pairs, a, b).select("a", "b", "ta", "tb").transform(map_arrow, check, pairs.select("a", "b").schema)

    label = closure(nodes.select("id", "n", *[F.col("sketch")[i].alias(f"k{i}") for i in range(2)]), buckets, near, verify, "lines").select("id", "label")
    named = firsts.select("digest", "id").join(label, "id", "left").select("digest", F.coalesce("label", "id").alias("label"))
    out = lines.select(*_ROW, "line_no", "digest").join(named, "digest").withColumn("kept", place == F.col("label"))
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "row", "line_no", F.when(~F.col("label.no_id"), F.col("label.doc_id")).alias("class_doc_id"), F.col("label.row").alias("class_row"), F.col("label.line_no").alias("class_line_no"), "kept")


def _without(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Batches whose last column names the lines to leave out; it says then whether nothing is left."""
    for batch in batches:
        out, empty = [], []
        for text, drop in zip(batch.column(at), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            kept, gone = text.as_py(), set(drop or ())
            if gone:
                kept = "\n".join(x for i, x in enumerate(kept.split("\n")) if i not in gone)
            empty.append(bool(gone) and not kept.strip())
            out.append(kept)
        cols = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(empty, pa.bool_())], names=batch.schema.names)


def drop_repeated_lines(docs: DataFrame, distance: int | tuple = DISTANCE, least: int = LEAST) -> DataFrame:
    """docs without the lines that line_classes() doesn't keep, and without documents of which nothing is left.

    Of rows equal in doc_id and text (null, empty and blank texts too) one stays. Other columns, whatever
    their names, stay as they are; no documents give none.
    """
    gone = line_classes(docs, distance, least).where("not kept").groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("lines"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    mine = docs.toDF(*names)
    doc = F.col(names[docs.columns.index("doc_id")]).cast("long")
    mine = mine.withColumn("no_id", doc.isNull()).withColumn("id", F.coalesce(doc, F.lit(0))).withColumn("row", F.xxhash64(F.col(names[at]).cast("string")))
    gone = gone.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row", "lines")
    both = mine.join(gone, ["no_id", "id", "row"], "left")
    first = F.row_number().over(Window.partitionBy("no_id", "id", "row").orderBy(F.xxhash64(*names)))
    both = both.withColumn("first", first).where("first = 1").select(*names, "lines")
    schema = ", ".join(f"`{c}` {t}" for c, (_, t) in zip(names, docs.dtypes, strict=True)) + ", lines boolean"
    return both.transform(map_arrow, lambda it: _without(it, at), schema).where("not lines").select(*names).toDF(*docs.columns)
