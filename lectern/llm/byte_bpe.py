"""Byte-level BPE encoding and decoding.

A text's pieces are the matches of the tokenizer's pattern. The commonest distinct pieces of
the corpus, counted over all of it, are folded by ranked merges with Spark's higher-order
functions: a piece's bytes, one character each in ISO-8859-1, and each step joins the adjacent
pair of the lowest rank. The ranks stand in a literal array of small maps, found by a hash.
Texts are then put together from the folded pieces in map tasks; pieces too rare to be held
are merged where they occur, many at once, by the same rule. Decoding concatenates the ids' byte strings.
"""

from __future__ import annotations

import base64
import functools
import heapq
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import Memo, gathered, joined, map_arrow, table

#: Slots of the literal array; pieces held ready, and their longest length in bytes, so at most 16 MB are broadcast.
SLOTS, READY, LONGEST = 1 << 15, 1 << 17, 64
#: Pieces a Python worker counts before it passes them on, and pieces it remembers in each of two halves; these bound its memory only.
HELD, MEMO = 200_000, 60_000
#: Rows a map task hands back at a time, and bytes of whole texts it cuts at a time.
STEP, SPAN = 256, 1 << 19
NONE, ROOM = 2**31 - 1, 1 << 30
#: Stands at both ends of the parts; no piece in ISO-8859-1 has it.
MARK = "\u0100"


def ranks(path: str) -> dict[bytes, int]:
    """A rank file's table of byte strings."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def slot(key: Column) -> Column:
    return F.crc32(key.cast("binary")).bitwiseAND(F.lit(SLOTS - 1))


def constant(one: DataFrame, kind: str, name: str) -> Column:
    """The single value of a one-row DataFrame as a literal: a session variable, whose value a query takes when it is built."""
    spark, view = one.sparkSession, f"lectern_{name}"
    one.createOrReplaceTempView(view)
    spark.sql(f"DECLARE OR REPLACE VARIABLE {view}_value {kind}")
    spark.sql(f"SET VAR {view}_value = (SELECT * FROM {view})")
    spark.catalog.dropTempView(view)
    return F.expr(f"{view}_value")


def rank_slots(spark: SparkSession, path: str) -> Column:
    """The literal rank map: an array of maps, each byte string in the map of its slot."""
    known = ranks(path)
    rows = spark.createDataFrame(pa.table({"k": pa.array([b.decode("latin-1") for b in known], pa.string()), "v": pa.array(list(known.values()), pa.int32())}))
    held = rows.groupBy(slot(F.col("k")).alias("s")).agg(F.collect_list(F.struct("k", "v")).alias("m"))
    full = spark.range(SLOTS).withColumnRenamed("id", "s").join(held, "s", "left")
    one = full.agg(F.sort_array(F.collect_list(F.struct("s", F.coalesce("m", F.array().cast("array<struct<k:string,v:int>>")).alias("m")))).alias("a"))
    return constant(one.select(F.transform("a", lambda x: F.map_from_entries(x["m"]))), "ARRAY<MAP<STRING, INT>>", "ranks")


def rank_of(table_: Column, key: Column) -> Column:
    return F.coalesce(F.element_at(table_[slot(key)], key), F.lit(NONE))


def fold(piece: Column, table_: Column) -> Column:
    """The ids of a piece in ISO-8859-1: as many merge steps as it has gaps; without a pair that has a rank, a step changes nothing.

    The state is the parts between two marks that no rank knows, and the ranks of all adjacent pairs.
    """

    def step(state: Column, _: Column) -> Column:
        parts, found = state["parts"], state["found"]

        def at(i: Column) -> Column:
            def put(word: Column) -> Column:
                left = rank_of(table_, F.concat(parts[i - 2], word))
                right = rank_of(table_, F.concat(word, parts[i + 1]))
                return F.struct(F.concat(F.slice(parts, 1, i - 1), F.array(word), F.slice(parts, i + 2, ROOM)).alias("parts"), F.concat(F.slice(found, 1, i - 2), F.array(left, right), F.slice(found, i + 2, ROOM)).alias("found"))

            return let(F.concat(parts[i - 1], parts[i]), put)

        return let(F.array_min(found), lambda best: F.when(best == NONE, state).otherwise(let(F.array_position(found, best).cast("int"), at)))

    def begin(parts: Column) -> Column:
        marked = F.concat(F.array(F.lit(MARK)), parts, F.array(F.lit(MARK)))
        pairs = F.zip_with(F.concat(F.array(F.lit(MARK)), parts), F.concat(parts, F.array(F.lit(MARK))), lambda a, b: rank_of(table_, F.concat(a, b)))
        end = lambda s: F.transform(F.slice(s["parts"], 2, F.size(s["parts"]) - 2), lambda p: F.element_at(table_[slot(p)], p))
        return F.aggregate(F.slice(parts, 2, ROOM), F.struct(marked.alias("parts"), pairs.alias("found")), step, end)

    return let(F.element_at(table_[slot(piece)], piece), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(let(F.split(piece, ""), begin)))


def latin(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


#: The pattern whose matches pieces() finds by runs of character classes; fixed value.
RUNS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, WHITE = range(4)


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    code = np.r_[0:0xD800, 0xE000:0x110000]
    every, out = "".join(map(chr, code.tolist())), np.zeros(0x110000, dtype=np.uint8)
    for kind, name in ((LETTER, "L"), (NUMBER, "N"), (WHITE, "White_Space")):
        for m in regex.finditer(rf"\p{{{name}}}+", every):
            out[code[m.start() : m.end()]] = kind
    return out


def cuts(b: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where in the UTF-8 bytes b of texts that begin and end at edge the matches of RUNS begin; they leave nothing between them.

    A run of one class is a match, with a space that stands before it. Of white space before another
    character, the last character is apart: it is that space, or a match of its own. An apostrophe
    alone, without such a space, takes the letters of a contraction from the run behind it.
    """
    table_ = classes()
    kind = table_[b]
    lead = np.flatnonzero(b >= 0xC0)
    if len(lead):
        first = b[lead].astype(np.int32)
        long = (first >= 0xE0).astype(np.int8) + (first >= 0xF0)
        code = first & np.array([0x1F, 0x0F, 0x07])[long]
        for k in range(1, 4):
            at = lead + np.minimum(k, long + 1)
            code = np.where(k <= long + 1, code << 6 | b[at] & 0x3F, code)
        for k in range(4):
            kind[lead + np.minimum(k, long + 1)] = table_[code]
    begins = np.zeros(len(b), dtype=bool)
    begins[edge[edge < len(b)]] = True
    new = begins.copy()
    new[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(new)
    end = np.r_[run[1:], len(b)]
    within_ = np.r_[~begins[run[1:]], False]  # another run of the same text follows
    white = (kind[run] == WHITE) & within_
    last = end[white] - 1
    for _ in range(3):
        last = last - ((b[last] & 0xC0) == 0x80)
    new[last] = True
    new[end[white][b[last] == 32]] = False
    quote = np.flatnonzero((end - run == 1) & within_ & (b[run] == 39) & new[run])
    after = np.r_[b, np.zeros(2, np.uint8)]
    at, size = run[quote] + 1, end[np.minimum(quote + 1, len(run) - 1)] - run[quote] - 1
    letter = kind[np.minimum(at, len(b) - 1)] == LETTER
    x, y = after[at], after[at + 1]
    took = np.where(np.isin(x, list(b"stmd")), 1, np.where((size > 1) & (((x == 108) & (y == 108)) | (np.isin(x, list(b"rv")) & (y == 101))), 2, 0)) * letter
    some = took > 0
    new[at[some]] = False
    rest = some & (size > took)
    new[(at + took)[rest]] = True
    return np.flatnonzero(new)


def pieces(texts: pa.Array, pattern: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Where each text's matches of the pattern begin and the last one's end, which of the distinct matches each is, and those."""
    if pattern == RUNS:
        b, edge = joined(texts)
        part = np.unique(np.r_[edge[np.searchsorted(edge, np.arange(0, len(b), SPAN))], len(b)])
        at = np.concatenate([np.empty(0, np.int64), *(s + cuts(b[s:e], edge[np.searchsorted(edge, s) : np.searchsorted(edge, e, "right")] - s) for s, e in zip(part[:-1].tolist(), part[1:].tolist(), strict=True))])
        every = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.r_[at, len(b)].astype(np.int64)), pa.py_buffer(b))
        start = np.searchsorted(at, edge)
    else:
        find = matcher(pattern)
        found = [find(x or "") for x in texts.to_pylist()]
        every = pa.array([p for x in found for p in x], pa.large_string())
        start = np.cumsum([0, *map(len, found)])
    coded = every.dictionary_encode()
    return start, coded.indices.to_numpy(), coded.dictionary.to_pylist()


def matcher(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the tokenizer's pattern, its white space as Unicode defines it."""
    import regex

    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall


def merge(piece: bytes, known: dict[bytes, int]) -> bytes:
    """A piece's ids as little-endian 32-bit integers: the leftmost pair of the lowest rank joins, until none has a rank."""
    n = len(piece)
    after, before, heap = [*range(1, n + 1)], [*range(-1, n - 1)], []

    def offer(i: int, e: int) -> None:
        if (r := known.get(piece[i:e])) is not None:
            heapq.heappush(heap, (r, i, e))

    if piece in known:
        return known[piece].to_bytes(4, "little")
    for i in range(n - 1):
        offer(i, i + 2)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = after[i]
        if not 0 < j < n or after[j] != e:
            continue  # one of the two has joined another since
        after[i], after[j] = e, 0
        if e < n:
            before[e] = i
            offer(i, after[e])
        if before[i] >= 0:
            offer(before[i], e)
    out, i = [], 0
    while i < n:
        out.append(known[piece[i : after[i]]].to_bytes(4, "little"))
        i = after[i]
    return b"".join(out)


def steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of STEP rows, so that what a task hands back at a time stays small."""
    for i in range(0, len(batch), STEP):
        yield batch.slice(i, STEP)


class Merges:
    """Ranked merges of many short pieces at once: in each step every piece joins its leftmost pair of the lowest rank."""

    def __init__(self, known: dict[bytes, int]):
        self.known = known
        pairs = {}
        for token, rank in known.items():
            for i in range(1, len(token)):
                if token[:i] in known and token[i:] in known:
                    pairs[known[token[:i]] << 32 | known[token[i:]]] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int32)
        self.byte = np.array([known[bytes([i])] for i in range(256)], dtype=np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of what each a and b join to; NONE where nothing, or where either is below 0."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.made[at], NONE)

    def _some(self, some: list[bytes]) -> list[bytes]:
        size = np.array(list(map(len, some)))
        width = int(size.max())
        parts = np.full((len(some), width + 1), -1, dtype=np.int32)
        parts[:, :width][np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(some), np.uint8)]
        found = self.rank(parts[:, :-1], parts[:, 1:])
        live, out, place = np.arange(len(some)), [b""] * len(some), np.arange(width)
        while len(live):
            at = found.argmin(axis=1)
            row = np.arange(len(live))
            best = found[row, at]
            done = best == NONE
            for i in np.flatnonzero(done).tolist():
                out[live[i]] = parts[i, : size[live[i]]].astype("<u4").tobytes()
            go = ~done
            live, parts, found, at, best = live[go], parts[go], found[go], at[go], best[go]
            if not len(live):
                break
            row = row[: len(live)]
            size[live] -= 1
            parts[row, at] = best
            parts[:, 1:-1] = np.where(place[1:] > at[:, None], parts[:, 2:], parts[:, 1:-1])
            found[:, :-1] = np.where(place[:-1] >= at[:, None], found[:, 1:], found[:, :-1])
            parts[row, size[live]] = -1
            found[row, size[live] - 1] = NONE
            found[row, at] = self.rank(parts[row, at], parts[row, at + 1])
            left = np.maximum(at - 1, 0)
            found[row, left] = np.where(at > 0, self.rank(parts[row, left], parts[row, at]), found[row, left])
        return out

    def __call__(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        out = [self.known[p].to_bytes(4, "little") if p in self.known else None for p in raw]
        short = sorted((i for i, p in enumerate(raw) if out[i] is None and len(p) <= LONGEST), key=lambda i: len(raw[i]))
        for i in range(0, len(short), 8192):
            some = short[i : i + 8192]
            for k, v in zip(some, self._some([raw[k] for k in some]), strict=True):
                out[k] = v
        return [merge(p, self.known) if v is None else v for p, v in zip(raw, out, strict=True)]


class Encoder:
    """Ids of texts from folded pieces, and by merges of those too rare to be held."""

    def __init__(self, data: bytes, pattern: str):
        self.pattern, self.ready, known = pattern, {}, {}
        for batch in pa.ipc.open_stream(data):
            for folded_, k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if folded_:
                    self.ready[k.decode()] = v
                else:
                    known[k] = int.from_bytes(v, "little")
        self.rare = Memo(Merges(known), MEMO, LONGEST)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in order, and how many come before each text and in all."""
        start, which, words = pieces(texts, self.pattern)
        each = [self.ready.get(w) for w in words]
        missing = [i for i, v in enumerate(each) if v is None]
        for i, v in zip(missing, self.rare([words[i] for i in missing]), strict=True):
            each[i] = v
        ids, before = gathered(each, which)
        return ids, before[start]


_held: dict[str, Encoder] = {}


def held_encoder(token: str, data: bytes, pattern: str) -> Encoder:
    """This Python worker's Encoder of the encoding named by token, kept from task to task."""
    if token not in _held:
        _held.clear()
        _held[token] = Encoder(data, pattern)
    return _held[token]


def counts(docs: DataFrame, pattern: str) -> DataFrame:
    """k and count of each distinct piece of up to LONGEST bytes in docs' texts; summed within each block of texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _held.clear()  # what an earlier corpus' encoder left in this worker
        held: list[pa.Table] = []
        size = 0

        def close() -> pa.RecordBatch:
            out = pa.concat_tables(held).group_by("k").aggregate([("n", "sum")]).rename_columns(["k", "n"]).combine_chunks()
            return pa.RecordBatch.from_arrays([out.column(c).combine_chunks().cast(t) for c, t in (("k", pa.string()), ("n", pa.int64()))], names=["k", "n"])

        for batch in batches:
            _, which, words = pieces(batch.column("text"), pattern)
            times = np.bincount(which, minlength=len(words))
            short = np.fromiter((len(w.encode()) <= LONGEST for w in words), bool, len(words))
            held.append(pa.table({"k": pa.array(words, pa.large_string()), "n": pa.array(times, pa.int64())}).filter(pa.array(short, pa.bool_())))
            size += len(words)
            if size > HELD:
                yield close()
                held, size = [], 0
        if held:
            yield close()

    return docs.select("text").transform(map_arrow, run, "k string, n long").groupBy("k").agg(F.sum("n").alias("count"))


def folded(counted: DataFrame, path: str) -> DataFrame:
    """k and ids v of the commonest pieces of counted, READY at most: whole classes of like counts, as many as fit."""
    level = F.floor(F.log2("count") * 8)
    room, least = READY, None
    for r in counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    common = counted.where(level >= least) if least is not None else counted.limit(0)
    known = rank_slots(counted.sparkSession, path)
    return common.repartition(64, F.col("k")).select("k", let(known, lambda m: fold(latin(F.col("k")), m)).alias("v"))


def _encoding(rows: DataFrame, path: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What encodes Arrow batches of rows (doc_id, text) as (doc_id, ids), with the folded pieces of all rows at hand."""
    spark, token = rows.sparkSession, uuid.uuid4().hex
    ready = folded(table(counts(rows, pattern), "pieces"), path).toArrow()  # READY rows at most
    known = ranks(path)
    keys = [*known, *(k.encode() for k in ready.column("k").to_pylist())]
    values = [*(r.to_bytes(4, "little") for r in known.values()), *(np.array(v, "<u4").tobytes() for v in ready.column("v").to_pylist())]
    held = pa.table({"folded": pa.array([False] * len(known) + [True] * len(ready)), "k": pa.array(keys, pa.binary()), "v": pa.array(values, pa.binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held.schema) as out:
        out.write_table(held, 10_000)
    data = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held_encoder(token, data.value, pattern)
        for batch in batches:
            ids, before = encoder(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids.view("<i4")))
            yield from steps(pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"]))

    return run


def _decoding(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What adds decoded and packed to Arrow batches of (doc_id, ids)."""
    known = ranks(path)
    size = max(known.values()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings: list[bytes | None] = [None] * size
        for b, i in known.items():
            strings[i] = b
        every = pa.array(strings, pa.large_binary())
        for batch in batches:
            lists = batch.column("ids").fill_null([])
            ids, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            at = at - at[0]
            parts = every.take(ids)  # the byte strings one after the other in one buffer
            ends = np.frombuffer(parts.buffers()[1], dtype=np.int64, count=len(parts) + 1)
            whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends[at]), parts.buffers()[2]])
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(4 * at), pa.py_buffer(ids.to_numpy().astype("<u4"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, whole.cast(pa.binary()), packed.cast(pa.binary())], names=["doc_id", "ids", "decoded", "packed"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of each row of docs (doc_id, text): for each match of the pattern, its byte-level BPE ids; null texts are empty and have none.

    Rows without or with repeated doc_ids are encoded each; no rows give no rows; other columns are not read.
    """
    rows = _rows(docs)
    return rows.transform(map_arrow, _encoding(rows, path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, the concatenated byte strings of the ids as decoded, and the ids as little-endian 32-bit integers as packed. Null ids are none."""
    return encoded.select("doc_id", "ids").transform(map_arrow, _decoding(path), "doc_id long, ids array<int>, decoded binary, packed binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of each row's ids and of what they decode to; one worker a task does both."""
    rows = _rows(docs)
    there, back = _encoding(rows, path, pattern), _decoding(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in back(there(batches)):
            size = pc.list_value_length(batch.column("ids")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, batch.column("decoded"), batch.column("packed")], names=["doc_id", "n_tokens", "decoded", "packed"])

    out = rows.transform(map_arrow, run, "doc_id long, n_tokens long, decoded binary, packed binary")
    return out.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
