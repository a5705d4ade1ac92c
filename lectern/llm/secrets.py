"""Secrets in texts: base patterns, and credential values that are hard to guess.

A value found where a credential stands is cut into the cheapest sequence of words, dates,
repeats, keyboard walks and brute-force spans; the sum of the parts' log10 guesses is its guess
cost. A word's rank is its place among the words of the most documents of the corpus, behind a
few that are always tried first. Values above a cost are reported as spans of the kind guess.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import joined, map_arrow, spaced, table

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so the length may stand in the pattern
#: Where else a credential's value follows: other names, authorization headers, and a URL's user part.
CONTEXT = re.compile(r"""(?:\b(?:pwd|passphrase|pass|credentials?|auth[_-]?key|access[_-]?key|client[_-]?secret)["']?\x20*[:=]\x20*["']?|\bbearer\x20+|://[A-Za-z0-9._-]+:)([!-~]{6,})""", re.ASCII | re.IGNORECASE)
#: Common passwords and words by rank, rows of keys, and number of guesses of a date; fixed values.
WORDS = """password 123456 qwerty letmein welcome admin login abc123 monkey dragon master sunshine princess football shadow
superman secret root test user guest default changeme love hello freedom whatever trustno1 summer winter spring autumn
token key api pass example sample demo public private server database cloud access my the your""".split()
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0987654321", "poiuytrewq", "lkjhgfdsa", "mnbvcxz")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
#: The corpus' words that are ranked (of the most documents, ties by the word), and their lengths: at most 20,000 x 24 bytes go to each task.
RANKED, SHORTEST, LONGEST = 20_000, 3, 24
#: The longest block whose repeats a cost without a limit sees; below a limit, blocks as long as the limit can't be part of it.
BLOCK = 512
#: All blocks of up to 7 characters go into so many; a stretch of repeats keeps so many before and after what is left out of its middle.
_COMMON, _KEPT = 420, 840
_STRETCH = re.compile(r"(.{1,7}?)\1{260,}", re.DOTALL)
_PART = math.log10(2)
_LEET = str.maketrans("@4301$57!", "aaeoissti")
_NEXT = {a + b for row in ROWS for a, b in zip(row, row[1:], strict=False)}
#: A value of that many log10 guesses and more is reported: beyond what an offline word attack tries first.
STRONG = 8.0


def ranks(words: list[str]) -> dict[str, int]:
    """Each word's rank: WORDS first, then words in their order."""
    out: dict[str, int] = {}
    for w in [*WORDS, *words]:
        out.setdefault(w, len(out) + 1)
    return out


class _Starts:
    """Starts of an open run by the cost before them. A later one that costs no more drops an earlier one; an earlier one that is ahead at some end stays ahead, and drops a later one."""

    def __init__(self):
        self.held: list[tuple[float, int]] = []

    def add(self, cost: float, at: int) -> None:
        while self.held and self.held[-1][0] >= cost:
            self.held.pop()
        self.held.append((cost, at))

    def least(self, end: int, size: int) -> float:
        kept, low = [], math.inf
        for cost, at in self.held:
            guesses = cost + math.log10((end - at) / size)
            if guesses < low:
                kept.append((cost, at))
                low = guesses
        self.held = kept
        return low


def shortened(value: str) -> tuple[str, list[int]]:
    """A value without the middles of its long stretches of repeats, and each place's distance from the value's start as if they were there.

    A multiple of all block sizes goes, so that what stands around it fits together. A cheap segmentation has one part
    that spans the middle of such a stretch, and all others near its ends, where nothing is left out.
    """
    out, place, at = [], [0], 0
    for m in _STRETCH.finditer(value):
        gone = (m.end() - m.start() - 2 * _KEPT) // _COMMON * _COMMON
        if gone > 0:
            cut = m.start() + _KEPT
            out.append(value[at:cut])
            place += range(at + 1, cut + 1)
            at = cut + gone
    place += range(at + 1, len(value) + 1)
    return "".join([*out, value[at:]]), place


def guess_cost(value: str, rank: dict[str, int], limit: float = math.inf) -> float:
    """log10 of the guesses that the cheapest segmentation of a value needs, or the limit where they are no fewer; 0 for an empty value.

    Below a limit the work ends as soon as no part that begins within reach is cheap enough, and long repeats are
    taken as one, so that a value of any length takes little time.

    best[j] is the least cost of the first j characters. A part may begin and end anywhere and costs:
    a word its rank (twice that if capitals are undone, four times if look-alike signs are), a date
    36,500 (119 for a year), a block of b characters repeated k times 10**b * k, a keyboard or
    alphabet walk of n characters 40 * n, and anything else 10 a character in brute force. Each
    further part doubles the guesses.
    """
    block = BLOCK
    place: list[int] | range = range(len(value) + 1)
    if limit < math.inf:
        block = min(BLOCK, math.ceil(limit) - 1)
        if len(value) > 2 * _KEPT + _COMMON and block <= 7:
            value, place = shortened(value)
    n, low, alive = len(value), value.lower(), 0
    plain = low.translate(_LEET)
    best = [0.0] + [math.inf] * n
    before = lambda i: best[i] + (_PART if i else 0.0)
    brute, walk, walk_from = math.inf, _Starts(), 0
    period: dict[int, int] = {}  # of each block size, how many characters up to here equal the one a block before
    repeats: dict[tuple[int, int], _Starts] = {}  # by block size and place within the block
    dates: dict[int, list[tuple[int, float]]] = {}
    back: dict[str, list[int]] = {}  # places of each character
    for j in range(1, n + 1):
        c = j - 1  # the character that ends here
        for m in DATE.finditer(value, c, min(n, c + 10)) if value[c].isdigit() else ():
            if m.start() == c:
                dates.setdefault(m.end(), []).append((c, math.log10(119 if m.end() - c == 4 else 36_500)))
            break
        if value[c : c + 2] in ("19", "20") and re.fullmatch(r"\d{4}", value[c : c + 4], re.ASCII):
            dates.setdefault(c + 4, []).append((c, math.log10(119)))
        brute = min(brute + 1, before(c) + 1)
        cost = brute
        for i in range(max(0, j - LONGEST), j - SHORTEST + 1):
            if r := rank.get(low[i:j]):
                cost = min(cost, before(i) + math.log10(r if value[i:j] == low[i:j] else 2 * r))
            if r := rank.get(plain[i:j]):
                cost = min(cost, before(i) + math.log10(4 * r))
        for i, guesses in dates.get(j, ()):
            cost = min(cost, before(i) + guesses)
        if not (c and low[c - 1 : c + 1] in _NEXT):
            walk, walk_from = _Starts(), c
        if j - 3 >= walk_from:
            walk.add(before(j - 3), place[j - 3])
            cost = min(cost, walk.least(place[j], 1) + math.log10(40))
        seen = back.setdefault(value[c], [])
        now: dict[int, int] = {}
        short = 0  # the shortest block here
        for at in reversed(seen):
            b = c - at
            if b > block:
                break
            now[b] = period.get(b, 0) + 1
            if now[b] == 1:  # a new run of this block: starts of an older one don't reach it
                for k in range(b):
                    repeats.pop((b, k), None)
            if now[b] >= b:
                starts = repeats.setdefault((b, j % b), _Starts())
                starts.add(before(j - 2 * b), place[j - 2 * b])
                short = short or b
                if b == short or b % short or now[short] + short < now[b] + b:  # else the shorter block is cheaper
                    cost = min(cost, starts.least(place[j], b) + b)
        period = now
        seen.append(c)
        best[j] = cost
        if cost < limit:
            alive = j
        elif j - alive > LONGEST:  # no word reaches back that far, and a walk or repeats that go on would be alive
            return limit
    return min(best[n], limit)


def scan(text: str, rank: dict[str, int], strong: float = STRONG) -> list[tuple[int, int, str]]:
    """(start, kind's place, kind:start:end) of all spans of a text, in code points."""
    out, values = [], {}
    low = text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                out.append((m.start(), 0, m.end()))
                values[m.span(2)] = m[2]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(k in low for k in ("pwd", "pass", "credential", "key", "secret", "bearer", "://")):
        values |= {m.span(1): m[1] for m in CONTEXT.finditer(text)}
    out += [(s, 3, e) for (s, e), v in values.items() if guess_cost(v, rank, strong) >= strong]
    return [(s, k, f"{KINDS[k]}:{s}:{e}") for s, k, e in sorted(set(out))]


_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def word_counts(docs: DataFrame) -> DataFrame:
    """word and how many of docs' rows have it: lower-case runs of ASCII letters; summed within each block of texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = np.full(256, 32, dtype=np.uint8)
        letter[97:123] = np.arange(97, 123)
        letter[65:91] = np.arange(97, 123)
        for batch in batches:
            b, edge = joined(batch.column("text"))
            start, which, words = spaced(pa.LargeStringArray.from_buffers(len(batch), pa.py_buffer(edge), pa.py_buffer(letter[b])))
            doc = np.repeat(np.arange(len(batch)), np.diff(start))
            once = np.unique(which.astype(np.int64) * len(batch) + doc) // max(1, len(batch))
            n = np.bincount(once, minlength=len(words))
            some = [i for i, w in enumerate(words) if SHORTEST <= len(w) <= LONGEST]
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in some], pa.string()), pa.array(n[some], pa.int64())], names=["word", "n"])

    return docs.select(F.col("text").cast("string")).transform(map_arrow, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(counts: DataFrame) -> list[str]:
    """The RANKED words of the most documents, ties by the word. Levels of like counts tell first how far down they reach, so that tasks don't each send their own RANKED."""
    counted, level = table(counts, "words"), F.floor(F.log2("n") * 8)
    room, least = RANKED, 0
    for r in counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some hundred levels
        room, least = room - r["count"], r["level"]
        if room <= 0:
            break
    return [r.word for r in counted.where(level >= least).orderBy(F.desc("n"), "word").limit(RANKED).collect()]


def find_secrets(docs: DataFrame, strong: float = STRONG) -> DataFrame:
    """One row for each row of docs (doc_id, text): counts and a digest of the base spans, and all spans.

    Whole texts are scanned; a null or empty text has no spans (digest of the empty string). Rows that
    repeat a doc_id or have none keep their own rows; other columns are not read; no rows give no rows.
    """
    words = common_words(word_counts(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks(words)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found = scan(text or "", rank, strong)
                base = [x for x in found if x[1] < 3]
                rows.append(([sum(x[1] == k for x in base) for k in range(3)], hashlib.sha256(",".join(x[2] for x in base).encode()).hexdigest(), ",".join(x[2] for x in found)))
            counts = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_arrow, run, _FOUND)
