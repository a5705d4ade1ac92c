"""Toxicity by a learned lexicon, matched with spelling errors, in context.

Terms that mark toxic documents (words, and beginnings that many words share) are learned
from labelled rows. A trie of them is intersected with Levenshtein automata of distance one;
the product's states are made as words reach them, so that a word without a term leaves it
after a few letters. Each hit counts as quoted or direct by the quotation marks in a window
around it; a logistic regression weighs the counts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_arrow, mix64, shingle_set, table, utf8

#: At most about so many labelled rows train the lexicon and the weights, picked by a hash of their ids.
TRAIN_ROWS = 20_000
#: A lexicon's size, the lengths of beginnings, and the least length of a term matched with an error.
TERMS, BEGINNINGS, FUZZY = 2_000, (4, 5, 6), 5
#: Tokens on either side of a hit within which quotation marks make it quoted.
WINDOW = 6
QUOTES = frozenset("\"“”„«»‹›")
EDGE = ".,;:!?'\"“”„«»‹›()[]{}*%$#&|<>-_"
NAMES = ["direct", "quoted", "direct_misspelled", "quoted_misspelled", "density"]


#: Words found clean that a task remembers, and states of the automaton it makes before it begins anew; these bound its memory only.
CLEAN, STATES = 100_000, 50_000


class Automaton:
    """Trie of terms x Levenshtein automata of distance one, made deterministic state by state.

    A state is a set of (trie node, errors so far). A term ending in * matches any word that begins
    with it. match() gives the fewest errors with which a word is a term, or None.
    """

    def __init__(self, terms: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.end: list[tuple[bool, bool, bool]] = [(False, False, False)]  # word, beginning, long enough for an error
        for term in terms:
            at, word = 0, term.rstrip("*")
            for c in word:
                if c not in self.next[at]:
                    self.next.append({})
                    self.end.append((False, False, False))
                    self.next[at][c] = len(self.next) - 1
                at = self.next[at][c]
            w, b, f = self.end[at]
            self.end[at] = (w or term == word, b or term != word, f or len(word) >= FUZZY + (term != word))
        self.reset()

    def reset(self) -> None:
        """Forgets all states made so far."""
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.accept: list[tuple[int | None, int | None]] = []  # errors if the word ends here, if a beginning ends here
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, found: set[tuple[int, int]]) -> frozenset:
        """With a letter left out of the term at one error, and what a smaller error count covers taken away."""
        found = found | {(m, 1) for n, e in found if not e for m in self.next[n].values()}
        return frozenset((n, e) for n, e in found if not e or (n, 0) not in found)

    def _state(self, found: frozenset) -> int:
        if found not in self.states:
            self.states[found] = len(self.sets)
            self.sets.append(found)
            self.step.append({})
            ok = [(e, self.end[n]) for n, e in found if not e or self.end[n][2]]
            self.accept.append((min((e for e, (w, _, _) in ok if w), default=None), min((e for e, (_, b, _) in ok if b), default=None)))
        return self.states[found]

    def move(self, state: int, c: str) -> int:
        to = self.step[state].get(c)
        if to is None:
            out = set()
            for n, e in self.sets[state]:
                if c in self.next[n]:
                    out.add((self.next[n][c], e))
                if not e:
                    out.add((n, 1))  # a letter too many
                    out |= {(m, 1) for m in self.next[n].values()}  # another letter
            to = self.step[state][c] = self._state(self._closed(out))
        return to

    def match(self, word: str) -> int | None:
        state, best = self.start, None
        for c in word:
            state = self.step[state][c] if c in self.step[state] else self.move(state, c)
            if state == self.dead:
                return best
            begun = self.accept[state][1]
            if begun is not None and (best is None or begun < best):
                best = begun
                if not best:
                    return 0
        whole = self.accept[state][0]
        return whole if best is None or (whole is not None and whole < best) else best


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def terms_of(text: str) -> set[str]:
    """The distinct words of a text, and their beginnings marked by *."""
    words = {w.strip(EDGE) for w in set(text.lower().split())}
    return {w for w in words if 3 <= len(w) <= 40} | {w[:n] + "*" for n in BEGINNINGS for w in words if len(w) > n}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found[toxic].update(terms_of(text or ""))
    terms = [t for t in found[1] if found[1][t]]
    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([found[1][t] for t in terms], pa.int64()), pa.array([found[0][t] for t in terms], pa.int64())], names=["term", "a", "b"])
    terms = [t for t in found[0] if not found[1][t] and found[0][t] > 1]
    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([0] * len(terms), pa.int64()), pa.array([found[0][t] for t in terms], pa.int64())], names=["term", "a", "b"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    draws = np.array([[3], [5], [7], [11]], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        sets = [shingle_set(b) for b in utf8(batch.column("text"))]
        keys = [mix64(s[None, :] ^ draws).min(axis=1).view(np.int64) if len(s) else np.zeros(4, np.int64) for s in sets]
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([int(k[i]) for k in keys], pa.int64()) for i in range(4))], names=[*batch.schema.names, "k0", "k1", "k2", "k3"])


def without_copies(sample: DataFrame) -> DataFrame:
    """Near copies are no further evidence for their words: one row stays of those that share one of four minima over their 5-word shingles."""
    out = sample.select("doc_id", "text", "toxic").transform(map_arrow, _keys, "doc_id long, text string, toxic int, k0 long, k1 long, k2 long, k3 long")
    for i in range(4):  # the row of the smallest id, and of its smallest text, stays
        out = out.groupBy(f"k{i}").agg(F.min_by(F.struct(*out.columns), F.struct("doc_id", "text", "toxic")).alias("r")).select("r.*")
    return out.select("doc_id", "text", "toxic")


def learn_terms(sample: DataFrame) -> list[str]:
    """The lexicon: terms whose documents are toxic far beyond chance (a tail bound below 0.01 over all terms tried), the shortest of those that cover each other."""
    n = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n[1] or n[1] == n[0]:
        return []
    rate = n[1] / n[0]
    counted = table(sample.select("text", "toxic").transform(map_arrow, _count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a > 1"), "toxic")
    tried = max(1, counted.count())
    share = F.col("a") / (F.col("a") + F.col("b"))
    surprise = F.col("a") * F.log(share / rate) + F.when(share < 1, F.col("b") * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    good = counted.where((share >= 0.5) & (surprise > math.log(tried / 0.01))).orderBy(F.col("a").desc(), "term").limit(4 * TERMS)
    rows = good.collect()  # a bounded number of short strings
    out: list[str] = []
    kept: set[str] = set()
    for r in sorted(rows, key=lambda r: (len(r.term.rstrip("*")), not r.term.endswith("*"), r.term)):
        word = r.term.rstrip("*")
        if not any(word[:i] + "*" in kept for i in BEGINNINGS if i < len(word) + (not r.term.endswith("*"))):
            # A beginning that a single word makes up is that word.
            alone = next((s for s in rows if r.term.endswith("*") and not s.term.endswith("*") and s.term.startswith(word) and s.a >= 0.9 * r.a), None)
            if not alone:
                kept.add(r.term)
                out.append(r.term)
    return out[:TERMS]


class Scorer:
    """Counts of hits in a text. Words found clean are remembered, up to a bound."""

    def __init__(self, terms: list[str]):
        self.automaton, self.clean = Automaton(terms), set()

    def features(self, text: str) -> list[float]:
        words = text.lower().split()
        hits = {}
        for w in set(words) - self.clean:
            errors = self.automaton.match(w.strip(EDGE))
            if errors is None:
                self.clean.add(w)
            else:
                hits[w] = errors
        if len(self.clean) > CLEAN:
            self.clean = set()
        if len(self.automaton.sets) > STATES:
            self.automaton.reset()
        n = [0, 0, 0, 0]
        if hits:
            for i, w in enumerate(words):
                if w in hits:
                    near = words[max(0, i - WINDOW) : i + WINDOW + 1]
                    n[2 * hits[w] + any(QUOTES & set(x) for x in near)] += 1
        return [*map(math.log1p, n), sum(n) / max(1, len(words)) * 10]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the first is the constant."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs (doc_id, text), behind the columns named in keep, if any: those of docs as they are.

    labels (doc_id, toxic) are learned from where crc32 of the doc_id's digits modulo 5 is not 0, at
    most about TRAIN_ROWS of them. Null and empty texts have the score of a text without hits. Without
    labels of both kinds the score is 0. Rows that repeat an id are scored each; a row without an id is
    held out by the hash of the text None; no rows give no rows; columns not in keep are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1) and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    parts = max(1, math.ceil(n / TRAIN_ROWS))
    sample = table(without_copies(rows.join(marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0), "doc_id")), "toxic")
    terms = learn_terms(sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms)
        for batch in batches:
            x = [scorer.features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    weights = None
    if terms:
        seen = sample.select("toxic", "text").transform(map_arrow, measure, "toxic int, x array<double>").toArrow()
        weights = fit(np.array(seen.column("x").to_pylist()), seen.column("toxic").to_numpy().astype(float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            p = [0.0] * len(ids)
            if weights is not None:
                x = np.array([scorer.features(t or "") for t in batch.column("text").to_pylist()]).reshape(len(ids), len(NAMES))
                p = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            found = [pa.array([held_out(d) for d in ids], pa.bool_()), pa.array(p, pa.float64()), pa.array([int(v >= 0.5) for v in p], pa.int32())]
            mine = [batch.column("doc_id")] if keep is None else batch.columns
            yield pa.RecordBatch.from_arrays([*mine, *found], names=["doc_id", *names[1:], "held_out", "score", "predicted"])

    if keep is None:
        names = ["doc_id"]
        return rows.transform(map_arrow, score, "doc_id long, held_out boolean, score double, predicted int")
    names = ["doc_id", "text", *[c for c in keep if c not in ("doc_id", "text")]]
    kinds = dict(docs.dtypes) | {"doc_id": "bigint", "text": "string"}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", held_out boolean, score double, predicted int"
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *names[2:])
    return whole.transform(map_arrow, score, schema)
