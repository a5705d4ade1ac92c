"""Column functions over token text."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A display token: what white space of any kind, no-break spaces included, separates.
TOKEN = r"[^\s\p{Z}﻿]+"
ACCENTED = "áàâäãéèêëíìîïóòôöõúùûüñçÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜÑÇ"
PLAIN = "aaaaaeeeeiiiiooooouuuuncAAAAEEEEIIIIOOOOUUUUNC"


def _bare_letters() -> tuple[str, str]:
    """Every composed letter whose parts are a letter and marks, and that letter, by Unicode's own decompositions."""
    pairs = []
    for i in range(0xC0, sys.maxunicode + 1):
        c = chr(i)
        parts = unicodedata.decomposition(c)
        if parts and not parts.startswith("<"):
            bare = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"))
            if len(bare) == 1 and bare != c:
                pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, BARE = _bare_letters()


def _single_capitals() -> tuple[str, str]:
    """Every letter whose upper case in full is more than one letter, and its capital of one letter: itself without one."""
    pairs = [("ß", "ẞ")]
    for i in range(0xE0, 0x20000):
        c = chr(i)
        if c != "ß" and len(c.upper()) > 1:
            pairs.append((c, c.title() if len(c.title()) == 1 else c))
    # Letters that only Unicode 16 gave capitals stay as they are.
    return "".join(a for a, _ in pairs) + _NEW, "".join(b for _, b in pairs) + _NEW


_NEW = "ƛɤ\u1c8a\ua7cd\ua7db" + "".join(map(chr, range(0x10D70, 0x10D86)))
SHARP, CAPITALS = _single_capitals()


def composed(rows: DataFrame, column: str) -> DataFrame:
    """rows with a column's strings in composed form (NFC).

    Only strings with a character from U+0300 on can change. Their distinct ones go through Python and are joined back;
    all other rows stay as they are.
    """
    odd = F.coalesce(F.col(column).rlike(r"[\x{300}-\x{10FFFF}]"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([unicodedata.normalize("NFC", x) for x in b.column(0).to_pylist()], pa.string())], names=["__token", "__composed"])

    found = rows.where(odd).select(F.col(column).alias("__token")).distinct().mapInArrow(run, "__token string, __composed string")
    done = rows.where(odd).join(found, F.col(column) == F.col("__token")).withColumn(column, F.col("__composed")).select(*rows.columns)
    return rows.where(~odd).unionByName(done)


def fold(token: Column) -> Column:
    """Lower case, letters, numbers, underscore and apostrophe only; composed text is expected, see composed()."""
    return F.regexp_replace(F.lower(token), r"[^\p{L}\p{N}_']", "")


def loose(folded: Column) -> Column:
    """A fold without its accents, whatever the letter."""
    return F.when(F.octet_length(folded) == F.length(folded), folded).otherwise(F.translate(folded, MARKED, BARE))  # ASCII has none


def upper(token: Column) -> Column:
    """Upper case letter by letter, as many letters as before (ß gives ẞ), as DuckDB's upper; Spark's upper writes SS."""
    each = F.transform(F.split(token, ""), lambda x: F.when(F.lit(SHARP).contains(x), F.translate(x, SHARP, CAPITALS)).otherwise(F.upper(x)))
    return F.when(token.rlike(f"[{SHARP}]"), F.array_join(each, "")).otherwise(F.upper(token))


def accented(token: Column) -> Column:
    """Whether a token has a letter with an accent, by itself or as a mark that follows."""
    return (F.translate(token, MARKED, BARE) != token) | token.rlike(r"\p{Mn}")


def digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def elisions(folded: Column) -> Column:
    """The two ways to cut at the first interior apostrophe; empty without one."""
    at = F.instr(folded, "'")
    inside = (at > 1) & (at < F.length(folded))
    return F.when(inside, F.array(F.array(F.substr(folded, F.lit(1), at - 1), F.substr(folded, at)), F.array(F.substr(folded, F.lit(1), at), F.substr(folded, at + 1)))).otherwise(F.array().cast("array<array<string>>"))


def overlap_pct(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared part of two intervals in percent of their union; 0 for an empty union."""
    union = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(union > 0, F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0.0)) / union * 100).otherwise(0.0)


def at_most(x: Column, bound: float, digits: int) -> Column:
    """Whether x, rounded to digits, is at most bound (itself of no more digits); only what lies close to the bound is rounded, which is dear for doubles."""
    return F.when(x < bound - 10.0**-digits, True).when(x > bound + 10.0**-digits, False).otherwise(F.round(x, digits) <= bound)


def at_least(x: Column, bound: float, digits: int) -> Column:
    """Whether x, rounded to digits, is at least bound; as at_most()."""
    return F.when(x > bound + 10.0**-digits, True).when(x < bound - 10.0**-digits, False).otherwise(F.round(x, digits) >= bound)


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """(low, high) percent of the Wilson score interval, to one decimal; nulls for n = 0."""
    p = k / n
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.struct(F.bround(F.greatest(mid - half, F.lit(0.0)) * 100, 1).alias("low"), F.bround(F.least(mid + half, F.lit(1.0)) * 100, 1).alias("high")))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs: twice the smaller binomial tail, summed in logarithms; 1 without any."""
    n, k = b + c, F.least(b, c)
    lgamma = lambda x: F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(x, F.lit(1)).cast("long")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    term = lambda i: F.exp(lgamma(n) - lgamma(i) - lgamma(n - i) - n * F.log(F.lit(2.0)))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), F.lit(0.0), lambda s, i: s + term(i))
    return F.when(n == 0, 1.0).otherwise(F.least(2 * tail, F.lit(1.0)))
