"""Spoken forms of a page token: what a recogniser may write for it, as arrays of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.spelling import variants
from lectern.functions.text import digits, elisions, fold, loose

# The single words of numbers, and the words that abbreviations stand for, by language.
NUMBERS = {
    "en": {
        0: "zero", 1: "one", 2: "two", 3: "three", 4: "four", 5: "five", 6: "six", 7: "seven", 8: "eight", 9: "nine", 10: "ten",
        11: "eleven", 12: "twelve", 13: "thirteen", 14: "fourteen", 15: "fifteen", 16: "sixteen", 17: "seventeen", 18: "eighteen", 19: "nineteen",
        20: "twenty", 30: "thirty", 40: "forty", 50: "fifty", 60: "sixty", 70: "seventy", 80: "eighty", 90: "ninety", 100: "hundred", 1000: "thousand",
    },
    "es": {
        0: "cero", 1: "uno", 2: "dos", 3: "tres", 4: "cuatro", 5: "cinco", 6: "seis", 7: "siete", 8: "ocho", 9: "nueve", 10: "diez",
        20: "veinte", 30: "treinta", 40: "cuarenta", 50: "cincuenta", 60: "sesenta", 70: "setenta", 80: "ochenta", 90: "noventa", 100: "ciento", 1000: "mil",
    },
    "fr": {
        0: "zero", 1: "un", 2: "deux", 3: "trois", 4: "quatre", 5: "cinq", 6: "six", 7: "sept", 8: "huit", 9: "neuf", 10: "dix",
        20: "vingt", 30: "trente", 40: "quarante", 50: "cinquante", 60: "soixante", 100: "cent", 1000: "mille",
    },
}
ABBREVIATIONS = {
    "en": {"dr": ["doctor"], "mr": ["mister"], "mrs": ["missus"], "ms": ["miz"], "prof": ["professor"], "st": ["saint", "street"], "vs": ["versus"]},
    "es": {"dr": ["doctor"], "dra": ["doctora"], "sr": ["senor"], "sra": ["senora"], "prof": ["profesor"], "profa": ["profesora"]},
    "fr": {"dr": ["docteur"], "dre": ["docteure"], "m": ["monsieur"], "mme": ["madame"], "mlle": ["mademoiselle"], "pr": ["professeur"], "prof": ["professeur"], "st": ["saint"], "ste": ["sainte"]},
}


def _map(entries: dict, kind: str) -> Column:
    return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))]).cast(kind)


def _by_lang(lang: Column, tables: dict[str, dict], kind: str, key: Column) -> Column:
    out = F.lit(None)
    for name, entries in tables.items():
        out = F.when(lang == name, F.element_at(_map(entries, kind), key)).otherwise(out)
    return out


def number_word(n: Column, lang: Column) -> Column:
    """The single word of a whole number, or null."""
    return _by_lang(lang, NUMBERS, "map<bigint,string>", n.cast("bigint"))


def year(n: Column, lang: Column) -> Column:
    """The words of a year from 1100 to 2099: its hundreds, then one word for the rest or tens and units; null if a word lacks."""
    word = lambda x: number_word(x, lang)
    head, low = word(F.floor(n / 100)), n % 100
    tens, units = word(low - low % 10), word(low % 10)
    whole = word(low)
    return F.when(n.between(1100, 2099) & head.isNotNull(), F.when(low == 0, F.array(head)).when(whole.isNotNull(), F.array(head, whole)).when(tens.isNotNull() & units.isNotNull(), F.array(head, tens, units)))


def digit_runs(token: Column) -> Column:
    return F.regexp_extract_all(token, F.lit("[0-9]+"), F.lit(0))


def abbreviations(folded: Column, lang: Column) -> Column:
    """What an abbreviation stands for, or null."""
    return _by_lang(lang, ABBREVIATIONS, "map<string,array<string>>", folded)


def forms(token: Column, lang: Column, folded: Column | None = None, number: Column | None = None) -> Column:
    """All sequences of words for a token, each word folded, the first of equal ones kept: the fold, its digits, number word, year and digit runs, abbreviations, other spellings and elisions.

    folded and number: columns that hold the token's fold and digits, which are read some fifty times; without them each time works them out.
    """
    folded, number = fold(token) if folded is None else folded, digits(token) if number is None else number
    n = F.when(F.length(number).between(1, 15), number.cast("bigint"))
    one = lambda c: F.when(c.isNotNull() & (c != ""), F.array(F.array(c)))
    many = lambda c: F.when(c.isNotNull() & (F.size(c) > 0), F.array(c))
    none = F.array().cast("array<array<string>>")
    parts = [one(folded), one(number), one(number_word(n, lang)), many(year(n, lang)), many(digit_runs(token)), F.transform(abbreviations(folded, lang), lambda w: F.array(w)), F.transform(variants(folded, lang), lambda w: F.array(w)), elisions(folded)]
    every = F.concat(*[F.coalesce(p, none) for p in parts])
    clean = F.transform(every, lambda s: F.filter(F.transform(s, fold), lambda w: w != ""))
    return F.when(folded == "", none).otherwise(F.array_distinct(F.filter(clean, lambda s: F.size(s) > 0)))


def has_more(token: Column, folded: Column, lang: Column) -> Column:
    """Whether a token has more forms than its fold: digits, an inner apostrophe, an abbreviation, or an English word with two spellings."""
    short = F.lit(False)
    for name, entries in ABBREVIATIONS.items():
        short = short | ((lang == name) & folded.isin(*entries))
    return token.rlike("[0-9]") | folded.contains("'") | short | (F.size(variants(folded, lang)) > 0)


def normalized(words: DataFrame, text: str, lang: str | None = None) -> DataFrame:
    """words with f, l and n (fold, fold without accents, digits) and, with the name of a language column, more and more_loose: the spoken forms of tokens that have others than their fold, else null."""
    out = words.withColumn("f", fold(F.col(text))).withColumn("l", loose(F.col("f"))).withColumn("n", digits(F.col(text)))
    if lang is None:
        return out
    # In a lambda, which Spark doesn't compile: the forms' code is so long that the whole stage would go uncompiled with it.
    some = lambda x: F.when((x["f"] != "") & has_more(x["t"], x["f"], x["g"]), forms(x["t"], x["g"], x["f"], x["n"]))
    out = out.withColumn("more", F.get(F.transform(F.array(F.struct(F.col(text).alias("t"), F.col(lang).alias("g"), "f", "n")), some), F.lit(0)))
    return out.withColumn("more_loose", F.transform("more", lambda s: F.transform(s, loose)))
