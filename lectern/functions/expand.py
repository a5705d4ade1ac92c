"""Numbers as the words a speaker says, and page tokens as tokens that an aligner can place, each with its owner."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import digits

# Words of the numbers to 19 and of the tens, by language, and of hundred and thousand.
UNITS = {
    "en": "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(),
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciseis diecisiete dieciocho diecinueve".split(),
    "fr": "zero un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dixsept dixhuit dixneuf".split(),
}
TENS = {
    "en": "twenty thirty forty fifty sixty seventy eighty ninety".split(),
    "es": "veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa".split(),
    "fr": "vingt trente quarante cinquante soixante soixantedix quatrevingt quatrevingtdix".split(),
}
HUNDRED, THOUSAND = {"en": "hundred", "es": "cien", "fr": "cent"}, {"en": "thousand", "es": "mil", "fr": "mille"}
#: Numbers from here on stay as they are.
TOO_LARGE = 1_000_000


def spelled(n: Column, lang: Column) -> Column:
    """The words of a whole number below a million; years from 1100 to 1999 by their hundreds. Null for other numbers and languages."""
    def of(tables: dict[str, list[str]], i: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, words in tables.items():
            out = F.when(lang == name, F.get(F.array(*map(F.lit, words)), i.cast("int"))).otherwise(out)
        return out

    word = lambda table: of({k: [v] for k, v in table.items()}, F.lit(0))
    none = F.array().cast("array<string>")
    unless_zero = lambda x, words: F.when(x == 0, none).otherwise(words)
    part = lambda x, by: F.floor(x / by).cast("long")

    def under_100(x: Column) -> Column:
        return F.when(x < 20, F.array(of(UNITS, x))).otherwise(F.concat(F.array(of(TENS, part(x, 10) - 2)), unless_zero(x % 10, F.array(of(UNITS, x % 10)))))

    def under_1000(x: Column) -> Column:
        return F.when(x < 100, under_100(x)).otherwise(F.concat(under_100(part(x, 100)), F.array(word(HUNDRED)), unless_zero(x % 100, under_100(x % 100))))

    large = F.concat(F.when(part(n, 1000).between(100, 999), under_1000(part(n, 1000))).otherwise(under_100(part(n, 1000))), F.array(word(THOUSAND)), unless_zero(n % 1000, under_1000(n % 1000)))
    year = F.concat(under_100(part(n, 100)), unless_zero(n % 100, under_100(n % 100)))
    return F.when(lang.isin(*UNITS) & n.between(0, TOO_LARGE - 1), F.when(n < 1000, under_1000(n)).when(n.between(1100, 1999), year).otherwise(large))


def _letters(text: str) -> str:
    flat = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in flat if "a" <= c <= "z" or c == "'")


def romanized(texts: pa.Array) -> pa.Array:
    """Each text's letters a to z and apostrophes: compatibility forms taken apart, marks dropped, lower case; distinct texts of a batch once."""
    each = texts.dictionary_encode()
    return pa.array([_letters(x) for x in each.dictionary.to_pylist()], pa.string()).take(each.indices)


def with_words(display: DataFrame) -> DataFrame:
    """display (lang, text and others) with words: what an aligner places for each token; null for nothing.

    A token of digits without letters is read out as words; any other gives its letters, and one without letters or digits nothing.
    Plain tokens of a to z never leave the JVM, no token is shuffled.
    """
    plain = F.regexp_replace(F.lower("text"), "[^a-z']", "")
    odd = F.col("text").rlike(r"[^\x00-\x7F]")
    rows = display.where("text is not null").withColumn("r", F.coalesce(F.arrow_udf(romanized, "string")(F.when(odd, F.col("text"))), plain))
    number = digits(F.col("text"))
    n = F.when(F.length(number).between(1, 15), number.cast("long"))
    words = F.when((F.col("r") == "") & n.isNotNull(), F.coalesce(spelled(n, F.col("lang")), F.array().cast("array<string>"))).when(F.col("r") != "", F.array("r"))
    return rows.withColumn("words", words).drop("r")


def expanded(display: DataFrame) -> DataFrame:
    """clip_id, disp_idx, part and word: the words of with_words() for each display token (clip_id, lang, disp_idx, text), each with the token that owns it."""
    rows = with_words(display).select("clip_id", "disp_idx", F.posexplode_outer("words").alias("part", "word"))  # outer: no filter is inferred that makes all words once more
    return rows.where("part is not null")
