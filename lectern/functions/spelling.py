"""The other spelling of an English word: closed families of stems and one rule for -ise and -yse, both ways, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stems of each family, words that the -ise rule leaves alone, and single pairs (British, American).
KEEP_S = (
    "raise praise appraise apprise reprise noise poise precise concise promise surprise wise likewise otherwise rise arise comprise compromise demise devise advise revise "
    "supervise televise improvise disguise guise despise chastise enterprise franchise merchandise exercise excise incise paradise treatise anise cruise bruise tortoise "
    "mortise expertise valise malaise mayonnaise surmise exorcise circumcise anywise"
).split()
KEEP_Z = "size prize seize maize capsize resize downsize oversize assize baize gaze gauze".split()
OUR = (
    "colour behaviour neighbour honour labour favour flavour harbour humour rumour vapour endeavour odour armour parlour "
    "saviour splendour valour vigour candour clamour demeanour fervour rancour rigour savour succour tumour ardour"
).split()
RE = "centre theatre metre litre fibre calibre sombre spectre sceptre lustre meagre sabre louvre goitre mitre nitre".split()
CE = "defence offence pretence licence".split()
OGUE = "catalogue dialogue monologue analogue epilogue travelogue".split()
TWO_L = "travel cancel label model signal marvel level total fuel jewel counsel equal initial rival dial channel panel quarrel revel shovel tunnel parcel pencil council grovel libel duel".split()
ONE_L = "fulfil instal enrol appal distil instil annul".split()
DIGRAPHS = {
    "encyclopaedia": "encyclopedia", "paediatric": "pediatric", "anaemia": "anemia", "anaesthetic": "anesthetic", "manoeuvre": "maneuver", "oesophagus": "esophagus",
    "foetus": "fetus", "orthopaedic": "orthopedic", "archaeology": "archeology", "leukaemia": "leukemia", "diarrhoea": "diarrhea", "gynaecology": "gynecology",
}
PAIRS = {
    "programme": "program", "programmes": "programs", "grey": "gray", "storey": "story", "storeys": "stories", "plough": "plow", "ploughs": "plows", "draught": "draft",
    "draughts": "drafts", "kerb": "curb", "tyre": "tire", "tyres": "tires", "aluminium": "aluminum", "jewellery": "jewelry", "moustache": "mustache", "pyjamas": "pajamas",
    "sceptical": "skeptical", "speciality": "specialty", "cheque": "check", "cheques": "checks", "mould": "mold", "moulds": "molds", "smoulder": "smolder", "axe": "ax",
}

#: Stems of a family without its ending, the endings (British, American), and what may follow.
FAMILIES = [
    ([x[:-3] for x in OUR], "our", "or", ["", "s", "ed", "ing", "ful", "less", "ly"]),
    ([x[:-2] for x in RE], "re", "er", ["", "s", "d"]),
    ([x[:-2] for x in CE], "ce", "se", ["", "s"]),
    ([x[:-2] for x in OGUE], "ue", "", ["", "s"]),
    (TWO_L, "l", "", ["ed", "ing", "er", "ers", "ings", "ous"]),
    (ONE_L, "", "l", ["", "s", "ment"]),
]
_KEPT = "^(?:" + "|".join(x[:-1] for x in [*KEEP_S, *KEEP_Z]) + ")(?:e|ed|es|er|ers|ing)$"
_ISE, _IZE = r"^(.*i)s(ations?|ed|es|ing|ers?|e)$", r"^(.*i)z(ations?|ed|es|ing|ers?|e)$"
_YSE, _YZE = r"^(.*y)s(ed|es|ing|e)$", r"^(.*y)z(ed|es|ing|e)$"


def _rules() -> list[tuple[str, str]]:
    """(pattern, replacement) of the closed families, each in both directions."""
    out = []
    for stems, gb, us, rest in FAMILIES:
        for a, b in ((gb, us), (us, gb)):
            out.append((f"^({'|'.join(stems)}){a}({'|'.join(rest)})$", f"$1{b}$2"))
    return out


def _swapped(word: Column) -> Column:
    """The word with -ise for -ize or the other way about; null where the rule doesn't reach or must not."""
    out = F.lit(None).cast("string")
    for pattern, to in ((_ISE, "$1z$2"), (_IZE, "$1s$2"), (_YSE, "$1z$2"), (_YZE, "$1s$2")):
        out = F.when(word.rlike(pattern), F.regexp_replace(word, pattern, to)).otherwise(out)
    return F.when(~word.rlike(_KEPT) & ~out.rlike(_KEPT), out)


def variants(folded: Column, lang: Column) -> Column:
    """The other spellings of a folded English word, as an array of words; empty in other languages and for words with one spelling."""
    single = {**PAIRS, **{a + s: b + s for a, b in DIGRAPHS.items() for s in ("", "s")}}
    pairs = F.create_map(*[F.lit(x) for a, b in single.items() for x in (a, b)]), F.create_map(*[F.lit(x) for a, b in single.items() for x in (b, a)])
    found = [F.element_at(m, folded) for m in pairs] + [F.when(folded.rlike(p), F.regexp_replace(folded, p, r)) for p, r in _rules()] + [_swapped(folded)]
    # One look tells most words apart from all of these.
    some = "|".join([p.strip("^$") for p, _ in _rules()] + [re.escape(w) for w in (*single, *single.values())] + [".*[iy][sz](?:ations?|ed|es|ing|ers?|e)"])
    none = F.array().cast("array<string>")
    return F.when((lang == "en") & folded.rlike(f"^(?:{some})$"), F.filter(F.array_distinct(F.array_compact(F.array(*found))), lambda w: w != folded)).otherwise(none)


# What the respelling probe rewrites, British to American, in this order.
PROBE = [
    ("isation$", "ization"), ("isations$", "izations"), ("ise$", "ize"), ("ised$", "ized"), ("ising$", "izing"), ("iser$", "izer"), ("ises$", "izes"),
    ("programme$", "program"), ("programmes$", "programs"), ("colour", "color"), ("neighbour", "neighbor"), ("behaviour", "behavior"), ("catalogue$", "catalog"), ("dialogue$", "dialog"),
]
_PROBE_KEPT = "(?i)^(?:" + "|".join(x[:-1] for x in KEEP_S if x != "anywise") + ")(?:e|ed|es|er|ers|ing)$"


def americanised(token: Column) -> Column:
    """A page token with each of its words in American spelling by the probe's rules; a capital at a word's start stays."""
    def word(w: Column) -> Column:
        new = F.lower(w)
        for pattern, to in PROBE:
            new = F.regexp_replace(new, pattern, to)
        capital = F.substring(w, 1, 1).rlike("[A-Z]")
        return F.when(w.rlike(_PROBE_KEPT) | (new == F.lower(w)), w).when(capital, F.concat(F.upper(F.substring(new, 1, 1)), F.substr(new, F.lit(2)))).otherwise(new)

    # Words and what stands between them take turns; a word is what the letters of A-Z make.
    parts = F.regexp_extract_all(token, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    touched = token.rlike("(?i)is(?:ation|e|ing)|programme|colour|neighbour|behaviour|logue")
    return F.when(touched, F.array_join(F.transform(parts, lambda w: F.when(w.rlike("^[A-Za-z]"), word(w)).otherwise(w)), "")).otherwise(token)
