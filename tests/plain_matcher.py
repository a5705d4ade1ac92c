"""The matcher and the ceiling in plain Python, rule by rule, for comparison; slow and simple on purpose."""

import re
import unicodedata

from lectern.functions import spelling as sp
from lectern.functions.spoken import ABBREVIATIONS, NUMBERS


def fold(t):
    t = unicodedata.normalize("NFC", t).lower()
    return "".join(c for c in t if unicodedata.category(c)[0] in "LN" or c in "_'")


def loose(t):
    d = unicodedata.normalize("NFD", fold(t))
    return unicodedata.normalize("NFC", "".join(c for c in d if unicodedata.category(c) != "Mn"))


def digits(t):
    return re.sub("[^0-9]", "", t)


def spellings(w):
    pairs = list(sp.PAIRS.items()) + [(a + s, b + s) for a, b in sp.DIGRAPHS.items() for s in ("", "s")]
    pairs += [(x + s, x[:-3] + "or" + s) for x in sp.OUR for s in ("", "s", "ed", "ing", "ful", "less", "ly")]
    pairs += [(x + s, x[:-2] + "er" + s) for x in sp.RE for s in ("", "s", "d")] + [(x + s, x[:-2] + "se" + s) for x in sp.CE for s in ("", "s")]
    pairs += [(x + s, x[:-2] + s) for x in sp.OGUE for s in ("", "s")] + [(f"{x}l{s}", x + s) for x in sp.TWO_L for s in ("ed", "ing", "er", "ers", "ings", "ous")]
    pairs += [(x + s, f"{x}l{s}") for x in sp.ONE_L for s in ("", "s", "ment")]
    out = [b for a, b in pairs if a == w] + [a for a, b in pairs if b == w]
    kept = {x for b in (*sp.KEEP_S, *sp.KEEP_Z) for x in (b, b + "d", b + "s", b + "r", b + "rs", b[:-1] + "ing")}
    ends = [("i", e) for e in ("ation", "ations", "ed", "es", "ing", "ers", "er", "e")] + [("y", e) for e in ("ed", "es", "ing", "e")]
    for v, e in ends:
        for a, b in (("s", "z"), ("z", "s")):
            if w.endswith(v + a + e):
                new = w[: len(w) - len(e) - 1] + b + e
                if w not in kept and new not in kept:
                    out.append(new)
    return [x for x in dict.fromkeys(out) if x != w]


def forms(token, lang):
    f, out = fold(token), []
    if not f:
        return []
    out.append([f])
    if d := digits(token):
        n, words = int(d), NUMBERS[lang]
        out.append([d])
        if len(d) <= 15:
            if n in words:
                out.append([words[n]])
            if 1100 <= n <= 2099 and n // 100 in words:
                low = n % 100
                rest = [] if not low else [words[low]] if low in words else [words.get(low - low % 10), words.get(low % 10)]
                if None not in rest:
                    out.append([words[n // 100], *rest])
        out.append(re.findall("[0-9]+", token))
    out += [[x] for x in ABBREVIATIONS[lang].get(f, [])]
    if lang == "en":
        out += [[x] for x in spellings(f)]
    at = f.find("'")
    if 0 < at < len(f) - 1:
        out += [[f[:at], f[at:]], [f[: at + 1], f[at + 1 :]]]
    clean = [tuple(x for x in map(fold, seq) if x) for seq in out]
    return [list(x) for x in dict.fromkeys(clean) if x]


def match(page, said, lang):
    """page: tokens; said: (w, s, e). -> (matched, unmatched, resyncs) as lists of tuples."""
    said = [o for o in said if fold(o[0])]
    f, lo, dg = [fold(o[0]) for o in said], [loose(o[0]) for o in said], [digits(o[0]) for o in said]
    every = [forms(t, lang) for t in page]
    bare = [loose(t) for t in page]
    matched, lost, jumps, held = [], [], [], []
    di = oi = 0
    jumped = False

    def look():
        for j in range(di, min(di + 6, len(page))):
            order = sorted(range(len(every[j])), key=lambda k: -len(every[j][k]))
            for k in order:
                if f[oi : oi + len(every[j][k])] == every[j][k]:
                    return j, len(every[j][k]), "exact" if every[j][k] == [fold(page[j])] else "normalized"
            for k in order:
                if lo[oi : oi + len(every[j][k])] == [loose(x) for x in every[j][k]]:
                    return j, len(every[j][k]), "normalized"
        for n in (3, 2):
            group = [digits(t) for t in page[di : di + n]]
            if dg[oi] and len(group) == n and all(group) and "".join(group) == dg[oi]:
                return di, n, "shared_token"

    while oi < len(said) and di < len(page):
        hit = look()
        if hit and hit[2] == "shared_token":
            matched += [(oi, di + k, "shared_token", said[oi][1], said[oi][2], jumped) for k in range(hit[1])]
            di, oi = di + hit[1], oi + 1
        elif hit:
            matched.append((oi, hit[0], hit[2], said[oi][1], said[oi + hit[1] - 1][2], jumped))
            di, oi = hit[0] + 1, oi + hit[1]
        if hit:
            lost, held, jumped = lost + held, [], False
            continue
        held.append(oi)
        oi += 1
        while len(held) >= 3:
            run = lo[held[0] : held[0] + 3]
            to = next((j for j in range(di + 1, min(di + 200, len(page) - 3) + 1) if bare[j : j + 3] == run), None) if all(run) else None
            if to is not None:
                jumps.append((held[0], di, to, to - di, tuple(run)))
                di, oi, held, jumped = to, held[0], [], True
                break
            lost.append(held.pop(0))
    return matched, lost + held + list(range(oi, len(said))), jumps


def absent(page, said, lang):
    """Indices of tokens that no run of one to three words gives, whatever the order."""
    f = [fold(w) for w in said if fold(w)]
    lo = [loose(w) for w in said if fold(w)]
    seen = {tuple(x[i : i + n]) for x in (f, lo) for n in (1, 2, 3) for i in range(len(x) - n + 1)}
    numbers = {digits(w) for w in said if fold(w)} - {""}
    covered = {i + k for n in (2, 3) for i in range(len(page) - n + 1) if all(digits(t) for t in page[i : i + n]) and "".join(map(digits, page[i : i + n])) in numbers for k in range(n)}
    return [i for i, t in enumerate(page) if fold(t) and i not in covered and not any(tuple(x) in seen or tuple(map(loose, x)) in seen for x in forms(t, lang))]
