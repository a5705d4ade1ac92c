"""Periodic runs, url filters and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from lectern.llm import queries
from lectern.llm.periodic import find_runs, periodic_runs
from lectern.llm.resampling import resample
from lectern.llm.url_filters import domain, judge

GAP = r"[^\x20\x09-\x0D]+"


def plain_runs(words, least=6, times=4):
    """Every maximal stretch by every lag; a stretch with a smaller period is left out."""
    out = []
    for q in range(1, len(words)):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                run = words[i : j + q]
                if not any(all(run[x] == run[x + p] for x in range(len(run) - p)) for p in range(1, q)):
                    out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def random_words(rng):
    kind, n = rng.random(), rng.randrange(1, 120)
    if kind < 0.3:
        return [rng.choice("ab") for _ in range(n)]
    words = [rng.choice("abcdefgh") for _ in range(n)]
    for _ in range(rng.randrange(4)):
        at, p = rng.randrange(n), rng.randrange(1, 25)
        for i in range(at + p, min(n, at + p * rng.randrange(2, 9))):
            words[i] = words[i - p]
    return words


def test_runs_are_all_runs():
    rng = random.Random(5)
    for _ in range(600):
        words = random_words(rng)
        code = np.array([ord(w) for w in words])
        assert find_runs(code, len(code)) == plain_runs(words), words
        assert find_runs(code, len(code), 9, 3) == plain_runs(words, 9, 3), words


def test_a_long_document_of_runs():
    u = [f"w{i}" for i in range(1000)]
    words = ["a"] * 50_000 + u * 30 + ["b", "c"] * 40_000
    code = np.unique(words, return_inverse=True)[1]
    assert find_runs(code, len(code)) == [(0, 50_000, 1), (50_000, 30_000, 1000), (80_000, 80_000, 2)]


def test_periodic_rows(spark):
    rng = random.Random(6)
    texts = [" ".join(random_words(rng)) for _ in range(300)] + [None, "", " \n\t ", "x" * 3000, "a  a\n\na\ta a a", "é é é é é é é", "\u00a0 \u00a0 \u00a0 \u00a0 \u00a0 \u00a0"]
    rows = [(i, t, "en", 7) for i, t in enumerate(texts)] + [(3, texts[3], "en", 7), (None, "b b b b b b", "en", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, words int")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df.repartition(3)).collect()), key=repr)
    want = []
    for doc, text, *_ in rows:
        words = re.findall(GAP, text or "")
        runs = plain_runs(words)
        want.append((doc, len(words), runs, collapsed(words, runs)))
    assert got == sorted(want, key=repr)
    assert periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(df, 6, 2)


def test_op11_by_the_contract(spark, sf):
    got = {r.doc_id: r.asDict() for r in queries.op11_periodic_runs(spark, sf).collect()}
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert len(got) == len(docs)
    for doc, text in docs:
        words = re.findall(GAP, text or "")
        n, h = len(words), zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue  # the plain version is quadratic
        runs = plain_runs(words)
        row = got[doc]
        assert row["n_runs"] == len(runs)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        assert (row["start"], row["length"], row["period"]) == top
        assert row["exponent_milli"] == (1000 * top[1] // top[2] if runs else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op12_url_filters", "op13_importance_resampling"])
def test_sql(spark, sf, name):
    assert oracle.compare(spark, oracle.connect(sf), sf, queries.queries()[name], queries.oracle_sql()[name])


def test_domains(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "example.co.uk": ("example.co.uk", "co.uk"), "x.example.co.uk:8080": ("example.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "localhost": ("localhost",) * 2, "10.0.0.1:80": ("10.0.0.1",) * 2, "": ("", ""), "com": ("com", "com")}
    d, s = domain(F.col("h"))
    assert {r.h: (r.d, r.s) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", d.alias("d"), s.alias("s")).collect()} == hosts


def test_rules_and_reputation(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow")]
    urls = {
        "https://a.example.com/en/1?x": ("a.example.com", "/en/1", "example.com/en/", "block"), "HTTP://WWW.Example.COM/en/#t": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://example.com": ("example.com", "", None, "allow"), "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "http://example.com:80/en/": ("example.com:80", "/en/", None, "allow"),
        "x://bad.org/p?a=://b/c": ("bad.org", "/p", None, "block"), "x://good.org?q/": ("good.org", "", None, "allow"), "no scheme/en/": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
    }
    rows = [(i, u, 1) for i, u in enumerate(urls)]
    many = [(100 + i, f"x://{'bad' if i % 2 else 'good'}.org/{i}", 1) for i in range(2000)]
    outcomes = [(100 + i, i % 20 > 2 if i % 2 else i % 20 == 0) for i in range(2000)] + [(None, True), (100, None), (100, True)]
    pages = spark.createDataFrame(rows + many + [rows[0]], "page_id long, url string, host int")
    got = judge(pages, spark.createDataFrame(outcomes, "page_id long, bad boolean"), rules).collect()
    assert len(got) == len(rows) + len(many) + 1
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got if r.page_id < 100} == {(i, *urls[u]) for i, u, _ in rows}
    assert {r.verdict for r in got if r.host == "bad.org"} == {"block"} and {r.verdict for r in got if r.host == "good.org"} == {"allow"}
    none = judge(pages, spark.createDataFrame([], "page_id long, bad boolean"), rules)
    assert none.where("rule is null and verdict = 'block'").count() == 0 and none.count() == len(got)
    assert judge(pages.limit(0), spark.createDataFrame(outcomes, "page_id long, bad boolean"), rules).count() == 0


def plain_resample(docs, target, most, buckets, percent, least):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in features(x):
                side[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for doc, x in docs:
        f = [gain[b] for b in features(x)]
        weight = sum(f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x)) >= least])
    rows.sort(key=lambda r: (not r[5], -r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i in range(sum(r[5] for r in rows) * percent // 100):
        rows[i][4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("most", [1, 3])
def test_resampling(spark, most):
    rng = random.Random(most)
    text = lambda: "".join(rng.choice(["The ", "cat,", "DOG ", "über", "-", " 12", "x_y ", "\u00a0", "漢字 ", "a\x00b "]) for _ in range(rng.randrange(90)))
    docs = [(i, text()) for i in range(400)] + [(400, None), (401, ""), (402, " .- "), (403, "long " * 30_000), (None, text() + "w " * 30), (7, "again " * 25), (7, "again " * 25)]
    target = [text() for _ in range(20)] + [None]
    df = spark.createDataFrame([(*d, "c", 3) for d in docs], "doc_id long, text string, weight string, found int")
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = sorted((tuple(r) for r in resample(df.repartition(5), aim, most, 500, percent=30).collect()), key=repr)
    assert got == plain_resample(docs, target, most, 500, 30, 20)
    assert resample(df.limit(0), aim).count() == 0 and resample(df, aim.limit(0)).where("rank is not null").count() > 0
