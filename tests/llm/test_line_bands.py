import random

import corpus_pipeline
from lectern.llm import queries


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def threshold(n):
    return 0 if n < 20 else 1 if n < 128 else 2 if n < 512 else 3


def edited(rnd, x, n):
    y = list(x)
    for _ in range(n):
        k = rnd.randrange(1, len(y) - 1)
        y[k : k + rnd.randint(0, 1)] = rnd.choice(["", "Q", "Z"])
    return "".join(y)


def test_lines_of_all_lengths_against_brute_force(spark, tmp_path):
    rnd = random.Random(21)
    docs = [(1, "Home\nAbout us\n\nMIT"), (2, "About us\nhome\n  MIT "), (3, "x\nHome\n\n"), (4, None)]
    for n in (5, 18, 19, 20, 21, 60, 126, 128, 130, 300, 510, 513, 700):
        base = "a" + "".join(rnd.choice("bcdefgh ") for _ in range(n - 2)) + "a"
        docs += [(len(docs) + 1 + i, "\n".join([base, edited(rnd, base, k)])) for i, k in enumerate((0, 1, 2, 2, 3, 4))]
    places = sorted((d, i, x.strip()) for d, t in docs for i, x in enumerate((t or "").split("\n")) if x.strip())
    parent = list(range(len(places)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (*_, x) in enumerate(places):
        for j in range(i):
            y = places[j][2]
            t = threshold(min(len(x), len(y)))
            if find(i) != find(j) and (x == y or abs(len(x) - len(y)) <= t and edit(x, y) <= t):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = {p[:2]: places[find(i)][:2] for i, p in enumerate(places)}
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == want


def test_pipeline_drops_short_lines_and_long_ones_with_two_edits(spark):
    rnd = random.Random(22)
    long = "a" + "".join(rnd.choice("bcdefgh ") for _ in range(298)) + "a"
    other = long[:40] + "Q" + long[41:200] + "Z" + long[201:]
    docs = spark.createDataFrame([(1, f"Menu\n\nfirst\n{long}"), (2, f"Menu\n\nsecond\n{other}"), (3, "Menu")], "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "0L as n_chars")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {1: f"Menu\n\nfirst\n{long}", 2: "\nsecond"}
