import random
import re

from lectern.llm.near_dedup import near_duplicates


def brute(rows):
    sets, parent = {}, {}
    for i, (d, text) in enumerate(rows):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i in sets:
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), low[find(i)] if sets[i] else rows[i][0]) for i in sets)


def fixture():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    base = [rnd.choice(words) for _ in range(120)]
    for i in range(60):  # a drifting chain and a star of edits
        if i % 3 == 0:
            base = list(base)
            base[rnd.randrange(120)] = rnd.choice(words)
            base[rnd.randrange(120)] = rnd.choice(words)
        w = list(base)
        for _ in range(i % 4):
            w[rnd.randrange(120)] = rnd.choice(words)
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 80)))) for i in range(40)]
    rows += [(3000, None), (3001, ""), (3002, " \n\t "), (3003, "one two"), (3004, "One  TWO\n"), (3005, "É x"), (3006, "é x"), (3007, rows[0][1].upper()), (3008, rows[5][1])]
    rows += [(3010, " ".join(rnd.choice(words) for _ in range(30_000)))]
    return rows


def test_against_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as label", "1 as key", "2 as n_shingles")
    got = near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_repeated_ids_null_ids_and_no_rows(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    docs = spark.createDataFrame([(5, a), (5, b), (7, a), (3, b), (9, a), (None, a), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == [(-1, None, True), (-1, None, True), (3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (9, 3, False)]
    assert near_duplicates(docs.limit(0)).count() == 0
