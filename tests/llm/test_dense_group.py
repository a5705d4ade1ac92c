"""A dense group of near copies, half of them around the threshold: classes equal to brute force, and few candidate rows."""

import random

from lectern.llm import links
from lectern.llm.near_dedup import near_duplicates


def test_dense_group(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    texts = []
    for i in range(900):
        words = list(base)
        for at in rng.sample(range(160), rng.randrange(2, 9)):  # similarities of pairs from about 0.5 to 0.9
            words[at] = f"x{i}-{at}"
        texts.append(" ".join(words))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    linked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                linked += 1
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    want = {i: find(i) for i in range(len(sets))}
    assert len(set(want.values())) > 20 and linked > 10_000

    made = []
    real = links.table

    def counted(df, name):
        out = real(df, name)
        if set(out.columns) == {"a", "b"}:
            made.append(out.count())
        return out

    monkeypatch.setattr(links, "table", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert got == want
    assert max(made) < 0.25 * len(texts) * (len(texts) - 1) / 2, made
