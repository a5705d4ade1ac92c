import random

import numpy as np
from test_near_dedup import brute

from lectern.llm import near_dedup
from lectern.llm.near_dedup import near_duplicates


def similarity(a, b, slots):
    x = a ^ b
    unequal = sum(int(v).bit_count() for v in (x | x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return (1 - unequal / slots - 0.25) / 0.75


def test_estimate_of_small_sets_at_the_threshold():
    rng = np.random.default_rng(7)
    wide = slice(near_dedup.PERMUTATIONS, None)
    for n in (4, 8, 12, 20):
        for _ in range(150):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            few, many = ([near_dedup.packed(near_dedup.minima(s, which)) for s in (a, a[: n * 3 // 4])] for which in (slice(near_dedup.PERMUTATIONS), wide))
            assert similarity(*few, near_dedup.PERMUTATIONS) >= 0.75 - near_dedup.MARGIN
            assert similarity(*many, near_dedup.WIDE) >= 0.75 - near_dedup.WIDE_MARGIN


def test_short_texts_with_a_shared_pivot(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(250):  # 7 and 8 words, linked at exactly 0.75; the pivot of their buckets is linked with neither
        w = [f"w{rnd.randrange(10**9)}" for _ in range(12)]
        rows += [(10 * i, " ".join(w[:9])), (10 * i + 1, " ".join(w[2:9])), (10 * i + 2, " ".join([*w[2:9], w[10]]))]
        rows.append((10 * i + 3, " ".join(w[: rnd.randint(6, 12)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect())
    assert got == brute(rows)
