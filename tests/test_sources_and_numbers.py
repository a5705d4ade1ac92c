"""RIFF walks, word files, spelled numbers, expansion and back, bootstrap intervals, and sets of one basis."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from lectern.functions import expand
from lectern.operators import artifacts, contracts, costs
from lectern.sources import files


def riff(*chunks, name=b"WAVE"):
    body = b"".join(k + struct.pack("<I", n) + v + b"\0" * (len(v) % 2) for k, n, v in chunks)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + name + body


FMT = (b"fmt ", 16, struct.pack("<HHIIHH", 1, 2, 8000, 32000, 4, 16))


def test_riff_chunks(spark, tmp_path):
    wavs = {
        "plain": riff(FMT, (b"data", 32000, b"\0" * 32000)),
        "odd": riff((b"LIST", 5, b"abcde"), FMT, (b"fact", 4, b"\1\0\0\0"), (b"data", 32000, b"\0" * 32000)),
        "streaming": riff(FMT, (b"data", 0xFFFFFFFC, b"\0" * 16000)),
        "no_align": riff((b"fmt ", 16, struct.pack("<HHIIHH", 1, 2, 8000, 0, 0, 16)), (b"data", 8, b"\0" * 3200)),
        "no_data": riff(FMT, (b"LIST", 4, b"abcd")),
        "other": b"OggS" + b"\0" * 60, "short": b"RI", "cut": riff(FMT)[:20],
    }
    for k, v in wavs.items():
        (tmp_path / f"{k}.wav").write_bytes(v)
    got = {r.path.rpartition("/")[2][:-4]: r for r in files.audio_manifest(spark, str(tmp_path), F.col("path").contains("odd")).collect()}
    assert set(got) == set(wavs)
    assert {k: (r.sample_rate, r.channels, r.bits, r.declared_data_bytes, r.actual_data_bytes, r.seconds, r.header_bogus, r.fault) for k, r in got.items()} == {
        "plain": (8000, 2, 16, 32000, 32000, 1.0, False, None), "odd": (8000, 2, 16, 32000, 32000, 1.0, False, None), "streaming": (8000, 2, 16, 0xFFFFFFFC, 16000, 0.5, True, None),
        "no_align": (8000, 2, 16, 8, 3200, 0.1, True, None), "no_data": (None,) * 7 + ("no fmt or data chunk",), "cut": (None,) * 7 + ("no fmt or data chunk",),
        **{k: (None,) * 7 + ("not RIFF/WAVE",) for k in ("other", "short")},
    }
    assert got["odd"].reconstructible and not got["plain"].reconstructible and got["plain"].bytes == len(wavs["plain"])


def test_words_in_segments(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"clip_id": 1, "segments": [{"start": 0, "end": 2, "words": [{"word": " a ", "start": 0.0, "end": 0.5}]}, {"start": 2, "end": 3}, {"words": [{"w": "b", "s": 2.0, "e": 2.5, "p": 0.9}]}]}\n{"clip_id": 2, "words": [{"w": "c", "s": 1.0, "e": 1.5}]}\n')
    assert sorted((r.clip_id, r.w, r.s, r.e, r.p) for r in files.flat_words(spark, str(tmp_path / "a.json")).collect()) == [(1, "a", 0.0, 0.5, None), (1, "b", 2.0, 2.5, 0.9), (2, "c", 1.0, 1.5, None)]
    (tmp_path / "b.json").write_text('{"clip_id": 3, "segments": [{"start": 0, "end": 2, "text": "a b"}]}\n')
    with pytest.raises(Exception, match="no word timings in clip 3"):
        files.flat_words(spark, str(tmp_path / "b.json")).collect()


def plain_spelled(n, lang):
    if n < 20:
        return [expand.UNITS[lang][n]]
    if n < 100:
        return [expand.TENS[lang][n // 10 - 2]] + (plain_spelled(n % 10, lang) if n % 10 else [])
    for size, word, low, high in ((100, None, 1100, 2000), (100, expand.HUNDRED, 0, 1000), (1000, expand.THOUSAND, 0, 10**6)):
        if low <= n < high:
            return plain_spelled(n // size, lang) + ([word[lang]] if word else []) + (plain_spelled(n % size, lang) if n % size else [])


def test_spelled_numbers(spark):
    numbers = [*range(0, 2300), *random.Random(1).sample(range(10**6), 300), 999_999, 100_000, 1_000_000, 110_000, 150_100]
    df = spark.createDataFrame([(n, lang) for n in numbers for lang in ("en", "es", "fr", "de")], "n long, lang string")
    for r in df.withColumn("w", expand.spelled(F.col("n"), F.col("lang"))).collect():
        want = plain_spelled(r.n, r.lang) if r.lang != "de" else None
        assert r.w == want, (r.n, r.lang, r.w, want)


def test_expansion_and_back_is_the_identity(spark):
    texts = ["In", "1984,", "l'été", "—", "1,250", "3rd", "Łódź", "ﬁn", "42", "0", "99999999999999999", "x"]
    d = spark.createDataFrame([(c, "en", i, t) for c in range(3) for i, t in enumerate(texts)], "clip_id long, lang string, disp_idx int, text string")
    parts = expand.expanded(d).persist()
    got = {}
    for r in parts.where("clip_id = 1").orderBy("disp_idx", "part").collect():
        got.setdefault(r.disp_idx, []).append(r.word)
    assert got == {0: ["in"], 1: ["nineteen", "eighty", "four"], 2: ["l'ete"], 4: ["twelve", "fifty"], 5: ["rd"], 6: ["odz"], 7: ["fin"], 8: ["forty", "two"], 9: ["zero"], 11: ["x"]}
    # Every token's span cut into its parts, and put together again.
    spans = d.select("clip_id", "disp_idx", (F.col("disp_idx") * 1.0).alias("s"), (F.col("disp_idx") + 0.75).alias("e"))
    n = parts.groupBy("clip_id", "disp_idx").agg(F.count("*").alias("n"))
    timed = parts.join(spans, ["clip_id", "disp_idx"]).join(n, ["clip_id", "disp_idx"])
    cut = timed.select("clip_id", "disp_idx", (F.col("s") + F.col("part") * (F.col("e") - F.col("s")) / F.col("n")).alias("s"), (F.col("s") + (F.col("part") + 1) * (F.col("e") - F.col("s")) / F.col("n")).alias("e"))
    back = contracts.owner_spans(cut).join(spans.withColumnsRenamed({"s": "s0", "e": "e0"}), ["clip_id", "disp_idx"])
    assert back.count() == n.count() and back.where("abs(s - s0) > 1e-9 or abs(e - e0) > 1e-9").count() == 0


def drawn_interval(blocks, seed, iters=10_000):
    import numpy as np

    rng = np.random.default_rng(seed)
    t, d = np.array(blocks).T
    picks = rng.integers(0, len(blocks), (iters, len(blocks)))
    diffs = np.sort(100.0 * d[picks].sum(1) / t[picks].sum(1))
    return diffs[int(0.025 * (iters - 1))], diffs[int(0.975 * (iters - 1))]


@pytest.mark.parametrize("k", [20, 50, 200, 1000, 5000])
def test_bootstrap_intervals(spark, k):
    rng = random.Random(k)
    rows, blocks = [], []
    for block in range(k):
        bias, n = rng.random(), rng.randrange(4, 20)
        outcomes = [(int(rng.random() < 0.5 + bias / 2), int(rng.random() < 0.4)) for _ in range(n)]
        rows += [(block, *x) for x in outcomes]
        blocks.append((n, sum(a - b for a, b in outcomes)))
    r = costs.block_bootstrap(spark.createDataFrame(rows, "block int, a int, b int"), "a", "b", "block").first()
    lows, highs = zip(*(drawn_interval(blocks, s) for s in range(3 if k < 5000 else 1)), strict=True)
    width = sum(highs) / len(highs) - sum(lows) / len(lows)
    slack = (0.15 if k == 20 else 0.08) * width
    assert abs(r.low - sum(lows) / len(lows)) < slack and abs(r.high - sum(highs) / len(highs)) < slack, (r, lows, highs)


def test_bootstrap_controls(spark):
    rows = [(i // 40, int(i < 40), 1, i) for i in range(80)]
    df = spark.createDataFrame(rows, "block int, a int, b int, i int")
    blocked, single = (costs.block_bootstrap(df, "a", "b", c).first() for c in ("block", "i"))
    assert blocked.high - blocked.low > single.high - single.low
    same = costs.block_bootstrap(df.withColumn("a", F.col("b")), "a", "b", "i").first()
    assert (same.n, same.low, same.high) == (80, 0.0, 0.0)
    assert costs.block_bootstrap(df.limit(0), "a", "b", "i").count() == 0


def test_one_basis_against_plain_sets(spark):
    rng = random.Random(9)
    have = [(f"f{f}", b, float(rng.randrange(30))) for f in range(12) for b in "xy" for _ in range(8)]
    want = [(s, float(rng.randrange(33))) for s in range(300) for _ in range(rng.randrange(1, 4))]
    got = {r.set_id: (r.size, r.consistent) for r in artifacts.one_basis(spark.createDataFrame(have, "file string, basis string, value double"), spark.createDataFrame(want, "set_id long, value double")).collect()}
    bases = {}
    for f, b, v in have:
        bases.setdefault((f, b), set()).add(v)
    sets = {}
    for s, v in want:
        sets.setdefault(s, set()).add(v)
    assert got == {s: (len(v), any(v <= b for b in bases.values())) for s, v in sets.items()}
    assert 0 < sum(c for _, c in got.values()) < len(got)
