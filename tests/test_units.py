import math
import statistics

import pyspark.sql.functions as F

from lectern.functions import text as t
from lectern.operators import align, quality, segments, stats
from lectern.sources.files import audio_manifest, recogniser_words
from lectern.streaming import jobs


def test_folds(spark):
    r = spark.createDataFrame([("L'Été!", "1,250")], "a string, b string").select(t.fold(F.col("a")).alias("f"), t.loose(t.fold(F.col("a"))).alias("l"), t.digits(F.col("b")).alias("d"), t.elisions(t.fold(F.col("a"))).alias("e")).first()
    assert (r.f, r.l, r.d) == ("l'été", "l'ete", "1250") and r.e == [["l", "'été"], ["l'", "été"]]


def tokens(words, kind):
    if kind == "display":
        return [(1, i, w) for i, w in enumerate(words)]
    return [(1, w, float(i), i + 0.5) for i, w in enumerate(words)]


def run(spark, page, said):
    d = spark.createDataFrame(tokens(page, "display"), "clip_id long, disp_idx int, text string")
    o = spark.createDataFrame(tokens(said, "observed"), "clip_id long, w string, s double, e double")
    return align.match_tokens(d, o).orderBy("match_seq").collect()


def test_matcher_places_resyncs_and_groups(spark):
    page = "a b c d e f g h i j k l m n o p".split()
    got = run(spark, page, "a b l m n o p".split())  # a dropped run of nine: beyond the look-ahead
    assert [r.disp_idx for r in got if r.kind == "match"] == [0, 1, 11, 12, 13, 14, 15]
    assert [r.after_resync for r in got if r.disp_idx == 11] == [True]
    got = run(spark, ["in", "1", "250", "days"], ["in", "1250", "days"])
    assert [(r.disp_idx, r.evidence) for r in got] == [(0, "exact"), (1, "shared_token"), (2, "shared_token"), (3, "exact")]
    got = run(spark, ["été", "x"], ["ete", "zzq", "x"])
    assert [(r.disp_idx, r.evidence, r.kind) for r in got] == [(0, "normalized", "match"), (None, None, "unmatched"), (1, "exact", "match")]


def test_tri_state_rules(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    rules = {"positive": F.col("x") > 0, "even": F.col("x") % 2 == 0}
    assert {r.rule: r.state for r in quality.expectations(df, rules).collect()} == {"positive": "pass", "even": "fail"}
    assert {r.state for r in quality.expectations(df.limit(0), rules).collect()} == {"unestablished"}


def test_reachable_ends_on_cycles(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("z", "y")], "child string, parent string")
    assert {r.name for r in quality.reachable(edges, spark.createDataFrame([("a",)], "name string")).collect()} == {"a", "b", "c"}


def test_sources(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"clip_id": 1, "word": " hi ", "start": 0.5, "end": 0.9}\n{"clip_id": 1, "w": "x", "s": 1.0, "e": 1.1, "p": 0.7}\n')
    assert [(r.w, r.s, r.p) for r in recogniser_words(spark, str(tmp_path / "w.json")).orderBy("s").collect()] == [("hi", 0.5, None), ("x", 1.0, 0.7)]
    wav = b"RIFF\0\0\0\0WAVEfmt " + (16).to_bytes(4, "little") + b"\1\0\1\0" + (8000).to_bytes(4, "little") + (16000).to_bytes(4, "little") + b"\2\0\x10\0data" + (99).to_bytes(4, "little") + b"\0" * 16000
    (tmp_path / "a.wav").write_bytes(wav)
    r = audio_manifest(spark, str(tmp_path / "a.wav")).first()
    assert (r.seconds, r.header_bogus, r.bytes) == (1.0, True, len(wav))


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events*.parquet")
    q = jobs.chunks(stream, delay="10 minutes").writeStream.outputMode("complete").format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("chunks").collect())) == sorted(map(tuple, jobs.chunks(events).collect()))


def test_order_scores_against_loops(spark):
    import random

    from lectern.operators import layout

    rnd = random.Random(4)
    pages = {f"p{k}": rnd.sample(range(n), n) for k, n in enumerate([1, 2, 7, 40])}
    rows = [(p, i, x) for p, v in pages.items() for i, x in enumerate(v)]
    for r in layout.order_scores(spark.createDataFrame(rows, "page_id string, place int, seq int")).collect():
        v = pages[r.page_id]
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        inv = sum(v[j] > v[i] for i in range(len(v)) for j in range(i))
        n = len(v)
        assert (r.n, r.lis, r.inversions) == (n, max(best), inv)
        assert abs(r.concordance - (1 - 2 * inv / (n * (n - 1)) if n > 1 else 1)) < 1e-6


def test_reachable_far(spark):
    from lectern.operators import quality

    edges = spark.createDataFrame([(i + 1, i) for i in range(12)] + [(0, 12), (50, 51)], "child long, parent long")
    assert sorted(r.name for r in quality.reachable(edges, spark.createDataFrame([(0,)], "name long")).collect()) == list(range(13))


def test_segments_hold_their_ceiling(spark):
    texts = [(1, "en", "x" * 2602 + ". Short one. " + "y" * 990 + "."), (2, "fr", None), (3, "fr", "")]
    docs = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    got = [(r.doc_id, r.segment_ord, r.first_ord, r.last_ord, r.chars) for r in segments.segment(docs).orderBy("segment_ord").collect()]
    assert got == [(1, 0, 0, 0, 2000), (1, 1, 1, 2, 614), (1, 2, 3, 3, 992)]
    assert "".join(r.sentence for r in segments.sentences(docs).orderBy("ord").collect()) == texts[0][2]


def test_fit_of_slopes(spark):
    """Interval, r and p of a small clip against plain sums; r stays within its bound, and clips of fewer than four pairs have no fit."""
    y = [0.0, 2.8, 3.2, 6.8, 7.2]
    rows = [(1, float(i), v) for i, v in enumerate(y)] + [(2, float(i), float(i)) for i in range(20)] + [(3, 1.0, 1.0)] * 3
    got = {r.clip_id: r for r in stats.slope(spark.createDataFrame(rows, "clip_id long, s double, delta_ms double")).collect()}
    n, mx, my = 5, 2.0, sum(y) / 5
    sxy, syy = sum((i - mx) * (v - my) for i, v in enumerate(y)), sum((v - my) ** 2 for v in y)
    b, se = sxy / 10, math.sqrt((syy - sxy * sxy / 10) / 3 / 10)
    r = sxy / math.sqrt(10 * syy)
    p = 2 * (1 - statistics.NormalDist().cdf(math.atanh(r) * math.sqrt(n - 3)))
    assert set(got) == {1, 2} and abs(got[1].slope - b) < 1e-4 and abs(got[1].slope_high - (b + 3.182446 * se)) < 1e-3
    assert abs(got[1].r - r) < 1e-4 and abs(got[1].p - p) < 1e-4 and got[2].r == 1.0
