"""Stream jobs against the same jobs over whole tables."""

import pytest
from pyspark.sql import functions as F

from lectern import queries
from lectern.operators import contracts, matcher
from lectern.plans import derived
from lectern.streaming import jobs, match_stream

KEY = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("words"))
    d = queries._display(spark, sf).where("clip_id % 5 = 1")
    o = derived.observed_tokens(d).select("clip_id", "w", "s", "e")
    d.write.parquet(f"{root}/display")
    d = spark.read.parquet(f"{root}/display")
    ends = o.groupBy("clip_id").agg(F.min(F.struct("s", "w")).alias("lo"), F.max(F.struct("s", "w")).alias("hi"))
    marked = o.join(ends, "clip_id").select("clip_id", "w", "s", "e", (F.struct("s", "w") == F.col("lo")).alias("first"), (F.struct("s", "w") == F.col("hi")).alias("last"))
    marked.write.parquet(f"{root}/all")
    return root, d, spark.read.parquet(f"{root}/all")


@pytest.mark.parametrize("cuts", [[7.0, 11.5], [0.5 * k for k in range(1, 12)]])
def test_stream_matcher_is_the_batch_matcher(spark, tables, cuts):
    root, d, words = tables
    old = spark.conf.get(KEY)
    spark.conf.set(KEY, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        at = f"{root}/in{len(cuts)}"
        for lo, hi in zip([float("-inf"), *cuts], [*cuts, float("inf")], strict=True):
            words.where((F.col("s") >= lo) & (F.col("s") < hi)).coalesce(1).write.mode("append").parquet(at)
        pages = match_stream.pages(d).persist()
        stream = spark.readStream.schema(words.schema).option("maxFilesPerTrigger", 1).parquet(at)
        out = match_stream.stream_match(stream, pages)
        q = out.writeStream.format("parquet").option("path", f"{root}/out{len(cuts)}").option("checkpointLocation", f"{root}/ck{len(cuts)}").trigger(availableNow=True).start()
        q.awaitTermination(400)
        assert q.exception() is None and len(q.recentProgress) >= len(cuts)
    finally:
        spark.conf.set(KEY, old)
    got = spark.read.parquet(f"{root}/out{len(cuts)}")
    want = matcher.match_tokens(d, words)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_monitor_counts_once_over_a_restart(spark, tables):
    root, d, words = tables
    truth = derived.placements(d, derived.observed_tokens(d)).withColumn("asr_conf", F.lit(1.0)).withColumn("match_conf", F.lit(1.0))
    truth.repartition(4, "clip_id").write.parquet(f"{root}/placed")
    placed = spark.read.parquet(f"{root}/placed")
    run = match_stream.monitor_contract(d, f"{root}/violations", 60.0, 96.0)
    calls = []

    def failing(batch, n):
        run(batch, n)
        calls.append(n)
        if len(calls) == 2:
            raise RuntimeError("the job dies after it wrote its batch")

    for f in (failing, run):
        stream = spark.readStream.schema(placed.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/placed")
        q = stream.writeStream.foreachBatch(f).option("checkpointLocation", f"{root}/ck-monitor").trigger(availableNow=True).start()
        try:
            q.awaitTermination(300)
        except Exception as e:
            assert f is failing, e
    want = contracts.contract_violations(d, placed, 60.0, 96.0).groupBy("invariant").agg(F.count("*").alias("violations"), F.countDistinct("clip_id").alias("clips"))
    got = sorted(map(tuple, match_stream.violation_counts(spark, f"{root}/violations").collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) >= 2


def test_repeated_deliveries_go(spark, tmp_path):
    rows = spark.sql("SELECT id % 7 AS k, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts FROM range(40)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = jobs.dedupe(stream, ["k"], "10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(7))


def test_late_ledger(spark, tmp_path):
    calls = spark.sql("SELECT id AS call_id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id, 0) AS ts FROM range(20)")
    ledger = calls.where("call_id % 3 <> 0").select("call_id", (F.col("ts") + F.expr("CASE WHEN call_id % 5 = 0 THEN interval 10 minutes ELSE interval 30 seconds END")).alias("debited_at"), F.lit(5).alias("debit"))
    for name, df in (("calls", calls), ("ledger", ledger)):
        df.write.parquet(str(tmp_path / name))
    a, b = (spark.readStream.schema(df.schema).parquet(str(tmp_path / name)) for name, df in (("calls", calls), ("ledger", ledger)))
    q = jobs.reconcile(a, b).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    got = {r.call_id: r.debit for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k for k, v in got.items() if v == 5} == {k for k in range(20) if k % 3 and k % 5}
    # Calls without a debit are told once the watermark has passed their interval.
    assert all(v is None for k, v in got.items() if not (k % 3 and k % 5)) and len(got) > len([v for v in got.values() if v])
