import time

from pyspark.sql import functions as F

from geomill.streaming import cache, messages, progress


def run(stream, out, checkpoint):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination(60)


def test_entries_expire_and_are_asked_again(spark, tmp_path):
    for k, v in cache.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        schema = "key string, time timestamp"
        put = lambda rows: spark.createDataFrame(rows, "key string, s double").select("key", F.timestamp_seconds("s").alias("time")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        put([("a", 0.0), ("a", 7.0), ("b", 1.0), ("a", 15.0), ("a", 16.0), ("a", 31.0)])
        stream = cache.cached(messages.read_stream(spark, f"{tmp_path}/in", schema, 100), "key", 15.0)
        query = stream.writeStream.format("memory").queryName("asked").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()

        def seen(many):
            until = time.time() + 60
            while (rows := spark.table("asked").collect()) and len(rows) < many or not rows:
                assert time.time() < until and query.isActive
                time.sleep(0.3)
            return {(r.key, int(r.time.timestamp())): r.hit for r in rows}

        assert seen(6) == {("a", 0): False, ("a", 7): True, ("a", 15): True, ("a", 16): False, ("a", 31): True, ("b", 1): False}
        put([("a", 30.0), ("b", 9.0)])  # soon after: both are in the store
        found = seen(8)
        assert found["a", 30] and found["b", 9]
        time.sleep(17)  # the store drops both entries, though by their own times they would still hold
        put([("a", 29.0), ("b", 10.0)])
        found = seen(10)
        assert not found["a", 29] and not found["b", 10]
        query.stop()
    finally:
        for k in cache.STATE_STORE:
            spark.conf.unset(k)


def test_progress_of_a_job_and_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, ("error", "info")[i % 2]) for i in range(40)], "seq long, severity string")
    job = progress.Progress("rows", total=80)
    job.watch(rows.repartition(3), errors=F.count_if(F.col("severity") == "error")).write.parquet(f"{tmp_path}/in")
    assert job.counts() == {"n": 40, "errors": 20, "share": 0.5}
    listener = progress.StreamProgress("seen")
    spark.streams.addListener(listener)
    try:
        stream = progress.watched(messages.read_stream(spark, f"{tmp_path}/in", rows.schema), "seen", errors=F.count_if(F.col("severity") == "error"))
        run(stream, f"{tmp_path}/out", f"{tmp_path}/c")
        for _ in range(100):
            if listener.totals().get("n") == 40:
                break
            time.sleep(0.2)
        assert listener.totals() == {"n": 40, "errors": 20} and len(listener.batches) >= 3
    finally:
        spark.streams.removeListener(listener)
