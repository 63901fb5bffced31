from pyspark.sql import functions as F

from geomill.streaming import messages


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, ("error", "info")[i % 2], f"m{i % 7}") for i in range(40)], "seq long, severity string, message string").withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = messages.read_stream(spark, f"{tmp_path}/in", rows.schema)
    once = messages.first_of_each(messages.one_in(stream, "seq", 2), "message")
    messages.write_routed(once, "severity", f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r.message for r in got} == {f"m{i}" for i in range(7)} and len(got) == 7


def test_windows_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, "k") for i in range(120)], "seq long, k string").withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    counted = messages.windowed(messages.read_stream(spark, f"{tmp_path}/in", rows.schema), "ts", "1 hour", None, ["k"])
    counted.writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start().awaitTermination(120)
    assert [r.n for r in spark.table("hours").orderBy("start").collect()] == [60, 60]
    assert messages.windowed(rows, "ts", "1 hour", "30 minutes", ["k"]).agg(F.sum("n")).first()[0] == 240
    assert messages.sessions(rows.filter("seq < 10 OR seq > 100"), "ts", "5 minutes", ["k"]).count() == 2
