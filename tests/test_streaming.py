from pyspark.sql import functions as F

from corpusloom.streaming import duplicates


def test_stream_counts_and_first_files(spark, tmp_path):
    rows = [(0, f"f{i}", bytearray(b"a b" if i % 2 else b"a\tb" if i == 0 else b"c%d" % i)) for i in range(6)]
    schema = "repo_id int, path string, content binary"
    spark.createDataFrame(rows, schema).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"{schema}, ts timestamp").parquet(str(tmp_path / "in"))
    for name, plan, mode in (("counted", duplicates.counts(stream), "complete"), ("firsts", duplicates.first_seen(stream), "append")):
        q = plan.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.n_members for r in spark.table("counted").collect()) == [1, 1, 4]
    assert spark.table("firsts").count() == 3
