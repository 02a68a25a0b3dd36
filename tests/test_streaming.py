from pyspark.sql import functions as F

from graphloom.streaming.ingest import run_counts, run_to


def test_windows_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 01:00:00", "a"), ("2024-01-01 02:00:00", "a"), ("2024-01-02 01:00:00", "b"), ("2024-01-09 00:00:00", "z")]
    spark.createDataFrame(rows, "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, event_type string").parquet(str(tmp_path / "in"))
    run_to(run_counts(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(str(r["started_at"])[:10], r["event_type"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("2024-01-01", "a", 2), ("2024-01-02", "b", 1)}
