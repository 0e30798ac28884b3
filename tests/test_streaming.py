"""A stream of files gives what a table gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from measurelake.streaming.quantities import counts_by_window, parse_stream


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", "5 kg"), ("2024-01-01 00:00:50", "1 to 2 m"), ("2024-01-01 00:01:10", "7 s"), ("2024-01-01 00:01:20", "nothing"), (None, "3 m")]
    table = spark.createDataFrame(rows, "at string, span string").select(F.col("at").cast("timestamp").alias("at"), "span")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = counts_by_window(parse_stream(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), F.col("span")), "at", "1 minute", "10 minutes")
    run = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = counts_by_window(parse_stream(table, F.col("span")), "at", "1 minute", "10 minutes")
    key = lambda r: (r.start.minute, r.type, r.n, r.parsed_n)
    got = sorted(map(key, spark.table("counts").collect()))
    assert got == sorted(map(key, want.collect())) == [(0, "range", 1, 1), (0, "single_quantity", 1, 1), (1, "single_quantity", 1, 1), (1, "unknown", 1, 0)]
