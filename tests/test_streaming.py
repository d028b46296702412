from pyspark.sql import functions as F

from loomspace.functions import geometry as G
from loomspace.streaming import points


def test_points_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", 1.0, 1.0), ("2024-01-01 00:20:00", 4.0, 1.0), ("2024-01-01 02:00:00", 9.0, 9.0)]
    spark.createDataFrame(rows, "ts string, x double, y double").select(F.to_timestamp("ts").alias("ts"), "x", "y").write.parquet(str(tmp_path / "in"))
    polygon = spark.createDataFrame([(7, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))")], "id long, w string").select("id", G.from_wkt(F.col("w")).alias("geom"))
    stream = spark.readStream.schema("ts timestamp, x double, y double").parquet(str(tmp_path / "in"))
    q = points.counts(points.within(stream, polygon, "x", "y", 5.0), "ts").writeStream.format("memory").outputMode("complete").queryName("hits").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.polygon_id, r.n) for r in spark.table("hits").collect()] == [(7, 2)]
