"""Points of a stream against fixed polygons, and counts by polygon and window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspace.functions.geometry import point, point_in_ring


def within(stream: DataFrame, polygons: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    """The stream's rows with the id of each polygon that they lie in or on, `state` 1 or 0.

    polygons: id, geom. Both sides meet in grid cells of a fixed size, so each micro-batch
    joins by equality with the static side.
    """
    g = F.col("geom")
    span = lambda lo, hi: F.sequence(F.floor(g[lo] / cell), F.floor(g[hi] / cell))
    cells = F.flatten(F.transform(span("minx", "maxx"), lambda i: F.transform(span("miny", "maxy"), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    fixed = polygons.select(F.col("id").alias("polygon_id"), "geom", F.explode(cells).alias("cell"))
    at = F.struct(F.floor(F.col(x) / cell).alias("i"), F.floor(F.col(y) / cell).alias("j"))
    rows = stream.withColumn("cell", at).join(fixed, "cell")
    p = point(F.col(x), F.col(y))
    rows = rows.where(F.col(x).between(g["minx"], g["maxx"]) & F.col(y).between(g["miny"], g["maxy"]))
    return rows.withColumn("state", point_in_ring(F.element_at(p["pts"], 1), g["pts"])).where("state >= 0").drop("cell", "geom")


def counts(hits: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, polygon_id, n: hits by window and polygon, with a watermark for late rows."""
    return hits.withWatermark(time, late).groupBy(F.window(time, window), "polygon_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "polygon_id", "n")
