"""Geometries derived from the driver's tables by whole-number arithmetic, so that any engine computes the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspace.functions import geometry as G
from loomspace.operators.order import block_of, numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Keys dealt out to all cores: their files are small and read by few tasks, and geometry is much work a row."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def _boxed(df: DataFrame) -> DataFrame:
    """The geometry computed once a row: behind a generator it isn't written out again wherever a part of it is named."""
    df = df.select(*(c for c in df.columns if c != "geom"), F.explode(F.array("geom")).alias("geom"))
    return df.select("*", *(F.col("geom")[c].alias(c) for c in ("minx", "miny", "maxx", "maxy")))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, scene, geom of customers: a point each."""
    k = F.col("c_custkey")
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")).select(k.alias("id"), F.col("c_nationkey").cast("long").alias("scene"), G.point((k * 7919) % 1000, (k * 104729) % 1000).alias("geom"))
    return _boxed(rows)


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, k, scene, geom of parts: squares (k = 0), diamonds (1) and right triangles (2)."""
    p = F.col("p_partkey")
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(p.alias("id"), (p % 3).cast("int").alias("k"), (p % 25).alias("scene"), ((p * 6151) % 980).cast("double").alias("x"), ((p * 3571) % 980).cast("double").alias("y"), (4 + 2 * (F.col("p_size") % 9)).cast("double").alias("w"))
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    h = w / 2
    square = F.array(G.xy(x, y), G.xy(x + w, y), G.xy(x + w, y + w), G.xy(x, y + w))
    diamond = F.array(G.xy(x + h, y), G.xy(x + w, y + h), G.xy(x + h, y + w), G.xy(x, y + h))
    triangle = F.array(G.xy(x, y), G.xy(x + w, y), G.xy(x, y + w))
    ring = F.when(F.col("k") == 0, square).when(F.col("k") == 1, diamond).otherwise(triangle)
    return _boxed(rows.select("id", "k", "scene", G.polygon(ring).alias("geom")))


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes(spark, sf_dir).where("k = 0")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, geom of suppliers: a segment each."""
    k = F.col("s_suppkey")
    ends = F.array(G.xy((k * 6151) % 1000, (k * 3571) % 1000), G.xy((k * 7919) % 1000, (k * 104729) % 1000))
    return _boxed(spread(table(spark, sf_dir, "supplier").select("s_suppkey")).select(k.alias("id"), G.line(ends).alias("geom")))


def level_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, geom of suppliers: horizontal segments of length 100 at half heights, so that they never run along an edge."""
    k = F.col("s_suppkey")
    x, y = ((k * 6151) % 900).cast("double"), ((k * 3571) % 980).cast("double") + 0.5
    return _boxed(spread(table(spark, sf_dir, "supplier").select("s_suppkey")).select(k.alias("id"), G.line(F.array(G.xy(x, y), G.xy(x + 100, y))).alias("geom")))


def generated_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, geom, kind by name: squares and points as one table."""
    one = lambda df, kind: df.select(F.concat(F.lit(kind), F.col("id").cast("string")).alias("name"), "geom")
    return one(squares(spark, sf_dir), "POLYGON_").unionByName(one(points(spark, sf_dir), "POINT_"))


def named_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, geom of all shapes and points as one table."""
    one = lambda df, kind: df.select(F.concat(F.lit(kind), F.col("id").cast("string")).alias("name"), "geom")
    return one(shapes(spark, sf_dir), "POLYGON_").unionByName(one(points(spark, sf_dir), "POINT_"))


def _in_order(rows: DataFrame, keys: DataFrame) -> DataFrame:
    placed = numbered(rows, ["scene_id"], [F.col("first"), block_of(F.col("id"))], ["id"], "place", keys)
    return placed.select("scene_id", F.col("place").cast("int").alias("ord"), "name", "geom")


def _keys(df: DataFrame, scene: Column, first: int, key: str) -> DataFrame:
    """The rows of a table as keys of a scene, without their geometry."""
    return df.select(scene.cast("long").alias("scene_id"), F.lit(first).alias("first"), F.col(key).alias("id"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, ord, name, geom: shapes of all three kinds and then points of each of 25 scenes."""
    one = lambda df, kind, first: df.select(F.col("scene").alias("scene_id"), F.lit(first).alias("first"), "id", F.concat(F.lit(kind), F.col("id").cast("string")).alias("name"), "geom")
    rows = one(shapes(spark, sf_dir), "POLYGON_", 0).unionByName(one(points(spark, sf_dir), "POINT_", 1))
    keys = _keys(table(spark, sf_dir, "part"), F.col("p_partkey") % 25, 0, "p_partkey").unionByName(_keys(table(spark, sf_dir, "customer"), F.col("c_nationkey"), 1, "c_custkey"))
    return _in_order(rows, keys)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, ord, name, geom: squares, then level lines of suppliers on forty heights, of each of five scenes."""
    k = F.col("s_suppkey")
    x, y = ((k * 6151) % 900).cast("double"), (((k * 3571) % 40) * 20).cast("double") + 0.5
    level = _boxed(spread(table(spark, sf_dir, "supplier").select("s_suppkey")).select(k.alias("id"), G.line(F.array(G.xy(x, y), G.xy(x + 100, y))).alias("geom")))
    one = lambda df, kind, first: df.select((F.col("id") % 5).alias("scene_id"), F.lit(first).alias("first"), "id", F.concat(F.lit(kind), F.col("id").cast("string")).alias("name"), "geom")
    rows = one(squares(spark, sf_dir), "POLYGON_", 0).unionByName(one(level, "LINE_", 1))
    of_squares = table(spark, sf_dir, "part").where("p_partkey % 3 = 0")
    keys = _keys(of_squares, F.col("p_partkey") % 5, 0, "p_partkey").unionByName(_keys(table(spark, sf_dir, "supplier"), k % 5, 1, "s_suppkey"))
    return _in_order(rows, keys)
