"""Small graph utilities over ``vertices(id, attrs)`` and ``edges``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attribute(name: str, default: str) -> Column:
    """``attrs[name]``, else the default."""
    return F.coalesce(F.col("attrs")[name], F.lit(default))


def node_colors(vertices: DataFrame, default: str = "lightblue") -> DataFrame:
    return vertices.select("id", attribute("color", default).alias("color"))


def geo_clusters(vertices: DataFrame, k: int = 2, seed: int = 42) -> DataFrame:
    """Adds ``cluster`` by k-means over ``lat, lon``, numbered by the smallest id of each."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["lat", "lon"], outputCol="_at").transform(vertices)
    told = KMeans(k=k, seed=seed, featuresCol="_at", predictionCol="_c").fit(rows).transform(rows).drop("_at")
    names = told.groupBy("_c").agg(F.min("id").alias("cluster"))  # at most k rows
    return told.join(F.broadcast(names), "_c").drop("_c")


def aggregate_clusters(told: DataFrame, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Clusters as nodes (mean place, summed load); edges between clusters, reactances and limits summed."""
    nodes = told.groupBy("cluster").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.sum("load").alias("load"), F.count("*").alias("members"))
    if edges is None:
        return nodes, None
    of = told.select("id", "cluster")
    ends = edges.join(of.select(F.col("id").alias("src"), F.col("cluster").alias("a")), "src").join(of.select(F.col("id").alias("dst"), F.col("cluster").alias("b")), "dst")
    return nodes, ends.filter("a <> b").groupBy("a", "b").agg(F.sum("x").alias("x"), F.sum("p_max").alias("p_max"), F.count("*").alias("n"))


def dot_source(vertices: DataFrame, edges: DataFrame, default: str = "lightblue") -> DataFrame:
    """A graph's drawing as lines of DOT source, ``kind, line``: a node line each with its colour, an edge line each."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    nodes = node_colors(vertices, default).select(F.lit("node").alias("kind"), F.concat(F.lit("  "), quoted("id"), F.lit(" [style=filled, fillcolor="), quoted("color"), F.lit("];")).alias("line"))
    return nodes.unionByName(edges.select(F.lit("edge").alias("kind"), F.concat(F.lit("  "), quoted("src"), F.lit(" -- "), quoted("dst"), F.lit(";")).alias("line")))
