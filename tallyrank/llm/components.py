"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, new_folder


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b) that isn't the smallest of its component.

    Labels live in tables of the shared folder, one a round, and never come to the driver; only a count and
    a checksum do. Each round is two aggregations with map-side combining and two equi-joins whose
    hot side can be split; the number of rounds grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    seen, before = None, None
    while True:
        path = new_folder(spark, "stars")
        now.write.parquet(path)
        table = spark.read.schema("a long, b long").parquet(path)
        state = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before is not None:
            drop_path(spark, before)
        if tuple(state) == seen or not state[0]:
            return table.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, before = tuple(state), path
        now = _small_star(_large_star(table))
