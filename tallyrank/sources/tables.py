"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt out to all cores where it has fewer splits than there are cores.

    A file of one row group is one split, however many cores wait; such a scan is small for the cluster,
    and what follows (tokenising, hashing, matching) costs far more than moving it once. Scans with
    enough splits stay as they are. Only for plain scans: others would be run to be counted.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
