"""Exact cosine top-k over a table of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import best_places, unit, vector_problem

#: Vectors of a shard, and queries that meet it in one task.
SHARD_VECTORS = 262_144
QUERY_BLOCK = 4096
#: Scores that a task holds at once.
HELD_SCORES = 4_000_000


def problems(vectors: DataFrame, dim: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, problem) of vectors that can't be indexed: null, dimension, not finite, or duplicate id."""
    bad = vectors.select(key, vector_problem(F.col(vector), dim).alias("problem")).where("problem IS NOT NULL")
    twice = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("duplicate id").alias("problem"))
    return bad.unionByName(twice)


def valid(vectors: DataFrame, dim: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, vector) of rows that can be indexed."""
    return vectors.where(F.col(key).isNotNull() & vector_problem(F.col(vector), dim).isNull()).select(key, vector)


def dimension(vectors: DataFrame, vector: str = "embedding") -> int:
    """The number of components that most vectors have; 0 without any."""
    sizes = vectors.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max(F.struct("n", "dim")).alias("m")).first()["m"]
    return most["dim"] if most else 0


def top_k_vectors(vectors: DataFrame, queries: DataFrame, k: int, include_self: bool = False, dim: int | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest of ``vectors`` for each query, cosine clamped to 0..1.

    Both have vec_id and embedding; rows with a null id, or a vector that is null, not finite or not of ``dim`` components (those
    of most vectors, if not given), are neither found nor asked. Vectors are dealt into shards and queries
    into blocks, and each block meets each shard in a task of its own; a task hands on k rows a query. Ties in nine decimals
    go to the smaller id.
    """
    dim = dimension(vectors) if dim is None else dim
    rows, asked = valid(vectors, dim), valid(queries, dim)
    shards, blocks = (max(1, -(-df.count() // n)) for df, n in ((rows, SHARD_VECTORS), (asked, QUERY_BLOCK)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("long")
    # A few shards would leave cores without work: a small table is cut finer.
    shards = max(shards, rows.sparkSession.sparkContext.defaultParallelism)
    left = rows.select("vec_id", "embedding", dealt(shards).alias("shard"), every(blocks).alias("block"))
    right = asked.select("vec_id", "embedding", every(shards).alias("shard"), dealt(blocks).alias("block"))

    def of_block(found: pa.Table, asking: pa.Table) -> pa.Table:
        own, ids = (t.column("vec_id").to_numpy() for t in (found, asking))
        by = np.argsort(own, kind="stable")
        own, v, q = own[by], unit(_matrix(found, dim))[by], unit(_matrix(asking, dim))
        out: list[tuple[np.ndarray, ...]] = []
        step = max(1, HELD_SCORES // max(1, len(own)))
        for a in range(0, len(ids) if len(own) else 0, step):
            scores = np.clip(q[a : a + step] @ v.T, 0.0, 1.0)
            keys = np.round(scores, 9)
            if not include_self:
                keys[own[None, :] == ids[a : a + step, None]] = -1.0
            place = best_places(keys, min(k, len(own)))
            row = np.repeat(np.arange(len(scores)), place.shape[1])
            key = keys[row, place.ravel()]
            kept = key >= 0
            out.append((ids[a : a + step][row][kept], own[place.ravel()][kept], scores[row, place.ravel()][kept], key[kept]))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        columns = [pa.array(np.concatenate([x[j] for x in out]) if out else [], kind) for j, kind in enumerate(kinds)]
        return pa.table(columns, names=["query_id", "vec_id", "score", "key"])

    keys = ["shard", "block"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(of_block, "query_id long, vec_id long, score double, key double")
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def _matrix(table: pa.Table, dim: int) -> np.ndarray:
    flat = table.column("embedding").combine_chunks().flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), float).reshape(len(table), dim)


class VectorTable:
    """A table of vectors by id: added in checked parts, searched, emptied."""

    def __init__(self, spark: SparkSession, dim: int) -> None:
        self.spark, self.dim = spark, dim
        self.reset()

    def reset(self) -> None:
        self.rows = self.spark.createDataFrame([], "vec_id long, embedding array<double>")

    def add(self, vectors: DataFrame) -> None:
        """ValueError if one of them can't be indexed or has an id that is there already."""
        more = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        both = self.rows.unionByName(more)
        wrong = problems(both, self.dim).limit(5).collect()
        if wrong:
            raise ValueError("vectors can't be added: " + ", ".join(f"{r['vec_id']} ({r['problem']})" for r in wrong))
        self.rows = both

    def ids(self) -> DataFrame:
        return self.rows.select("vec_id")

    def __len__(self) -> int:
        return self.rows.count()

    def __contains__(self, vec_id: int) -> bool:
        return not self.rows.where(F.col("vec_id") == vec_id).isEmpty()

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return top_k_vectors(self.rows, queries, k, include_self=True, dim=self.dim)
