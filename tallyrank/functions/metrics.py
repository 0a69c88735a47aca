"""Ranking metrics as columns and aggregates. A missing rank is a miss: 0, never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def within(rank: Column, k: int) -> Column:
    return F.coalesce((rank <= k).cast("double"), F.lit(0.0))


def reciprocal_rank(rank: Column) -> Column:
    return F.coalesce(F.lit(1.0) / rank, F.lit(0.0))


def ndcg(rank: Column, k: int) -> Column:
    return F.coalesce(F.when(rank <= k, F.lit(1.0) / F.log2(rank + 1.0)), F.lit(0.0))


def mean(x: Column) -> Column:
    """0 for no rows."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def percentile(x: Column, q: float) -> Column:
    """Exact, linear between neighbours; 0 for no rows."""
    if not 0 <= q <= 100:
        raise ValueError(f"q must be in [0, 100], got {q}")
    return F.coalesce(F.percentile(x, F.lit(q / 100)), F.lit(0.0))


def harmonic_mean(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0)


def ranking_aggregates(rank: Column) -> dict[str, Column]:
    """The metric block of a set of outcomes by the rank of their correct item."""
    return {
        "queries": F.count(F.lit(1)),
        "top_1_accuracy": mean(within(rank, 1)),
        "top_3_accuracy": mean(within(rank, 3)),
        "mrr": mean(reciprocal_rank(rank)),
        "ndcg_at_5": mean(ndcg(rank, 5)),
        "recall_at_1": mean(within(rank, 1)),
        "recall_at_3": mean(within(rank, 3)),
        "recall_at_5": mean(within(rank, 5)),
    }
