"""The confidence gate: how many of a query's candidates to keep, if any.

All of it is one CASE expression over the row's candidate array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP_THRESHOLD = 0.03
SCORE_FLOOR = 0.54
MIN_K, MAX_K = 1, 5


def check_arguments(min_k: int, max_k: int, gap_threshold: float, score_floor: float) -> int:
    """max_k, raised to min_k where it is smaller; ValueError for values out of range."""
    if min_k < 1:
        raise ValueError(f"min_k must be >= 1, got {min_k}")
    for name, value in (("gap_threshold", gap_threshold), ("score_floor", score_floor)):
        if not 0 <= value <= 1:
            raise ValueError(f"{name} must be in [0, 1], got {value}")
    return max(min_k, max_k)


def gate_columns(candidates: Column, min_k: int, max_k: int, gap_threshold: Column, score_floor: float) -> dict[str, Column]:
    """mode, selected_k, gap, top_score and runner_up_score. The floor comes before the gap test and looks at the raw dense score."""
    n = F.size(candidates)
    top, second = F.get(candidates, F.lit(0)), F.get(candidates, F.lit(1))
    floor_score = F.coalesce(top["dense_raw"], top["score"])
    gap = F.round(top["score"] - second["score"], 9)
    mode = (
        F.when(n == 0, "no_candidates")
        .when((F.lit(score_floor) > 0) & (F.round(floor_score, 9) < score_floor), "no_confident_match")
        .when(n < 2, "single_candidate")
        .when(gap >= gap_threshold, "confident")
        .otherwise("ambiguous")
    )
    kept = F.when(mode.isin("no_candidates", "no_confident_match"), 0).when(mode == "ambiguous", F.least(n, F.lit(max_k))).otherwise(F.least(n, F.lit(min_k)))
    return {
        "mode": mode,
        "selected_k": kept.cast("int"),
        "gap": F.when(mode.isin("confident", "ambiguous"), gap),
        "top_score": top["score"],
        "runner_up_score": second["score"],
    }


def confidence_gate(
    df: DataFrame, min_k: int = MIN_K, max_k: int = MAX_K, gap_threshold: float = GAP_THRESHOLD, score_floor: float = SCORE_FLOOR
) -> DataFrame:
    """Add the gate's decision, ``reason``, ``widened`` and ``has_match`` to rows with ``candidates``."""
    max_k = check_arguments(min_k, max_k, gap_threshold, score_floor)
    out = df.withColumns(gate_columns(F.col("candidates"), min_k, max_k, F.lit(gap_threshold), score_floor))
    names = [F.get("candidates", F.lit(i))["item_id"].cast("string") for i in (0, 1)]
    floor_score = F.coalesce(F.get("candidates", F.lit(0))["dense_raw"], F.col("top_score"))
    gap_text = F.format_string("Gap %.3f between '%s' (%.3f) and '%s' (%.3f) ", "gap", names[0], "top_score", names[1], "runner_up_score")
    reason = (
        F.when(F.col("mode") == "no_candidates", "Retrieval returned no candidates; nothing to gate.")
        .when(
            F.col("mode") == "no_confident_match",
            F.format_string(f"Best candidate '%s' scored %.3f, below the absolute floor {score_floor:.2f}. No item plausibly serves this query, so no guess is returned.", names[0], floor_score),
        )
        .when(F.col("mode") == "single_candidate", F.format_string("Only one candidate ('%s', score %.3f) was retrieved, so no top1-top2 gap exists; returning it as-is.", names[0], "top_score"))
        .when(F.col("mode") == "confident", F.concat(gap_text, F.format_string(f"meets the threshold {gap_threshold:.2f}; narrowing to top-%d.", "selected_k")))
        .otherwise(F.concat(gap_text, F.format_string(f"is below the threshold {gap_threshold:.2f}; widening to top-%d so that the choice can be made later.", "selected_k")))
    )
    return out.withColumns({"reason": reason, "widened": F.col("mode") == "ambiguous", "has_match": F.col("selected_k") > 0})


def disabled_gate(df: DataFrame) -> DataFrame:
    """Keep all candidates: mode ``disabled``."""
    n = F.size("candidates").cast("int")
    return df.withColumns({"mode": F.lit("disabled"), "selected_k": n, "gap": F.lit(None).cast("double"), "reason": F.lit("Gate disabled; fixed top-k."), "widened": F.lit(False), "has_match": n > 0})


def selected(df: DataFrame) -> DataFrame:
    """Cut ``candidates`` to the gate's selection."""
    return df.withColumn("candidates", F.slice("candidates", F.lit(1), F.col("selected_k")))


def swept(df: DataFrame, grid: tuple[float, ...], min_k: int = MIN_K, max_k: int = MAX_K, score_floor: float = SCORE_FLOOR) -> DataFrame:
    """Each row once per threshold of the (short, fixed) grid, gated anew; candidates are made once."""
    check_arguments(min_k, max_k, 0.0, score_floor)
    rows = df.withColumn("gap_threshold", F.explode(F.array(*(F.lit(g) for g in grid))))
    return rows.withColumns(gate_columns(F.col("candidates"), min_k, max_k, F.col("gap_threshold"), score_floor))
