from __future__ import annotations

import numpy as np
import pytest

from tallyrank.operators import gate
from tallyrank.operators.scoring import CANDIDATE_FIELDS, min_max


def candidates(spark, *scores, raw=None):
    rows = [(i, float(s), None, None, raw, None, i + 1) for i, s in enumerate(scores)]
    return spark.createDataFrame([(1, rows)], f"query_id long, candidates array<struct<{CANDIDATE_FIELDS}>>")


def decide(spark, *scores, raw=None, **options):
    return gate.confidence_gate(candidates(spark, *scores, raw=raw), **options).first()


@pytest.mark.parametrize(
    ("scores", "options", "mode", "kept"),
    [
        ((0.95, 0.60, 0.55), {"gap_threshold": 0.15}, "confident", 1),
        ((0.80, 0.65), {"gap_threshold": 0.15, "score_floor": 0.0}, "confident", 1),
        ((0.90, 0.88, 0.86, 0.85), {"max_k": 3}, "ambiguous", 3),
        ((0.90,), {"score_floor": 0.0}, "single_candidate", 1),
        ((), {}, "no_candidates", 0),
        ((0.20, 0.19, 0.18), {"score_floor": 0.55}, "no_confident_match", 0),
        ((0.90, 0.89), {"min_k": 3, "max_k": 1}, "ambiguous", 2),
    ],
)
def test_modes(spark, scores, options, mode, kept):
    row = decide(spark, *scores, **options)
    assert (row["mode"], row["selected_k"]) == (mode, kept)
    assert row["has_match"] == (kept > 0) and row["widened"] == (mode == "ambiguous")


def test_floor_looks_at_raw_dense(spark):
    assert decide(spark, 1.0, 0.2, raw=0.11)["mode"] == "no_confident_match"


def test_gap_is_null_without_pair(spark):
    assert decide(spark, 0.9, score_floor=0.0)["gap"] is None


def test_larger_threshold_never_keeps_fewer(spark):
    rows = gate.swept(candidates(spark, 0.9, 0.8, 0.7), (0.0, 0.05, 0.1, 0.2)).orderBy("gap_threshold").collect()
    kept = [r["selected_k"] for r in rows]
    assert kept == sorted(kept)


@pytest.mark.parametrize("options", [{"min_k": 0}, {"gap_threshold": 1.5}, {"score_floor": -0.1}])
def test_bad_arguments(spark, options):
    with pytest.raises(ValueError):
        decide(spark, 0.9, **options)


@pytest.mark.parametrize(("given", "want"), [([1.0, 2.0, 3.0], [0, 0.5, 1]), ([5.0, 5.0], [1, 1]), ([0.0, 0.0], [0, 0]), ([], [])])
def test_min_max(given, want):
    assert min_max(np.array([given])).tolist() == [want]


def test_disabled(spark):
    assert gate.disabled_gate(candidates(spark, 0.1, 0.2)).first()["selected_k"] == 2
