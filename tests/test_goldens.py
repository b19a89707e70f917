"""Calibration measures over the recorded scores of 63 questions: sweep, bands, safe thresholds, class gap, reciprocal rank."""

import pytest

from tessera.config import BANDS, THRESHOLDS
from tessera.operators import evaluation

# Recorded (question, best score, rank of the first hit, its score) by category.
SCORES = {
    "respondible": [
        (1, 0.9984, 1, 0.9984), (2, 0.9659, 1, 0.9659), (3, 0.9821, 1, 0.9821), (4, 0.9953, 1, 0.9953), (5, 0.9997, 1, 0.9997), (6, 0.9923, 1, 0.9923), (7,
        0.9971, 1, 0.9971), (8, 0.9919, 1, 0.9919), (9, 0.9511, None, None), (10, 0.9996, 1, 0.9996), (11, 0.9874, 1, 0.9874), (12, 0.9907, 1, 0.9907), (13,
        0.9993, 1, 0.9993), (14, 0.8447, 1, 0.8447), (15, 0.905, 1, 0.905), (16, 0.8404, 1, 0.8404), (17, 0.9754, 1, 0.9754), (18, 0.8314, 1, 0.8314), (26,
        0.9811, 2, 0.9766), (27, 0.9981, 1, 0.9981), (28, 0.9995, 1, 0.9995), (29, 0.969, 1, 0.969), (30, 0.9997, 1, 0.9997), (31, 0.9981, 1, 0.9981), (32,
        0.9919, 1, 0.9919), (33, 0.9994, 1, 0.9994), (34, 0.9865, 1, 0.9865), (35, 0.9976, 1, 0.9976), (36, 0.9969, 1, 0.9969), (37, 0.9975, 1, 0.9975), (38,
        0.9831, 1, 0.9831), (39, 0.9902, 1, 0.9902), (40, 0.9992, 1, 0.9992), (41, 0.9754, 1, 0.9754), (42, 0.9978, 1, 0.9978), (43, 0.963, 1, 0.963), (44,
        0.9855, 1, 0.9855), (45, 0.9968, 1, 0.9968), (46, 0.9712, 1, 0.9712), (47, 0.9997, 1, 0.9997), (48, 0.9755, 1, 0.9755), (49, 0.9751, 1, 0.9751), (50,
        0.9771, 4, 0.8215), (51, 0.9975, 1, 0.9975), (52, 0.9899, 1, 0.9899), (53, 0.9576, 1, 0.9576), (59, 0.993, 1, 0.993), (60, 0.7185, 1, 0.7185), (61,
        0.8854, 1, 0.8854), (62, 0.7851, 1, 0.7851), (63, 0.9802, 1, 0.9802)
    ],
    "fuera": [
        (19, 0.3452, None, None), (20, 0.0009, None, None), (21, 0.0054, None, None), (22, 0.0049, None, None), (23, 0.0, None, None), (54, 0.0492, None,
        None), (55, 0.3982, None, None), (56, 0.0551, None, None), (57, 0.0828, None, None)
    ],
    "ambigua": [(24, 0.2581, None, None), (25, 0.4432, 1, 0.4432), (58, 0.1587, None, None)],
}
# Threshold, rejected out of scope (%), false refusals (%), recall (%), ambiguous rejected.
SWEEP = [
    (0.0, 0.0, 0.0, 98.0, 0), (0.01, 44.4, 0.0, 98.0, 0), (0.02, 44.4, 0.0, 98.0, 0), (0.05, 55.6, 0.0, 98.0, 0), (0.1, 77.8, 0.0, 98.0, 0),
    (0.15, 77.8, 0.0, 98.0, 0), (0.2, 77.8, 0.0, 98.0, 1), (0.3, 77.8, 0.0, 98.0, 2), (0.4, 100.0, 0.0, 98.0, 2), (0.5, 100.0, 0.0, 98.0, 3),
    (0.6, 100.0, 0.0, 98.0, 3), (0.7, 100.0, 0.0, 98.0, 3), (0.8, 100.0, 3.9, 94.1, 3), (0.9, 100.0, 11.8, 84.3, 3),
]
# From, to, answerable, first hit first (%), out of scope.
BANDED = [(0.0, 0.1, 0, 0.0, 7), (0.1, 0.3, 0, 0.0, 0), (0.3, 0.5, 0, 0.0, 2), (0.5, 0.7, 0, 0.0, 0), (0.7, 0.9, 6, 100.0, 0), (0.9, 1.0, 45, 93.3, 0)]


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(q, kind, best, rank, hit) for kind, own in SCORES.items() for q, best, rank, hit in own]
    assert len(rows) == 63
    return spark.createDataFrame(rows, "qid long, category string, best double, hit_rank int, hit_score double")


def test_sweep(scores):
    assert sorted(map(tuple, evaluation.sweep(scores, THRESHOLDS).collect())) == SWEEP


def test_bands(scores):
    assert sorted(map(tuple, evaluation.bands(scores, BANDS).collect())) == BANDED


def test_safe_thresholds(scores):
    assert tuple(evaluation.safe(evaluation.sweep(scores)).first()) == (4, 0.4, 0.7, "0.40,0.50,0.60,0.70")


def test_class_gap(scores):
    assert tuple(evaluation.class_gap(scores).first()) == (60, 0.7185, 55, 0.3982)


def test_reciprocal_rank_and_misses(scores):
    from pyspark.sql import functions as F

    hits = scores.filter("category = 'respondible'").select(F.lit("rerank").alias("run"), "qid", "hit_rank")
    assert evaluation.metrics(hits).first().asDict() == {"run": "rerank", "questions": 51, "recall": 98.0, "mrr": 0.956, "misses": 1}
    assert [r["qid"] for r in hits.filter("hit_rank is null").collect()] == [9]
