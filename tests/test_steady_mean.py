"""Means that thresholds are set against don't hang on the order of rows."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.operators import analysis
from lodestone.plans import queries


def mean(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value double").agg(analysis.steady_mean(F.col("value"))).first()[0]


def test_sums_are_whole(spark):
    assert mean(spark, [0.1] * 10) == 0.1 and mean(spark, [0.1] * 10 + [None]) == 0.1
    assert mean(spark, [1e300, 1e300]) == 1e300 and mean(spark, [1e-300, 3e-300]) == 2e-300
    assert mean(spark, [None]) is None and math.isnan(mean(spark, [1.0, math.nan])) and mean(spark, [math.inf, 1.0]) == math.inf


@pytest.mark.parametrize("parts", [1, 3])
def test_pairs_have_steady_means(spark, monkeypatch, parts):
    rows = [(i, 1, mode, v, '{"k": 1}') for mode, v in (("view", 0.1), ("purchase", 0.3)) for i in range(10)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").repartition(parts)
    monkeypatch.setattr(queries, "t", lambda *_: events)
    assert queries._pairs(spark, "").select("base_es", "other_es").first()[:] == (0.1 / 100, 0.3 / 100)
