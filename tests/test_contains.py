"""Names inside texts, by whichever way runs meet names; what is shuffled for it."""

import re

import pytest

from lodestone.operators import dataset

TEXTS = [(1, "the cat then Cat$1 über"), (2, "the the cat_x " + "abcd" * 30), (3, None), (4, ""), (5, "then a über-cat"), (6, "the cat then Cat$1 über")]
NAMES = ["a", "th", "the", "cat", "Cat$", "über", "bcda", "abcdabcd", "x", "none", ""]


def rows(spark):
    return spark.createDataFrame(TEXTS, "text_id int, text string"), spark.createDataFrame([(n,) for n in NAMES], "name string")


@pytest.mark.parametrize("bounds", [{}, {"most": 0}, {"most": 2}, {"few": 0}])
def test_all_ways_find_the_same(spark, bounds):
    got = sorted(map(tuple, dataset.contains_join(*rows(spark), "text", "name", **bounds).collect()))
    assert got == sorted((i, n) for i, x in TEXTS for n in NAMES if x and n and n in x)


def test_pairs_are_not_shuffled(spark):
    plan = dataset.contains_join(*rows(spark), "text", "name")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(text_id" in plan and not re.search(r"hashpartitioning\(text_id#\d+, name", plan)
