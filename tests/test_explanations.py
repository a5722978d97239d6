"""Explanations take texts apart once, for scores and for what they tell of them."""

from lodestone.operators import retrieval
from lodestone.plans import record_queries  # noqa: F401  registers its queries
from lodestone.plans.queries import QUERIES


def test_postings_are_made_once(spark, monkeypatch):
    seen, whole = [], retrieval.postings
    monkeypatch.setattr(retrieval, "postings", lambda *a: seen.append(a) or whole(*a))
    assert QUERIES["score_explanations"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(seen) == 1
