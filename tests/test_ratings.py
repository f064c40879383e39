"""Ratings come from one pass over the reports, and agreement goes by patterns of items."""

from __future__ import annotations

import re

from sparquill.operators import agreement
from sparquill.plans import adapters


def test_one_pass(spark, tiny):
    plan = adapters.ratings(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[l_orderkey", plan)) == 1 and "Union" not in plan


def test_fleiss_by_patterns(spark):
    """Two items of one pattern, one of another, one with a rating missing: p = (1 + 1 + 1/3) / 3, shares 7/9 and 2/9."""
    rows = [("i", r, "x") for r in range(3)] + [("j", r, "x") for r in range(3)] + [("k", 0, "y"), ("k", 1, "x"), ("k", 2, "y"), ("l", 0, "x"), ("l", 1, None), ("l", 2, "x")]
    got = agreement.fleiss_kappa(spark.createDataFrame(rows, "item_id string, rater int, label string"), 3).first()
    p, e = (2 + 1 / 3) / 3, (7 / 9) ** 2 + (2 / 9) ** 2
    assert got.items == 3 and got.kappa == round((p - e) / (1 - e), 4)


def test_fleiss_of_nothing(spark):
    got = agreement.fleiss_kappa(spark.createDataFrame([], "item_id string, rater int, label string"), 3).first()
    assert got.items == 0 and got.kappa is None
