"""Work on whole texts does not grow with the number of variants, nor into an array of all characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.functions import text as X
from sparquill.plans import catalog, catalog_labels  # noqa: F401


def test_variants_share_counts(spark, tiny):
    plan = catalog.QUERIES["ablation_variants"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(") < 60


def test_char_tokens(spark):
    texts = [["b a", "　ab\n"], [" \t \x85"], [], None, ["\U0001f600x\U0001f600", "\x1c"]]
    df = spark.createDataFrame([(x,) for x in texts], "x array<string>").select(X.char_tokens(F.col("x")).alias("y"))
    assert [r.y for r in df.collect()] == [["b", "a"], [], [], [], ["\U0001f600", "x", "\x1c"]]
    assert "split(" not in df._jdf.queryExecution().optimizedPlan().toString()
