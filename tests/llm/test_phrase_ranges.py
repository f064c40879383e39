"""What a task of the collocations holds: one range of hashes, of a bounded number of entries whatever the corpus."""

import numpy as np
from pyspark.sql import functions as F

from sparquill.llm import phrases


def test_a_task_holds_one_range(spark):
    docs = spark.createDataFrame([(" ".join(f"w{i * j % 997}" for j in range(1, 60)), "en") for i in range(1, 60)], "text string, lang string")
    table = phrases.shards(docs, shard_words=500).cache()
    ranges = 64
    rows = phrases.frequent_buckets(table, 1, 1, 1, ranges).select("bucket", F.spark_partition_id().alias("task")).collect()
    assert len({r["bucket"] for r in rows}) == len(rows) > 500
    of = {}
    for r in rows:
        of.setdefault(r["task"], set()).add(r["bucket"] % ranges)
    assert max(map(len, of.values())) == 1 and len(of) == len({r["bucket"] % ranges for r in rows})


def test_ranges_grow_with_lengths_and_words(spark, monkeypatch):
    """Counting phrases of three lengths gives three entries a word, so it has three times the ranges."""
    monkeypatch.setattr(phrases, "RANGE_ENTRIES", 100)
    asked, real = [], phrases.frequent_buckets
    monkeypatch.setattr(phrases, "frequent_buckets", lambda table, low, high, least, ranges, *more: asked.append((low, high, ranges)) or real(table, low, high, least, ranges, *more))
    docs = spark.createDataFrame([("a b c d e f g h i j",)] * 100, "text string").withColumn("lang", F.lit("en"))
    found = phrases.collocations(docs, least_count=50).collect()
    assert asked == [(1, 1, 10), (2, 2, 10), (3, 5, 30)]
    assert found and all(r["a"] == 100 for r in found)


def test_numbers_of_views():
    x = np.array([0, 1, 255, 256, 2**47])
    import pyarrow as pa

    column = pa.array([phrases._planes(x, 6), phrases._planes(x[:2], 6)], pa.binary())
    assert [phrases._of_planes(v, 6).tolist() for v in phrases._views(column)] == [x.tolist(), x[:2].tolist()]


def test_few_shards_are_read_at_once(spark, monkeypatch):
    key, used, real = "spark.sql.parquet.columnarReaderBatchSize", {}, phrases.materialize
    before = spark.conf.get(key)
    monkeypatch.setattr(phrases, "materialize", lambda df, label: used.setdefault(label, spark.conf.get(key)) and real(df, label))
    phrases.collocations(spark.createDataFrame([("a b c",)] * 20, "text string").withColumn("lang", F.lit("en")), least_count=5).collect()
    assert int(used["phrase_buckets"]) <= 16 and int(used["phrase_frequent"]) <= 16
    assert spark.conf.get(key) == before
