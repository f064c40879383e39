"""Tables in a fixed number of parts by a hash of the key, in which a write replaces only the parts that it touches.

A part is a partition folder, part_of_N=i, so the number of parts stands in the table itself. New rows name the parts that
they touch (at most N numbers), only those are read, merged and overwritten, by dynamic partition overwrite; the files of
all others stay as they are. Spark stages the new parts and moves them when the job commits; a write that is run again
after it broke off gives the same table, as both merges here are idempotent.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.operators.cleaning import last_by
from sparquill.plans.stage import materialize, release

PARTS = 64
_NAME = re.compile(r"part_of_(\d+)")


def _part(key: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a keyed table is there: a folder of parts."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(where) and any(_NAME.match(x.getPath().getName()) for x in files.listStatus(where))


def _write(df: DataFrame, path: str, key: Sequence[str], parts: int, mode: str) -> None:
    name = f"part_of_{parts}"
    rows = df.withColumn(name, _part(key, parts)).hint("rebalance", name)  # a part of many rows may have several files
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)


def write_keyed(df: DataFrame, path: str, key: Sequence[str], parts: int = PARTS) -> None:
    """A new keyed table; an error if there is one."""
    if exists(df.sparkSession, path):
        raise FileExistsError(f"{path} is a keyed table already")
    _write(df, path, key, parts, "append")


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, str, int]:
    rows = spark.read.parquet(path)
    name = next((c for c in rows.columns if _NAME.fullmatch(c)), None)
    if name is None:
        raise ValueError(f"{path} is no keyed table")
    return rows, name, int(_NAME.fullmatch(name)[1])


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    rows, name, _ = _read(spark, path)
    return rows.drop(name)


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of the given keys; only their parts are read."""
    rows, name, parts = _read(spark, path)
    touched = [r[0] for r in keys.select(_part(key, parts)).distinct().collect()]  # at most `parts` numbers
    return rows.where(F.col(name).isin(touched)).drop(name).join(keys.select(*key).distinct(), list(key), "left_semi")


def _merge(new: DataFrame, path: str, key: Sequence[str], merged) -> list[int]:
    spark = new.sparkSession
    table, name, parts = _read(spark, path)
    new = materialize(new, "keyed_new")
    touched = sorted(r[0] for r in new.select(_part(key, parts)).distinct().collect())  # at most `parts` numbers
    if touched:
        old = table.where(F.col(name).isin(touched)).drop(name)
        _write(merged(old, new.select(*old.columns)), path, key, parts, "overwrite")
        spark.catalog.refreshByPath(path)
    release(new)
    return touched


def replace_keys(new: DataFrame, path: str, key: Sequence[str]) -> list[int]:
    """Rows of new in place of all rows of their keys, which may be several for each; the parts that were written."""
    return _merge(new, path, key, lambda old, rows: old.join(rows.select(*key).distinct(), list(key), "left_anti").unionByName(rows))


def upsert_keys(new: DataFrame, path: str, key: Sequence[str], order: Sequence[str]) -> list[int]:
    """One row for each key, the last in order of the table's and new's; the parts that were written."""
    return _merge(new, path, key, lambda old, rows: last_by(old.unionByName(rows), list(key), list(order)))
