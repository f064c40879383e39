"""Sinks: CSV, JSON lines, split exports, snapshots and manifests."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "dev", "test")
DONE = ("ok", "fallback_ok")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", append: bool = False) -> None:
    df.write.mode("append" if append else mode).csv(path, header=True, escape='"')


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_splits(df: DataFrame, path: str, column: str = "split", mode: str = "errorifexists") -> None:
    """A folder for each split; a row of any other split fails the write."""
    known = F.when(F.col(column).isin(*SPLITS), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("unknown split "), F.coalesce(column, F.lit("null")))))
    df.withColumn(column, known).write.mode(mode).partitionBy(column).parquet(path)


def write_snapshot(prices: DataFrame, status: DataFrame, path: str) -> None:
    """Prices, fetch states, and the states of what is still missing."""
    prices.write.mode("overwrite").parquet(f"{path}/prices")
    status.write.mode("overwrite").parquet(f"{path}/status")
    status.where(~F.col("status").isin(*DONE)).write.mode("overwrite").parquet(f"{path}/missing")


def digests(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, bytes, sha256) of files, for a record of where results come from. Each file is one value, so it is for inputs of up to 2 GB."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_locked(df: DataFrame, path: str, force: bool = False) -> None:
    """A result that is written once: a second write fails unless it is forced."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    if not force and where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(where):
        raise FileExistsError(f"{path} is locked")
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def freeze(rows: DataFrame, problems: DataFrame, path: str) -> None:
    """Publish annotations that have no problem (rows of cleaning.annotation_errors); else fail and name the first kinds."""
    found = problems.groupBy("problem").agg(F.count(F.lit(1)).alias("n")).orderBy("problem").limit(10).collect()
    if found:
        raise ValueError("not ready: " + ", ".join(f"{r['n']} x {r['problem']}" for r in found))
    write_locked(rows, path)


def counters(reason: Column | None = None, reasons: Sequence[str] = (), date: str | None = None, filled: Sequence[str] = ()) -> dict[str, Column]:
    """Aggregates that a write can take along: rows, rows by reason (null is 'kept'), first and last of a date (empty ones do
    not count), and for each column of filled how many rows have it. None of them is a count of distinct values."""
    out: dict[str, Column] = {"rows": F.count(F.lit(1))}
    if reason is not None:
        named = F.coalesce(reason, F.lit("kept"))
        out |= {f"reason_{r}": F.count(F.when(named == r, 1)) for r in ("kept", *reasons)}
        out["reason_other"] = F.count(F.when(~named.isin("kept", *reasons), 1))
    if date is not None:
        day = F.nullif(F.col(date).cast("string"), F.lit(""))
        out |= {"first": F.min(day), "last": F.max(day)}
    return out | {f"with_{c}": F.count(F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", 1)) for c in filled}


def write_counted(df: DataFrame, path: str, counts: dict[str, Column], mode: str = "errorifexists", keep: Column | None = None) -> dict:
    """Write df as Parquet, and what counts say of it, from the same job: nothing is read or computed twice.

    Counts are of df's rows; keep, a condition, says which of them are written, so that reasons count what is left out.
    """
    seen = Observation()
    rows = df.observe(seen, *[c.alias(n) for n, c in counts.items()])
    (rows if keep is None else rows.where(keep)).write.mode(mode).parquet(path)
    return dict(seen.get)


def write_with_manifest(tables: dict[str, tuple[DataFrame, dict[str, Column]]], path: str, mode: str = "errorifexists") -> str:
    """Each table below path, with its counters; what they say as JSON, also in path/manifest."""
    out = {name: write_counted(df, f"{path}/{name}", counts, mode) for name, (df, counts) in tables.items()}
    text = json.dumps(out, ensure_ascii=False, sort_keys=True)
    spark = next(iter(tables.values()))[0].sparkSession
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/manifest")
    return text


def manifest(tables: dict[str, DataFrame], date: str, key: str) -> str:
    """Row counts, date ranges and distinct keys of tables as JSON; each table is one aggregate."""
    out = {}
    for name, df in tables.items():
        r = df.agg(F.count(F.lit(1)).alias("rows"), F.min(F.col(date).cast("string")).alias("first"), F.max(F.col(date).cast("string")).alias("last"), F.countDistinct(key).alias("distinct_keys")).first()
        out[name] = r.asDict()
    return json.dumps(out, ensure_ascii=False, sort_keys=True)


def latex_table(df: DataFrame, columns: Sequence[str], caption: str) -> str:
    """A small result table as LaTeX; floats to two digits, special characters escaped."""
    special = {"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$"}
    cell = lambda v: f"{v:.2f}" if isinstance(v, float) else "".join(special.get(c, c) for c in str("" if v is None else v))
    rows = [" & ".join(cell(r[c]) for c in columns) + r" \\" for r in df.select(*columns).collect()]
    head = " & ".join(cell(c) for c in columns) + r" \\ \hline"
    return "\n".join([r"\begin{table}", rf"\caption{{{cell(caption)}}}", rf"\begin{{tabular}}{{{'l' * len(columns)}}}", head, *rows, r"\end{tabular}", r"\end{table}"])
