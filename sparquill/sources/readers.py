"""Sources: CSV and JSON-lines scans with header checks, market and report scans, and landed HTTP responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the files' column names
REPORT_COLUMNS = ("report_date", "stock_code", "company_name", "title", "summary")
# fixed values: the files' column names
PRICE_COLUMNS = ("stock_code", "trade_date", "open", "close", "high", "low", "volume", "amount", "amplitude", "pct_change", "change", "turnover")


def strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, expected: Sequence[str] | None = None) -> DataFrame:
    """All columns as text; quoted line ends and a byte order mark are fine. expected: the exact header, in order."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    if expected is not None and df.columns != list(expected):
        raise ValueError(f"header of {path} is {df.columns}, not {list(expected)}")
    return df


def require_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object a line; blank lines do not count."""
    return spark.read.schema(schema).json(path)


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """As read_jsonl, but a line that is no object is an error when it is read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("x"), "value")
    whole = F.trim("value").startswith("{") & F.trim("value").endswith("}") & F.col("x").isNotNull()
    return parsed.select(F.when(whole, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("no JSON object: "), F.substring("value", 1, 80)))).alias("x")).select("x.*")


def market_rows(raw: DataFrame, stocks: DataFrame | None = None) -> DataFrame:
    """Price rows with a numeric close, of the wanted stocks (a semi-join); pct_change defaults to 0."""
    rows = raw.select("stock_code", F.to_date("trade_date").alias("trade_date"), F.col("close").try_cast("double").alias("close"), F.coalesce(F.col("pct_change").try_cast("double"), F.lit(0.0)).alias("pct_change"))
    rows = rows.where("close is not null")
    return rows if stocks is None else rows.join(stocks.select("stock_code").distinct(), "stock_code", "left_semi")


def kline_rows(landed: DataFrame) -> DataFrame:
    """landed (stock_code, klines: array of comma-joined values) -> PRICE_COLUMNS as text."""
    each = landed.select("stock_code", F.explode("klines").alias("k")).select("stock_code", F.split("k", ",").alias("v"))
    names = ("trade_date", "open", "close", "high", "low", "volume", "amount", "amplitude", "pct_change", "change", "turnover")
    return each.select("stock_code", *[F.try_element_at("v", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def unwrap_jsonp(body: Column) -> Column:
    """The JSON text inside of callback(...)."""
    inner = F.regexp_extract(body, r"(?s)^\s*[\w$.]+\((.*)\)\s*;?\s*$", 1)
    return F.when(inner != "", inner).otherwise(body)


def stock_ids(reports: DataFrame, column: str = "stock_id") -> DataFrame:
    return reports.select(F.trim(column).alias(column)).where(F.col(column) != "").distinct().orderBy(column)


def month_windows(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """The first and last day of every month of the years."""
    months = spark.range(1).select(F.explode(F.sequence(F.make_date(F.lit(first_year), F.lit(1), F.lit(1)), F.make_date(F.lit(last_year), F.lit(12), F.lit(1)), F.expr("interval 1 month"))).alias("first_day"))
    return months.select("first_day", F.last_day("first_day").alias("last_day"))


def with_fallback(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of the first source that has a key, with source_rank; later sources fill in what is missing."""
    ranked = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_rank", F.lit(i))
        ranked = s if ranked is None else ranked.unionByName(s)
    best = ranked.groupBy(key).agg(F.min("source_rank").alias("source_rank"))
    return ranked.join(best, [key, "source_rank"], "left_semi")


def fetch_status(row_count: Column, source_rank: Column, error: Column) -> Column:
    return F.when(error == "parse", "parse_failed").when(error.isNotNull() & (source_rank > 0), "fallback_failed").when(error.isNotNull(), "request_failed").when(F.coalesce(row_count, F.lit(0)) == 0, "empty").when(source_rank > 0, "fallback_ok").otherwise("ok")
