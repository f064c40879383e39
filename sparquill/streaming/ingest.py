"""Reports as a stream: landed files in, first of each id kept, batches merged into a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sparquill.sources import keyed
from sparquill.streaming.requests import ingest_rows


def report_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def first_seen(stream: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """The first row of each key; state older than the watermark is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, time: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "stock_code").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "stock_code", "n")


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, key: str, order: str, parts: int = keyed.PARTS) -> StreamingQuery:
    """Merge every batch into a keyed table (sources/keyed.py), of which it rewrites only the parts that it touches. A batch
    that is run again does no harm."""
    return ingest_rows(stream, table, checkpoint, [key], [order], parts)
