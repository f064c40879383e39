"""Landed responses of data services: a source of framed files, and the outcome of each request over an order of services.

What a fetcher lands is a file of records, one for each attempt: a head line of JSON (request, attempt, error, number of
bytes) and so many bytes of body. spark.read.format("landed_responses") reads folders of such files, one for each service,
a partition for each run of files; df.write.format("landed_responses") lands them. Everything after that is DataFrames.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from sparquill.sources.readers import PRICE_COLUMNS, unwrap_jsonp

SCHEMA = "service string, request string, attempt int, error string, body string"
#: Bytes of files that a partition reads, if not one file has more.
PARTITION_BYTES = 64 << 20
SUFFIX = ".landed"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.services = [x.strip() for x in options["services"].split(",")] if options.get("services") else None
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, root = _files(self.path)
        found = [x for x in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if x.is_file and x.path.endswith(SUFFIX)]
        out: list[_Files] = []
        size = self.most
        for x in sorted(found, key=lambda f: f.path):
            service = x.path.split("/")[-2]
            if self.services is not None and service not in self.services:
                continue
            if size >= self.most:
                out.append(_Files([]))
                size = 0
            out[-1].files.append((service, x.path))
            size += x.size
        return out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = _files(self.path)
        for service, path in partition.files:
            with system.open_input_stream(path, buffer_size=1 << 20) as stream:
                while line := _line(stream):
                    head = json.loads(line)
                    body = stream.read(head["bytes"]) if head["bytes"] else None
                    if body is not None and len(body) < head["bytes"]:
                        raise ValueError(f"{path} ends within a record")
                    yield service, head["request"], head["attempt"], head.get("error"), None if body is None else body.decode("utf-8", "replace")


def _line(stream) -> bytes:
    out = bytearray()
    while (c := stream.read(1)) and c != b"\n":
        out += c
    return bytes(out)


class _Written(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, root = _files(self.path)
        open_files: dict[str, tuple] = {}
        try:
            for r in rows:
                if r["service"] not in open_files:
                    system.create_dir(f"{root}/{r['service']}", recursive=True)
                    name = f"{root}/{r['service']}/{uuid.uuid4().hex}"
                    open_files[r["service"]] = name, system.open_output_stream(f"{name}.part")
                body = (r["body"] or "").encode()
                head = {"request": r["request"], "attempt": r["attempt"], "error": r["error"], "bytes": len(body)}
                open_files[r["service"]][1].write(json.dumps(head).encode() + b"\n" + body)
        finally:
            for _, stream in open_files.values():
                stream.close()
        return _Written([name for name, _ in open_files.values()])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = _files(self.path)
        for m in messages:
            for name in m.paths if m is not None else []:
                system.move(f"{name}.part", f"{name}{SUFFIX}")  # only whole files are ever read

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = _files(self.path)
        for m in messages:
            for name in m.paths if m is not None else []:
                system.delete_file(f"{name}.part")


class LandedResponses(DataSource):
    """Options: path; services, those to read (all, if not said); partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "landed_responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("landed responses are only added to")
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedResponses)


def read_landed(spark: SparkSession, path: str, services: Sequence[str] | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("landed_responses").option("path", path)
    return (reader.option("services", ",".join(services)) if services else reader).load()


def land(responses: DataFrame, path: str) -> None:
    register(responses.sparkSession)
    responses.select("service", "request", F.col("attempt").cast("int").alias("attempt"), "error", "body").write.format("landed_responses").option("path", path).mode("append").save()


def klines_of(body: Column) -> Column:
    """The k-line strings of a body (JSON, or JSON inside of a callback): an empty array where it has none, null where it is no JSON."""
    inner = F.trim(unwrap_jsonp(body))
    lines = F.from_json(F.get_json_object(inner, "$.data.klines"), "array<string>")
    return F.when(F.try_parse_json(inner).isNotNull(), F.coalesce(lines, F.expr("cast(array() as array<string>)")))


def outcomes(requests: DataFrame, responses: DataFrame, services: Sequence[str], most_attempts: int = 3, values: int = len(PRICE_COLUMNS) - 1) -> DataFrame:
    """One row for each request: status, service_used, fallback_used, attempts, message and klines, of its landed responses.

    Services are asked in order, each up to most_attempts times. The first attempt that gives an answer, with rows or
    without, ends a service; one that has none (an error, no JSON, or a line of other than `values` values) is an attempt
    more. The first service that answers ends the request: 'ok', 'fallback_ok' from a later service, or 'empty'. If none
    does: 'fallback_failed' where a later service was tried, else 'parse_failed' or 'request_failed' by the last attempt.
    message joins the last errors of the services that failed before. A request without responses has failed.
    responses: service, request, attempt, error, body; requests: request (repeated ones count once, null ones go).
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in services]), F.col("service"))
    tried = responses.where(rank.isNotNull() & (rank > 0) & F.col("attempt").between(1, most_attempts)).withColumn("rank", rank).withColumn("klines", klines_of(F.col("body")))
    whole = F.forall(F.coalesce("klines", F.array()), lambda k: F.size(F.split(k, ",")) == values)
    problem = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("klines").isNull() | ~whole, F.lit("parse"))
    tried = tried.withColumn("problem", problem).withColumn("good", F.col("problem").isNull())
    # of each service: the first good attempt, else the last one
    first = F.min(F.when(F.col("good"), F.struct("attempt", "klines")))
    last = F.max(F.when(~F.col("good"), F.struct("attempt", "problem")))
    served = tried.groupBy("request", "service", "rank").agg(first.alias("first"), last.alias("last"))
    served = served.withColumn("spent", F.coalesce("first.attempt", "last.attempt"))
    best = F.min(F.when(F.col("first").isNotNull(), F.struct("rank", "service", F.col("first.klines").alias("klines"))))
    every = F.sort_array(F.collect_list(F.struct("rank", "service", "spent", F.when(F.col("first").isNull(), F.col("last.problem")).alias("problem"))))  # one a service
    by = served.groupBy("request").agg(best.alias("best"), every.alias("every"))
    rows = requests.select("request").where("request is not null").distinct().join(by, "request", "left")
    used = F.filter(F.coalesce("every", F.expr("cast(array() as array<struct<rank:int,service:string,spent:int,problem:string>>)")), lambda e: F.col("best").isNull() | (e["rank"] <= F.col("best.rank")))
    rows = rows.withColumn("used", used)
    end = F.element_at("used", -1)
    failed = F.when(F.size("used") == 0, "request_failed").when(end["rank"] > 1, "fallback_failed").when(end["problem"] == "parse", "parse_failed").otherwise("request_failed")
    status = F.when(F.col("best").isNull(), failed).when(F.size("best.klines") == 0, "empty").when(F.col("best.rank") > 1, "fallback_ok").otherwise("ok")
    last_service = F.when(F.size("used") > 0, end["service"]).otherwise(F.lit(services[0]))
    message = F.array_join(F.transform(F.filter("used", lambda e: e["problem"].isNotNull()), lambda e: F.concat(e["service"], F.lit(": "), e["problem"])), " | ")
    spent = F.aggregate("used", F.lit(0).cast("long"), lambda s, e: s + e["spent"])
    return rows.select(
        "request", status.alias("status"), F.coalesce("best.service", last_service).alias("service_used"), F.coalesce(F.coalesce("best.rank", F.when(F.size("used") > 0, end["rank"])) > 1, F.lit(False)).alias("fallback_used"),
        spent.alias("attempts"), message.alias("message"), F.coalesce("best.klines", F.expr("cast(array() as array<string>)")).alias("klines"),
    )


def price_rows(found: DataFrame) -> DataFrame:
    """outcomes() -> a row for each k-line: stock_code and the other columns of prices, as text."""
    line = F.split("line", ",")
    each = found.select(F.col("request").alias("stock_code"), F.explode("klines").alias("line"))
    return each.select("stock_code", *[line[i].alias(c) for i, c in enumerate(PRICE_COLUMNS[1:])])


def status_rows(found: DataFrame) -> DataFrame:
    """outcomes() as the rows that a run records: with the number of rows in place of the rows."""
    return found.select("request", "status", F.size("klines").cast("long").alias("row_count"), "service_used", "fallback_used", "attempts", "message")
