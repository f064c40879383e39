"""Ingest in windows that can be stopped and taken up again: landed answers in, rows and the state of every request out.

Each landed file holds answers to requests. The stream's checkpoint says which files are done, a keyed table holds the
rows, and each request (a stock, a month of reports) has a state of its own: attempts so far, last status, rows. A run
that is stopped anywhere and started again ends with the tables of one uninterrupted run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from sparquill.sources import keyed

#: The states of requests live in RocksDB, on disk and in the checkpoint, not in the heap.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "attempts long, status string, rows long, at long"
ANSWER = "request string, at long, status string, n_rows long"


class RequestState(StatefulProcessor):
    """attempts, last status and rows of a request; an answer that comes again (at is not above the last) does not count."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("request", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempts, status, n_rows, at = self.state.get() if self.state.exists() else (0, None, 0, -1)
        new: dict[int, tuple] = {}
        for frame in rows:
            for when, how, n in zip(frame["at"].tolist(), frame["status"].tolist(), frame["n_rows"].tolist(), strict=True):
                if when > at:
                    new.setdefault(when, (how, 0 if n is None or n != n else int(n)))
        if new:
            attempts += len(new)
            n_rows += sum(n for _, n in new.values())
            at = max(new)
            status = new[at][0]
            self.state.update((attempts, status, n_rows, at))
            yield pd.DataFrame({"request": [key[0]], "attempts": [attempts], "status": [status], "rows": [n_rows], "at": [at]})

    def close(self) -> None:
        pass


def request_states(answers: DataFrame) -> DataFrame:
    """A stream of answers (request, at, status, n_rows) -> a stream of the changed states: request, attempts, status, rows, at.

    at numbers the answers of a request; they have to come in its order, batch by batch, within a batch in any order.
    """
    answers.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return answers.groupBy("request").transformWithStateInPandas(RequestState(), f"request string, {STATE}", "Update", "None")


def states_of(answers: DataFrame) -> DataFrame:
    """The same states of a table of answers."""
    once = answers.dropDuplicates(["request", "at"])
    return once.groupBy("request").agg(F.count(F.lit(1)).alias("attempts"), F.max_by("status", "at").alias("status"), F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long").alias("rows"), F.max("at").alias("at"))


def _upsert_into(table: str, key: Sequence[str], order: Sequence[str], parts: int) -> Callable[[DataFrame, int], None]:
    def merge(batch: DataFrame, batch_id: int) -> None:
        if keyed.exists(batch.sparkSession, table):
            keyed.upsert_keys(batch, table, key, order)
        else:
            keyed.write_keyed(keyed.last_by(batch, list(key), list(order)), table, key, parts)

    return merge


def ingest_states(answers: DataFrame, table: str, checkpoint: str, parts: int = keyed.PARTS) -> StreamingQuery:
    """Keep the state of every request in a keyed table; one row a request. Takes what has landed and ends."""
    writer = request_states(answers).writeStream.outputMode("update").foreachBatch(_upsert_into(table, ["request"], ["at"], parts))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_rows(rows: DataFrame, table: str, checkpoint: str, key: Sequence[str], order: Sequence[str], parts: int = keyed.PARTS) -> StreamingQuery:
    """Keep the last row of each key in a keyed table, a window of files at a time. Takes what has landed and ends."""
    return rows.writeStream.foreachBatch(_upsert_into(table, key, order, parts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landed(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1) -> DataFrame:
    """Landed JSON-lines files as a stream, oldest first, so many to a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def open_requests(requests: DataFrame, states: DataFrame, failed: Sequence[str] = ("request_failed", "parse_failed", "fallback_failed"), retry_only: bool = False, most_attempts: int | None = None) -> DataFrame:
    """What a next run asks for: requests without a state (unless retry_only), and with retry_only those that failed last
    and have not had most_attempts yet."""
    if not retry_only:
        return requests.join(states.select("request"), "request", "left_anti")
    again = states.where(F.col("status").isin(*failed))
    again = again if most_attempts is None else again.where(F.col("attempts") < most_attempts)
    return requests.join(again.select("request"), "request", "left_semi")


def run_counts(requests: DataFrame, states: DataFrame, done: Sequence[str] = ("ok", "fallback_ok"), empty: str = "empty") -> DataFrame:
    """One row: requests asked for, with a state, covered, missing (empty), failed, rows and attempts in all."""
    joined = requests.select("request").distinct().join(states, "request", "left")
    status = F.col("status")
    return joined.agg(
        F.count(F.lit(1)).alias("requested"), F.count("status").alias("processed"), F.count(F.when(status.isin(*done), 1)).alias("covered"), F.count(F.when(status == empty, 1)).alias("missing"),
        F.count(F.when(~status.isin(*done, empty), 1)).alias("failed"), F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("rows"), F.coalesce(F.sum("attempts"), F.lit(0)).cast("long").alias("attempts"),
    )
