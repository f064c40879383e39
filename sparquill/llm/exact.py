"""Exact de-duplication: a tree-merge of sorted digest runs.

Every input partition sorts its digests, by digest range, into runs: of each digest the identifier that stays and the
number of rows. Runs then meet in rounds: in round r the runs whose numbers agree after dropping r base-8 digits are
exchanged to one node (digest range, run number >> 3r), brought into one order, and merged in one pass over it in which
only the first row of each digest, the best identifier, goes up with the sum of the rows. After log8(partitions) rounds
each range has one run. A node holds one digest range of at most eight runs, so no task sees a range's rows, only its
distinct digests, and a text that makes up a third of the corpus is one row of each run from the start.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.plans.stage import materialize

FAN_BITS = 3


def normal(text: Column) -> Column:
    """Lower-case A-Z only; null counts as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (SHA-256), and a check made independently of it (64-bit hash and byte length), with the run's number."""
    text = normal(F.col(text_col))
    return documents.select(
        F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.xxhash64(text).alias("check"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.spark_partition_id().alias("run"),
    )


NODE, KEY = ["range", "run"], ["digest", "check", "n_bytes"]


def _same_as_before(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Of each row but the first, whether its node and key are those of the row before it."""
    same = np.ones(max(0, rows.num_rows - 1), bool)
    for name in (*NODE, *KEY):
        column = rows[name]
        same &= pc.equal(column.slice(1), column.slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
    return same


def merge_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of node, key and preference -> the first of each node and key, with the sum of group_size.

    A key may go on in the next batch, so the last one waits; what is held is a batch and one row.
    """
    wait: pa.Table | None = None

    def folded(rows: pa.Table) -> pa.Table:
        first = np.flatnonzero(np.concatenate([[True], ~_same_as_before(rows)]))
        size = np.add.reduceat(rows["group_size"].to_numpy(), first)
        place = rows.schema.get_field_index("group_size")
        return rows.take(pa.array(first)).set_column(place, rows.schema.field(place), pa.array(size))

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = folded(rows if wait is None else pa.concat_tables([wait, rows]).combine_chunks())
        yield from rows.slice(0, rows.num_rows - 1).combine_chunks().to_batches()
        wait = rows.slice(rows.num_rows - 1).combine_chunks()
    if wait is not None:
        yield from wait.to_batches()


def sorted_runs(rows: DataFrame, keep: str, ranges: int) -> DataFrame:
    """Rows of digests() -> each partition's runs: range, run, key, keep_id, group_size, without an exchange."""
    rows = rows.withColumn("range", F.pmod(F.col("check"), F.lit(ranges)).cast("int")).withColumn("group_size", F.lit(1).cast("long"))
    return _merged(rows.select(*NODE, *KEY, F.col("id").alias("keep_id"), "group_size"), keep)


def _merged(rows: DataFrame, keep: str) -> DataFrame:
    better = {"max": F.desc_nulls_last, "min": F.asc_nulls_last}[keep]
    return rows.sortWithinPartitions(*NODE, *KEY, better("keep_id")).mapInArrow(merge_pass, rows.schema)


def merge_runs(rows: DataFrame, keep: str = "max", ranges: int | None = None) -> DataFrame:
    """Rows of digests() -> one row for each text: digest, check, n_bytes, keep_id, group_size.

    keep: 'max' or 'min' identifier stays. Rows merge only where the digest and the independent check agree, at every
    level; if two texts ever shared a digest, both would stay.
    """
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = rows.agg(F.max("run")).first()[0] or 0
    run = sorted_runs(rows, keep, ranges)
    while True:
        # the runs of a node meet by one exchange
        run = _merged(run.withColumn("run", F.shiftright("run", FAN_BITS)).repartition(*NODE), keep)
        top >>= FAN_BITS
        if top == 0:
            return run.select(*KEY, "keep_id", "group_size")
        run = materialize(run, "exact_round")


def exact_groups(documents: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, keep_id, group_size, kept, text_sha256.

    Defined cases: null text equals the empty text; a null id never wins over another and is kept only where its whole
    group has none; rows that repeat id and text are all marked kept if that id stays; an empty table gives no rows.
    Other columns of documents are not read.
    """
    rows = materialize(digests(documents, id_col, text_col), "exact_digests")
    merged = materialize(merge_runs(rows, keep), "exact_groups")
    # the rows' side may be dominated by one text; AQE splits such a partition of a plain equi-join
    out = rows.drop("run").join(merged, KEY)
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
