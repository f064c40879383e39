"""Token ids in files of fixed-width bit packing.

A shard file holds the ids of consecutive documents, each id in the least number of bits that the vocabulary needs:

    blocks of BLOCK ids, each starting on a byte | offset of each block (u64) | document ids (i64) |
    first id of each document, and the end (u64) | footer

so any id range is read by unpacking the blocks that hold it, and a whole block unpacks with numpy in one step.
Documents are range-partitioned and sorted by id, every task writes one shard as a stream, and a manifest (a row for
each shard) gives the global position of each shard's first id.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from sparquill.llm.arrowtext import SLICE, as_bytes, slices
from sparquill.llm.wordpieces import ChunkEncoder
from sparquill.plans.stage import materialize, stage_path

MAGIC = b"SQBITS01"
FOOTER = struct.Struct("<8sHIQQQQ")  # magic, bits, ids in a block, ids, documents, documents without id, where the offsets begin
BLOCK = 1 << 14
WHOLE = {8: "u1", 16: ">u2", 32: ">u4"}  # widths of whole bytes: the same bits, without taking them apart


def width(vocabulary: int) -> int:
    """The least number of bits for ids 0 .. vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids, most significant bit first, padded with 0 to whole bytes."""
    if bits in WHOLE:
        return ids.astype(WHOLE[bits]).tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits :].reshape(-1)).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in WHOLE:
        return np.frombuffer(data, WHOLE[bits], n).astype(np.uint32)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(wide, axis=1).view(">u4").reshape(-1).astype(np.uint32)


class ShardWriter:
    def __init__(self, stream, bits: int):
        self.out, self.bits, self.at, self.n = stream, bits, 0, 0
        self.offsets: list[int] = []
        self.docs: list[int] = []
        self.starts: list[int] = []
        self.nulls = 0
        self.wait: list[np.ndarray] = []
        self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Documents without an id come first."""
        self.nulls += doc_id is None
        self.docs.append(doc_id or 0)
        self.starts.append(self.n)
        self.n += len(ids)
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            self._flush(False)

    def _flush(self, end: bool) -> None:
        ids = np.concatenate(self.wait) if self.wait else np.zeros(0, np.uint32)
        whole = len(ids) if end else len(ids) // BLOCK * BLOCK
        for a in range(0, whole, BLOCK):
            data = pack(ids[a : min(a + BLOCK, whole)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.wait, self.waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        self.out.write(np.array(self.offsets, "<u8").tobytes() + np.array(self.docs, "<i8").tobytes() + np.array([*self.starts, self.n], "<u8").tobytes())
        self.out.write(FOOTER.pack(MAGIC, self.bits, BLOCK, self.n, len(self.docs), self.nulls, self.at))


class Shard:
    """Random access to a shard file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - FOOTER.size)
        magic, self.bits, self.block, self.n, self.n_docs, self.nulls, self.end = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of packed token ids")
        blocks = -(-self.n // self.block)
        source.seek(self.end)
        index = source.read(8 * (blocks + 2 * self.n_docs + 1))
        self.offsets = np.frombuffer(index, "<u8", blocks)
        self.docs = np.frombuffer(index, "<i8", self.n_docs, 8 * blocks)
        self.starts = np.frombuffer(index, "<u8", self.n_docs + 1, 8 * (blocks + self.n_docs)).astype(np.int64)

    def block_ids(self, k: int) -> np.ndarray:
        """All ids of one block."""
        at = int(self.offsets[k])
        stop = int(self.offsets[k + 1]) if k + 1 < len(self.offsets) else self.end
        self.source.seek(at)
        return unpack(self.source.read(stop - at), min(self.block, self.n - k * self.block), self.bits)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start .. end - 1, from the blocks that hold them; no other is read, and one at a time."""
        out = np.empty(max(0, end - start), np.uint32)
        for k in range(start // self.block, -(-end // self.block) if end > start else 0):
            at = k * self.block
            part = self.block_ids(k)[max(0, start - at) : end - at]
            begin = max(start, at) - start
            out[begin : begin + len(part)] = part
        return out

    def document(self, i: int) -> tuple[int | None, int, np.ndarray]:
        """(document id, first id, ids) of the i-th document of the file."""
        s = int(self.starts[i])
        return (None if i < self.nulls else int(self.docs[i])), s, self.ids(s, int(self.starts[i + 1]))

    def pieces(self) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the document in the file, ids) in the order of the file, cut where blocks end, so that one block is
        held whatever the documents' sizes; a document without ids gives one empty piece."""
        i, stop = 0, self.starts[1:].tolist()
        for k in range(len(self.offsets)):
            ids, at, a = self.block_ids(k), k * self.block, 0
            while i < self.n_docs and (stop[i] <= at + len(ids)):
                yield i, ids[a : stop[i] - at]
                i, a = i + 1, stop[i] - at
            if a < len(ids):
                yield i, ids[a:]
        for j in range(i, self.n_docs):
            yield j, np.zeros(0, np.uint32)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, first id, ids) in the order of the file, each document whole; one document is held at a time."""
        parts: list[np.ndarray] = []
        got = 0
        for i, ids in self.pieces():
            parts.append(ids)
            got += len(ids)
            s = int(self.starts[i])
            if got == int(self.starts[i + 1]) - s:
                yield (None if i < self.nulls else int(self.docs[i])), s, np.concatenate(parts)
                parts, got = [], 0


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_packed(documents: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text, append end_id, and write shards in ascending id order; returns the manifest.

    Manifest: shard, path, n_ids, n_docs, base (ids in all shards before). Null text is empty; null ids come first; rows
    of one id are ordered by their text's hash. Ids are whole numbers (a column of another type is an error at once), an
    empty table gives an empty manifest, and other columns are not read. Each attempt of a task writes a file of its own
    name and the manifest holds those of the attempts that counted, so a lost executor leaves at most an unused file.
    """
    if not isinstance(documents.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be a column of whole numbers, not of {documents.schema[id_col].dataType.simpleString()}")
    spark = documents.sparkSession
    folder = folder or stage_path(spark, "packed")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = ChunkEncoder.of(tokenizer)
        writer, files, name, stream = None, None, "", None
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            if writer is None:
                files, base = _open(folder)
                files.create_dir(base, recursive=True)
                name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bits"
                stream = files.open_output_stream(f"{base}/{name}")
                writer = ShardWriter(stream, width(max(encoder.size, end_id + 1)))
            _, off = as_bytes(batch.column(1))
            for a, b in slices(off, 4 * SLICE):
                part = batch.slice(a, b - a)
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    writer.add(doc, np.frombuffer(ids + end, "<u4"))
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "path": [f"{folder}/{name}"], "n_ids": [writer.n], "n_docs": [len(writer.docs)]})

    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc()]
    done = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, "shard long, path string, n_ids long, n_docs long")
    manifest = materialize(done, "packed_manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_packed(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shard files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, path = _open(row["path"])
                with files.open_input_file(path) as f:
                    out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                    shard, crc, got = Shard(f), 0, 0
                    for i, ids in shard.pieces():
                        crc, got = zlib.crc32(ids.astype("<u4").tobytes(), crc), got + len(ids)
                        start, end = int(shard.starts[i]), int(shard.starts[i + 1])
                        if got < end - start:
                            continue
                        for k, v in zip(out, (None if i < shard.nulls else int(shard.docs[i]), row["base"] + start, got, crc), strict=True):
                            out[k].append(v)
                        crc = got = 0
                        if len(out["doc_id"]) == 10_000:
                            yield _rows(out)
                            out = {k: [] for k in out}
                    yield _rows(out)

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns.values()], list(columns))
