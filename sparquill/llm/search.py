"""Ranked lexical search: MaxScore over the shards of an inverted index.

The terms of the queries (a bounded block of them at a time) go to the tasks; one pass over the documents writes index
shards: for each of the block's terms the documents that hold it and how often, with every document's length. A shard
has a bounded number of documents and postings and is one row, so nothing is shuffled to build it. Counts of all
shards give each term's weight. Then each shard answers each query by itself: lists in descending order of the most that
they can add (their upper bound); while an unseen document could still come among the best, lists are essential and add to
all their documents; after that the remaining, non-essential lists are only probed at the documents that can still
qualify. What a shard's earlier neighbours in the task have reached is the bound to start from. Of the shards' best,
Spark keeps the best of each query.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.llm.arrowtext import as_bytes, inside_table, lowered, same_runs, slices, word_hashes
from sparquill.llm.leaks import words
from sparquill.plans.stage import materialize

#: Terms of a block of queries, with repeats; documents and postings of a shard (one document more at most).
BLOCK_TERMS, SHARD_DOCS, SHARD_POSTINGS = 1 << 20, 1 << 15, 4 << 20
INSIDE = inside_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
SALTS = 64


class Vocabulary:
    """Distinct terms in order of their hashes; find() gives each run's number or -1, by hash and then by its bytes."""

    def __init__(self, terms: list[str]):
        self.raw, off = as_bytes(pa.array(sorted(set(terms)), pa.string()))
        h, first, length = word_hashes(self.raw, off, 0, len(off) - 1, INSIDE)
        by = np.argsort(h, kind="stable")
        self.hashes, self.first, self.length = h[by], first[by], length[by]
        self.most = int(np.unique(h, return_counts=True)[1].max()) if len(h) else 0
        self.number = {self.raw[a : a + n].tobytes().decode(): i for i, (a, n) in enumerate(zip(self.first.tolist(), self.length.tolist(), strict=True))}

    def find(self, raw: np.ndarray, h: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        found = np.full(len(h), -1, np.int64)
        start = np.searchsorted(self.hashes, h)
        for more in range(self.most):
            at = np.minimum(start + more, len(self.hashes) - 1)
            i = np.flatnonzero((self.hashes[at] == h) & (self.length[at] == length) & (start + more < len(self.hashes)))
            i = i[same_runs(raw, first[i], self.raw, self.first[at[i]], length[i])]
            found[i] = at[i]
        return found


def _shard_rows(known: Vocabulary, batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    ids: list[pa.Array] = []
    lengths: list[np.ndarray] = []
    postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n_docs = n_postings = 0

    def shard() -> pa.RecordBatch:
        nonlocal ids, lengths, postings, n_docs, n_postings
        length = np.concatenate(lengths)
        term, doc, tf = (np.concatenate(x) for x in zip(*postings, strict=True))
        by = np.argsort(term, kind="stable")  # documents stay in order
        terms, start = np.unique(term[by], return_index=True)
        own = pa.concat_arrays(ids)
        out = pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                *(pa.array([np.ascontiguousarray(x, "<i4").tobytes()], pa.binary()) for x in (length, terms, np.append(start, len(term)), doc[by], tf[by])),
                pa.array([int((length > 0).sum())], pa.int64()), pa.array([int(length.sum())], pa.int64()),
            ],
            names=["ids", "lengths", "terms", "ends", "docs", "tfs", "n_docs", "n_terms"],
        )
        ids, lengths, postings, n_docs, n_postings = [], [], [], 0, 0
        return out

    for batch in batches:
        raw, off = as_bytes(batch.column(0))
        for a, b in slices(off):
            base = int(off[a])
            part = lowered(raw[base : int(off[b])])
            own_off = off[a : b + 1] - base
            h, first, length = word_hashes(part, own_off, 0, b - a, INSIDE)
            bound = np.searchsorted(first, own_off)
            term = known.find(part, h, first, length)
            row = np.repeat(np.arange(b - a), np.diff(bound))
            has = term >= 0
            key, tf = np.unique(row[has] * max(1, len(known.hashes)) + term[has], return_counts=True)
            ids.append(batch.column(1).slice(a, b - a).cast(id_type))
            lengths.append(np.diff(bound))
            postings.append((key % max(1, len(known.hashes)), key // max(1, len(known.hashes)) + n_docs, tf))
            n_docs += b - a
            n_postings += len(key)
            if n_docs >= SHARD_DOCS or n_postings >= SHARD_POSTINGS:
                yield shard()
    if n_docs:
        yield shard()


def build_index(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Vocabulary]:
    """Shards of an inverted index of the given terms over all documents, written once: ids, lengths in words, terms, ends
    of their postings, documents and counts of the postings (little-endian 32-bit), number of documents and words."""
    spark = docs.sparkSession
    known = Vocabulary(terms)
    shared = spark.sparkContext.broadcast(known)
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    id_type = rows.schema["id"].dataType
    schema = T.StructType().add("ids", T.ArrayType(id_type))
    for name in ("lengths", "terms", "ends", "docs", "tfs"):
        schema.add(name, T.BinaryType())
    schema.add("n_docs", T.LongType()).add("n_terms", T.LongType())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        yield from _shard_rows(shared.value, batches, to_arrow_type(id_type))

    return materialize(rows.mapInArrow(build, schema), "search_index"), known


def _ints(data: pa.Scalar) -> np.ndarray:
    return np.frombuffer(data.as_py(), "<i4").astype(np.int64)


def document_frequencies(index: DataFrame) -> DataFrame:
    """term (its number), df over all shards."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                term, ends = _ints(batch.column(0)[i]), _ints(batch.column(1)[i])
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.diff(ends))], names=["term", "df"])

    return index.select("terms", "ends").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def max_score(
    query: list[tuple[int, int]], lists: dict[int, tuple[np.ndarray, np.ndarray, int]], acc: np.ndarray, rank: np.ndarray, top: int, floor: int
) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the best of one shard, best first; of equal scores the one of lower rank.

    query: (term, factor); lists: term -> (documents, impacts, greatest impact). floor: a score that the top-th best of
    all surely has; lower ones may be missing. acc: zeros, one for each document of the shard; zeros again afterwards.
    """
    own = [(f * lists[t][2], f, t) for t, f in query if t in lists]
    own.sort(reverse=True)
    rest = np.cumsum([0, *(u for u, _, _ in reversed(own))])[::-1].tolist()  # rest[i]: the most that lists i and after add
    touched: list[np.ndarray] = []
    i, bar = 0, max(floor, 1)
    while i < len(own) and rest[i] >= bar:  # essential: a document not seen yet may qualify
        _, f, t = own[i]
        docs, impact, _ = lists[t]
        acc[docs] += f * impact
        touched.append(docs)
        i += 1
        if i < len(own):
            seen = acc if len(docs) * 4 > len(acc) else acc[docs]
            if len(seen) >= top:
                bar = max(bar, int(np.partition(seen, -top)[-top]))
    if not touched:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.flatnonzero(acc)
    docs, score = seen, acc[seen]
    acc[seen] = 0
    while True:
        if len(score) >= top:
            bar = max(bar, int(np.partition(score, -top)[-top]))
        ok = score + rest[i] >= bar
        docs, score = docs[ok], score[ok]
        if i == len(own) or not len(docs):
            break
        _, f, t = own[i]  # not essential: probed where a document can still qualify
        there, impact, _ = lists[t]
        at = np.minimum(np.searchsorted(there, docs), len(there) - 1)
        score = score + np.where(there[at] == docs, f * impact[at], 0)
        i += 1
    best = np.lexsort((rank[docs], -score))[:top]
    return docs[best], score[best]


def _answers(batches: Iterator[pa.RecordBatch], queries: list[list[tuple[int, int]]], n_docs: int, n_terms: int, top: int) -> Iterator[pa.RecordBatch]:
    floors: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
    shard = 0
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column(0)[i].values
            length, term, ends, docs, tfs = (_ints(batch.column(c)[i]) for c in range(1, 6))
            if not len(docs):
                continue
            m = 75 + (25 * length * n_docs) // n_terms
            impact = (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[docs])
            most = np.maximum.reduceat(impact, ends[:-1])
            lists = {t: (docs[a:b], impact[a:b], u) for t, a, b, u in zip(term.tolist(), ends[:-1].tolist(), ends[1:].tolist(), most.tolist(), strict=True)}
            rank = np.zeros(len(ids), np.int64)
            rank[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))  # nulls come last
            acc = np.zeros(len(ids), np.int64)
            found: list[tuple[int, np.ndarray, np.ndarray]] = []
            for q, query in enumerate(queries):
                floor = int(floors[q][-1]) if len(floors[q]) == top else 0
                own, score = max_score(query, lists, acc, rank, top, floor)
                if len(own):
                    found.append((q, own, score))
                    floors[q] = -np.sort(-np.concatenate([floors[q], score]))[:top]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.full(len(d), q) for q, d, _ in found])),
                        ids.take(pa.array(np.concatenate([d for _, d, _ in found]))),
                        pa.array(np.concatenate([s for _, _, s in found])),
                        pa.array(np.full(sum(len(d) for _, d, _ in found), shard)),
                    ],
                    names=["query", "id", "score", "shard"],
                )
            shard += 1


def _best(rows: DataFrame, top: int, *key: str) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_block(docs: DataFrame, block: DataFrame, top: int, id_col: str, text_col: str) -> DataFrame:
    """block: item, terms. Rows item, rank, id, score."""
    spark = docs.sparkSession
    rows = block.toArrow()
    items, terms = rows["item"], rows["terms"].to_pylist()
    index, known = build_index(docs, [t for x in terms for t in x], id_col, text_col)
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    df = {r["term"]: r["df"] for r in document_frequencies(index).collect()}  # a row a term of the block
    queries: list[list[tuple[int, int]]] = []
    for x in terms:
        times: dict[int, int] = {}
        for t in x:
            times[known.number[t]] = times.get(known.number[t], 0) + 1
        queries.append([(t, w) for t, n in times.items() if t in df and (w := n * weight(n_docs, df[t])) > 0])
    shared = spark.sparkContext.broadcast(queries)
    id_type = index.schema["ids"].dataType.elementType
    schema = T.StructType().add("query", T.LongType()).add("id", id_type).add("score", T.LongType()).add("shard", T.LongType())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _answers(batches, shared.value, n_docs, n_terms, top)

    found = index.select("ids", "lengths", "terms", "ends", "docs", "tfs").mapInArrow(answer, schema)
    salted = found.withColumn("salt", F.pmod(F.hash("id", "shard"), F.lit(SALTS)))
    best = _best(_best(salted, top, "query", "salt").drop("rank"), top, "query")
    names = spark.createDataFrame(pa.table({"query": pa.array(range(len(items)), pa.int64()), "item": items}))
    return best.join(F.broadcast(names), "query").select("item", F.col("rank").cast("int").alias("rank"), "id", "score")


def search(
    docs: DataFrame, queries: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """The best documents of each row of queries: item, rank from 1, document id, score; only scores above 0.

    Terms are runs of digits, letters a-z (A-Z lower-cased) and everything that is not ASCII; null texts have none. With N
    documents that hold a term at all, L terms in them, n in this one, and df documents of a term that is tf times here:
    weight floor(1000 ln((2N+2)/(2df+1))), m = 75 + 25 n N div L, score the sum over the query's terms, with repeats,
    of weight * (10^9 tf div (1000 tf + 12 m)). Equal scores stand in ascending order of ids, null last.
    Queries are taken in blocks of block_terms terms; each block has its own index, so what is broadcast stays bounded.
    Defined cases: rows of queries that share a name are queries of their own; a query without terms, or an empty table
    on either side, gives no rows; documents that repeat an id are ranked each. Other columns are not read.
    """
    rows = materialize(queries.select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("terms")).where(F.size("terms") > 0), "search_queries")
    n = max(1, math.ceil((rows.agg(F.sum(F.size("terms"))).first()[0] or 0) / block_terms))
    block = F.pmod(F.xxhash64("item", "terms"), F.lit(n))  # of an empty table, one block without rows
    found = functools.reduce(DataFrame.union, [_search_block(docs, rows.where(block == i), top, id_col, text_col) for i in range(n)])
    return found.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
