"""Benchmark decontamination: windows of test items looked up in a broadcast hash set.

The windows of all items (ten consecutive words, or the whole of a shorter item) are made by Spark, sized, and cut into
slices of at most SLICE_BYTES, by hash. A slice is a hash set that tasks get by broadcast; one pass over the documents,
without an exchange, rolls a hash over their words, looks every window up, and compares the words of each hit with those
of the item's window. A test set of one slice, the usual case, needs nothing else. With more of them each slice has
its own pass and the hits of a document meet by its number; every slice has the same bound, however many there are.
"""

from __future__ import annotations

import functools
import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.llm.arrowtext import as_bytes, inside_table, lowered, mix, same_runs, slices, word_hashes
from sparquill.plans.stage import materialize

WINDOW = 10
#: Bytes of windows and item names in one broadcast set.
SLICE_BYTES = 32 << 20
#: What is no word: ASCII but digits and a-z, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
INSIDE = inside_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

SPAN = "struct<word_from:bigint,word_to:bigint,byte_from:bigint,byte_to:bigint>"
_FOUND = f"n_words bigint, spans array<{SPAN}>, items array<string>"
_SPAN_ARROW = pa.struct([(n, pa.int64()) for n in ("word_from", "word_to", "byte_from", "byte_to")])


def words(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, runs of digits, a-z and all that is not ASCII; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (as text), gram, words: one row for each item and distinct window of it. Items without words have none."""
    split = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    split = split.withColumn("n", F.least(F.size("w"), F.lit(window)))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))
    return split.select("item", F.explode(F.array_distinct(grams)).alias("gram"), F.col("n").alias("words")).distinct()


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n hashes."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(out)])
    return out


class WindowSet:
    """Windows in order of their hashes, for each length in words, with the names of their items."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.names = rows["item"].combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.string()).dictionary_encode()
        grams = rows["gram"].combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.string()).dictionary_encode()
        self.raw, off = as_bytes(grams.dictionary)
        h, first, length = word_hashes(self.raw, off, 0, len(off) - 1, INSIDE)
        bound = np.searchsorted(first, off)
        size = np.diff(bound)
        gram, item = grams.indices.to_numpy(), self.names.indices.fill_null(-1).to_numpy()
        order = np.argsort(gram, kind="stable")
        self.of_gram = np.searchsorted(gram[order], np.arange(len(size) + 1))
        self.items = item[order]
        self.by_size = {}
        for n in np.unique(size).tolist():
            at = bound[:-1][size == n]
            grown = rolled(h, n)[at]
            by = np.argsort(grown, kind="stable")
            place = at[by][:, None] + np.arange(n)
            most = int(np.unique(grown, return_counts=True)[1].max())
            self.by_size[n] = grown[by], np.flatnonzero(size == n)[by], first[place], length[place], most

    def hits(self, raw: np.ndarray, h: np.ndarray, first: np.ndarray, length: np.ndarray, row_end: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, first word, window) of all verified hits; row_end has the end of each word's row, as a number of words."""
        for n, (known, gram, w_first, w_length, most) in self.by_size.items():
            own = rolled(h, n)
            own_at = np.searchsorted(known, own)
            for more in range(most):  # windows that share a hash
                at = np.minimum(own_at + more, len(known) - 1)
                i = np.flatnonzero((known[at] == own) & (own_at + more < len(known)))
                i = i[i + n <= row_end[i]]
                w = at[i]
                ok = np.ones(len(i), bool)
                for j in range(n):
                    ok &= length[i + j] == w_length[w, j]
                    left = np.flatnonzero(ok)
                    ok[left] = same_runs(raw, first[i[left] + j], self.raw, w_first[w[left], j], length[i[left] + j])
                yield n, i[ok], gram[w[ok]]


def _scan_slice(known: WindowSet, column: pa.Array, a: int, b: int, raw: np.ndarray, off: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """n_words, spans and items of rows a..b."""
    base = int(off[a])
    raw, off = lowered(raw[base : int(off[b])]), off[a : b + 1] - base
    h, first, length = word_hashes(raw, off, 0, b - a, INSIDE)
    bound = np.searchsorted(first, off)
    row = np.repeat(np.arange(b - a), np.diff(bound))
    change = np.zeros(len(h) + 1, np.int64)
    pairs = [np.zeros(0, np.int64)]
    n_names = len(known.names.dictionary)
    for n, i, gram in known.hits(raw, h, first, length, bound[row + 1]):
        np.add.at(change, i, 1)
        np.add.at(change, i + n, -1)
        met = np.unique(row[i] * len(known.of_gram) + gram)
        in_row, gram = met // len(known.of_gram), met % len(known.of_gram)
        count = known.of_gram[gram + 1] - known.of_gram[gram]
        place = np.repeat(known.of_gram[gram] - np.cumsum(count) + count, count) + np.arange(count.sum())
        name = known.items[place]
        pairs.append((np.repeat(in_row, count) * n_names + name)[name >= 0])
    hit = np.cumsum(change[:-1]) > 0
    edge = np.ones(len(h) + 1, bool)  # a row's first word; the end
    edge[1:-1] = row[1:] != row[:-1]
    start = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
    stop = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]])))
    own = row[start]
    spans = pa.StructArray.from_arrays(
        [pa.array(x.astype(np.int64)) for x in (start - bound[own], stop + 1 - bound[own], first[start] - off[own], first[stop] + length[stop] - off[own])], fields=list(_SPAN_ARROW)
    )
    found = np.unique(np.concatenate(pairs))
    ends = np.arange(b - a + 1)
    items = known.names.dictionary.take(pa.array(found % max(n_names, 1)))
    return (
        pa.array(np.diff(bound).astype(np.int64)),
        pa.ListArray.from_arrays(pa.array(np.searchsorted(own, ends).astype(np.int32)), spans),
        pa.ListArray.from_arrays(pa.array(np.searchsorted(found // max(n_names, 1), ends).astype(np.int32)), items),
    )


def _scan(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs (text first, then what stays) with one slice of windows looked up: what stays, n_words, spans, items."""
    known = docs.sparkSession.sparkContext.broadcast(WindowSet(rows.toArrow()))
    kept = T.StructType(docs.schema.fields[1:])
    schema = T.StructType([*kept.fields, *T.StructType.fromDDL(_FOUND).fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = as_bytes(batch.column(0))
            for a, b in slices(off):
                found = _scan_slice(known.value, batch.column(0), a, b, raw, off)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *found], names=[*part.schema.names[1:], "n_words", "spans", "items"])

    return docs.mapInArrow(scan, schema)


def _merged(found: DataFrame) -> DataFrame:
    """number, n_words, spans, items of several passes -> one row a number: overlapping and touching spans are one."""
    spans = found.select("number", F.inline("spans"))
    in_order = Window.partitionBy("number").orderBy("word_from", "word_to")
    before = F.max("word_to").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(before >= F.col("word_from"), 0).otherwise(1))
    spans = spans.withColumn("island", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("number", "island").agg(F.min("word_from").alias("word_from"), F.max("word_to").alias("word_to"), F.min("byte_from").alias("byte_from"), F.max("byte_to").alias("byte_to"))
    spans = spans.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("word_from", "word_to", "byte_from", "byte_to"))).alias("spans"))
    items = found.groupBy("number").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return items.join(spans, "number", "left").select("number", "n_words", F.coalesce("spans", F.expr(f"cast(array() as array<{SPAN}>)")).alias("spans"), "items")


def _looked_up(docs: DataFrame, benchmark: DataFrame, window: int, item_col: str, item_text_col: str, slice_bytes: int) -> DataFrame:
    """docs (text first) -> the other columns, n_words, spans, items."""
    grams = materialize(windows(benchmark, window, item_col, item_text_col), "leak_windows")
    weight = F.octet_length("gram") + F.coalesce(F.octet_length("item"), F.lit(0)) + F.lit(64) + F.col("words") * 16
    n = max(1, math.ceil((grams.agg(F.sum(weight)).first()[0] or 0) / slice_bytes))
    if n == 1:
        return _scan(docs, grams)
    kept = materialize(docs.withColumn("number", F.monotonically_increasing_id()), "leak_documents")
    text = kept.columns[0]
    slice_of = F.pmod(F.xxhash64("gram", "item"), F.lit(n))
    passes = [_scan(kept.select(text, "number"), grams.where(slice_of == i)) for i in range(n)]
    merged = _merged(functools.reduce(DataFrame.union, passes))
    return kept.drop(text).join(merged, "number").drop("number")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """One row for each document: id, n_words, spans (runs of hit words, as words and as bytes of the UTF-8 text), items (the
    names, as text and in its order, of the test items of which a window occurs).

    A word of a document is hit if it lies inside an occurrence of a window; all words of a window lie in one text.
    Defined cases: null and empty texts have no words, and an item without words has no window; items of the same name
    are one item; an item without a name marks words but is not listed; repeated documents each get their row; either
    table may be empty. Other columns are not read.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("__id"))
    out = _looked_up(rows, benchmark, window, item_col, item_text_col, slice_bytes)
    return out.select(F.col("__id").alias(id_col), "n_words", "spans", F.array_sort("items").alias("items"))


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["word_to"] - x["word_from"])


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, remove: str = "spans", window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """docs with its own columns, cleaned: remove='documents' drops those with a hit, 'spans' cuts the hit words out.

    From a cut run go all bytes from its first word's first to its last word's last; what stands around it stays, and a
    text of which nothing is left is empty. Null texts stay null. Other cases as in find_leaks().
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    own = docs.columns
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    found = _looked_up(rows, benchmark, window, item_col, item_text_col, slice_bytes)
    if remove == "documents":
        return found.where(F.size("spans") == 0).select(*[F.col("row")[c].alias(c) for c in own])
    data = F.encode(F.col("row")[text_col], "UTF-8")
    ends = F.concat(F.transform("spans", lambda s: s["byte_from"]), F.array(F.octet_length(data).cast("long")))
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["byte_to"]))
    kept = F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda p: F.substring(data, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")).cast("string"))
    text = F.when(F.size("spans") == 0, F.col("row")[text_col]).otherwise(F.array_join(kept, ""))
    return found.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in own])
