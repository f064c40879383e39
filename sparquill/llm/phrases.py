"""Phrase collocations: suffix automata over shards of words, counted globally level by level.

Documents become shards once: of one language, a dictionary of words and the words' numbers, pieces apart. Over a shard
stands a generalised suffix automaton of bounded depth: a state is a set of phrases that end at just the same places,
with their number (endpos), and its suffix link leads to the longest suffix that ends at more places. It is built by
sorting, a level of phrase lengths at a time; a state's phrases are the suffixes of its longest one.

No phrase is frequent unless all its words are, and all its pairs of neighbours. So words are counted first, then pairs of
frequent words, then phrases of three and more whose pairs are all frequent. These rounds count hashes of 48 bits, packed
into arrays, a row for each shard and range of hashes; what reaches the least count becomes a bitmap of fixed size. A last
round counts the phrases themselves, of those that the bitmaps let pass: where different phrases share a hash, they only
pass in vain. All exchanges are by hash of the phrase, so a frequent one is no more than an entry of each shard.
"""

from __future__ import annotations

import contextlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.llm.arrowtext import SLICE, as_bytes, inside_table, lowered, mix, same_runs, slices, word_hashes
from sparquill.plans.stage import materialize, release

#: Words of a shard (a document's piece more at most). Bits of a filter: at most FILTER_BITS / 64 rows get to the driver.
SHARD_WORDS, FILTER_BITS = 500_000, 1 << 26
#: Entries of the corpus (words, times the lengths of phrases that are counted) for each range of hashes, which is a task of its
#: own, and entries that a task holds before it adds them up. Phrases that are counted as they are have passed the bitmaps: one length's.
RANGE_ENTRIES, HELD = 2_000_000, 1_000_000
#: What parts pieces; beside it, space and tab part words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
INSIDE = inside_table(PIECE_ENDS + b" \t")
_ENDS = ~inside_table(PIECE_ENDS)
UNKNOWN = "und"


def distinct_runs(raw: np.ndarray, h: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct run among all, each run's number), by hash, then by bytes; frequent ones come first."""
    _, at, number = np.unique(h, return_index=True, return_inverse=True)
    while True:
        odd = np.flatnonzero(length[at[number]] != length)
        same = np.flatnonzero(length[at[number]] == length)
        odd = np.concatenate([odd, same[~same_runs(raw, first[same], raw, first[at[number[same]]], length[same])]])
        if not len(odd):
            break
        # runs that share a hash but are not equal: the first of them gets a number of its own, and so on
        here = odd[np.unique(number[odd], return_index=True)[1]]
        fresh = dict(zip(number[here].tolist(), range(len(at), len(at) + len(here)), strict=True))
        number[odd] = [fresh[x] for x in number[odd].tolist()]
        at = np.concatenate([at, here])
    count = np.bincount(number, minlength=len(at))
    order = np.argsort(-count, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return at[order], place[number]


class _Buffer:
    """Words of one language that wait for their shard."""

    def __init__(self) -> None:
        self.texts: list[np.ndarray] = []
        self.words: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_bytes = self.n_words = 0

    def add(self, raw: np.ndarray, h: np.ndarray, first: np.ndarray, length: np.ndarray, begins: np.ndarray) -> None:
        self.texts.append(raw)
        self.words.append((h, first + self.n_bytes, length, begins))
        self.n_bytes += len(raw)
        self.n_words += len(h)

    def shard(self, lang: str) -> pa.RecordBatch:
        raw = np.concatenate(self.texts)
        h, first, length, begins = (np.concatenate(x) for x in zip(*self.words, strict=True))
        at, number = distinct_runs(raw, h, first, length)
        # a 0 stands before each piece, so numbers start with 1
        codes = np.insert(number + 1, np.flatnonzero(begins), 0).astype("<i4")
        data, cut = raw.tobytes(), zip(first[at].tolist(), length[at].tolist(), strict=True)
        words = pa.array([data[a : a + n] for a, n in cut], pa.binary()).cast(pa.string())
        count = np.bincount(number, minlength=len(at))
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]), *(pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), x) for x in (words, pa.array(count))), pa.array([codes.tobytes()])], names=["lang", "words", "counts", "codes"]
        )


def _parts(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lower-cased bytes, edges of their texts), slice by slice; a text longer than a slice comes in several, cut between pieces."""
    for a, b in slices(off, SLICE):
        start, stop = int(off[a]), int(off[b])
        if b - a > 1 or stop - start <= SLICE:
            yield lowered(raw[start:stop]), off[a : b + 1] - start
            continue
        while start < stop:
            end = min(stop, start + SLICE)
            while end < stop and not _ENDS[raw[end - 1]]:
                more = _ENDS[raw[end : end + SLICE]]
                end = end + int(more.argmax()) + 1 if more.any() else min(stop, end + SLICE)
            yield lowered(raw[start:end]), np.array([0, end - start])
            start = end


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, words (distinct), counts, codes (numbers of the words from 1 in the order of the texts, 0 before a piece)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: dict[str, _Buffer] = {}
        n = 0
        for batch in batches:
            known = batch.column(1).dictionary_encode()
            for k, lang in enumerate(known.dictionary.to_pylist()):
                column = batch.column(0).filter(pc.equal(known.indices, k))
                for part, edges in _parts(*as_bytes(column)):
                    h, first, length = word_hashes(part, edges, 0, len(edges) - 1, INSIDE)
                    if not len(h):
                        continue
                    ends = np.cumsum(_ENDS[part])
                    piece = ends[first] + np.searchsorted(edges, first, "right") * (len(part) + 1)
                    begins = np.concatenate([[True], piece[1:] != piece[:-1]])
                    wait.setdefault(lang, _Buffer()).add(part, h, first, length, begins)
                    n += len(h)
                    if n >= shard_words:
                        yield from (x.shard(name) for name, x in wait.items())
                        wait, n = {}, 0
        yield from (x.shard(name) for name, x in wait.items())

    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"))
    return rows.mapInArrow(build, "lang string, words array<string>, counts array<bigint>, codes binary")


def _hashes(words: pa.Array, lang: str) -> np.ndarray:
    """A hash of each word of a shard by its number; that of 0 is not used."""
    raw, off = as_bytes(words)
    seed = mix(np.array([zlib.crc32(lang.encode())], np.uint64))
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), mix(word_hashes(raw, off, 0, len(off) - 1, INSIDE)[0] + seed)])


def _bucket(h: np.ndarray, codes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """48 bits of a hash of the phrase of k words at each place."""
    out = h[codes[at]]
    with np.errstate(over="ignore"):
        for j in range(1, k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[codes[at + j]])
    return (out >> np.uint64(16)).astype(np.int64)


class FrequentFilter:
    """A bitmap of fixed size over the buckets (column bucket) of what is frequent."""

    def __init__(self, buckets: DataFrame, bits: int = FILTER_BITS):
        bit = F.pmod(F.col("bucket"), F.lit(bits)).alias("bit")
        rows = buckets.select(bit).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask")).toArrow()
        self.bits = bits
        self.map = np.zeros(bits // 64, np.int64)
        self.map[rows["word"].to_numpy()] = rows["mask"].to_numpy()

    def has(self, bucket: np.ndarray) -> np.ndarray:
        bit = bucket % self.bits
        return (self.map[bit >> 6] >> (bit & 63)) & 1 == 1


class Automaton:
    """The generalised suffix automaton of a shard's pieces, for phrases of two words up over the places allowed.

    Level k has a number for each distinct phrase of k words: where it first stands (first), at how many places (count),
    and its suffix of k - 1 words (link). A phrase is in one state with its suffix if both stand at equally many places,
    for then at the same ones; a state's longest phrase has nothing longer in its state (top).
    """

    def __init__(self, codes: np.ndarray, starts: dict[int, np.ndarray], n_words: int):
        """starts: for each length from 2 on, the places where a phrase of this length may begin; with a place of one length,
        the next place is one of the length before."""
        self.first: dict[int, np.ndarray] = {}
        self.count: dict[int, np.ndarray] = {}
        self.link: dict[int, np.ndarray] = {}
        self.top: dict[int, np.ndarray] = {}
        number = codes.astype(np.int64)  # of the phrase of k - 1 words at each place
        for k, at in starts.items():
            key = number[at] * (n_words + 1) + codes[at + k - 1]
            _, first, own, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            self.first[k], self.count[k] = at[first], count
            self.top[k] = np.ones(len(first), bool)
            if k - 1 in self.first:
                self.link[k] = number[at[first] + 1]
                self.top[k - 1][self.link[k][count == self.count[k - 1][self.link[k]]]] = False
            number = np.zeros(len(codes), np.int64)
            number[at] = own

    def phrases(self, low: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """All phrases of low words and more, state by state: (words, where they first stand, count)."""
        for k, at, least, count in self.states(low):
            for m in range(k, low - 1, -1):
                own = least <= m
                yield m, at[own] + k - m, count[own]

    def states(self, low: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length from low on: (words of the longest phrases, where they stand, words of their states' shortest
        that is not below low, count)."""
        for k, top in self.top.items():
            if k < low:
                continue
            own = np.flatnonzero(top)
            least, now, level = np.full(len(own), k), own, k
            going = np.arange(len(own))
            while level > low and len(going):
                down = self.link[level][now]
                same = self.count[level - 1][down] == self.count[level][now]
                going, now = going[same], down[same]
                level -= 1
                least[going] = level
            yield k, self.first[k][own], least, self.count[k][own]


def _starts(codes: np.ndarray, words_ok: np.ndarray, high: int, h: np.ndarray | None = None, pairs: FrequentFilter | None = None) -> dict[int, np.ndarray]:
    """Places of phrases of 2..high words of which every word, and every pair of neighbours where a filter is given, is allowed."""
    ok = words_ok[codes]
    ok[codes == 0] = False
    run = ok[:-1] & ok[1:]
    out, at = {}, np.flatnonzero(run)
    if pairs is not None:
        at = at[pairs.has(_bucket(h, codes, at, 2))]
        run = np.zeros(len(run), bool)
        run[at] = True
    for k in range(2, high + 1):
        if k > 2:
            at = at[at + k - 2 < len(run)]
            at = at[run[at + k - 2]]
        out[k] = at
    return out


def _each_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """(lang, words, counts, codes) of each row."""
    for batch in batches:
        for i in range(batch.num_rows):
            lang, words, counts = batch.column(0)[i].as_py(), batch.column(1)[i].values, batch.column(2)[i].values.to_numpy()
            yield lang, words, counts, np.frombuffer(batch.column(3)[i].as_py(), "<i4").astype(np.int64)


def _planes(x: np.ndarray, n: int) -> bytes:
    """Numbers as their lowest bytes, then their second ones and so on: what is mostly zero stands together."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _of_planes(data: bytes | pa.Buffer, n: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(n, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :n] = planes.T
    return out.view("<u8")[:, 0].astype(np.int64)


def _parts_by_range(bucket: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by range and bucket, the ranges met, the end of each within the order)."""
    of = bucket % ranges
    order = np.lexsort((bucket, of))
    met, start = np.unique(of[order], return_index=True)
    return order, met, np.append(start[1:], len(order))


@contextlib.contextmanager
def _few_shards(table: DataFrame) -> Iterator[None]:
    """Statements in here read few shards of the written table at once: a row has megabytes, and Spark's reader takes thousands of rows."""
    conf, key = table.sparkSession.conf, "spark.sql.parquet.columnarReaderBatchSize"
    was = conf.get(key)
    conf.set(key, "8")
    try:
        yield
    finally:
        conf.set(key, was)


def _dealt(packed: DataFrame, ranges: int) -> DataFrame:
    """A task for each range: dealt by a hash of it, a few of many tasks would get several ranges, and hold them all."""
    return packed.repartitionById(ranges, F.col("range").cast("int"))


def _views(column: pa.Array) -> Iterator[pa.Buffer]:
    """The values of a binary column, not copied."""
    return (x.as_buffer() for x in column)


def frequent_buckets(table: DataFrame, low: int, high: int, least: int, ranges: int, words_ok: FrequentFilter | None = None, pairs_ok: FrequentFilter | None = None) -> DataFrame:
    """bucket: hashes of phrases of low..high words that stand, those which share it taken together, at least so often."""
    shared = table.sparkSession.sparkContext.broadcast((words_ok, pairs_ok))

    def added(bucket: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        own, n = np.concatenate(bucket), np.concatenate(times)
        order = np.argsort(own)
        own, n = own[order], n[order]
        del order
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        return own[head], np.add.reduceat(n, head) if len(own) else n

    def packed_parts(bucket: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order, met, ends = _parts_by_range(bucket, ranges)
        bucket, n = bucket[order], n[order]
        cut = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if len(met) else []
        return pa.RecordBatch.from_arrays(
            [pa.array(met), pa.array([_planes(np.diff(bucket[a:b], prepend=0), 6) for a, b in cut], pa.binary()), pa.array([_planes(n[a:b], 4) for a, b in cut], pa.binary())], names=["range", "buckets", "times"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each range of what some shards hold, which a task adds up while they are few."""
        good_words, good_pairs = shared.value
        buckets: list[np.ndarray] = []
        times: list[np.ndarray] = []
        for lang, words, counts, codes in _each_shard(batches):
            h = _hashes(words, lang)
            if high == 1:
                buckets.append(_bucket(h, np.arange(len(h)), np.arange(1, len(h)), 1))
                times.append(counts)
            else:
                ok = good_words.has(_bucket(h, np.arange(len(h)), np.arange(len(h)), 1))
                automaton = Automaton(codes, _starts(codes, ok, high, h, good_pairs), len(words))
                for k, at, n in automaton.phrases(low):
                    buckets.append(_bucket(h, codes, at, k))
                    times.append(n)
            if sum(map(len, times)) > HELD:
                yield packed_parts(*added(buckets, times))
                buckets, times = [], []
        if times:
            yield packed_parts(*added(buckets, times))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, times, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            for a, b in zip(_views(batch.column(1)), _views(batch.column(2)), strict=True):
                bucket.append(np.cumsum(_of_planes(a, 6)))
                times.append(_of_planes(b, 4))
                held += len(times[-1])
                if held > max(HELD, 2 * len(bucket[0])):
                    own, total = added(bucket, times)
                    bucket, times, held = [own], [total], len(own)
        own, total = added(bucket, times)
        yield pa.RecordBatch.from_arrays([pa.array(own[total >= least])], names=["bucket"])

    packed = table.select("lang", "words", "counts", "codes").mapInArrow(count, "range bigint, buckets binary, times binary")
    return _dealt(packed, ranges).mapInArrow(add, "bucket bigint")


def _joined(words: pa.Array, codes: np.ndarray, at: np.ndarray, k: int) -> pa.Array:
    parts = [words.take(pa.array(codes[at + j] - 1)) for j in range(k)]
    return pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]


COLUMNS = ["lang", "phrase", "words", "bucket", "n"]


def count_phrases(table: DataFrame, longest: int, least: int, ranges: int, words_ok: FrequentFilter, pairs_ok: FrequentFilter, more_ok: FrequentFilter | None) -> DataFrame:
    """lang, phrase, words, a: phrases of at most longest words that stand at least so often, counted as they are."""
    shared = table.sparkSession.sparkContext.broadcast((words_ok, pairs_ok, more_ok))

    def added(held: list[pa.Table]) -> pa.Table:
        rows = pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("words", "min"), ("bucket", "min"), ("n", "sum")])
        return rows.select(["lang", "phrase", "words_min", "bucket_min", "n_sum"]).rename_columns(COLUMNS)

    def packed_parts(rows: pa.Table) -> pa.RecordBatch:
        order, met, ends = _parts_by_range(rows["bucket"].to_numpy(), ranges)
        edges = pa.array(np.append(0, ends).astype(np.int32)) if len(met) else pa.array([0], pa.int32())
        rows = rows.take(pa.array(order)).combine_chunks()
        lists = [pa.ListArray.from_arrays(edges, pa.concat_arrays(rows[c].chunks) if rows.num_rows else pa.array([], rows[c].type)) for c in COLUMNS]
        return pa.RecordBatch.from_arrays([pa.array(met), *lists], names=["range", *COLUMNS])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good_words, good_pairs, good_more = shared.value
        held: list[pa.Table] = []
        for lang, words, counts, codes in _each_shard(batches):
            h = _hashes(words, lang)
            numbers = np.arange(len(h))
            ok = good_words.has(_bucket(h, numbers, numbers, 1))
            ok[0] = False
            own = np.flatnonzero(ok)
            found = [(_joined(words, numbers, own, 1), np.full(len(own), 1), _bucket(h, numbers, own, 1), counts[own - 1])]
            automaton = Automaton(codes, _starts(codes, ok, longest, h, good_pairs), len(words))
            for k, at, times in automaton.phrases(2):
                bucket = _bucket(h, codes, at, k)
                keep = (good_pairs if k == 2 else good_more).has(bucket)
                found.append((_joined(words, codes, at[keep], k), np.full(int(keep.sum()), k), bucket[keep], times[keep]))
            k, bucket, n = (np.concatenate([x[i] for x in found]).astype(np.int64) for i in (1, 2, 3))
            names = pa.array([lang]).take(pa.array(np.zeros(len(k), np.int64)))
            held.append(pa.table([names, pa.concat_arrays([x[0] for x in found]), pa.array(k.astype(np.int32)), pa.array(bucket), pa.array(n)], names=COLUMNS))
            if sum(x.num_rows for x in held) > HELD // 2:
                yield packed_parts(added(held))
                held = []
        if held:
            yield packed_parts(added(held))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = kept = 0
        for batch in batches:
            held.append(pa.table([pc.list_flatten(batch.column(i)) for i in range(1, 6)], names=COLUMNS))
            n += held[-1].num_rows
            if n > max(HELD // 2, 2 * kept):
                held = [added(held)]
                n = kept = held[0].num_rows
        if held:
            rows = added(held)
            yield from rows.filter(pc.greater_equal(rows["n"], least)).select(["lang", "phrase", "words", "n"]).rename_columns(["lang", "phrase", "words", "a"]).combine_chunks().to_batches()

    lists = "lang array<string>, phrase array<string>, words array<int>, bucket array<bigint>, n array<bigint>"
    packed = table.select("lang", "words", "counts", "codes").mapInArrow(count, f"range bigint, {lists}")
    return _dealt(packed, ranges).mapInArrow(add, "lang string, phrase string, words int, a bigint")


def frequent_phrases(table: DataFrame, longest: int = 5, least_count: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of all phrases of at most so many words that stand at least so often, and (lang, n)."""
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    totals = materialize(table.groupBy("lang").agg(F.sum(total).alias("n")), "phrase_totals")
    partitions = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_words = totals.agg(F.sum("n")).first()[0] or 0

    def ranges(low: int, high: int) -> int:
        return max(partitions, math.ceil(n_words * (high - low + 1) / RANGE_ENTRIES))

    def filter_of(low: int, high: int, *before: FrequentFilter) -> FrequentFilter:
        with _few_shards(table):
            buckets = materialize(frequent_buckets(table, low, high, least_count, ranges(low, high), *before), "phrase_buckets")
        made = FrequentFilter(buckets)
        release(buckets)
        return made

    words = filter_of(1, 1)
    pairs = filter_of(2, 2, words)
    more = filter_of(3, longest, words, pairs) if longest > 2 else None
    with _few_shards(table):
        return materialize(count_phrases(table, longest, least_count, ranges(1, 1), words, pairs, more), "phrase_frequent"), totals


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(17,0)")


def best_cuts(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """frequent's phrases of two words and more, with l, r, n and score of the cut that scores least (the first of equals)."""
    cuts = frequent.where("words > 1").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', cut)")).withColumn("right", F.expr("substring_index(phrase, ' ', cut - words)"))
    part = frequent.select("lang", F.col("phrase").alias("part"), F.col("a").alias("times"))
    cuts = cuts.join(part.select("lang", F.col("part").alias("left"), F.col("times").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("part").alias("right"), F.col("times").alias("r")), ["lang", "right"]).join(totals, "lang")
    top = (_exact("a") * _exact("n") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)")
    below = (_exact("l") * _exact("r")).cast("decimal(38,0)")
    cuts = cuts.withColumn("over", top).withColumn("under", below).withColumn("score", F.expr("over div under"))
    best = F.min(F.struct("score", "cut", "l", "r"))
    return cuts.groupBy("lang", "phrase", "words", "a", "n").agg(best.alias("best")).select("lang", "phrase", "words", "a", "n", "best.l", "best.r", "best.score")


def not_subsumed(scored: DataFrame, frequent: DataFrame, percent: int = 100) -> DataFrame:
    """Without phrases inside of a longer frequent one that stands at least percent / 100 times as often.

    A phrase is inside of one that is one word longer as its suffix (the automaton's link) or its prefix; if it is inside of a
    longer one that stands often enough, so it is inside of one in between, which stands at least as often.
    """
    longer = frequent.where("words > 2")
    inner = longer.select("lang", F.expr("substring_index(phrase, ' ', 1 - words)").alias("phrase"), "a").union(longer.select("lang", F.expr("substring_index(phrase, ' ', words - 1)").alias("phrase"), "a"))
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    joined = scored.join(most, ["lang", "phrase"], "left")
    return joined.where(F.coalesce(100 * F.col("around") < percent * F.col("a"), F.lit(True))).drop("around")


def collocations(
    docs: DataFrame, top: int = 2000, longest: int = 5, least_count: int = 100, subsumed_percent: int = 100, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS
) -> DataFrame:
    """The top phrases of each language: lang, rank from 1, phrase, words, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at .,;:!? and line ends, and these into words at spaces and tabs. A phrase of
    two words and more that stands at least least_count times (a) in pieces is cut after each of its words, into parts that
    stand l and r times, with score floor(1000 a n / (l r)), n being all words of the language; the lowest score
    counts, of equal ones the first cut. Order: score descending, a descending, phrase ascending by its bytes.
    Defined cases: null texts are empty; a null language is 'und' (with documents of that language, if there are any); a
    language without phrases has no rows; repeated rows count as often as they stand; an empty table gives no rows. Other
    columns are not read.
    """
    table = materialize(shards(docs, text_col, lang_col, shard_words), "phrase_shards")
    frequent, totals = frequent_phrases(table, longest, least_count)
    release(table)
    rows = not_subsumed(best_cuts(frequent, totals), frequent, subsumed_percent)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = rows.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(64)))
    for key in (["lang", "salt"], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("words").cast("int").alias("words"), "a", "l", "r", "n", "score")
