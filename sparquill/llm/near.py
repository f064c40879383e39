"""Near-duplicate documents by ProbMinHash, banding and verification.

A document's five-word shingles are weighted by how often they occur. Each shingle sends a Poisson process of arrivals,
at a rate of its weight, to random registers; a register keeps the shingle of its earliest arrival, so two documents
agree in a register with the probability Jaccard similarity of their shingle distributions. A shingle's process ends as
soon as its next arrival is later than all of the document's registers. Registers are banded, bands are buckets, and
candidates are verified by the Jaccard similarity of their sets of 32-bit shingle hashes. As a passage that one text repeats moves
its counts but not its set, a document with repeated shingles has a second sketch, of unit weights. One without has the
same registers by both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.llm.arrowtext import as_bytes, mix, slices, word_hashes
from sparquill.llm.linking import Likeness, link_buckets
from sparquill.plans.stage import materialize, may_contain, release

WORDS, SIMILARITY = 5, 0.8
#: 24 bands of 4 registers: a pair of set similarity 0.8 shares a band of unit weights with probability 1 - (1 - 0.8^4)^24
#: = 0.999997; counts add candidates.
BANDS, ROWS = 24, 4
GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text worked on at once.
BLOCK = 1 << 18

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def weighted_shingles(raw: np.ndarray, off: np.ndarray, a: int, b: int, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of rows a..b: (row, hash, count), sorted by row, then the rows' numbers of words and two keys
    of their word sequences. A text of fewer than k words, but one at least, is one shingle of what it has."""
    h, first, _ = word_hashes(raw, off, a, b, _WORD)
    cut = np.searchsorted(first, off[a : b + 1])
    words = np.diff(cut)
    row = np.repeat(np.arange(b - a), words)
    with np.errstate(over="ignore"):
        place = (np.arange(len(h)) - cut[row]).astype(np.uint64)
        one, two = mix(h + place * GOLD), mix(h ^ mix(place + np.uint64(7)))
        keys = np.zeros((2, b - a), np.uint64)
        full = np.flatnonzero(words)
        if len(full):
            keys[0, full], keys[1, full] = np.add.reduceat(one, cut[full]), np.add.reduceat(two, cut[full])
        s = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            s += mix(h[j : j + len(s)] + np.uint64(j + 1) * GOLD)
        same = row[: len(s)] == row[k - 1 :] if len(s) else np.zeros(0, bool)
        few = np.flatnonzero((words > 0) & (words < k))
        who = np.concatenate([row[: len(s)][same], few])
        what = mix(np.concatenate([s[same], keys[0, few]]))
    order = np.lexsort((what, who))
    who, what = who[order], what[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
    at = np.flatnonzero(new)
    return who[at], what[at], np.diff(np.append(at, len(who))), words, keys


def prob_minhash(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m registers: the shingle of the earliest arrival, over all rows' processes at once, arrival by arrival.

    Rows of one shingle need no race. A process stops when its next arrival is later than its row's latest register.
    """
    first = np.full((n, m), np.inf)
    who = np.zeros((n, m), np.uint64)
    flat_t, flat_s = first.reshape(-1), who.reshape(-1)
    count = np.bincount(row, minlength=n)
    single = count[row] == 1
    who[row[single]] = shingle[single][:, None]
    row, shingle, weight = row[~single], shingle[~single], weight[~single].astype(np.float64)
    time, state = np.zeros(len(row)), shingle.copy()
    rows = np.flatnonzero(count > 1)
    while len(row):
        with np.errstate(over="ignore"):
            state = state + GOLD
            draw = mix(state)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / weight
        slot = row * m + (mix(draw ^ GOLD) % np.uint64(m)).astype(np.int64)
        ahead = np.flatnonzero(time < flat_t[slot])
        ahead = ahead[np.argsort(-time[ahead], kind="stable")]  # of several for one slot the earliest is written last
        flat_t[slot[ahead]] = time[ahead]
        flat_s[slot[ahead]] = shingle[ahead]
        latest = np.full(n, -np.inf)
        latest[rows] = first[rows].max(axis=1)
        on = time < latest[row]
        row, shingle, weight, time, state = row[on], shingle[on], weight[on], time[on], state[on]
    return who


def _bands(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        part = mix(registers + (np.arange(registers.shape[1], dtype=np.uint64) + np.uint64(1)) * GOLD).reshape(-1, bands, rows)
        return mix(part.sum(axis=2, dtype=np.uint64))


def sketches(documents: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """id, node (16 bytes: the word sequence), n (distinct shingles), bands (array of long, empty without words), shingles.

    bands has those of unit weights and then, where a shingle repeats, those of counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = as_bytes(batch.column(1))
            for a, b in slices(off, BLOCK):
                who, what, count, words, keys = weighted_shingles(raw, off, a, b, k)
                found = _bands(prob_minhash(who, what, np.ones(len(what)), b - a, bands * rows), bands, rows).view(np.int64)
                again = np.bincount(who[count > 1], minlength=b - a) > 0  # rows with a shingle that repeats
                part = again[who]
                number = np.cumsum(again) - 1
                counted = prob_minhash(number[who[part]], what[part], count[part], int(again.sum()), bands * rows)
                every = np.zeros((b - a, 2 * bands), np.int64)
                every[:, :bands] = found
                every[again, bands:] = _bands(counted, bands, rows).view(np.int64)
                # sets are kept as 32-bit hashes, distinct and sorted
                pair = np.unique((who.astype(np.uint64) << np.uint64(32)) | (what >> np.uint64(32)))
                owner, short = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                size = np.bincount(owner, minlength=b - a)
                some = words > 0
                kept = np.where(again, 2 * bands, np.where(some, bands, 0))
                found = every[np.arange(2 * bands) < kept[:, None]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([x.tobytes() if w else None for x, w in zip(np.ascontiguousarray(keys.T), some, strict=True)], pa.binary()),
                        pa.array(size.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)), pa.array(found)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(short)),
                    ],
                    ["_id", "node", "n", "bands", "shingles"],
                )

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col).alias("_id"), F.lower(F.col(text_col)).alias("text")).mapInArrow(
        run, f"_id {kind}, node binary, n int, bands array<long>, shingles array<int>"
    )


def near_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, k: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each document: id, class_id (least id of its group), class_size (documents), class_texts, kept (id = class_id).

    Words are runs of letters and digits after lower-casing. Documents of one word sequence are one node; nodes link
    where the Jaccard similarity of their sets of k-word shingles is at least `similarity`, and a group is what is
    connected by links. Defined cases: a document without words (null and empty texts too) is a group of its own; a text
    of fewer than k words is one shingle; rows that repeat id and text are one document's group members; a null id is
    never a class id unless its whole group has none; an empty table gives no rows; other columns are not read.
    """
    sketch = materialize(sketches(documents, id_col, text_col, k, bands, rows), "near_sketches")
    worded = sketch.where("node is not null")
    # all rows of a node have the same bands; a band's hash tells its place
    texts = materialize(
        worded.groupBy("node").agg(F.min("_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")), "near_nodes"
    )
    members = texts.select("node", F.explode(F.array_distinct("bands")).alias("bucket")).select("bucket", "node")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """(node, payload: the shingles) of these nodes, and perhaps of some more."""
        rows_, _ = may_contain(worded.select("node", "shingles"), "node", nodes, "node")
        return materialize(rows_.groupBy("node").agg(F.first("shingles").alias("payload")), "near_sets")

    def match(x: Column, y: Column) -> Column:
        small, large = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
        common = F.when(small >= large * similarity, F.size(F.array_intersect(x, y))).otherwise(0)
        return common >= (small + large - common) * similarity

    def own(nodes: DataFrame) -> DataFrame:
        """Sizes of shingle sets, and how many of a node's shingles no other of these nodes has."""
        each = sets_of(nodes).join(nodes, "node", "left_semi").select("node", F.explode("payload").alias("shingle"))
        lone = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("node")).where("nodes = 1")
        u = lone.groupBy("node").agg(F.count(F.lit(1)).alias("u"))
        n = texts.join(nodes, "node", "left_semi").select("node", "n")
        return n.join(u, "node", "left").select("node", "n", F.coalesce("u", F.lit(0)).alias("u"))

    def possible(nx: Column, ux: Column, ny: Column, uy: Column) -> Column:
        """At most nx - ux shingles are common, and similarity s needs s / (1 + s) of nx + ny; one more allows for rounding."""
        return nx - ux + 1 >= (nx + ny) * (similarity / (1 + similarity))

    comps = link_buckets(members, Likeness(sets_of, match, own, possible, lambda n, u, least: possible(n, u, least, F.lit(0))))
    classes = texts.select("node", F.col("least_id").alias("class_id"), F.col("copies").alias("class_size"), F.lit(1).cast("long").alias("class_texts"))
    if comps is not None:
        tied = materialize(texts.select("node", "least_id", "copies").join(comps, "node"), "near_tied")
        whole = tied.groupBy("comp").agg(F.min("least_id").alias("c_id"), F.sum("copies").alias("c_size"), F.count(F.lit(1)).alias("c_texts"))
        found = tied.select("node", "comp").join(whole, "comp").select("node", "c_id", "c_size", "c_texts")
        classes = classes.join(found, "node", "left").select(
            "node", F.when(F.col("c_texts").isNull(), F.col("class_id")).otherwise(F.col("c_id")).alias("class_id"),
            F.coalesce("c_size", "class_size").alias("class_size"), F.coalesce("c_texts", "class_texts").alias("class_texts"),
        )
    classes = materialize(classes, "near_classes")
    release(texts, comps, tied if comps is not None else None)
    out = worded.select("_id", "node").join(classes, "node").select("_id", "class_id", "class_size", "class_texts")
    alone = sketch.where("node is null").select("_id", F.col("_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(1).cast("long").alias("class_texts"))
    return out.union(alone).select(F.col("_id").alias(id_col), "class_id", "class_size", "class_texts", F.col("_id").eqNullSafe(F.col("class_id")).alias("kept"))


def without_near_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents with one of each group: that with the least id, and of several texts of that id the one of the least hash.

    Rows that repeat both stay once; rows without id stay. Columns stay as they are, whatever their names.
    """
    own_id, own_text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    key = F.when(own_id.isNotNull(), F.struct(own_id.alias("id"), F.xxhash64(own_id, own_text).alias("hash")))
    keyed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), key.alias("key"))
    groups = near_groups(keyed.select("key", F.col("row").getField(text_col).alias("text")), "key", "text")
    keep = materialize(groups.where("kept and key is not null").select("key").distinct(), "near_keep")
    kept = keyed.where("key is not null").join(keep, "key", "left_semi").dropDuplicates(["key"]).select("row")
    return kept.union(keyed.where("key is null").select("row")).select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
