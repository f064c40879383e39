"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of order 0 to 3 with the symbols seen after each. A symbol not seen in its
context escapes to the next shorter one (method C: distinct / (total + distinct)), down to a uniform byte. A text's
code length under a language is the exact sum of its symbols' costs under the frozen counts, and the language with the
shortest code wins. The costs of all languages sit in one table for each order, so a text is scored in one vectorised
walk over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.llm.arrowtext import as_bytes, slices

PAD = b"   "
UNDETERMINED = "und"
#: Documents of each language, and bytes of their text, that the trees are grown from at most (about).
DOCS_PER_LANGUAGE, BYTES_PER_LANGUAGE = 1500, 8 << 20
#: Bytes of text scored at once.
BLOCK = 1 << 17
#: Steps in which a share of documents is taken.
SHARES = 1 << 40


def _grams(raw: np.ndarray, off: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The four bytes that end at each byte of rows a..b, each row padded in front, and n + 1 offsets of the rows."""
    own = [raw[off[i] : off[i + 1]].tobytes() for i in range(a, b)]
    text = np.frombuffer(PAD + PAD.join(own), np.uint8).astype(np.uint32)
    g = (text[:-3] << 24) | (text[1:-2] << 16) | (text[2:-1] << 8) | text[3:]
    lens = np.diff(off[a : b + 1])
    starts = np.concatenate([[0], np.cumsum(lens + len(PAD))])[:-1]
    inside = np.ones(len(g), bool)
    for k in range(len(PAD)):  # where the pads themselves are coded
        at = starts[1:] - 1 - k
        inside[at[at >= 0]] = False
    return g[inside], np.concatenate([[0], np.cumsum(lens)])


class Lookup:
    """uint32 keys -> their index, or -1: one probe of a table, and a binary search for what collided there."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        slot = self._slot(keys)
        self.row = np.full(1 << self.bits, -1, np.int32)
        self.row[slot] = np.arange(len(keys), dtype=np.int32)
        self.key = np.zeros(1 << self.bits, np.uint32)
        self.key[slot] = keys
        lost = np.flatnonzero(self.row[slot] != np.arange(len(keys)))
        order = np.argsort(keys[lost])
        self.more_keys, self.more_rows = keys[lost][order], lost[order].astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435769)) >> np.uint32(32 - self.bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        row = self.row[slot]
        miss = np.flatnonzero(self.key[slot] != keys)
        row[miss] = -1
        if len(self.more_keys) and len(miss):
            want = keys[miss]
            at = np.minimum(np.searchsorted(self.more_keys, want), len(self.more_keys) - 1)
            row[miss] = np.where(self.more_keys[at] == want, self.more_rows[at], -1)
        return row


@dataclass
class ContextTrees:
    """Frozen costs in bits. paths4: cost by (4-byte path, language); paths3: cost and escape of order 3 by 3-byte path."""

    languages: list[str]
    paths4: Lookup
    cost4: np.ndarray
    paths3: Lookup
    cost3: np.ndarray
    escape3: np.ndarray
    cost2: np.ndarray
    escape2: np.ndarray

    def costs(self, g: np.ndarray) -> np.ndarray:
        """Bits of each path's last byte, a column for each language."""
        row = self.paths4(g)
        out = self.cost4[row]
        miss = np.flatnonzero(row < 0)
        if len(miss):
            m = g[miss]
            context, short = self.paths3(m >> np.uint32(8)), self.paths3(m & np.uint32(0xFFFFFF))
            lower = np.where(
                (short >= 0)[:, None], self.cost3[short],
                self.escape2[(m >> np.uint32(8)) & np.uint32(0xFFFF)] + self.cost2[m & np.uint32(0xFFFF)],
            )
            out[miss] = lower + np.where((context >= 0)[:, None], self.escape3[context], 0)
        return out

    def code_lengths(self, raw: np.ndarray, off: np.ndarray, a: int, b: int) -> np.ndarray:
        """Bits of rows a..b (one row for each text, a column for each language)."""
        g, at = _grams(raw, off, a, b)
        out = np.zeros((b - a, len(self.languages)))
        full = np.flatnonzero(np.diff(at) > 0)
        if len(full):
            out[full] = np.add.reduceat(self.costs(g).astype(np.float64), at[full], axis=0)
        return out


def grow(languages: list[str], paths: np.ndarray, language: np.ndarray, counts: np.ndarray) -> ContextTrees:
    """The trees from counts of 4-byte paths: shorter contexts have the sums of those they end."""
    n = len(languages)

    def level(order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct paths of order + 1 bytes, counts by language, and for each path's context: total, distinct symbols."""
        short = (paths & np.uint32((1 << 8 * (order + 1)) - 1)) if order < 3 else paths
        uniq, at = np.unique(short, return_inverse=True)
        c = np.zeros((len(uniq), n))
        np.add.at(c, (at, language), counts)
        context = uniq >> np.uint32(8)
        names, where = np.unique(context, return_inverse=True)
        total, distinct = np.zeros((len(names), n)), np.zeros((len(names), n))
        np.add.at(total, where, c)
        np.add.at(distinct, where, c > 0)
        return uniq, c, np.stack([total[where], distinct[where]]), np.concatenate([names[None].astype(np.float64).T, total, distinct], 1)

    def seen(c: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return -np.log2(c / (ctx[0] + ctx[1]))

    def escapes(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total, distinct = table[:, 1 : n + 1], table[:, n + 1 :]
        with np.errstate(divide="ignore", invalid="ignore"):
            return table[:, 0].astype(np.int64), np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)

    u0, c0, x0, t0 = level(0)
    esc0 = escapes(t0)[1][0] if len(t0) else np.zeros(n)
    cost0 = np.broadcast_to(esc0 + 8.0, (256, n)).copy()
    cost0[u0] = np.where(c0 > 0, seen(c0, x0), cost0[u0])

    u1, c1, x1, t1 = level(1)
    esc1 = np.zeros((256, n))
    at, e = escapes(t1)
    esc1[at] = e
    cost1 = (esc1[:, None, :] + cost0[None, :, :]).reshape(65536, n)
    cost1[u1] = np.where(c1 > 0, seen(c1, x1), cost1[u1])

    u2, c2, x2, t2 = level(2)
    esc2 = np.zeros((65536, n))
    at, e = escapes(t2)
    esc2[at] = e

    u3, c3, x3, t3 = level(3)
    at3, e3 = escapes(t3)
    names = np.union1d(u2, at3.astype(np.uint32))
    low = esc2[(names >> np.uint32(8)) & np.uint32(0xFFFF)] + cost1[names & np.uint32(0xFFFF)]
    cost2 = low.copy()
    where = np.searchsorted(names, u2)
    cost2[where] = np.where(c2 > 0, seen(c2, x2), low[where])
    esc3 = np.zeros((len(names), n))
    esc3[np.searchsorted(names, at3.astype(np.uint32))] = e3
    context, short = np.searchsorted(names, u3 >> np.uint32(8)), np.searchsorted(names, u3 & np.uint32(0xFFFFFF))
    cost3 = np.where(c3 > 0, seen(c3, x3), esc3[context] + cost2[short])
    f = np.float32
    return ContextTrees(
        languages, Lookup(u3), np.vstack([cost3, np.zeros((1, n))]).astype(f), Lookup(names), cost2.astype(f), esc3.astype(f),
        cost1.astype(f), esc2.astype(f),
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language index, text) -> (language index, path, count) of each slice."""
    for batch in batches:
        raw, off = as_bytes(batch.column(1))
        index = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in slices(off):
            g, at = _grams(raw, off, a, b)
            key = (np.repeat(index[a:b], np.diff(at)) << 32) | g.astype(np.int64)
            key, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, bytes_per_language: int = BYTES_PER_LANGUAGE) -> ContextTrees:
    """Grow the trees from about docs_per_language labelled documents of each language.

    The sample is bounded: a language's documents are taken whole where the hash of their text is below the share that gives
    this number, or less where that would be more than about bytes_per_language of text; so the paths are bounded too, and
    all of them are kept.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: (r["n"], r["b"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()}
    languages = sorted(sizes)
    if not languages:
        return grow([], np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0))
    index = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)]), F.col("lang"))
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, docs_per_language / sizes[k][0], bytes_per_language / max(1, sizes[k][1])))]), F.col("lang"))
    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(SHARES)) < share * SHARES)
    counted = picked.select(index.alias("i"), F.lower("text").alias("text")).mapInArrow(_count, "key long, n long")
    counted = counted.groupBy("key").agg(F.sum("n").alias("n"))
    frame = counted.toPandas()
    key = frame["key"].to_numpy(np.int64)
    return grow(languages, (key & 0xFFFFFFFF).astype(np.uint32), key >> 32, frame["n"].to_numpy(np.float64))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(rows: DataFrame, trees: ContextTrees, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "bits")) -> DataFrame:
    """All columns of rows but the text's copy, with the language, its posterior probability and the code length in bits.

    Defined cases: a text that is null or has no letter is 'und' with score 0 and no code length, and so is every text
    where no language was learnt; ties go to the first language in order. Columns of rows named like the new ones are
    replaced.
    """
    keep = [c for c in rows.columns if c not in names]
    fields = [f for f in rows.schema.fields if f.name in keep]
    inner = rows.select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)], F.lower(F.col(f"`{text}`")).alias("_text"),
        F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)).alias("_letter"),
    )
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    n_keep = len(keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            raw, off = as_bytes(batch.column(n_keep))
            bits = np.zeros((batch.num_rows, max(1, len(model.languages))))
            if model.languages:
                for a, b in slices(off, BLOCK):
                    bits[a:b] = model.code_lengths(raw, off, a, b)
            best = bits.argmin(axis=1)
            lead = bits.min(axis=1)
            with np.errstate(under="ignore"):
                posterior = 1.0 / np.exp2(np.maximum(lead[:, None] - bits, -1000)).sum(axis=1)
            known = batch.column(n_keep + 1).to_numpy(zero_copy_only=False).astype(bool) & bool(model.languages)
            lang = np.where(known, np.array(model.languages or [UNDETERMINED], object)[best], UNDETERMINED)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_keep], pa.array(lang, pa.string()), pa.array(np.where(known, posterior, 0.0)), pa.array(lead, mask=~known)],
                [*[f"_c{i}" for i in range(n_keep)], "_lang", "_score", "_bits"],
            )

    schema = T.StructType(
        [T.StructField(f"_c{i}", f.dataType) for i, f in enumerate(fields)]
        + [T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_bits", T.DoubleType())]
    )
    out = inner.mapInArrow(score, schema)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], *[F.col(x).alias(y) for x, y in zip(("_lang", "_score", "_bits"), names, strict=True)])


def accepted(documents: DataFrame, trees: ContextTrees, least: float = 0.5) -> DataFrame:
    """documents without those whose language is undetermined or has a posterior below least."""
    names = tuple(f"__ppm_{x}" for x in ("lang", "score", "bits"))
    found = predict(documents, trees, names=names)
    return found.where((F.col(names[0]) != UNDETERMINED) & (F.col(names[1]) >= least)).select(*[F.col(f"`{c}`") for c in documents.columns])
