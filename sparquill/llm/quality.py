"""Quality classifier from weak labels.

Ten overlapping heuristics, three of them about repetition, vote good, bad or abstain on each document. Votes are summed
to a count of each vote pattern over all documents (at most 3^10 rows), expectation-maximisation on these counts estimates how accurate each
heuristic is, and a pattern's posterior is a soft label. On a bounded sample these labels train a linear scorer over
hashed byte trigrams and a few statistics, which then scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.arrowtext import as_bytes, mix, slices, word_hashes

BUCKETS = 1 << 14
#: Documents (about) that the scorer is trained on, bytes (about) of their features, and steps of training.
SAMPLE, SAMPLE_BYTES, STEPS = 6_000, 1 << 26, 80
#: Bytes of a text's bucket and its share.
FEATURE = 6
BAD, GOOD, ABSTAIN = 0, 1, 2


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


_UPPER = _table(bytes(range(65, 91)))
_LETTER = _UPPER | _table(bytes(range(97, 123))) | _table(bytes(range(128, 256)))
_SPACE = _table(b" \t\n\r\f\v")
_SYMBOL = _table(b"#*%&$|~^=<>{}[]\\@+_/")
_STOP = _table(b".!?")
STATS = ("words", "mean_length", "symbols", "upper", "distinct_pairs", "short", "letters", "stops", "doubled", "variety")


def statistics(raw: np.ndarray, off: np.ndarray, a: int, b: int) -> np.ndarray:
    """A row for each text, a column for each of STATS (shares are of words, letters or characters; 0 for empty texts).

    doubled: share of words that equal the word before; variety: distinct words by the root of the number of words, which
    stays about level as texts grow.
    """
    edges = off[a : b + 1]
    part, at = raw[edges[0] : edges[-1]], edges - edges[0]

    def count(table: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(table[part])])
        return (c[at[1:]] - c[at[:-1]]).astype(np.float64)

    h, first, length = word_hashes(raw, off, a, b, ~_SPACE)
    cut = np.searchsorted(first, edges)
    words = np.diff(cut).astype(np.float64)
    one = np.maximum(words, 1)
    solid = count(~_SPACE)
    letters = count(_LETTER)
    doc = np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(cut))

    def different(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        key = np.unique((owner << np.uint64(44)) | (hashes >> np.uint64(20)))
        return np.bincount((key >> np.uint64(44)).astype(np.int64), minlength=b - a)

    distinct, doubled = np.ones(b - a), np.zeros(b - a)
    if len(h) > 1:
        both = doc[:-1] == doc[1:]
        with np.errstate(over="ignore"):
            pair = mix(h[:-1] + np.uint64(3) * h[1:])[both]
        distinct = np.where(words > 1, different(doc[:-1][both], pair) / np.maximum(words - 1, 1), 1.0)
        doubled = np.bincount(doc[1:][both & (h[:-1] == h[1:])].astype(np.int64), minlength=b - a) / np.maximum(words - 1, 1)
    # function words: short ones that begin with a letter
    short = np.bincount(doc[(length <= 3) & _LETTER[raw[first]]].astype(np.int64), minlength=b - a)
    return np.stack([words, solid / one, count(_SYMBOL) / one, count(_UPPER) / np.maximum(letters, 1), distinct, short / one, letters / np.maximum(solid, 1), count(_STOP) / one, doubled, different(doc, h) / np.sqrt(one)], 1)


def votes(s: np.ndarray) -> np.ndarray:
    """The heuristics' votes, a column for each. Fixed thresholds; between them a heuristic abstains."""
    words, length, symbols, upper, distinct, short, letters, stops, doubled, variety = s.T

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))

    return np.stack([
        vote(words < 5, words >= 30),
        vote((length < 2.5) | (length > 11), (length >= 3) & (length <= 9)),
        vote(symbols > 0.15, symbols < 0.04),
        vote(upper > 0.35, upper < 0.15),
        vote(distinct < 0.5, distinct > 0.75),
        vote((short < 0.03) & (words >= 20), short > 0.12),
        vote(letters < 0.75, letters > 0.85),
        vote(((stops < 0.004) & (words >= 30)) | (stops > 0.5), (stops >= 0.02) & (stops <= 0.3)),
        vote((doubled > 0.1) & (words >= 5), (doubled < 0.03) & (words >= 5)),
        vote((variety < 2) & (words >= 20), (variety > 4) & (words >= 20)),
    ], 1)


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: (posterior of good for each pattern, P(vote | class) by heuristic, 1 for none, prior of good).

    Starts from the share of good among the votes given. An abstention is a missing vote and says nothing of the class, so
    that texts too short for most heuristics are not bad for it; P(vote | class) is of votes given, each outcome smoothed
    by one document.
    """
    n = len(STATS)
    v = (patterns[:, None] // 3 ** np.arange(n)) % 3
    good, bad = (v == GOOD).sum(1), (v == BAD).sum(1)
    q = np.clip((good + 0.5) / (good + bad + 1.0), 0.02, 0.98)
    table, prior = np.ones((n, 2, 3)), 0.5
    for _ in range(rounds):
        prior = float((q * counts).sum() / max(counts.sum(), 1e-9))
        for k in range(n):
            for o in (BAD, GOOD):
                hit = v[:, k] == o
                table[k, 1, o] = (q * counts)[hit].sum() + 1
                table[k, 0, o] = ((1 - q) * counts)[hit].sum() + 1
            table[k, :, :ABSTAIN] /= table[k, :, :ABSTAIN].sum(1, keepdims=True)
        log = np.log(np.clip([1 - prior, prior], 1e-6, 1)) + sum(np.log(table[k][:, v[:, k]]).T for k in range(n))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(new - q).max(initial=0) < 1e-9:
            break
        q = new
    return q, table, prior


def _dense(s: np.ndarray) -> np.ndarray:
    out = s.copy()
    out[:, 0] = np.log1p(out[:, 0]) / 5
    out[:, 1] = np.minimum(out[:, 1], 20) / 10
    out[:, 9] = np.minimum(out[:, 9], 20) / 10
    return np.minimum(out, 3.0)


def _trigrams(raw: np.ndarray, off: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram of each byte of rows a..b, and offsets of rows; a row's first two reach over its start as 0."""
    edges = off[a : b + 1]
    at = edges - edges[0]
    part = raw[edges[0] : edges[-1]].astype(np.uint32)
    one, two = np.zeros_like(part), np.zeros_like(part)
    one[1:], two[2:] = part[:-1], part[:-2]
    for k, back in ((0, (one, two)), (1, (two,))):
        heads = at[:-1] + k
        for x in back:
            x[heads[heads < at[1:]]] = 0
    return ((part | one << 8 | two << 16) * np.uint32(2654435769)) >> np.uint32(32 - 14), at


@dataclass
class Scorer:
    weights: np.ndarray  # by bucket, of a trigram's share of the text
    dense: np.ndarray
    bias: float

    def score(self, raw: np.ndarray, off: np.ndarray, a: int, b: int, stats: np.ndarray) -> np.ndarray:
        h, at = _trigrams(raw, off, a, b)
        out = np.zeros(b - a)
        full = np.flatnonzero(np.diff(at) > 0)
        if len(full):
            out[full] = np.add.reduceat(self.weights[h].astype(np.float64), at[full]) / np.diff(at)[full]
        return 1 / (1 + np.exp(-np.clip(out + _dense(stats) @ self.dense + self.bias, -50, 50)))


def train(rows: list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]) -> Scorer:
    """Logistic regression by full-batch AdaGrad on (soft label, dense, buckets, shares); both classes weigh the same."""
    y = np.array([r[0] for r in rows])
    dense = np.array([r[1] for r in rows]).reshape(len(rows), len(STATS))
    index = np.concatenate([r[2] for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
    value = np.concatenate([r[3] for r in rows]) * 30 if rows else np.zeros(0)
    owner = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    w, d, c = np.zeros(BUCKETS), np.zeros(len(STATS)), 0.0
    if not rows:
        return Scorer(w, d, c)
    weight = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    weight /= weight.sum()
    gw, gd, gc = np.full(BUCKETS, 1e-8), np.full(len(STATS), 1e-8), 1e-8
    for _ in range(STEPS):
        z = np.bincount(owner, w[index] * value, minlength=len(rows)) + dense @ d + c
        # the two classes' weights carry the labels: a soft label counts in part for either
        g = ((1 / (1 + np.exp(-np.clip(z, -50, 50)))) - y) * weight
        for grad, x, acc in ((np.bincount(index, value * g[owner], minlength=BUCKETS) + 1e-5 * w, w, gw), (g @ dense + 1e-5 * d, d, gd)):
            acc += grad**2
            x -= 0.3 * grad / np.sqrt(acc)
        gc += g.sum() ** 2
        c -= 0.3 * g.sum() / np.sqrt(gc)
    return Scorer((w * 30).astype(np.float32), d, float(c))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = as_bytes(batch.column(0))
        found = [pattern(votes(statistics(raw, off, a, b))) for a, b in slices(off)]
        if found:
            p, place, n = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
            size = np.bincount(place, FEATURE * np.minimum(np.diff(off), BUCKETS))  # at most, of their features
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(size.astype(np.int64))], ["pattern", "n", "size"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = as_bytes(batch.column(0))
        for a, b in slices(off):
            s = statistics(raw, off, a, b)
            h, at = _trigrams(raw, off, a, b)
            rows = []
            for i in range(b - a):
                k, n = np.unique(h[at[i] : at[i + 1]], return_counts=True)
                rows.append((k.astype(np.uint16).tobytes(), (n / max(1, at[i + 1] - at[i])).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(pattern(votes(s)).astype(np.int32)), pa.array([x.tobytes() for x in _dense(s)]), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                ["pattern", "dense", "buckets", "shares"],
            )


def score_quality(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least: float = 0.5, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """id, score (0 to 1), weak_posterior, votes_good, votes_bad, keep (score >= least) of each document.

    All documents' votes enter the estimate. The scorer is trained on about `sample` documents, those whose text's hash
    is below the share that gives this number, or fewer, so that their features, which go to the driver, take about
    `sample_bytes` at most (a text's take 6 bytes for each of its bytes, and 98 KB at most). Defined cases: a null text counts as empty; an empty text has 0 words,
    which the length heuristic votes bad; equal texts get equal scores; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = documents.select(text.alias("text")).mapInArrow(_patterns, "pattern int, n long, size long").groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    seen = sorted((r["pattern"], r["n"], r["size"]) for r in counted.collect())  # at most 3^10 rows
    patterns, counts = np.array([p for p, _, _ in seen], np.int64), np.array([n for _, n, _ in seen], np.float64)
    posterior, _, _ = estimate(patterns, counts)
    soft = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))

    share = min(1.0, sample / max(1.0, counts.sum()), sample_bytes / max(1, sum(size for _, _, size in seen)))
    picked = documents.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < share * (1 << 40))
    # a text that makes up a large part of the corpus is trained on once
    got = picked.dropDuplicates(["text"]).mapInArrow(_features, "pattern int, dense binary, buckets binary, shares binary").collect()
    scorer = train([(soft.get(r["pattern"], 0.5), np.frombuffer(r["dense"]), np.frombuffer(r["buckets"], np.uint16), np.frombuffer(r["shares"], np.float32)) for r in got])
    shared = documents.sparkSession.sparkContext.broadcast((scorer, soft))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, labels = shared.value
        for batch in batches:
            raw, off = as_bytes(batch.column(1))
            out: list[list[np.ndarray]] = [[], [], [], []]
            for a, b in slices(off):
                s = statistics(raw, off, a, b)
                v = votes(s)
                found = (model.score(raw, off, a, b, s), np.array([labels.get(p, 0.5) for p in pattern(v).tolist()]), (v == GOOD).sum(1), (v == BAD).sum(1))
                for x, y in zip(out, found, strict=True):
                    x.append(y)
            if batch.num_rows:
                score_, weak, good, bad = (np.concatenate(x) for x in out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(score_), pa.array(weak), pa.array(good.astype(np.int32)), pa.array(bad.astype(np.int32)), pa.array(score_ >= least)],
                    ["_id", "score", "weak_posterior", "votes_good", "votes_bad", "keep"],
                )

    kind = documents.schema[id_col].dataType.simpleString()
    scored = documents.select(F.col(id_col).alias("_id"), text.alias("text")).mapInArrow(
        score, f"_id {kind}, score double, weak_posterior double, votes_good int, votes_bad int, keep boolean"
    )
    return scored.withColumnRenamed("_id", id_col)
