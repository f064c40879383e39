"""The weak-label model against plain Python: statistics and votes, EM over documents, a likelihood that rises, bounds."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa


def texts() -> list[str | None]:
    rnd = random.Random(3)
    out: list[str | None] = [None, "", " ", "\n", "a", "a a", "Der " * 700, "one two " * 300, "x" * 30_000, "é É ß 中文 \x1c", "...!?", "#1 $2 %3"]
    words = "the of a an and London 42 $ ## ab. xyz! QUITE Longerwordshere é".split()
    for _ in range(300):
        few = rnd.sample(words, rnd.randint(1, len(words)))
        out.append("".join(rnd.choice(few) + rnd.choice([" ", "  ", "\n", ". "]) for _ in range(rnd.randint(0, 120))))
    return out


def plain(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[ \t\n\r\f\v]+", raw) if w]
    n = max(1, len(words))
    count = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    upper, high = count(range(65, 91)), sum(c >= 128 for c in raw)
    letters = upper + count(range(97, 123)) + high
    solid = len(raw) - count(b" \t\n\r\f\v")
    pairs = list(zip(words, words[1:]))
    is_letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    return [
        len(words), solid / n, count(b"#*%&$|~^=<>{}[]\\@+_/") / n, upper / max(1, letters), len(set(pairs)) / len(pairs) if pairs else 1.0,
        sum(len(w) <= 3 and is_letter(w[0]) for w in words) / n, letters / max(1, solid), count(b".!?") / n,
        sum(a == b for a, b in pairs) / max(1, len(pairs)), len(set(words)) / math.sqrt(n),
    ]


def given() -> tuple[np.ndarray, np.ndarray]:
    from sparquill.llm import quality as Q
    from sparquill.llm.arrowtext import as_bytes, slices

    raw, off = as_bytes(pa.array(texts(), pa.string()))
    s = np.concatenate([Q.statistics(raw, off, a, b) for a, b in slices(off, 5000)])
    return s, Q.votes(s)


def test_statistics_against_plain_ones():
    s, v = given()
    want = np.array([plain(t) for t in texts()])
    assert np.allclose(s, want, rtol=1e-12, atol=1e-12)
    assert v.shape == s.shape and set(np.unique(v)) == {0, 1, 2}


def by_documents(votes: list[list[int]], rounds: int) -> list[float]:
    """EM with a loop over documents: posterior of good for each."""
    n = len(votes[0])
    q = [min(0.98, max(0.02, (v.count(1) + 0.5) / (v.count(0) + v.count(1) + 1))) for v in votes]
    for _ in range(rounds):
        prior = sum(q) / len(q)
        table = [[[1.0, 1.0], [1.0, 1.0]] for _ in range(n)]
        for v, x in zip(votes, q):
            for k, o in enumerate(v):
                if o < 2:
                    table[k][1][o] += x
                    table[k][0][o] += 1 - x
        new = []
        for v in votes:
            log = [math.log(1 - prior), math.log(prior)]
            for k, o in enumerate(v):
                if o < 2:
                    for c in (0, 1):
                        log[c] += math.log(table[k][c][o] / sum(table[k][c]))
            new.append(1 / (1 + math.exp(min(50, max(-50, log[0] - log[1])))))
        q = new
    return q


def test_em_over_patterns_is_em_over_documents():
    from sparquill.llm import quality as Q

    _, v = given()
    patterns, place, counts = np.unique(Q.pattern(v), return_inverse=True, return_counts=True)
    assert len(patterns) < len(v)
    for rounds in (1, 2, 10):
        got, _, _ = Q.estimate(patterns, counts.astype(float), rounds)
        assert np.allclose(got[place], by_documents(v.tolist(), rounds), atol=1e-9)


def test_likelihood_rises():
    """The likelihood of all votes given, with the smoothing as its prior, never falls from round to round."""
    from sparquill.llm import quality as Q

    rng = np.random.default_rng(7)
    n = len(Q.STATS)
    truth, skill = rng.random(3000) < 0.7, rng.uniform(0.55, 0.95, n)
    v = np.where(rng.random((3000, n)) < skill, truth[:, None], ~truth[:, None]).astype(int)
    v[rng.random(v.shape) < 0.3] = Q.ABSTAIN
    for votes in (v, given()[1]):
        patterns, counts = np.unique(Q.pattern(votes), return_counts=True)
        o = (patterns[:, None] // 3 ** np.arange(n)) % 3
        seen = []
        for rounds in range(1, 25):
            q, table, prior = Q.estimate(patterns, counts.astype(float), rounds)
            each = np.array([np.log([1 - prior, prior])[c] + sum(np.log(table[k, c, o[:, k]]) for k in range(n)) for c in (0, 1)])
            seen.append(float((np.logaddexp(*each) * counts).sum() + np.log(table[:, :, :2]).sum()))
        assert all(b >= a - 1e-7 for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0]
    patterns, place, counts = np.unique(Q.pattern(v), return_inverse=True, return_counts=True)
    q, table, _ = Q.estimate(patterns, counts.astype(float))
    assert ((q[place] > 0.5) == truth).mean() > 0.95 and np.abs(table[:, 1, Q.GOOD] - skill).max() < 0.06


def test_sample_is_bounded_by_bytes(spark, monkeypatch):
    """Features that go to the driver stay near their bound; every document is scored all the same."""
    from sparquill.llm import quality as Q

    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice("abcdefghij") * rnd.randint(1, 9) for _ in range(rnd.choice([5, 50, 2000])))) for i in range(400)]
    docs = spark.createDataFrame([*rows, (400, None), (0, rows[0][1])], "doc_id long, text string").withColumn("score", docs_none()).withColumn("_id", docs_none())
    seen = []
    monkeypatch.setattr(Q, "train", lambda got, real=Q.train: seen.append(sum(len(r[2]) * Q.FEATURE for r in got)) or real(got))
    got = Q.score_quality(docs, sample=10_000, sample_bytes=200_000).collect()
    assert len(got) == 402 and seen[0] < 400_000
    assert len({r.score for r in got if r.doc_id == 0}) == 1 and all(0 <= r.score <= 1 for r in got)


def docs_none():
    from pyspark.sql import functions as F

    return F.lit(None).cast("string")
