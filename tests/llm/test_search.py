"""Phrases, leaks and search against brute force, and their defined cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from sparquill.llm import leaks, phrases, search
from sparquill.llm.arrowtext import _BLOCK, as_bytes, inside_table, same_runs, word_hashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, n string, score string, item string, words string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def frame(spark, rows, parts=3):
    """rows (doc_id, text, lang), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], DOCS).repartition(parts)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


# ---------------------------------------------------------------- helpers of Arrow texts


def test_runs_longer_than_a_block():
    inside = inside_table(b" ")
    long = "ab" * _BLOCK
    for texts in ([f"x {long} y", long, f"{long}z", "q"], [long[:-1], f"{long} {long}"]):
        raw, off = as_bytes(pa.array(texts))
        h, first, length = word_hashes(raw, off, 0, len(texts), inside)
        want = [w for t in texts for w in t.split()]
        assert [raw[a : a + n].tobytes().decode() for a, n in zip(first, length, strict=True)] == want
        known = {}
        for word, x in zip(want, h.tolist(), strict=True):
            assert known.setdefault(word, x) == x
        assert len(set(known.values())) == len(known)


def test_same_runs():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 63, 64, 65, 200]))) for _ in range(300)]
    raw, off = as_bytes(pa.array(texts))
    first, length = off[:-1], np.diff(off)
    other = np.array([rng.randrange(300) for _ in range(300)])
    ok = length == length[other]
    got = same_runs(raw, first[ok], raw, first[other[ok]], length[ok])
    assert got.tolist() == [texts[i] == texts[j] for i, j in zip(np.flatnonzero(ok), other[ok], strict=True)]


# ---------------------------------------------------------------- leaks


def brute_leaks(docs, items, window=10):
    out = {}
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    for k, (doc_id, text, _) in enumerate(docs):
        w, hit, named = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    named |= grams[tuple(w[i : i + n])]
        out[k] = doc_id, len(w), len(hit), sorted(str(x) for x in named if x is not None)
    return sorted(out.values(), key=str)


def leak_case(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Straße", "été", "naïve", "数据"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 5, 9, 10, 11, 30, 60]) if i > 3 else 40)) for i in range(30)]
    items += [(7, items[2][1]), (None, items[3][1]), (90, None), (91, "?!"), (92, items[0][1] + " tail of its own")]
    docs = []
    for i in range(120):
        parts = [say(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            source = words(rng.choice(items)[1])
            at = rng.randrange(len(source)) if source else 0
            parts.append(rng.choice([", ", "\n", "-"]).join(x.capitalize() for x in source[at : at + rng.randrange(1, 40)]))
            parts.append(say(rng.randrange(0, 20)))
        docs.append((i, " ".join(parts), None))
    docs += [(200, None, None), (201, "", "en"), (3, docs[3][1], None), (3, docs[3][1], None), (None, items[1][1], "en"), (203, " ".join(["again"] * 5000) + items[0][1], None)]
    return docs, items


def found_leaks(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in df.withColumn("n_hit", leaks.n_hit(F.col("spans"))).collect()), key=str)


@pytest.mark.parametrize("slice_bytes", [1 << 25, 20_000])
def test_leaks_against_brute_force(spark, slice_bytes):
    docs, items = leak_case()
    found = leaks.find_leaks(frame(spark, docs), bench(spark, items), slice_bytes=slice_bytes)
    assert found_leaks(found) == brute_leaks(docs, items)


def test_leaks_of_windows_with_one_hash(spark, monkeypatch):
    """Hits are verified: with every window of a length under one hash, nothing changes."""
    monkeypatch.setattr(leaks, "rolled", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    rows = pa.table({"item": ["a", "b", "a"], "gram": ["x y", "z w", "z w"]})
    known = leaks.WindowSet(rows)
    column = pa.array(["q x y q", "w z w z", "x q y"])
    raw, off = as_bytes(column)
    n_words, spans, items = leaks._scan_slice(known, column, 0, 3, raw, off)
    assert n_words.to_pylist() == [4, 4, 3]
    assert items.to_pylist() == [["a"], ["a", "b"], []]
    assert [[(s["word_from"], s["word_to"]) for s in x] for x in spans.to_pylist()] == [[(1, 3)], [(1, 3)], []]


def test_leaks_removed(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "short item")]
    docs = [
        (1, "Before. One, two three four five six seven eight nine ten! After", "en"), (2, "clean text stays — as it is", "en"), (3, None, None), (4, "short ITEM", "en"),
        (5, "é short item é, one two three four five six seven eight nine ten eleven", "fr"), (6, "one two three four five six seven eight nine", "en"),
    ]
    for slice_bytes in (1 << 25, 300):
        cut = {r["doc_id"]: r for r in leaks.without_leaks(frame(spark, docs), bench(spark, items), slice_bytes=slice_bytes).collect()}
        assert {k: r["text"] for k, r in cut.items()} == {1: "Before. ! After", 2: docs[1][1], 3: None, 4: "", 5: "é  é, ", 6: docs[5][1]}
        assert cut[1]["words"] == "x" and list(cut[1].asDict()) == [x.split()[0] for x in DOCS.split(", ")]
        stay = leaks.without_leaks(frame(spark, docs), bench(spark, items), remove="documents", slice_bytes=slice_bytes)
        assert sorted(r["doc_id"] for r in stay.collect()) == [2, 3, 6]


def test_leaks_of_empty_tables(spark):
    docs, items = leak_case()
    assert leaks.find_leaks(frame(spark, []), bench(spark, items)).collect() == []
    for none in ([], [(1, None), (2, " ")]):
        assert found_leaks(leaks.find_leaks(frame(spark, docs[:5]), bench(spark, none))) == brute_leaks(docs[:5], [])


# ---------------------------------------------------------------- search


def brute_search(docs, items, top=20):
    counts = [(d, Counter(words(t))) for d, t, _ in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    big_n, big_l = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        rows = []
        for doc_id, c, n in counts:
            m = 75 + 25 * n * big_n // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, i + 1, r[3], -r[0]) for i, r in enumerate(sorted(rows)[:top])]
    return sorted(out, key=str)


def found_search(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize(("shard_docs", "block_terms"), [(1 << 15, 1 << 20), (5, 200)])
def test_search_against_brute_force(spark, monkeypatch, shard_docs, block_terms):
    docs, items = leak_case(8)
    items += [(80, "the the the never w1 w1"), (81, "neverseen")]
    docs += [(300 + i, docs[0][1], "en") for i in range(40)]  # ties beyond the top
    monkeypatch.setattr(search, "SHARD_DOCS", shard_docs)
    index, _ = search.build_index(frame(spark, docs, 2), ["w1", "数据"])
    assert index.agg(F.sum("n_docs"), F.sum("n_terms")).first() == (sum(bool(words(t)) for _, t, _ in docs), sum(len(words(t)) for _, t, _ in docs))
    found = search.search(frame(spark, docs, 2), bench(spark, items), block_terms=block_terms)
    assert found_search(found) == brute_search(docs, items)


def test_small_shards(spark):
    """Many shards in a task, with a bound that goes from one to the next, give the scores of one shard."""
    docs, items = leak_case(9)
    n_docs, n_terms = 126, 4000
    terms = sorted({w for _, t in items for w in words(t)})
    known = search.Vocabulary(terms)
    queries = [[(known.number[t], n * 700) for t, n in Counter(words(text)).items()] for _, text in items]
    answers = []
    for size in (1000, 7):
        batches = [pa.RecordBatch.from_arrays([pa.array([t for _, t, _ in docs[a : a + size]], pa.string()), pa.array([d for d, _, _ in docs[a : a + size]], pa.int64())], names=["text", "id"]) for a in range(0, len(docs), size)]
        shards = [s for b in batches for s in search._shard_rows(known, iter([b]), pa.int64())]
        best = {}
        for b in search._answers(iter(shards), queries, n_docs, n_terms, 20):
            for q, i, s, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                best.setdefault(q, []).append((-s, i is None, i or 0))
        answers.append({q: sorted(x)[:20] for q, x in best.items()})
    assert answers[0] == answers[1]


def test_max_score_probes_only_what_can_qualify():
    """A list of little weight is not added to the documents that only it holds."""
    rare, common = np.arange(30), np.arange(1000)
    lists = {0: (rare, np.full(30, 100), 100), 1: (common, np.full(1000, 1), 1)}
    acc = np.zeros(1000, np.int64)
    docs, score = search.max_score([(0, 5), (1, 1)], lists, acc, np.arange(1000)[::-1], 20, 0)
    assert docs.tolist() == list(range(29, 9, -1)) and set(score.tolist()) == {501} and not acc.any()
    docs, score = search.max_score([(1, 1)], lists, acc, np.arange(1000), 20, 2)
    assert not len(docs) and not acc.any()


def test_search_of_empty_tables(spark):
    docs, items = leak_case()
    assert search.search(frame(spark, []), bench(spark, items)).collect() == []
    assert search.search(frame(spark, [(1, None, None), (2, "?", None)]), bench(spark, items)).collect() == []
    assert search.search(frame(spark, docs), bench(spark, [(1, None)])).collect() == []
    assert search.search(frame(spark, docs), bench(spark, [])).collect() == []


# ---------------------------------------------------------------- phrases


def brute_phrases(docs, least, top, longest=5, percent=100):
    counts, total = {}, Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            if any(len(q) > len(p) and percent * a <= 100 * b and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items()):
                continue
            score, k = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0]) for i, x in enumerate(sorted(rows)[:top])]
    return sorted(out)


def phrase_case(seed=4):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(12)] + ["Ärger", "x" * 70, "non break", "数据"]
    fixed = [[rng.choice(vocab) for _ in range(n)] for n in (2, 3, 4, 5, 7, 5)]
    docs = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(0, 12)):
            parts += rng.choice(fixed) if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randrange(1, 4))]
            if rng.random() < 0.3:
                parts.append(rng.choice([".", ",", ";\n", "!", "\x0b"]))
        docs.append((i, rng.choice([" ", "  ", "\t"]).join(parts), ["en", "de", None, "und", ""][i % 5]))
    return docs + [(500, None, "en"), (501, "", None), (502, "again again again again " * 30, "en"), (3, docs[3][1], docs[3][2]), (None, docs[4][1], "en")]


@pytest.mark.parametrize(("least", "shard_words", "percent"), [(3, 2_000_000, 100), (6, 50, 100), (4, 300, 60)])
def test_phrases_against_brute_force(spark, least, shard_words, percent):
    docs = phrase_case()
    found = phrases.collocations(frame(spark, docs), top=60, least_count=least, subsumed_percent=percent, shard_words=shard_words)
    got = sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found.collect())
    assert got == brute_phrases(docs, least, 60, percent=percent)


def test_automaton_states():
    """States are sets of end places: their phrases, the suffixes of the longest, have just its count."""
    rng = random.Random(1)
    codes = np.array([0 if rng.random() < 0.1 else rng.randrange(1, 5) for _ in range(400)])
    starts = phrases._starts(codes, np.ones(6, bool), 5)
    seen = Counter()
    for k in range(2, 6):
        for i in range(len(codes) - k + 1):
            if 0 not in codes[i : i + k]:
                seen[tuple(codes[i : i + k].tolist())] += 1
    automaton = phrases.Automaton(codes, starts, 5)
    for low in (2, 3):
        got, tops = {}, 0
        for k, at, least, count in automaton.states(low):
            for i, m, n in zip(at.tolist(), least.tolist(), count.tolist(), strict=True):
                tops += 1
                for j in range(m, k + 1):
                    phrase = tuple(codes[i + k - j : i + k].tolist())
                    assert phrase not in got
                    got[phrase] = n
        assert got == {p: n for p, n in seen.items() if len(p) >= low}
        assert tops < len(got)  # some states have several phrases


def test_distinct_runs_that_share_a_hash():
    raw, off = as_bytes(pa.array(["b", "aa", "b", "cc", "aa", "b", "a"]))
    at, number = phrases.distinct_runs(raw, np.zeros(7, np.uint64), off[:-1], np.diff(off))
    names = [raw[off[i] : off[i + 1]].tobytes() for i in at]
    assert names[0] == b"b" and sorted(names) == [b"a", b"aa", b"b", b"cc"]
    assert [names[i] for i in number] == [b"b", b"aa", b"b", b"cc", b"aa", b"b", b"a"]


def test_a_long_text_is_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 50)
    raw, off = as_bytes(pa.array(["ab, " + "x" * 120 + " y. A B" * 30, "q", "no end " * 40]))
    parts = list(phrases._parts(raw, off))
    assert b"".join(p.tobytes() for p, _ in parts) == raw.tobytes().lower()
    assert all(p[-1] in phrases.PIECE_ENDS for p, e in parts[:1])


def test_phrases_of_empty_tables(spark):
    assert phrases.collocations(frame(spark, [])).collect() == []
    assert phrases.collocations(frame(spark, [(1, None, None), (2, " ,", "en"), (3, "one", "en")]), least_count=1).collect() == []
    assert [r["phrase"] for r in phrases.collocations(frame(spark, [(1, "a b", None)]), least_count=1).collect()] == ["a b"]
