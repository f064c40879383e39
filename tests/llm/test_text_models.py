"""Token packing, trie BPE, language identification, quality, HTML and TIFF, against the library, round trips and literals."""

from __future__ import annotations

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "a", "Ünïcode ß 中文 😀\x1c\xa0x", "x" * 30_000, "don't  stop\t\n now <|endoftext|> 123", "the " * 5000, "\0 \0a\n\0", "é İ Σσ"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def mixed_texts(n: int) -> list[str]:
    rnd = random.Random(5)
    parts = ["abc", "the ", " ing", "  ", "\n", "\r\n", "\t", "'s", "12", "é", "中", "<|endoftext|>", "\xa0", ".,", "\0"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_packing_round_trip():
    from sparquill.llm import tokenpack as K

    rng = np.random.default_rng(1)
    for bits in (1, 7, 13, 16, 17, 32):
        ids = rng.integers(0, 1 << bits, 1001).astype(np.uint32)
        assert (K.unpack(K.pack(ids, bits), len(ids), bits) == ids).all()
    out = io.BytesIO()
    w = K.ShardWriter(out, 16)
    docs = [rng.integers(0, 49408, n).astype(np.uint32) for n in (0, 1, 20_000, 5, 40_000)]
    for i, d in enumerate(docs):
        w.add(None if i == 0 else i, d)
    w.close()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getbuffer())

    shard = K.Shard(Source(out.getvalue()))
    got = list(shard.documents())
    assert [g[0] for g in got] == [None, 1, 2, 3, 4] and all((g[2] == d).all() for g, d in zip(got, docs, strict=True))
    whole = np.concatenate(docs)
    assert (shard.ids(16_380, 33_000) == whole[16_380:33_000]).all() and K.width(49408) == 16


def test_packed_tokens_are_the_librarys(spark):
    from tokenizers import Tokenizer

    from sparquill.llm.tokenpack import read_packed, write_packed

    texts = ODD + mixed_texts(200)
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = {r.doc_id: r for r in read_packed(write_packed(frame(spark, texts), P.path("word_bpe_49k.json"))).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), (i, t)
        start += len(ids)


def test_packed_tokens_of_nothing(spark):
    from sparquill.llm.tokenpack import read_packed, write_packed

    assert read_packed(write_packed(frame(spark, []), P.path("word_bpe_49k.json"))).count() == 0


def test_trie_bpe_is_the_librarys(spark):
    from tokenizers import Tokenizer

    from sparquill.llm.triebpe import TrieEncoder, encode_decode

    path = P.path("byte_bpe_50k.json")
    encoder = TrieEncoder.of(path)
    assert not encoder.odd  # every entry encodes to itself
    texts = ODD + mixed_texts(400)
    lib = Tokenizer.from_file(path)
    for r in encode_decode(frame(spark, texts), path).collect():
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert encode_decode(frame(spark, []), path).count() == 0


def brute_ppm(train: dict[str, list[bytes]], text: bytes) -> dict[str, float]:
    """Code lengths by counting every context of every length anew."""
    out = {}
    for lang, docs in train.items():
        counts: dict[bytes, dict[int, int]] = {}
        for d in docs:
            padded = b"   " + d
            for i in range(3, len(padded)):
                for k in range(4):
                    c = counts.setdefault(padded[i - k : i], {})
                    c[padded[i]] = c.get(padded[i], 0) + 1
        bits, padded = 0.0, b"   " + text
        for i in range(3, len(padded)):
            for k in (3, 2, 1, 0):
                c = counts.get(padded[i - k : i])
                if not c:
                    continue
                total, distinct = sum(c.values()), len(c)
                if padded[i] in c:
                    bits -= np.log2(c[padded[i]] / (total + distinct))
                    break
                bits -= np.log2(distinct / (total + distinct))
            else:
                bits += 8
        out[lang] = bits
    return out


def test_language_code_lengths_are_exact(spark):
    from sparquill.llm import langid
    from sparquill.llm.arrowtext import as_bytes

    import pyarrow as pa

    train = {"a": ["the cat sat on the mat", "cats and hats"], "b": ["der hund und die katze", "und so weiter"]}
    df = spark.createDataFrame([(t, k) for k, ts in train.items() for t in ts], "text string, lang string")
    trees = langid.fit(df)
    texts = ["the hat", "und der", "zzz \xfc", ""]
    raw, off = as_bytes(pa.array(texts))
    got = trees.code_lengths(raw, off, 0, len(texts))
    for t, row in zip(texts, got, strict=True):
        want = brute_ppm({k: [x.encode() for x in ts] for k, ts in train.items()}, t.encode())
        assert row == pytest.approx([want["a"], want["b"]], abs=1e-3)


def test_language_cases(spark, tiny):
    from sparquill.llm import langid
    from sparquill.llm.queries import queries

    trees = langid.fit(spark.createDataFrame([("hello there", "en"), ("bonjour mes amis", "fr"), (None, "fr"), ("x", None)], "text string, lang string"))
    rows = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "123 !!", "q"), (4, "hello", "q"), (4, "hello", "q")], "doc_id long, text string, lang_pred string")
    got = langid.predict(rows, trees).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "en"] and got[0].score == 0 and 0 <= got[3].score <= 1
    assert langid.predict(rows.limit(0), trees).count() == 0
    none = langid.fit(rows.select("text", F.lit(None).cast("string").alias("lang")))
    assert {r.lang_pred for r in langid.predict(rows, none).collect()} == {"und"}
    assert langid.accepted(rows, trees).columns == rows.columns
    found = queries()["op4_language"](spark, tiny).join(spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count()


def test_quality(spark, tiny):
    from sparquill.llm import quality
    from sparquill.llm.queries import queries

    n = len(quality.STATS)  # one heuristic for each
    v = np.array([[1] * n, [0] * n, [1] * (n - 1) + [0]])
    q, table, prior = quality.estimate(quality.pattern(v), np.array([80.0, 15.0, 5.0]))
    assert q[0] > 0.9 and q[1] < 0.1 and 0.7 < prior < 0.95
    cases = quality.score_quality(frame(spark, ODD)).collect()
    assert len(cases) == len(ODD) and all(0 <= r.score <= 1 for r in cases)
    assert quality.score_quality(frame(spark, [])).count() == 0
    found = queries()["op3_quality"](spark, tiny).join(spark.read.parquet(f"{tiny}/labels.parquet"), "doc_id")
    good, bad = found.where("quality = 1"), found.where("quality = 0")
    assert good.where("keep").count() >= 0.95 * good.count() and bad.where("not keep").count() >= 0.9 * bad.count()


def test_html():
    from sparquill.llm.htmltext import render

    assert render("<ul><li>one<li>two<ol start=3><li>a</ol></ul>x") == "- one\n- two\n  3. a\n\nx"
    assert render("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3</table>") == "Name       Qty\napple pie  3"
    assert render("<style>.z{display:none}</style><p class='a z'>no<p style='visibility: hidden'>no<p hidden>no<p>A &amp; B<br>c") == "A & B\nc"
    assert render("<pre> k\n  l</pre>a < b<script>if (a<b) x()</script>") == " k\n  l\n\na < b"
    assert render(None) == render("") == "" and render("plain <b>bold") == "plain bold" and render("<!-- x") == ""
    assert render("<div>" * 3000 + "deep") == "deep" and render("<table><tr><td>" * 50 + "y") == "y"
    assert render("<a href='x>y'>t</a><p") == "t<p"  # a tag that never ends is text


def test_html_rows(spark):
    from sparquill.llm.htmltext import extract

    df = spark.createDataFrame([(1, "<p>a", "old"), (2, None, "old"), (2, "", None)], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text) for r in extract(df).collect()) == [(1, "a"), (2, ""), (2, "")]


def test_tiff_round_trips(spark):
    from sparquill.llm import tiff as T

    rng = np.random.default_rng(3)
    for n in range(12):
        page = rng.integers(0, 3 if n % 2 else 256, (int(rng.integers(1, 70)), int(rng.integers(1, 90)))).astype(np.uint8)
        for method in (T.NONE, T.LZW, T.DEFLATE, T.PACKBITS):
            for tile in (None, (16, 32)):
                got = list(T.pages(T.encode_pages([page, page.T.copy()], method, n % 3 == 0, 7, tile)))
                assert len(got) == 2 and (got[0].pixels[:, :, 0] == page).all() and (got[1].pixels[:, :, 0] == page.T).all()
    big = bytes(rng.integers(0, 256, 20_000).astype(np.uint8))
    assert T.lzw_unpack(T.lzw_pack(big), len(big)) == big and T.unpack_bits(T.pack_bits(b"a" * 1000 + big), 21_000) == b"a" * 1000 + big
    good = T.encode_pages([np.zeros((2, 2), np.uint8)])
    media = spark.createDataFrame([(1, good, "x"), (2, b"no", "x"), (3, None, "x"), (4, b"", "x"), (5, good[:20], "x")], "id int, media binary, width string")
    rows = {r.id: r for r in T.read_tiff(media).collect()}
    assert set(rows) == {1, 2, 5} and rows[1].pixels == b"\0" * 4 and rows[2].error == "not a TIFF" and rows[5].error


def test_tiff_of_texts(spark):
    from sparquill.llm import tiff as T

    texts = ODD + ["y" * (577 * 300)]
    for r in T.read_tiff(T.text_to_tiff(frame(spark, texts))).where("page = 0").collect():
        raw = (texts[r.doc_id] or "").encode()
        assert bytes(r.pixels) == raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw)) and r.n_bytes == len(raw)


def test_trie_of_long_words():
    """Words of unlike letters, without a space: as the library encodes them, in memory linear in the word."""
    import random
    import tracemalloc

    import public_tokenizers
    from tokenizers import Tokenizer

    from sparquill.llm.triebpe import TrieEncoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    rnd, encoder, library = random.Random(5), TrieEncoder.of(path), Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    make = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABC") for _ in range(n))
    for n in (10, 3000):
        word = make(n)
        assert np.frombuffer(encoder.encode([word])[0], "<u4").tolist() == library.encode(word, add_special_tokens=False).ids
    tracemalloc.start()
    code = encoder.encode([make(200_000)])[0]
    assert encoder.decode(np.frombuffer(code, "<u4")) and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_html_of_tags_without_end():
    import time

    from sparquill.llm.htmltext import render

    start = time.time()
    assert len(render("<a " * 100_000)) == 299_999 and render('<a "<b>" ' * 30_000 + "'") is not None
    assert time.time() - start < 60


def test_html_nothing(spark):
    from sparquill.llm.htmltext import extract

    assert extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_tiff_files_of_other_writers(spark):
    """Files put together by hand: big-endian, planes apart, several samples; and what must be an error row."""
    import struct

    from sparquill.llm import tiff as T

    def by_hand(order, tags, data):
        at = 8 + 2 + 12 * len(tags) + 4
        head = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 8) + struct.pack(f"{order}H", len(tags))
        for tag, values in sorted(tags.items()):
            field = struct.pack(f"{order}{len(values)}H", *(v + at if tag == T.STRIPS else v for v in values)).ljust(4, b"\0")
            assert len(field) == 4
            head += struct.pack(f"{order}HHI", tag, 3, len(values)) + field
        return head + b"\0\0\0\0" + data

    basic = {T.WIDTH: [3], T.LENGTH: [2], T.BITS: [8], T.COMPRESSION: [1], T.STRIPS: [0], T.STRIP_BYTES: [6]}
    for order in "<>":
        (page,) = T.pages(by_hand(order, basic, bytes(range(6))))
        assert page.pixels[:, :, 0].tolist() == [[0, 1, 2], [3, 4, 5]] and page.error is None
        planes = basic | {T.SAMPLES: [2], T.PLANAR: [2], T.STRIPS: [0, 6], T.STRIP_BYTES: [6, 6]}
        (page,) = T.pages(by_hand(order, planes, bytes(range(12))))
        assert page.pixels.tolist() == [[[0, 6], [1, 7], [2, 8]], [[3, 9], [4, 10], [5, 11]]]
        wide = basic | {T.BITS: [16], T.STRIP_BYTES: [12], T.PREDICTOR: [2]}
        (page,) = T.pages(by_hand(order, wide, struct.pack(f"{order}6H", 300, 1, 1, 5, 0, 65535)))
        assert page.pixels[:, :, 0].tolist() == [[300, 301, 302], [5, 5, 4]]
    for bad in ({T.PREDICTOR: [3]}, {T.BITS: [4]}, {T.WIDTH: [65535], T.LENGTH: [65535]}, {T.COMPRESSION: [7]}):
        (page,) = T.pages(by_hand("<", basic | bad, bytes(6)))
        assert page.pixels is None and page.error
    for short in (b"II*", b"MM\0*\0", b"II*\0\0"):
        assert [p.error for p in T.pages(short)] == ["not a TIFF"]
    # LZW of seven equal bytes, by hand: clear, 65, 258, 259, 65, end in nine bits each
    bits = "".join(f"{c:09b}" for c in (256, 65, 258, 259, 65, 257))
    assert T.lzw_unpack(int(bits.ljust(56, "0"), 2).to_bytes(7, "big"), 7) == b"A" * 7
    assert T.unpack_bits(b"\xfe\xaa\x02\x80\x00\x2a\xfd\xaa\x03\x80\x00\x2a\x22\xf7\xaa", 24).hex() == "aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10
    assert T.read_tiff(spark.createDataFrame([], "id int, media binary")).count() == 0 and T.text_to_tiff(frame(spark, [])).count() == 0
    forms = {(p.compression, p.tiled) for i in range(40) for p in T.pages(T.store(T.payload(f"text {i} " * (1 + 40 * i))))}
    assert forms == {("lzw", False), ("packbits", False), ("deflate", False), ("deflate", True)}
