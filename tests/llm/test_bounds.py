"""Memory by bytes of packed tokens and TIFF pages, corrupt media, and layout of pages against a plain version."""

from __future__ import annotations

import io
import tracemalloc
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")


class Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def shard_of(docs: list[np.ndarray], bits: int):
    from sparquill.llm import tokenpack as K

    out = io.BytesIO()
    w = K.ShardWriter(out, bits)
    for i, d in enumerate(docs):
        w.add(i, d)
    w.close()
    return K.Shard(Source(out.getvalue()))


@pytest.mark.parametrize("bits", [8, 13, 16, 17, 32])
def test_pieces_and_random_access(bits):
    from sparquill.llm import tokenpack as K

    rng = np.random.default_rng(bits)
    sizes = [0, 3, K.BLOCK - 3, 0, K.BLOCK, 1, 3 * K.BLOCK + 7, 0, 0, 5, 0]
    docs = [rng.integers(0, 1 << bits, n).astype(np.uint32) for n in sizes]
    shard = shard_of(docs, bits)
    got = list(shard.documents())
    assert [g[0] for g in got] == list(range(len(docs))) and all((g[2] == d).all() and len(g[2]) == len(d) for g, d in zip(got, docs, strict=True))
    for i, d in enumerate(docs):
        assert (shard.document(i)[2] == d).all() and len(shard.document(i)[2]) == len(d)
    assert max(len(p) for _, p in shard.pieces()) <= K.BLOCK
    assert (K.unpack(K.pack(docs[4], bits), K.BLOCK, bits) == docs[4]).all()


def test_whole_bytes_are_the_same_format():
    """Widths of whole bytes take a shorter way; its bits are those of the general form."""
    from sparquill.llm import tokenpack as K

    ids = np.random.default_rng(2).integers(0, 256, 1000).astype(np.uint32)
    for bits in K.WHOLE:
        wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
        assert K.pack(ids, bits) == np.packbits(wide[:, 32 - bits :].reshape(-1)).tobytes()


def test_memory_of_pieces_is_a_block():
    ids = np.arange(1_000_000, dtype=np.uint32) % 8000
    shard = shard_of([ids, *[ids[:20_000]] * 100], 13)
    tracemalloc.start()
    assert sum(len(p) for _, p in shard.pieces()) == 3_000_000
    assert tracemalloc.get_traced_memory()[1] < 4e6
    tracemalloc.stop()


def test_packing_other_columns_and_ids(spark):
    from sparquill.llm.tokenpack import read_packed, write_packed

    path = P.path("word_bpe_49k.json")
    rows = spark.createDataFrame([(2, "b b", 1, "x"), (1, None, 2, "y"), (2, "b b", 3, "z"), (None, "c", 4, "w")], "doc_id int, text string, start int, id string")
    got = read_packed(write_packed(rows, path)).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in got][:2] == [(None, 0), (1, 2)] and [r.n_tokens for r in got] == [2, 1, 3, 3] and len({r.ids_crc32 for r in got[2:]}) == 1
    with pytest.raises(TypeError):
        write_packed(rows.withColumn("doc_id", rows["id"]), path)


def test_corrupt_media_is_an_error():
    from sparquill.llm import tiff as T

    code = lambda *c: int("".join(f"{x:09b}" for x in c).ljust(-(-9 * len(c) // 8) * 8, "0"), 2).to_bytes(-(-9 * len(c) // 8), "big")
    assert T.lzw_unpack(code(256, 65, 258, 257), 3) == b"AAA"
    for bad in (code(256, 65, 259, 257), code(256, 258, 257), code(256, 65, 66, 300, 257)):
        with pytest.raises(ValueError):
            T.lzw_unpack(bad, 10)
    page = np.random.default_rng(1).integers(0, 9, (30, 40)).astype(np.uint8)
    data = bytearray(T.encode_pages([page, page], T.DEFLATE, False))
    found = data.index(zlib.compress(page.tobytes(), 1)[-4:])  # the checksum of the first page's strip
    data[found] ^= 1
    first, second = T.pages(bytes(data))
    assert first.pixels is None and first.error and (second.pixels[:, :, 0] == page).all()


def test_lzw_of_every_table_size():
    from sparquill.llm import tiff as T

    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 250, 255, 256, 257, 765, 766, 1790, 3836, 3837, 3838, 3839, 9000):
        for top in (2, 256):
            data = rng.integers(0, top, n).astype(np.uint8).tobytes()
            for step in (1, 7, 512):
                assert T.lzw_unpack(T.lzw_pack(data), n, step) == data


def test_tiff_groups_by_bytes(spark, monkeypatch):
    """Many pages in one value and many values in one batch come out in groups; nothing is lost, repeated ids stay."""
    from sparquill.llm import tiff as T

    pages = [np.full((20, 20), i, np.uint8) for i in range(9)]
    media = spark.createDataFrame([(1, bytearray(T.encode_pages(pages))), (1, bytearray(T.encode_pages(pages[:2]))), (2, bytearray(T.encode_pages(pages[3:4])))], "id int, media binary")
    monkeypatch.setattr(T, "GROUP_BYTES", 1000)
    rows = sorted((r.id, r.n_pages, r.page, bytes(r.pixels)) for r in T.read_tiff(media).collect())
    want = [(1, 2, i, bytes([i]) * 400) for i in range(2)] + [(1, 9, i, bytes([i]) * 400) for i in range(9)] + [(2, 1, 0, bytes([3]) * 400)]
    assert rows == sorted(want)
    small = T.read_tiff(media, most=399).collect()
    assert len(small) == 12 and all(r.pixels is None and "more than 399" in r.error for r in small)


def test_spread_in_parts():
    from sparquill.llm import tiff as T

    big = np.random.default_rng(6).integers(0, 256, 3_000_000).astype(np.uint8)
    tracemalloc.start()
    mean, deviation = T._spread(big)
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()
    assert (mean, deviation) == (round(float(big.mean()), 3), round(float(big.std()), 3)) and T._spread(None) == (None, None)


class Pages:
    """Random pages, each with its layout put together from the layouts of its parts: (html, top, lines, bottom), where top
    and bottom are the line ends that are due before and after."""

    def __init__(self, seed: int):
        import random

        self.rnd = random.Random(seed)

    def words(self) -> str:
        return " ".join(self.rnd.choice(["a", "bc", "d&amp;e", "fghij", "k" * 30, "l" * 70]) for _ in range(self.rnd.randint(1, 4)))

    def text(self):
        x = self.words()
        spaced = x.replace(" ", self.rnd.choice([" ", "\n ", "\t"]))
        return spaced, 0, [x.replace("&amp;", "&")], 0

    def joined(self, parts):
        """Parts one after another, with the larger of two neighbours' margins between them."""
        html, lines = "", []
        for i, (h, top, own, bottom) in enumerate(parts):
            html += h
            if i:
                lines += [""] * (max(parts[i - 1][3], top, 1) - 1)
            lines += own
        return html, parts[0][1], lines, parts[-1][3]

    def around(self, margin, html, part):
        return html, max(margin, part[1]), part[2], max(margin, part[3])

    def blocks(self, depth, inside):
        out = []
        for _ in range(self.rnd.randint(1, 3)):
            kind = self.rnd.choice(["p", "div", "list", "table", "hidden"]) if depth else "p"
            if kind == "p":
                part = self.text()
                out.append(self.around(2, f"<p>{part[0]}" + self.rnd.choice(["", "</p>"]), part))
            elif kind == "div":
                part = self.joined(self.blocks(depth - 1, inside))
                out.append(self.around(1, f"<div class='x>y'>{part[0]}</div>", part))
            elif kind == "list":
                out.append(self.listed(depth - 1, inside))
            elif kind == "table":
                out.append(self.table(depth - 1))
            else:
                h, top, lines, bottom = out.pop() if out else self.around(1, "<div>q</div>", ("", 0, ["q"], 0))
                out.append((h + self.rnd.choice(["<div hidden>no<p>no</div>", "<script>if (a<b) '</p>'</script>", "<p style='display:none'>no</p>"]), top, lines, bottom))
        return out

    def listed(self, depth, inside):
        tag, items, html = self.rnd.choice(["ul", "ol"]), [], ""
        for i in range(self.rnd.randint(1, 3)):
            parts = [self.text()] + (self.blocks(depth, True) if depth > 0 and self.rnd.random() < 0.5 else [])
            h, top, lines, bottom = self.joined(parts)
            mark = "- " if tag == "ul" else f"{i + 1}. "
            lines = [(mark if k == 0 else " " * len(mark)) + x if x else x for k, x in enumerate(lines)]
            html += f"<li>{h}" + self.rnd.choice(["", "</li>"])
            items.append(("", max(1, top), lines, max(1, bottom)))
        return self.around(1 if inside else 2, f"<{tag}>{html}</{tag}>", self.joined(items))

    def table(self, depth):
        html, grid, columns = "", [], self.rnd.randint(1, 3)
        for _ in range(self.rnd.randint(1, 4)):
            row = [self.joined(self.blocks(depth, False)) if depth > 0 and self.rnd.random() < 0.3 else self.text() for _ in range(columns)]
            html += "<tr>" + "".join(f"<td>{h}" + self.rnd.choice(["", "</td>"]) for h, _, _, _ in row) + self.rnd.choice(["", "</tr>"])
            grid.append([lines for _, _, lines, _ in row])
        if any(len(x) > 1 for row in grid for x in row):
            lines = [y for row in grid for x in row for y in x]
        else:
            wide = []
            for column in zip(*grid):
                sizes = [len(x[0]) for x in column]
                wide.append(max(w for w in sizes if sum(w - x for x in sizes if x <= w) <= 16 * sum(x + 1 for x in sizes)))
            lines = ["  ".join(x[0].ljust(w) for x, w in zip(row, wide)).rstrip() for row in grid]
        return f"<table>{html}</table>", 2, lines, 2


def test_layout_against_layouts_of_parts():
    from sparquill.llm.htmltext import render

    for seed in range(400):
        pages = Pages(seed)
        page = pages.joined(pages.blocks(4, False))
        assert render(page[0]) == "\n".join(page[2]), page[0]


def test_tags_behind_broken_ones():
    """What a page holds elsewhere does not change how a tag is read, and reading stays linear."""
    import re
    import time

    from sparquill.llm.htmltext import Tags, render

    good = '<a title="a>b">T</a>'
    assert render(good) == "T" and render("<i '>" * 71 + good).endswith("T") and '">T' not in render('<x "b>' * 70 + good)
    whole = re.compile(r"""<(/?)([a-zA-Z][^\s/>"']*)(?![^\s/>])((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
    import random

    rnd = random.Random(8)
    for _ in range(3000):
        page = "".join(rnd.choice(["<a ", "<b", " ", ">", '"', "'", "x=", "</c", "/"]) for _ in range(rnd.randint(1, 25)))
        tags = Tags(page)
        for lt in range(len(page)):
            if page[lt] == "<" and not re.match(r"<(/?)[a-zA-Z][^\s/>]*[\"']", page[lt:]):
                want, got = whole.match(page, lt), tags.at(lt)
                assert (want is None) == (got is None), (page, lt)
                assert got is None or (got[1], got[2], got[3]) == (want[2].lower(), want[3], want.end()), (page, lt)
    start = time.time()
    for page in ('<a "<b>' * 40_000 + "'", "<table>" * 30_000, "<table><tr><td>" * 20_000 + "y", "<table><tr><td>a<p>b" * 10_000, "<a x='>\"" * 40_000):
        render(page)
    assert time.time() - start < 60


def test_one_odd_cell_keeps_tables_linear():
    from sparquill.llm.htmltext import render

    page = "<table><tr><td>" + "w" * 200_000 + "<td>z" + "<tr><td>ab<td>c<tr><td>a<td>b" * 5000
    text = render(page)
    assert len(text) < 20 * len(page) and text.split("\n")[1:3] == ["ab  c", "a   b"]
    assert render("<table><tr><td>" + "w" * 60 + "<td>z<tr><td>abcdef<td>c") == "w" * 60 + "  z\n" + "abcdef".ljust(60) + "  c"
    spans = render("<table>" + "<tr><td colspan=1000>x<td>y" * 500 + "<tr>" + "<td>word" * 300)
    assert len(spans) < 100_000


def test_html_rows_that_repeat_and_clash(spark):
    from sparquill.llm.htmltext import extract

    rows = [(1, "<p>a" * 30_000, "x"), (1, "<p>a" * 30_000, "x"), (None, None, None)]
    got = extract(spark.createDataFrame(rows, "page_id long, html string, _html string")).collect()
    assert sorted((r.page_id or 0, len(r.text), r._html or "") for r in got) == [(0, 0, ""), (1, 89_998, "x"), (1, 89_998, "x")]
