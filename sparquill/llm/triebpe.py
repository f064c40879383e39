"""Byte-level BPE by prefix-sharing traversal of a trie of distinct words.

The encoding of a prefix is the encoding of a shorter prefix plus one last token, and that last token is the only
vocabulary entry that both ends the prefix and is compatible with the last token before it (two tokens are compatible
if merging their joined bytes gives these two tokens back). So one state for each trie node, its last token, is enough,
and a depth-first walk gives the encoding of every word; a prefix that many words share is encoded once. Sorting the
words lays out the trie: the walk keeps the states of the current path and goes back to the common prefix.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.llm.wordpieces import MARK, between_marks

#: Fixed value: the word pattern of byte-level BPE, with white space as Unicode's property has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: The same for pieces that each end with a zero byte, which is a word of its own and as good as the end of the text.
CUT = regex.compile(
    rf"\x00|'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}\x00]+|[{SPACE}]+(?![^{SPACE}\x00])|[{SPACE}]+"
)
#: A text in which every white space but the line end is one space between other characters needs no look beyond a space.
CLOSE = re.compile(rf"[{SPACE}](?<![ \n])")
TOUCHING = ("  ", " \n", "\n ")
MOST_PIECES, MOST_WORDS = 300_000, 500_000
SLICE_CHARS = 1 << 19


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte: itself where Latin-1 prints it, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    out.update((chr(256 + i), b) for i, b in enumerate(rest))
    return out


class TrieEncoder:
    _made: dict[str, TrieEncoder] = {}

    @classmethod
    def of(cls, path: str) -> TrieEncoder:
        """One for each file and Python worker."""
        if path not in cls._made:
            with open(path, encoding="utf-8") as f:
                cls._made[path] = cls(json.load(f))
        return cls._made[path]

    def __init__(self, spec: dict):
        stand = byte_alphabet()
        to_bytes = lambda token: bytes(stand[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.token = {to_bytes(t): i for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in self.token.items():
            self.bytes_of[i] = t
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.id_bytes = [np.uint32(i).astype("<u4").tobytes() for i in range(size)]
        # rank: the order of merges; single bytes come before all. parts: what a token was merged from
        self.rank = [-1] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.merged: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b = vocab[a], vocab[b]
            t = self.token[self.bytes_of[a] + self.bytes_of[b]]
            if self.parts[t] is None:
                self.parts[t], self.rank[t] = (a, b), r
            self.merged[a, b] = t
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fits: dict[int, bool] = {}
        self.odd = {t for t in self.token.values() if not self.whole(t)}
        self.fresh = {"\0": next(self.walk([b"\0"]))}
        self.words: dict[str, bytes] = dict(self.fresh)
        self.pieces: dict[str, bytes] = {}

    def forget(self) -> None:
        """Drop what was learnt from texts: the worker lives on, with the tasks of other stages."""
        self.words, self.pieces, self.fits = dict(self.fresh), {}, {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE on the joined bytes of two tokens ends in these two: no merge across the seam comes before the
        merges that made the tokens. Undone one at a time, latest first, what meets at the seam must not be a pair
        whose merge would have come earlier than the one just undone."""
        key = left * len(self.id_bytes) + right
        undone, ok = len(self.merged) + 1, True
        while True:
            across = self.merged.get((left, right))
            # at equal rank the leftmost pair merges first: a seam pair before a right-hand one, after a left-hand one
            if across is not None and self.rank[across] < undone:
                ok = False
                break
            a, b = self.parts[left], self.parts[right]
            if a is None and b is None:
                break
            if b is None or (a is not None and self.rank[left] > self.rank[right]):
                undone, left = self.rank[left], a[1]
            else:
                undone, right = self.rank[right] + 1, b[0]
        self.fits[key] = ok
        return ok

    def walk(self, words: list[bytes]) -> Iterator[bytes]:
        """Encodings of sorted distinct words, as little-endian unsigned 32-bit integers."""
        get, compatible, id_bytes, odd = self.token.get, self.compatible, self.id_bytes, self.odd
        known, size = self.fits.get, len(self.id_bytes)
        last, back, before = [-1], [0], b""  # of each prefix: its last token, and where that begins
        for word in words:
            n, depth, top = len(word), 0, min(len(word), len(before))
            while depth < top and word[depth] == before[depth]:
                depth += 1
            del last[depth + 1 :], back[depth + 1 :]
            for i in range(depth + 1, n + 1):
                for j in range(i - 1, -1, -1):  # exactly one entry fits; short ones are the likelier
                    t = get(word[j:i])
                    if t is None:
                        continue
                    if j:
                        left = last[j]
                        ok = known(left * size + t)
                        if ok is None:
                            ok = compatible(left, t)
                    else:
                        ok = t not in odd
                    if ok:
                        last.append(t)
                        back.append(j)
                        break
            before, code = word, []
            while n:
                code.append(id_bytes[last[n]])
                n = back[n]
            yield b"".join(reversed(code))

    def whole(self, t: int) -> bool:
        """Whether a token's own bytes encode to it."""
        parts = self.parts[t]
        return parts is None or (self.whole(parts[0]) and self.whole(parts[1]) and self._meets(*parts, self.rank[t]))

    def _meets(self, left: int, right: int, rank: int) -> bool:
        """Whether the seam stays free of earlier merges until the pair itself merges."""
        undone = rank
        while self.parts[left] is not None or self.parts[right] is not None:
            a, b = self.parts[left], self.parts[right]
            if b is None or (a is not None and self.rank[left] > self.rank[right]):
                undone, left = self.rank[left], a[1]
            else:
                undone, right = self.rank[right] + 1, b[0]
            across = self.merged.get((left, right))
            if across is not None and self.rank[across] < undone:
                return False
        return True

    def _learn(self, pieces: set[str]) -> None:
        """Piece: what follows a space, with the space."""
        plain = [p for p in pieces if "\0" not in p]
        cut = CUT.findall("\0".join([*plain, ""]))
        odd = [(p, WORDS.findall(p)) for p in pieces if "\0" in p]
        new = set(cut).union(*(ws for _, ws in odd)).difference(self.words)
        order = sorted((w.encode(), w) for w in new)
        self.words.update(zip((w for _, w in order), self.walk([b for b, _ in order]), strict=True))
        get = self.words.__getitem__
        own, self.words["\0"] = self.words["\0"], MARK
        self.pieces.update(zip(plain, between_marks(b"".join(map(get, cut))), strict=True))
        self.words["\0"] = own
        self.pieces.update((p, b"".join(map(get, ws))) for p, ws in odd)

    def _plain(self, text: str) -> list[str]:
        """A text without special tokens, cut at places that no word of the pattern crosses."""
        if any(x in text for x in TOUCHING) or CLOSE.search(text):
            return WORDS.findall(text)
        first, *rest = text.split(" ")
        return [first, *[f" {x}" for x in rest]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        parts = [self.split_special.split(x) if self.split_special else [x] for x in texts]
        cut = [[[p] if k % 2 else self._plain(p) for k, p in enumerate(ps)] for ps in parts]
        if len(self.words) > MOST_WORDS:
            self.words = dict(self.fresh)
        if len(self.pieces) > MOST_PIECES:
            self.pieces = {}
        if len(self.fits) > 3_000_000:
            self.fits = {}
        special = {t: self.id_bytes[i] for t, i in self.special.items()}
        new: set[str] = set()
        for ps in cut:
            for k, p in enumerate(ps):
                if k % 2 == 0:
                    new.update(p)
        self._learn(new.difference(self.pieces))
        get = self.pieces.__getitem__
        return [b"".join(special[p[0]] if k % 2 else b"".join(map(get, p)) for k, p in enumerate(ps)) for ps in cut]

    def decode(self, ids: np.ndarray) -> str:
        """Bytes of all ids, special tokens too, as UTF-8 with U+FFFD for what is not."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_decode(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of each whole text; with ids=True also the array of ids and the decoded text.

    Defined cases: null counts as empty (no ids); equal texts give equal values; other columns are not read. The state of
    a task is bounded: pieces and words that it remembers are forgotten beyond MOST_PIECES and MOST_WORDS, and at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TrieEncoder.of(tokenizer)
        try:
            for batch in batches:
                texts, at = [x or "" for x in batch.column(1).to_pylist()], 0
                while at < len(texts):
                    end, size = at, 0
                    while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE_CHARS):
                        size += len(texts[end])
                        end += 1
                    n, sha, back, arrays, decoded = [], [], [], [], []
                    for code in encoder.encode(texts[at:end]):
                        got = np.frombuffer(code, "<u4")
                        text = encoder.decode(got)
                        n.append(len(got))
                        sha.append(hashlib.sha256(code).hexdigest())
                        back.append(hashlib.sha256(text.encode()).hexdigest())
                        if ids:
                            arrays.append(got.astype(np.int32))
                            decoded.append(text)
                    columns = [batch.column(0).slice(at, end - at), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)]
                    columns += [pa.array(arrays, pa.list_(pa.int32())), pa.array(decoded)] if ids else []
                    yield pa.RecordBatch.from_arrays(columns, schema.names)
                    at = end
        finally:
            encoder.forget()

    schema = T.StructType(
        [T.StructField(id_col, documents.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
        + ([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())] if ids else [])
    )
    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
