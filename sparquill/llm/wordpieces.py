"""Encoding with the tokenizers library, each distinct piece of text once.

The library does the encoding; this module only sees to it that a piece between white space goes there once in a while
instead of once per occurrence. That is exact for a tokenizer that splits at white space and never looks beyond it:
texts with anything for which this may not hold (special tokens' strings, unusual white space) go to it whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import regex

#: Pieces that are remembered at most, by a Python worker (some 250 MB); then the memory is emptied.
MOST_CHUNKS, MOST_WORDS = 600_000, 1_000_000
JOINED = 500
WHOLE = re.compile(r"<\||[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Beyond these, lower-casing and normalising may look at neighbours.
NOT_SIMPLE = re.compile(r"[^\x21-\u024f\n]")
#: Fixed value: the word pattern of the vocabulary file.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CUT = regex.compile(rf"{WORDS}|\n")
MARK = b"\xff\xff\xff\xff"


def between_marks(data: bytes) -> list[bytes]:
    """The parts of a run of 32-bit ids that MARK ends."""
    at = [0, *((np.flatnonzero(np.frombuffer(data, "<u4") == 0xFFFFFFFF) + 1) * 4).tolist()]
    return [data[a : b - 4] for a, b in zip(at[:-1], at[1:], strict=True)]


class ChunkEncoder:
    _made: dict[str, ChunkEncoder] = {}

    @classmethod
    def of(cls, path: str) -> ChunkEncoder:
        """One for each file and Python worker."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {"\n": MARK}

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        """Encode words that the tokenizer's own pattern would cut out, many joined by spaces at a time; each ends with
        one token that carries the end-of-word mark."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, ids in zip(groups, self._library([" ".join(g) for g in groups]), strict=True):
            found = np.array(ids, "<u4")
            cuts = np.flatnonzero(self.ends[found]) + 1
            if len(cuts) != len(group):  # a vocabulary without the mark
                parts = [np.array(x, "<u4").tobytes() for x in self._library(group)]
            else:
                data, at = found.tobytes(), [0, *(cuts * 4).tolist()]
                parts = [data[at[i] : at[i + 1]] for i in range(len(group))]
            self.words.update(zip(group, parts, strict=True))

    def _learn(self, chunks: list[str]) -> None:
        simple, joined = chunks, "\n".join(chunks)
        if NOT_SIMPLE.search(joined):
            simple = [c for c in chunks if not NOT_SIMPLE.search(c)]
            joined = "\n".join(simple)
        if simple:  # one pass over all chunks: line ends between them stay as marks
            cut = CUT.findall(f"{joined.lower()}\n")
            new = set(cut).difference(self.words)
            if new:
                self._learn_words(sorted(new))
            self.chunks.update(zip(simple, between_marks(b"".join(map(self.words.__getitem__, cut))), strict=True))
        if len(simple) == len(chunks):
            return
        rest = [c for c in chunks if c not in self.chunks]
        self.chunks.update((c, np.array(ids, "<u4").tobytes()) for c, ids in zip(rest, self._library(rest), strict=True))

    def encode(self, column: pa.Array, step: int = 200) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        out: list[bytes] = []
        for a in range(0, len(column), step):
            texts = [x or "" for x in column.slice(a, step).to_pylist()]
            odd = {i for i, x in enumerate(texts) if WHOLE.search(x)}
            split = [[] if i in odd else x.split() for i, x in enumerate(texts)]
            if len(self.words) > MOST_WORDS:
                self.words = {"\n": MARK}
            if len(self.chunks) > MOST_CHUNKS:
                self.chunks = {}
            new = set().union(*split).difference(self.chunks)
            if new:
                self._learn(list(new))
            get = self.chunks.__getitem__
            for i, pieces in enumerate(split):
                out.append(np.array(self._library([texts[i]])[0], "<u4").tobytes() if i in odd else b"".join(map(get, pieces)))
        return out
