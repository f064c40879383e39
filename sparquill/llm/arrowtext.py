"""Strings of Arrow batches as numpy bytes, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer single document makes a slice of its own.
SLICE = 1 << 20


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, n + 1 offsets into them); null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def slices(off: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes, or one row."""
    n, start = len(off) - 1, 0
    while start < n:
        end = int(np.searchsorted(off, off[start] + most, "right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def inside_table(outside: bytes) -> np.ndarray:
    """Of each byte whether it belongs to a run; bytes from 128 on always do."""
    table = np.ones(256, bool)
    table[list(outside)] = False
    return table


def lowered(raw: np.ndarray) -> np.ndarray:
    """A copy with A-Z in lower case."""
    out = raw.copy()
    out[(raw - np.uint8(65)) < 26] |= 32
    return out


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number (zeros beyond the end)."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def same_runs(raw: np.ndarray, first: np.ndarray, other: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of each run of raw whether its bytes are those of other from at on."""
    same = np.ones(len(first), bool)
    left, right = _eights(raw), _eights(other)
    rest = np.flatnonzero(length <= 64)
    for step in range(0, 64, 8):
        if not len(rest):
            break
        n = np.minimum(length[rest] - step, 8)
        mask = np.where(n > 0, np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.maximum(n, 1)) * 8).astype(np.uint64), np.uint64(0))
        same[rest] &= ((left[first[rest] + step] ^ right[at[rest] + step]) & mask) == 0
        rest = rest[length[rest] > step + 8]
    for i in np.flatnonzero(length > 64).tolist():
        a, b, n = int(first[i]), int(at[i]), int(length[i])
        same[i] = raw[a : a + n].tobytes() == other[b : b + n].tobytes()
    return same


_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 19
_TABLES: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _TABLES:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(_BLOCK + 1, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _TABLES[name] = np.multiply.accumulate(steps)
    return _TABLES["up"], _TABLES["down"]


def _end_of_run(raw: np.ndarray, at: int, stop: int, inside: np.ndarray) -> int:
    while at < stop:
        out = ~inside[raw[at : min(stop, at + _BLOCK)]]
        if out.any():
            return at + int(out.argmax())
        at = min(stop, at + _BLOCK)
    return stop


def _long_hash(raw: np.ndarray, start: int, end: int) -> np.uint64:
    """The hash that word_hashes() gives a run, block by block."""
    up, _ = _powers()
    total = 0
    for at in range(start, end, _BLOCK):
        part = raw[at : min(end, at + _BLOCK)].astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            total += int((part * up[: len(part)]).sum()) * pow(_BASE, at - start, 1 << 64)
    return mix(np.array([total % (1 << 64)], np.uint64))[0]


def word_hashes(raw: np.ndarray, off: np.ndarray, a: int, b: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes for which the table inside holds, in rows a..b: (64-bit hash, first byte, length) of each, in order.

    A run's hash is a polynomial over its bytes, taken from running sums, so all of a block's runs come at once; a row's
    end ends a run. Blocks are cut between runs; a run longer than a block is hashed on its own.
    """
    up, down = _powers()
    hashes, firsts, lengths = [], [], []
    start, stop = int(off[a]), int(off[b])
    edges = off[a : b + 1]
    while start < stop:
        end = min(stop, start + _BLOCK)
        if end < stop:
            tail = ~inside[raw[start:end]]
            back = int(tail[::-1].argmax())
            k = int(np.searchsorted(edges, end, "right")) - 1
            if tail[end - start - 1 - back]:
                end -= back
            elif edges[k] > start:
                end = int(edges[k])
            else:  # one run fills the block
                end = _end_of_run(raw, end, int(edges[k + 1]), inside)
                hashes.append(np.array([_long_hash(raw, start, end)]))
                firsts.append(np.array([start]))
                lengths.append(np.array([end - start]))
                start = end
                continue
        part = raw[start:end]
        word = np.zeros(len(part) + 2, bool)
        word[1:-1] = inside[part]
        begin, over = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
        k0, k1 = np.searchsorted(edges, [start, end])
        cut = edges[k0:k1] - start
        cut = cut[cut < len(part)]
        begin[cut] |= word[1:-1][cut]
        cut = cut[cut > 0] - 1
        over[cut] |= word[1:-1][cut]
        first, last = np.flatnonzero(begin), np.flatnonzero(over)
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)])])
            hashes.append(mix((total[last + 1] - total[first]) * down[first]))
        firsts.append(first + start)
        lengths.append(last + 1 - first)
        start = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lengths)
