"""Words and their hashes as arrays, for whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once, about; a longer word makes a larger block.
BLOCK = 1 << 20
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Random value of each byte, A-Z as a-z, at each of the first 64 places of a word; later places mix in their number.
PLACES = 64
_VALUES = np.random.default_rng(20_240_229).integers(1, 1 << 63, (PLACES, 256), dtype=np.uint64)[:, LOWER].ravel()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, modulo 2**64, as far as they have been needed."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            ones = np.ones(n, dtype=np.uint64)
            self.up, self.down = ones.copy(), ones
            self.up[1:], self.down[1:] = np.uint64(_BASE), np.uint64(_INVERSE)
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)


_POWERS = _Powers()


def block_words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) and hashes of the words of a block; ``breaks``: where a text begins.

    A hash is the mixed sum of a random value for each byte and its place, so it tells words apart that agree in their
    bytes but for the order, however long and regular they are.
    """
    inside = ~WHITE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = breaks[(breaks > 0) & (breaks < len(data))]
    begins[cut] |= inside[cut]
    ends[cut - 1] |= inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return start, end, np.zeros(0, dtype=np.uint64)
    at = np.arange(len(data), dtype=np.int32)
    place = at - np.repeat(np.append(np.int32(0), start.astype(np.int32)), np.diff(start, prepend=0, append=len(data)))
    values = _VALUES[((place & (PLACES - 1)) << 8) | data]
    late = np.flatnonzero(place >= PLACES)
    if len(late):
        values[late] = mix(values[late] + (place[late] // PLACES).astype(np.uint64) * _MIX1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    return start, end, mix(sums[end] - sums[start] + (end - start).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts ``data[offsets[k]:offsets[k + 1]]``, and where each text's words begin.

    Words are runs of anything but ASCII white space; A-Z count as a-z. Works in blocks that end at white
    space or between texts, so memory beyond the result stays bounded.
    """
    base, total = int(offsets[0]), int(offsets[-1])
    hashes, starts, at = [], [], base
    while at < total:
        end = min(at + BLOCK, total)
        while end < total:  # to the next white space or text
            gap = np.flatnonzero(WHITE[data[end : end + BLOCK]])
            text = offsets[np.searchsorted(offsets, end)]
            stop = min(end + int(gap[0]) if len(gap) else min(end + BLOCK, total), int(text))
            done = len(gap) > 0 or stop == text
            end = stop
            if done:
                break
        low, high = np.searchsorted(offsets, [at, end])
        start, _, found = block_words(data[at:end], offsets[low:high] - at)
        hashes.append(found)
        starts.append(start + at)
        at = end
    every = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    place = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
    return every, np.searchsorted(place, offsets)


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    out = np.sort(values)
    return out[np.append(True, out[1:] != out[:-1])] if len(out) else out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow column of texts or binaries without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    where = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), where


def slices(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or of one longer text."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, min(high, n)
        low = high


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places have none."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:m].copy()
    for k in range(1, n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[k : k + m]
    return mix(out + np.uint64(n))
