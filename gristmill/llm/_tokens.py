"""Words of UTF-8 text in numpy, straight from Arrow buffers: no Python object per word or document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20  # bytes of text worked on at once
_STRIDE = 1 << 16  # bytes whose hashes' temporaries fit a core's cache

_SPACES = [0x20, *range(0x09, 0x0E)]
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[_SPACES] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What is left of a word for fuzzy comparison: letters in lower case, digits, and all bytes beyond ASCII.
IS_KEPT = np.zeros(256, dtype=bool)
IS_KEPT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DROPPED = np.flatnonzero(~(IS_KEPT | IS_SPACE)).astype(np.uint8).tobytes()

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))[LOWER]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _UNPOWER = _powers(_MULTIPLIER, PIECE + 4096), _powers(_INVERSE, PIECE + 4096)


class Texts:
    """A run of documents: ``data`` holds their bytes, ``offsets`` where each begins, ``null`` which have no text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, null: np.ndarray, first: int):
        self.data, self.offsets, self.null, self.first = data, offsets, null, first

    def __len__(self) -> int:
        return len(self.offsets) - 1


def texts_of(column: pa.Array, most_bytes: int = PIECE) -> Iterator[Texts]:
    """Runs of whole documents of about ``most_bytes`` bytes, in order; a longer document is a run of its own."""
    if not len(column):
        return
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    null = np.asarray(column.is_null())
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1)
        yield Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], null[at:to], at)
        at = to


def squeeze(texts: Texts) -> Texts:
    """The texts without ASCII punctuation and control characters, for comparison that ignores them."""
    data, cuts = texts.data.tobytes(), texts.offsets.tolist()
    kept = [data[a:b].translate(None, _DROPPED) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(x) for x in kept], dtype=np.int64)))
    return Texts(np.frombuffer(b"".join(kept), np.uint8), offsets, texts.null, texts.first)


def words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, maximal runs without white space inside one document; and where each document's words begin."""
    n = len(texts.data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    inside = ~IS_SPACE[texts.data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[texts.offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, texts.offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same for upper and lower case of A-Z, from one running sum over the bytes."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _STRIDE, side="right")))
        size = int(ends[to - 1] - base)
        power, unpower = (_POWER, _UNPOWER) if size <= len(_POWER) else (_powers(_MULTIPLIER, size), _powers(_INVERSE, size))
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[data[base : ends[to - 1]]] * power[:size], out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((total[e] - total[s]) * unpower[s])
        at = to
    return out


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each word on; the last k - 1 positions have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(_MULTIPLIER) + hashes[j : n + j]
    return mix(out)


def whole_shingles(first_word: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """For each shingle position whether its k words belong to one document."""
    n = n_words - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    doc = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))
    return doc[:n] == doc[k - 1 :]
