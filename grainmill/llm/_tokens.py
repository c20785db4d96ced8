"""Words of many texts at once, as 64-bit hashes, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18  # bytes handled at once: what they need stays small, and in the processor's cache

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_KEPT = 1 << 19
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n - 1 of R and of its inverse modulo 2^64. Only tables of ``_KEPT`` are kept; longer ones go with the text that needs them."""

    def table(r: np.uint64, size: int) -> np.ndarray:
        x = np.full(size, r, np.uint64)
        x[:1] = 1
        return np.multiply.accumulate(x, out=x)

    if n > _KEPT:
        return table(_R, n), table(_R_INVERSE, n)
    if not _powers:
        _powers.extend([table(_R, _KEPT), table(_R_INVERSE, _KEPT)])
    return _powers[0], _powers[1]


def pieces(texts: pa.Array, most: int = PIECE) -> Iterator[tuple[int, list[bytes | None]]]:
    """The texts of a column in runs of up to ``most`` bytes (one text at least), each with the number of its first row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
        yield first, texts.slice(first, last - first).to_pylist()
        first = last


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_places(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, then of each word hash, text number, first byte, byte after the last, and each text's first byte).

    A word is a run of ASCII letters and digits and of bytes beyond ASCII; letters of ASCII and Latin-1 are compared in
    lower case. A null text has no words.
    """
    data = np.frombuffer(b" ".join([x or b"" for x in texts]) + b" ", np.uint8)
    ends = np.cumsum([len(x or b"") + 1 for x in texts])
    is_word = _WORD[data]
    start = np.flatnonzero(is_word & ~np.r_[False, is_word[:-1]])
    stop = np.flatnonzero(is_word & ~np.r_[is_word[1:], False]) + 1
    low = _LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1  # the capitals of Latin-1 follow this byte in UTF-8
    capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    low[capital] += 0x20
    up, down = _power(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return data, mixed((sums[stop] - sums[start]) * down[start]), np.searchsorted(ends, start, side="right"), start, stop, np.r_[0, ends[:-1]].astype(np.int64)


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each word of ``texts`` in order."""
    _, h, doc, *_ = word_places(texts)
    return h, doc
