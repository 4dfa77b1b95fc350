"""Words of Arrow string columns as 64-bit hashes, by numpy over the bytes of a whole batch.

A word is a maximal run of letters, marks and digits, in lower case. Equal words have equal hashes in every task and run.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64)
_SLICE = 1 << 20
_NOT_WORD = r"[^\x00-\x7f\p{L}\p{M}\p{N}]"
_WORD = np.zeros(256, bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _WORD[_c] = True
_WORD[128:] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Words(NamedTuple):
    hash: np.ndarray  # of each word
    start: np.ndarray  # byte offsets in the batch's UTF-8 data
    end: np.ndarray
    splits: np.ndarray  # document d has words splits[d]:splits[d + 1]
    offsets: np.ndarray  # and bytes offsets[d]:offsets[d + 1]
    data: np.ndarray  # the bytes, in lower case


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers from 0 to n, and their inverses, modulo 2**64."""
    size = 1 << max(10, int(n).bit_length())
    if size not in _powers:
        up, down = np.full(size + 1, _BASE), np.full(size + 1, _INVERSE)
        up[0] = down[0] = 1
        if size > 4 * _SLICE:
            return np.cumprod(up), np.cumprod(down)
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    parts = arr.buffers()
    offsets = np.frombuffer(parts[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(parts[2], np.uint8)[offsets[0] : offsets[-1]] if parts[2] is not None and len(parts[2]) else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def _same_length_lower(s: str) -> str:
    return "".join(low if len((low := c.lower()).encode()) == len(c.encode()) else c for c in s)


def lowered(arr: pa.Array) -> pa.Array:
    """Lower case in as many bytes as before, signs beyond ASCII blanked, so that byte offsets hold in the original."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    low = pc.utf8_lower(arr)
    odd = pc.not_equal(pc.binary_length(low), pc.binary_length(arr))
    if pc.any(odd).as_py():
        low = pc.replace_with_mask(low, odd, pa.array([_same_length_lower(s) for s in arr.filter(odd).to_pylist()], pa.large_string()))
    signs = pc.match_substring_regex(low, _NOT_WORD)
    if pc.any(signs).as_py():
        import regex

        blank = regex.compile(_NOT_WORD)
        low = pc.replace_with_mask(low, signs, pa.array([blank.sub(lambda m: " " * len(m[0].encode()), s) for s in low.filter(signs).to_pylist()], pa.large_string()))
    return low


def word_bounds(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = _WORD[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty_like(inside)
    first[0] = inside[0]
    np.greater(inside[1:], inside[:-1], out=first[1:])
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    last = np.empty_like(inside)
    last[-1] = inside[-1]
    np.greater(inside[:-1], inside[1:], out=last[:-1])
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start[i]:end[i]], for spans in order that don't overlap."""
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):  # slices end between spans, so that memory doesn't follow a long text's length
        j = max(i + 1, int(np.searchsorted(end, start[i] + _SLICE)))
        a, b = int(start[i]), int(end[j - 1])
        up, down = powers(b - a)
        sums = np.zeros(b - a + 1, U)
        part = _BYTE[data[a:b]]
        part *= up[: b - a]
        np.cumsum(part, out=sums[1:])
        out[i:j] = (sums[end[i:j] - a] - sums[start[i:j] - a]) * down[start[i:j] - a]
        i = j
    out *= U(2)
    out += (end - start).astype(U) & U(1)
    return mix(out)


def words_of(arr: pa.Array) -> Words:
    offsets, data = buffers(lowered(arr))
    start, end = word_bounds(offsets, data)
    return Words(span_hashes(data, start, end), start, end, np.searchsorted(start, offsets), offsets, data)


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that words_of gives these words."""
    w = words_of(pa.array(words, pa.large_string()))
    if len(w.hash) != len(words):
        raise ValueError("not single words")
    return w.hash


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of h[i:i + n] for every i."""
    if len(h) < n:
        return np.zeros(0, U)
    out = np.empty(len(h) - n + 1, U)
    for a in range(0, len(out), _SLICE):
        part = h[a : a + _SLICE + n - 1]
        up, down = powers(len(part))
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        m = len(part) - n + 1
        out[a : a + m] = (sums[n:] - sums[:-n]) * down[:m]
    return mix(out)


def document_of(splits: np.ndarray) -> np.ndarray:
    """Each word's document."""
    return np.repeat(np.arange(len(splits) - 1), np.diff(splits))
