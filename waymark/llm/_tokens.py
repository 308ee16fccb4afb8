"""Tokens of whole Arrow text columns as flat numpy arrays.

A column is seen as one run of UTF-8 bytes. A table of 256 entries says which
bytes belong to a token and what each counts for, so lower-casing and splitting
take no loop over texts. A token's 64-bit hash is a polynomial over its bytes,
read off a prefix sum; sums run over slabs of a bounded number of bytes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = U(0xD6E8FEB86659FD93)
SLAB = 1 << 19

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


class Bytes(NamedTuple):
    """Which bytes belong to tokens, and the value of each in a hash."""

    inside: np.ndarray
    value: np.ndarray


class Tokens(NamedTuple):
    """hash, first byte and end of each token; first[i]:first[i+1] are the tokens of text i."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each token."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def byte_table(inside: np.ndarray, lower: bool = True) -> Bytes:
    value = np.arange(1, 257, dtype=U)
    if lower:
        value[65:91] += U(32)
    return Bytes(inside, value)


def _spaces() -> np.ndarray:
    inside = np.ones(256, bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    return inside


def _letters(digits: bool) -> np.ndarray:
    inside = np.zeros(256, bool)
    inside[65:91] = inside[97:123] = inside[128:] = True
    if digits:
        inside[48:58] = True
    return inside


#: Everything between white space; letters and digits; letters. Bytes of non-ASCII characters count as letters.
BY_SPACE, WORDS, LETTERS = byte_table(_spaces()), byte_table(_letters(True)), byte_table(_letters(False))


def powers(n: int) -> list[np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(max(n, SLAB + 1), base, U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """The hashes with all bits spread."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xCA5A826395121157)
    h ^= h >> U(29)
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls, and where each text begins."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slabs(column: pa.Array, most: int = 1 << 20):
    """Ranges of texts of about `most` bytes together, one text at least, so that what is made of them stays small."""
    size = np.cumsum(pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)) // most
    cuts = np.flatnonzero(np.diff(size, prepend=-1))
    yield from zip(cuts.tolist(), [*cuts[1:].tolist(), len(column)], strict=True)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The hash of each byte range; ranges are in order and don't overlap."""
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLAB, "right")))
        low = start[i]
        part = value[data[low : end[j - 1]]]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out[i:j] = (sums[end[i:j] - low] - sums[start[i:j] - low]) * down[start[i:j] - low]
        i = j
    return mixed(out)


def tokenize(column: pa.Array, table: Bytes) -> Tokens:
    data, offsets = flat(column)
    n = len(data)
    inside = table.inside[data]
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = offsets[:-1][offsets[:-1] < n]
        first[cut] = inside[cut]
        cut = offsets[1:][offsets[1:] > 0] - 1
        last[cut] = inside[cut]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return Tokens(hashes(data, start, end, table.value), start, end, np.searchsorted(start, offsets), data, offsets)


def window_hashes(h: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """For each position, a hash of the tokens at the given places after it; the last positions are left out."""
    n = len(h) - max(places)
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for p in places:
        out *= STEP
        out += h[p : p + n]
    return mixed(out)


def inside_text(first: np.ndarray, span: int) -> np.ndarray:
    """The positions from which span tokens lie in one text."""
    counts = np.maximum(np.diff(first) - span + 1, 0)
    total = int(counts.sum())
    begin = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return begin + np.arange(total)


def shingles(tokens: Tokens, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and where each text's begin.

    A text of fewer words has one shingle of all of them; one of none has none.
    """
    h, first = tokens.hash, tokens.first
    counts = np.diff(first)
    at = inside_text(first, words)
    owner = np.repeat(np.arange(len(counts)), np.maximum(counts - words + 1, 0))
    found = window_hashes(h, tuple(range(words)))[at] if len(at) else np.zeros(0, U)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        sums = np.zeros(len(short), U)
        for k in range(words - 1):
            has = counts[short] > k
            sums[has] = sums[has] * STEP + h[first[short[has]] + k]
        found = np.concatenate([found, mixed(sums + counts[short].astype(U))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    if len(found):
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        found, owner = found[new], owner[new]
    return found, np.searchsorted(owner, np.arange(len(counts) + 1))
