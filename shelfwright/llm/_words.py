"""Vectorised words: Arrow binary text -> 64-bit word hashes.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  A hash is the sum of
its bytes' values, each mixed with its place in the word, mixed once more: no
polynomial, whose differences structured words can cancel.  Equal words have
equal hashes on every machine; two different words share one with probability
2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from ._common import ship_by_value

ship_by_value(__name__)

BLOCK_BYTES = 2 * 1024 * 1024

_PLACE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240611).integers(1, 2 ** 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Words(NamedTuple):
    """Words of a block of texts: ``hashes``, byte places ``starts`` and
    ``ends`` in ``data``; text t has words ``of[t]:of[t + 1]`` and bytes
    ``at[t]:at[t + 1]``."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray
    data: np.ndarray
    at: np.ndarray


def blocks(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_BYTES each; a longer text stands alone."""
    at = offsets(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK_BYTES, "right")) - 1)
        yield lo, min(hi, len(column))
        lo = min(hi, len(column))


def offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32) if column.buffers()[1] else np.zeros(1, np.int32)
    return at[column.offset:column.offset + len(column) + 1].astype(np.int64)


def block_bytes(column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts lo..hi-1 and each one's place in them."""
    at = offsets(column)[lo:hi + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0]:at[-1]] if raw else np.zeros(0, np.uint8)
    return data, at - at[0]


def words(column: pa.Array, lo: int, hi: int, lower: bool = False) -> Words:
    data, at = block_bytes(column, lo, hi)
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(hi - lo + 1, np.int64), data, at)
    inside = ~_SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[at[:-1][at[:-1] < n]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    values = _BYTES[_LOWER] if lower else _BYTES
    size = ends - starts
    held = data[inside]
    begin = np.cumsum(size) - size  # of each word among the bytes of words
    place = (np.arange(len(held)) - np.repeat(begin, size)).astype(np.uint64)
    with np.errstate(over="ignore"):
        place *= _PLACE
        place += values[held]
        hashes = mix(np.add.reduceat(mix(place), begin)) if len(begin) else np.zeros(0, np.uint64)
    return Words(hashes, starts, ends, np.searchsorted(starts, at), data, at)
