"""Words of texts as arrays of hashes, without a Python object for each word.

A word is a longest run of bytes other than space and 0x09-0x0D (the pattern
``[^\\x20\\x09-\\x0D]+``; both sets are ASCII, so bytes and code points agree).
A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix
sums of a whole block, then mixed; two seeds give independent hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes hashed at a time; each hasher keeps two tables of eight times that in every worker.
BLOCK = 1 << 19
#: Places whose grams are hashed at a time, which bounds what lies between.
PLACES = 1 << 15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def odd(seed: int, n: int) -> np.ndarray:
    """n odd multipliers."""
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=_U) | _U(1)


class Hasher:
    """Hashes of words under one seed."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**64, 256, dtype=_U)
        self.table[SPACES] = 0
        self.base = int(rng.integers(0, 2**61)) * 8 + 3
        self.power = self.inverse = np.ones(0, _U)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n + n // 8, BLOCK + 1)
            for name, step in (("power", self.base), ("inverse", pow(self.base, -1, 2**64))):
                steps = np.full(n, step, _U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=_U))

    def __call__(self, block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(block))
        sums = np.empty(len(block) + 1, _U)
        sums[0] = 0
        np.cumsum(self.table[block] * self.power[: len(block)], dtype=_U, out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts])


SPACES = [0x20, *range(0x09, 0x0E)]
_IS_WORD = np.ones(256, np.int8)
_IS_WORD[SPACES] = 0


def blocks(texts: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK bytes together; a longer text has a range of its own."""
    first = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > BLOCK:
            yield first, i
            first, held = i, 0
        held += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def hashes(texts: Sequence[bytes], *hashers: Hasher) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets of each text's words in the arrays (one more than texts), and an array of hashes for each hasher."""
    counts, found = [np.zeros(1, np.int64)], [[] for _ in hashers]
    for a, b in blocks(texts):
        block = np.frombuffer(b"\n".join(texts[a:b]) + b"\n", np.uint8)
        edge = np.diff(_IS_WORD[block], prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        limits = np.cumsum([len(t) + 1 for t in texts[a:b]])
        counts.append(np.diff(np.searchsorted(starts, limits), prepend=0))
        for out, hasher in zip(found, hashers, strict=True):
            out.append(hasher(block, starts, ends))
    return np.cumsum(np.concatenate(counts)), [np.concatenate(x) if x else np.zeros(0, _U) for x in found]


def grams(words: np.ndarray, at: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Mixed hashes of the len(factors) consecutive words that begin at each place of ``at``."""
    out = np.zeros(len(at), _U)
    for a in range(0, len(at), PLACES):
        part, own = at[a : a + PLACES], out[a : a + PLACES]
        for j, factor in enumerate(factors):
            own += words[part + j] * factor
        own[:] = mix(own)
    return out


def starts_of(offsets: np.ndarray, length: int) -> np.ndarray:
    """Places where ``length`` consecutive words of one text begin, for all texts in order."""
    lengths = np.diff(offsets)
    room = np.maximum(lengths - length + 1, 0)
    ends = np.cumsum(room)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[:-1] - (ends - room), room)


def trim() -> None:
    """Give back to the system what a worker that is used again still holds free from the tasks before, and from now on arrays of 8 MB or more once they are free."""
    pa.default_memory_pool().release_unused()
    free, option = (getattr(ctypes.CDLL(None), name, None) for name in ("malloc_trim", "mallopt"))
    if option is not None:
        option(-3, 1 << 23)  # M_MMAP_THRESHOLD, which else grows to 32 MB
    if free is not None:
        free(0)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
