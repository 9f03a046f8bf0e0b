"""Vectorised word kernel over Arrow string columns.

A batch of texts is cut into byte-bounded blocks; in a block, words are found
and hashed with whole-array numpy steps, so the cost per word is some
nanoseconds and memory is bounded by the block, not by the batch.

A word is a maximal run of bytes other than ``0x20`` and ``0x09-0x0D``; ASCII
``A-Z`` is lower-cased for hashing. Word hashes are 64 bit: a random value per
byte, a polynomial over positions, and a final mix; they serve grouping inside
one block or set, where a chance collision has odds of about 2**-64 a pair.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = int(_rng.integers(2**62, 2**63)) * 2 + 1
_POW = _INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse mod 2**64."""
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, BLOCK_BYTES + 1)
        with np.errstate(over="ignore"):
            out = []
            for base in (_P, pow(_P, -1, 2**64)):
                step = np.full(size, base, np.uint64)
                step[0] = 1
                out.append(np.multiply.accumulate(step))
        if size > 2 * BLOCK_BYTES:  # a very long text: not kept
            return out[0], out[1]
        _POW, _INV = out
    return _POW, _INV


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


@dataclass
class Block:
    """Texts ``first .. first + n`` of a batch, and their words in order."""

    first: int
    n: int
    data: np.ndarray  # uint8, all texts of the block end to end
    text_at: np.ndarray  # n + 1 byte offsets
    starts: np.ndarray  # of words, in bytes
    ends: np.ndarray
    hashes: np.ndarray  # of words
    word_at: np.ndarray  # n + 1 offsets into words
    prefix: np.ndarray  # running polynomial, len(data) + 1
    inverse: np.ndarray

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.word_at))

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte spans (equal bytes, but for ASCII case: equal hash)."""
        with np.errstate(over="ignore"):
            return mix((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts])

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def text(self, i: int) -> bytes:
        return self.data[self.text_at[i] : self.text_at[i + 1]].tobytes()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column, nulls as empty texts."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def make_block(data: np.ndarray, at: np.ndarray, first: int = 0) -> Block:
    n, at = len(at) - 1, np.asarray(at, np.int64)
    size = len(data)
    power, inverse = _powers(size + 1)
    space = _SPACE[data]
    edge = np.zeros(size + 1, bool)  # no word goes over the edge of a text
    edge[at] = True
    solid = ~space
    before = np.ones(size, bool)
    after = np.ones(size, bool)
    if size:
        before[1:] = space[:-1]
        after[:-1] = space[1:]
        before |= edge[:-1]
        after |= edge[1:]
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    prefix = np.zeros(size + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * power[:size], out=prefix[1:])
        hashes = mix((prefix[ends] - prefix[starts]) * inverse[starts])
    return Block(first, n, data, at, starts, ends, hashes, np.searchsorted(starts, at), prefix, inverse)


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of at most ``block_bytes`` (or one longer text each), in order."""
    data, at = text_buffers(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + block_bytes, "right")) - 1)
        yield make_block(data[at[i] : at[j]], at[i : j + 1] - at[i], i)
        i = j


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0] .. +lengths[0], starts[1] .. +lengths[1], and so on."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total)
