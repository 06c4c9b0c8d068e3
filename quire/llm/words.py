"""Vectorised word and shingle hashing over Arrow string buffers.

A block is a run of whole texts whose UTF-8 bytes lie next to each other, as
Arrow stores them. Every step works on the bytes of a whole block with numpy,
so there is no Python call per word. Blocks are cut at text boundaries once
they reach ``BLOCK_BYTES``; memory is a small multiple of that, or of the
longest single text.

Hashes are 64-bit: a polynomial over random byte values, finished with an
avalanche step. Two different words meet with probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1_000_000

# Separator bytes of the word pattern [^\x20\x09-\x0D]+ ; every byte of a
# multi-byte character is a word byte.
SPACE_BREAKS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
# Separators of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (digits, a-z, non-ASCII stay).
ALNUM_BREAKS = np.isin(np.arange(256), [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche a uint64 array (splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        inverse = pow(_BASE, -1, 2**64)
        tables = []
        for b in (_BASE, inverse):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        have = (tables[0], tables[1])
        if size <= 4 * BLOCK_BYTES:
            _powers[0] = have
    return have


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[s:e]`` (uint64) for each pair of starts and ends."""
    up, down = _power_tables(len(values) + 1)
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.multiply(values, up[:len(values)], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Block:
    """Texts ``first .. first+len(bounds)-1`` of a batch and their words."""

    first: int
    n_texts: int
    data: np.ndarray          # bytes of the block
    offsets: np.ndarray       # n_texts + 1 byte offsets
    starts: np.ndarray        # first byte of each word
    ends: np.ndarray          # byte after each word
    bounds: np.ndarray        # n_texts + 1 word offsets

    def word_hashes(self) -> np.ndarray:
        return rolling(_BYTE_VALUES[self.data], self.starts, self.ends)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), np.diff(self.bounds))


def string_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive runs of whole texts; null
    counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + block_bytes, "right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


def word_blocks(column: pa.Array, breaks: np.ndarray = SPACE_BREAKS, lower: bool = False,
                block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Split every text of a string column into words, block by block."""
    for first, data, offsets in string_blocks(column, block_bytes):
        if lower:
            data = _LOWER[data]
        inside = ~breaks[data]
        edge = np.zeros(len(data) + 1, bool)      # a text begins here
        edge[offsets] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        bounds = np.searchsorted(starts, offsets)
        yield Block(first, len(offsets) - 1, data, offsets, starts, ends, bounds)


def windows(block: Block, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and hash of every run of ``k`` words inside one text."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = np.repeat(block.bounds[1:], np.diff(block.bounds))  # word after the text of each word
    at = np.flatnonzero(np.arange(n) + k <= last)
    return at, rolling(hashes, at, at + k)


def distinct_shingles(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles per text: (text number, hash), sorted by both.
    A text of fewer than ``k`` words, but not none, has its whole word
    sequence as its one shingle."""
    hashes = block.word_hashes()
    at, shingle = windows(block, hashes, k)
    text = block.text_of_word()[at] if len(at) else np.zeros(0, np.int64)
    size = np.diff(block.bounds)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        whole = rolling(hashes, block.bounds[:-1][short], block.bounds[1:][short])
        text, shingle = np.concatenate([text, short]), np.concatenate([shingle, whole])
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    if len(text):
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
        text, shingle = text[new], shingle[new]
    return text, shingle
