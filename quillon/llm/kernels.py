"""Vectorised text kernels over Arrow batches.

Every separator and letter of the word classes used here is ASCII, so a word can be found on UTF-8 bytes: bytes from 0x80
up are either word bytes (both classes) and never need decoding. Work is cut into slices of bounded bytes, so memory per
task does not depend on how many rows a batch holds; one document is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of the class [^\x20\x09-\x0D]+.
BLANK = np.ones(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = False
#: Words of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F]+: ASCII digits, a-z, and all that is not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = int(_rng.integers(2**20, 2**62)) * 8 + 3
_BACK = pow(_STEP, -1, 2**64)
_MUL = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}
#: Bytes that are hashed at once, and powers that a process keeps of each base.
HASHED = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; HASHED of them are kept."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        out = np.empty(max(n, HASHED), dtype=np.uint64)
        out[0], done = 1, 1
        while done < len(out):
            more = min(done, len(out) - done)
            np.multiply(out[:more], np.uint64(pow(base, done, 2**64)), out=out[done : done + more])
            done += more
        got = out
        if n <= HASHED:
            _POWERS[base] = out
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch's rows in order, cut so that a slice has at most `most` bytes of text, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < len(lengths):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


class Texts:
    """The bytes of a string column and where each row starts; null is empty."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = column.buffers()
        offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.empty(0, np.uint8)
        self.bytes = _LOWER[raw] if lower else raw
        self.offsets = offs - offs[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1


class Words:
    """Where the words of each row start and end, and a 64-bit hash of each word."""

    def __init__(self, texts: Texts, kind: np.ndarray):
        n = len(texts.bytes)
        inside = kind[texts.bytes]
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
            cuts = texts.offsets[1:-1]
            cuts = cuts[cuts < n]
            before[cuts] = False
        first = inside & ~before
        self.starts = np.flatnonzero(first)
        # a word ends where the next byte is no word byte or belongs to the next row
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
            cuts = texts.offsets[1:-1]
            cuts = cuts[(cuts > 0) & (cuts <= n)]
            after[cuts - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.offsets = np.searchsorted(self.starts, texts.offsets)
        self.texts = texts

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def hashes(self) -> np.ndarray:
        """Words are hashed in stretches of HASHED bytes, so that no more powers than that are held; a longer word is a stretch of its own."""
        out, at = np.empty(len(self), np.uint64), 0
        while at < len(out):
            base = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.ends, base + HASHED, side="right")))
            starts, ends = self.starts[at:to] - base, self.ends[at:to] - base
            n = int(ends[-1])
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.texts.bytes[base : base + n]] * _powers(_STEP, n), out=total[1:])
            out[at:to] = (total[ends] - total[starts]) * _powers(_BACK, n)[starts]
            at = to
        return mix(out + (self.ends - self.starts).astype(np.uint64) * _MUL[63])


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each position on; rows are not regarded, so positions too near a row's end mean nothing."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n] * _MUL[0]
    for j in range(1, k):
        out += mix(hashes[j : n + j] + _MUL[j]) * _MUL[j]
    return mix(out)


def starts_of_grams(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which k words of one row start, and the row of each."""
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    firsts = np.cumsum(counts) - counts
    return np.arange(len(rows)) - firsts[rows] + offsets[:-1][rows], rows


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row, sorted by row and hash, with each one's row. A row of fewer words, but not none, has
    its whole sequence as its only shingle."""
    hashes = words.hashes()
    at, rows = starts_of_grams(words.offsets, k)
    values = grams(hashes, k)[at] if len(at) else np.empty(0, np.uint64)
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for m in range(1, k):
            which = counts[short] == m
            whole[which] = grams(hashes, m)[words.offsets[short[which]]] + np.uint64(m)
        values, rows = np.concatenate([values, whole]), np.concatenate([rows, short])
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    if len(values):
        keep = np.empty(len(values), dtype=bool)
        keep[0] = True
        keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        values, rows = values[keep], rows[keep]
    return values, rows
