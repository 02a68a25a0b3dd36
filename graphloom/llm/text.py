"""Vectorised work on batches of texts as UTF-8 bytes: words, hashes, shingles.

A word is a run of bytes other than space and 0x09-0x0D, A-Z lower-cased; UTF-8 bytes of
other characters are all above 0x7F, so bytes and code points give the same words.
Hashes are 64-bit polynomials over bytes: with prefix sums any span's hash takes O(1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BLOCK_BYTES = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and doubled as longer texts come."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(BLOCK_BYTES + 2, 1 << (n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string or binary column (null: empty), and the n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = column.type in (pa.large_string(), pa.large_binary())
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return held, offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, or one longer text: bounds memory per step."""
    for batch in batches:
        if batch.num_rows:
            _, offsets = raw(batch.column(column))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
                yield batch.slice(at, to - at)
                at = to


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes wrap round to 26 or more."""
    return data + (((data - np.uint8(65)) < np.uint8(26)).view(np.uint8) << np.uint8(5))


def spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes are 0x20 or 0x09-0x0D."""
    return (data == np.uint8(32)) | ((data - np.uint8(9)) < np.uint8(5))


class Words:
    """The words of a block of texts: byte spans, the first word of each text, and 64-bit hashes."""

    def __init__(self, column: pa.Array, lower: bool = True, inside: np.ndarray | None = None):
        """inside: for each byte value, whether it belongs to words."""
        data, self.offsets = raw(column)
        self.data = lowered(data) if lower else data
        n = len(self.data)
        word = ~spaces(self.data) if inside is None else inside[self.data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        first[cuts] = word[cuts]
        last[cuts - 1] = word[cuts - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.starts, self.offsets)  # of each text's first word
        self.counts = np.diff(self.at)

    def hashes(self) -> np.ndarray:
        return spans(self.data, self.starts, self.ends)

    def text_of(self) -> np.ndarray:
        """For each word, the number of its text in the block."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial; entry i covers the first i bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    terms = out[1:]
    np.add(data, np.uint64(1), out=terms, dtype=np.uint64)
    terms *= powers(BASE, len(data))
    np.cumsum(terms, out=terms)
    return out


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end]; equal bytes give equal hashes wherever they stand."""
    sums = prefix(data)
    return mix((sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by position of its first word; runs may cross texts (see :func:`within`)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    return mix(out)


def within(words: Words, k: int) -> np.ndarray:
    """Whether the run of k words from each position stays in one text."""
    n = len(words.starts) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    of = words.text_of()
    return of[:n] == of[k - 1 : k - 1 + n]


def shingle_sets(words: Words, k: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingles; of fewer words the whole sequence; none without words."""
    hashes = words.hashes()
    runs, out = grams(hashes, k), []
    for at, n in zip(words.at[:-1].tolist(), words.counts.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(runs[at : at + n - k + 1]))
        elif n:
            out.append(grams(hashes[at : at + n], n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
