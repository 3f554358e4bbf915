"""Array kernels on packed UTF-8 text. No Spark in here.

A batch of texts is one byte array and document offsets, as Arrow stores it.
Words are runs of bytes outside ``\\x20 \\x09-\\x0D``, with A-Z lower-cased.
Nulls are treated as empty texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes handled at once; one longer document is handled alone.
CHUNK_BYTES = 256 << 10
SHINGLE = 5


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser (Steele, Lea, Flood 2014), on a copy."""
    x = np.asarray(x, dtype=U) + U(0x9E3779B97F4A7C15)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Rolling:
    """Polynomial hashes modulo 2^64 of any spans of a chunk. They choose what meets and never decide that two spans are equal:
    for some families of strings (Thue-Morse words) such hashes agree whatever the base."""

    BASE = U(0x5851F42D4C957F2D)
    INVERSE = U(pow(0x5851F42D4C957F2D, -1, 1 << 64))
    CODE = mix(np.arange(256, dtype=U))

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > 4 * CHUNK_BYTES:  # of a single long text: not to be kept
            return _powers(n, self.BASE), _powers(n, self.INVERSE)
        if len(self.up) < n:
            self.up, self.down = _powers(n, self.BASE), _powers(n, self.INVERSE)
        return self.up[:n], self.down[:n]

    def prefix(self, data: np.ndarray) -> np.ndarray:
        up, self.shift = self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(self.CODE[data] * up[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self.shift[starts] + (ends - starts).astype(U))


def _powers(n: int, of: np.uint64) -> np.ndarray:
    out = np.full(n, of, dtype=U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _near(seed: int) -> np.ndarray:
    """Random values of (place modulo 64, byte), one table for each seed."""
    if seed not in _NEAR:
        _NEAR[seed] = mix(np.arange(64 << 8, dtype=U) + (U(seed) << U(32)))
    return _NEAR[seed]


_NEAR: dict[int, np.ndarray] = {}


def span_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *seeds: int):
    """64-bit names of ascending spans that don't overlap; one array for each seed, of seed 0 if none is given.

    A name sums a random value for each byte, by its place in the span: a table's
    value for the place modulo 64, times a random odd number for each 64 places.
    Two different spans share a name with a chance of about 2^-64 whatever their
    bytes; different seeds give independent names.
    """
    out = [np.zeros(len(starts), dtype=U) for _ in seeds or (0,)]
    # a slice of bytes at a time, so that a long text needs no more memory than a chunk
    for lo in range(0, len(data), CHUNK_BYTES):
        hi = min(len(data), lo + CHUNK_BYTES)
        a, b = int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(starts, hi, side="left"))
        if a >= b:
            continue
        # the first span may have begun before the slice; bytes of no span are counted from anywhere
        first, last = np.clip(starts[a:b], lo, hi) - lo, np.clip(ends[a:b], lo, hi) - lo
        before = first[0] + lo - starts[a]
        code = np.arange(hi - lo)
        code[first[0] :] -= np.repeat(first, np.diff(first, append=hi - lo))
        if before:
            code[first[0] : last[0]] += before
        code &= 63
        code <<= 8
        code |= data[lo:hi]
        # pieces: each span's places of like 64s, the first of them at place 0 or where the slice cuts in
        skipped = np.zeros(b - a, np.int64)
        skipped[0] = before
        low = skipped >> 6
        count = np.where(last > first, (skipped + last - first - 1 >> 6) - low + 1, 1)
        at = np.cumsum(count) - count
        step = np.arange(count.sum()) - np.repeat(at - low, count)
        begin = np.maximum(np.repeat(first - skipped, count) + (step << 6), np.repeat(first, count))
        end = np.minimum(np.repeat(first - skipped, count) + (step + 1 << 6), np.repeat(last, count))
        far = None
        if (top := int(step.max())) > 0:
            least = int(step.min())
            scale = mix(np.arange(least, top + 1, dtype=U)) | U(1)
            if least == 0:
                scale[0] = 1
            far = scale[step - least]
        total = np.zeros(hi - lo + 1, dtype=U)
        for names, seed in zip(out, seeds or (0,), strict=True):
            np.cumsum(np.take(_near(seed), code), out=total[1:])
            piece = total[end] - total[begin]
            if far is not None:
                piece *= far
            names[a:b] += np.add.reduceat(piece, at)
    size = (ends - starts).astype(U) * U(0x9E3779B97F4A7C15)
    out = [mix(x ^ size) for x in out]
    return out if len(out) > 1 else out[0]


def packed(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of about ``limit`` bytes."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


#: Bytes between words for models of wording: ASCII that is neither letter nor digit.
SYMBOL = np.ones(256, dtype=bool)
SYMBOL[48:58] = SYMBOL[65:91] = SYMBOL[97:123] = SYMBOL[128:] = False


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each document's first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~between[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Words:
    """Names of the words of a packed chunk."""

    def __init__(self, fold=LOWER, between=SPACE) -> None:
        self.fold, self.between = fold, between

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """(word names, first word of each document)."""
        data = self.fold[data]
        starts, ends, first = word_spans(data, offsets, self.between)
        return span_names(data, starts, ends), first


SLOT = mix(np.arange(1000, 1000 + SHINGLE, dtype=U)) | U(1)


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Of one document: a hash for each run of k words; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.full(n - k + 1, k * 0x1B873593, dtype=U)
    for j in range(k):
        out += words[j : n - k + 1 + j] * SLOT[j]
    return mix(out)


def shingle_sets(batch_column, words: Words | None = None, k: int = SHINGLE):
    """(row, sorted distinct shingle hashes) of every text."""
    words = words or Words()
    data, offsets = packed(batch_column)
    for a, b in chunks(offsets):
        hashes, first = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for row in range(a, b):
            yield row, np.unique(shingle_hashes(hashes[first[row - a] : first[row - a + 1]], k))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each document's values; first: the index of each document's first value, one more at the end."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
