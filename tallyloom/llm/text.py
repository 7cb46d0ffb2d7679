"""Words and their hashes, for whole Arrow batches of UTF-8 text at a time.

A batch is cut into slices of about a MB of text, so that memory follows the
slice, or the longest single text, and not the number of rows in a batch.
A word's 64-bit hash chains its bytes, eight at a time, through a mixing
function, and an n-gram's chains the hashes of its words; neither is linear in
what it takes in, so texts can't be made to collide by their form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20

_BYTE = np.arange(256)
#: Bytes of words that are runs of anything but ASCII white space.
SPACED = ~np.isin(_BYTE, [32, 9, 10, 11, 12, 13])
#: Bytes of words that are runs of ASCII letters, digits and non-ASCII characters.
ALNUM = (_BYTE >= 128) | ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122))
#: Words as ALNUM has them, and runs of other characters but ASCII white space as words of their own.
MIXED = np.where(ALNUM, 1, np.where(SPACED, 2, 0))
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
#: For bytes.translate: ASCII letters lower-cased, everything that no ALNUM word holds made a space.
ALNUM_LOWER = bytes(int(LOWER[b]) if ALNUM[b] else 32 for b in range(256))

def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes, in that order."""
    return mix(a * _STEP + b)


def fold(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k hashes that follow one another, from runs of 1, 2, 4, ... of them."""
    n, out, done, size = len(h) - k + 1, None, 0, 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    while True:
        if k & size:
            out = h[:n] if out is None else pair(out, h[done : done + n])
            done += size
        if done == k:
            return mix(out + np.uint64(k))
        h = pair(h[:-size], h[size:])
        size *= 2


#: Longer words are hashed one by one.
LONG_WORD = 4096
#: Masks of the low 0 to 8 bytes.
LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def eights(buf: np.ndarray) -> np.ndarray:
    """From every byte on, eight of them as a little-endian number; zeros follow the last."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from each start to its end."""
    from_here, size = eights(buf), end - start
    h = mix((from_here[start] & LOW[np.minimum(size, 8)]) + size.astype(np.uint64) * _STEP)
    more, step = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(more):
        left = size[more] - step
        h[more] = pair(h[more], from_here[start[more] + step] & LOW[np.minimum(left, 8)])
        more, step = more[left > 8], step + 8
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct column `row`, so that their names can't clash with an operator's."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row")


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null is an empty text."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = col.buffers()
    off = np.frombuffer(where, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, field: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that a slice holds about limit bytes of the column, or of a field of it, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column) if field is None else pc.struct_field(batch.column(column), field)
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each of the segments between offsets, the sum of flags."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


class Words:
    """The words of a slice of texts: where each begins and ends, its text and hash, and where each text's words begin.

    kind names the class of each byte; a word is a run of bytes of one class other than 0 (or False)."""

    def __init__(self, col: pa.Array, kind: np.ndarray = SPACED, lower: bool = False):
        buf, off = flat(col)
        self.buf, self.off, self.n_texts = buf, off, len(off) - 1
        of = kind[buf].astype(np.int8)
        n = len(buf)
        before, after = np.zeros(n, np.int8), np.zeros(n, np.int8)
        before[1:], after[:-1] = of[:-1], of[1:]
        before[off[:-1][off[:-1] < n]] = 0
        after[off[1:][off[1:] > 0] - 1] = 0
        self.start = np.flatnonzero((of != 0) & (of != before))
        self.end = np.flatnonzero((of != 0) & (of != after)) + 1
        self.text = np.searchsorted(off, self.start, "right") - 1
        self.count = np.bincount(self.text, minlength=self.n_texts).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.lower = lower

    @cached_property
    def hash(self) -> np.ndarray:
        return span_hashes(LOWER[self.buf] if self.lower else self.buf, self.start, self.end)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For every word the hash of the k words from it, and whether its text has that many left."""
        n = len(self.hash)
        out, ok = np.zeros(n, np.uint64), np.zeros(n, bool)
        if n >= k:
            out[: n - k + 1] = fold(self.hash, k)
            ok[: n - k + 1] = self.text[: n - k + 1] == self.text[k - 1 :]
        return out, ok


def winnow(h: np.ndarray, ok: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the windows of width valid hashes, and of the smallest hash (the leftmost of equals) of each."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # of runs of 1, 2, 4, ... hashes the smallest and its place; two runs that may overlap make a window
    best, size = np.arange(len(h)), 1
    while size < width:
        step = min(size, width - size)
        a, b = best[:-step], best[step:]
        best = np.where(h[b] < h[a], b, a)
        size += step
    wrong = np.zeros(len(h) + 1, np.int64)
    np.cumsum(~ok, out=wrong[1:])
    starts = np.flatnonzero(wrong[width:] == wrong[:n])
    return starts, best[starts]
