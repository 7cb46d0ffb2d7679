"""Groups of spelling variants: words of a corpus, those one edit apart, and the form that each one most likely stands for.

Words are counted everywhere first. Two words one edit apart differ by at most
two in the sum of absolute differences of their letter counts, and so in the
squared distance of the counts. Of four parts of the alphabet at least two then
have the same counts, so words meet in blocks of equal counts in two parts. In
a block, NumPy products of letter-count matrices give all squared distances;
pairs at most two apart whose lengths are the same or adjacent are verified by
their letters. A block of many words is cut into tiles, and its tiles meet in
pairs, so a task holds two tiles and not the block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, text

#: Letters by how common they are, dealt to the parts of the alphabet back and forth. Fixed values.
COMMON = "etaoinsrhldcumfpgwybvkxjqz"
PARTS = 4
PAIRS = list(combinations(range(PARTS), 2))
#: Columns of a letter-count matrix: a to z, then U+00C0 to U+00FF.
LETTERS = 26 + 64
#: Words of a block that a tile holds.
TILE = 4096
#: Words whose letters are compared in matrices; longer ones are compared one by one.
WIDE = 64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: The first byte of U+00C0 to U+00FF in UTF-8, and of no other character.
_LATIN = 0xC3


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def runs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of letters of texts between offsets, and the number of code points of each."""
    lead = buf == _LATIN
    letter = _LETTER[buf] | lead
    letter[1:] |= lead[:-1]
    inner = np.ones(len(buf) + 1, bool)
    inner[off] = False
    start = np.flatnonzero(letter & ~(np.append(False, letter[:-1]) & inner[:-1]))
    end = np.flatnonzero(letter & ~(np.append(letter[1:], False) & inner[1:])) + 1
    leads = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead, out=leads[1:])
    return start, end, end - start - (leads[end] - leads[start])


def crcs(buf: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of what each `before` is the crc32 of, followed by the bytes from start to end; all runs take a byte at a time."""
    order = np.argsort(start - end, kind="stable")
    start, size, reg = start[order], (end - start)[order], ~before[order].astype(np.uint32)
    more = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
    for j, m in enumerate(more.tolist()):
        reg[:m] = _CRC[(reg[:m] ^ buf[start[:m] + j]) & np.uint32(255)] ^ (reg[:m] >> np.uint32(8))
    out = np.empty(len(reg), np.uint32)
    out[order] = ~reg
    return out


def _strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    off = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.repeat(start - off[:-1], size) + np.arange(off[-1])]
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])


def word_counts(docs: DataFrame, every: int, least_letters: int, id_col: str, text_col: str) -> DataFrame:
    """(word, n): lower-cased runs of letters, with the slips that follow from crc32, by how often they occur."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, "x"):
            buf, off = text.flat(part.column("x"))
            buf = text.LOWER[buf]
            start, end, letters = runs(buf, off)
            ids = np.array([zlib.crc32(b"%s:" % (i or "").encode()) for i in part.column("id").to_pylist()], np.uint32)
            crc = crcs(buf, start, end, ids[np.searchsorted(off, start, "right") - 1])
            slip = crc % every == 0
            slipped = []
            for a, b, h, n in zip(*(v[slip & (letters > least_letters)].tolist() for v in (start, end, crc, letters))):
                word = buf[a:b].tobytes().decode()
                slipped.append(word[: h % n] + word[h % n + 1 :])
            own = np.flatnonzero(~slip & (letters >= least_letters))
            _, first, n = np.unique(text.span_hashes(buf, start[own], end[own]), return_index=True, return_counts=True)
            words = _strings(buf, start[own][first], end[own][first])
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array(slipped, pa.string())]), pa.array(np.append(n, np.ones(len(slipped), np.int64)).astype(np.int64))], names=["word", "n"])

    found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("x")).mapInArrow(rows, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


class Letters:
    """Letter counts of words, code points of the short ones, and the hashes of the counts in each part of the alphabet."""

    def __init__(self, words: list[str]):
        self.words, self.size = words, np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        of = np.repeat(np.arange(len(words)), self.size)
        self.counts = np.bincount(of * LETTERS + np.where(points < 128, points - 97, points - 0xC0 + 26), minlength=len(words) * LETTERS).reshape(-1, LETTERS)
        self.points = np.zeros((len(words), min(WIDE, int(self.size.max(initial=0)))), np.uint32)
        place = np.arange(len(points)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        short = place < WIDE
        self.points[of[short], place[short]] = points[short]

    def parts(self) -> np.ndarray:
        """For each word and part of the alphabet a hash of the part's counts."""
        return np.stack([(self.counts[:, _PART == p].astype(np.uint64) * _WEIGHT[_PART == p]).sum(1, dtype=np.uint64) for p in range(PARTS)], 1)

    def one_edit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a and b, whose lengths differ by one at most, differ by exactly one inserted, deleted or replaced code point."""
        swap = self.size[a] < self.size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        out = np.zeros(len(a), bool)
        short = self.size[a] <= WIDE
        x, y = self.points[a[short]], self.points[b[short]]
        differ = (x != y).sum(1) == 1
        shifted = np.zeros_like(x)
        shifted[:, :-1] = x[:, 1:]
        head, tail = np.ones(x.shape, bool), np.logical_and.accumulate((shifted == y)[:, ::-1], axis=1)[:, ::-1]
        head[:, 1:] = np.logical_and.accumulate((x == y)[:, :-1], axis=1)
        out[short] = np.where(self.size[a[short]] == self.size[b[short]], differ, (head & tail).any(1))
        for i in np.flatnonzero(~short).tolist():
            x, y = self.words[a[i]], self.words[b[i]]
            same = next((j for j, (p, q) in enumerate(zip(x, y)) if p != q), len(y))
            out[i] = x != y and x[same + 1 :] == y[same + (len(x) == len(y)) :]
        return out


_order = [ord(c) - 97 for c in COMMON] + list(range(26, LETTERS))
_PART = np.empty(LETTERS, np.int64)
_PART[_order] = [i % PARTS if i // PARTS % 2 == 0 else PARTS - 1 - i % PARTS for i in range(LETTERS)]
_WEIGHT = text.mix(np.arange(1, LETTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _blocks(words: DataFrame) -> DataFrame:
    """words(word, n) -> a row for each word and two parts of the alphabet: pair, key (of the counts in both), word, n."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = Letters(batch.column("word").to_pylist()).parts()
            for c, (p, q) in enumerate(PAIRS):
                key = text.pair(parts[:, p], parts[:, q])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, c, np.int32)), pa.array(key.view(np.int64)), batch.column("word"), batch.column("n")], names=["pair", "key", "word", "n"])

    return words.mapInArrow(rows, "pair int, key long, word string, n long")


def _products(counts: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of blocks of at most `width` rows each whose squared distance is 1 or 2, by products of stacks of blocks."""
    step = max(1, (1 << 22) // (width * max(width, LETTERS)))
    for i in range(0, len(first), step):
        at = first[i : i + step, None] + np.minimum(np.arange(width), size[i : i + step, None] - 1)
        stack = counts[at].astype(np.float64)
        norm = np.square(stack).sum(2)
        far = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(stack, stack.transpose(0, 2, 1))
        g, a, b = np.nonzero((far >= 1) & (far <= 2))
        keep = (a < b) & (b < size[i + g])
        yield at[g[keep], a[keep]], at[g[keep], b[keep]]


def _between(counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a row of a and one of b whose squared distance is 1 or 2, by products of 1,024 rows each."""
    for i in range(0, len(a), 1024):
        x = counts[a[i : i + 1024]].astype(np.float64)
        for j in range(0, len(b), 1024):
            y = counts[b[j : j + 1024]].astype(np.float64)
            far = np.square(x).sum(1)[:, None] + np.square(y).sum(1) - 2 * (x @ y.T)
            p, q = np.nonzero((far >= 1) & (far <= 2))
            yield a[i + p], b[j + q]


def _pairs_of(letters: Letters, side: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of words of a block whose counts are near; blocks are rows from first on. Words of sides 0 and 1 meet only across."""
    alike = side[first] == 2
    for width in (2, 4, 8, 16, 32, 64):
        own = np.flatnonzero(alike & (size > width // 2) & (size <= width) & (size > 1))
        yield from _products(letters.counts, first[own], size[own], width)
    for g in np.flatnonzero((alike & (size > 64)) | ~alike).tolist():
        at = np.arange(first[g], first[g] + size[g])
        if not alike[g]:
            halves = at[side[at] == 0], at[side[at] == 1]
            for n in np.unique(letters.size[halves[0]]).tolist():
                near = halves[1][np.abs(letters.size[halves[1]] - n) <= 1]
                yield from _between(letters.counts, halves[0][letters.size[halves[0]] == n], near)
            continue
        for n in np.unique(letters.size[at]).tolist():
            own, next_ = at[letters.size[at] == n], at[letters.size[at] == n + 1]
            for a, b in _between(letters.counts, own, own):
                yield a[a < b], b[a < b]
            yield from _between(letters.counts, own, next_)


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """words(word, n), distinct -> (word, other, other_n) for every two words exactly one edit apart, both ways."""
    blocks = scratch.written(_blocks(words), "blocks")
    large = blocks.groupBy("pair", "key").agg(F.count("*").alias("m")).filter(F.col("m") > tile)
    large = scratch.written(large.select("pair", "key", F.ceil(F.col("m") / tile).cast("int").alias("tiles")), "large")
    tiled = blocks.join(large, ["pair", "key"], "left").withColumn("own", F.when(F.col("tiles") > 1, F.pmod(F.xxhash64("word"), "tiles")).otherwise(0).cast("int"))
    # tile i meets every tile j >= i: words of i on side 0, of j on side 1, and itself as side 2
    meets = F.transform(F.sequence(F.lit(0), F.coalesce(F.col("tiles"), F.lit(1)) - 1), lambda t: F.struct(F.least("own", t).alias("i"), F.greatest("own", t).alias("j"), F.when(t < F.col("own"), 1).when(t > F.col("own"), 0).otherwise(2).alias("side")))
    dealt = tiled.select("pair", "key", "word", "n", F.explode(meets).alias("m")).select("pair", "key", "m.i", "m.j", "m.side", "word", "n")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(part: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
            names = part.column("word").to_pylist()
            letters, n, side, pair = Letters(names), part.column("n").to_numpy(), part.column("side").to_numpy().astype(np.int64), part.column("pair").to_numpy()
            parts = letters.parts()
            for a, b in _pairs_of(letters, side, cuts[:-1], np.diff(cuts)):
                keep = np.abs(letters.size[a] - letters.size[b]) <= 1
                a, b = a[keep], b[keep]
                # of all blocks that two words share, the first one has the pair
                same = parts[a] == parts[b]
                leading = np.argmax(np.stack([same[:, p] & same[:, q] for p, q in PAIRS], 1), axis=1) if len(a) else a
                keep = leading == pair[a]
                a, b = a[keep], b[keep]
                keep = letters.one_edit(a, b)
                a, b = a[keep], b[keep]
                if len(a):
                    x, y = np.append(a, b), np.append(b, a)
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in x.tolist()]), pa.array([names[i] for i in y.tolist()]), pa.array(n[y])], names=["word", "other", "other_n"])

        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            cuts = _cuts(held)
            if len(cuts) > 2 and held.num_rows > TILE:  # all but the last block are whole
                yield from solved(held.slice(0, cuts[-2]).combine_chunks(), cuts[:-1])
                held = held.slice(cuts[-2]).combine_chunks()
        if held is not None and held.num_rows:
            yield from solved(held.combine_chunks(), _cuts(held))

    keys = ["pair", "key", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(rows, "word string, other string, other_n long")


def _cuts(table: pa.Table) -> np.ndarray:
    """Where blocks begin, and the number of rows."""
    new = np.zeros(table.num_rows, bool)
    for c in ("pair", "key", "i", "j"):
        v = table.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(new), [table.num_rows]])


def _roots(forms: DataFrame) -> DataFrame:
    """forms(word, form) -> (word, root): where following forms ends. Each round doubles how far a word looks; n grows at each step, so there are few."""
    now = scratch.written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = now.join(on, "root", "left")
        if joined.filter("next is not null").isEmpty():
            return now
        now = scratch.replaced(now, joined.select("word", F.coalesce("next", "root").alias("root")), "roots")


def groups(docs: DataFrame, every: int = 199, least_letters: int = 6, least_n: int = 5, ratio: int = 5, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each word: word, n, n_near, form, form_n and root.

    Words are maximal runs of ASCII letters and U+00C0 to U+00FF, of which only
    A to Z are lower-cased. Where `every` divides h, the crc32 of
    `<id>:<run>`, the run loses its code point h % length: slips that the
    operator makes itself. Words of least_letters code points and least_n
    occurrences are kept. n_near counts the words exactly one inserted, deleted
    or replaced code point away; form is the most frequent of them (of equals
    the smallest in code-point order) if it occurs ratio times as often, ratio
    being 2 at least; root is where following forms ends, the word itself if it
    has none.

    Null and empty texts have no words, a null id counts as an empty one, and
    repeated rows count each time. Within a slice of text, runs are told apart
    by 64 bits of hash.
    """
    if ratio < 2 or least_letters < 1:
        raise ValueError("ratio is 2 at least, least_letters 1")
    counted = word_counts(docs, every, least_letters, id_col, text_col)
    words = scratch.written(counted.filter(F.col("n") >= least_n), "words")
    near = near_words(words, tile)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    tops = scratch.written(near.groupBy("word").agg(F.count("*").alias("n_near"), best).select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n")), "near")
    fits = F.col("form_n") >= ratio * F.col("n")
    known = words.join(tops, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")
    )
    known = scratch.written(known, "known")
    roots = _roots(known.filter("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
