"""Removal of every byte in a long string that also starts elsewhere in the corpus, by suffix arrays of shards.

Of the k-grams of a window of bytes, winnowing picks the one of smallest hash,
so equal windows pick equal k-grams; the windows of a document that pick one
place make a *span*. Only spans whose k-gram is picked more than once anywhere
go on, and spans of equal bytes go on once, with their number. What goes on is
dealt by k-gram, so equal windows meet. A shard is the text of many k-grams, or
a part of one's: its suffix array is sorted by doubling within groups that
aren't told apart yet (Larsson and Sadakane, 2007), common prefixes follow in
text order (Kasai et al., 2001), and where the spans of one k-gram fill more
than a shard, windows of each shard are sought in the others' arrays by binary
search. A k-gram with more distinct text than a task should hold is split: by
halves of the windows' places about it, whose windows share more bytes than the
k-gram, and by those bytes; the last half is one window, of which there is one
text. So no task holds more than `group_bytes` of one k-gram.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, text
from .substring import ordered_key

#: Window starts that are hashed at a time, so that memory follows this and not the length of a text.
CHUNK = 1 << 20
_PLACE = np.uint64((1 << 28) - 1)
#: The smallest numbers of 1, 2, ... 8 bytes.
_BYTES = np.array([1 << 8 * i for i in range(8)], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial hashes of any stretch of a buffer, modulo 2^64. They name candidates; bytes decide what is equal."""

    def __init__(self, buf: np.ndarray, seed: int):
        base = 2 * seed + 0x9E3779B97F4A7C15
        values = text.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(values[buf] * _powers(base, len(buf)), out=self.sums[1:])
        self.inverse = _powers(pow(base, -1, 1 << 64), len(buf) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return text.mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` values that follow one another, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, ~np.uint64(0))
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def spans_of(buf: np.ndarray, off: np.ndarray, window: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For texts between offsets, in chunks: the text, first window start, number of windows, place of the k-gram, its hash and two hashes of the span."""
    for a in range(0, len(buf) - window + 1, CHUNK):
        part = buf[a : a + CHUNK + window - 1]
        one, two = Rolling(part, 1), Rolling(part, 2)
        at = np.arange(len(part) - k + 1)
        grams = one.of(at, at + k)
        picked = (smallest((grams & ~_PLACE) | at.astype(np.uint64), window - k + 1) & _PLACE).astype(np.int64)
        start = np.arange(len(picked))
        of = np.searchsorted(off, start + a, "right") - 1
        whole = np.flatnonzero(start + a + window <= off[of + 1])
        if not len(whole):
            continue
        picked, of = picked[whole], of[whole]
        first = np.flatnonzero(np.diff(picked, prepend=-1))
        n = np.diff(first, append=len(whole))
        begin = whole[first]
        end = begin + n + window - 1
        yield of[first], begin + a, n, picked[first] + a, grams[picked[first]], one.of(begin, end), two.of(begin, end)


SPANS = "k long, start int, n int, gap int, print long, h1 long, h2 long"


def _spans(docs: DataFrame, window: int, k: int) -> DataFrame:
    """docs(k, x) -> every span: its document and first window, its windows, how far its k-gram is from the first window's start, and hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, "x"):
            buf, off = text.flat(part.column("x"))
            for of, begin, n, at, *hashes in spans_of(buf, off, window, k):
                numbers = [(begin - off[of]).astype(np.int32), n.astype(np.int32), (at - begin).astype(np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("k").take(pa.array(of)), *map(pa.array, numbers), *(pa.array(h.view(np.int64)) for h in hashes)], names=["k", "start", "n", "gap", "print", "h1", "h2"]
                )

    return docs.select("k", "x").mapInArrow(rows, SPANS)


def _bodies(docs: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """The bytes of the chosen spans, read from the documents that hold them."""
    wanted = chosen.groupBy("k").agg(F.collect_list(F.struct("start", "n", "gap", "print", "h1", "h2", "copies")).alias("own"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, "x"):
            texts, own = part.column("x").cast(pa.large_binary()).to_pylist(), part.column("own")
            of, own = np.repeat(np.arange(len(texts)), own.value_lengths()).tolist(), own.flatten()
            body = pa.array([texts[i][s : s + n + window - 1] for i, s, n in zip(of, own.field("start").to_pylist(), own.field("n").to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*(own.field(c) for c in ("print", "h1", "h2", "copies", "n", "gap")), body], names=["print", "h1", "h2", "copies", "n", "gap", "body"])

    return docs.select("k", "x").join(wanted, "k").mapInArrow(rows, "print long, h1 long, h2 long, copies long, n int, gap int, body binary")


class SuffixArray:
    """The sorted suffixes of texts, each ended by a mark that is smaller than any byte and equal to no other mark."""

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts], np.int64)
        end = np.cumsum(size + 1) - 1
        self.buf = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        self.text = np.repeat(np.arange(len(texts)), size + 1)
        self.left = (end[self.text] - np.arange(len(self.buf))).astype(np.int64)
        self.eights = self._eights(self.buf)
        self.rank, self.sorted = self._order()

    @staticmethod
    def _eights(buf: np.ndarray) -> np.ndarray:
        """From every byte on, eight of them as a number that orders as they do."""
        return text.eights(buf)[:-1].byteswap()

    def _order(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.buf)
        low = np.minimum(self.left, 8)
        key = self.eights & ~text.LOW[8 - low]
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=key[order[0]]) != 0
        # suffixes that end within eight bytes are told apart by where, and by their text
        group = np.cumsum(new)
        ends = np.zeros(group[-1] + 1, bool)
        ends[group[self.left[order] < 8]] = True
        mixed = np.flatnonzero(ends[group])
        own = order[mixed]
        own = own[np.lexsort((np.where(low[own] < 8, self.text[own], 0), low[own], group[mixed]))]
        order[mixed] = own
        new |= np.diff(low[order], prepend=0) != 0
        new |= self.left[order] < 8
        new[0] = True
        rank, depth = np.empty(n, np.int64), 8
        first = np.flatnonzero(new)
        rank[order] = np.repeat(first, np.diff(first, append=n))
        # groups of suffixes that share `depth` bytes, and within them by the rank of what follows
        open_ = np.flatnonzero(np.repeat(np.diff(first, append=n) > 1, np.diff(first, append=n)))
        while len(open_):
            at = order[open_]
            head, tail = rank[at], rank[at + depth]
            by = np.lexsort((tail, head))
            at, head, tail = at[by], head[by], tail[by]
            order[open_] = at
            new = (np.diff(head, prepend=-1) != 0) | (np.diff(tail, prepend=-1) != 0)
            first = np.flatnonzero(new)
            sizes = np.diff(first, append=len(at))
            rank[at] = np.repeat(open_[first], sizes)
            open_ = open_[np.repeat(sizes > 1, sizes)]
            depth *= 2
        return rank, order

    def common(self) -> np.ndarray:
        """For every suffix the length of its common prefix with the one sorted before it. One place's length is at least the
        length of the place before it less one, so places are taken at strides of 64, 32, ... 1, each from what the last stride found."""
        n = len(self.buf)
        before = np.full(n, -1)
        before[self.sorted[1:]] = self.sorted[:-1]
        out, stride = np.zeros(n, np.int64), 64
        todo = np.arange(0, n, stride)
        while True:
            at = todo[before[todo] >= 0]
            least = out[at - stride] - stride if stride < 64 else np.zeros(len(at), np.int64)
            self._extend(at, before[at], np.maximum(least, 0), out)
            if stride == 1:
                return out
            stride //= 2
            todo = np.arange(stride, n, 2 * stride)

    def _extend(self, at: np.ndarray, other: np.ndarray, done: np.ndarray, out: np.ndarray) -> None:
        most = np.minimum(self.left[at], self.left[other])
        while len(at):
            differ = self.eights[at + done] ^ self.eights[other + done]
            same = 8 - np.searchsorted(_BYTES, differ, "right")
            done = done + same
            out[at] = np.minimum(done, most)
            more = (same == 8) & (done < most)
            at, other, done, most = at[more], other[more], done[more], most[more]

    def windows(self, width: int) -> np.ndarray:
        """The places of all windows of width bytes, in sorted order."""
        return self.sorted[self.left[self.sorted] >= width]

    def repeated(self, width: int) -> np.ndarray:
        """Whether each place starts a window of width bytes that another place starts too."""
        long = self.common() >= width
        out = long.copy()
        out[self.sorted[:-1]] |= long[self.sorted[1:]]
        return out

    def seek(self, other: SuffixArray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """By binary search of the other's windows among the sorted ones here: whether each place here is found, and each place there."""
        own, asked = self.windows(width), other.windows(width)
        here, there = np.zeros(len(self.buf), bool), np.zeros(len(other.buf), bool)
        lo, hi = np.zeros(len(asked), np.int64), np.full(len(asked), len(own))
        for depth in range(0, width, 8):
            step = min(depth, width - 8)
            lo, hi = self._bound(own, other.eights[asked + step], step, lo, hi, False), self._bound(own, other.eights[asked + step], step, lo, hi, True)
            live = lo < hi
            asked, lo, hi = asked[live], lo[live], hi[live]
        there[asked] = True
        marks = np.zeros(len(own) + 1, np.int64)
        np.add.at(marks, lo, 1)
        np.add.at(marks, hi, -1)
        here[own[np.cumsum(marks[:-1]) > 0]] = True
        return here, there

    def _bound(self, own: np.ndarray, value: np.ndarray, step: int, lo: np.ndarray, hi: np.ndarray, after: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            v = self.eights[own[mid] + step]
            right = (v <= value[open_]) if after else (v < value[open_])
            lo[open_[right]], hi[open_[~right]] = mid[right] + 1, mid[~right]


def repeated_windows(groups: list[list[bytes]], width: int, shard_bytes: int) -> list[list[np.ndarray]]:
    """For each text of each group whether each of its windows starts elsewhere in the group too. Groups share a shard while they fit it;
    a larger group is cut into shards that are merged pair by pair."""
    shards, out, own = [], [[None] * len(g) for g in groups], []
    size = 0

    def close() -> None:
        nonlocal own, size
        if own:
            shards.append(own)
        own, size = [], 0

    def solve() -> None:
        arrays = [SuffixArray([groups[g][i] for g, i in s]) for s in shards]
        found = [a.repeated(width) for a in arrays]
        for j in range(len(arrays)):
            for i in range(j):
                here, there = arrays[i].seek(arrays[j], width)
                found[i] |= here
                found[j] |= there
        for s, flags in zip(shards, found):
            at = 0
            for g, i in s:
                out[g][i] = flags[at : at + len(groups[g][i]) - width + 1]
                at += len(groups[g][i]) + 1
        shards.clear()

    for g, texts in enumerate(groups):
        whole = sum(map(len, texts))
        if size and size + whole > shard_bytes:
            close()
            solve()
        for i, t in enumerate(texts):
            if size and size + len(t) > shard_bytes:
                close()
            own.append((g, i))
            size += len(t)
        if shards:  # a group of several shards is merged for itself
            close()
            solve()
    close()
    solve()
    return out


GONE = "print long, h1 long, h2 long, gone array<int>"


def _runs(flags: np.ndarray) -> list[int]:
    """Begin and end of each run of true flags, one after the other."""
    return np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0)).tolist()


def _in_shards(spans: DataFrame, width: int, shard_bytes: int) -> DataFrame:
    """Spans, dealt by their k-gram -> (print, h1, h2, gone): runs of the windows that start elsewhere too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, groups, held, last, size = [], [], [], None, 0

        def solved() -> pa.RecordBatch:
            p, a, b, gone = [], [], [], []
            for own, found in zip(keys, repeated_windows(groups, width, shard_bytes)):
                for (print_, h1, h2, copies), flags in zip(own, found):
                    if copies > 1:
                        flags = np.ones(len(flags), bool)
                    if flags.any():
                        p.append(print_), a.append(h1), b.append(h2), gone.append(_runs(flags))
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["print", "h1", "h2", "gone"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("print", "h1", "h2", "copies", "body"))
            for print_, h1, h2, copies, body in zip(*columns):
                if print_ != last:
                    if size > shard_bytes:
                        yield solved()
                        keys, groups, size = [], [], 0
                    keys.append([])
                    groups.append([])
                    last = print_
                keys[-1].append((print_, h1, h2, copies))
                groups[-1].append(body)
                size += len(body)
        if groups:
            yield solved()

    dealt = spans.select("print", "h1", "h2", "copies", "body").repartition("print").sortWithinPartitions("print")
    return dealt.mapInArrow(rows, GONE)


def _halves(spans: DataFrame, width: int) -> DataFrame:
    """Each span cut in two by the places of its k-gram in its windows, lo to mid and mid to hi, under the hash of what all windows of the half share."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(13)]
            for r in batch.to_pylist():
                mid = (r["lo"] + r["hi"]) // 2
                for lo, hi in ((r["lo"], mid), (mid, r["hi"])):
                    # window i of the span has the k-gram at place gap - i
                    a, b = max(0, r["gap"] - hi + 1), min(r["n"], r["gap"] - lo + 1)
                    if a >= b:
                        continue
                    body = r["body"][a : b + width - 1]
                    gap = r["gap"] - a
                    core = r["body"][r["gap"] - lo : r["gap"] - hi + 1 + width]
                    key = hashlib.blake2b(b"%d %d %d " % (r["print"], lo, hi) + core, digest_size=8).digest()
                    own = hashlib.blake2b(body, digest_size=16).digest()
                    h1, h2 = int.from_bytes(own[:8], "little", signed=True), int.from_bytes(own[8:], "little", signed=True)
                    for c, v in zip(out, (r["print"], r["h1"], r["h2"], a, int.from_bytes(key, "little", signed=True), h1, h2, r["copies"], b - a, gap, lo, hi, body)):
                        c.append(v)
            kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 4 + [pa.int32()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds)], names=["of", "of1", "of2", "shift", "print", "h1", "h2", "copies", "n", "gap", "lo", "hi", "body"])

    schema = "of long, of1 long, of2 long, shift int, print long, h1 long, h2 long, copies long, n int, gap int, lo int, hi int, body binary"
    return spans.select("print", "h1", "h2", "copies", "n", "gap", "lo", "hi", "body").mapInArrow(rows, schema)


def _resolved(spans: DataFrame, width: int, shard_bytes: int, group_bytes: int) -> DataFrame:
    """spans(print, h1, h2, copies, n, gap, lo, hi, body) -> (print, h1, h2, gone); k-grams of more than group_bytes by halves."""
    sizes = spans.groupBy("print").agg(F.sum(F.octet_length("body")).alias("bytes"))
    large = scratch.written(sizes.filter(F.col("bytes") > group_bytes).select("print"), "large")
    if large.isEmpty():
        return _in_shards(spans, width, shard_bytes)
    small = spans.join(large, "print", "left_anti")
    halves = scratch.written(_halves(spans.join(large, "print", "left_semi"), width), "halves")
    same = F.first(F.struct("n", "gap", "lo", "hi", "body")).alias("r")
    distinct = scratch.written(halves.groupBy("print", "h1", "h2").agg(F.sum("copies").alias("copies"), same).select("print", "h1", "h2", "copies", "r.*"), "spans")
    found = _resolved(distinct, width, shard_bytes, group_bytes)
    back = halves.select("of", "of1", "of2", "shift", "print", "h1", "h2").join(found, ["print", "h1", "h2"])
    shifted = back.select(F.col("of").alias("print"), F.col("of1").alias("h1"), F.col("of2").alias("h2"), F.transform("gone", lambda v: v + F.col("shift")).alias("gone"))
    return _in_shards(small, width, shard_bytes).union(shifted)


def repeated_spans(docs: DataFrame, width: int, k: int, shard_bytes: int, group_bytes: int) -> DataFrame:
    """docs(k, x) -> (k, places): for each document with any, begin and end of runs of windows that start elsewhere too, unordered."""
    spark = docs.sparkSession
    spans = scratch.written(_spans(docs, width, k), "spans")
    each = spans.groupBy("print", "h1", "h2").agg(F.count("*").alias("copies"), F.min(F.struct("k", "start", "n", "gap")).alias("r"))
    each = scratch.written(each.select("print", "h1", "h2", "copies", "r.*"), "distinct")
    twice = scratch.written(each.groupBy("print").agg(F.sum("copies").alias("m")).filter("m > 1").select("print"), "twice")
    chosen = each.join(twice, "print")
    bodies = scratch.written(_bodies(docs, chosen, width).withColumns({"lo": F.lit(0), "hi": F.lit(width - k + 1)}), "bodies")
    scratch.dropped(each, twice)
    scratch.released(spark)
    found = scratch.written(_resolved(bodies, width, shard_bytes, group_bytes), "found")
    scratch.dropped(bodies)
    scratch.released(spark)
    hit = spans.select("k", "start", "print", "h1", "h2").join(found, ["print", "h1", "h2"])
    places = hit.select("k", F.transform("gone", lambda v: v + F.col("start")).alias("gone")).groupBy("k").agg(F.flatten(F.collect_list("gone")).alias("places"))
    out = scratch.written(places, "places")
    scratch.dropped(spans, found)
    scratch.released(spark)
    return out


def remove_repeated_bytes(docs: DataFrame, width: int = 400, k: int = 40, shard_bytes: int = 1 << 20, group_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans (maximal runs removed), spans (begin and end of each, one after the other), kept (bytes) and kept_sha256.

    A byte of the UTF-8 text goes if a string of width bytes (8 at least) that
    covers it also starts anywhere else, in this or another document; strings
    don't cross documents and are judged on the input. Every occurrence goes,
    the first included. Null and empty texts, and texts shorter than width,
    lose nothing. Rows that share an id, or have none, are documents of their
    own, so of repeated rows nothing is left if they are width bytes long.
    What is left needn't be valid UTF-8, so kept is binary.
    """
    if not 1 <= k <= width or width < 8 or group_bytes < 2 * width:
        raise ValueError("width is 8 at least, k from 1 to width, group_bytes twice the width at least")
    keyed = ordered_key(docs, id_col, text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, "x"):
            kept, spans = [], []
            for value, places in zip(part.column("x").cast(pa.large_binary()).to_pylist(), part.column("places").to_pylist()):
                value, gone = value or b"", []
                for a, b in sorted(zip(places[::2], places[1::2])) if places else ():
                    if gone and a <= gone[-1]:
                        gone[-1] = max(gone[-1], b + width - 1)
                    else:
                        gone += [a, b + width - 1]
                edges = [0, *gone, len(value)]
                kept.append(b"".join(value[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append(gone)
            size = text.flat(part.column("x"))[1]
            n = np.diff(size)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(n), pa.array(n - np.array([len(x) for x in kept], np.int64)), pa.array([len(s) // 2 for s in spans], pa.int64()),
                    pa.array(spans, pa.list_(pa.int32())), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"],
            )

    found = repeated_spans(keyed, width, k, shard_bytes, group_bytes)
    return keyed.join(found, "k", "left").mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<int>, kept binary, kept_sha256 string")
