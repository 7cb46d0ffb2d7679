"""Removal of long passages that occur earlier in the corpus, and of passages of a bounded reference list.

`remove_repeats` works on the corpus itself. Of every window of `window` words,
winnowing keeps the smallest hash of its k-grams. A window can only occur
twice if the k-gram kept for it is kept twice, so only windows on such k-grams
go on, a row for each k-gram kept; of equal windows all but the one of smallest
(id, start) are removed.

`remove_reference_spans` takes a reference list that is bounded: its shards
become suffix automata over words, which are broadcast; documents are streamed
through them for matching statistics, and maximal matches of min_words or more
go. For the corpus against itself that method isn't used: every document would
have to pass the automata of all the corpus; see the README for figures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, text

#: Of windows on a k-gram that is kept more often than this, each task sends on only the first one that it has met.
HOT = 1_000
#: Windows that a task remembers for that; beyond, it forgets them, which costs rows but no result.
REMEMBERED = 100_000


def ordered_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, doc_id, x): k tells rows apart and orders them as doc_id does. It is doc_id itself where that is unique and
    never null; else rows are numbered by (doc_id, text), null ids first."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("x"))
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").limit(1).count()
    if not odd:
        return docs.select(F.col("doc_id").alias("k"), "doc_id", "x")
    numbered = docs.repartitionByRange("doc_id", "x").sortWithinPartitions("doc_id", "x").withColumn("k", F.monotonically_increasing_id())
    return scratch.written(numbered.select("k", "doc_id", "x"), "numbered")


def _prints(docs: DataFrame, window: int, k: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, "x"):
            words = text.Words(part.column("x"))
            h, ok = words.grams(k)
            at = np.unique(text.winnow(h, ok, window - k + 1)[1])
            of = words.text[at]
            yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(of)), pa.array((at - words.first[of]).astype(np.int32)), pa.array(h[at].view(np.int64))], names=["k", "place", "print"])

    return docs.select("k", "x").mapInArrow(rows, "k long, place int, print long")


WINDOWS = "print long, k long, start int, hashes array<long>, late boolean"


def _window_rows(prints: np.ndarray, k: pa.Array, start: np.ndarray, ends: np.ndarray, hashes: np.ndarray, late: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(hashes.view(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), k, pa.array(start.astype(np.int32)), lists, pa.array(late)], names=["print", "k", "start", "hashes", "late"])


class _Firsts:
    """Of each window that a task has met, the smallest (k, start); all others are late, and need no company to say so."""

    def __init__(self) -> None:
        self.first: dict[tuple[int, int], tuple[int, int]] = {}

    def late(self, rows: Iterator[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        for p, h, k, s in rows:
            old = self.first.setdefault((p, h), (k, s))
            if old < (k, s):
                yield p, h, k, s
            elif old > (k, s):
                self.first[p, h] = (k, s)
                yield p, h, *old

    def batch(self, rows: list[tuple[int, int, int, int]], late: bool) -> pa.RecordBatch:
        p, h, k, s = (np.array(c, np.uint64 if i < 2 else np.int64) for i, c in enumerate(zip(*rows)))
        # windows of a hot k-gram are dealt out each by its own words, late ones anywhere
        p = text.mix(k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + s.view(np.uint64)) if late else text.pair(p, h)
        return _window_rows(p, pa.array(k), s, np.arange(len(rows) + 1), h, np.full(len(rows), late))

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.first:
            yield self.batch([(*w, *at) for w, at in self.first.items()], False)
            self.first = {}


def _windows(docs: DataFrame, window: int, k: int) -> DataFrame:
    """docs(k, x, few, many) -> (print, k, start, hashes, late): for each kept k-gram at one of the places `few`, the first of the windows
    it is kept for, and the hashes of these windows, which follow one another. Windows on places `many` have a row each, under a print of
    k-gram and window; they are late, under one of their own, if the task has met the window at a smaller (k, start)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = _Firsts()
        for part in text.slices(batches, "x"):
            words = text.Words(part.column("x"))
            h, ok = words.grams(k)
            starts, best = text.winnow(h, ok, window - k + 1)
            hashes, of = words.grams(window)[0][starts], words.text[starts]
            ids = part.column("k").to_numpy()
            for name in ("few", "many"):
                places = part.column(name)
                counts = np.array(places.value_lengths().to_numpy(zero_copy_only=False), np.int64)
                marked = np.zeros(len(words.hash) + 1, bool)
                marked[places.flatten().to_numpy(zero_copy_only=False) + np.repeat(words.first[:-1], counts)] = True
                keep = np.flatnonzero(marked[best])
                if not len(keep):
                    continue
                place = starts[keep] - words.first[of[keep]]
                if name == "few":
                    first = np.flatnonzero(np.diff(best[keep], prepend=-1))
                    yield _window_rows(h[best[keep][first]], pa.array(ids[of[keep][first]]), place[first], np.append(first, len(keep)), hashes[keep], np.zeros(len(first), bool))
                else:
                    met = zip(h[best[keep]].tolist(), hashes[keep].tolist(), ids[of[keep]].tolist(), place.tolist())
                    if late := list(firsts.late(met)):
                        yield firsts.batch(late, True)
                    if len(firsts.first) > REMEMBERED:
                        yield from firsts.flush()
        yield from firsts.flush()

    return docs.select("k", "x", "few", "many").mapInArrow(rows, WINDOWS)


def _spans(starts: DataFrame, window: int) -> DataFrame:
    """(k, places): begin and end of each stretch of words that the windows at the places cover, one after the other."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.column("places"):
                at = np.sort(p.values.to_numpy())
                gap = np.flatnonzero(np.diff(at) > window)
                out.append(np.stack([at[np.append(0, gap + 1)], at[np.append(gap, len(at) - 1)] + window], axis=1).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(out, pa.list_(pa.int32()))], names=["k", "places"])

    return starts.mapInArrow(rows, "k long, places array<int>")


def repeated_spans(docs: DataFrame, window: int, k: int) -> DataFrame:
    """docs(k, x) -> (k, places): begin and end of the stretches that are covered by windows that also start earlier in the corpus. Joins are by sorted
    partitions whatever the size, so that no task holds a side and disk is in proportion to the corpus."""
    spark, prints = docs.sparkSession, _prints(docs, window, k)
    # written, so that Spark can split the rows of a hot k-gram in the join
    twice = scratch.written(prints.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1"), "twice")
    scratch.released(spark)
    # steps of one shuffle of the corpus each, so that disk holds the files of one at a time
    hits = prints.join(twice.hint("merge"), "print").groupBy("k").agg(F.collect_list(F.when(F.col("n") <= HOT, F.col("place"))).alias("few"), F.collect_list(F.when(F.col("n") > HOT, F.col("place"))).alias("many"))
    hits = scratch.written(hits, "hits")
    scratch.dropped(twice)
    scratch.released(spark)
    rows = scratch.written(_windows(docs.join(hits.hint("merge"), "k"), window, k), "windows")
    scratch.dropped(hits)
    scratch.released(spark)
    each = rows.repartition("print").select("print", "k", "start", "late", F.posexplode("hashes").alias("i", "hash")).select("print", "hash", "k", (F.col("start") + F.col("i")).alias("start"), "late")
    least = F.min(F.struct("k", "start")).over(Window.partitionBy("print", "hash"))
    later = each.withColumn("first", least).filter(F.col("late") | (F.struct("k", "start") > F.col("first")))
    spans = scratch.written(_spans(later.groupBy("k").agg(F.collect_list("start").alias("places")), window), "repeats")
    scratch.dropped(rows)
    scratch.released(spark)
    return spans


def remove_repeats(docs: DataFrame, window: int = 20, k: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, kept (the words left, joined by one space) and kept_sha256.

    A word goes if a window of `window` words that covers it has the same words
    as one that starts earlier: in a document of smaller id, or before it in the
    same one; windows are judged on the input. Words are runs of anything but
    ASCII white space. Null and empty texts have no words. Rows that share an id
    are ordered by their texts; null ids come before all others. Windows are
    equal if 64 bits of hash of all their words, and 64 of the k-gram kept, are.
    """
    keyed = ordered_key(docs, id_col, text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, "x"):
            n_words, kept = [], []
            for value, places in zip(part.column("x").cast(pa.large_binary()).to_pylist(), part.column("places").to_pylist()):
                words = (value or b"").split()
                n_words.append(len(words))
                if places:
                    gone = bytearray(len(words))
                    for a, b in zip(places[::2], places[1::2]):
                        gone[a:b] = b"\x01" * (b - a)
                    words = [w for w, g in zip(words, gone) if not g]
                kept.append(words)
            left = [b" ".join(w) for w in kept]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array([n - len(w) for n, w in zip(n_words, kept)], pa.int64()),
                    pa.array(left, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in left]),
                ],
                names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    return keyed.join(repeated_spans(keyed, window, k).hint("merge"), "k", "left").mapInArrow(rows, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")


class SuffixAutomaton:
    """All runs of words of the sequences added, each state with the length of its longest run."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[bytes]) -> None:
        """Adds a sequence; runs don't cross from one sequence to the next."""
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def matching(self, words: list[bytes]) -> list[int]:
        """For every word the length of the longest run that ends there and that some sequence holds."""
        nxt, link, length = self.next, self.link, self.length
        out, state, run = [], 0, 0
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                run = length[state]
            if w in nxt[state]:
                state, run = nxt[state][w], run + 1
            out.append(run)
        return out


def remove_reference_spans(docs: DataFrame, reference: DataFrame, min_words: int = 20, shard_words: int = 200_000, max_words: int = 2_000_000, text_col: str = "text") -> DataFrame:
    """(row, n_words, n_removed, kept) for each document: spans of min_words or more that a reference text holds are removed.

    row is a struct of all columns of docs. The reference list must not have
    over max_words words, which is checked; it is collected, cut into shards
    and broadcast, and every task builds a shard's automaton once.
    """
    lines = reference.select(F.col(text_col).alias("x"))
    size = lines.agg(F.coalesce(F.sum(F.size(F.split(F.coalesce("x", F.lit("")), r"[ \t-\r]+"))), F.lit(0))).first()[0]
    if size > max_words:
        raise ValueError(f"the reference list has {size} words; automata of at most {max_words} are broadcast")
    shards, full = [[]], 0
    for r in lines.collect():
        words = (r["x"] or "").encode().split()
        if full and full + len(words) > shard_words:
            shards.append([])
            full = 0
        shards[-1].append(words)
        full += len(words)
    held = docs.sparkSession.sparkContext.broadcast(shards)
    rows_in = docs.select(text.whole_row(docs), F.col(text_col).alias("x"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = []
        for shard in held.value:
            automata.append(SuffixAutomaton())
            for words in shard:
                automata[-1].add(words)
        for part in text.slices(batches, "x"):
            n_words, n_removed, kept = [], [], []
            for value in part.column("x").cast(pa.large_binary()).to_pylist():
                words = (value or b"").split()
                gone = bytearray(len(words))
                for own in automata:
                    for end, run in enumerate(own.matching(words), 1):
                        if run >= min_words:
                            gone[end - run : end] = b"\x01" * run
                left = [w for w, g in zip(words, gone) if not g]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["row", "n_words", "n_removed", "kept"])

    schema = docs.select(text.whole_row(docs), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept")).schema
    return rows_in.mapInArrow(rows, schema)
