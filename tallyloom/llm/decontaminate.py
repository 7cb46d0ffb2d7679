"""Benchmark decontamination by winnowing.

Of every window of `window` consecutive words, the smallest hash of its k-grams
is kept, on both sides; equal windows keep the same one, so a join of the kept
hashes finds every shared window. Each hit is then extended from the k-gram to
the window and compared word by word. An item of fewer words is one window of
its own length, kept by the hash of the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, text

#: Bits of the filter that tells tasks which prints a benchmark may have: 16 MB, whatever the size of the benchmark.
FILTER_BITS = 1 << 27


def words_of(value: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (value or "").encode().translate(text.ALNUM_LOWER).split()


def _sized(h: np.ndarray, n: int) -> np.ndarray:
    """k-grams of windows of different lengths don't meet."""
    return text.mix(h + np.uint64(n)).view(np.int64)


def windows(items: DataFrame, window: int, k: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, length, span, print, offset) of every window: its words joined by spaces, and where in it its fingerprint begins."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, "x"):
            seen, ids = text.Words(part.column("x"), text.ALNUM, lower=True), part.column("k").to_pylist()
            out = []
            for item, value, n, first in zip(ids, part.column("x").to_pylist(), seen.count, seen.first):
                if not n:
                    continue
                words = words_of(value)
                size = min(window, int(n))
                gram = k if size == window else size
                one = text.Words(pa.array([value]), text.ALNUM, lower=True)
                h, ok = one.grams(gram)
                starts, best = text.winnow(h, ok, size - gram + 1)
                prints = _sized(h, size)
                out += [{"item_id": item, "length": size, "span": b" ".join(words[s : s + size]).decode(), "print": int(prints[b]), "offset": int(b - s)} for s, b in zip(starts, best)]
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("item_id", pa.int64()), ("length", pa.int64()), ("span", pa.string()), ("print", pa.int64()), ("offset", pa.int64())]))

    picked = items.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("x"))
    return picked.mapInArrow(rows, "item_id long, length long, span string, print long, offset long")


def print_filter(prints: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of two bits a print, set by executors and put together by 64-bit words."""
    low = F.lit(bits - 1).cast("long")
    both = prints.select(F.explode(F.array(F.col("print").bitwiseAND(low), F.shiftrightunsigned("print", 32).bitwiseAND(low))).alias("bit"))
    words = both.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63).cast("long")).cast("int"))).alias("word")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return out.view(np.uint64)


def may_have(words: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether a filter may have each of the prints."""
    h, low, six = prints.view(np.uint64), np.uint64(64 * len(words) - 1), np.uint64(6)
    one, two = h & low, (h >> np.uint64(32)) & low
    return ((words[one >> six] >> (one & np.uint64(63))) & (words[two >> six] >> (two & np.uint64(63))) & np.uint64(1)).astype(bool)


def fingerprints(docs: DataFrame, window: int, k: int, short: list[int], known: Broadcast) -> DataFrame:
    """docs(k, x) -> (doc_id, position, print): the k-grams that winnowing keeps, and all grams of the short lengths given, that the filter may have."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, "x"):
            words, ids = text.Words(part.column("x"), text.ALNUM, lower=True), part.column("k")
            at, found = [], []
            h, ok = words.grams(k)
            _, best = text.winnow(h, ok, window - k + 1)
            best = np.unique(best)
            at.append(best)
            found.append(_sized(h[best], window))
            for n in short:
                h, ok = words.grams(n)
                at.append(np.flatnonzero(ok))
                found.append(_sized(h[ok], n))
            at, found = np.concatenate(at), np.concatenate(found)
            held = may_have(known.value, found)
            at, found = at[held], found[held]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(words.text[at])), pa.array(at - words.first[words.text[at]]), pa.array(found)], names=["doc_id", "position", "print"])

    return docs.mapInArrow(rows, "doc_id long, position long, print long")


def row_key(id_col: str, text_col: str) -> Column:
    """Ids may be null or repeat, so rows are told apart by id and text; rows of one key have one verdict."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("none")), F.coalesce(F.md5(F.col(text_col)), F.lit("none")))


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 4, id_col: str = "doc_id", text_col: str = "text", keep_key: bool = False
) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit (words in an occurrence of a window of some item), n_items (items
    with such windows), items_sha256 (of their ids, sorted as strings, joined by commas) and contaminated (n_hit > 0).

    Null and empty texts have no words; items without words have no windows;
    repeated items count once for each id, and items without an id as one that
    isn't named in the list. Ids are whole numbers, or strings of such. Rows of documents
    that share an id are judged each by its own text. A null doc_id is judged
    like any other. Other columns are left out. keep_key adds row_key, to find a
    verdict's rows by.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("x"), row_key(id_col, text_col).alias("k"))
    every = scratch.written(windows(benchmark, window, k), "windows")
    spans = every.select(F.xxhash64("span").alias("span_id"), "span", "length", "print", "offset").distinct()
    short = sorted(r["length"] for r in every.filter(F.col("length") < window).select("length").distinct().collect())
    known = docs.sparkSession.sparkContext.broadcast(print_filter(every, FILTER_BITS))
    prints = fingerprints(docs.select("k", "x"), window, k, short, known)
    hits = prints.join(spans, "print").select(F.col("doc_id").alias("k"), (F.col("position") - F.col("offset")).alias("begin"), "length", "span_id", "span").filter("begin >= 0")
    hits = hits.groupBy("k").agg(F.collect_set(F.struct("begin", "length", "span_id", "span")).alias("hits"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, "x"):
            n_words, n_hit, found = [], [], []
            for value, candidates in zip(part.column("x").to_pylist(), part.column("hits").to_pylist()):
                words = words_of(value)
                hit, spans = bytearray(len(words)), set()
                for c in candidates or ():
                    a, n = c["begin"], c["length"]
                    if a + n <= len(words) and words[a : a + n] == c["span"].encode().split():
                        hit[a : a + n] = b"\x01" * n
                        spans.add(c["span_id"])
                n_words.append(len(words))
                n_hit.append(sum(hit))
                found.append(list(spans))
            yield pa.RecordBatch.from_arrays(
                [part.column("k"), part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["k", "doc_id", "n_words", "n_hit", "spans"]
            )

    judged = scratch.written(docs.join(hits, "k", "left").mapInArrow(judge, "k long, doc_id long, n_words long, n_hit long, spans array<long>"), "judged")
    items = every.select(F.xxhash64("span").alias("span_id"), "item_id").distinct()
    of = judged.select("k", F.explode("spans").alias("span_id")).join(items, "span_id").groupBy("k").agg(F.collect_set(F.struct(F.col("item_id").cast("string").alias("id"))).alias("items"))
    out = judged.join(of, "k", "left")
    listed = F.coalesce(F.array_sort(F.filter("items.id", lambda i: i.isNotNull())), F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), listed.alias("items"),
        *([F.col("k").alias("row_key")] if keep_key else []),
    )
