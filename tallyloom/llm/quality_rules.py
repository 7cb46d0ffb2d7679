"""Quality rules by distribution divergence.

A document's histogram of character classes and of the commonest words of its
language is held against that language's own, counted over all documents, by
the Jensen-Shannon distance (base 2, so from 0 to 1). Short texts stray by
chance, so each distance counts only from a length on, and only if the
language's own counts rest on enough words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch, text

CLASSES = ("lower", "upper", "digit", "space", "symbol", "other", "beyond")
SYMBOLS = b"#*$%&|<>"


def _class_table() -> np.ndarray:
    out = np.full(256, CLASSES.index("other"))
    out[97:123], out[65:91], out[48:58] = 0, 1, 2
    out[~text.SPACED] = 3
    out[list(SYMBOLS)] = 4
    out[128:192] = -1  # continues a character
    out[192:] = 6
    return out


CLASS = _class_table()


@dataclass(frozen=True)
class Rules:
    """A text is kept if it has min_words, no more than max_repeat_percent of its words lie in repeated 3-word windows,
    and no distance that counts for its length is above its limit.

    word_limit holds from word_min_words on. Texts of word_short_words to word_min_words have a limit that widens with
    the fourth root of the length they lack; None leaves them to the other rules."""

    min_words: int = 50
    max_repeat_percent: int = 50
    common_words: int = 50
    class_min_chars: int = 200
    class_limit: float = 0.3
    word_min_words: int = 100
    word_limit: float = 0.42
    reference_min_words: int = 1000
    word_short_words: int | None = 50

    @property
    def word_from(self) -> int:
        return self.word_min_words if self.word_short_words is None else min(self.word_short_words, self.word_min_words)

    def word_limit_at(self, n_words: int) -> float:
        return self.word_limit * max(1.0, self.word_min_words / max(1, n_words)) ** 0.25


def _histograms(words: text.Words) -> np.ndarray:
    """Characters of each class, per text."""
    kind = CLASS[words.buf]
    return np.stack([text.sums(kind == c, words.off) for c in range(len(CLASSES))], axis=1)


#: Words of all languages that a task counts before it sends its sums on, about 30 MB.
COUNTED = 200_000


def references(docs: DataFrame, rules: Rules = Rules(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Per language (null counts as one): n_words, characters by class, and the commonest words (A-Z lower-cased; the smaller
    of equally common ones first) with their counts. Counts cover every text whole; only sums per task are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("class", pa.int64()), ("n", pa.int64())])
        found: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, c in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.keys(), pa.binary()).cast(pa.string()), pa.nulls(len(c), pa.int64()), pa.array(c.values(), pa.int64())], schema=schema)
            found.clear()

        for part in text.slices(batches, "x"):
            words, langs = text.Words(part.column("x")), part.column("lang").to_pylist()
            raw = words.buf.tobytes().lower()
            for lang, a, b, h in zip(langs, words.off, words.off[1:], _histograms(words)):
                found.setdefault(lang, Counter()).update(raw[a:b].split())
                sums[lang] = sums.get(lang, 0) + h
            if sum(map(len, found.values())) > COUNTED:
                yield from rows()
        yield from rows()
        for lang, h in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.nulls(len(h), pa.string()), pa.array(np.arange(len(h))), pa.array(h)], schema=schema)

    picked = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("x"))
    counts = scratch.written(picked.mapInArrow(count, "lang string, word string, class long, n long").groupBy("lang", "word", "class").agg(F.sum("n").alias("n")), "counts")
    words = counts.filter("word is not null")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = words.withColumn("rank", rank).filter(F.col("rank") <= rules.common_words).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    classes = counts.filter("class is not null").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("class", "n"))).alias("classes"))
    total = words.groupBy("lang").agg(F.sum("n").alias("n_words"))
    out = classes.join(total, "lang", "left").join(top, "lang", "left")
    empty = F.array()
    return scratch.written(
        out.select("lang", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.col("classes.n").alias("classes"), F.coalesce("top.word", empty.cast("array<string>")).alias("words"), F.coalesce("top.n", empty.cast("array<long>")).alias("counts")),
        "references",
    )


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 if either is empty."""
    p, q = np.asarray(p, float), np.asarray(q, float)
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda a: float(np.sum(a[a > 0] * np.log2(a[a > 0] / m[a > 0])))
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double, base_failed boolean, kept boolean"


def _duplicate_lines(value: bytes) -> int:
    lines = [x for x in value.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _repeated(words: text.Words) -> np.ndarray:
    """Per text, its words in windows of 3 that it holds twice or more."""
    grams, ok = words.grams(3)
    at = np.flatnonzero(ok)
    key = text.mix(grams[at] + words.text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    start = at[order[twice]]
    hit = np.zeros(len(words.hash) + 2, bool)
    for i in range(3):
        hit[start + i] = True
    return text.sums(hit[: len(words.hash)], words.first)


#: References of at most so many languages, about 10 MB, are broadcast.
LANGUAGES = 10_000


def judge(docs: DataFrame, reference: DataFrame, rules: Rules = Rules(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(row, measures...): row is a struct of all the columns of docs, whatever their names.

    A null text has no words, so it fails the base rules as an empty one does.
    Null languages form a language of their own. A language without enough words
    to compare with leaves its documents to the base rules.
    """
    rows = docs.select(text.whole_row(docs), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    place = docs.columns.index(text_col)
    few = reference.count() <= LANGUAGES
    joined = rows.join((F.broadcast(reference) if few else reference).withColumnRenamed("n_words", "of_words"), "lang", "left")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, np.ndarray, dict[bytes, int], np.ndarray]] = {}
        for part in text.slices(batches, "row", field=place):
            words, langs = text.Words(pc.struct_field(part.column("row"), place)), part.column("lang").to_pylist()
            classes, repeated = _histograms(words), _repeated(words)
            characters = (CLASS[words.buf] >= 0) & text.SPACED[words.buf]
            inside = text.sums(characters, words.off)
            raw = words.buf.tobytes()
            char_js, word_js, lines = [], [], []
            for i, (lang, a, b, n) in enumerate(zip(langs, words.off, words.off[1:], words.count)):
                if lang not in known:
                    top = part.column("words")[i].as_py() or []
                    of, counts = part.column("of_words")[i].as_py() or 0, part.column("counts")[i].as_py() or []
                    known[lang] = (of, np.array(part.column("classes")[i].as_py() or [0]), {w.encode(): k for k, w in enumerate(top)}, np.array([*counts, of - sum(counts)], float))
                of, own, index, common = known[lang]
                lines.append(_duplicate_lines(raw[a:b]))
                enough = of >= rules.reference_min_words
                char_js.append(distance(classes[i], own) if enough and classes[i].sum() >= rules.class_min_chars else None)
                if enough and n >= rules.word_from:
                    hits = np.bincount(np.fromiter(map(index.get, raw[a:b].lower().split(), repeat(len(index))), np.int64, n), minlength=len(index) + 1)
                    word_js.append(distance(hits, common))
                else:
                    word_js.append(None)
            failed = (words.count < rules.min_words) | (100 * repeated > rules.max_repeat_percent * words.count)
            far = np.array([(c is not None and c > rules.class_limit) or (w is not None and w > rules.word_limit_at(n)) for c, w, n in zip(char_js, word_js, words.count.tolist())], bool)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(words.count), pa.array(inside), pa.array(classes[:, 4]), pa.array(lines, pa.int64()), pa.array(repeated), pa.array(char_js, pa.float64()), pa.array(word_js, pa.float64()), pa.array(failed), pa.array(~failed & ~far)],
                names=["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept"],
            )

    return joined.mapInArrow(measure, T.StructType([rows.schema["row"], *T.StructType.fromDDL(MEASURES)]))
