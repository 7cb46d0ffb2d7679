"""Documents whose sets of word shingles have a Jaccard similarity of a threshold or more, and the groups they form.

Two sets of sizes a <= b link only if their symmetric difference is at most
H = (a + b)(1 - t)/(1 + t). Sets are banded by size so that links stay in a band
or reach the next one, and every band has its H. The universe of shingles is
dealt out into segments by a hash. If m segments are compared whole and x of
them are also compared but for one deletion, a pair that agrees nowhere
differs by at least m + x, so m + x = H + 1 finds every link. With u more, a
link agrees in at least u + 1 segments, so a set of no more than u empty ones
need not be found by those, which many sets share; and a share more than that
gives every set a number of signatures (floor) that any link of its shares. How
many segments get deletions is the choice of least cost for a band: more of them
make fewer and longer segments, with more signatures but fewer chance agreements.

Documents that share a signature are candidates. What shares fewer signatures
than its floor is left out, and the rest meets on all signatures of a set but its
last floor - 1 in one order. Buckets are not expanded into pairs: each is tied
to the member that shares most with others, candidates are verified by their
whole sets, and members that are then still in different components are
compared only if they differ from that member in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache, reduce
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, scratch, text

#: One verified candidate costs as much as so many signatures.
VERIFY_COST = 200

#: Of a band's largest difference, one in so many segments is added, so that every link shares some signatures and not just one.
SURPLUS = 8

SIGNED = "doc_id long, words_key binary, n_shingles long, back int, floor long, alone array<long>, led array<long>, again array<long>"


def bands(t: Fraction, longest: int) -> tuple[tuple[int, int, int], ...]:
    """(smallest size, largest size, H) of each band, up to the size given or more. A link's smaller set is in its band."""
    return _bands(t, int(longest).bit_length())


@lru_cache(maxsize=None)
def _bands(t: Fraction, bits: int) -> tuple[tuple[int, int, int], ...]:
    out, lo = [], 1
    while lo <= 1 << bits:
        hi = int(lo / t / t)
        out.append((lo, hi, int((hi + int(hi / t)) * (1 - t) / (1 + t))))
        lo = hi + 1
    return tuple(out)


#: Unrelated sets agree in a segment of one shingle once in so many times.
RARE = 1_000_000


def spare(size: int, segments: int) -> int:
    """Empty segments that few sets of a size have more of."""
    mean = segments * exp(-size / segments)
    return ceil(mean + 3 * sqrt(mean))


def allocate(size: int, difference: int, documents: int) -> int:
    """Of segments that get one-deletion neighbourhoods, the number of least expected cost: signatures of all documents
    and verified candidates that agree by chance, in segments of one shingle."""

    def cost(x: int) -> float:
        m = difference + 1 - x
        fill = size / m
        chance = exp(-2 * fill) * (fill * fill + x / m) / RARE
        return documents * (m + x * fill) + VERIFY_COST * documents**2 / 2 * chance * m

    return min(range((difference + 1) // 2 + 1), key=cost)


def _counted(docs: DataFrame, k: int, t: Fraction) -> dict[int, int]:
    """Documents of each band, by their word counts; as many rows as bands, so a few hundred at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for part in text.slices(batches, "x"):
            n = np.maximum(1, text.Words(part.column("x"), text.SPACED).count - k + 1)
            top = bands(t, int(n.max(initial=1)))
            for band, many in zip(*np.unique(np.searchsorted([b[1] for b in top], n), return_counts=True)):
                total[int(band)] = total.get(int(band), 0) + int(many)
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["band", "n"])

    rows = docs.select("x").mapInArrow(count, "band long, n long").groupBy("band").agg(F.sum("n").alias("n")).collect()
    return {r["band"]: r["n"] for r in rows}


def shingle_sets(words: text.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a slice's texts, the distinct shingle hashes (of the whole sequence where there are fewer than k words)
    in order, and the text of each."""
    grams, ok = words.grams(k)
    h, owner = grams[ok], words.text[ok]
    for i in np.flatnonzero((words.count > 0) & (words.count < k)):
        short = text.fold(words.hash[words.first[i] : words.first[i + 1]], int(words.count[i]))
        h, owner = np.concatenate([h, short]), np.concatenate([owner, [i]])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


def _signatures(h: np.ndarray, owner: np.ndarray, group: np.ndarray, m: np.ndarray, x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets within one of their groups; group, m, x and u are per set, owner is the set of each hash."""
    at = np.repeat(np.concatenate([[0], np.cumsum(m)[:-1]]), m)
    cell = (np.cumsum(m) - m)[owner] + (text.mix(h) % m[owner].astype(np.uint64)).astype(np.int64)
    # a segment's value is the sum of its hashes, so that a deletion is a subtraction
    value = np.zeros(int(m.sum()), np.uint64)
    order = np.argsort(cell, kind="stable")
    cell, own, weight = cell[order], owner[order], text.mix(h[order] ^ np.uint64(0x5851F42D4C957F2D))
    begin = np.flatnonzero(np.diff(cell, prepend=-1))
    if len(begin):
        value[cell[begin]] = np.add.reduceat(weight, begin)
    segment = np.arange(len(value)) - at
    sets = np.repeat(np.arange(len(m)), m)
    salt = text.mix((group[sets].astype(np.uint64) << np.uint64(32)) + segment.astype(np.uint64))
    near = segment[cell] < x[own]
    lost = text.mix((value[cell[near]] - weight[near]) ^ salt[cell[near]])
    empty = np.bincount(cell, minlength=len(value)) == 0
    # an empty segment of those with deletions counts twice, as it would if it had some to share
    none = empty & (segment < x[sets])
    bare = empty & (segment >= x[sets])
    shown = ~bare | (np.bincount(sets, bare, len(m)) > u)[sets]
    return np.concatenate([text.mix(value ^ salt)[shown], lost, text.mix(~salt[none])]), np.concatenate([sets[shown], own[near], sets[none]])


#: Times that sets which share too few signatures are left out.
PEELS = 3
#: Keys of texts that a task remembers to sign equal ones once; beyond, it forgets them, which costs signatures but no result.
REMEMBERED = 200_000


def sign(docs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """docs(k, x) -> a row for each (back 0), and for each that a smaller set of the band below may link to another (back 1).

    A row has the size, a key of the words, the number of signatures that the
    set must share to link with any other (floor), and its signatures: those
    that no other set of the slice has (alone), those that others have which
    come later in the slice (led), and those that earlier ones have (again), so
    that of a signature that many sets share few rows have to meet.
    A text whose words the same task has met before has no signatures, as equal
    words share a class anyway. Rows without an id have none either, and none
    counts as met for their words.
    """
    population = _counted(docs, k, t)
    chosen: dict[int, tuple[int, int, int]] = {}

    def plan(band: int, top: tuple) -> tuple[int, int, int]:
        if band not in chosen:
            lo, hi, difference = top[band]
            difference += difference // SURPLUS
            x = allocate((lo + hi) // 2, difference, population.get(band, 0) + population.get(band + 1, 0))
            u = spare(lo, difference + 1 - x)
            u = spare(lo, difference + 1 - x + u)
            chosen[band] = (difference + 1 - x + u, x, u)
        return chosen[band]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for part in text.slices(batches, "x"):
            words = text.Words(part.column("x"), text.SPACED, lower=True)
            h, owner = shingle_sets(words, k)
            size = np.bincount(owner, minlength=words.n_texts)
            raw = words.buf.tobytes()
            keys = [hashlib.blake2b(b" ".join(raw[a:b].lower().split()), digest_size=16).digest() if n else None for a, b, n in zip(words.off, words.off[1:], size)]
            first = np.zeros(words.n_texts, bool)
            for i, (key, named) in enumerate(zip(keys, part.column("k").is_valid().to_pylist())):
                if named and key is not None and key not in met:
                    met.add(key)
                    first[i] = True
            if len(met) > REMEMBERED:
                met.clear()
            top = bands(t, int(size.max(initial=1)))
            home = np.searchsorted([b[1] for b in top], size)
            limits = np.array([(b[1], b[2] + b[2] // SURPLUS, int(b[1] / t)) for b in top], np.int64)
            reached = (home > 0) & (size <= limits[np.maximum(home - 1, 0), 2])
            doc = np.concatenate([np.arange(words.n_texts), np.flatnonzero(reached)])
            back = (np.arange(len(doc)) >= words.n_texts).astype(np.int32)
            band = home[doc] - back
            # a link's sizes are size and at most size / t, or at most the band's largest and size
            other = np.where(back, limits[band, 0], size[doc] * t.denominator // t.numerator)
            floor = np.maximum(1, limits[band, 1] + 1 - (size[doc] + other) * (t.denominator - t.numerator) // (t.denominator + t.numerator))
            found, of = [], []
            for b in (0, 1):
                units = np.flatnonzero(first[doc] & (back == b))
                if not len(units):
                    continue
                number = np.full(words.n_texts, -1)
                number[doc[units]] = np.arange(len(units))
                mine = number[owner] >= 0
                split = np.array([plan(int(i), top) for i in band[units]], np.int64)
                got, whose = _signatures(h[mine], number[owner[mine]], band[units], *split.T)
                found.append(got)
                of.append(units[whose])
            got, whose = (np.concatenate(found), np.concatenate(of)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            order = np.argsort(got, kind="stable")
            got, whose = got[order], whose[order]
            later, sooner = np.zeros(len(got), bool), np.zeros(len(got), bool)
            sooner[1:] = later[:-1] = got[1:] == got[:-1]
            columns = []
            for which in (~sooner & ~later[: len(got)], ~sooner & later, sooner):
                mine = np.flatnonzero(which)
                mine = mine[np.argsort(whose[mine], kind="stable")]
                ends = np.concatenate([[0], np.cumsum(np.bincount(whose[mine], minlength=len(doc)))]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(ends, pa.array(got[mine].view(np.int64))))
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [part.column("k").take(at), pa.array(keys, pa.binary()).take(at), pa.array(size[doc].astype(np.int64)), pa.array(back), pa.array(floor.astype(np.int64)), *columns],
                names=["doc_id", "words_key", "n_shingles", "back", "floor", "alone", "led", "again"],
            )

    return docs.mapInArrow(rows, SIGNED)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, "x"):
            h, owner = shingle_sets(text.Words(part.column("x"), text.SPACED, lower=True), k)
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=part.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64)))], names=["doc_id", "shingles"])

    return docs.mapInArrow(rows, "doc_id long, shingles array<long>")


def _sets_of(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles) of all documents of the pairs (u, v)."""
    ids = scratch.written(pairs.select(F.explode(F.array("u", "v")).alias("k")).distinct(), "candidates")
    return scratch.written(_sets(docs.join(ids, "k", "left_semi"), k), "sets")


def _measured(spokes: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Spokes (u, v) with size_u, size_v, linked, and differ: the shingles that one of them has and the other lacks."""
    a = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b"))
    rows = spokes.join(a, "u").join(b, "v").select("u", "v", F.size("a").alias("size_u"), F.size("b").alias("size_v"), F.concat(F.array_except("a", "b"), F.array_except("b", "a")).alias("differ"))
    return rows.withColumn("linked", _links(F.col("size_u"), F.col("size_v"), F.size("differ"), t))


def _links(a: Column, b: Column, differ: Column, t: Fraction) -> Column:
    """Whether sets of these sizes and this symmetric difference link. Twice what they share is a + b - differ, twice the union a + b + differ."""
    return (a + b - differ).cast("long") * t.denominator >= (a + b + differ).cast("long") * t.numerator


def _residual(spokes: DataFrame, t: Fraction) -> DataFrame:
    """Links (u, v) among documents that share a centre c but not a component, from spokes(u, v, part, size_u, size_v, differ, linked).

    The difference of x and y is differ_x + differ_y less twice what these, their
    differences from c, have in common; a link needs it to be at most
    H(x, y), the floor of (|x| + |y|)(1 - t)/(1 + t). One of them, x, isn't linked
    to c, so |differ_x| > H(x, c), and they must share
    - (|differ_x| - H(x, c))/2 or more, as |differ_y| makes up for what y has more than c,
    - (|differ_y| + 1 + floor((|c| - |y|)(1 - t)/(1 + t)))/2 or more, and
      the same with x if y isn't linked to c either;
    one at least in any case. Sets that must share n shingles meet if each keeps
    all but its last n - 1 in one order: first those that one component alone
    has, then rare ones.
    """
    p, q = t.denominator - t.numerator, t.denominator + t.numerator
    n = F.size("differ")
    of = spokes.withColumns({
        "strict": n + 1 - F.greatest(F.lit(1), F.ceil((n + 1 + F.floor((F.col("size_v") - F.col("size_u")) * p / q)) / 2)),
        "loose": n + 1 - F.greatest(F.lit(1), F.ceil((n - F.floor((F.col("size_u") + F.col("size_v")) * p / q)) / 2)),
    })
    spark = spokes.sparkSession
    tokens = scratch.written(of.select("v", "u", "part", "linked", "size_u", "strict", "loose", n.alias("all"), F.explode("differ").alias("token")), "tokens")
    scratch.released(spark)
    keys = ["v", "token"]
    counts = tokens.groupBy(*keys, "part").agg(F.count("*").alias("n")).groupBy(*keys)
    counts = counts.agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("n"), (F.count("*") > 1).alias("mixed"))
    # shingles of one component come first in the order and lead nowhere, so only their number is needed
    counts = scratch.written(counts.filter("mixed").drop("mixed"), "counts")
    scratch.released(spark)
    own = Window.partitionBy("v", "u")
    rank = F.col("all") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "token"))
    ranked = tokens.join(counts, keys).withColumn("rank", rank).filter(F.col("rank") <= F.when(F.col("linked"), F.col("strict")).otherwise(F.greatest("strict", "loose")))
    ranked = scratch.written(ranked.select(*keys, "u", "part", "linked", "size_u", (F.col("part") == F.col("most.part")).alias("main"), (F.col("rank") <= F.col("strict")).alias("strict")), "meeting")
    scratch.dropped(tokens, counts)
    scratch.released(spark)
    left = ranked.filter("not linked")
    right = ranked.filter("strict").select(*keys, F.col("u").alias("w"), F.col("part").alias("w_part"), F.col("linked").alias("w_linked"), F.col("size_u").alias("w_size"), F.col("main").alias("w_main"))
    # many rows of a token may be of one part; the part with most of them never meets itself
    pairs = left.filter("not main").join(right, keys).union(left.filter("main").join(right.filter("not w_main"), keys))
    near = (F.col("w_size") * t.denominator >= F.col("size_u") * t.numerator) & (F.col("size_u") * t.denominator >= F.col("w_size") * t.numerator)
    pairs = pairs.filter((F.col("part") != F.col("w_part")) & (F.col("w_linked") | F.col("strict")) & near)
    pairs = pairs.groupBy(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("w")).agg(F.min("v").alias("v"))
    one = spokes.select("v", "u", "size_u", F.col("differ").alias("a"))
    other = spokes.select("v", F.col("u").alias("w"), F.col("size_u").alias("size_w"), F.col("differ").alias("b"))
    apart = F.size("a") + F.size("b") - 2 * F.size(F.array_intersect("a", "b"))
    pairs = scratch.written(pairs, "rest")
    scratch.released(spark)
    return pairs.join(one, ["v", "u"]).join(other, ["v", "w"]).filter(_links(F.col("size_u"), F.col("size_w"), apart, t)).select("u", F.col("w").alias("v"))


#: Signatures meet in so many rounds, by their remainder, so that disk holds the shuffle files of one at a time.
ROUNDS = 2


def _shared(signed: DataFrame, turn: int) -> DataFrame:
    """(sig, doc_id, back) of the signatures of a round that sets share, or that a slice knows to be shared."""
    known = signed.filter("doc_id is not null and words_key is not null")
    mine = F.pmod("sig", F.lit(ROUNDS)) == turn
    one = known.select("doc_id", "back", F.lit(False).alias("led"), F.explode("alone").alias("sig"))
    more = known.select("doc_id", "back", F.lit(True).alias("led"), F.explode("led").alias("sig"))
    every = Window.partitionBy("sig")
    met = one.union(more).filter(mine).withColumns({"n": F.count("*").over(every), "some": F.max("led").over(every)}).filter("n > 1 or some").select("sig", "doc_id", "back")
    return met.union(known.select(F.explode("again").alias("sig"), "doc_id", "back").filter(mine).select("sig", "doc_id", "back"))


def _peeled(buckets: DataFrame, floors: DataFrame, parts: DataFrame) -> DataFrame:
    """buckets(sig, doc_id, back) without what can't lead to a link between different parts; parts(doc_id, part), a document
    that isn't there is a part of its own. The table given is dropped.

    Two sets that link share at least `floor` signatures in the band that they
    meet in. So of buckets with several parts, a set stays only where it shares so
    many; that is done again and again, as it takes partners from others. How
    often changes the work and not the result."""
    now = scratch.replaced(buckets, buckets.drop("part").join(parts, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id")), "open")
    rows = None
    for _ in range(PEELS):
        split = now.groupBy("sig").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select("sig")
        live = now.join(split, "sig")
        enough = live.groupBy("doc_id", "back").agg(F.count("*").alias("n")).join(floors, ["doc_id", "back"]).filter("n >= floor").select("doc_id", "back")
        now = scratch.replaced(now, live.join(enough, ["doc_id", "back"]).select(*now.columns), "open")
        before, rows = rows, now.count()
        if rows in (before, 0):  # nothing more to leave out
            break
    return now


def _spokes(buckets: DataFrame, floors: DataFrame) -> DataFrame:
    """(sig, u, back, v): the members of each bucket and its centre v, the member whose signatures most others share (the
    smallest id of equals).

    Sets that share `floor` of their signatures or more meet even if each leaves
    out its last floor - 1 in one order of all signatures, here those of the
    largest buckets."""
    sizes = buckets.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1")
    ranked = buckets.join(sizes, "sig").join(floors, ["doc_id", "back"])
    own = Window.partitionBy("doc_id", "back")
    first = ranked.withColumns({"rank": F.row_number().over(own.orderBy("n", "sig")), "all": F.count("*").over(own)}).filter(F.col("rank") <= F.col("all") - F.col("floor") + 1)
    front = scratch.written(first.select("sig", "doc_id", "back"), "front")
    live = front.join(front.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1"), "sig")
    weight = live.groupBy("doc_id").agg(F.sum("n").alias("w"))
    centre = live.join(weight, "doc_id").groupBy("sig").agg(F.max(F.struct("w", (-F.col("doc_id")).alias("c"))).alias("top")).select("sig", (-F.col("top.c")).alias("v"))
    return scratch.written(live.join(centre, "sig").filter("doc_id <> v").select("sig", F.col("doc_id").alias("u"), "back", "v"), "spoked")


def _numbered(docs: DataFrame) -> DataFrame | None:
    """docs(k, x) with a number for each row, if ids repeat."""
    if docs.filter("k is not null").groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return None
    return scratch.written(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")


def jaccard_groups(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A
    text of fewer than k words is one shingle; an empty or null one has none
    and links with nothing. Ids are whole numbers, or strings of such. Rows of
    equal id are one node, even if they have no words. A row whose id is null
    stays, with a null component. Other columns are left out.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("x"))
    if (rows := _numbered(docs)) is None:
        signed, links = _linked(docs, k, threshold)
        whole = graph.components(links)
        out = signed.join(whole.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    named = rows.filter("k is not null")
    signed, links = _linked(named.select(F.col("row").alias("k"), "x"), k, threshold)
    same = named.select("row", "k").join(named.groupBy("k").agg(F.min("row").alias("least")), "k").select(F.col("row").alias("u"), F.col("least").alias("v"))
    whole = graph.components(links.union(same)).withColumnRenamed("node", "row")
    parted = named.select("row", "k").join(whole, "row", "left").select("row", "k", F.coalesce("component", "row").alias("part"))
    least = parted.groupBy("part").agg(F.min("k").alias("component_id"))
    out = parted.join(least, "part").join(signed.withColumnRenamed("doc_id", "row"), "row").select(F.col("k").alias("doc_id"), "n_shingles", "component_id")
    unnamed = sign(rows.filter("k is null").select("k", "x"), k, threshold).filter("back = 0")
    return out.union(unnamed.select("doc_id", "n_shingles", "doc_id"))


def _linked(docs: DataFrame, k: int, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """docs(k, x) whose ids are different or null -> (doc_id, n_shingles) of all rows, and links (u, v) that tie each group together."""
    spark = docs.sparkSession
    signed = scratch.written(sign(docs, k, t), "signed")
    sizes = scratch.written(signed.filter("back = 0").select("doc_id", "n_shingles"), "sizes")
    known = signed.filter("back = 0 and doc_id is not null and words_key is not null").select("doc_id", "words_key")
    classes = scratch.written(known.groupBy("words_key").agg(F.min("doc_id").alias("rep")), "reps")
    member = scratch.written(known.join(classes, "words_key").select("doc_id", "rep"), "classes")
    floors = scratch.written(signed.join(member.filter("doc_id = rep"), "doc_id").select("doc_id", "back", "floor"), "floors")
    shared = []
    for turn in range(ROUNDS):
        shared.append(scratch.written(_shared(signed, turn), "shared"))
        scratch.released(spark)
    scratch.dropped(signed, classes)
    buckets = scratch.written(reduce(DataFrame.union, shared).join(member, "doc_id").select("sig", F.col("rep").alias("doc_id"), "back").distinct(), "buckets")
    scratch.dropped(*shared)
    scratch.released(spark)
    buckets = _peeled(buckets, floors, member.select("doc_id", F.col("rep").alias("part")))
    scratch.released(spark)

    spoked = _spokes(buckets, floors)
    scratch.released(spark)
    spokes = scratch.written(spoked.select("u", "v").distinct(), "spokes")
    sets = _sets_of(docs, spokes, k)
    measured = scratch.written(_measured(spokes, sets, t), "measured")
    scratch.dropped(sets)
    scratch.released(spark)
    copies = member.filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    links = measured.filter("linked").select("u", "v").union(copies)
    parts = scratch.written(graph.components(links), "parts").select(F.col("node").alias("doc_id"), F.col("component").alias("part"))

    # what stars can't tie: members of one bucket in different components
    buckets = _peeled(buckets, floors, parts)
    if buckets.isEmpty():
        return sizes, links
    alive = buckets.select(F.col("doc_id").alias("u"), "back", "part").distinct()
    named = spoked.join(alive, ["u", "back"])
    split = named.groupBy("sig").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select("sig")
    open_spokes = scratch.written(named.join(split, "sig").select("u", "v", "part").distinct().join(measured, ["u", "v"]), "open_spokes")
    scratch.released(spark)
    if open_spokes.isEmpty():
        return sizes, links
    more = _residual(open_spokes, t)
    return sizes, links.union(more)
