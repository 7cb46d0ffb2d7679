"""Spelling groups, repeated bytes and vector codes against brute-force versions, with odd rows, hot groups, small tiles and shards."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyloom.llm import queries, spelling, suffix_arrays, text, vector_codes

SCHEMA = "doc_id long, text string, word string, n long, k long, print string, root string, row string, x string"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "w", 1, 2, "p", "r", "row", "x") for i, t in zip(ids, texts)], SCHEMA).repartition(3)


# spelling


def slips(texts, ids, every):
    counts = Counter()
    for i, t in zip(ids, texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return counts


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_groups(texts, ids, every=199, least_letters=6, least_n=5, ratio=5):
    n = {w: c for w, c in slips(texts, ids, every).items() if len(w) >= least_letters and c >= least_n}
    near = {w: [o for o in n if abs(len(o) - len(w)) <= 1 and one_edit(w, o)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def variants(seed=1, n=120):
    rng = random.Random(seed)
    letters = "abcdeilnorstuéüÿ"
    stems = ["".join(rng.choice(letters) for _ in range(rng.choice([6, 7, 8, 11]))) for _ in range(25)] + ["x" * 70, "aabbcc", "abcabc"]
    pool = []
    for s in stems:
        pool += [s] * 60
        for share in (12, 3, 1):
            i = rng.randrange(len(s))
            w = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice(letters) + s[i + 1 :], s[:i] + rng.choice(letters) + s[i:]])
            pool += [w] * (4 * share)
            s = w
    texts = [None, "", "12 34", "×÷ ÉTÉS", "don’t 中文abcdef中", "short words only"]
    texts += [" ".join(rng.choice([str.upper, str, str, str.title])(rng.choice(pool)).replace("SS", "ss") + rng.choice(["", ".", ",-", "9"]) for _ in range(rng.choice([5, 40, 120]))) for _ in range(n)]
    return texts + [" ".join(rng.choice(pool) for _ in range(30_000)), "z" * 9000, "z" * 9000]


def groups_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("tile", [4, spelling.TILE])
def test_spelling_groups_equal_brute_force(spark, tile):
    texts = variants()
    ids = [None, 1, 1, *range(3, len(texts))]
    assert groups_of(spelling.groups(frame(spark, texts, ids), every=7, least_n=3, tile=tile)) == brute_groups(texts, ids, every=7, least_n=3)


def test_spelling_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = groups_of(queries.op11_spelling_groups(spark, "/root/testdata/sf0.001"))
    assert got == brute_groups([r["text"] for r in docs], [r["doc_id"] for r in docs]) and any(v[0] for v in got.values())


def test_spelling_of_empty_tables(spark):
    got = spelling.groups(frame(spark, ["x", None]).limit(0))
    assert got.count() == 0 and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.groups(frame(spark, [None, "", "a b"])).count() == 0


def test_a_block_of_anagrams_and_long_chains_of_forms(spark):
    words = ["abcdef", "abcdfe", "fedcba", "abcdeg", "bcdefg", "abcde" * 20, "abcde" * 20 + "a", "abcdx" + "abcde" * 19]
    chain = ["qqqqqq" + "r" * i for i in range(6)]
    texts = [" ".join([w] * n) for w, n in zip(words, [5, 25, 7, 125, 6, 5, 30, 200])] + [" ".join([w] * 5 ** (i + 1)) for i, w in enumerate(chain)]
    got = groups_of(spelling.groups(frame(spark, texts), every=10**9, least_n=1))
    assert got == brute_groups(texts, range(len(texts)), every=10**9, least_n=1)
    assert got[chain[0]][1] == chain[-1]


# repeated bytes


def brute_bytes(texts, width):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if count[d[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), len(d) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def repeats(seed=2, n=70):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gämma", "日本", "d", "epsilon\n", "\0", "z" * 30]
    text_of = lambda m: " ".join(rng.choice(words) for _ in range(m))
    passage = text_of(60)
    texts = [None, "", "tiny", "q" * 900, passage, passage]
    while len(texts) < n:
        t = text_of(rng.choice([3, 30, 90, 200]))
        kind = rng.randrange(6)
        if kind == 0:
            t = t[:50] + passage + t[50:]
        elif kind == 1 and texts[-1]:
            t = texts[-1]
        elif kind == 2 and texts[-1]:
            i = rng.randrange(len(texts[-1]))
            t = texts[-1][:i] + "#" + texts[-1][i:]
        elif kind == 3:
            t = t + passage[10:150] + t
        texts.append(t)
    return texts + [text_of(3000)]


def rows_of(df):
    return sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize("width,k,shard,group", [(400, 40, 1 << 20, 4 << 20), (120, 16, 2_000, 20_000), (100, 10, 700, 1_500), (64, 64, 300, 600), (50, 3, 200, 130)])
def test_removed_bytes_equal_brute_force(spark, width, k, shard, group):
    texts = repeats()
    got = suffix_arrays.remove_repeated_bytes(frame(spark, texts), width, k, shard, group)
    assert rows_of(got) == sorted(brute_bytes(texts, width))


def test_rows_without_an_id_and_with_equal_ids_are_documents_of_their_own(spark):
    texts = ["a" * 50 + str(i) for i in range(3)] + ["same text of some length, twice over"] * 2 + ["short"] * 2
    got = suffix_arrays.remove_repeated_bytes(frame(spark, texts, [None, None, 3, 3, 3, 4, 4]), 20, 8)
    assert rows_of(got) == sorted(brute_bytes(texts, 20))
    one = got.filter("n_bytes = 36").first()
    assert one["n_removed"] == 36 and one["spans"] == [0, 36] and bytes(one["kept"]) == b""
    assert suffix_arrays.remove_repeated_bytes(frame(spark, ["x"]).limit(0)).count() == 0


def test_one_passage_in_many_documents_is_split(spark):
    rng = random.Random(5)
    footer = "All rights reserved; see the notice at the end of this page. "
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(90)) + footer + "".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(300)]
    got = suffix_arrays.remove_repeated_bytes(frame(spark, texts), 80, 16, 1_000, 4_000)
    assert rows_of(got) == sorted(brute_bytes(texts, 80)) and all(r[1] == 0 for r in rows_of(got))


def test_repeated_bytes_query_on_the_smallest_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = brute_bytes([r["text"] for r in docs], 400)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op12_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r["doc_id"]: w for r, w in zip(docs, want)} and any(w[1] for w in want)


def test_suffix_arrays_order_and_prefixes():
    rng = random.Random(3)
    for _ in range(120):
        letters = rng.choice([b"a", b"ab", b"ab\0", bytes(range(256))])
        texts = [bytes(rng.choice(letters) for _ in range(rng.choice([0, 1, 7, 8, 9, 30, 90]))) for _ in range(rng.randrange(1, 6))]
        array = suffix_arrays.SuffixArray(texts)
        suffixes = {}
        for i, t in enumerate(texts):
            for j in range(len(t) + 1):
                suffixes[len(suffixes)] = ([b + 1_000 for b in t[j:]] + [i], t[j:])
        assert array.sorted.tolist() == sorted(suffixes, key=lambda p: suffixes[p][0])
        common = array.common()
        for a, b in zip(array.sorted.tolist(), array.sorted.tolist()[1:]):
            a, b_ = suffixes[a][1], suffixes[b][1]
            assert common[b] == next((i for i, (p, q) in enumerate(zip(a, b_)) if p != q), min(len(a), len(b_)))


# vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([v for _, v, _ in kept], np.int64).reshape(len(kept), parts, -1)
    first = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, kept[j][0] or 0, kept[j][1]))[:entries]
    books = [x[first, p] for p in range(parts)]

    def nearest(p):
        far = np.square(x[:, p, None, :] - books[p][None]).sum(2)
        return far.argmin(1), far.min(1)

    for _ in range(rounds):
        for p in range(parts):
            at, new = nearest(p)[0], books[p].copy()
            for e in np.unique(at):
                own = x[at == e, p]
                new[e] = own.sum(0) // len(own)
            books[p] = new
    found = [nearest(p) for p in range(parts)]
    error = sum(f[1] for f in found)
    total = defaultdict(int)
    for (_, _, label), e in zip(kept, error):
        total[label] += int(e)
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    codes = ["".join(f"{f[0][j]:02x}" for f in found) for j in range(len(kept))]
    return Counter((i, c, int(e), total[label], sha) for (i, _, label), c, e in zip(kept, codes, error))


VECTORS = "vec_id long, embedding array<float>, label int, x int, code string, low string"


def codes_of(df):
    return Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def vectors(seed, n, dims=16):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(7, dims))
    rows = [(i, [float(v) for v in np.float32(at[i % 7] + rng.normal(scale=0.3, size=dims))], None if i % 5 == 0 else i % 4) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [None] + [0.0] * (dims - 1), 1), (n + 2, [float("nan")] * dims, 2), (n + 3, [float("inf")] + [0.0] * (dims - 1), 2), (n + 4, [], 3)]
    return rows + [(None, rows[3][1], None), (3, rows[3][1], 1), (4, rows[9][1], 1)] + [(1000 + i, rows[11][1], 3) for i in range(60)]


@pytest.mark.parametrize("entries,n", [(256, 400), (20, 400), (256, 30), (1, 50)])
def test_vector_codes_equal_brute_force(spark, entries, n):
    rows = vectors(entries, n)
    df = spark.createDataFrame([(*r, 1, "c", "l") for r in rows], VECTORS).repartition(3)
    assert codes_of(vector_codes.encode(df, entries=entries)) == brute_codes(rows, entries=entries)


def test_vector_codes_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert codes_of(queries.op13_vector_codes(spark, "/root/testdata/sf0.001")) == brute_codes(rows)


def test_bounds_spare_scans_and_lose_nothing():
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(size=(600, 8)) * 200 + rng.integers(0, 6, 600)[:, None] * 900)
    books, held = [x[:64].copy()], (None, None, None)
    scanned = []
    for _ in range(6):
        at, best, low, stamp, tried = vector_codes.nearest(x, books, *held)
        far = np.square(x[:, None] - books[-1][None]).sum(2)
        assert (at == far.argmin(1)).all() and (best == far.min(1)).all()
        for i, book in enumerate(books):  # a bound holds for every entry of its block but the one held
            net = np.sqrt(np.square(books[-1] - book).sum(1))
            for g in range(4):
                own = np.flatnonzero(stamp[:, g] == i)
                entries = np.arange(16 * g, 16 * g + 16)
                true = np.sqrt(far[own][:, entries]) + net[entries].max() + 1e-6
                true[at[own][:, None] == entries] = np.inf
                assert (low[own, g, None] <= true).all()
        held = at, low.astype(float), stamp
        scanned.append(tried.sum())
        new = books[-1].copy()
        for e in np.unique(at):
            new[e] = x[at == e].sum(0) // (at == e).sum()
        books.append(new)
    assert scanned[0] == 600 * 64 and sum(scanned[1:]) < 5 * scanned[0] / 2


def test_vectors_of_odd_lengths_and_empty_tables(spark):
    rows = [(1, [0.5] * 8, 1, 1, "c", "l"), (2, [0.25] * 8, 1, 1, "c", "l"), (3, [1.0] * 4, 1, 1, "c", "l"), (4, [1.0] * 7, 1, 1, "c", "l"), (5, [1e30] * 8, None, 1, "c", "l")]
    got = {r["vec_id"]: r["code"] for r in vector_codes.encode(spark.createDataFrame(rows, VECTORS)).collect()}
    assert set(got) == {1, 2, 5} and got[1] == "00000000"
    empty = vector_codes.encode(spark.createDataFrame(rows, VECTORS).filter("vec_id > 9"))
    assert empty.count() == 0 and "codebooks_sha256" in empty.columns
    with pytest.raises(ValueError):
        vector_codes.encode(empty, entries=300)


def test_rolling_hashes_and_running_minima():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 50, 97).astype(np.uint64)
    for w in (1, 2, 7, 97, 98):
        assert suffix_arrays.smallest(v, w).tolist() == [min(v[i : i + w].tolist()) for i in range(len(v) - w + 1)]
    buf = np.frombuffer(b"abcabcabcabd", np.uint8)
    roll = suffix_arrays.Rolling(buf, 1)
    h = roll.of(np.arange(10), np.arange(10) + 3)
    assert h[0] == h[3] == h[6] != h[9] and h[1] == h[4]


def test_crcs_and_runs():
    texts = ["Aéb c9d", "", "ÿx", "no©pe Āa"]
    import pyarrow as pa

    buf, off = text.flat(pa.array(texts))
    start, end, size = spelling.runs(buf, off)
    assert [buf[a:b].tobytes().decode() for a, b in zip(start, end)] == ["Aéb", "c", "d", "ÿx", "no", "pe", "a"]
    assert size.tolist() == [3, 1, 1, 2, 2, 2, 1]
    before = np.array([zlib.crc32(b"12:")] * len(start), np.uint32)
    assert spelling.crcs(buf, start, end, before).tolist() == [zlib.crc32(b"12:" + buf[a:b].tobytes()) for a, b in zip(start, end)]
