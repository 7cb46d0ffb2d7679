"""Every text operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import classifier, decontaminate, encode, graph, jaccard, licenses, mixing, quality_rules, queries, records, substring, text, token_counts, urls

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, k string, start int, component_id string"


def corpus(seed=1, n=60):
    """Texts of a small vocabulary: copies, near copies, shared passages, odd white space, other alphabets, one long text."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "naïve", "日本", "x|y", "A.B", "THE!!"]
    words = lambda m: [rng.choice(vocabulary) for _ in range(m)]
    passage = words(30)
    texts = [None, "", " \n\t ", "one", "two  words", "a b c"]
    while len(texts) < n:
        kind = rng.randrange(6)
        w = words(rng.choice([3, 9, 25, 60, 120]))
        if kind == 0:
            w = w[:10] + passage + w[10:]
        if kind == 1 and any(texts[6:]):
            w = rng.choice(texts[6:]).split()
            if rng.random() < 0.7:
                w[rng.randrange(len(w))] = "edit"
        texts.append(rng.choice([" ", "  ", "\n", " \n "]).join(w) if kind == 2 else " ".join(w))
    texts.append(" ".join(words(20_000)))
    return texts


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, [None, "en", "fr"][j % 3], [None, "src0", "src7", "src12"][j % 4], len(t or ""), "r", "k", 1, "c") for j, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return corpus()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def alnum_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


# words and hashes


def test_words_are_those_of_the_patterns(texts):
    col = pa.array(texts, pa.string())
    for kind, own in ((text.SPACED, space_words), (text.ALNUM, lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or ""))):
        w = text.Words(col, kind)
        raw = w.buf.tobytes()
        got = defaultdict(list)
        for a, b, i in zip(w.start, w.end, w.text):
            got[i].append(raw[a:b].decode())
        assert [got[i] for i in range(len(texts))] == [own(t) for t in texts]


def test_hashes_are_equal_exactly_for_equal_words_and_grams(texts):
    w = text.Words(pa.array(texts, pa.string()))
    raw = w.buf.tobytes()
    names = [raw[a:b] for a, b in zip(w.start, w.end)]
    assert len(set(zip(names, w.hash.tolist()))) == len(set(names)) == len(set(w.hash.tolist()))
    h, ok = w.grams(3)
    grams = {(tuple(names[i : i + 3]), int(h[i])) for i in np.flatnonzero(ok)}
    assert len(grams) == len({g for g, _ in grams}) == len({x for _, x in grams})


def test_equal_windows_keep_the_same_gram():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 5, 200).astype(np.uint64)
    starts, best = text.winnow(h, np.ones(200, bool), 6)
    kept = {}
    for s, b in zip(starts, best):
        assert kept.setdefault(tuple(h[s : s + 6]), b - s) == b - s


# tokens


MARKED = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y \n z", "<|endof", "text|>"]


def library_ids(texts, special=True, path=BPE):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = not special
    return [own.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.fixture(scope="module")
def encoded(texts):
    return library_ids([*texts, *MARKED])


def thue_morse(n=2048):
    """Two words of letters a and b whose polynomial hashes modulo 2**64 are equal for every odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_made_to_collide_do_not(spark):
    one, two = thue_morse()
    assert len(set(text.Words(pa.array([f"{one} {two} {one[:9]} {two[:9]}"])).hash.tolist())) == 4
    col = pa.array([f" {one} {two}", one, two, f"é{one}"])
    ids, places = encode.Encoder(BPE)(col)
    assert [ids[a:b].tolist() for a, b in zip(places, places[1:])] == library_ids(col.to_pylist())
    same = " ".join(f"v{i}" for i in range(19))
    got = by_id(substring.remove_repeats(frame(spark, [f"{same} {one}", f"{same} {two}", f"x {same} {one}"])))
    assert [got[i]["n_removed"] for i in range(3)] == [0, 0, 20]
    got = by_id(jaccard.jaccard_groups(frame(spark, [one, two, one]), 3, Fraction(9, 10)))
    assert [got[i]["component_id"] for i in range(3)] == [0, 1, 0]
    rules = quality_rules.Rules()
    docs = frame(spark, [f"p {one} q p {two} q", f"p {one} q p {one} q"])
    assert [r["n_repeat_words"] for r in quality_rules.judge(docs, quality_rules.references(docs, rules), rules).orderBy("row.doc_id").collect()] == [0, 6]


def test_encoder_gives_the_librarys_ids(monkeypatch):
    rng = random.Random(5)
    letters = ["a", "B", "é", "日", "7", " ", "  ", "\n", "\t", "\u00a0", "'s", "'", "!", "\u2003", "<|endoftext|>", "🙂", "\x00"]
    values = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(3000)] + [None, "", *MARKED]
    monkeypatch.setattr(encode, "KEPT", 50)
    for special in (True, False):
        own = encode.Encoder(BPE, special)
        for at in range(0, len(values), 100):
            part = values[at : at + 100]
            ids, places = own(pa.array(part, pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(places, places[1:])] == library_ids(part, special)


def test_other_kinds_of_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    own = encode.Encoder(path)
    values = ["Some  words", None, "naïve <|endoftext|> x"]
    ids, places = own(pa.array(values, pa.string()))
    assert not own.parted and [ids[a:b].tolist() for a, b in zip(places, places[1:])] == library_ids(values, path=path)


def test_token_counts_by_separator_scan(spark, texts):
    values = [*texts, *MARKED]
    got = token_counts.token_counts(frame(spark, values), BPE, 50256, block_tokens=1000).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == [(i, len(x)) for i, x in enumerate(library_ids(values, special=False))] and all(r["ended"] for r in got)


def test_token_counts_of_null_and_repeated_ids_and_no_rows(spark):
    docs = frame(spark, ["b", "a c", None, "b"], [None, 5, 5, None])
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.token_counts(docs, BPE, 50256).collect()) == [("5", 0), ("5", 2), ("None", 1), ("None", 1)]
    assert token_counts.token_counts(docs.limit(0), BPE, 50256).count() == 0


def test_separator_scan_of_files_without_a_catalogue(spark, tmp_path):
    rng = np.random.default_rng(3)
    want = {}
    for name, size in (("a.bin", 5000), ("b.bin", 1), ("c.bin", 0), ("d.bin", 3000)):
        ids = rng.integers(1, 9, size).astype("<u2")
        ids[rng.random(size) < (0.001 if name == "a.bin" else 0.2)] = 0
        (tmp_path / name).write_bytes(ids.tobytes())
        parts = np.split(ids, np.flatnonzero(ids == 0) + 1)
        want[name] = [(len(p) - 1, True) for p in parts[:-1]] + ([(len(parts[-1]), False)] if len(parts[-1]) else [])
    files = token_counts.flat_files(spark, f"file://{tmp_path}")
    got = defaultdict(list)
    for r in token_counts.document_spans(token_counts.scan_blocks(files, 0, block_tokens=128)).orderBy("file", "ordinal").collect():
        got[r["file"].rpartition("/")[2]].append((r["n_tokens"], r["ended"]))
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_records_round_trip(spark, texts, encoded):
    got = records.token_records(frame(spark, [*texts, *MARKED]), BPE).orderBy("start").collect()
    start = 0
    for i, (ids, r) in enumerate(zip(encoded, got)):
        ids = [*ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(encoded)
    assert records.token_records(frame(spark, ["a"]).limit(0), BPE).count() == 0


def test_records_keep_null_and_repeated_ids(spark):
    got = records.token_records(frame(spark, ["b", "a", None], [None, 5, 5]), BPE).orderBy("start").collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == [(None, 2), (5, 1), (5, 2)]


def test_records_are_read_in_a_shuffled_order_by_the_index(spark, texts, encoded, monkeypatch, tmp_path):
    monkeypatch.setattr(records, "LOOKED_UP", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shards = records.write_records(frame(spark, [*texts, *MARKED], [None, None, *range(2, len(texts) + len(MARKED))]), f"file://{tmp_path}", BPE)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    one, two = (records.read_shuffled(shards, seed).collect() for seed in (1, 2))
    assert shards.count() > 1
    assert [r["place"] for r in one] == sorted(r["place"] for r in one) and [r["doc_id"] for r in one] != [r["doc_id"] for r in two]
    for got in (one, two):
        assert sorted((r["shard"], r["position"]) for r in got) == sorted((r["shard"], r["position"]) for r in records.read_records(shards).collect())
        assert sorted(r["ids"] for r in got) == sorted([*map(int, ids), 2] for ids in encoded)
    again = records.read_shuffled(shards.repartition(1), 1).coalesce(1).collect()
    assert again == one
    assert {r["doc_id"]: r["ids"] for r in one}[5] == [*map(int, encoded[5]), 2]
    damaged = shards.first()["data"].removeprefix("file://")
    with open(damaged, "r+b") as f:
        f.seek(14)
        b = f.read(1)[0]
        f.seek(14)
        f.write(bytes([b ^ 1]))
    with pytest.raises(Exception, match="checksum"):
        records.read_shuffled(shards, 1).collect()
    assert records.read_shuffled(shards.limit(0), 1).count() == 0


def test_damaged_records_are_refused():
    framed = bytearray(records.frame(b"payload"))
    assert records.unframe(bytes(framed)) == (b"payload", len(framed))
    for i in (0, 9, 13, len(framed) - 1):
        bad = bytearray(framed)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad))
    with pytest.raises(ValueError):
        records.unframe(bytes(framed[:-1]))


# decontamination


def brute_contamination(t, items, window=10):
    words = alnum_words(t)
    hit, found = set(), set()
    for item, it in items:
        w = alnum_words(it)
        n = min(window, len(w))
        own = {tuple(w[s : s + n]) for s in range(len(w) - n + 1)} if w else set()
        for s in range(len(words) - n + 1):
            if tuple(words[s : s + n]) in own:
                hit |= set(range(s, s + n))
                found.add(item)
    named = sorted(str(i) for i in found if i is not None)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(named).encode()).hexdigest()


def test_print_filter_has_every_print_and_few_others(spark):
    rng = np.random.default_rng(2)
    h = rng.integers(-(2**63), 2**63 - 1, 5000)
    held = decontaminate.print_filter(spark.createDataFrame([(int(v),) for v in h], "print long"), 1 << 20)
    assert decontaminate.may_have(held, h).all()
    assert decontaminate.may_have(held, rng.integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.001
    assert not decontaminate.may_have(decontaminate.print_filter(spark.createDataFrame([], "print long"), 1 << 10), h).any()


@pytest.mark.parametrize("bits", [1 << 27, 64])
def test_contamination(spark, texts, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)  # 64 bits let everything through
    long = [t for t in texts if t and len(t.split()) > 30]
    items = [(3, " ".join(long[0].split()[5:25]).upper()), (11, long[0][:80]), (2, long[1].replace(" ", ", ")), (7, "one"), (8, "w1 W2"), (9, None), (10, "!!"), (12, "one"), (None, long[1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.contamination(frame(spark, texts), bench))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == brute_contamination(t, items), i
        assert r["contaminated"] == (r["n_hit"] > 0)
    assert sum(r["contaminated"] for r in got.values()) > 3


def test_contamination_of_repeated_ids_and_empty_tables(spark):
    docs = frame(spark, ["one two", "three", "one two", None], [1, 1, None, None])
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_hit"]) for r in decontaminate.contamination(docs, bench).collect()) == [("1", 0), ("1", 2), ("None", 0), ("None", 2)]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert [r["n_items"] for r in decontaminate.contamination(docs, bench.limit(0)).collect()] == [0] * 4


# quality rules


def brute_quality(t):
    t = t or ""
    words = space_words(t)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {p for s in range(len(words) - 2) if grams[tuple(words[s : s + 3])] > 1 for p in (s, s + 1, s + 2)}
    lines = [x for x in t.split("\n") if space_words(x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed


def test_quality_base_measures(spark, texts):
    more = [*texts, "a b c\na b c\n\n a b c\nx", "Und " * 60, "l\r\nl\r\nl\n"]
    docs = frame(spark, more)
    got = {r["row"]["doc_id"]: r for r in quality_rules.judge(docs, quality_rules.references(docs)).collect()}
    for i, t in enumerate(more):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_quality(t), i
        assert not (r["base_failed"] and r["kept"])
        assert r["row"]["text"] == t and r["row"]["row"] == "r"


def test_divergent_documents_go_and_others_stay(spark):
    rng = random.Random(2)
    common = ["the", "of", "and", "to", "in", "a"]
    clean = lambda: " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(150))
    good = [clean() for _ in range(60)]
    bad = [clean().upper().replace(" ", "!! "), " ".join(f"{w}$$$" for w in clean().split()), " | ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(150))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + bad)], "doc_id long, text string, lang string")
    kept = {r["row"]["doc_id"] for r in quality_rules.judge(docs, quality_rules.references(docs)).filter("kept").collect()}
    assert kept == set(range(60))


def test_short_junk_goes_in_the_pipeline_and_short_texts_stay(spark, tmp_path):
    rng = random.Random(12)
    common = ["the", "of", "and", "to", "in", "a"]
    other = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    clean = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else other() for _ in range(n))
    good = [clean(150) for _ in range(200)] + [clean(n) for n in range(50, 100)]
    junk = [" ".join(other() for _ in range(n)) for n in range(50, 100)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + junk)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()} == set(range(250))


def test_word_limit_widens_without_a_step():
    rules = quality_rules.Rules()
    limits = [rules.word_limit_at(n) for n in range(rules.word_from, 130)]
    assert rules.word_from == rules.min_words == 50 and limits[50:] == [rules.word_limit] * 30
    assert all(0 < a - b < 0.003 for a, b in zip(limits[:51], limits[1:51]))


def test_distance_is_a_bounded_metric_of_histograms():
    assert quality_rules.distance([1, 2, 3], [2, 4, 6]) == pytest.approx(0, abs=1e-7)
    assert quality_rules.distance([1, 0], [0, 5]) == pytest.approx(1)
    assert quality_rules.distance([3, 1], [1, 1]) == pytest.approx(quality_rules.distance([1, 1], [3, 1]))


# substrings


def brute_repeats(rows, window=20):
    seen, out = set(), {}
    for k, t in rows:
        w = space_words(t)
        gone = set()
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            if g in seen:
                gone |= set(range(s, s + window))
            seen.add(g)
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[k] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot,remembered", [(10_000, 1000), (2, 1000), (2, 5)])
def test_repeated_passages_are_removed(spark, texts, monkeypatch, hot, remembered):
    monkeypatch.setattr(substring, "REMEMBERED", remembered)
    monkeypatch.setattr(substring, "HOT", hot)
    more = [*texts, "a b " * 40, "w1 " * 19, "w1 " * 21]
    got = by_id(substring.remove_repeats(frame(spark, more)))
    assert {k: (r["n_words"], r["n_removed"], r["kept_sha256"]) for k, r in got.items()} == brute_repeats(enumerate(more))
    assert sum(r["n_removed"] > 0 for r in got.values()) > 5


def test_windows_on_a_hot_k_gram_are_spread(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT", 50)
    rng = random.Random(7)
    own = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    texts = [f"{own(16)} the same six words in each {own(16)}" for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, x string").repartition(4)
    prints = substring._prints(docs, 20, 6)
    many = prints.join(prints.groupBy("print").count().filter("count > 50"), "print").groupBy("k").agg(F.array().cast("array<int>").alias("few"), F.collect_list("place").alias("many"))
    rows = substring._windows(docs.join(many, "k"), 20, 6).repartition(8, "print")
    dealt = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(dealt) == 8 and max(dealt) < 2 * sum(dealt) / 8
    got = by_id(substring.remove_repeats(frame(spark, texts)))
    assert all(r["n_removed"] == 0 for r in got.values())


def test_repeats_under_null_and_repeated_ids(spark):
    same = " ".join(f"v{i}" for i in range(25))
    docs = frame(spark, [same, same + " z", None, same], [4, None, 4, 4])
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring.remove_repeats(docs).collect())
    assert got == [("4", 0, 0), ("4", 25, 25), ("4", 25, 25), ("None", 26, 0)]
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_automaton_matches_brute_force(spark):
    rng = random.Random(4)
    own, texts_ = substring.SuffixAutomaton(), []
    for _ in range(5):
        w = [rng.choice(b"abc") for _ in range(30)]
        texts_.append(w)
        own.add(w)
    query = [rng.choice(b"abcd") for _ in range(60)]
    runs = {tuple(w[i:j]) for w in texts_ for i in range(30) for j in range(i, 31)}
    for end, got in enumerate(own.matching(query), 1):
        assert got == max(n for n in range(end + 1) if tuple(query[end - n : end]) in runs)


def test_reference_spans_are_removed(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = frame(spark, [f"start {passage} end", passage[:60], None, ""])
    ref = spark.createDataFrame([("x " + passage + " y",), (None,)], "text string")
    got = {r["row"]["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove_reference_spans(docs, ref, 20, shard_words=10).collect()}
    assert got[0] == (32, 30, "start end") and got[1][1] == 0 and got[2] == (0, 0, "") == got[3]
    with pytest.raises(ValueError):
        substring.remove_reference_spans(docs, ref, max_words=5)


# licenses


def brute_lcs_pairs(a, b, pairs):
    return all(a[x] == b[y] for x, y in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_patience_alignment():
    assert licenses.align(list("abcdef"), list("abcdef")) == [(i, i) for i in range(6)]
    pairs = licenses.align("x licensed under the new mit license now".split(), "licensed under the mit license".split())
    assert [p[1] for p in pairs] == [0, 1, 2, 3, 4]
    rng = random.Random(5)
    for _ in range(50):
        a, b = [[rng.choice("abcdefghij") for _ in range(rng.randrange(12))] for _ in range(2)]
        assert brute_lcs_pairs(a, b, licenses.align(a, b))


def test_license_scan(spark, texts):
    mit = "Released under the MIT License."
    docs = frame(spark, [*texts, f"{texts[-1]} {mit} tail", mit.upper(), f"{mit}\n{mit}", "Licensed under the new Apache License, Version 2.0 today", "the license"])
    got = by_id(licenses.scan(docs))
    n = len(texts)
    assert all(got[i]["license"] is None for i in range(n))
    assert got[n]["license"] == "MIT" and got[n]["first_word"] == len(alnum_words(texts[-1])) and got[n]["coverage"] == 1.0
    assert got[n + 1]["license"] == "MIT" and got[n + 2]["license"] == "MIT" and got[n + 3]["license"] == "Apache-2.0" and got[n + 4]["license"] is None
    assert licenses.scan(docs.limit(0)).count() == 0


def test_every_license_of_a_text_is_found_and_none_is_taken_for_another(spark):
    t = licenses.TEMPLATES
    rows = ["Released under the BSD License.", "Licensed under CC BY 4.0.", "GNU General Public License, version 2", "Licensed under CC BY-ND 4.0.", t["GPL-3.0 header"].replace("version 3", "version 9")]
    rows += [f"{t['GPL-3.0 header']} {'x y z ' * 300} {t['CC-BY-NC-4.0']} q {t['MIT']}\n{t['MIT']}"]
    got = by_id(licenses.scan(frame(spark, rows)))
    assert [got[i]["license"] for i in range(6)] == ["BSD name", "CC-BY-4.0 short", "GPL-2.0 name", None, None, "GPL-3.0 header"]
    assert [(m["license"], m["first_word"], m["last_word"]) for m in got[5]["matches"]] == [("GPL-3.0 header", 0, 41), ("CC-BY-NC-4.0", 942, 948), ("MIT", 950, 954), ("MIT", 955, 959)]
    lesser, numbered = (alnum_words(x) for x in (t["GPL-3.0 header"].replace("GNU General", "GNU Lesser General"), t["BSD"].replace("binary", "1 binary")))
    known = [(n, [w.encode() for w in alnum_words(x)]) for n, x in sorted(t.items())]
    assert [[m[0] for m in licenses.matches([w.encode() for w in x], known, 0.8)] for x in (lesser, numbered)] == [["LGPL-3.0 header"], ["BSD"]]
    assert got[3]["matches"] == [] and got[5]["n_matched"] == 42


def test_mentions_of_licenses_are_a_kind_of_their_own_and_negations_are_told(spark):
    rows = ["This project is licensed under the MIT License", "Released under the Apache License", "Distributed under the MIT license", "SPDX-License-Identifier: GPL-3.0-or-later", "code under GPLv3, docs under CC BY-SA 4.0",
            "Not licensed under CC BY 4.0.", "not under the MIT license", "the mit of the institute", None, "is released under an ISC license, under the terms of the LGPL-2.1"]
    got = by_id(licenses.scan(frame(spark, rows)))
    named = [[(m["license"], m["negated"]) for m in got[i]["mentions"]] for i in range(len(rows))]
    assert named == [
        [("MIT", False)], [("Apache-2.0", False)], [("MIT", False)], [("GPL-3.0", False)], [("GPL-3.0", False), ("CC-BY-SA-4.0", False)], [("CC-BY-4.0", True)], [("MIT", True)], [], [], [("ISC", False), ("LGPL-2.1", False)],
    ]
    assert got[4]["matches"] == [] and got[5]["license"] is None and got[0]["license"] is None and (got[0]["mentions"][0]["first_word"], got[0]["mentions"][0]["last_word"]) == (4, 7)


def test_full_texts_are_known_with_edits(spark):
    rng = random.Random(4)
    full = ["MIT full", "ISC full", "BSD-2-Clause full", "Apache-2.0 notice", "LGPL-2.1 header", "LGPL-3.0 header", "AGPL-3.0 header", "Unlicense text", "MPL-2.0 notice", "Zlib text", "CC-BY-3.0", "CC-BY-SA-4.0"]
    rows = []
    for name in full:
        words = licenses.TEMPLATES[name].split()
        for _ in range(len(words) // 15):
            i = rng.randrange(len(words))
            if not any(map(licenses.telling, decontaminate.words_of(words[i]))):
                words[i] = rng.choice(["changed", ""])
        rows.append("x y z " * 50 + " ".join(words) + " and more words after it")
    got = by_id(licenses.scan(frame(spark, rows)))
    assert [got[i]["license"] for i in range(len(full))] == full and all(got[i]["first_word"] >= 150 for i in range(len(full)))


def plain_patience(a, b):
    """Patience alignment of whole sequences as it is told: equal ends, the longest rising run of words unique to both (by trying all ends), then the gaps."""
    if not a or not b:
        return 0
    if a[0] == b[0]:
        return 1 + plain_patience(a[1:], b[1:])
    if a[-1] == b[-1]:
        return 1 + plain_patience(a[:-1], b[:-1])
    ca, cb = Counter(a), Counter(b)
    pairs = [(i, b.index(w)) for i, w in enumerate(a) if ca[w] == cb[w] == 1]
    if not pairs:
        return 0
    runs = []
    for i, j in pairs:
        runs.append(max((r for r in runs if r[-1][1] < j), key=len, default=[]) + [(i, j)])
    best, total, last = max(runs, key=len), 0, (-1, -1)
    for i, j in [*best, (len(a), len(b))]:
        total += plain_patience(a[last[0] + 1 : i], b[last[1] + 1 : j]) + (i < len(a))
        last = (i, j)
    return total


def test_stretches_match_what_the_whole_text_aligns():
    rng = random.Random(12)
    known = {name: decontaminate.words_of(t) for name, t in licenses.TEMPLATES.items()}
    for name, template in known.items():
        for _ in range(6):
            loose = [i for i, w in enumerate(template) if not licenses.telling(w)]
            lost = set(rng.sample(loose, min(len(loose), len(template) // 10))) if len(template) > licenses.SHORT else set()
            kept = [w for i, w in enumerate(template) if i not in lost]
            filler = lambda n: [f"q{rng.randrange(1000)}".encode() for _ in range(n)]
            words = filler(rng.randrange(40)) + kept + filler(rng.randrange(40))
            found = {m[0]: m for m in licenses.matches(words, [(name, template)], 0.8)}
            assert found[name][1] == plain_patience(words, template) == len(kept), (name, lost)


def test_twin_notices_are_found_at_any_place():
    known = [(n, alnum_words(t)) for n, t in sorted(licenses.TEMPLATES.items())]
    known = [(n, [w.encode() for w in t]) for n, t in known]
    for name, t in known:
        for pad in (0, 1, 7, 40):
            got = licenses.matches([b"z"] * pad + t + t, known, 0.8)
            assert sorted((first, last) for n, _, _, first, last in got if n == name) == [(pad, pad + len(t) - 1), (pad + len(t), pad + 2 * len(t) - 1)], (name, pad)


# urls


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 240)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame([*edges, (None, 3), (5, None), (7, 7)], "u long, v long")
    assert {r["node"]: r["component"] for r in graph.components(df).collect()} == {x: find(x) for x in touched}
    assert graph.components(df.limit(0)).count() == 0


def test_url_verdicts_and_aliases(spark):
    canonical = lambda u: f'<html><link rel="canonical" href="{u}"></html>'
    pages = [
        (1, "https://m.Example.COM/en/75?x#y", ""), (2, "http://a.com/en/1", ""), (3, "http://other.io/p", canonical("http://a.com/en/1")), (4, "http://fourth.io/", '<meta http-equiv="refresh" content="0; url=http://other.io/p">'),
        (5, "http://mixed.io/", canonical("http://x.net/de/1")), (6, "http://mixed.io/2", canonical("http://mixed.io/")), (7, "http://bad.org/es/1", canonical("http://mixed.io/2")), (8, None, canonical("http://a.com/en/1")),
        (9, "no scheme", None), (10, "http://example.net/de/8/a", None), (11, "http://notexample.net/de/8", None), (None, "http://a.com", ""), (2, "http://a.com/en/1", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, urls.rules_table(spark, queries.URL_RULES), urls.page_edges(df)).collect()]
    assert sorted(got, key=str) == sorted(
        [
            (1, "m.example.com", "/en/75", "example.com/en/7", "allow"), (2, "a.com", "/en/1", "com/en/", "block"), (2, "a.com", "/en/1", "com/en/", "block"), (3, "other.io", "/p", None, "block"), (4, "fourth.io", "/", None, "block"),
            (5, "mixed.io", "/", None, "allow"), (6, "mixed.io", "/2", None, "allow"), (7, "bad.org", "/es/1", "org/es/", "block"), (8, "", "", None, "allow"), (9, "", "", None, "allow"),
            (10, "example.net", "/de/8/a", "example.net/de/8", "block"), (11, "notexample.net", "/de/8", "net/de/", "allow"), (None, "a.com", "", None, "allow"),
        ], key=str,
    )
    assert urls.judge(df.limit(0), urls.rules_table(spark, queries.URL_RULES), urls.page_edges(df.limit(0))).count() == 0


LINKS = [
    ("http://a.com/en/1", ""), ("http://o.io/d/p?q=1", "<LINK href='/en/../x' rel=\"alternate\"><link href=../e/./f rel=canonical>"), ("http://o.io/e/f", '<link rel="nofollow Canonical" href="HTTP://A.com/en/1#top">'),
    ("http://o.io/g", """<meta content='0; URL="//o.io/e/f"' http-equiv=Refresh>"""), ("http://O.io/h#z", '<link rel="canonical" href="?a=1&amp;b=2">'), ("http://o.io/h?a=1&b=2", '<link rel="canonical" href="g">'),
    ("http://q.io", '<link rel="canonical" href="#x"><meta http-equiv="refresh" content="5">'), ("http://r.io/a/b", '<link rel="canonical" href="mailto:x@y"><link rel="canonical" href="http://a.com/en/1">'), (None, '<link rel="canonical" href="http://a.com/en/1">'),
    ("http://s.io/a/b/", '<link rel="canonical" href="../../../..">'), ("http://s.io/", '<link data-rel="canonical" href="http://a.com/en/1">'),
]


def test_links_of_every_form_make_aliases(spark):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(LINKS)], "page_id long, url string, html string")
    edges = {(r["u"], r["v"]) for r in urls.page_edges(df).collect()}
    assert edges == {
        ("http://o.io/d/p?q=1", "http://o.io/e/f"), ("http://o.io/e/f", "http://a.com/en/1"), ("http://o.io/g", "http://o.io/e/f"), ("http://o.io/h", "http://o.io/h?a=1&b=2"), ("http://o.io/h?a=1&b=2", "http://o.io/g"), ("http://s.io/a/b/", "http://s.io/"),
    }
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df, urls.rules_table(spark, queries.URL_RULES), urls.page_edges(df)).collect()}
    assert [got[i] for i in range(len(LINKS))] == ["block"] * 6 + ["allow"] * 5


def test_url_sql_knows_the_same_links(spark, tmp_path):
    import duckdb

    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(LINKS)], "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.OP6_SQL})").fetchall()
    got = [tuple(r) for r in queries.op6_url_verdicts(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got) == sorted(found)


def test_tied_rules_go_to_allow_and_then_the_smaller(spark):
    df = spark.createDataFrame([(1, "http://x.com/en/7", ""), (2, "http://b.y.org/aa", "")], "page_id long, url string, html string")
    rules = urls.rules_table(spark, [("block", "com/en/7"), ("allow", "x.com/en"), ("block", "y.org/aa"), ("block", "b.y.org/")])
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(df, rules, urls.page_edges(df)).collect()} == {1: ("x.com/en", "allow"), 2: ("b.y.org/", "block")}


# n-gram Jaccard


def brute_groups(rows, k, t):
    sets = {}
    for i, x in rows:
        w = space_words(lower(x))
        sets[i] = {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both * t.denominator >= (len(sets[a]) + len(sets[b]) - both) * t.numerator:
                    x, y = find(a), find(b)
                    part[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, base_words=60, n=80, edits=4):
    """A base and copies with a few substitutions, insertions or deletions, from few places, so that copies link over one another."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(base_words)]
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(1, edits + 1)):
            at = rng.choice([5, 6, 20, 33, 50]) % len(w)
            kind = rng.randrange(3)
            if kind == 0:
                w[at] = rng.choice(["e1", "e2", f"r{rng.random()}"])
            elif kind == 1:
                w.insert(at, rng.choice(["i1", "i2"]))
            else:
                del w[at]
        out.append(" ".join(w))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,k,t", [(1, 3, Fraction(9, 10)), (2, 3, Fraction(9, 10)), (3, 5, Fraction(4, 5)), (4, 2, Fraction(7, 10))])
def test_jaccard_groups(spark, seed, k, t):
    rows = list(enumerate(corpus(seed, 40) + near_copies(seed) + near_copies(seed + 10, 12, 20, 2)))
    got = by_id(jaccard.jaccard_groups(frame(spark, [x for _, x in rows]), k, t))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_groups(rows, k, t)


def test_deletion_neighbourhoods_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "allocate", lambda size, difference, documents: (difference + 1) // 2)
    rows = list(enumerate(near_copies(7) + near_copies(8, 20, 30, 2)))
    got = by_id(jaccard.jaccard_groups(frame(spark, [x for _, x in rows]), 3, Fraction(9, 10)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_groups(rows, 3, Fraction(9, 10))


def test_more_documents_get_longer_segments():
    assert jaccard.allocate(40, 20, 10) == 0 < jaccard.allocate(40, 20, 10**9)


def families(seed):
    """Families of documents with several centres, whose members are near the limit to one another and share passages."""
    rng = random.Random(seed)
    out = []
    for f in range(3):
        base = [f"f{f}w{i}" for i in range(80)]
        centres = []
        for _ in range(4):
            w = list(base)
            for at in rng.sample(range(80), 6):
                w[at] = f"c{rng.randrange(30)}"
            centres.append(w)
        for _ in range(25):
            w = list(rng.choice(centres))
            for at in rng.sample(range(0, 80, 5), rng.randrange(0, 4)):
                w[at] = f"x{rng.randrange(6)}"
            out.append(" ".join(w[rng.randrange(0, 8) :]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_links_between_members_of_several_stars_are_found(spark, seed):
    rows = list(enumerate(families(seed)))
    got = by_id(jaccard.jaccard_groups(frame(spark, [x for _, x in rows]), 3, Fraction(4, 5)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_groups(rows, 3, Fraction(4, 5))


def test_jaccard_groups_of_null_ids_and_empty_tables(spark):
    got = jaccard.jaccard_groups(frame(spark, ["a b c d", "A B C D", "a b c d", "q"], [9, 3, None, 3]), 3, Fraction(9, 10)).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == [("3", 3), ("3", 3), ("9", 3), ("None", None)]
    assert jaccard.jaccard_groups(frame(spark, ["a"]).limit(0), 3, Fraction(9, 10)).count() == 0


def test_null_ids_before_a_document_cost_it_no_links(spark):
    base = [f"b{i}" for i in range(60)]
    near = [*base[:30], "edit", *base[31:]]
    rows = [(None, " ".join(base)), (7, " ".join(base)), (4, " ".join(near)), (None, " ".join(near)), (9, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = jaccard.jaccard_groups(docs, 3, Fraction(9, 10)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got) == [("4", 58, 4), ("7", 58, 4), ("9", 1, 9), ("None", 58, None), ("None", 58, None)]


# classifier


def test_classifier_scores_are_those_of_its_network_and_rank_held_out_labels(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = by_id(classifier.score(docs, labels))
    assert len(got) == docs.count() and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    # the scores again, from all texts at once in one process
    s, rows = classifier.Settings(), sorted(docs.select("doc_id", "text").collect())
    column = pa.array([r["text"] for r in rows], pa.string())
    vectors = classifier.weighted(classifier.word_vectors(docs, s), s)
    x = {r["doc_id"]: v for r, v in zip(rows, classifier.pooled(column, vectors, s))}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    used = sorted(i for i in known if i in x and not got[i]["held_out"])
    net = classifier.fit(np.array([x[i] for i in used]), np.array([known[i] for i in used]), s)
    assert np.allclose([got[r["doc_id"]]["score"] for r in rows], net.probability(np.array([x[r["doc_id"]] for r in rows])), atol=1e-6)
    held = [(got[i]["score"], y) for i, y in known.items() if i in got and got[i]["held_out"]]
    wins = [(a > b) + 0.5 * (a == b) for a, y in held for b, z in held if y > z]
    assert wins and sum(wins) / len(wins) > 0.8


def test_classifier_samples_a_repeated_id_once(spark):
    docs = frame(spark, ["good words here", "zz zz", "other", "good words"], [1, 1, 3, None])
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (None, 1)], "doc_id long, quality int")
    assert classifier.score(docs, labels).count() == 4


def test_pipeline_stages_of_an_empty_table(spark, tmp_path):
    docs = frame(spark, ["a"]).limit(0).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_rules_of_null_ids_repeated_rows_and_empty_tables(spark):
    docs = frame(spark, ["a b c", "a b c", None, "x"], [None, 3, 3, 4])
    rules = quality_rules.Rules()
    got = quality_rules.judge(docs, quality_rules.references(docs, rules), rules)
    assert sorted((str(r["row"]["doc_id"]), r["n_words"], r["kept"]) for r in got.collect()) == [("3", 0, False), ("3", 3, False), ("4", 1, False), ("None", 3, False)]
    none = docs.limit(0)
    assert quality_rules.judge(none, quality_rules.references(none, rules), rules).count() == 0


def test_licenses_of_null_and_repeated_ids_and_empty_tables(spark):
    docs = frame(spark, ["Released under the MIT License.", "Released under the MIT License.", None], [None, 3, 3])
    assert sorted((str(r["doc_id"]), str(r["license"])) for r in licenses.scan(docs).collect()) == [("3", "MIT"), ("3", "None"), ("None", "MIT")]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_reference_spans_of_an_empty_reference(spark):
    docs = frame(spark, ["a b", None])
    got = substring.remove_reference_spans(docs, docs.select("text").limit(0), 20).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in got) == [(0, 0), (2, 0)]


def test_classifier_learns_and_holds_out(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["the", "of", "and", "river", "stone", "tree"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["buy!!", "now!!", "$$$", "win|", "free"]) for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(300)]
    docs = frame(spark, [t for _, t, _ in rows] + [None, ""])
    labels = spark.createDataFrame([*((i, y) for i, _, y in rows), (None, 1), (5, None)], "doc_id long, quality int")
    got = by_id(classifier.score(docs, labels))
    assert len(got) == 302 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert len(held) > 40 and sum(p == y for p, y in held) / len(held) > 0.95
    # labels of documents that are held out change nothing
    flipped = spark.createDataFrame([(i, 1 - y if got[i]["held_out"] else y) for i, _, y in rows], "doc_id long, quality int")
    again = by_id(classifier.score(docs, flipped))
    assert all(abs(again[i]["score"] - got[i]["score"]) < 1e-9 for i in got)


def test_word_vectors_are_sums_over_neighbours(spark):
    s = classifier.Settings(words=64, size=8)
    docs = spark.createDataFrame([("a b c",), ("c a",), (None,)], "text string")
    table = classifier.word_vectors(docs, s)
    spots, signs = classifier.index_vectors(s)
    want = np.zeros((64, 9))
    for t in ("a b c", "c a"):
        w = (text.Words(pa.array([t]), text.MIXED).hash % np.uint64(64)).astype(int)
        for i in range(len(w)):
            want[w[i], 8] += 1
            for j in range(len(w)):
                if 0 < abs(i - j) <= s.reach:
                    for p, g in zip(spots[w[j]], signs[w[j]]):
                        want[w[i], p] += g
    assert np.array_equal(table, want)


def test_classifier_without_labels_or_rows(spark):
    docs = frame(spark, ["a b", None])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in classifier.score(docs, labels).collect()} == {0.5}
    assert classifier.score(docs.limit(0), labels).count() == 0


# mixing


def test_fill_gives_shortages_to_siblings(spark):
    rows = [("p", "a", 10, 1, 100), ("p", "b", 1000, 1, 100), ("p", "c", 1000, 2, 100), ("q", "a", 5, 1, 100), ("q", "b", 7, 0, 100)]
    got = {(r["parent"], r["name"]): r["alloc"] for r in mixing.fill(spark.createDataFrame(rows, "parent string, name string, cap long, weight long, budget long"), ["parent"], "name").collect()}
    assert got == {("p", "a"): 10, ("p", "b"): 30, ("p", "c"): 60, ("q", "a"): 5}


def test_mixture_takes_whole_epochs_and_a_seeded_prefix(spark, texts):
    tree = mixing.Tree([("lang", "lang", {"en": 3}, 1), ("source", "source", {}, 1)], max_epochs=2)
    docs = frame(spark, texts)
    cuts = {(r["lang"], r["source"]): r for r in mixing.leaf_cuts(docs, tree).collect()}
    taken = defaultdict(list)
    for r in mixing.mix(docs, tree).collect():
        taken[(r["lang"], r["source"])].append((r["row"]["doc_id"], r["epoch"], r["n_tokens"]))
    leaves = defaultdict(list)
    for j, t in enumerate(texts):
        leaves[([None, "en", "fr"][j % 3] or "unknown", [None, "src0", "src7", "src12"][j % 4] or "unknown")].append((j, len(space_words(t))))
    for leaf, docs_ in leaves.items():
        c, total = cuts[leaf], sum(n for _, n in docs_)
        assert c["tokens"] == total and c["whole"] == c["alloc"] // total
        want, sum_ = [(i, e) for i, _ in docs_ for e in range(1, c["whole"] + 1)], 0
        for i, n in sorted(docs_, key=lambda d: hashlib.md5(f"mix:{c['whole'] + 1}:{d[0]}".encode()).hexdigest()):
            sum_ += n
            if 0 < c["alloc"] % total >= sum_:
                want.append((i, c["whole"] + 1))
        assert sorted((i, e) for i, e, _ in taken[leaf]) == sorted(want), leaf
    everything = sum(n for d in leaves.values() for _, n in d)
    assert everything - 20 <= sum(c["alloc"] for c in cuts.values()) <= everything


def test_shortages_under_weight_nothing_reach_other_branches(spark):
    tree = mixing.Tree([("d", "d", {"a": 1, "b": 1}, 0), ("s", "s", {"x": 1, "y": 0, "z": 1}, 0)], max_epochs=1, budget_percent=50)
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 90), ("b", "z", 300), ("c", "z", 5)], "d string, s string, tokens long")
    assert {(r["d"], r["s"]): r["alloc"] for r in mixing.budgets(leaves, tree).collect()} == {("a", "x"): 10, ("b", "z"): 192}


def test_mixture_of_an_empty_table(spark):
    assert mixing.mix(frame(spark, ["a"]).limit(0), queries.TREE).count() == 0


# pipeline


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    common = ["the", "of", "and", "to", "in", "a"]
    clean = lambda: " ".join(rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(120))
    good = [clean() for _ in range(40)]
    near = " ".join([*good[0].split()[:-1], "changed"])
    leak = " ".join(good[1].split()[:40]) + " " + clean()
    docs = spark.createDataFrame(
        [(i, t, "en", "src1", len(t)) for i, t in enumerate([*good, good[2], near, leak, "short text", good[3].upper().replace(" ", "!! ")])], "doc_id long, text string, lang string, source string, n_chars long"
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(leak.split()[60:75]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    kept = [set(range(45)) - {43, 44}, set(range(45)) - {43, 44, 40, 41}, set(range(45)) - {43, 44, 40, 41, 42}]
    now = docs
    for (_, stage), want in zip(corpus_pipeline.STAGES[:3], kept):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns and {r["doc_id"] for r in now.collect()} == want
    mixed = corpus_pipeline.STAGES[3][1](spark, now, str(tmp_path))
    assert mixed.columns == docs.columns
    times = Counter(r["doc_id"] for r in mixed.collect())
    final = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert times == final and set(times) <= kept[2]


def test_pipeline_stages_go_by_rows_where_ids_are_null_or_repeat(spark, tmp_path):
    texts_ = {x: " ".join(f"{x}{i}" for i in range(40)) for x in "abcde"}
    near = texts_["a"].replace("a39", "edit")
    rows = [(5, texts_["a"]), (None, near), (2, near), (2, texts_["a"]), (2, texts_["b"]), (None, texts_["c"]), (None, texts_["c"]), (7, texts_["d"]), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    found = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    rest = [r for r in found if r not in ((2, near), (2, texts_["a"]))]
    assert len(found) == len(rest) + 1 and sorted(rest, key=str) == sorted([(2, texts_["b"]), (None, texts_["c"]), (7, texts_["d"]), (None, None), (8, "")], key=str)

    spark.createDataFrame([(1, " ".join(texts_["c"].split()[5:20]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, texts_["c"]), (None, texts_["a"]), (3, texts_["c"]), (3, texts_["b"]), (4, "x " + texts_["c"]), (6, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    clean = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()]
    assert sorted(clean, key=str) == sorted([rows[1], rows[3], rows[5], rows[6]], key=str)


def test_repeats_are_joined_the_same_way_at_any_size(spark):
    same = " ".join(f"w{i}" for i in range(30))
    got = substring.remove_repeats(frame(spark, [f"a {same}", f"b {same}", "c"]))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(r["n_removed"] for r in got.collect()) == [0, 0, 30]


def test_repeats_are_found_in_steps_that_each_shuffle_the_corpus_once(spark, monkeypatch):
    from tallyloom.llm import scratch, substring

    joins, paths, write = {}, {}, scratch.written

    def written(df, name):
        joins[name] = str(df._jdf.queryExecution().optimizedPlan()).count("Join ")
        out = write(df, name)
        paths[name] = out.scratch_path.removeprefix("file://")
        return out

    monkeypatch.setattr(scratch, "written", written)
    passage = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(0, f"a b {passage} c"), (1, f"d {passage} e f"), (2, "alone"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(docs).collect()}
    assert got == {0: 0, 1: 25, 2: 0, 3: 0}
    assert max(joins.values()) == 1 and {"hits", "windows"} <= set(joins)
    assert os.path.exists(paths["repeats"]) and not any(os.path.exists(paths[n]) for n in ("twice", "hits", "windows"))


def test_jaccard_join_meets_signatures_and_differences_in_steps(spark, monkeypatch):
    from tallyloom.llm import scratch

    plans, paths, write = defaultdict(list), defaultdict(list), scratch.written

    def written(df, name):
        plans[name].append(str(df._jdf.queryExecution().optimizedPlan()))
        out = write(df, name)
        paths[name].append(out.scratch_path.removeprefix("file://"))
        return out

    monkeypatch.setattr(scratch, "written", written)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]

    def edited(n):
        words = list(base)
        for i in rng.sample(range(120), n):
            words[i] = f"x{rng.randrange(40)}"
        return words

    words = [edited(n) for n in (0, 0, *[3, 4, 5, 6] * 6)] + [[f"y{i}" for i in range(50)]]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string"), 3, Fraction(4, 5)).collect()}
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in words]
    part = list(range(len(words)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and part[i] != part[j]:
                lo, hi = sorted((part[i], part[j]))
                part = [lo if p == hi else p for p in part]
    assert got == dict(enumerate(part)) and len(set(part)) > 2
    assert len(plans["shared"]) == jaccard.ROUNDS and not any("Window" in p for p in plans["buckets"])
    assert plans["counts"] and not any("Aggregate" in p for p in plans["meeting"])
    assert not any(os.path.exists(p) for n in ("signed", "shared", "tokens", "counts") for p in paths[n])
