"""Remedies for a rare class against copies of rows, plain fits and plain scores."""

import hashlib

import numpy as np
import pytest

from tallyloom.operators import imbalance as I


def share(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 16**13


def logistic(x, y, w, ridge=1.0):
    """Coefficients and intercept on columns that come standardised."""
    z, beta = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    penalty = np.append(np.full(x.shape[1], ridge), 1e-9)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        beta += np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + np.diag(penalty), z.T @ (w * (y - p)) - penalty * beta)
    return beta


def scores(p, y, recall=0.8):
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
    cuts = sorted(set(p), reverse=True)
    tp, flagged = (np.array([f(c) for c in cuts], float) for f in (lambda c: (pos >= c).sum(), lambda c: (p >= c).sum()))
    ap = float(np.sum(np.diff(np.append(0, tp)) / len(pos) * tp / flagged))
    at = lambda want: next(i for i in range(len(cuts)) if tp[i] >= want * len(pos) - 1e-9)
    q = np.clip(p, 1e-7, 1 - 1e-7)
    half = p >= 0.5
    return {
        "auc": auc, "average_precision": ap, "precision_at_recall": tp[at(recall)] / flagged[at(recall)], "mean_p": p.mean(), "log_loss": -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q)),
        "brier": np.mean((p - y) ** 2), "recall_half": half[y == 1].mean(), "precision_half": y[half].mean() if half.any() else None,
    }, lambda want: (tp[at(want)] / flagged[at(want)], cuts[at(want)])


@pytest.fixture(scope="module")
def drawn():
    rng = np.random.default_rng(12)
    n = 900
    y = (rng.random(n) < 0.12).astype(int)
    x = rng.normal(size=(n, 3))
    x[y == 1, :2] += 1.2
    x[:, 2] = 5.0 + 3 * x[:, 2]
    return x, y


def test_every_remedy_equals_copies_and_plain_fits(spark, drawn):
    x, y = drawn
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(len(y))], "id long, vec array<double>, y int")
    got = {(r["rep"], r["method"]): r for r in I.resampled_scores(df, "id", "vec", "y", 2, 0.6, "s", steps=25).collect()}
    assert set(got) == {(r, m) for r in range(2) for m in (*I.METHODS, I.CORRECTED)}
    at = np.array([share(f"s:set:{i}") for i in range(len(y))])
    test = at >= 0.6
    for rep in range(2):
        own = np.flatnonzero(~test & (np.floor(at / 0.6 * 2) == rep))
        mean, sd = x[own].mean(0), x[own].std(0)
        z, t, most, rare = (x - mean) / sd, y[own], int((y[own] == 0).sum()), int(y[own].sum())
        u = np.array([share(f"s:take:{i}") for i in own])
        times = most / rare
        copies = np.where(t == 1, np.floor(times) + (u < times % 1), 1).astype(int)
        copied = np.repeat(own, copies)
        kept = own[(t == 1) | (u < rare / most)]
        pos = own[t == 1]
        need = most - rare
        ranked = sorted(pos, key=lambda i: hashlib.md5(f"s:{rep}:{i}".encode()).hexdigest())
        made = []
        for place, i in enumerate(ranked):
            d = np.round(np.sqrt(((x[pos].astype(np.float32).astype(float) - x[i].astype(np.float32)) ** 2).sum(1)), 9)
            near = [j for _, j in sorted((d[a], j) for a, j in enumerate(pos) if j != i)]
            for c in range(1, need // rare + (place < need % rare) + 1):
                j = near[int(share(f"s:{rep}:near:{i}:{c}") * min(5, rare - 1))]
                made.append(x[i] + share(f"s:{rep}:way:{i}:{c}") * (x[j] - x[i]))
        assert len(made) == need
        one = np.ones
        fits = {
            "plain": logistic(z[own], t, one(len(own))), "oversample": logistic(z[copied], y[copied], one(len(copied))), "undersample": logistic(z[kept], y[kept], one(len(kept))),
            "weights": logistic(z[own], t, np.where(t == 1, len(own) / (2 * rare), len(own) / (2 * most))),
            "smote": logistic(np.vstack([z[own], (np.array(made) - mean) / sd]), np.append(t, one(need)), one(len(own) + need)),
        }
        trained = y[copied].mean()
        drawn_odds, trained_odds = (q / (1 - q) for q in (rare / len(own), trained))
        p = {m: 1 / (1 + np.exp(-(z[test] @ b[:-1] + b[-1]))) for m, b in fits.items()}
        odds = p["oversample"] / (1 - p["oversample"]) * drawn_odds / trained_odds
        p[I.CORRECTED] = odds / (1 + odds)
        plain = scores(np.round(p["plain"], 9), y[test])[1]
        for m, q in p.items():
            want = scores(np.round(q, 9), y[test])[0]
            r = got[rep, m]
            for c, v in want.items():
                assert (r[c] is None and v is None) or np.isclose(r[c], v, atol=1e-6), (rep, m, c, r[c], v)
            if want["recall_half"] > 0:
                assert np.allclose((r["plain_precision"], r["plain_threshold"]), plain(want["recall_half"]), atol=1e-6)
    # what the study is about: remedies move probabilities, which the prior correction moves back
    assert got[0, "weights"]["mean_p"] > 2 * got[0, "plain"]["mean_p"] and abs(got[0, I.CORRECTED]["mean_p"] - got[0, "plain"]["mean_p"]) < 0.03


def test_sets_without_a_rare_row_have_no_scores(spark):
    none = spark.createDataFrame([], "id long, vec array<double>, y int")
    assert I.paired_remedies(I.resampled_scores(none, "id", "vec", "y", 2, 0.5, "s")).count() == 0
    rows = [(i, [float(i), 1.0], 0) for i in range(30)] + [(30, None, 1), (31, [None, 1.0], 1), (None, [1.0, 1.0], 1), (32, [float("nan"), 1.0], 1)]
    assert I.resampled_scores(spark.createDataFrame(rows, "id long, vec array<double>, y int"), "id", "vec", "y", 2, 0.5, "s").count() == 0


def test_paired_differences_are_from_the_same_set(spark):
    columns = "rep int, method string, auc double, average_precision double, precision_at_recall double"
    df = spark.createDataFrame([(0, "plain", 0.8, 0.5, 0.3), (1, "plain", 0.7, 0.4, 0.2), (0, "smote", 0.9, 0.5, 0.3), (1, "smote", 0.7, 0.4, None)], columns)
    got = {r["method"]: r for r in I.paired_remedies(df).collect()}
    assert np.isclose(got["smote"]["auc_gap"], 0.05) and np.isclose(got["smote"]["auc_gap_se"], 0.05) and got["plain"]["auc_gap"] == 0
    assert got["smote"]["precision_at_recall_gap"] == 0 and got["smote"]["precision_at_recall_gap_se"] is None


def test_boosted_remedies_equal_copies_and_plain_trees(spark, drawn):
    x, y = drawn
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(len(y))], "id long, vec array<double>, y int")
    sets = I.resampled_sets(I.training_sets(df, "id", "vec", "y", 1, 0.6, "s").filter("rep is not null"), 1, 5, "s")
    edges, fits = I.boosted_fits(sets, 16, 3, 2, 0.5, 2)
    rows = sets.rows.toPandas()
    vec = np.array(rows["vec"].tolist())
    assert np.allclose(edges, [vec.min(0), vec.max(0)])
    t, u, real = (rows[c].to_numpy() for c in ("y", "u", "drawn"))
    rare, most = int((real & (t == 1)).sum()), int((real & (t == 0)).sum())
    times = most / rare
    weights = {
        "plain": real.astype(float), "smote": np.ones(len(t)), "undersample": np.where(t == 1, 1.0, u < rare / most) * real, "oversample": np.where(t == 1, np.floor(times) + (u < times % 1), 1.0) * real,
        "weights": np.where(t == 1, (most + rare) / (2 * rare), (most + rare) / (2 * most)) * real,
    }
    b = I._bins(edges, vec, 16)

    def grow(w, p, at, depth):
        """The leaf's values of rows `at`, split where the squared error of what is left falls most."""
        g, h = w * (t - p), w * p * (1 - p)
        best = None
        if depth:
            for f in range(3):
                for cut in range(15):
                    left, right = at & (b[:, f] <= cut), at & (b[:, f] > cut)
                    if w[left].sum() >= 2 and w[right].sum() >= 2:
                        gain = round(g[left].sum() ** 2 / w[left].sum() + g[right].sum() ** 2 / w[right].sum() - g[at].sum() ** 2 / w[at].sum(), 9)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = gain, left, right
        if best is None:
            return np.where(at, 0.5 * g[at].sum() / max(h[at].sum(), 1e-12), 0.0)
        return grow(w, p, best[1], depth - 1) + grow(w, p, best[2], depth - 1)

    for _, name, first, trees in fits:
        w = weights[name]
        start = np.log((w @ t) / (w.sum() - w @ t))
        assert np.isclose(first, start), name
        z, own = np.full(len(t), start), np.full(len(t), first)
        for tree in trees:
            z = z + grow(w, 1 / (1 + np.exp(-z)), np.ones(len(t), bool), 2)
            own = own + tree.predict(b, 2)
        assert np.allclose(own[w > 0], z[w > 0], atol=1e-6), name
    scores = {r["method"]: r for r in I.resampled_scores(df, "id", "vec", "y", 1, 0.6, "s", model="boosted", bins=16, rounds=3, depth=2, rate=0.5, least=2).collect()}
    assert set(scores) == {*I.METHODS, I.CORRECTED} and scores["plain"]["auc"] > 0.7 and scores["weights"]["mean_p"] > scores["plain"]["mean_p"]
    with pytest.raises(ValueError):
        I.resampled_scores(df, "id", "vec", "y", 1, 0.6, "s", model="other")


def test_documents_are_read_once_and_counts_are_those_of_patterns(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from tallyloom.operators import cleaning
    from tallyloom.plans import q_imbalance as Q

    monkeypatch.setattr(cleaning, "AT_ONCE", 7)
    texts = ["", None, "Ab 1\n2é€😀", "x" * 20, "É\t9Z\r\n", "\U0001f600", "12 34"]
    df = spark.createDataFrame([(i, 2 * i, t) for i, t in enumerate(texts)], "a long, b long, text string").coalesce(1)
    got = cleaning.character_counts(df, "text", Q.CLASSES, "n")
    assert got.columns == ["a", "b", "n", "digits", "capitals", "spaces", "plain"]
    left = lambda p: F.length(F.regexp_replace("text", p, "")).cast("long")
    want = df.select("a", "b", F.length("text").cast("long"), left("[^0-9]"), left("[^A-Z]"), left("[^ \\n]"), left("[^A-Za-z0-9 \\n]"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert cleaning.character_counts(df.limit(0), "text", Q.CLASSES).count() == 0

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5)], int(i % 4 == 0)) for i in range(120)], "id long, vec array<double>, y int")
    I.resampled_scores(rows.mapInArrow(count, rows.schema), "id", "vec", "y", 1, 0.6, "s", steps=2).collect()
    assert seen.value == 120


def test_boosted_remedies_read_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5)], int(i % 4 == 0)) for i in range(120)], "id long, vec array<double>, y int")
    I.resampled_scores(rows.mapInArrow(count, rows.schema), "id", "vec", "y", 1, 0.6, "s", model="boosted", bins=4, rounds=1, depth=1).collect()
    assert seen.value == 120


def test_boosted_trees_grow_from_cells_and_not_from_rows(spark, monkeypatch):
    held, grown = [], I._grown

    def seen(table, *rest):
        held.append(table)
        return grown(table, *rest)

    monkeypatch.setattr(I, "_grown", seen)
    rows = [(i, [float(i % 5), float(i % 3)], int(i % 4 == 0), 0) for i in range(240)]
    sizes, trees = [], []
    for copies in (1, 3):
        real = spark.createDataFrame([(*r, 0.5, True) for r in rows * copies], "id long, vec array<double>, y int, rep int, u double, drawn boolean").drop("id")
        counts = np.array([[180, 60]]) * copies
        trained = np.array([[0.25, 0.5, 0.25, 0.5, 0.5]])
        edges, fits = I.boosted_fits(I.Sets(real, 2, counts, [0], trained), 8, 2, 2, 0.5, 1)
        sizes.append(held[-1].count())
        trees.append([(name, [t.splits.keys() for t in own], [{k: round(v, 9) for k, v in t.values.items()} for t in own]) for _, name, _, own in fits])
        assert held[-1].groupBy().sum("n").first()[0] == 240 * copies and edges.tolist() == [[0.0, 0.0], [4.0, 2.0]]
    assert sizes == [30, 30] and trees[0] == trees[1]  # 5 x 3 vectors of either label, however many rows


def test_characters_of_long_texts_and_many_classes(spark):
    from string import ascii_lowercase

    from tallyloom.operators.cleaning import character_counts

    texts = ["a" * 4095, "a" * 4096, "ab€" * 5000, None, "", "z" * 20_000 + "a"]
    classes = {f"c{i}": ascii_lowercase[i] for i in range(7)} | {"all": ascii_lowercase}
    got = character_counts(spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1), "text", classes)
    want = [(i, *([None] * 9 if t is None else [len(t), *(sum(map(t.count, c)) for c in classes.values())])) for i, t in enumerate(texts)]
    assert sorted(map(tuple, got.collect())) == want
