"""Every registered query that SQL expresses against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}
QUERIES = {k: v for k, v in entry.queries().items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, pd.Timestamp) or type(v).__name__ == "date":
        return str(pd.Timestamp(v))
    return v


def same(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return a == b or abs(a - b) <= 1e-5 * max(1.0, abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def rows(df, columns):
    out = [tuple(plain(v) for v in r) for r in df[columns].astype(object).values.tolist()]
    return sorted(out, key=lambda r: [repr(round(x, 4) if isinstance(x, float) else x) for x in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got, sorted(got.columns)), rows(want, sorted(got.columns))
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b) if not same(x, y)]
    assert not wrong, wrong[:3]


def test_queries_without_sql_are_those_with_tests_of_their_own():
    assert set(QUERIES) - set(SQL) == {"matched_absence", "tree_importances", "greedy_holdout", "component_stabilities", "component_usefulness", "imbalance_comparison", "imbalance_comparison_trees", "leak_table", "nested_tuning"}


def test_matched_absence_places_the_spells_of_the_series(spark):
    from tallyloom.operators import sequence
    from tallyloom.plans.base import returns

    got = QUERIES["matched_absence"](spark, SF).toPandas()
    d = returns(spark, SF).toPandas().sort_values(["series", "date"])
    spells = sequence.episodes(returns(spark, SF).selectExpr("series", "date", "ret < -100 as f"), "series", "date", "f").toPandas()
    for series, own in got.groupby("series"):
        n = int((d["series"] == series).sum())
        assert sorted(own["length"]) == sorted(spells.loc[spells["series"] == series, "length"])
        placed = own.dropna(subset=["first"]).sort_values("first")
        ends = (placed["first"] + placed["length"]).tolist()
        assert all(0 <= a for a in placed["first"]) and all(e <= n for e in ends) and all(a > e for a, e in zip(placed["first"].tolist()[1:], ends))
        again = QUERIES["matched_absence"](spark, SF).filter(f"series = '{series}'").toPandas()
        assert sorted(again["first"].dropna()) == sorted(placed["first"])


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 6
