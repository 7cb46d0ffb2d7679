"""Queries of prediction scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import scoring as S

from .base import DAILY_P, PREDICTED, RETURNS, SCORED, daily_by_priority, predicted, r, returns, scored, table
from .registry import query


def _rounded(df, keys, digits=6):
    return df.select(*keys, *[r(c, digits).alias(c) for c in df.columns if c not in keys])


_BY_SCORE = f"""{SCORED}, d AS (SELECT g, p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY 1, 2),
c AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pa, coalesce(sum(neg) OVER w, 0) AS na, sum(pos) OVER (PARTITION BY g) AS np, sum(neg) OVER (PARTITION BY g) AS nn FROM d WINDOW w AS (PARTITION BY g ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"""WITH {_BY_SCORE} SELECT g, round(sum(neg * (pa + pos / 2)) / nullif(any_value(np * nn), 0), 6) AS auc, round(sum(pos * (pa + pos) / (pa + pos + na + neg)) / nullif(any_value(np), 0), 6) AS average_precision,
 round(arg_max((pa + pos) / (pa + pos + na + neg), CASE WHEN pa + pos >= 0.8 * np THEN p END), 6) AS precision_at_recall, round(max(CASE WHEN na + neg <= 0.05 * nn THEN (pa + pos) / nullif(np, 0) ELSE 0 END), 6) AS recall_at_fpr FROM c GROUP BY g""")
def ranking_scores(spark, sf_dir):
    return _rounded(S.ranking_scores(scored(spark, sf_dir), "g", "p", "y"), ["g"])


@query(f"""WITH {SCORED}, c AS (SELECT *, least(greatest(p, 1e-7), 1 - 1e-7) AS q, (p >= 0.5)::INT AS f FROM scored) SELECT g, count(*) AS n, round(-avg(y * ln(q) + (1 - y) * ln(1 - q)), 6) AS log_loss, round(avg((p - y) ** 2), 6) AS brier,
 round(sum(f * y) / nullif(sum(y), 0), 6) AS recall, round(sum(f * y) / nullif(sum(f), 0), 6) AS precision, round(avg(f), 6) AS flagged FROM c GROUP BY g""")
def threshold_scores(spark, sf_dir):
    return _rounded(S.threshold_scores(scored(spark, sf_dir), "g", "p", "y", 0.5), ["g", "n"])


def _ece_sql(bin_sql: str) -> str:
    return f"WITH {SCORED}, b AS (SELECT g, {bin_sql} AS b, count(*) AS k, avg(p) AS conf, avg(y) AS acc FROM scored GROUP BY 1, 2) SELECT g, round(sum(k * abs(acc - conf)) / sum(k), 6) AS ece FROM b GROUP BY g"


_ABOVE = "(SELECT min(i) FROM range(1, 16) t(i) WHERE p <= i / 15.0::DOUBLE)"


@query(_ece_sql(_ABOVE))
def calibration_error_closed_above(spark, sf_dir):
    return _rounded(S.calibration_error(scored(spark, sf_dir), "g", "p", "y"), ["g"])


@query(_ece_sql("least(floor(p * 15), 14)"))
def calibration_error_closed_below(spark, sf_dir):
    return _rounded(S.calibration_error(scored(spark, sf_dir), "g", "p", "y", closed_above=False), ["g"])


@query(f"""WITH {SCORED}, b AS (SELECT g, {_ABOVE} AS b, count(*) AS k, avg(p) AS conf, avg(y) AS acc FROM scored GROUP BY 1, 2), n AS (SELECT g, count(*) AS n FROM scored GROUP BY 1),
s AS (SELECT g, sum(k / n * ((acc - conf) ** 2 - acc * (1 - acc) / (k - 1))) AS s FROM b JOIN n USING (g) WHERE k > 1 GROUP BY g) SELECT g, round(sign(s) * sqrt(abs(s)), 6) AS l2 FROM s""")
def calibration_l2_debiased(spark, sf_dir):
    return _rounded(S.debiased_l2(scored(spark, sf_dir), "g", "p", "y"), ["g"])


@query(f"""WITH {SCORED}, o AS (SELECT g, (y = (p >= 0.5)::INT)::INT AS c, abs(p - 0.5) AS s, id FROM scored), w AS (SELECT g, c, avg(1 - c) OVER (PARTITION BY g ORDER BY s DESC, id ROWS UNBOUNDED PRECEDING) AS risk, row_number() OVER (PARTITION BY g ORDER BY s DESC, id) AS i, count(*) OVER (PARTITION BY g) AS n FROM o)
SELECT g, round(avg(risk), 6) AS aurc, round(avg(c) FILTER (i <= floor(n * 0.2::DOUBLE)), 6) AS accuracy_at_coverage FROM w GROUP BY g""")
def selective_risk(spark, sf_dir):
    s = scored(spark, sf_dir).select("g", "id", (F.col("y") == (F.col("p") >= 0.5).cast("int")).alias("c"), F.abs(F.col("p") - 0.5).alias("s"))
    return _rounded(S.selective_risk(s, "g", "s", "c", "id"), ["g"])


@query(f"""WITH {SCORED}, f AS (SELECT *, (p >= 0.6)::INT AS f FROM scored) SELECT g, round(avg(y), 6) AS base, round(avg(f), 6) AS flag, round(sum(f * (1 - y)) / nullif(sum(1 - y), 0), 6) AS fpr, round(sum((1 - f) * y) / nullif(sum(y), 0), 6) AS fnr,
 round(sum(f * y) / nullif(sum(f), 0), 6) AS ppv, round(avg(p) - avg(y), 6) AS gap FROM f GROUP BY g""")
def group_fairness_rates(spark, sf_dir):
    return _rounded(S.group_rates(scored(spark, sf_dir), "g", "p", "y", 0.6), ["g"])


@query(f"WITH {SCORED} SELECT g, round(quantile_cont(p, 0.9), 6) AS threshold FROM scored WHERE y = 0 GROUP BY g")
def equal_fpr_thresholds(spark, sf_dir):
    return _rounded(S.equal_fpr_thresholds(scored(spark, sf_dir), "g", "p", "y", 0.1), ["g"])


@query(f"WITH {SCORED}, t AS (SELECT unnest([0.2, 0.4, 0.6, 0.8])::DOUBLE AS threshold) SELECT g, threshold, round(avg(5 * (p < threshold)::INT * y + (p >= threshold)::INT * (1 - y)), 6) AS cost FROM scored, t GROUP BY ALL")
def cost_curve(spark, sf_dir):
    out = None
    for t in (0.2, 0.4, 0.6, 0.8):
        c = _rounded(S.cost_at(scored(spark, sf_dir), "g", "p", "y", t, 5.0), ["g"]).withColumn("threshold", F.lit(t))
        out = c if out is None else out.unionByName(c)
    return out


@query(f"WITH {_BY_SCORE} SELECT g, round(least(min((5 * (np - pa - pos) + na + neg) / (np + nn)), min(5 * np / (np + nn))), 6) AS best_cost FROM c GROUP BY g")
def best_cost_threshold(spark, sf_dir):
    return _rounded(S.best_cost(scored(spark, sf_dir), "g", "p", "y", 5.0), ["g"])


_TWO = f"{SCORED}, two AS (SELECT g, (y = (p >= 0.5)::INT)::INT AS a, (y = (p >= 0.8)::INT)::INT AS b, id, p, y FROM scored)"


def _two(spark, sf_dir):
    y = F.col("y")
    return scored(spark, sf_dir).select("g", (y == (F.col("p") >= 0.5).cast("int")).alias("a"), (y == (F.col("p") >= 0.8).cast("int")).alias("b"), "id", "p", "y")


@query(f"""WITH {_TWO} SELECT g, count(*) AS n, sum((a > b)::INT)::BIGINT AS only_a, sum((b > a)::INT)::BIGINT AS only_b, round(avg((a <> b)::INT), 6) AS discordance, round(avg(a - b), 6) AS difference,
 round(sqrt((avg((a - b) ** 2) - avg(a - b) ** 2) / count(*)), 6) AS se_paired, round(sqrt((avg(a) * (1 - avg(a)) + avg(b) * (1 - avg(b))) / count(*)), 6) AS se_unpaired FROM two GROUP BY g""")
def paired_model_comparison(spark, sf_dir):
    return _rounded(S.paired(_two(spark, sf_dir), "g", "a", "b"), ["g", "n", "only_a", "only_b"])


@query("""WITH v AS (SELECT l_returnflag AS g, l_orderkey AS k, (l_discount > 0.05)::INT::DOUBLE AS v FROM lineitem), c AS (SELECT g, k, avg(v) AS m, var_pop(v) AS s, count(*) AS n FROM v GROUP BY 1, 2)
SELECT g, (SELECT round(stddev_pop(v) / sqrt(count(*)), 6) FROM v WHERE v.g = c.g) AS se_naive, round(stddev_samp(m) / sqrt(count(*)), 6) AS se_cluster, round(1 - sum(s * n) / sum(n) / (SELECT var_pop(v) FROM v WHERE v.g = c.g), 6) AS icc FROM c GROUP BY g""")
def clustered_standard_error(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_orderkey").alias("k"), (F.col("l_discount") > 0.05).cast("double").alias("v"))
    return _rounded(S.clustered_error(v, "g", "k", "v"), ["g"])


@query(f"""WITH {RETURNS}, l AS (SELECT series, k AS lag, ret AS x, lag(ret, k) OVER (PARTITION BY series, k ORDER BY date) AS b FROM rets, range(1, 6) t(k)) SELECT series, lag::INT AS lag, round(corr(x, b), 6) AS r, count(b) AS n FROM l GROUP BY 1, 2""")
def lag_correlations(spark, sf_dir):
    return S.lag_correlations(returns(spark, sf_dir).withColumn("s", F.col("series")), "series", "s", "date", "ret", 5).select("series", "lag", r("r").alias("r"), "n")


@query(f"""WITH {SCORED}, o AS (SELECT list_sort(list(p)) AS v, (count(*) - 1) * (1 - avg(y)) AS i FROM scored), c AS (SELECT v[floor(i)::INT + 1] + (i - floor(i)) * (v[ceil(i)::INT + 1] - v[floor(i)::INT + 1]) AS cut FROM o) SELECT g, round(avg((p >= cut)::INT), 6) AS judged, round(avg(y), 6) AS actual, round(avg((p >= cut)::INT) FILTER (y = 1), 6) AS pass_right, round(avg((p >= cut)::INT) FILTER (y = 0), 6) AS pass_wrong FROM scored, c GROUP BY g""")
def judge_calibration(spark, sf_dir):
    return _rounded(S.judged(scored(spark, sf_dir), "g", "p", "y"), ["g"])


_PPI = f"""{SCORED}, q AS (SELECT g, (p >= 0.6)::INT AS j, y AS t, id % 4 = 0 AS l FROM scored), a AS (SELECT g, count(*) FILTER (l) AS n, count(*) FILTER (NOT l) AS m, avg(t) FILTER (l) AS t, avg(j) FILTER (l) AS jl, avg(j) FILTER (NOT l) AS ju,
 covar_samp(t, j) FILTER (l) AS c, var_samp(j) FILTER (l) AS vj, var_samp(j) FILTER (NOT l) AS vu, var_samp(t) FILTER (l) AS vt FROM q GROUP BY g), b AS (SELECT *, least(1.0, greatest(0.0, c / nullif((1 + n / m) * vj, 0))) AS k FROM a)"""


@query(f"WITH {_PPI} SELECT g, round(k, 6) AS lambda, round(k * ju + t - k * jl, 6) AS estimate, round(sqrt(k * k * vu / m + (vt + k * k * vj - 2 * k * c) / n), 6) AS se, round(ju, 6) AS judge_only, round(t, 6) AS label_only FROM b")
def prediction_powered_inference(spark, sf_dir):
    q = scored(spark, sf_dir).select("g", (F.col("p") >= 0.6).alias("j"), F.col("y").alias("t"), (F.col("id") % 4 == 0).alias("l"))
    return _rounded(S.prediction_powered(q, "g", "j", "t", "l"), ["g"])


@query(f"WITH {PREDICTED} SELECT grp, count(*) AS n, round(avg((truth BETWEEN pred - 20000 AND pred + 900 * scale)::INT), 6) AS coverage, round(avg(900 * scale + 20000), 4) AS mean_width, round(quantile_cont(900 * scale + 20000, 0.5), 4) AS median_width FROM predicted GROUP BY grp")
def interval_coverage(spark, sf_dir):
    p = predicted(spark, sf_dir).select("grp", "truth", (F.col("pred") - 20000).alias("lo"), (F.col("pred") + 900 * F.col("scale")).alias("hi"))
    c = S.interval_coverage(p, "grp", "truth", "lo", "hi")
    return c.select("grp", "n", r("coverage").alias("coverage"), r("mean_width", 4).alias("mean_width"), r("median_width", 4).alias("median_width"))


_FC = f"{DAILY_P}, fc AS (SELECT series, date, value AS y, lag(value, 7) OVER w AS p, lag(value, 1) OVER w AS last FROM dp WINDOW w AS (PARTITION BY series ORDER BY date))"


def _forecast(spark, sf_dir):
    w = Window.partitionBy("series").orderBy("date")
    return daily_by_priority(spark, sf_dir).select("series", "date", F.col("value").alias("y"), F.lag("value", 7).over(w).alias("p"), F.lag("value", 1).over(w).alias("last"))


@query(f"""WITH {_FC} SELECT series, round(sqrt(avg((p - y) ** 2)), 4) AS rmse, round(avg(abs(p - y)), 4) AS mae, round(sqrt(avg((p - y) ** 2)) / sqrt(avg(y * y)), 4) AS nrmse, round(1 - avg((p - y) ** 2) / var_pop(y), 4) AS r2,
 round(avg((sign(y - last) = sign(p - last))::INT) FILTER (y <> last), 4) AS direction FROM fc WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY series""")
def forecast_errors(spark, sf_dir):
    return _rounded(S.forecast_errors(_forecast(spark, sf_dir), ["series"], "y", "p", "last"), ["series"], 4)


@query(f"WITH {_FC} SELECT series, round(avg(greatest(0.9 * (y - p), -0.1 * (y - p))), 4) AS pinball FROM fc WHERE p IS NOT NULL GROUP BY series")
def pinball_loss(spark, sf_dir):
    return _rounded(S.pinball(_forecast(spark, sf_dir).filter("p is not null").withColumn("q", F.col("p")), ["series"], "y", "q", 0.9), ["series"], 4)


@query(f"WITH {_FC}, m AS (SELECT series, year(date) AS year, avg(abs(p - y)) / avg(abs(y - last)) AS mase FROM fc WHERE p IS NOT NULL GROUP BY 1, 2) SELECT series, round(exp(avg(ln(greatest(mase, 1e-6)))), 6) AS geomean, count(*) AS n FROM m GROUP BY 1")
def forecast_leaderboard(spark, sf_dir):
    f = _forecast(spark, sf_dir).filter("p is not null")
    m = f.groupBy("series", F.year("date").alias("year")).agg((F.avg(F.abs(F.col("p") - F.col("y"))) / F.avg(F.abs(F.col("y") - F.col("last")))).alias("mase"))
    return S.geometric(m, "series", "mase").select("series", r("geomean").alias("geomean"), "n")


_R = f"{RETURNS}, s AS (SELECT series, date, ret / 10000 AS x FROM rets)"


def _small(spark, sf_dir):
    return returns(spark, sf_dir).withColumn("x", F.col("ret") / 10000)


@query(f"WITH {_R} SELECT series, round(exp(sum(ln(1 + x)) * 252 / count(*)) - 1, 6) AS time_weighted FROM s GROUP BY 1")
def time_weighted_return(spark, sf_dir):
    return _rounded(S.time_weighted(_small(spark, sf_dir), "series", "x"), ["series"])


@query(f"WITH {_R}, l AS (SELECT series, date, sum(ln(1 + x)) OVER (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING) AS l FROM s), t AS (SELECT series, l, greatest(0, max(l) OVER (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING)) AS t FROM l) SELECT series, round(1 - exp(min(l - t)), 6) AS drawdown FROM t GROUP BY 1")
def drawdown(spark, sf_dir):
    return _rounded(S.drawdown(_small(spark, sf_dir), "series", "date", "x"), ["series"])


@query(f"""WITH {_R}, k AS (SELECT series, ln(1 + x) AS l, row_number() OVER (PARTITION BY series ORDER BY x DESC, date) AS u, row_number() OVER (PARTITION BY series ORDER BY x, date) AS d FROM s)
SELECT series, round(exp(sum(l)) - 1, 6) AS all_days, round(exp(sum(l) FILTER (u > 10)) - 1, 6) AS without_best, round(exp(sum(l) FILTER (d > 10)) - 1, 6) AS without_worst FROM k GROUP BY 1""")
def best_and_worst_days(spark, sf_dir):
    return _rounded(S.without_best(_small(spark, sf_dir), "series", "x", "date", 10), ["series"])


@query("WITH k AS (SELECT role, conv_id % 8 AS k, length(text) // 50 = lag(length(text) // 50) OVER (PARTITION BY conv_id % 8 ORDER BY conv_id, turn) AS same FROM conversations) SELECT k, round(avg(coalesce(same, false)::INT), 6) AS twin_share FROM k GROUP BY 1")
def adjacency_leak(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 8).alias("k"), F.struct("conv_id", "turn").alias("o"), F.floor(F.length("text") / 50).alias("t"))
    return _rounded(S.adjacency(c, "t", "o", "k"), ["k"])
