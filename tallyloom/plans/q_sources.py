"""Queries of the readers: tables are landed as files in the shared folder in the layout of a source, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.storage import fresh_dir
from tallyloom.sources import landed as S

from .base import DAILY, DAILY_P, MONTHLY, PANEL, daily, daily_by_priority, monthly, panel, r, table
from .registry import query


def _landed(df, name, **options):
    path = fresh_dir(df.sparkSession, name)
    df.write.options(header=True, **options).csv(path)
    return path


def _texts(df, name):
    path = fresh_dir(df.sparkSession, name)
    df.write.text(path)
    return path


@query(f"WITH {DAILY} SELECT date, value, 'orders' AS source_id FROM daily")
def csv_with_provenance(spark, sf_dir):
    path = _landed(daily(spark, sf_dir), "daily")
    return S.csv_with_source(spark, path, "orders", "date date, value double").drop("source_file")


@query("SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS status, nullif(CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END, '') AS priority FROM orders")
def pipe_separated_table(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    line = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderpriority")))
    return S.pipe_table(spark, _texts(o.select(line.alias("value")), "pipe"), ["id", "status", "priority"])


@query(f"WITH {DAILY_P}, s AS (SELECT unnest(['URG', '5-LOW']) AS series, unnest(['1-URGENT', '5-LOW']) AS was), d AS (SELECT DISTINCT date FROM dp WHERE series IN ('1-URGENT', '5-LOW') AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') SELECT d.date, s.series, dp.value FROM d CROSS JOIN s LEFT JOIN dp ON dp.series = s.was AND dp.date = d.date")
def multi_series_csv(spark, sf_dir):
    d = daily_by_priority(spark, sf_dir).groupBy(F.col("date").alias("observation_date")).pivot("series", ["1-URGENT", "5-LOW"]).agg(F.first("value")).filter("`1-URGENT` is not null or `5-LOW` is not null")
    path = _landed(d, "series", nullValue=".")
    return S.multi_series_csv(spark, path, "1996-01-01", "1997-12-31", {"1-URGENT": "URG"})


@query("WITH v AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_totalprice AS value, CAST(date_trunc('month', o_orderdate) AS DATE) + (o_orderkey % 400)::INT AS since FROM orders), u AS (SELECT date, since, max(value) AS value FROM v GROUP BY 1, 2) SELECT date, arg_max(value, since) AS value FROM u WHERE since <= DATE '1998-06-30' GROUP BY 1")
def point_in_time_series(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = F.to_date(F.date_trunc("month", "o_orderdate"))
    v = o.groupBy(m.alias("date"), F.date_add(m, (F.col("o_orderkey") % 400).cast("int")).alias("since")).agg(F.max("o_totalprice").alias("value")).withColumn("until", F.lit(None).cast("date"))
    return S.as_published(v, "date", "value", "since", "until", "1998-06-30")


_SDMX = "s AS (SELECT year(o_orderdate) || '-Q' || quarter(o_orderdate) AS p, o_orderpriority AS k, o_orderstatus AS f, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY ALL)"
_Q_END = "last_day(make_date(left(p, 4)::INT, right(p, 1)::INT * 3, 1))"


def _sdmx(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    period = F.concat(F.year("o_orderdate").cast("string"), F.lit("-Q"), F.quarter("o_orderdate").cast("string"))
    s = o.groupBy(period.alias("TIME_PERIOD"), F.col("o_orderpriority").alias("KEY"), F.col("o_orderstatus").alias("FREQ")).agg(F.round(F.sum("o_totalprice"), 2).alias("OBS_VALUE"))
    return S.sdmx_csv(spark, _landed(s, "sdmx"))


@query(f"WITH {_SDMX} SELECT k AS KEY, f AS FREQ, {_Q_END} AS date, v AS OBS_VALUE FROM s")
def sdmx_rows(spark, sf_dir):
    return _sdmx(spark, sf_dir).select("KEY", "FREQ", "date", "OBS_VALUE")


@query(f"""WITH {_SDMX} SELECT {_Q_END} AS date, max(v) FILTER (k = '1-URGENT') AS "1-URGENT", max(v) FILTER (k = '5-LOW') AS "5-LOW" FROM s WHERE f = 'O' GROUP BY 1""")
def sdmx_slice(spark, sf_dir):
    return S.slice_to_columns(_sdmx(spark, sf_dir), {"FREQ": "O"}, "KEY", ["1-URGENT", "5-LOW"])


_PERIODS = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y%m') WHEN 2 THEN year(o_orderdate) || 'Q' || quarter(o_orderdate) ELSE strftime(o_orderdate, '%Y%m%d') END"


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN make_date(year(o_orderdate)::INT, 12, 31) WHEN 1 THEN last_day(o_orderdate) WHEN 2 THEN last_day(make_date(year(o_orderdate)::INT, quarter(o_orderdate)::INT * 3, 1)) ELSE CAST(o_orderdate AS DATE) END AS last,
 CASE o_orderkey % 4 WHEN 0 THEN make_date(year(o_orderdate)::INT, 1, 1) WHEN 1 THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN 2 THEN CAST(date_trunc('quarter', o_orderdate) AS DATE) ELSE CAST(o_orderdate AS DATE) END AS first FROM orders""")
def period_strings(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    p = F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "yyyyMM")).when(k == 2, F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))).otherwise(F.date_format(d, "yyyyMMdd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.period_date(p).alias("last"), S.period_date(p, end=False).alias("first"))


def _json_pages(spark, sf_dir):
    rows = panel(spark, sf_dir)
    first, last = rows.agg(F.min("year"), F.max("year")).first()
    n = last - first + 1
    item = F.struct(F.struct(F.col("indicator").alias("id"), F.col("indicator").alias("value")).alias("indicator"), F.struct(F.substring("country", 1, 2).alias("id"), F.col("country").alias("value")).alias("country"), F.upper(F.substring("country", 1, 3)).alias("countryiso3code"), F.col("year").cast("string").alias("date"), F.col("value").alias("value"))
    pages = rows.groupBy((F.col("year") - first + 1).alias("page")).agg(F.to_json(F.collect_list(item)).alias("rows"))
    text = F.concat(F.lit('[{"page":'), F.col("page").cast("string"), F.lit(f',"pages":{n}}},'), "rows", F.lit("]"))
    path = fresh_dir(spark, "pages")
    pages.repartition(n, "page").select("page", text.alias("value")).write.partitionBy("page").text(path)
    return S.paged_json(spark, f"{path}/*")


@query(f"WITH {PANEL} SELECT country, upper(left(country, 3)) AS iso3, year, value, indicator FROM panel")
def paged_json_rows(spark, sf_dir):
    return _json_pages(spark, sf_dir)


@query(f"""WITH {PANEL} SELECT country, upper(left(country, 3)) AS iso3, year, max(value) FILTER (indicator = '1-URGENT') AS "1-URGENT", max(value) FILTER (indicator = '5-LOW') AS "5-LOW" FROM panel GROUP BY 1, 2, 3""")
def indicator_panel(spark, sf_dir):
    return S.indicator_panel(_json_pages(spark, sf_dir), ["1-URGENT", "5-LOW"])


@query(f"WITH {PANEL} SELECT make_date(year, 12, 31) AS date, value FROM panel WHERE upper(left(country, 3)) = 'CHI' AND indicator = '5-LOW'")
def single_country_series(spark, sf_dir):
    return S.single_series(_json_pages(spark, sf_dir).filter("indicator = '5-LOW'"), "CHI")


def _wide(spark, sf_dir):
    p = panel(spark, sf_dir)
    years = [x["year"] for x in p.select("year").distinct().orderBy("year").collect()]
    w = p.groupBy(F.col("country").alias("iso3"), "indicator").pivot("year", years).agg(F.first("value"))
    lines = w.coalesce(1).select(F.concat_ws(",", "iso3", "indicator", *[F.coalesce(F.col(f"`{y}`").cast("decimal(20,2)").cast("string"), F.lit("")) for y in years]).alias("value"))
    head = spark.range(5, numPartitions=1).select(F.when(F.col("id") < 4, F.concat(F.lit("note "), F.col("id").cast("string"))).otherwise(",".join(["iso3", "indicator", *map(str, years)])).alias("value"))
    return S.preamble_csv(spark, _texts(head.union(lines).coalesce(1), "wide"), 4)


@query(f"WITH {PANEL} SELECT country AS iso3, indicator, year, value FROM panel WHERE country IN (SELECT n_name FROM nation WHERE n_regionkey > 0)")
def wide_years_to_long(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("iso3"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("region"))
    return S.years_to_long(_wide(spark, sf_dir), ["iso3", "indicator"], n)


_ENTITY = "e AS (SELECT n_name AS entity, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE upper(left(n_name, 3)) END AS code, CAST(year(o_orderdate) AS INTEGER) AS y, round(sum(o_totalprice), 2) AS total, count(*)::DOUBLE AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"


def _entities(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    code = F.when(F.col("n_nationkey") % 6 != 0, F.upper(F.substring("n_name", 1, 3)))
    e = rows.groupBy(F.col("n_name").alias("Entity"), code.alias("Code"), F.year("o_orderdate").alias("Year")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("orders"))
    return S.entity_csv(spark, _landed(e, "entity"))


@query(f"WITH {_ENTITY} SELECT entity, code, make_date(y, 12, 31) AS date, unnest(['total', 'orders']) AS measure, unnest([total, orders]) AS value FROM e")
def entity_csv(spark, sf_dir):
    return _entities(spark, sf_dir)


@query(f"WITH {_ENTITY} SELECT entity, make_date(y, 12, 31) AS date, total AS value FROM e WHERE entity <> 'CHINA' AND (code IS NULL OR code <> 'FRA')")
def without_aggregate_entities(spark, sf_dir):
    names, codes = spark.range(1).select(F.lit("CHINA").alias("entity")), spark.range(1).select(F.lit("FRA").alias("code"))
    return S.without_aggregates(_entities(spark, sf_dir).filter("measure = 'total'"), names, codes).select("entity", "date", "value")


@query("""WITH o AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_orderpriority AS k, o_totalprice AS v, o_orderkey AS s FROM orders) SELECT date, arg_max(v, s) FILTER (k = '1-URGENT') AS "1-URGENT", arg_max(v, s) FILTER (k = '5-LOW') AS "5-LOW" FROM o WHERE k IN ('1-URGENT', '5-LOW') GROUP BY 1""")
def wide_pivot_last_wins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderpriority in ('1-URGENT', '5-LOW')").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("date"), "o_orderpriority", "o_totalprice", "o_orderkey")
    return S.wide_last(o, "date", "o_orderpriority", "o_totalprice", "o_orderkey", ["1-URGENT", "5-LOW"])


@query("SELECT DISTINCT c AS citation FROM (SELECT unnest(['Chart of ' || r_name, 'by ' || r_name, CASE WHEN r_regionkey % 2 = 0 THEN 'short' ELSE 'long ' || r_name END]) AS c FROM region)")
def column_citations(spark, sf_dir):
    g = table(spark, sf_dir, "region")
    column = lambda **k: F.struct(*[v.alias(n) for n, v in k.items()])
    doc = F.struct(
        F.struct(F.col("r_name").alias("title"), F.concat(F.lit("Chart of "), "r_name").alias("citation")).alias("chart"),
        F.struct(column(attribution=F.concat(F.lit("by "), "r_name")).alias("a"), column(citationShort=F.when(F.col("r_regionkey") % 2 == 0, "short"), citationLong=F.concat(F.lit("long "), "r_name")).alias("b")).alias("columns"),
    )
    path = fresh_dir(spark, "metadata")
    g.select("r_regionkey", F.to_json(doc).alias("value")).repartition("r_regionkey").write.partitionBy("r_regionkey").text(path)
    return S.column_citations(spark, f"{path}/*")


@query(f"WITH {MONTHLY} SELECT series, date, value, year(date) = 1998 AS provisional FROM monthly")
def month_columns_to_long(spark, sf_dir):
    m = monthly(spark, sf_dir)
    first, last = m.agg(F.year(F.min("date")), F.year(F.max("date"))).first()
    label = F.concat(F.date_format("date", "yyyy/MM"), F.when(F.year("date") == 1998, " p)").otherwise(""))
    labels = [f"{y}/{i:02d}{' p)' if y == 1998 else ''}" for y in range(first, last + 1) for i in range(1, 13)]
    wide = m.withColumn("label", label).groupBy("series").pivot("label", labels).agg(F.first("value").cast("decimal(20,2)"))
    return S.month_columns(spark.read.option("header", True).csv(_landed(wide, "months")), ["series"])


@query("""WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, o_custkey AS k, o_orderpriority AS h, o_totalprice AS v, o_orderkey % 3 AS f, o_orderkey AS i FROM orders) SELECT m, k, h, v FROM o QUALIFY row_number() OVER (PARTITION BY m, k, h ORDER BY f, i) = 1""")
def overlapping_files_first_wins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("m"), F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("h"), F.col("o_totalprice").alias("v"), (F.col("o_orderkey") % 3).alias("f"), F.col("o_orderkey").alias("i"))
    total = o.groupBy("k", "h").agg(F.sum("v").alias("v")).select(F.lit("Total").alias("m"), "k", "h", "v", F.lit(0).alias("f"), F.lit(0).alias("i"))
    kept, _ = S.first_wins(o.unionByName(total), ["m", "k", "h"], "m", ["f", "i"])
    return kept.select("m", "k", "h", "v")


@query("SELECT l_orderkey, l_linenumber, l_quantity AS net, round(l_quantity * l_tax, 4) AS tax, round(l_quantity + round(l_quantity * l_tax, 4), 4) AS gross FROM lineitem")
def reconciled_totals(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    t = F.round(F.col("l_quantity") * F.col("l_tax"), 4)
    return S.reconciled(l.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("net"), t.alias("tax"), F.round(F.col("l_quantity") + t, 4).alias("gross")), ["net", "tax"], "gross", 0.001)


@query("""WITH m AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, month(o_orderdate) AS month, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2), p AS (SELECT year, max(value) AS peak, sum(value) / 1e6 AS twh, CASE WHEN count(*) = 12 THEN avg(value) END AS mean FROM m GROUP BY 1)
SELECT year, round(peak, 2) AS peak, round(twh, 6) AS twh, round(mean, 2) AS mean, round(100 * twh * 1e6 / (peak * 8760), 6) AS load_factor, round(peak / mean, 6) AS peak_to_mean FROM p WHERE year < (SELECT max(year) FROM p)""")
def annual_load_frame(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("value"))
    a = S.annual_frame(m.groupBy("year").agg(F.max("value").alias("peak")), m.groupBy("year").agg((F.sum("value") / 1e6).alias("twh")), m)
    return a.select("year", r("peak", 2).alias("peak"), r("twh").alias("twh"), r("mean", 2).alias("mean"), r("load_factor").alias("load_factor"), r("peak_to_mean").alias("peak_to_mean"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS amount FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2")
def loan_level_aggregates(spark, sf_dir):
    a = S.loan_aggregates(table(spark, sf_dir, "lineitem"), {"l_returnflag": ["A", "R"]}, ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return a.select("l_returnflag", "l_linestatus", "n", r("amount", 2).alias("amount"))


@query(f"WITH {DAILY} SELECT date, value AS close FROM daily")
def price_file(spark, sf_dir):
    d = daily(spark, sf_dir).select(F.date_format("date", "yyyy/MM/dd").alias("일자"), F.format_number("value", 2).alias("종가"), F.lit("1").alias("change"), F.lit("2").alias("volume"))
    return S.price_file(spark, _landed(d, "prices"))


@query(f"WITH {MONTHLY} SELECT series, date, value FROM monthly")
def survey_long_file(spark, sf_dir):
    m = monthly(spark, sf_dir).select(F.col("series").alias("series_id"), F.year("date").alias("year"), F.date_format("date", "'M'MM").alias("period"), F.col("value").cast("decimal(20,2)").alias("value"))
    annual = m.groupBy("series_id", "year").agg(F.avg("value").alias("value")).select("series_id", "year", F.lit("M13").alias("period"), "value")
    return S.survey_long(spark, _landed(m.unionByName(annual), "survey", sep="\t"))


@query(f"WITH {DAILY} SELECT date, value AS close, value * 2 AS volume FROM daily")
def quote_file(spark, sf_dir):
    d = daily(spark, sf_dir).select(F.col("date").alias("Date"), F.col("value").alias("Close"), (F.col("value") * 2).alias("Volume"))
    return S.quotes(spark, _landed(d, "quotes"), accept_terms=True)


@query(f"WITH {DAILY} SELECT count(*) AS rows, min(date) AS first, max(date) AS last FROM daily")
def csv_sink_report(spark, sf_dir):
    done = S.write_csv(daily(spark, sf_dir), fresh_dir(spark, "sink"), "date")
    return spark.createDataFrame([(done["rows"], done["first"], done["last"])], "rows long, first date, last date")


@query("SELECT sha256(t) AS sha256, strlen(t)::BIGINT AS n_bytes FROM (SELECT string_agg(n_nationkey || ',' || n_name || chr(10), '' ORDER BY n_nationkey) AS t FROM nation GROUP BY n_regionkey)")
def payload_manifest(spark, sf_dir):
    path = fresh_dir(spark, "payloads")
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name").repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_nationkey")
    n.write.partitionBy("n_regionkey").csv(path)
    return S.manifest(spark, f"{path}/*/*.csv").select("sha256", "n_bytes")  # names of files are new each time


def _sources(spark, sf_dir):
    g = table(spark, sf_dir, "region")
    return g.select(F.col("r_name").alias("source_id"), F.concat(F.lit("Office of "), "r_name").alias("citation"), F.lit("terms of use").alias("licence"), (F.col("r_regionkey") % 2 == 0).alias("redistributable"), F.array(F.concat(F.lit("WARNING "), "r_name"), F.lit("note")).alias("notes"))


_USED = "used AS (SELECT DISTINCT r_name, r_regionkey FROM region JOIN nation ON n_regionkey = r_regionkey)"


def _used(spark, sf_dir):
    g, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return n.join(g, n.n_regionkey == g.r_regionkey).select(F.col("r_name").alias("source_id"))


@query(f"WITH {_USED} SELECT 'Office of ' || r_name AS citation FROM used")
def citation_report(spark, sf_dir):
    return S.citations(_used(spark, sf_dir), _sources(spark, sf_dir))


@query(f"WITH {_USED} SELECT r_name AS source_id, 'not redistributable: terms of use' AS line FROM used WHERE r_regionkey % 2 = 1 UNION ALL SELECT r_name, 'WARNING ' || r_name FROM used")
def licence_report(spark, sf_dir):
    return S.licence_warnings(_used(spark, sf_dir), _sources(spark, sf_dir))


@query("""WITH o AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS d, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2) SELECT series AS item, d AS date, v AS value FROM o
UNION ALL SELECT series || '/Q', last_day(make_date(year(d), quarter(d) * 3, 1)), round(sum(v), 2) FROM o GROUP BY 1, 2 UNION ALL SELECT series || '/A', make_date(year(d), 12, 31), round(sum(v), 2) FROM o GROUP BY 1, 2""")
def statistic_service_rows(spark, sf_dir):
    o = daily_by_priority(spark, sf_dir)
    quarter = F.concat(F.year("date").cast("string"), F.lit("Q"), F.quarter("date").cast("string"))
    parts = [o.select("series", F.date_format("date", "yyyyMMdd").alias("t"), "value")]
    parts += [o.groupBy(F.concat("series", F.lit(tail)).alias("series"), t.alias("t")).agg(F.round(F.sum("value"), 2).alias("value")) for tail, t in (("/Q", quarter), ("/A", F.year("date").cast("string")))]
    rows = parts[0].union(parts[1]).union(parts[2])
    item = F.struct(F.lit("001").alias("STAT_CODE"), F.col("series").alias("ITEM_CODE1"), F.lit("won").alias("UNIT_NAME"), F.col("t").alias("TIME"), F.col("value").cast("decimal(20,2)").cast("string").alias("DATA_VALUE"))
    pages = rows.groupBy("series", F.substring("t", 1, 4).alias("y")).agg(F.collect_list(item).alias("row"))
    doc = F.to_json(F.struct(F.struct(F.size("row").alias("list_total_count"), F.col("row")).alias("StatisticSearch")))
    return S.statistic_json(spark, _texts(pages.select(doc.alias("value")), "statistics")).select("item", "date", "value")


@query(f"WITH {MONTHLY} SELECT series, date, value FROM monthly")
def survey_wide_table(spark, sf_dir):
    m = monthly(spark, sf_dir).withColumn("Year", F.year("date"))
    cells = m.groupBy("series", "Year").agg(*[F.max(F.when(F.month("date") == i, F.col("value").cast("decimal(20,2)").cast("string"))).alias(f"m{i}") for i in range(1, 13)])
    names = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
    line = F.concat_ws(",", F.col("Year").cast("string"), *[F.coalesce(F.col(f"m{i}"), F.lit("")) for i in range(1, 13)], F.lit("1.0"))
    head = m.select("series").distinct().withColumn("o", F.explode(F.sequence(F.lit(-3), F.length("series") % 3 - 2)))
    head = head.select("series", "o", F.when(F.col("o") == F.length("series") % 3 - 2, ",".join(["Year", *names, "Annual"])).otherwise(F.concat(F.lit("Series,"), "series")).alias("value"))
    lines = head.union(cells.select("series", "Year", line.alias("value")))
    path = fresh_dir(spark, "survey_wide")
    lines.repartition("series").sortWithinPartitions("series", "o").select("series", "value").write.partitionBy("series").text(path)
    return S.survey_wide(spark, path).select("series", "date", "value")


@query("""WITH l AS (SELECT o_orderpriority AS k, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) FILTER (month(o_orderdate) IN (12, 1, 2)) AS w, sum(o_totalprice) FILTER (month(o_orderdate) NOT IN (12, 1, 2)) AS s FROM orders GROUP BY 1, 2)
SELECT k, year, coalesce(w, 0) > coalesce(s, 0) AS winter_peak, round((round(coalesce(w, 0), 2) + round(coalesce(s, 0), 2)) / 1e6, 6) AS total_twh FROM l""")
def power_table(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cold = F.month("o_orderdate").isin(12, 1, 2)
    part = lambda c: F.round(F.coalesce(F.sum(F.when(c, F.col("o_totalprice"))), F.lit(0.0)), 2)
    t = o.groupBy(F.col("o_orderpriority").alias("c1"), F.year("o_orderdate").alias("c2")).agg(part(cold).alias("c3"), part(~cold).alias("c4")).withColumn("c5", F.round(F.col("c3") + F.col("c4"), 2))
    p = S.power_table(t, ["k", "year", "winter", "summer", "total"], "winter", "summer", "total", 0.5)
    return p.select("k", "year", "winter_peak", r("total_twh").alias("total_twh"))


@query("SELECT n_name AS name, n_regionkey::BIGINT AS region FROM nation")
def zipped_members(spark, sf_dir):
    import io
    import zipfile

    import pandas as pd

    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_name")

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr("metadata.csv", "note\nx\n")
            z.writestr("flow.csv", "skipped\n" + rows.rename(columns={"n_name": "name", "n_regionkey": "region"}).to_csv(index=False))
        return pd.DataFrame({"content": [held.getvalue()]})

    return S.zipped_members(n.groupBy("n_regionkey").applyInPandas(packed, "content binary"), "name string, region long", member=r"flow.*\.csv$", skip=1)


@query("SELECT n_name AS name, n_regionkey::BIGINT AS region FROM nation")
def largest_member(spark, sf_dir):
    import io
    import zipfile

    import pandas as pd

    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_name")

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr("in/Metadata_of_all.csv", "name,region\n" + "note,0\n" * 500)
            z.writestr("in/a_short.csv", "name,region\n")
            z.writestr("in/table.csv", rows.rename(columns={"n_name": "name", "n_regionkey": "region"}).to_csv(index=False))
        return pd.DataFrame({"content": [held.getvalue()]})

    return S.zipped_members(n.groupBy("n_regionkey").applyInPandas(packed, "content binary"), "name string, region long", member=r"API_.*\.csv$", largest=True)


@query(f"""WITH {DAILY}, m AS (SELECT date_trunc('month', date)::DATE AS date, round(avg(value), 2) AS value FROM daily WHERE month(date) <> 7 OR year(date) % 2 = 0 GROUP BY 1) SELECT date, value FROM m WHERE value > 0""")
def landed_month_matrix(spark, sf_dir):
    d = daily(spark, sf_dir).filter(~((F.month("date") == 7) & (F.year("date") % 2 == 1)))
    means = [F.coalesce(F.format_number(F.avg(F.when(F.month("date") == k, F.col("value"))), 2), F.lit("0")).alias(f"{k}M") for k in range(1, 13)]
    m = d.groupBy(F.year("date").alias("year")).agg(*means)
    return S.month_matrix(spark.read.option("header", True).csv(_landed(m, "months")), "year").select("date", r("value", 2).alias("value"))


@query(f"""WITH {DAILY}, y AS (SELECT year(date)::INT AS year, max(value) AS peak, arg_max(month(date), value)::INT AS month, count(*)::DOUBLE AS days FROM daily GROUP BY 1) SELECT year, month, round(peak, 2) AS peak, days, month IN (11, 12, 1, 2) AS winter_peak FROM y""")
def yearly_peaks(spark, sf_dir):
    y = daily(spark, sf_dir).groupBy(F.year("date").cast("string").alias("c1")).agg(F.max_by(F.month("date"), "value").cast("string").alias("c2"), F.format_number(F.max("value"), 2).alias("c3"), F.format_number(F.count("*"), 0).alias("c4"))
    none = spark.createDataFrame([("1900", "1", "-", "-")], y.schema)  # a year without a peak
    return S.peak_table(y.union(none), ["year", "month", "peak", "days"], "year", "month", "peak", ["days"])
