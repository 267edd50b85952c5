"""Charts as queries."""

from checks.registry import query, table as t
from ledgerline.operators import charts as G
from pyspark.sql import functions as F


def rounded(df, *columns):
    for c in columns or ("value",):
        df = df.withColumn(c, F.round(c, 4))
    return df


HISTOGRAM = """WITH b AS (SELECT min({v}) - CASE WHEN min({v}) = max({v}) THEN 0.5 ELSE 0 END AS a,
      max({v}) + CASE WHEN min({v}) = max({v}) THEN 0.5 ELSE 0 END AS z FROM {t}),
    c AS (SELECT least(CAST(floor(({v} - a) / ((z - a) / 20)) AS BIGINT), 19) AS bin, count(*) AS count FROM {t}, b WHERE {v} IS NOT NULL GROUP BY 1)
    SELECT s.bin, printf('%.2f–%.2f', a + s.bin * ((z - a) / 20), a + (s.bin + 1) * ((z - a) / 20)) AS label,
    round(a + s.bin * ((z - a) / 20), 4) AS lo, round(a + (s.bin + 1) * ((z - a) / 20), 4) AS hi, coalesce(c.count, 0) AS count
    FROM (SELECT unnest(range(20)) AS bin) s CROSS JOIN b LEFT JOIN c ON s.bin = c.bin"""


@query("chart_histogram", HISTOGRAM.format(v="o_totalprice", t="orders"))
def histogram(spark, d):
    return rounded(G.build(t(spark, d, "orders"), {"chart_type": "histogram", "x": "o_totalprice"}), "lo", "hi")


@query("chart_histogram_constant", HISTOGRAM.format(v="one", t="(SELECT CAST(7 AS DOUBLE) AS one FROM orders)"))
def histogram_constant(spark, d):
    o = t(spark, d, "orders").select(F.lit(7).alias("one"))
    return rounded(G.build(o, {"chart_type": "histogram", "x": "one"}), "lo", "hi")


@query("chart_histogram_empty_bins", HISTOGRAM.format(v="v", t="(SELECT value * value * value AS v FROM events)"))
def histogram_empty(spark, d):
    e = t(spark, d, "events").select(F.expr("value * value * value").alias("v"))
    return rounded(G.build(e, {"chart_type": "histogram", "x": "v"}), "lo", "hi")


@query("chart_bar_sum", "SELECT l_returnflag AS x, round(sum(l_extendedprice), 4) AS value FROM lineitem GROUP BY 1")
def bar_sum(spark, d):
    return rounded(G.build(t(spark, d, "lineitem"), {"chart_type": "bar", "x": "l_returnflag", "y": "l_extendedprice"}))


@query(
    "chart_bar_count_by_key",
    "SELECT CAST(l_suppkey AS VARCHAR) AS x, CAST(count(l_tax) AS DOUBLE) AS value FROM lineitem GROUP BY l_suppkey ORDER BY l_suppkey LIMIT 50",
)
def bar_count(spark, d):
    return G.build(t(spark, d, "lineitem"), {"chart_type": "bar", "x": "l_suppkey", "y": "l_tax", "aggregation": "count"})


@query(
    "chart_bar_rows",
    "SELECT CAST(user_id AS VARCHAR) AS x, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 50",
)
def bar_rows(spark, d):
    return G.build(t(spark, d, "events"), {"chart_type": "bar", "x": "user_id"})


@query(
    "chart_line_median",
    "SELECT CAST(l_linenumber AS VARCHAR) AS x, round(quantile_cont(l_extendedprice, 0.5), 4) AS value FROM lineitem GROUP BY l_linenumber",
)
def line_median(spark, d):
    spec = {"chart_type": "line", "x": "l_linenumber", "y": "l_extendedprice", "aggregation": "median"}
    return rounded(G.build(t(spark, d, "lineitem"), spec))


@query(
    "chart_line_by_date",
    """SELECT CAST(o_orderdate AS VARCHAR) AS x, round(sum(o_totalprice), 4) AS value FROM orders GROUP BY o_orderdate
    ORDER BY sum(o_totalprice) DESC, o_orderdate LIMIT 50""",
)
def line_by_date(spark, d):
    return rounded(G.build(t(spark, d, "orders"), {"chart_type": "line", "x": "o_orderdate", "y": "o_totalprice"}))


@query(
    "chart_area_ordered_by_x",
    "SELECT CAST(o_orderdate AS VARCHAR) AS x, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY o_orderdate ORDER BY o_orderdate LIMIT 50",
)
def area_by_x(spark, d):
    spec = {"chart_type": "area", "x": "o_orderdate", "y": "o_totalprice", "aggregation": "mean", "order": "x"}
    return rounded(G.build(t(spark, d, "orders"), spec))


@query(
    "chart_pie_filtered",
    "SELECT p_type AS x, round(max(p_retailprice), 4) AS value FROM part WHERE p_size > 10 GROUP BY 1",
)
def pie(spark, d):
    spec = {
        "chart_type": "pie", "x": "p_type", "y": "p_retailprice", "aggregation": "max", "group_by": "p_brand",
        "filters": [{"column": "p_size", "operator": "greater_than", "value": 10}],
    }
    return rounded(G.build(t(spark, d, "part"), spec))


def grouped_sql(source, x, g, value):
    return f"""WITH v AS (SELECT {x} AS x, {g} AS g, {value} AS v FROM {source} GROUP BY 1, 2)
    SELECT CAST(a.x AS VARCHAR) AS x, CAST(b.g AS VARCHAR) AS series, round(CASE WHEN v.x IS NULL THEN 0 ELSE v.v END, 4) AS value
    FROM (SELECT DISTINCT x FROM v ORDER BY x LIMIT 50) a CROSS JOIN (SELECT DISTINCT g FROM v) b
    LEFT JOIN v ON v.x = a.x AND v.g = b.g"""


@query("chart_grouped", grouped_sql("lineitem", "l_returnflag", "l_linestatus", "sum(l_extendedprice)"))
def grouped(spark, d):
    spec = {"chart_type": "bar", "x": "l_returnflag", "y": "l_extendedprice", "group_by": "l_linestatus"}
    return rounded(G.build(t(spark, d, "lineitem"), spec))


@query("chart_grouped_absent_pairs", grouped_sql("events", "user_id", "event_type", "avg(value)"))
def grouped_absent(spark, d):
    spec = {"chart_type": "line", "x": "user_id", "y": "value", "group_by": "event_type", "aggregation": "mean"}
    return rounded(G.build(t(spark, d, "events"), spec))


@query("chart_scatter", "SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part")
def scatter(spark, d):
    return G.build(t(spark, d, "part"), {"chart_type": "scatter", "x": "p_size", "y": "p_retailprice"})


SUGGESTED = """WITH d AS (SELECT count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p FROM orders),
    fit AS (SELECT 1 AS o, 'histogram' AS chart_type, 'o_orderkey' AS x, CAST(NULL AS VARCHAR) AS y, 'How o_orderkey is spread' AS title, 'a number: where its values lie' AS reason
    UNION ALL SELECT 2, 'histogram', 'o_custkey', NULL, 'How o_custkey is spread', 'a number: where its values lie'
    UNION ALL SELECT 3, 'histogram', 'o_totalprice', NULL, 'How o_totalprice is spread', 'a number: where its values lie'
    UNION ALL SELECT 4, 'bar', 'o_orderstatus', NULL, 'Rows for each o_orderstatus', 'few enough values to stand side by side' FROM d WHERE s BETWEEN 1 AND 15
    UNION ALL SELECT 5, 'bar', 'o_orderpriority', NULL, 'Rows for each o_orderpriority', 'few enough values to stand side by side' FROM d WHERE p BETWEEN 1 AND 15
    UNION ALL SELECT 6, 'line', 'o_orderdate', 'o_orderkey', 'o_orderkey through o_orderdate', 'a number along a date: how it moves'
    UNION ALL SELECT 7, 'scatter', 'o_orderkey', 'o_custkey', 'o_orderkey against o_custkey', 'two numbers: whether they go together')
    SELECT row_number() OVER (ORDER BY o) AS rank, chart_type, x, y, title, reason FROM fit"""


@query("chart_suggestions", SUGGESTED)
def suggestions(spark, d):
    return G.suggest(t(spark, d, "orders"))


@query(
    "chart_saved_specs",
    """SELECT event_type AS title, 'bar' AS chart_type, 'user_id' AS x, CAST(NULL AS VARCHAR) AS y, 'sum' AS aggregation,
    event_type AS group_by, CAST(NULL AS VARCHAR) AS filters FROM events GROUP BY 1""",
)
def saved_specs(spark, d):
    kinds = t(spark, d, "events").select("event_type").distinct()
    spec = F.to_json(
        F.struct(F.lit("bar").alias("chart_type"), F.lit("user_id").alias("x"), F.lit("sum").alias("aggregation"), F.col("event_type").alias("group_by"))
    )
    saved = kinds.select(F.col("event_type").alias("title"), spec.alias("config"))
    return G.parse_specs(saved, "config").withColumn("filters", F.to_json("filters"))


@query(
    "chart_saved_rerun",
    """SELECT 0::BIGINT AS ord, 'bar' AS chart_type, o_orderstatus AS label, CAST(NULL AS VARCHAR) AS series, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 3
    UNION ALL SELECT 1, 'pie', o_orderpriority, NULL, CAST(count(*) AS DOUBLE) FROM orders WHERE o_totalprice > 1000 GROUP BY 3
    UNION ALL SELECT 2, 'bar', 'x: the table has no column ' || chr(39) || 'gone' || chr(39), NULL, NULL""",
)
def saved_rerun(spark, d):
    """Three saved charts of the orders, one of which names a column that is gone."""
    spec = F.expr(
        """CASE r_regionkey WHEN 0 THEN '{"chart_type":"bar","x":"o_orderstatus","y":"o_totalprice"}'
        WHEN 1 THEN '{"chart_type":"pie","x":"o_orderpriority","filters":[{"column":"o_totalprice","operator":"greater_than","value":"1000"}]}'
        WHEN 2 THEN '{"chart_type":"bar","x":"gone"}' END"""
    )
    saved = t(spark, d, "region").select("r_regionkey", spec.alias("config")).where("config is not null")
    return G.run_saved(t(spark, d, "orders"), saved, "config", "r_regionkey").withColumn("value", F.round("value", 2))


def _bins_sql(ord, column):
    bins = HISTOGRAM.format(v="v", t=f"(SELECT CAST({column} AS DOUBLE) AS v FROM part)")
    return f"SELECT {ord}::BIGINT AS ord, 'histogram' AS chart_type, label, CAST(NULL AS VARCHAR) AS series, CAST(count AS DOUBLE) AS value FROM ({bins})"


@query(
    "chart_suggestions_run",
    f"""{_bins_sql(0, "p_size")} UNION ALL {_bins_sql(1, "p_retailprice")}
    UNION ALL SELECT 2, 'bar', p_brand, NULL, n FROM (SELECT p_brand, count(*) AS n, count(*) OVER () AS brands FROM part GROUP BY 1) WHERE brands <= 15
    UNION ALL SELECT CASE WHEN (SELECT count(DISTINCT p_brand) FROM part) <= 15 THEN 3 ELSE 2 END, 'scatter', CAST(CAST(p_size AS DOUBLE) AS VARCHAR), NULL, p_retailprice FROM part""",
)
def suggestions_run(spark, d):
    rows = t(spark, d, "part").select("p_brand", "p_size", "p_retailprice")
    found = [r.asDict() for r in G.suggest(rows).orderBy("rank").collect()]
    return G.build_all(rows, [{"chart_type": r["chart_type"], "x": r["x"], "y": r["y"]} for r in found])
