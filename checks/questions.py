"""Filters, aggregates, top-k and plan questions."""

from checks.registry import query, table as t
from ledgerline.functions import values as V
from ledgerline.operators import aggregates as A, predicates as P
from ledgerline.plans.run import grounding, run_plan
from pyspark.sql import functions as F

OVER_25 = [{"column": "l_quantity", "operator": "greater_than", "value": 25}]
NOTED = "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END"


@query(
    "plan_top_n_sum",
    """SELECT l_returnflag AS "group", round(sum(l_extendedprice), 4) AS value FROM lineitem
    WHERE l_quantity > 25 GROUP BY 1 ORDER BY value DESC, 1 LIMIT 3""",
)
def plan_top_n_sum(spark, d):
    plan = {"operation": "top_n", "column": "l_extendedprice", "group_by": "l_returnflag", "agg": "sum", "n": 3, "filters": OVER_25}
    return run_plan(t(spark, d, "lineitem"), plan)


@query(
    "plan_top_n_ascending_mean",
    """SELECT CAST(l_suppkey AS VARCHAR) AS "group", round(avg(l_discount), 4) AS value FROM lineitem
    GROUP BY l_suppkey ORDER BY avg(l_discount), l_suppkey LIMIT 7""",
)
def plan_top_n_ascending_mean(spark, d):
    plan = {"operation": "top_n", "column": "l_discount", "group_by": "l_suppkey", "agg": "mean", "n": 7, "ascending": True}
    return run_plan(t(spark, d, "lineitem"), plan)


def _whole(agg):
    def run(spark, d):
        plan = {"operation": "aggregate", "column": "l_extendedprice", "agg": agg}
        return run_plan(t(spark, d, "lineitem"), plan)

    return run


for _agg, _sql in {
    "sum": "sum(l_extendedprice)",
    "mean": "avg(l_extendedprice)",
    "count": "CAST(count(l_extendedprice) AS DOUBLE)",
    "min": "min(l_extendedprice)",
    "max": "max(l_extendedprice)",
    "median": "quantile_cont(l_extendedprice, 0.5)",
}.items():
    query(f"plan_aggregate_{_agg}", f"SELECT round({_sql}, 4) AS value FROM lineitem")(_whole(_agg))


def _by_group(agg):
    def run(spark, d):
        plan = {"operation": "aggregate", "column": "o_totalprice", "agg": agg, "group_by": "o_custkey"}
        return run_plan(t(spark, d, "orders"), plan)

    return run


for _agg, _sql in {
    "sum": "sum(o_totalprice)",
    "mean": "avg(o_totalprice)",
    "count": "CAST(count(o_totalprice) AS DOUBLE)",
    "min": "min(o_totalprice)",
    "max": "max(o_totalprice)",
    "median": "quantile_cont(o_totalprice, 0.5)",
}.items():
    query(
        f"plan_grouped_{_agg}",
        f"""SELECT CAST(o_custkey AS VARCHAR) AS "group", round({_sql}, 4) AS value FROM orders
        GROUP BY o_custkey ORDER BY {_sql} DESC, o_custkey LIMIT 25""",
    )(_by_group(_agg))


@query(
    "plan_grouped_nulls_last",
    """SELECT o_orderstatus AS "group", round(value, 4) AS value FROM (
      SELECT o_orderstatus, max(CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice END) AS value
      FROM orders GROUP BY 1) ORDER BY value DESC NULLS LAST, 1 LIMIT 25""",
)
def plan_grouped_nulls_last(spark, d):
    o = t(spark, d, "orders").withColumn("price", F.expr("CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice END"))
    return A.ranked_groups(o, "price", "o_orderstatus", "max")


@query(
    "plan_grouped_sum_null_keys",
    f"""SELECT k AS "group", round(coalesce(sum(v), 0), 4) AS value FROM (
      SELECT {NOTED} AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_totalprice END AS v FROM orders)
    WHERE k IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25""",
)
def plan_grouped_sum_null_keys(spark, d):
    o = t(spark, d, "orders").select(
        F.expr(NOTED).alias("k"), F.expr("CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_totalprice END").alias("v")
    )
    return run_plan(o, {"operation": "aggregate", "column": "v", "agg": "sum", "group_by": "k"})


@query("plan_count_rows", "SELECT count(*) AS row_count FROM events WHERE event_type = 'purchase'")
def plan_count_rows(spark, d):
    plan = {"operation": "count_rows", "filters": [{"column": "event_type", "operator": "equals", "value": "purchase"}]}
    return run_plan(t(spark, d, "events"), plan)


@query(
    "plan_describe_numeric",
    """SELECT 'value' AS "column", count(value) AS count, round(avg(value), 4) AS mean,
    round(quantile_cont(value, 0.5), 4) AS median, round(min(value), 4) AS min, round(max(value), 4) AS max,
    round(stddev_samp(value), 4) AS std FROM events""",
)
def plan_describe_numeric(spark, d):
    return run_plan(t(spark, d, "events"), {"operation": "describe_column", "column": "value"})


@query(
    "plan_describe_categorical",
    """SELECT 'event_type' AS "column", (SELECT count(event_type) FROM events) AS count,
    (SELECT count(DISTINCT event_type) FROM events) AS unique_count,
    row_number() OVER (ORDER BY count(*) DESC, event_type) AS rank, event_type AS value, count(*) AS value_count
    FROM events GROUP BY event_type ORDER BY rank LIMIT 5""",
)
def plan_describe_categorical(spark, d):
    return run_plan(t(spark, d, "events"), {"operation": "describe_column", "column": "event_type"})


@query(
    "plan_unique_values",
    """SELECT (SELECT count(DISTINCT p_type) FROM part) AS unique_count,
    row_number() OVER (ORDER BY count(*) DESC, p_type) AS rank, p_type AS value, count(*) AS count
    FROM part GROUP BY p_type ORDER BY rank LIMIT 20""",
)
def plan_unique_values(spark, d):
    return run_plan(t(spark, d, "part"), {"operation": "unique_values", "column": "p_type"})


@query(
    "plan_correlation",
    """SELECT 'l_quantity' AS column_a, 'l_extendedprice' AS column_b,
    round(corr(l_quantity, l_extendedprice), 4) AS correlation FROM lineitem""",
)
def plan_correlation(spark, d):
    plan = {"operation": "correlation", "column_a": "l_quantity", "column_b": "l_extendedprice"}
    return run_plan(t(spark, d, "lineitem"), plan)


@query(
    "plan_correlation_constant",
    "SELECT 'l_quantity' AS column_a, 'one' AS column_b, CAST(NULL AS DOUBLE) AS correlation",
)
def plan_correlation_constant(spark, d):
    li = t(spark, d, "lineitem").withColumn("one", F.lit(1))
    return run_plan(li, {"operation": "correlation", "column_a": "l_quantity", "column_b": "one"})


def _spine(lo, hi, step):
    return f"SELECT unnest(generate_series({lo}, {hi}, INTERVAL {step}))"


_TREND = {
    "D": ("events", "ts", "value", "CAST(ts AS DATE)", "SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS p FROM b"),
    "W": ("orders", "o_orderdate", "o_totalprice", "CAST(date_trunc('week', o_orderdate) AS DATE) + 6", "SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS p FROM b"),
    "M": ("orders", "o_orderdate", "o_totalprice", "last_day(CAST(o_orderdate AS DATE))", "SELECT last_day(CAST(m AS DATE)) AS p FROM (SELECT unnest(generate_series(date_trunc('month', lo), hi, INTERVAL 1 MONTH)) AS m FROM b)"),
    "Y": ("orders", "o_orderdate", "o_totalprice", "make_date(year(o_orderdate), 12, 31)", "SELECT make_date(year(CAST(m AS DATE)), 12, 31) AS p FROM (SELECT unnest(generate_series(date_trunc('year', lo), hi, INTERVAL 1 YEAR)) AS m FROM b)"),
}


def trend_sql(freq, agg_sql, absent):
    source, date, value, label, spine = _TREND[freq]
    return f"""WITH g AS (SELECT {label} AS p, {agg_sql.format(value)} AS v FROM {source} GROUP BY 1),
    b AS (SELECT min(p) AS lo, max(p) AS hi FROM g), s AS ({spine}),
    f AS (SELECT s.p, CASE WHEN g.p IS NULL THEN {absent} ELSE g.v END AS v FROM s LEFT JOIN g ON s.p = g.p
      ORDER BY s.p DESC LIMIT 36)
    SELECT CAST(p AS VARCHAR) AS period, round(v, 4) AS value FROM f"""


def _trend(freq, agg):
    source, date, value, *_ = _TREND[freq]

    def run(spark, d):
        plan = {"operation": "trend", "date_column": date, "value_column": value, "freq": freq, "agg": agg}
        return run_plan(t(spark, d, source), plan)

    return run


query("plan_trend_daily", trend_sql("D", "sum({0})", "0"))(_trend("D", "sum"))
query("plan_trend_weekly", trend_sql("W", "avg({0})", "NULL"))(_trend("W", "mean"))
query("plan_trend_monthly", trend_sql("M", "sum({0})", "0"))(_trend("M", "sum"))
query("plan_trend_monthly_median", trend_sql("M", "quantile_cont({0}, 0.5)", "NULL"))(_trend("M", "median"))
query("plan_trend_yearly", trend_sql("Y", "CAST(count({0}) AS DOUBLE)", "0"))(_trend("Y", "count"))


@query(
    "plan_trend_with_gaps",
    """WITH r AS (SELECT o_orderdate AS ts, o_totalprice AS v FROM orders
      WHERE o_orderpriority LIKE '%URGENT%' AND o_totalprice > 400000),
    g AS (SELECT CAST(ts AS DATE) AS p, avg(v) AS v FROM r GROUP BY 1),
    b AS (SELECT min(p) AS lo, max(p) AS hi FROM g),
    s AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS p FROM b)
    SELECT CAST(s.p AS VARCHAR) AS period, round(g.v, 4) AS value FROM s LEFT JOIN g ON s.p = g.p
    ORDER BY s.p DESC LIMIT 36""",
)
def plan_trend_with_gaps(spark, d):
    plan = {
        "operation": "trend", "date_column": "o_orderdate", "value_column": "o_totalprice", "freq": "D", "agg": "mean",
        "filters": [
            {"column": "o_orderpriority", "operator": "contains", "value": "urgent"},
            {"column": "o_totalprice", "operator": "greater_than", "value": 400000},
        ],
    }
    return run_plan(t(spark, d, "orders"), plan)


def _filtered(source, key, column, operator, value, **more):
    def run(spark, d):
        return P.apply_filters(t(spark, d, source), [{"column": column, "operator": operator, "value": value, **more}]).select(key, column)

    return run


query("filter_equals_text", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")(
    _filtered("customer", "c_custkey", "c_mktsegment", "equals", "BUILDING")
)
query("filter_equals_integer", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 7")(
    _filtered("customer", "c_custkey", "c_nationkey", "equals", 7)
)
query("filter_equals_float", "SELECT event_id, value FROM events WHERE value = (SELECT max(value) FROM events)")(
    lambda spark, d: P.apply_filters(
        t(spark, d, "events"),
        [{"column": "value", "operator": "equals", "value": t(spark, d, "events").agg(F.max("value")).first()[0]}],
    ).select("event_id", "value")
)
query("filter_greater_than", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000.5")(
    _filtered("customer", "c_custkey", "c_acctbal", "greater_than", "5000.5")
)
query("filter_less_than", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")(
    _filtered("customer", "c_custkey", "c_acctbal", "less_than", 0)
)
query("filter_contains_regex", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '(?i)^s.*(all|dard)$')")(
    _filtered("part", "p_partkey", "p_type", "contains", "^s.*(all|dard)$")
)
query("filter_contains_literal", "SELECT doc_id, source FROM documents WHERE contains(lower(source), 'c1')")(
    _filtered("documents", "doc_id", "source", "contains", "C1", literal=True)
)


@query(
    "filter_not_equals_keeps_missing",
    f"SELECT o_orderkey, k FROM (SELECT o_orderkey, {NOTED} AS k FROM orders) WHERE k IS NULL OR k <> '1-URGENT'",
)
def filter_not_equals(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.expr(NOTED).alias("k"))
    return P.apply_filters(o, [{"column": "k", "operator": "not_equals", "value": "1-URGENT"}])


@query(
    "filter_number_in_text",
    """SELECT event_id, k FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'N/A' ELSE CAST(event_id AS VARCHAR) END AS k
    FROM events) WHERE TRY_CAST(k AS DOUBLE) > 5000""",
)
def filter_number_in_text(spark, d):
    e = t(spark, d, "events").select(
        "event_id", F.expr("CASE WHEN event_id % 10 = 0 THEN 'N/A' ELSE CAST(event_id AS STRING) END").alias("k")
    )
    return P.apply_filters(e, [{"column": "k", "operator": "greater_than", "value": 5000}])


@query(
    "filter_conjunction",
    """SELECT c_mktsegment, count(*) AS count FROM customer WHERE c_acctbal > 0 AND c_acctbal < 9000
    AND c_mktsegment <> 'BUILDING' GROUP BY 1""",
)
def filter_conjunction(spark, d):
    rows = P.apply_filters(
        t(spark, d, "customer"),
        [
            {"column": "c_acctbal", "operator": "greater_than", "value": 0},
            {"column": "c_acctbal", "operator": "less_than", "value": 9000},
            {"column": "c_mktsegment", "operator": "not_equals", "value": "BUILDING"},
        ],
    )
    return A.group_sizes(rows, "c_mktsegment")


@query("rows_complete", "SELECT count(*) AS row_count FROM lineitem WHERE l_linenumber <> 7 AND l_returnflag <> 'N'")
def rows_complete(spark, d):
    li = t(spark, d, "lineitem").select(
        F.expr("CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END").alias("a"),
        F.expr("CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_tax END").alias("b"),
    )
    return A.count_rows(P.complete_rows(li, ["a", "b"]))


@query(
    "scatter_points",
    "SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem WHERE l_linenumber <> 7",
)
def scatter_points(spark, d):
    li = t(spark, d, "lineitem").withColumn("q", F.expr("CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END"))
    return P.numeric_points(li, "q", "l_extendedprice")


@query("group_sizes", "SELECT p_brand, count(*) AS count FROM part GROUP BY 1")
def group_sizes(spark, d):
    return A.group_sizes(t(spark, d, "part"), "p_brand")


@query(
    "value_counts_top_10",
    "SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS count FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 10",
)
def value_counts(spark, d):
    return A.value_counts(t(spark, d, "events"), "user_id", 10)


@query("distinct_count", "SELECT count(DISTINCT l_partkey) AS unique_count FROM lineitem")
def distinct_count(spark, d):
    return A.distinct_count(t(spark, d, "lineitem"), "l_partkey")


def _context_sql():
    """The column overview of the orders as rows of JSON text, absent entries left out."""
    number = """SELECT {i} AS ordinal, '{{"ordinal":{i},"column":"{c}","role":"numeric","dtype":"{t}","min":"' || CAST(round(min({c})::DOUBLE, 4) AS VARCHAR)
      || '","max":"' || CAST(round(max({c})::DOUBLE, 4) AS VARCHAR) || '","mean":' || round(avg({c}), 4) || '}}' AS entry FROM orders"""
    text = """SELECT {i}, '{{"ordinal":{i},"column":"{c}","role":"categorical","dtype":"string","unique_count":' || max(u) || ',"top_values":"'
      || string_agg({c}, ', ' ORDER BY n DESC, {c}) || '"}}' FROM (SELECT {c}, count(*) AS n, count(*) OVER () AS u FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)"""
    date = """SELECT 4, '{{"ordinal":4,"column":"o_orderdate","role":"datetime","dtype":"timestamp_ntz","min":"' || strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S')
      || '","max":"' || strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') || '"}}' FROM orders"""
    rows = [number.format(i=i, c=c, t=k) for i, c, k in ((0, "o_orderkey", "bigint"), (1, "o_custkey", "bigint"), (3, "o_totalprice", "double"))]
    rows += [text.format(i=i, c=c) for i, c in ((2, "o_orderstatus"), (5, "o_orderpriority"))] + [date.format()]
    return " UNION ALL ".join(rows)


def _java(v):
    """A positive double as Java writes it: with an exponent from ten million on."""
    digits = f"rtrim(replace(CAST({v} AS VARCHAR), '.', ''), '0')"
    return f"""CASE WHEN {v} < 1e7 THEN CAST({v} AS VARCHAR) ELSE {digits}[1] || '.' || coalesce(nullif({digits}[2:], ''), '0') || 'E' || CAST(floor(log10({v})) AS INTEGER) END"""


@query(
    "plan_grounding",
    f"""SELECT (SELECT '[' || string_agg(entry, ',' ORDER BY ordinal) || ']' FROM ({_context_sql()})) AS context,
    (SELECT '[' || string_agg('{{"group":"' || g || '","value":' || {_java('v')} || '}}', ',' ORDER BY v DESC, g) || ']' FROM
      (SELECT o_orderstatus AS g, round(sum(o_totalprice), 4) AS v FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)) AS result""",
)
def plan_grounding(spark, d):
    plan = {"operation": "top_n", "column": "o_totalprice", "group_by": "o_orderstatus", "n": 3}
    return grounding(t(spark, d, "orders"), plan)
