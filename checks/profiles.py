"""Roles, descriptive statistics, quality scans and the dataset profile."""

from checks.registry import query, table as t
from ledgerline.operators import describe as D, quality as Q, roles as R
from pyspark.sql import functions as F

NUMS = ["l_quantity", "l_extendedprice", "l_discount"]
# Missing values are derived by the same rule on both sides; the tables themselves have none.
GAPPY = "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END"
MIXED = "CASE WHEN event_id % 10 = 0 THEN 'N/A' ELSE CAST(event_id AS {text}) END"
DAY = "CASE WHEN event_id % 10 = 0 THEN 'unknown' ELSE CAST(CAST(ts AS DATE) AS {text}) END"


def dated_events(spark, d):
    return t(spark, d, "events").select("event_id", "event_type", F.expr(DAY.format(text="STRING")).alias("day"), "value")


@query(
    "roles_classify",
    """SELECT * FROM (VALUES (0::BIGINT, 'event_id', 'bigint', 'numeric'), (1, 'event_type', 'string', 'categorical'),
      (3, 'value', 'double', 'numeric')) v(ordinal, "column", spark_type, role)
    UNION ALL SELECT 2, 'day', 'string', CASE WHEN avg(CASE WHEN TRY_CAST(day AS DATE) IS NOT NULL THEN 1 ELSE 0 END) >= 0.85
      THEN 'datetime' ELSE 'categorical' END FROM (SELECT """ + DAY.format(text="VARCHAR") + " AS day FROM events)",
)
def roles_classify(spark, d):
    return R.classify(dated_events(spark, d))


@query(
    "roles_date_share",
    "SELECT 'day' AS \"column\", avg(CASE WHEN TRY_CAST(day AS DATE) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT "
    + DAY.format(text="VARCHAR")
    + " AS day FROM events)",
)
def roles_date_share(spark, d):
    return R.date_share(dated_events(spark, d), ["day"])


@query(
    "roles_features",
    """SELECT 0::BIGINT AS ordinal, 'c_acctbal' AS "column", 'numeric' AS role
    UNION ALL SELECT 1, 'c_mktsegment', CASE WHEN count(DISTINCT c_mktsegment) <= 30 THEN 'categorical' ELSE 'dropped' END FROM customer
    UNION ALL SELECT 2, 'c_name', CASE WHEN count(DISTINCT c_name) <= 30 THEN 'categorical' ELSE 'dropped' END FROM customer""",
)
def roles_features(spark, d):
    return R.feature_roles(t(spark, d, "customer"), ["c_acctbal", "c_mktsegment", "c_name"])


_TASK = """SELECT count({c}) AS known, CASE WHEN count(DISTINCT {c}) <= 20 THEN 'classification' ELSE 'regression' END
    AS task_type FROM {t}"""


@query("task_type_few_numbers", _TASK.format(c="l_linenumber", t="lineitem"))
def task_few(spark, d):
    return R.task_type(t(spark, d, "lineitem"), "l_linenumber")


@query("task_type_many_numbers", _TASK.format(c="o_totalprice", t="orders"))
def task_many(spark, d):
    return R.task_type(t(spark, d, "orders"), "o_totalprice")


@query("task_type_text", "SELECT count(p_name) AS known, 'classification' AS task_type FROM part")
def task_text(spark, d):
    return R.task_type(t(spark, d, "part"), "p_name")


def numeric_sql(column, source, expr=None):
    v = expr or column
    return f"""SELECT '{column}' AS "column", count({v}) AS count, round(avg({v}), 4) AS mean,
    round(quantile_cont({v}, 0.5), 4) AS median,
    (SELECT round(m, 4) FROM (SELECT {v} AS m FROM {source} WHERE {v} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, m LIMIT 1)) AS mode,
    round(stddev_samp({v}), 4) AS std, round(min({v}), 4) AS min, round(max({v}), 4) AS max,
    round(quantile_cont({v}, 0.25), 4) AS q1, round(quantile_cont({v}, 0.75), 4) AS q3 FROM {source}"""


@query("eda_numeric", " UNION ALL ".join(numeric_sql(c, "lineitem") for c in NUMS))
def eda_numeric(spark, d):
    return D.numeric_summary(t(spark, d, "lineitem"), NUMS)


@query("eda_numeric_with_gaps", numeric_sql("l_discount", "lineitem", GAPPY))
def eda_numeric_gaps(spark, d):
    return D.numeric_summary(t(spark, d, "lineitem").select(F.expr(GAPPY).alias("l_discount")), ["l_discount"])


def top_sql(columns, source, k):
    parts = [
        f"""SELECT '{c}' AS "column", row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank, {c} AS value, count(*) AS count,
        CAST(sum(count(*)) OVER () AS BIGINT) AS total, count(*) OVER () AS unique_count FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}"""
        for c in columns
    ]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + f") WHERE rank <= {k}"


@query("eda_categorical", top_sql(["p_name", "p_brand", "p_type"], "part", 10))
def eda_categorical(spark, d):
    return D.categorical_summary(t(spark, d, "part"), ["p_name", "p_brand", "p_type"])


def dates_sql(column, source):
    def iso(end):
        stamp = f"{end}({column})"
        return f"strftime({stamp}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({stamp}) % 1000000 = 0 THEN '' ELSE strftime({stamp}, '.%f') END"

    return f"""SELECT '{column}' AS "column", count({column}) AS count, {iso("min")} AS min, {iso("max")} AS max,
    (epoch_us(max({column})) - epoch_us(min({column}))) // 86400000000 AS range_days FROM {source}"""


@query("eda_datetime", dates_sql("ts", "events"))
def eda_datetime(spark, d):
    return D.datetime_summary(t(spark, d, "events"), ["ts"])


def all_columns_sql(source, numbers, texts, dates):
    """Every metric of every column as a row: numbers in ``number``, texts in ``label``."""
    row = """SELECT "column", '{role}' AS role, {metric} AS metric, CAST({number} AS DOUBLE) AS number, CAST({label} AS VARCHAR) AS label FROM {part}"""
    rows = [row.format(role="numeric", metric=f"'{m}'", number=f'"{m}"', label="NULL", part="n") for m in D.NUMERIC_METRICS]
    rows += [row.format(role="categorical", metric="'top_' || rank", number="count", label="value", part="c")]
    rows += [row.format(role="categorical", metric=f"'{m}'", number=v, label="NULL", part="c WHERE rank = 1") for m, v in (("count", "total"), ("unique_count", "unique_count"))]
    rows += [row.format(role="datetime", metric=f"'{m}'", number=f'"{m}"', label="NULL", part="d") for m in ("count", "range_days")]
    rows += [row.format(role="datetime", metric=f"'{m}'", number="NULL", label=f'"{m}"', part="d") for m in ("min", "max")]
    return f"""WITH n AS ({" UNION ALL ".join(numeric_sql(c, source) for c in numbers)}), c AS ({top_sql(texts, source, 10)}),
    d AS ({" UNION ALL ".join(dates_sql(c, source) for c in dates)}) {" UNION ALL ".join(rows)}"""


@query("eda_all_columns", all_columns_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"], ["o_orderdate"]))
def eda_all(spark, d):
    return D.describe_all(t(spark, d, "orders"))


PAIRS = [(a, b) for i, a in enumerate(NUMS) for b in NUMS[i + 1 :]]


@query(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{x}' AS column_a, '{y}' AS column_b, round(corr({a}, {b}), 4) AS correlation FROM lineitem"
        for a, b in PAIRS
        for x, y in ((a, b), (b, a))
    )
    + "".join(f" UNION ALL SELECT '{c}', '{c}', 1.0" for c in NUMS),
)
def correlation_matrix(spark, d):
    return D.correlation_matrix(t(spark, d, "lineitem"), NUMS)


@query(
    "correlation_pairwise_complete",
    f"""SELECT column_a, column_b, ordinal_a, ordinal_b, round(r, 4) AS correlation FROM (
    SELECT 'a' AS column_a, 'b' AS column_b, 0::BIGINT AS ordinal_a, 1::BIGINT AS ordinal_b, corr(a, b) AS r FROM (SELECT {GAPPY} AS a, l_tax AS b FROM lineitem)
    WHERE a IS NOT NULL AND b IS NOT NULL)""",
)
def correlation_gaps(spark, d):
    return D.pair_correlations(t(spark, d, "lineitem").select(F.expr(GAPPY).alias("a"), F.col("l_tax").alias("b")), ["a", "b"])


@query(
    "correlation_strongest_pair",
    """SELECT column_a, column_b, correlation FROM (
      SELECT 'l_quantity' AS column_a, 'l_extendedprice' AS column_b, round(corr(l_quantity, l_extendedprice), 4) AS correlation, 1 AS o FROM lineitem
      UNION ALL SELECT 'l_quantity', 'net', round(corr(l_quantity, l_extendedprice * (1 - l_discount)), 4), 2 FROM lineitem
      UNION ALL SELECT 'l_extendedprice', 'net', round(corr(l_extendedprice, l_extendedprice * (1 - l_discount)), 4), 3 FROM lineitem)
    WHERE abs(correlation) >= 0.3 ORDER BY abs(correlation) DESC, o LIMIT 1""",
)
def strongest(spark, d):
    li = t(spark, d, "lineitem").withColumn("net", F.expr("l_extendedprice * (1 - l_discount)"))
    return D.strongest_pair(li, ["l_quantity", "l_extendedprice", "net"])


@query(
    "dataset_context",
    """SELECT 0::BIGINT AS ordinal, 'c_custkey' AS "column", 'numeric' AS role, 'bigint' AS dtype, CAST(round(min(c_custkey)::DOUBLE, 4) AS VARCHAR) AS min,
      CAST(round(max(c_custkey)::DOUBLE, 4) AS VARCHAR) AS max, round(avg(c_custkey), 4) AS mean, CAST(NULL AS BIGINT) AS unique_count, CAST(NULL AS VARCHAR) AS top_values FROM customer
    UNION ALL SELECT 1, 'c_acctbal', 'numeric', 'double', CAST(round(min(c_acctbal), 4) AS VARCHAR), CAST(round(max(c_acctbal), 4) AS VARCHAR),
      round(avg(c_acctbal), 4), NULL, NULL FROM customer
    UNION ALL SELECT 2, 'c_mktsegment', 'categorical', 'string', NULL, NULL, NULL, (SELECT count(DISTINCT c_mktsegment) FROM customer),
      (SELECT string_agg(c_mktsegment, ', ' ORDER BY n DESC, c_mktsegment) FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5))""",
)
def dataset_context(spark, d):
    return D.dataset_context(t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"))


@query(
    "quality_missing",
    f"""SELECT 'gap' AS "column", count(*) - count(gap) AS count, round((count(*) - count(gap)) / count(*) * 100, 2) AS percentage
    FROM (SELECT {GAPPY} AS gap FROM lineitem)
    UNION ALL SELECT 'flag', count(*) - count(flag), round((count(*) - count(flag)) / count(*) * 100, 2)
    FROM (SELECT nullif(l_returnflag, 'R') AS flag FROM lineitem)""",
)
def quality_missing(spark, d):
    li = t(spark, d, "lineitem").select(
        "l_orderkey", F.expr(GAPPY).alias("gap"), F.expr("nullif(l_returnflag, 'R')").alias("flag"), "l_tax"
    )
    return Q.missing(li)


@query(
    "quality_duplicates",
    "SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS count FROM (SELECT count(*) AS c FROM documents GROUP BY lang, source)",
)
def quality_duplicates(spark, d):
    return Q.duplicates(t(spark, d, "documents").select("lang", "source"))


@query(
    "quality_duplicates_full_rows",
    "SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS count FROM (SELECT count(*) AS c FROM lineitem GROUP BY ALL)".replace(
        "GROUP BY ALL",
        "GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate",
    ),
)
def quality_duplicates_full(spark, d):
    return Q.duplicates(t(spark, d, "lineitem"))


@query(
    "quality_duplicate_positions",
    """SELECT doc_id AS row_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents)
    WHERE n > 1 ORDER BY doc_id LIMIT 20""",
)
def quality_positions(spark, d):
    return Q.duplicate_positions(t(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")


@query(
    "quality_duplicates_with_nulls",
    """SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS count FROM (SELECT count(*) AS c FROM
    (SELECT nullif(o_orderstatus, 'P') AS s, o_orderdate FROM orders) GROUP BY s, o_orderdate)""",
)
def quality_duplicates_nulls(spark, d):
    return Q.duplicates(t(spark, d, "orders").select(F.expr("nullif(o_orderstatus, 'P')").alias("s"), "o_orderdate"))


@query(
    "quality_constant",
    """SELECT 0::BIGINT AS ordinal, 'c_name' AS "column" FROM customer HAVING count(DISTINCT c_name) <= 1
    UNION ALL SELECT 1, 'one' FROM customer HAVING count(*) >= 0 UNION ALL SELECT 2, 'none' FROM customer HAVING count(*) >= 0
    UNION ALL SELECT 3, 'c_acctbal' FROM customer HAVING count(DISTINCT c_acctbal) <= 1""",
)
def quality_constant(spark, d):
    return Q.constant_columns(
        t(spark, d, "customer").select("c_name", F.lit(1).alias("one"), F.lit(None).cast("string").alias("none"), "c_acctbal")
    )


@query(
    "quality_high_cardinality",
    """SELECT 'c_name' AS "column", round(count(DISTINCT c_name) / count(*), 4) AS ratio FROM customer
    HAVING count(DISTINCT c_name) >= 0.9 * count(*) AND count(*) >= 20""",
)
def quality_high_cardinality(spark, d):
    return Q.high_cardinality(t(spark, d, "customer"))


def outlier_sql(column, source, expr=None):
    v = expr or column
    return f"""SELECT '{column}' AS "column", count(*) AS count, round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound
    FROM {source}, (SELECT quantile_cont({v}, 0.25) - 1.5 * (quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25)) AS lo,
      quantile_cont({v}, 0.75) + 1.5 * (quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25)) AS hi FROM {source})
    WHERE {v} < lo OR {v} > hi HAVING count(*) > 0"""


@query("quality_outliers", outlier_sql("value", "events") + " UNION ALL " + outlier_sql("squared", "events", "(value * value)"))
def quality_outliers(spark, d):
    e = t(spark, d, "events").select("event_id", "value", F.expr("value * value").alias("squared"))
    return Q.outliers(e)


@query(
    "quality_mostly_numeric_text",
    "SELECT 'mixed' AS \"column\", round(avg(CASE WHEN TRY_CAST(mixed AS DOUBLE) IS NULL THEN 0.0 ELSE 1.0 END) * 100, 2) AS looks_numeric_percentage FROM (SELECT "
    + MIXED.format(text="VARCHAR")
    + " AS mixed FROM events)",
)
def quality_mostly_numeric(spark, d):
    return Q.mostly_numeric_text(
        t(spark, d, "events").select(F.expr(MIXED.format(text="STRING")).alias("mixed"), "event_type", "props")
    )


_SCANNED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "gap"]
_SCAN = f"(SELECT *, {GAPPY} AS gap FROM lineitem)"


def scan_sql():
    """Every check of the lines with a gappy and a constant column; keys differ too little to be nearly all different."""
    bounds = " UNION ALL ".join(f"({outlier_sql(c, _SCAN)})" for c in _SCANNED)
    return f"""WITH o AS ({bounds})
    SELECT 'shape' AS "check", NULL AS "column", 'row_count' AS metric, CAST(count(*) AS DOUBLE) AS value FROM lineitem
    UNION ALL SELECT 'shape', NULL, 'column_count', 13.0
    UNION ALL SELECT 'shape', NULL, 'total_missing_cells', count(*) - count(gap) FROM {_SCAN}
    UNION ALL SELECT 'missing', 'gap', 'count', count(*) - count(gap) FROM {_SCAN}
    UNION ALL SELECT 'missing', 'gap', 'percentage', round((count(*) - count(gap)) / count(*) * 100, 2) FROM {_SCAN}
    UNION ALL SELECT 'constant', 'one', 'constant', 1.0
    UNION ALL SELECT 'duplicates', NULL, 'count', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) FROM lineitem
    UNION ALL SELECT 'outliers', "column", 'count', count FROM o UNION ALL SELECT 'outliers', "column", 'lower_bound', lower_bound FROM o
    UNION ALL SELECT 'outliers', "column", 'upper_bound', upper_bound FROM o"""


@query("quality_scan", scan_sql())
def quality_scan(spark, d):
    li = t(spark, d, "lineitem").withColumn("gap", F.expr(GAPPY)).withColumn("one", F.lit("x"))
    return Q.scan(li)


ORDER_BYTES = "count(*) * (8 + 8 + 8 + 8) + sum(strlen(o_orderstatus)) + sum(strlen(o_orderpriority))"


@query(
    "dataset_profile",
    f"""SELECT count(*) AS row_count, 6::BIGINT AS column_count, 0::BIGINT AS missing_values_count, 0::BIGINT AS duplicate_rows_count,
    CAST({ORDER_BYTES} AS BIGINT) AS logical_bytes, 'o_orderkey, o_custkey, o_totalprice' AS numeric_columns,
    'o_orderstatus, o_orderpriority' AS categorical_columns, 'o_orderdate' AS datetime_columns, false AS duplicate_detection_skipped FROM orders""",
)
def dataset_profile(spark, d):
    return Q.profile(t(spark, d, "orders"))
