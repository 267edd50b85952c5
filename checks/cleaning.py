"""Cleaning operators on columns with derived gaps and repeats."""

from checks.registry import query, table as t
from ledgerline.operators import clean as C, quality as Q
from pyspark.sql import functions as F

GAP = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END"
TYPE_GAP = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END"
SOURCE = f"(SELECT event_id, {GAP} AS value, {TYPE_GAP} AS event_type FROM events)"
FENCES = f"""(SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo,
    quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM {SOURCE})"""


def gappy(spark, d):
    return t(spark, d, "events").select("event_id", F.expr(GAP).alias("value"), F.expr(TYPE_GAP).alias("event_type"))


def rounded(df):
    return df.withColumn("value", F.round("value", 4))


for _s, _v in {
    "mean": f"(SELECT avg(value) FROM {SOURCE})",
    "median": f"(SELECT quantile_cont(value, 0.5) FROM {SOURCE})",
    "mode": f"(SELECT value FROM {SOURCE} WHERE value IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
    "constant": "-1.5",
    "zero": "0",
}.items():
    query(
        f"clean_fill_{_s}",
        f"SELECT event_id, round(coalesce(value, {_v}), 4) AS value, event_type FROM {SOURCE}",
    )(lambda spark, d, s=_s: rounded(C.fill_missing(gappy(spark, d), "value", s, -1.5)))


@query(
    "clean_fill_mode_text",
    f"""SELECT event_id, value, coalesce(event_type, (SELECT event_type FROM {SOURCE} WHERE event_type IS NOT NULL
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type FROM {SOURCE}""",
)
def fill_mode_text(spark, d):
    return C.fill_missing(gappy(spark, d), "event_type", "mode")


@query("clean_drop_missing_column", f"SELECT * FROM {SOURCE} WHERE value IS NOT NULL")
def drop_missing_column(spark, d):
    return C.drop_missing(gappy(spark, d), "value")


@query("clean_drop_missing_any", f"SELECT * FROM {SOURCE} WHERE value IS NOT NULL AND event_type IS NOT NULL")
def drop_missing_any(spark, d):
    return C.drop_missing(gappy(spark, d))


@query("clean_drop_column", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def drop_column(spark, d):
    return C.drop_column(t(spark, d, "customer"), "c_name")


@query("clean_remove_duplicates", "SELECT DISTINCT lang, source FROM documents")
def remove_duplicates(spark, d):
    return C.remove_duplicates(t(spark, d, "documents").select("lang", "source"))


@query("clean_clip_outliers", f"SELECT event_id, round(CASE WHEN value IS NULL THEN NULL ELSE greatest(least(value, hi), lo) END, 4) AS value, event_type FROM {SOURCE}, {FENCES}")
def clip(spark, d):
    return rounded(C.handle_outliers(gappy(spark, d), "value", "clip"))


@query("clean_remove_outliers", f"SELECT event_id, value, event_type FROM {SOURCE}, {FENCES} WHERE value IS NULL OR value BETWEEN lo AND hi")
def remove_outliers(spark, d):
    return C.handle_outliers(gappy(spark, d), "value", "remove")


TEXT = "CASE WHEN event_id % 10 = 0 THEN 'N/A' WHEN event_id % 10 = 1 THEN '1d' ELSE CAST({c} AS {text}) END"


def _text(spark, d, column):
    return t(spark, d, "events").select("event_id", F.expr(TEXT.format(c=column, text="STRING")).alias("v"))


@query("clean_convert_int", f"SELECT event_id, TRY_CAST(v AS BIGINT) AS v FROM (SELECT event_id, {TEXT.format(c='user_id', text='VARCHAR')} AS v FROM events)")
def convert_int(spark, d):
    return C.convert_type(_text(spark, d, "user_id"), "v", "int")


@query("clean_convert_float", f"SELECT event_id, TRY_CAST(v AS DOUBLE) AS v FROM (SELECT event_id, {TEXT.format(c='value', text='VARCHAR')} AS v FROM events)")
def convert_float(spark, d):
    return C.convert_type(_text(spark, d, "value"), "v", "float")


@query("clean_convert_string", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def convert_string(spark, d):
    return C.convert_type(t(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "string")


@query("clean_convert_category", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def convert_category(spark, d):
    return C.convert_type(t(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "category")


DATES = """CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y')
    WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 3 THEN strftime(o_orderdate, '%b %d, %Y') ELSE 'not a date' END"""


@query(
    "clean_convert_datetime",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderdate END AS day FROM orders",
)
def convert_datetime(spark, d):
    spelled = F.expr(
        """CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'MM/dd/yyyy')
        WHEN 2 THEN date_format(o_orderdate, 'yyyy/MM/dd') WHEN 3 THEN date_format(o_orderdate, 'MMM dd, yyyy') ELSE 'not a date' END"""
    )
    return C.convert_type(t(spark, d, "orders").select("o_orderkey", spelled.alias("day")), "day", "datetime")


ACTIONS = C.plan_actions(
    remove_duplicates=True, drop_columns=["event_id"], missing={"value": "median", "event_type": "drop"}, outliers={"value": "clip"}
)
_DEDUPED = f"(SELECT DISTINCT event_id // 2 AS event_id, {GAP} AS value, {TYPE_GAP} AS event_type FROM events)"
_TYPED = f"""(SELECT coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {_DEDUPED})) AS value, event_type FROM {_DEDUPED}
    WHERE event_type IS NOT NULL)"""


def _halved(spark, d):
    return gappy(spark, d).withColumn("event_id", F.expr("event_id div 2"))


@query(
    "clean_actions",
    f"""SELECT round(greatest(least(value, hi), lo), 4) AS value, event_type FROM {_TYPED},
    (SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo,
    quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM {_TYPED})""",
)
def actions(spark, d):
    return rounded(C.apply_actions(_halved(spark, d), ACTIONS)[0])


@query(
    "clean_actions_log",
    f"""WITH kept AS (SELECT value, event_type FROM {_DEDUPED}), filled AS (SELECT * FROM {_TYPED}),
    limits AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM filled)
    SELECT 1::BIGINT AS step, 'duplicates: ' || ((SELECT count(*) FROM events) - (SELECT count(*) FROM {_DEDUPED})) || ' repeated rows taken out' AS description
    UNION ALL SELECT 2, 'column event_id: left out'
    UNION ALL SELECT 3, 'column value: ' || (SELECT count(*) - count(value) FROM kept) || ' gaps closed by median'
    UNION ALL SELECT 4, 'column event_type: ' || (SELECT count(*) - count(event_type) FROM kept) || ' rows with a gap taken out'
    UNION ALL SELECT 5, 'column value: held within ' || printf('%.2f', a - 1.5 * (b - a)) || ' and ' || printf('%.2f', b + 1.5 * (b - a)) FROM limits""",
)
def actions_log(spark, d):
    return C.apply_actions(_halved(spark, d), ACTIONS)[1]


@query(
    "clean_compare",
    f"""SELECT metric, CAST(original AS BIGINT) AS original, CAST(cleaned AS BIGINT) AS cleaned, CAST(change AS BIGINT) AS change FROM (
    SELECT 'row_count' AS metric, (SELECT count(*) FROM {SOURCE}) AS original, (SELECT count(*) FROM {SOURCE} WHERE value IS NOT NULL) AS cleaned
    UNION ALL SELECT 'column_count', 3, 3
    UNION ALL SELECT 'missing_values_count', (SELECT 2 * count(*) - count(value) - count(event_type) FROM {SOURCE}),
      (SELECT count(*) - count(event_type) FROM {SOURCE} WHERE value IS NOT NULL)
    UNION ALL SELECT 'duplicate_rows_count', 0, 0
    UNION ALL SELECT 'logical_bytes', (SELECT count(*) * 16 + sum(strlen(event_type)) FROM {SOURCE}),
      (SELECT count(*) * 16 + sum(strlen(event_type)) FROM {SOURCE} WHERE value IS NOT NULL)) v(metric, original, cleaned),
    LATERAL (SELECT cleaned - original AS change)""",
)
def compare(spark, d):
    before = gappy(spark, d)
    return Q.compare_profiles(before, C.drop_missing(before, "value"))


@query("clean_saved_copy", f"SELECT * FROM {SOURCE} WHERE value IS NOT NULL")
def saved_copy(spark, d):
    return spark.read.parquet(C.save_copy(C.drop_missing(gappy(spark, d), "value")))
