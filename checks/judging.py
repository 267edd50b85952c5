"""Anomalies, model metrics, insight facts, recommendations and the report."""

from checks.drawing import HISTOGRAM
from checks.profiles import ORDER_BYTES, dates_sql, numeric_sql, outlier_sql, top_sql
from checks.registry import query, table as t
from ledgerline.operators import anomaly as N, describe as D, insight as I, metrics as M
from ledgerline.operators.forest import score_forest
from pyspark.sql import functions as F

MEASURES = ["value", "squared"]
GAP = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END"
E = f"(SELECT event_id, ts, user_id, event_type, {GAP} AS value, value * value AS squared FROM events)"


def measured(spark, d):
    return t(spark, d, "events").select(
        "event_id", "ts", "user_id", "event_type", F.expr(GAP).alias("value"), F.expr("value * value").alias("squared")
    )


IQR = f"""WITH r AS (SELECT * FROM {E} WHERE value IS NOT NULL AND squared IS NOT NULL),
    q AS (SELECT quantile_cont(value, 0.25) AS a1, quantile_cont(value, 0.75) AS a3, quantile_cont(squared, 0.25) AS b1, quantile_cont(squared, 0.75) AS b3 FROM r),
    f AS (SELECT a1 - 1.5 * (a3 - a1) AS al, a3 + 1.5 * (a3 - a1) AS ah, a3 - a1 AS ai, b1 - 1.5 * (b3 - b1) AS bl, b3 + 1.5 * (b3 - b1) AS bh, b3 - b1 AS bi FROM q),
    s AS (SELECT r.*, greatest(greatest(al - value, value - ah, 0) / ai, greatest(bl - squared, squared - bh, 0) / bi) AS score FROM r, f)"""


@query(
    "anomaly_iqr",
    IQR
    + """ SELECT round(score, 4) AS score, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS ts,
    user_id, event_type, round(value, 6) AS value, round(squared, 6) AS squared FROM s WHERE score > 0 ORDER BY s.score DESC, event_id LIMIT 200""",
)
def anomaly_iqr(spark, d):
    return N.detect(measured(spark, d), "iqr", MEASURES, "event_id")


@query("anomaly_iqr_summary", IQR + " SELECT count(*) AS row_count, count(*) FILTER (score > 0) AS anomaly_count, count(*) FILTER (score > 0) > 200 AS truncated FROM s")
def anomaly_iqr_summary(spark, d):
    return N.summary(N.score_iqr(measured(spark, d), MEASURES))


@query(
    "anomaly_iqr_bounds",
    IQR + " SELECT 'value' AS \"column\", round(al, 4) AS lower, round(ah, 4) AS upper FROM f UNION ALL SELECT 'squared', round(bl, 4), round(bh, 4) FROM f",
)
def anomaly_bounds(spark, d):
    return N.bounds(measured(spark, d), MEASURES)


Z = f"""WITH r AS (SELECT * FROM {E} WHERE value IS NOT NULL AND squared IS NOT NULL),
    m AS (SELECT avg(value) AS am, stddev_samp(value) AS asd, avg(squared) AS bm, stddev_samp(squared) AS bsd FROM r),
    s AS (SELECT event_id, value, squared, greatest(coalesce(abs(value - am) / nullif(asd, 0), 0), coalesce(abs(squared - bm) / nullif(bsd, 0), 0)) AS score FROM r, m)"""


@query(
    "anomaly_zscore",
    Z + " SELECT round(score, 4) AS score, event_id, round(value, 6) AS value, round(squared, 6) AS squared FROM s WHERE score > 3.0 ORDER BY s.score DESC, event_id LIMIT 200",
)
def anomaly_zscore(spark, d):
    return N.detect(measured(spark, d).select("event_id", *MEASURES), "zscore", MEASURES, "event_id")


@query(
    "anomaly_zscore_threshold",
    Z + " SELECT count(*) AS row_count, count(*) FILTER (score > 2.0) AS anomaly_count, count(*) FILTER (score > 2.0) > 200 AS truncated FROM s",
)
def anomaly_zscore_threshold(spark, d):
    return N.summary(N.score_zscore(measured(spark, d), MEASURES, 2.0))


@query("anomaly_plot_top_scores", Z + " SELECT event_id AS row_id, round(score, 4) AS score FROM s WHERE score > 3.0 ORDER BY s.score DESC, event_id LIMIT 30")
def anomaly_plot(spark, d):
    return N.score_plot(N.score_zscore(measured(spark, d), MEASURES), "event_id", ["value"])


@query("anomaly_plot_points", IQR + " SELECT round(value, 6) AS x, round(squared, 6) AS y, round(score, 4) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, event_id LIMIT 200")
def anomaly_points(spark, d):
    return N.score_plot(N.score_iqr(measured(spark, d), MEASURES), "event_id", MEASURES)


@query("anomaly_isolation_forest")
def anomaly_forest(spark, d):
    return N.ranked(score_forest(t(spark, d, "orders"), ["o_totalprice", "o_custkey"], "o_orderkey"), "o_orderkey")


# A fixed rule stands in for a model so that the metrics can be checked exactly.
RULE = "(SELECT l_returnflag = 'R' AS y, l_quantity > 25 AS p, l_quantity AS s FROM lineitem)"
FLAGS = "(SELECT l_returnflag AS y, CASE WHEN l_quantity > 30 THEN 'R' WHEN l_discount > 0.05 THEN 'N' ELSE 'A' END AS p FROM lineitem)"


def ruled(spark, d):
    return t(spark, d, "lineitem").selectExpr("l_returnflag = 'R' AS y", "l_quantity > 25 AS p", "l_quantity AS s")


def flagged(spark, d):
    return t(spark, d, "lineitem").selectExpr(
        "l_returnflag AS y", "CASE WHEN l_quantity > 30 THEN 'R' WHEN l_discount > 0.05 THEN 'N' ELSE 'A' END AS p"
    )


def confusion_sql(source):
    return f"""WITH c AS (SELECT y, p, count(*) AS n FROM {source} GROUP BY 1, 2), l AS (SELECT y AS v FROM c UNION SELECT p FROM c)
    SELECT a.v AS label, b.v AS prediction, coalesce(n, 0) AS count FROM l a CROSS JOIN l b LEFT JOIN c ON c.y = a.v AND c.p = b.v"""


@query("ml_confusion_binary", confusion_sql(RULE))
def confusion_binary(spark, d):
    return M.confusion(ruled(spark, d), "y", "p")


@query("ml_confusion_multiclass", confusion_sql(FLAGS))
def confusion_multi(spark, d):
    return M.confusion(flagged(spark, d), "y", "p")


@query("ml_label_union", f"SELECT y AS label FROM {FLAGS} UNION SELECT p FROM {FLAGS}")
def label_union(spark, d):
    return M.label_union(flagged(spark, d), "y", "p")


@query(
    "ml_metrics_binary",
    f"""SELECT round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 4) AS accuracy,
    round(count(*) FILTER (y AND p) / count(*) FILTER (p), 4) AS "precision", round(count(*) FILTER (y AND p) / count(*) FILTER (y), 4) AS recall,
    round(2 * count(*) FILTER (y AND p) / (count(*) FILTER (y) + count(*) FILTER (p)), 4) AS f1 FROM {RULE}""",
)
def metrics_binary(spark, d):
    return M.classification_metrics(ruled(spark, d), "y", "p")


@query(
    "ml_metrics_multiclass",
    f"""WITH l AS (SELECT v, (SELECT count(*) FROM {FLAGS} WHERE y = v AND p = v) AS tp, (SELECT count(*) FROM {FLAGS} WHERE y = v) AS sup,
      (SELECT count(*) FROM {FLAGS} WHERE p = v) AS cl FROM (SELECT DISTINCT y AS v FROM {FLAGS}))
    SELECT round(sum(tp) / sum(sup), 4) AS accuracy, round(sum(tp / cl * sup) / sum(sup), 4) AS "precision",
    round(sum(tp / sup * sup) / sum(sup), 4) AS recall, round(sum(2 * tp / (sup + cl) * sup) / sum(sup), 4) AS f1 FROM l""",
)
def metrics_multi(spark, d):
    return M.classification_metrics(flagged(spark, d), "y", "p")


AUC = """WITH g AS (SELECT {s} AS s, count(*) FILTER ({y}) AS pos, count(*) FILTER (NOT {y}) AS neg FROM {t} GROUP BY 1),
    c AS (SELECT pos, neg, sum(neg) OVER (ORDER BY s) - neg AS below FROM g)
    SELECT round(sum(pos * (below + neg / 2)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 4) AS roc_auc FROM c"""


@query("ml_auc", AUC.format(s="s", y="y", t=RULE))
def auc(spark, d):
    return M.roc_auc(ruled(spark, d), F.col("y"), F.col("s"))


@query("ml_auc_fine_scores", AUC.format(s="l_extendedprice * (1 - l_discount)", y="(l_returnflag = 'R')", t="lineitem"))
def auc_fine(spark, d):
    return M.roc_auc(t(spark, d, "lineitem"), F.expr("l_returnflag = 'R'"), F.expr("l_extendedprice * (1 - l_discount)"))


_OVR = """(WITH g AS (SELECT {s} AS s, count(*) FILTER (l_returnflag = '{c}') AS pos, count(*) FILTER (l_returnflag <> '{c}') AS neg FROM lineitem GROUP BY 1),
    c AS (SELECT pos, neg, sum(neg) OVER (ORDER BY s) - neg AS below FROM g)
    SELECT round(sum(pos * (below + neg / 2)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 4) AS a, sum(pos) AS n FROM c)"""


@query(
    "ml_auc_multiclass",
    "SELECT round(sum(a * n) / sum(n), 4) AS roc_auc FROM ("
    + " UNION ALL ".join(
        f"SELECT * FROM {_OVR.format(s=s, c=c)}" for c, s in (("A", "l_discount"), ("N", "l_tax"), ("R", "l_quantity"))
    )
    + ")",
)
def auc_multi(spark, d):
    li = t(spark, d, "lineitem").select("l_returnflag", F.array("l_discount", "l_tax", "l_quantity").alias("scores"))
    return M.roc_auc_weighted(li, "l_returnflag", "scores", ["A", "N", "R"])


@query(
    "ml_regression_metrics",
    """SELECT round(avg(abs(y - p)), 4) AS mae, round(avg((y - p) ** 2), 4) AS mse, round(sqrt(avg((y - p) ** 2)), 4) AS rmse,
    round(1 - avg((y - p) ** 2) / var_pop(y), 4) AS r2 FROM (SELECT l_extendedprice AS y, 1500 * l_quantity AS p FROM lineitem)""",
)
def regression(spark, d):
    return M.regression_metrics(t(spark, d, "lineitem").selectExpr("l_extendedprice AS y", "1500 * l_quantity AS p"), "y", "p")


@query(
    "ml_best_model",
    """SELECT * FROM (SELECT l_suppkey AS ordinal, 'rule ' || l_suppkey AS algorithm, 'classification' AS task_type, 'completed' AS status,
      round(avg(CASE WHEN (l_returnflag = 'R') = (l_quantity > 25) THEN 1.0 ELSE 0.0 END), 4) AS accuracy, CAST(NULL AS DOUBLE) AS r2,
      round(avg(CASE WHEN (l_returnflag = 'R') = (l_quantity > 25) THEN 1.0 ELSE 0.0 END), 4) AS primary_metric
      FROM lineitem GROUP BY l_suppkey) ORDER BY accuracy DESC, ordinal LIMIT 1""",
)
def best_model(spark, d):
    hit = F.avg(F.expr("CASE WHEN (l_returnflag = 'R') = (l_quantity > 25) THEN 1.0D ELSE 0.0D END"))
    results = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("ordinal")).agg(F.round(hit, 4).alias("accuracy"))
    return M.best_model(
        results.select(
            "ordinal", F.concat(F.lit("rule "), F.col("ordinal")).alias("algorithm"), F.lit("classification").alias("task_type"),
            F.lit("completed").alias("status"), "accuracy", F.lit(None).cast("double").alias("r2"),
        )
    )


@query(
    "ml_share_of_total",
    """SELECT p_brand AS feature, round(sum(p_retailprice), 6) AS importance,
    round(round(sum(p_retailprice), 6) / (SELECT sum(w) FROM (SELECT round(sum(p_retailprice), 6) AS w FROM part GROUP BY p_brand)) * 100, 2) AS importance_pct
    FROM part GROUP BY p_brand ORDER BY 2 DESC, 1 LIMIT 10""",
)
def share_of_total(spark, d):
    weights = t(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_retailprice").alias("importance"))
    return M.share_of_total(weights)


# Events with a derived gap and derived repeats, so that every kind of fact appears.
FACTS = "(SELECT value, value * value AS squared, event_type, ts, event_id FROM events)"


def fact_table(spark, d):
    return t(spark, d, "events").select("value", F.expr("value * value").alias("squared"), "event_type", "ts", "event_id")


def _outlier_counts():
    one = """SELECT '{c}' AS c, {o} AS o, count(*) AS n FROM {t}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})
      WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) HAVING count(*) > 0"""
    return " UNION ALL ".join(one.format(c=c, o=o, t=FACTS) for o, c in enumerate(("value", "squared", "event_id")))


@query(
    "insight_facts",
    f"""WITH g AS (SELECT event_type AS g, sum(value) AS v FROM {FACTS} GROUP BY 1),
    r AS (SELECT value AS v, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM {FACTS}),
    h AS (SELECT sum(v) FILTER (rn <= n // 2) AS a, sum(v) FILTER (rn > n // 2) AS b FROM r),
    c AS (SELECT 'value' AS a, 'squared' AS b, round(corr(value, squared), 4) AS r, 1 AS o FROM {FACTS}
      UNION ALL SELECT 'value', 'event_id', round(corr(value, event_id), 4), 2 FROM {FACTS}
      UNION ALL SELECT 'squared', 'event_id', round(corr(squared, event_id), 4), 3 FROM {FACTS}),
    x AS ({_outlier_counts()})
    SELECT 1::BIGINT AS ord, 'top_performer' AS type, 'Highest total value by event_type' AS detail, CAST(NULL AS VARCHAR) AS column_a, CAST(NULL AS VARCHAR) AS column_b,
      g AS "group", round(v, 4) AS value, CAST(NULL AS DOUBLE) AS first_half_total, CAST(NULL AS DOUBLE) AS second_half_total, CAST(NULL AS DOUBLE) AS percent_change
      FROM (SELECT * FROM g ORDER BY v DESC, g LIMIT 1)
    UNION ALL SELECT 2, 'bottom_performer', 'Lowest total value by event_type', NULL, NULL, g, round(v, 4), NULL, NULL, NULL FROM (SELECT * FROM g ORDER BY v, g DESC LIMIT 1)
    UNION ALL SELECT 3, 'trend', 'value: later half of the dates against the earlier', NULL, NULL, NULL, NULL, round(a, 4), round(b, 4), round((b - a) / abs(a) * 100, 2) FROM h
    UNION ALL SELECT 4, 'correlation', NULL, a, b, NULL, r, NULL, NULL, NULL FROM (SELECT * FROM c WHERE abs(r) >= 0.3 ORDER BY abs(r) DESC, o LIMIT 1)
    UNION ALL SELECT 5, 'anomaly', 'values far from the others in ' || c, c, NULL, NULL, n, NULL, NULL, NULL FROM (SELECT * FROM x ORDER BY n DESC, o LIMIT 1)""",
)
def insight_facts(spark, d):
    return I.facts(fact_table(spark, d), "event_id")


@query(
    "insight_group_extremes",
    """WITH g AS (SELECT o_custkey AS g, sum(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT (SELECT CAST(g AS VARCHAR) FROM g ORDER BY v DESC, g LIMIT 1) AS best, round((SELECT max(v) FROM g), 4) AS best_total,
    (SELECT CAST(g AS VARCHAR) FROM g ORDER BY v, g DESC LIMIT 1) AS worst, round((SELECT min(v) FROM g), 4) AS worst_total, (SELECT count(*) FROM g) AS groups""",
)
def group_extremes(spark, d):
    ends = I.group_extremes(t(spark, d, "orders"), "o_totalprice", "o_custkey")
    return ends.withColumn("best_total", F.round("best_total", 4)).withColumn("worst_total", F.round("worst_total", 4))


MESSY = "(SELECT event_type, CASE WHEN event_id % 8 = 0 THEN NULL ELSE round(value * value, 0) END AS amount, 'x' AS one FROM events)"


@query(
    "recommendations",
    f"""WITH q AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM {MESSY})
    SELECT 1::BIGINT AS ord, sum(c - 1) || ' rows repeat others: take them out, or sums count them twice.' AS text
      FROM (SELECT count(*) AS c FROM {MESSY} GROUP BY event_type, amount, one)
    UNION ALL SELECT 2, 'amount: ' || round((count(*) - count(amount)) / count(*) * 100, 2) || '% of the values are absent; fill them or find out why.' FROM {MESSY}
    UNION ALL SELECT 3, 'Always the same value, so nothing to learn from: one.'
    UNION ALL SELECT 4, 'amount: ' || count(*) || ' values lie far outside; look at their rows before relying on it.'
      FROM {MESSY}, q WHERE amount < q1 - 1.5 * (q3 - q1) OR amount > q3 + 1.5 * (q3 - q1) HAVING count(*) > 0""",
)
def recommendations(spark, d):
    messy = t(spark, d, "events").select(
        "event_type", F.expr("CASE WHEN event_id % 8 = 0 THEN NULL ELSE round(value * value, 0) END").alias("amount"), F.lit("x").alias("one")
    )
    return I.recommendations(messy)


def _plain(value):
    return f"regexp_replace(regexp_replace(printf('%.4f', {value}), '0+$', ''), '\\.$', '.0')"


def report_sql():
    """The report of the orders, section by section. No row of them repeats another, has a gap or the same value throughout."""
    numbers, texts = ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"]
    pairs = [(a, b) for i, a in enumerate(numbers) for b in numbers[i + 1 :]]
    parts = []

    def add(ord, section, metric, value, source, where="true"):
        parts.append(f"""SELECT {ord}::BIGINT AS ord, {section} AS section, {metric} AS metric, CAST({value} AS VARCHAR) AS value FROM {source} WHERE {where}""")

    overview = {"dataset_name": "'orders'", "row_count": "n", "column_count": "6", "missing_values_count": "0", "duplicate_rows_count": "0", "logical_bytes": "b"}
    for metric, value in overview.items():
        add(1, "'Overview'", f"'{metric}'", value, "t")
    for ord, metric, value in ((2, "total_missing_cells", "0"), (2, "duplicate_rows", "0"), (3, "constant_columns", "'none'")):
        add(ord, "'Data Quality'", f"'{metric}'", value, "t")
    add(4, "'Data Quality'", "'columns_with_outliers'", "(SELECT count(*) FROM x)", "t")
    add(5, """'EDA: ' || "column" """, "'count'", "count", "e")
    for m in D.NUMERIC_METRICS[1:]:
        add(5, """'EDA: ' || "column" """, f"'{m}'", _plain(f'"{m}"'), "e")
    for m, v in (("count", "total"), ("unique_count", "unique_count"), ("mode", "value"), ("mode_count", "count")):
        add(5, """'EDA: ' || "column" """, f"'{m}'", v, "c")
    for m in ("count", "min", "max", "range_days"):
        add(5, """'EDA: ' || "column" """, f"'{m}'", f'"{m}"', "d")
    add(6, "'Correlation: ' || a", "b", _plain("r"), "p")
    add(7, "'Chart: Totals'", "o_orderstatus", _plain("round(v, 4)"), "(SELECT o_orderstatus, sum(o_totalprice) AS v FROM orders GROUP BY 1)")
    add(7, "'Chart: Prices'", "label", "count || '.0'", f"({HISTOGRAM.format(v='o_totalprice', t='orders')})")
    for kind, end in (("top_performer", "Highest"), ("bottom_performer", "Lowest")):
        add(9, "'Insights'", f"'{kind}'", f"'{end} total o_orderkey by o_orderstatus'", "t", "(SELECT count(DISTINCT o_orderstatus) FROM orders) >= 2")
    moved = "'o_orderkey: later half of the dates against the earlier'"
    add(9, "'Insights'", "'trend'", moved, "h")
    add(9, "'Insights'", "'correlation'", "a || ' / ' || b", "(SELECT * FROM p WHERE abs(r) >= 0.3 ORDER BY abs(r) DESC, o LIMIT 1)")
    add(9, "'Insights'", "'anomaly'", "'values far from the others in ' || c", "far")
    advice = f"""(SELECT 4 AS o, c || ': ' || n || ' values lie far outside; look at their rows before relying on it.' AS line FROM far
      UNION ALL SELECT 6, {moved} || ': ' || CASE WHEN change > 0 THEN 'up' ELSE 'down' END || ' by ' || change || '%, ' ||
        CASE WHEN change > 0 THEN 'worth building on' ELSE 'worth an explanation' END || '.' FROM h
      UNION ALL SELECT 7, 'Nothing in this table asks for attention.' FROM t WHERE NOT EXISTS (SELECT * FROM far) AND NOT EXISTS (SELECT * FROM h))"""
    add(10, "'Recommendations'", "'recommendation_' || row_number() OVER (ORDER BY o)", "line", advice)
    far = " UNION ALL ".join(f"""SELECT {i} AS o, "column" AS c, count AS n FROM ({outlier_sql(c, "orders")})""" for i, c in enumerate(numbers))
    return f"""WITH t AS (SELECT count(*) AS n, CAST({ORDER_BYTES} AS BIGINT) AS b FROM orders), x AS ({far}), far AS (SELECT * FROM x ORDER BY n DESC, o LIMIT 1),
    e AS ({" UNION ALL ".join(numeric_sql(c, "orders") for c in numbers)}), c AS ({top_sql(texts, "orders", 1)}), d AS ({dates_sql("o_orderdate", "orders")}),
    p AS ({" UNION ALL ".join(f"SELECT {i} AS o, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM orders" for i, (a, b) in enumerate(pairs))}),
    k AS (SELECT CAST(o_orderkey AS DOUBLE) AS v, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders),
    h AS (SELECT * FROM (SELECT round((b - a) / abs(a) * 100, 2) AS change FROM (SELECT sum(v) FILTER (rn <= n // 2) AS a, sum(v) FILTER (rn > n // 2) AS b FROM k)
      WHERE a <> 0))
    {" UNION ALL ".join(parts)}"""


@query("report_rows", report_sql())
def report_rows(spark, d):
    o = t(spark, d, "orders")
    charts = [
        {"title": "Totals", "chart_type": "bar", "x": "o_orderstatus", "y": "o_totalprice"},
        {"title": "Prices", "chart_type": "histogram", "x": "o_totalprice"},
        {"title": "Broken", "chart_type": "bar", "x": "no such column"},
    ]
    return I.report(o, "orders", I.facts(o, "o_orderkey"), saved_charts=charts)
