"""Resampling, frequency, trend, season, forecasts and the half-to-half change."""

from checks.questions import _TREND
from checks.registry import query, table as t
from ledgerline.operators import series as S
from pyspark.sql import functions as F

LABELS = {
    **{k: v for k, v in zip(("D", "W", "ME", "YE"), (_TREND["D"], _TREND["W"], _TREND["M"], _TREND["Y"]))},
    "QE": (
        "orders", "o_orderdate", "o_totalprice", "last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE))",
        "SELECT last_day(CAST(m + INTERVAL 2 MONTH AS DATE)) AS p FROM (SELECT unnest(generate_series(date_trunc('quarter', lo), hi, INTERVAL 3 MONTH)) AS m FROM b)",
    ),
}


def series_sql(freq, agg="sum({0})", where="true"):
    """Common table expressions ending in s(p, v): one row per period, empty periods 0."""
    source, date, value, label, spine = LABELS[freq]
    return f"""g AS (SELECT {label} AS p, {agg.format(value)} AS v FROM {source} WHERE {where} GROUP BY 1),
    b AS (SELECT min(p) AS lo, max(p) AS hi FROM g), e AS ({spine}),
    s AS (SELECT e.p, coalesce(g.v, 0) AS v, row_number() OVER (ORDER BY e.p) - 1 AS i, count(*) OVER () AS n FROM e LEFT JOIN g ON e.p = g.p)"""


def prepared(spark, d, freq):
    source, date, value, *_ = LABELS[freq]
    return S.prepare(t(spark, d, source), date, value, freq)


for _f in LABELS:
    query(
        f"series_{_f.lower()}",
        f"WITH {series_sql(_f)} SELECT p AS period, round(v, 4) AS value FROM s",
    )(lambda spark, d, f=_f: prepared(spark, d, f).withColumn("value", F.round("value", 4)))


@query(
    "series_by_key_with_gaps",
    """WITH r AS (SELECT event_type AS k, last_day(CAST(ts AS DATE)) AS x, CAST(ts AS DATE) AS p, CASE WHEN value > 90 OR event_type = 'view' THEN value END AS v FROM events),
    g AS (SELECT k, p, sum(v) AS v FROM r GROUP BY 1, 2), b AS (SELECT k, min(p) AS lo, max(p) AS hi FROM g GROUP BY 1),
    s AS (SELECT k, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS p FROM b)
    SELECT s.k AS event_type, s.p AS period, round(coalesce(g.v, 0), 4) AS value FROM s LEFT JOIN g ON s.k = g.k AND s.p = g.p""",
)
def series_by_key(spark, d):
    # Events of other kinds count with their larger values only, so their days have gaps.
    e = t(spark, d, "events").withColumn("value", F.expr("CASE WHEN value > 90 OR event_type = 'view' THEN value END"))
    return S.resample(e, "ts", "value", "D", keys=["event_type"], zero_gaps=True).withColumn("value", F.round("value", 4))


def frequency_sql(source, stamp):
    return f"""SELECT median_gap_days, CASE WHEN coalesce(median_gap_days, 0) <= 1 THEN 'D' WHEN median_gap_days <= 8 THEN 'W'
      WHEN median_gap_days <= 45 THEN 'ME' WHEN median_gap_days <= 135 THEN 'QE' ELSE 'YE' END AS freq,
      CASE WHEN coalesce(median_gap_days, 0) <= 1 THEN 'Daily' WHEN median_gap_days <= 8 THEN 'Weekly'
      WHEN median_gap_days <= 45 THEN 'Monthly' WHEN median_gap_days <= 135 THEN 'Quarterly' ELSE 'Yearly' END AS label
    FROM (SELECT quantile_cont(gap, 0.5) AS median_gap_days FROM (
      SELECT CAST((epoch_us(d) - epoch_us(lag(d) OVER (ORDER BY d))) // 86400000000 AS DOUBLE) AS gap FROM (SELECT DISTINCT {stamp} AS d FROM {source})))"""


@query("series_frequency_stamps", frequency_sql("events", "ts"))
def frequency_stamps(spark, d):
    return S.frequency(t(spark, d, "events"), "ts")


@query("series_frequency_weeks", frequency_sql("orders", "date_trunc('week', o_orderdate)::TIMESTAMP"))
def frequency_weeks(spark, d):
    o = t(spark, d, "orders").select(F.date_trunc("week", F.col("o_orderdate").cast("timestamp")).alias("week"))
    return S.frequency(o, "week")


@query("series_frequency_quarters", frequency_sql("lineitem", "date_trunc('quarter', l_shipdate)::TIMESTAMP"))
def frequency_quarters(spark, d):
    li = t(spark, d, "lineitem").select(F.date_trunc("quarter", F.col("l_shipdate").cast("timestamp")).alias("q"))
    return S.frequency(li, "q")


def direction_sql(freq):
    return f"""WITH {series_sql(freq)}, f AS (SELECT count(*) AS n, regr_slope(v, i) AS k, avg(abs(v)) AS size FROM s)
    SELECT n, round(k, 6) AS slope, CASE WHEN n < 2 THEN 'insufficient_data' WHEN abs(k / CASE WHEN size = 0 THEN 1 ELSE size END) < 0.01 THEN 'stable'
      WHEN k > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM f"""


for _f in ("D", "ME"):
    query(f"series_trend_direction_{_f.lower()}", direction_sql(_f))(lambda spark, d, f=_f: S.trend_direction(prepared(spark, d, f)))


def season_parts(freq, period):
    """Common table expressions up to o(i, p, v, ph, off), the distance from the trend, and c(ph, sea), the season."""
    k = period // 2
    if period % 2:
        trend = f"avg(v) OVER (ORDER BY i ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
    else:
        trend = f"""(sum(v) OVER (ORDER BY i ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)
          - (lag(v, {k}) OVER (ORDER BY i) + lead(v, {k}) OVER (ORDER BY i)) / 2) / {period}"""
    return f"""WITH {series_sql(freq)},
    a AS (SELECT i, p, v, n, CASE WHEN i >= {k} AND i <= n - 1 - {k} THEN {trend} END AS t FROM s),
    h AS (SELECT regr_slope(t, i) AS hs, regr_intercept(t, i) AS hi FROM a WHERE t IS NOT NULL AND i < least({k} + {period}, n - 1 - {k})),
    z AS (SELECT regr_slope(t, i) AS ts, regr_intercept(t, i) AS ti FROM a WHERE t IS NOT NULL AND i < n - 1 - {k} AND i >= greatest({k}, n - 1 - {k} - {period})),
    o AS (SELECT i, p, v, i % {period} AS ph, v - CASE WHEN t IS NOT NULL THEN t WHEN i < {k} THEN hs * i + hi ELSE ts * i + ti END AS off FROM a, h, z),
    m AS (SELECT ph, avg(off) AS m FROM o GROUP BY 1), c AS (SELECT ph, m - (SELECT avg(m) FROM m) AS sea FROM m)"""


def season_sql(freq, period):
    return f"""{season_parts(freq, period)}, w AS (SELECT var_pop(sea) AS vs, var_pop(off - sea) AS vr, count(*) AS n FROM o JOIN c USING (ph))
    SELECT n, {period}::BIGINT AS season_length, CASE WHEN n >= greatest(8, 2 * {period}) THEN round(vs / (vs + vr), 4) END AS strength,
    n >= greatest(8, 2 * {period}) AND vs / (vs + vr) >= 0.3 AS detected FROM w"""


for _f, _p in (("D", 7), ("ME", 12), ("QE", 4)):
    query(f"series_seasonality_{_f.lower()}", season_sql(_f, _p))(lambda spark, d, f=_f: S.seasonality(prepared(spark, d, f), f))


@query(
    "series_decompose_daily",
    f"""{season_parts("D", 7)} SELECT i, p AS period, round(v, 4) AS value, round(v - off, 4) AS trend, round(sea, 4) AS seasonal,
    round(off - sea, 4) AS resid FROM o JOIN c USING (ph)""",
)
def decompose(spark, d):
    parts = S.decompose(prepared(spark, d, "D"), 7)
    return parts.select("i", "period", *[F.round(c, 4).alias(c) for c in ("value", "trend", "seasonal", "resid")])


def line_sql(freq, ahead, horizon):
    return f"""WITH {series_sql(freq)}, f AS (SELECT count(*) AS n, max(p) AS last, regr_slope(v, i) AS k, regr_intercept(v, i) AS c FROM s),
    r AS (SELECT stddev_pop(v - (k * i + c)) AS sd FROM s, f), h AS (SELECT unnest(range(1, {horizon} + 1)) AS step),
    x AS (SELECT step, {ahead} AS period, k * (n + step - 1) + c AS fit, 1.96 * sd * sqrt(step) AS m FROM f, r, h)
    SELECT step, CAST(period AS DATE) AS period, round(fit, 4) AS value, round(fit - m, 4) AS lower, round(fit + m, 4) AS upper FROM x"""


for _f, _ahead in {
    "D": "last + CAST(step AS INTEGER)",
    "W": "last + CAST(step * 7 AS INTEGER)",
    "ME": "last_day(last + to_months(CAST(step AS INTEGER)))",
    "QE": "last_day(last + to_months(CAST(3 * step AS INTEGER)))",
    "YE": "last_day(last + to_months(CAST(12 * step AS INTEGER)))",
}.items():
    query(f"forecast_line_{_f.lower()}", line_sql(_f, _ahead, 14))(
        lambda spark, d, f=_f: S.with_bands(S.line_forecast(prepared(spark, d, f), f, 14))
    )


@query(
    "forecast_methods_by_key",
    f"""WITH g AS (SELECT event_type AS k, CAST(ts AS DATE) AS p, sum(value) AS v FROM events GROUP BY 1, 2), b AS (SELECT k, min(p) AS lo, max(p) AS hi FROM g GROUP BY 1),
    e AS (SELECT k, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS p FROM b),
    s AS (SELECT e.k, coalesce(g.v, 0) AS v, row_number() OVER (PARTITION BY e.k ORDER BY e.p) - 1 AS i, count(*) OVER (PARTITION BY e.k) AS n
      FROM e LEFT JOIN g ON e.k = g.k AND e.p = g.p),
    a AS (SELECT k, i, v, n, CASE WHEN i >= 3 AND i <= n - 4 THEN avg(v) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS t FROM s),
    h AS (SELECT k, regr_slope(t, i) AS hs, regr_intercept(t, i) AS hi FROM a WHERE t IS NOT NULL AND i < least(10, n - 4) GROUP BY k),
    z AS (SELECT k, regr_slope(t, i) AS ts, regr_intercept(t, i) AS ti FROM a WHERE t IS NOT NULL AND i < n - 4 AND i >= greatest(3, n - 11) GROUP BY k),
    o AS (SELECT k, i % 7 AS ph, v - CASE WHEN t IS NOT NULL THEN t WHEN i < 3 THEN hs * i + hi ELSE ts * i + ti END AS off FROM a LEFT JOIN h USING (k) LEFT JOIN z USING (k)),
    m AS (SELECT k, ph, avg(off) AS m FROM o GROUP BY 1, 2), c AS (SELECT k, ph, m - avg(m) OVER (PARTITION BY k) AS sea FROM m),
    w AS (SELECT k, var_pop(sea) AS vs, var_pop(off - sea) AS vr, count(*) AS n FROM o JOIN c USING (k, ph) GROUP BY k),
    j AS (SELECT *, n >= 14 AND vs / (vs + vr) >= 0.3 AS detected FROM w WHERE n >= {S.MIN_POINTS})
    SELECT k AS event_type, n, 7::BIGINT AS season_length, CASE WHEN n >= 14 THEN round(vs / (vs + vr), 4) END AS strength, detected,
    CASE WHEN detected THEN 'holt_winters_seasonal' WHEN n >= {S.MIN_POINTS_HOLT} THEN 'holt_linear_trend' ELSE 'linear_regression_fallback' END AS method FROM j""",
)
def methods(spark, d):
    series = S.prepare(t(spark, d, "events"), "ts", "value", "D", keys=["event_type"])
    return S.method_per_series(series, "D", ["event_type"])


@query("forecast_smoothing_many_series")
def smoothing(spark, d):
    return S.forecast(t(spark, d, "events"), "ts", "value", 7, "D", keys=["event_type"])


@query("forecast_monthly")
def monthly(spark, d):
    return S.forecast(t(spark, d, "orders"), "o_orderdate", "o_totalprice", 12, "ME")


@query(
    "series_half_change",
    """WITH r AS (SELECT value AS v, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events),
    h AS (SELECT sum(v) FILTER (rn <= n // 2) AS a, sum(v) FILTER (rn > n // 2) AS b FROM r)
    SELECT round(a, 4) AS first_half_total, round(b, 4) AS second_half_total, round((b - a) / abs(a) * 100, 2) AS percent_change FROM h""",
)
def half_change(spark, d):
    return S.half_change(t(spark, d, "events"), "ts", "value", "event_id")


@query(
    "series_half_change_tied_dates",
    """WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY date_trunc('year', o_orderdate), o_orderkey) AS rn, count(*) OVER () AS n FROM orders),
    h AS (SELECT sum(v) FILTER (rn <= n // 2) AS a, sum(v) FILTER (rn > n // 2) AS b FROM r)
    SELECT round(a, 4) AS first_half_total, round(b, 4) AS second_half_total, round((b - a) / abs(a) * 100, 2) AS percent_change FROM h""",
)
def half_change_tied(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice", F.date_trunc("year", F.col("o_orderdate").cast("timestamp")).alias("y"))
    return S.half_change(o, "y", "o_totalprice", "o_orderkey")


_SHORT = "CASE WHEN event_type = 'error' AND ts > (SELECT min(ts) + INTERVAL 1 DAY FROM events) THEN NULL ELSE value END"


@query(
    "forecast_summary_by_key",
    f"""WITH r AS (SELECT event_type AS k, CAST(ts AS DATE) AS p, {_SHORT} AS v FROM events),
    g AS (SELECT k, p, sum(v) AS v FROM r WHERE v IS NOT NULL GROUP BY 1, 2), b AS (SELECT k, min(p) AS lo, max(p) AS hi FROM g GROUP BY 1),
    s AS (SELECT b.k, CAST(d AS DATE) AS p, CAST(d AS DATE) - lo AS i FROM b, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS x(d)),
    y AS (SELECT s.k, s.i, coalesce(g.v, 0) AS v FROM s LEFT JOIN g ON g.k = s.k AND g.p = s.p),
    f AS (SELECT k, count(*) AS n, regr_slope(v, i) AS slope, avg(v) AS mean FROM y GROUP BY k),
    every AS (SELECT DISTINCT k FROM r WHERE k IS NOT NULL)
    SELECT k AS event_type, coalesce(n, 0) AS n, CASE WHEN n >= 4 THEN round(slope, 6) END AS slope,
    CASE WHEN n >= 4 THEN NULL ELSE coalesce(n, 0) || ' periods, a forecast needs 4' END AS problem, 'Daily' AS freq_label FROM every LEFT JOIN f USING (k)""",
)
def summary(spark, d):
    first = t(spark, d, "events").agg(F.min("ts") + F.expr("INTERVAL 1 DAY")).scalar()
    short = (F.col("event_type") == "error") & (F.col("ts") > first)
    e = t(spark, d, "events").withColumn("value", F.when(~short, F.col("value")))
    return S.forecast_summary(e, "ts", "value", "D", keys=["event_type"]).select("event_type", "n", "slope", "problem", "freq_label")
