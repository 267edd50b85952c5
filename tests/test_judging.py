"""Anomalies, metrics, facts, recommendations and reports."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.errors import AnomalyError
from ledgerline.operators import anomaly as N, insight as I, metrics as M, workspace as K
from ledgerline.operators.forest import score_forest
from ledgerline.sources.sinks import report_to_csv, report_to_json


@pytest.fixture
def amounts(spark):
    rows = [(i, v, "east" if i % 2 else "west") for i, v in enumerate([10, 12, 11, 13, 12, 11, 10, 12, 11, 1000])]
    return spark.createDataFrame(rows, "id long, amount long, region string")


def test_iqr_finds_the_last_row(amounts):
    rows = N.detect(amounts, "iqr", ["amount"], "id").collect()
    assert [r["id"] for r in rows] == [9] and rows[0]["region"] == "east"


def test_uniform_data_has_no_anomalies(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(50)], "id long, x double")
    assert N.detect(df, "iqr", ["x"], "id").count() == 0
    constant = spark.createDataFrame([(i, 1.0) for i in range(10)], "id long, x double")
    assert N.detect(constant, "iqr", ["x"], "id").count() == 0
    assert N.detect(constant, "zscore", ["x"], "id").count() == 0


def test_stricter_threshold_never_flags_more(amounts):
    counts = [N.summary(N.score_zscore(amounts, ["amount"], z)).first()["anomaly_count"] for z in (1.0, 2.0, 2.8, 5.0)]
    assert counts == sorted(counts, reverse=True) and counts[0] >= 1 and counts[-1] == 0


def test_cap_and_truncation(spark):
    rows = [(i, 10 + i % 10) for i in range(2000)] + [(2000 + i, 5000) for i in range(250)]
    scored = N.score_iqr(spark.createDataFrame(rows, "id long, x long"), ["x"])
    assert N.ranked(scored, "id").count() == 200
    row = N.summary(scored).first()
    assert (row["row_count"], row["anomaly_count"], row["truncated"]) == (2250, 250, True)


def test_incomplete_rows_are_left_out(spark):
    df = spark.createDataFrame([(i, None if i == 3 else float(i)) for i in range(6)], "id long, x double")
    assert N.summary(N.score_iqr(df, ["x"])).first()["row_count"] == 5


@pytest.mark.parametrize(
    "method,columns", [("iqr", []), ("iqr", ["nope"]), ("iqr", ["region"]), ("magic", ["amount"])]
)
def test_bad_requests(amounts, method, columns):
    with pytest.raises(AnomalyError):
        N.detect(amounts, method, columns, "id")


def test_too_few_rows(spark):
    with pytest.raises(AnomalyError):
        N.detect(spark.createDataFrame([(1, 1.0)], "id long, x double"), "iqr", ["x"], "id")


@pytest.fixture
def planted(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(50, 5, (100, 2)))] + [(100, 65.0, 20.0)]
    return spark.createDataFrame(rows, "id long, x double, y double")


def test_forest_finds_the_planted_row(planted):
    rows = N.detect(planted, "isolation_forest", ["x", "y"], "id").collect()
    assert 100 in [r["id"] for r in rows]
    again = N.detect(planted, "isolation_forest", ["x", "y"], "id").collect()
    assert [(r["id"], r["score"]) for r in rows] == [(r["id"], r["score"]) for r in again]


def test_more_contamination_never_flags_fewer(planted):
    counts = [score_forest(planted, ["x", "y"], "id", c).where("is_anomaly").count() for c in (0.0, 0.05, 0.2, 0.9)]
    assert counts == sorted(counts) and counts[1] == 5 and counts[3] == 50


def test_accuracy_example(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (1, 0), (0, 0), (1, 1)], "y int, p int")
    row = M.classification_metrics(df, "y", "p").first()
    assert row["accuracy"] == 0.8 and row["precision"] == 1.0 and row["recall"] == 0.6667 and row["f1"] == 0.8
    cells = {(r["label"], r["prediction"]): r["count"] for r in M.confusion(df, "y", "p").collect()}
    assert cells == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 2}


def test_zero_division_is_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a")], "y string, p string")
    row = M.classification_metrics(df, "y", "p").first()
    assert row["accuracy"] == 0.3333 and row["precision"] == 0.1111


def test_regression_example(spark):
    df = spark.createDataFrame([(3.0, 2.5), (-0.5, 0.0), (2.0, 2.0), (7.0, 8.0)], "y double, p double")
    row = M.regression_metrics(df, "y", "p").first()
    assert row["rmse"] >= row["mae"] and row["mae"] == 0.5 and row["r2"] == 0.9486
    perfect = M.regression_metrics(df.select("y", F.col("y").alias("p")), "y", "p").first()
    assert perfect["r2"] == 1.0 and perfect["mse"] == 0.0


def test_auc_edge_cases(spark):
    df = spark.createDataFrame([(True, 0.9), (True, 0.8), (False, 0.1)], "y boolean, s double")
    assert M.roc_auc(df, F.col("y"), F.col("s")).first()["roc_auc"] == 1.0
    assert M.roc_auc(df, F.lit(True), F.col("s")).first()["roc_auc"] is None
    assert M.roc_auc(df, F.col("y"), F.lit(0.5)).first()["roc_auc"] == 0.5


def test_best_model_ties_and_failures(spark):
    rows = [(0, "a", "classification", "failed", None, None), (1, "b", "classification", "completed", 0.8, None), (2, "c", "classification", "completed", 0.8, None)]
    df = spark.createDataFrame(rows, "ordinal long, algorithm string, task_type string, status string, accuracy double, r2 double")
    assert M.best_model(df).first()["algorithm"] == "b"


def test_recommendation_fallback(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "x long, s string")
    lines = [r["text"] for r in I.recommendations(df).collect()]
    assert lines == ["Nothing in this table asks for attention."]


@pytest.mark.parametrize(
    "task,accuracy,r2,wanted",
    [
        ("classification", 0.55, None, "right in only 55.0% of cases"),
        ("regression", None, 0.3, "accounts for only 30.0% of the differences"),
        ("classification", 0.9, None, "(accuracy: 0.9)"),
        ("regression", None, 0.8, "(R²: 0.8)"),
    ],
)
def test_model_recommendations(spark, task, accuracy, r2, wanted):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x long, s string")
    best = spark.createDataFrame([("Forest", task, accuracy, r2)], "algorithm string, task_type string, accuracy double, r2 double")
    lines = [r["text"] for r in I.recommendations(df, best_model=best).collect()]
    assert len(lines) == 1 and wanted in lines[0]


@pytest.mark.parametrize("change,wanted", [(12.5, "sales: up by 12.5%, worth building on."), (-3.0, "sales: down by -3.0%, worth an explanation.")])
def test_trend_recommendations(spark, change, wanted):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x long, s string")
    facts = spark.createDataFrame([("trend", "sales", change)], "type string, detail string, percent_change double")
    assert any(wanted in r["text"] for r in I.recommendations(df, facts).collect())


def test_facts_on_a_small_table(spark):
    rows = [(i, f"2024-01-{i + 1:02d}", "ab"[i % 2], float(i), 2.0 * i) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, day string, kind string, x double, y double")
    got = {r["type"]: r for r in I.facts(df.select("day", "kind", "x", "y", "id"), "id").collect()}
    assert got["top_performer"]["group"] == "b" and got["bottom_performer"]["group"] == "a"
    assert got["trend"]["percent_change"] == 250.0
    assert (got["correlation"]["column_a"], got["correlation"]["column_b"], got["correlation"]["value"]) == ("x", "y", 1.0)
    assert "anomaly" not in got and "data_quality" not in got


def test_one_group_gives_no_extremes(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, v double")
    assert I.group_extremes(df, "v", "g").count() == 0


def test_report_and_its_files(spark, tmp_path):
    rows = [(("east", "west")[i % 2], float(i), i % 7) for i in range(100)]
    df = spark.createDataFrame(rows, "region string, amount double, units long")
    charts = [{"title": "By region", "chart_type": "bar", "x": "region", "y": "amount"}, {"title": "Broken", "chart_type": "bar", "x": "gone"}]
    best = spark.createDataFrame([("Forest", "regression", None, 0.9)], "algorithm string, task_type string, accuracy double, r2 double")
    report = I.report(df, "sales", best_model=best, saved_charts=charts)
    found = {(r["section"], r["metric"]): r["value"] for r in report.collect()}
    assert found["Overview", "row_count"] == "100" and found["Data Quality", "constant_columns"] == "none"
    assert found["EDA: amount", "mean"] == "49.5" and found["Chart: By region", "west"] == "2500.0"
    assert found["ML", "best_algorithm"] == "Forest" and ("ML", "accuracy") not in found
    assert ("Recommendations", "recommendation_1") in found and not any("Broken" in s for s, _ in found)
    report_to_csv(report, str(tmp_path / "csv"))
    text = next(Path(tmp_path / "csv").glob("*.csv")).read_text()
    assert text.startswith("Section,Metric,Value\n") and "Overview,dataset_name,sales" in text
    report_to_json(report, str(tmp_path / "json"))
    sections = [json.loads(line) for f in Path(tmp_path / "json").glob("*.json") for line in f.read_text().splitlines()]
    assert sections[0] == {"section": "Overview", "metric": "dataset_name", "value": "sales"} and len(sections) == report.count()


def test_pages_are_disjoint(spark):
    df = spark.range(30)
    one = {r["id"] for r in K.page(df, [F.desc("id")], 1, 12).collect()}
    three = {r["id"] for r in K.page(df, [F.desc("id")], 3, 12).collect()}
    assert len(one) == 12 and three == set(range(6))
