"""Profile, quality, cleaning and charts on small frames."""

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerline.errors import ChartError, CleaningError
from ledgerline.operators import charts as G, clean as C, describe as D, quality as Q, roles as R
from tests.conftest import FOLDER, plan_text


@pytest.fixture
def small(spark):
    # Loaves sold: kind, number, shop, day.
    rows = [
        ("rye", 34, "quay", dt.datetime(2021, 6, 2)), ("oat", 3, "hill", dt.datetime(2021, 6, 4)), ("rye", 8, "quay", dt.datetime(2021, 6, 4)),
        ("rye", 51, "hill", dt.datetime(2021, 6, 9)), ("oat", 17, "quay", dt.datetime(2021, 6, 13)), ("spelt", 6, "quay", dt.datetime(2021, 6, 13)),
        ("rye", 29, "mill", dt.datetime(2021, 6, 11)),
    ]
    return spark.createDataFrame(rows, "loaf string, sold long, shop string, day timestamp_ntz")


@pytest.fixture
def messy(spark):
    # Weighed catches: net, kilograms (one written wrong), skipper (often not noted), harbour. One entry was made twice.
    rows = [
        ("drift", 42.5, "Ode", "Vik"), ("trap", 40.0, None, "Vik"), ("drift", 45.0, "Per", "Vik"), ("trap", 4400.0, None, "Vik"),
        ("line", 41.5, "Ode", "Vik"), ("trap", 40.0, None, "Vik"), ("line", 43.0, None, "Vik"), ("drift", 44.5, None, "Vik"),
    ]
    return spark.createDataFrame(rows, "net string, kilos double, skipper string, harbour string")


def test_numeric_summary(small):
    row = D.numeric_summary(small).first()
    assert (row["column"], row["count"], row["min"], row["max"], row["mean"]) == ("sold", 7, 3.0, 51.0, 21.1429)


def test_categorical_and_datetime_summaries(small):
    top = {(r["column"], r["rank"]): r for r in D.categorical_summary(small).collect()}
    assert top["loaf", 1]["value"] == "rye" and top["loaf", 1]["count"] == 4 and top["loaf", 1]["unique_count"] == 3
    dates = D.datetime_summary(small).first()
    assert dates["range_days"] == 11 and dates["min"] == "2021-06-02T00:00:00"


def test_all_missing_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    got = {r["column"]: r for r in D.numeric_summary(df).collect()}
    assert got["b"]["count"] == 0 and got["b"]["mean"] is None and got["b"]["mode"] is None


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "a double")
    assert Q.missing(df).first()["count"] == 1
    assert D.numeric_summary(df).first()["max"] == 3.0


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (9.0, "x")], "`a.b c` double, `d``e` string")
    assert D.numeric_summary(df).first()["column"] == "a.b c"
    assert {r["column"] for r in D.categorical_summary(df).collect()} == {"d`e"}
    assert C.fill_missing(df, "a.b c", "mean").count() == 3
    assert Q.scan(df).where("check = 'shape' and metric = 'row_count'").first()["value"] == 3.0


def test_correlation_of_constant_is_zero_in_the_matrix(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0)], "x double, c double")
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in D.correlation_matrix(df).collect()}
    assert got["x", "c"] == 0.0 and got["c", "c"] == 0.0 and got["x", "x"] == 1.0


def test_correlations_are_pairwise_complete(spark):
    """Against pandas, with gaps, a far level, a constant column and one without values, over several tasks."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (500, 4)) @ rng.normal(0, 1, (4, 4))
    frame = pd.DataFrame(x + 1e6, columns=list("abcd")).mask(rng.random((500, 4)) < 0.2)
    frame["e"], frame["f"] = 7.0, np.nan
    want = frame.corr().fillna(0.0)
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"{c} double" for c in frame)).repartition(4)
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in D.correlation_matrix(df, list(frame)).collect()}
    assert len(got) == 36 and all(abs(got[a, b] - want.loc[a, b]) < 1e-3 for a in frame for b in frame if a != b)
    assert [got[c, c] for c in "abcdef"] == [1.0] * 4 + [0.0] * 2
    assert len(D.pair_correlations(df.limit(0), list(frame)).collect()) == 15


def test_one_scan_for_a_hundred_columns(spark):
    wide = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select(*[F.col("l_quantity").alias(f"c{i}") for i in range(100)])
    assert plan_text(D.pair_correlations(wide, wide.columns)).count("Batched: true") == 1


def test_roles(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-05", "x", True, [1]), (2, "01/31/2024", "y", False, [2]), (3, "Mar 3, 2024", "z", True, None)],
        "n int, d string, t string, b boolean, a array<int>",
    )
    assert R.role_lists(df) == {"numeric": ["n"], "categorical": ["t", "b"], "datetime": ["d"], "unsupported": ["a"]}
    assert {r["column"]: r["role"] for r in R.classify(df).collect()}["d"] == "datetime"


def test_date_threshold(spark):
    nearly = spark.createDataFrame([("2024-01-01",)] * 17 + [("soon",)] * 3, "d string")
    assert R.role_lists(nearly)["datetime"] == ["d"]
    fewer = spark.createDataFrame([("2024-01-01",)] * 16 + [("soon",)] * 4, "d string")
    assert R.role_lists(fewer)["categorical"] == ["d"]


def test_quality_scan(spark, messy):
    got = {(r["check"], r["column"], r["metric"]): r["value"] for r in Q.scan(messy).collect()}
    assert got["duplicates", None, "count"] == 1
    assert (got["missing", "skipper", "count"], got["missing", "skipper", "percentage"]) == (5, 62.5)
    assert got["constant", "harbour", "constant"] == 1 and ("constant", "net", "constant") not in got
    assert got["outliers", "kilos", "count"] == 1
    assert ("missing", "net", "count") not in got
    assert [got["shape", None, m] for m in ("row_count", "column_count", "total_missing_cells")] == [8, 4, 5]


def test_quality_scan_reads_few_times(spark):
    df = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    assert plan_text(Q.scan(df.select("l_returnflag", "l_linestatus"))).count("Batched: true") <= 5


def test_rows_taken_out_are_counted_while_they_are_written(spark, messy):
    """No job but those that write and those that find limits."""
    group = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "cleaning")
    _, log = C.apply_actions(messy, [{"type": "remove_duplicates"}, {"type": "drop_missing", "column": "skipper"}, {"type": "drop_missing"}])
    jobs = len(group.getJobIdsForGroup("counted"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r["description"].split(": ")[1].split()[0] for r in log.orderBy("step").collect()] == ["1", "4", "0"]
    assert jobs <= 4


def test_duplicate_positions_with_a_dominant_row(spark):
    rows = [(i, "same", None) for i in range(60)] + [(i, f"v{i}", float(i)) for i in range(60, 100)]
    df = spark.createDataFrame(rows, "id long, s string, x double")
    assert Q.duplicates(df.drop("id")).first()["count"] == 59
    assert sorted(r["row_id"] for r in Q.duplicate_positions(df, "id").collect()) == list(range(1, 21))


def test_duplicate_positions_by_brute_force(spark):
    """Several sets of copies, gaps that equal each other, ids that repeat and ids that are missing."""
    pick = random.Random(5)
    rows = [(pick.choice([None, *range(90)]), pick.choice([None, "a", "b"]), pick.choice([None, 1.5, 2.5])) for _ in range(400)]
    rows += [(i, "a", 1.5) for i in range(200, 3000)]
    df = spark.createDataFrame(rows, "id long, s string, x double").repartition(7)
    firsts = {}
    for i, *row in rows:
        if i is not None:
            firsts[tuple(row)] = min(i, firsts.get(tuple(row), i))
    wanted = sorted(i for i, *row in rows if i is not None and i > firsts[tuple(row)])
    for k in (1, 20, 150):
        assert [r["row_id"] for r in Q.duplicate_positions(df, "id", k).collect()] == wanted[:k]
    assert Q.duplicate_positions(df.limit(0), "id").collect() == []


def test_copies_are_limited_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id", "id % 2 AS v")
    assert "WindowGroupLimit" in plan_text(Q.duplicate_positions(df, "id"))


def test_few_values_are_counted_exactly(spark):
    df = spark.range(3000).selectExpr(
        "CAST(id % 7 AS STRING) AS seven", "CAST(id AS STRING) AS many", "CAST(NULL AS STRING) AS none", "id % 2 = 0 AS flag",
        "CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id % 31 AS STRING) END AS gappy",
    )
    found = R.few_values(df, df.columns, 30)
    assert (found["seven"], found["none"], found["flag"]) == (7, 0, 2) and found["many"] > 30 and found["gappy"] == 31
    assert R.few_values(df, [], 30) == {} and R.few_values(df.limit(0), ["seven"], 30) == {"seven": 0}
    roles = [r["role"] for r in R.feature_roles(df, df.columns).orderBy("ordinal").collect()]
    assert roles == ["categorical", "dropped", "categorical", "categorical", "dropped"]


def test_mostly_numeric_text(spark):
    df = spark.createDataFrame([("1",), ("2",), ("3.5",), ("4",), ("N/A",)], "amount string")
    assert Q.mostly_numeric_text(df).first()["looks_numeric_percentage"] == 80.0


def test_high_cardinality_needs_twenty_rows(spark):
    few = spark.createDataFrame([(f"v{i}",) for i in range(19)], "s string")
    many = spark.createDataFrame([(f"v{i}",) for i in range(20)], "s string")
    assert Q.high_cardinality(few).count() == 0
    assert Q.high_cardinality(many).first()["ratio"] == 1.0


def test_mean_fill(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,)], "x double")
    assert sorted(r["x"] for r in C.fill_missing(df, "x", "mean").collect())[2] == pytest.approx(7 / 3)


def test_clip_and_remove(spark):
    df = spark.createDataFrame([(10,), (12,), (11,), (13,), (1000,), (None,)], "x long")
    clipped = C.handle_outliers(df, "x", "clip")
    assert clipped.agg(F.max("x")).first()[0] < 1000 and clipped.where("x is null").count() == 1
    assert C.handle_outliers(df, "x", "remove").count() == 5
    assert df.agg(F.max("x")).first()[0] == 1000


def test_convert(spark):
    df = spark.createDataFrame([("1",), ("x",), ("3.0",), (None,)], "v string")
    assert [r["v"] for r in C.convert_type(df, "v", "int").collect()] == [1, None, 3, None]
    bad = spark.createDataFrame([("1.5",)], "v string")
    with pytest.raises(PySparkException, match="fractions"):
        C.convert_type(bad, "v", "int").collect()
    assert C.convert_type(bad, "v", "float").first()["v"] == 1.5


def test_action_list(spark, messy):
    actions = C.plan_actions(True, ["harbour"], {"skipper": "mode"}, {"net": "category"}, {"kilos": "clip"})
    assert [a["type"] for a in actions] == ["remove_duplicates", "drop_column", "fill_missing", "convert_type", "handle_outliers"]
    out, log = C.apply_actions(messy, actions)
    lines = [r["description"] for r in log.orderBy("step").collect()]
    assert lines[0] == "duplicates: 1 repeated rows taken out"
    assert lines[1] == "column harbour: left out"
    assert lines[2] == "column skipper: 4 gaps closed by mode"
    assert lines[4].startswith("column kilos: held within ")
    assert out.count() == 7 and "harbour" not in out.columns and out.where("skipper = 'Ode'").count() == 6
    assert messy.count() == 8 and "harbour" in messy.columns


def test_statistics_follow_the_current_table(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "c"), (100.0, None)], "x double, s string")
    actions = [{"type": "drop_missing", "column": "s"}, {"type": "fill_missing", "column": "x", "strategy": "mean"}]
    out, log = C.apply_actions(df, actions)
    assert sorted(r["x"] for r in out.collect()) == [1.0, 2.0, 3.0]
    assert log.orderBy("step").first()["description"] == "column s: 1 rows with a gap taken out"


@pytest.mark.parametrize(
    "action",
    [
        {"type": "eval"}, {"type": "drop_column", "column": "nope"}, {"type": "fill_missing", "column": "kilos", "strategy": "guess"},
        {"type": "handle_outliers", "column": "net"}, {"type": "handle_outliers", "column": "kilos", "method": "hide"},
        {"type": "convert_type", "column": "kilos", "target_type": "blob"}, {"type": "fill_missing", "column": "net", "strategy": "mean"},
    ],
)
def test_bad_actions(messy, action):
    with pytest.raises(CleaningError):
        C.apply_actions(messy, [action])


def test_saved_copy_never_overwrites(spark, small, tmp_path):
    path = str(tmp_path / "copy")
    C.save_copy(small, path)
    assert spark.read.parquet(path).count() == 7
    with pytest.raises(PySparkException):
        C.save_copy(small, path)


def test_histogram_counts_every_row(spark):
    df = spark.range(100).withColumnRenamed("id", "x")
    bins = G.histogram(df, "x").orderBy("bin").collect()
    assert len(bins) == 20 and sum(b["count"] for b in bins) == 100 and bins[19]["count"] == 5
    assert bins[0]["label"] == "0.00–4.95"


def test_chart_kinds(small):
    bar = G.build(small, {"chart_type": "bar", "x": "loaf", "y": "sold"}).collect()
    assert [(r["x"], r["value"]) for r in bar] == [("rye", 122.0), ("oat", 20.0), ("spelt", 6.0)]
    quay = [{"column": "shop", "operator": "equals", "value": "quay"}]
    assert G.build(small, {"chart_type": "pie", "x": "loaf", "filters": quay}).collect()[0]["value"] == 2.0
    pairs = {(r["x"], r["series"]): r["value"] for r in G.build(small, {"chart_type": "bar", "x": "loaf", "y": "sold", "group_by": "shop"}).collect()}
    assert pairs["spelt", "hill"] == 0.0 and pairs["rye", "quay"] == 42.0
    assert G.build(small, {"chart_type": "scatter", "x": "sold", "y": "sold"}).count() == 7


@pytest.mark.parametrize(
    "spec",
    [
        {"chart_type": "radar", "x": "loaf"}, {"chart_type": "bar", "x": "nope"}, {"chart_type": "bar", "x": "loaf", "y": "sold", "aggregation": "product"},
        {"chart_type": "scatter", "x": "sold"}, {"chart_type": "bar", "x": "loaf", "group_by": "shop"},
        {"chart_type": "bar", "x": "loaf", "filters": [{"column": "nope", "operator": "equals", "value": 1}]},
    ],
)
def test_bad_chart_specs(small, spec):
    with pytest.raises(ChartError):
        G.build(small, spec)


def test_suggestions(small):
    got = [(r["chart_type"], r["x"], r["y"]) for r in G.suggest(small).orderBy("rank").collect()]
    assert got == [
        ("histogram", "sold", None), ("bar", "loaf", None), ("bar", "shop", None), ("line", "day", "sold"),
    ]


def test_suggestions_stop_at_eight(spark):
    df = spark.createDataFrame([tuple("x" * 9) + (1.0, 2.0)], ", ".join(f"c{i} string" for i in range(9)) + ", n1 double, n2 double")
    got = G.suggest(df).orderBy("rank").collect()
    assert len(got) == 8 and [r["chart_type"] for r in got] == ["histogram"] * 2 + ["bar"] * 6


def test_compare_profiles(messy):
    got = {r["metric"]: r for r in Q.compare_profiles(messy, C.remove_duplicates(messy)).collect()}
    assert got["row_count"]["change"] == -1 and got["duplicate_rows_count"]["change"] == -1 and got["column_count"]["change"] == 0


def test_a_bad_later_action_starts_no_job(spark, messy):
    tracker = spark.sparkContext.statusTracker()
    bad = [
        [{"type": "remove_duplicates"}, {"type": "fill_missing", "column": "nope", "strategy": "zero"}],
        [{"type": "drop_column", "column": "skipper"}, {"type": "drop_missing", "column": "skipper"}],
        [{"type": "convert_type", "column": "kilos", "target_type": "string"}, {"type": "handle_outliers", "column": "kilos"}],
        [{"type": "remove_duplicates"}, {"type": "fill_missing", "column": "kilos", "strategy": "constant", "value": "many"}],
    ]
    for i, actions in enumerate(bad):
        spark.sparkContext.setJobGroup(f"bad{i}", "checks")
        with pytest.raises(CleaningError):
            C.apply_actions(messy, actions)
        assert not tracker.getJobIdsForGroup(f"bad{i}")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_text_columns_without_values_are_reported(spark):
    df = spark.createDataFrame([("a", None), ("b", None)], "s string, t string")
    got = {r["column"]: (r["total"], r["unique_count"]) for r in D.categorical_summary(df).collect()}
    assert got["t"] == (0, 0) and got["s"] == (2, 2)
    assert (D.describe_all(df).where("column = 't' and metric = 'count'").first() or {"number": 0})["number"] == 0
