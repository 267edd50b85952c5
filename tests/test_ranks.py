"""Exact ranks agree with NumPy on skewed, tied, extreme and missing values, however often the cells are cut again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import ranks
from tests.conftest import plan_text

PICKS = [ranks.quantile("q1", 0.25), ranks.quantile("med", 0.5), ranks.quantile("q99", 0.99), ranks.kth("third", lambda n: F.ceil(n / 3))]


def _frames():
    rng = np.random.default_rng(7)
    hot = np.concatenate([np.full(700, 5.0), rng.normal(0, 1, 900)])
    return {
        "normal": rng.normal(50, 10, 3000),
        "third_equal": hot,
        "outliers": np.concatenate([rng.normal(0, 1, 2000), [1e300, -1e300, 1e-300]]),
        "constant": np.full(50, 3.5),
        "one": np.array([42.0]),
        "two": np.array([1.0, 2.0]),
    }


@pytest.mark.parametrize("few", [False, True])
@pytest.mark.parametrize("limit", [4, 1 << 20])
def test_quantiles_by_key(spark, monkeypatch, limit, few):
    monkeypatch.setattr(ranks, "CELL_VALUES", limit)
    frames = _frames()
    rows = [(k, float(v)) for k, vs in frames.items() for v in vs] + [("normal", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in ranks.pick_values(df, "v", PICKS, ["k"], few_keys=few).collect()}
    assert got["empty"]["n"] == 0 and got["empty"]["med"] is None
    for k, vs in frames.items():
        assert got[k]["n"] == len(vs)
        for p, name in ((0.25, "q1"), (0.5, "med"), (0.99, "q99")):
            assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12), (k, name)
        assert got[k]["third"] == np.sort(vs)[int(np.ceil(len(vs) / 3)) - 1]


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_kth_keeps_large_whole_numbers(spark, monkeypatch, limit):
    monkeypatch.setattr(ranks, "CELL_VALUES", limit)
    base = 9_007_199_254_740_993
    df = spark.createDataFrame([(base + i * 3,) for i in range(500)], "v long")
    row = ranks.pick_values(df, "v", [ranks.kth("x", lambda n: F.floor(n / 2))]).first()
    assert row["x"] == base + 249 * 3


def test_empty_input(spark):
    df = spark.createDataFrame([], "v double")
    row = ranks.pick_values(df, "v", [ranks.quantile("m", 0.5)]).first()
    assert row["n"] == 0 and row["m"] is None


@pytest.mark.parametrize("limit", [100, 1 << 16])
def test_running_totals(spark, monkeypatch, limit):
    monkeypatch.setattr(ranks, "BUCKET_VALUES", limit)
    rng = np.random.default_rng(3)
    values = np.round(np.concatenate([rng.exponential(1, 4000), np.full(2000, 0.5)]), 3)
    df = spark.createDataFrame([(float(v), 1, 2) for v in values], "v double, a long, b long")
    got = sorted(ranks.running_totals(df, "v", ["a", "b"]).collect())
    distinct, counts = np.unique(values, return_counts=True)
    assert [r["v"] for r in got] == distinct.tolist()
    assert [r["a"] for r in got] == counts.tolist()
    assert [r["before_a"] for r in got] == (np.cumsum(counts) - counts).tolist()
    assert [r["before_b"] for r in got] == (2 * (np.cumsum(counts) - counts)).tolist()


def test_mode_takes_the_smallest_of_the_most_frequent(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 3.0), ("a", 1.0), ("b", None)], "k string, v double")
    assert ranks.modes(df, "v").first()["mode"] == 1.0
    assert [(r["k"], r["mode"], r["mode_count"]) for r in ranks.modes(df, "v", ["k"]).collect()] == [("a", 1.0, 2)]


def test_a_far_value_does_not_widen_the_cells(spark, monkeypatch):
    """One value at 1e15 beside 40,000 small ones: the last cells stay small all the same."""
    monkeypatch.setattr(ranks, "CELL_VALUES", 200)
    df = spark.range(40_000).select(F.when(F.col("id") == 7, 1e15).otherwise(F.col("id") / 7).alias("v"))
    row = ranks.pick_values(df, "v", [ranks.quantile("q", 0.999), ranks.quantile("top", 1.0)]).first()
    values = np.arange(40_000) / 7
    values[7] = 1e15
    assert row["q"] == pytest.approx(np.quantile(values, 0.999), rel=1e-12) and row["top"] == 1e15


def test_a_key_with_most_rows_is_spread(spark):
    """95 % of the rows have one key: they are counted by key and value, and nothing that follows a join by key holds a key's rows."""
    df = spark.range(20_000).select(F.when(F.col("id") % 20 == 0, F.col("id") % 7).otherwise(F.lit(99)).alias("k"), (F.col("id") * 37 % 5003).cast("double").alias("v"))
    out = ranks.pick_values(df, "v", [ranks.quantile("m", 0.5)], ["k"])
    pdf = df.toPandas()
    assert {r["k"]: r["m"] for r in out.collect()} == pdf.groupby("k").v.median().to_dict()
    # The values to be ordered are read from a table that was written after the join with the key's points.
    assert "rank-cells" in plan_text(out)


@pytest.mark.parametrize("limit", [4, 1 << 20])
def test_no_values(spark, monkeypatch, limit):
    monkeypatch.setattr(ranks, "CELL_VALUES", limit)
    df = spark.createDataFrame([("a", None), (None, 2.0), (None, 4.0)], "k string, v double")
    got = {r["k"]: (r["n"], r["m"]) for r in ranks.pick_values(df.where("k is not null"), "v", [ranks.quantile("m", 0.5)], ["k"]).collect()}
    assert got == {"a": (0, None)}
