"""Plans: filters and columns reach the scan, cuts are top-k, nothing is paired with everything."""

import pytest

import __spark_entry__ as entry
from ledgerline.operators import aggregates as A, describe as D, quality as Q
from ledgerline.plans.run import run_plan
from tests.conftest import FOLDER, plan_text


@pytest.fixture
def lineitem(spark):
    return spark.read.parquet(f"{FOLDER}/lineitem.parquet")


_plan = plan_text


def test_typed_filters_and_columns_reach_the_scan(lineitem):
    plan = _plan(
        run_plan(
            lineitem,
            {
                "operation": "top_n", "column": "l_extendedprice", "group_by": "l_returnflag", "n": 3,
                "filters": [
                    {"column": "l_quantity", "operator": "greater_than", "value": 25},
                    {"column": "l_linenumber", "operator": "equals", "value": "3"},
                    {"column": "l_linestatus", "operator": "equals", "value": "F"},
                ],
            },
        )
    )
    for pushed in ("GreaterThan(l_quantity,25.0)", "EqualTo(l_linenumber,3)", "EqualTo(l_linestatus,F)"):
        assert pushed in plan
    assert "l_shipdate" not in plan and "l_discount" not in plan
    assert "TakeOrderedAndProject" in plan


def test_one_scan_for_the_missing_report(lineitem):
    assert _plan(Q.missing(lineitem)).count("Batched: true") == 1


def test_one_scan_for_correlations(lineitem):
    assert _plan(D.pair_correlations(lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])).count("Batched: true") == 1


def test_top_values_are_cut_before_the_shuffle(lineitem):
    assert "WindowGroupLimit" in _plan(A.top_values(lineitem, ["l_returnflag", "l_linestatus"], 5))


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("clean_actions", "file_", "usage_stream", "op12_"))))
def test_no_query_pairs_all_rows(spark, name):
    plan = _plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["plan_aggregate_median", "plan_grouped_median", "eda_numeric", "quality_outliers", "clean_clip_outliers"])
def test_large_inputs_never_gather_a_group(spark, name):
    plan = _plan(entry.queries()[name](spark, FOLDER))
    # The bracketing marks come from a written table; no aggregate holds a group's values.
    assert " percentile(" not in plan and "collect_list" not in plan and "__at" in plan
