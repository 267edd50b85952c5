"""Every registered query with a relational form agrees with its SQL."""

import math

import pytest

import __spark_entry__ as entry
from tests.conftest import FOLDER

QUERIES, SQL = entry.queries(), entry.oracle_sql()

def _cell(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v + 0.0:.6g}"
    return "null" if v is None else str(v)


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def _check(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    theirs = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(theirs.columns)
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(theirs.fetchall(), theirs.columns)


# Minutes each at the registry's sizes; test_learning trains smaller models, tools/compare.py runs these.
LONG = {"ml_train_multiclass", "ml_train_regression"}


@pytest.mark.parametrize("name", sorted(set(SQL) - LONG))
def test_matches_sql(spark, duck, name):
    _check(spark, duck, name)


def test_entry(spark):
    assert entry.entry(spark).columns == ["group", "value"]
    assert entry.entry(spark).count() == 3


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
