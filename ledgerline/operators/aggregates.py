"""Aggregates, value counts and column descriptions, whole-table or by one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerline.errors import PlanError
from ledgerline.functions import ranks, values as V
from ledgerline.functions.stats import AGGREGATIONS, SIMPLE, pair_corr

MAX_GROUPS = 25
TOP_DESCRIBE = 5
TOP_EDA = 10
TOP_UNIQUE = 20


def check_aggregation(df: DataFrame, column: str, agg: str) -> None:
    if agg not in AGGREGATIONS:
        raise PlanError(f"{agg!r} is no aggregate; there are {', '.join(AGGREGATIONS)}")
    if agg != "count" and not V.is_numeric(V.type_of(df, column)):
        raise PlanError(f"{column!r} holds no numbers to take the {agg} of")


def _measure(df: DataFrame, column: str, agg: str) -> Column:
    if agg == "count" and not V.is_numeric(V.type_of(df, column)):
        return F.when(V.present(df, column).isNotNull(), F.lit(1.0))
    return V.number(df, column)


def grouped_value(df: DataFrame, keys: dict[str, Column], column: str, agg: str) -> DataFrame:
    """One row per key with the unrounded aggregate ``value``; rows with a missing key are left out."""
    check_aggregation(df, column, agg)
    rows = df.select(*[k.alias(n) for n, k in keys.items()], _measure(df, column, agg).alias("__m"))
    rows = rows.na.drop(subset=list(keys)) if keys else rows
    if agg == "median":
        return ranks.pick_values(rows, "__m", [ranks.quantile("value", 0.5)], list(keys)).drop("n")
    return (rows.groupBy(*keys) if keys else rows.groupBy()).agg(SIMPLE[agg](F.col("__m")).alias("value"))


def aggregate(df: DataFrame, column: str, agg: str) -> DataFrame:
    """One row: the aggregate of a column."""
    return grouped_value(df, {}, column, agg).select(F.round("value", 4).alias("value"))


def ranked_groups(
    df: DataFrame, column: str, group_by: str, agg: str = "sum", n: int = MAX_GROUPS, ascending: bool = False
) -> DataFrame:
    """The first ``n`` groups by aggregate, missing aggregates last, ties by key."""
    out = grouped_value(df, {"__g": V.present(df, group_by)}, column, agg)
    value = F.col("value").asc_nulls_last() if ascending else F.col("value").desc_nulls_last()
    return (
        out.orderBy(value, F.col("__g"))
        .limit(max(0, min(int(n), MAX_GROUPS)))
        .select(F.col("__g").cast("string").alias("group"), F.round("value", 4).alias("value"))
    )


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    """Rows per value of a column, missing keys left out."""
    rows = df.select(V.present(df, key).alias(key)).na.drop()
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def value_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values, ties by value."""
    return (
        group_sizes(df, column)
        .orderBy(F.desc("count"), V.ref(column))
        .limit(k)
        .select(V.ref(column).cast("string").alias("value"), "count")
    )


def distinct_count(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """Number of distinct non-missing values; the sketch is opt-in."""
    col = V.present(df, column)
    if not exact:
        return df.agg(F.approx_count_distinct(col).alias("unique_count"))
    return df.agg(F.countDistinct(col).alias("unique_count"))


def describe_numeric(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, median, min, max, std."""
    rows = df.select(V.number(df, column).alias("v"))
    moments = [F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.stddev_samp("v").alias("std")]
    out = ranks.pick_values(rows, "v", [ranks.quantile("median", 0.5)], extras=moments)
    return out.select(
        F.lit(column).alias("column"),
        F.col("n").alias("count"),
        *[F.round(c, 4).alias(c) for c in ("mean", "median", "min", "max", "std")],
    )


def top_values(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """(column, rank, value, count, total, unique_count) for the ``k`` most frequent values of each column.

    A column without values has one row without a rank, its totals 0.
    """
    pairs = [F.struct(F.lit(i).alias("code"), V.text(df, c).alias("value")) for i, c in enumerate(columns)]
    counts = (
        df.select(F.inline(F.array(*pairs)))
        .where(F.col("value").isNotNull())
        .groupBy("code", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    totals = counts.groupBy("code").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("unique_count"))
    order = W.partitionBy("code").orderBy(F.desc("count"), "value")
    # A rank filter this small is applied inside each task before the shuffle.
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = F.array(*[F.lit(c) for c in columns])
    # One row per column of the schema, whether it has values or not, and one row of totals at most.
    every = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("code"))
    return best.join(every, "code", "right").join(F.broadcast(totals), "code", "left").select(
        F.get(names, F.col("code")).alias("column"),
        F.col("rank").cast("long").alias("rank"),
        "value",
        "count",
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
    )


def describe_categorical(df: DataFrame, column: str, k: int = TOP_DESCRIBE) -> DataFrame:
    """The top values of one column, each row carrying the column's count and distinct count."""
    found = top_values(df, [column], k).select(
        "column", F.col("total").alias("count"), "unique_count", "rank", "value", F.col("count").alias("value_count")
    )
    return found.orderBy("rank")


def unique_values(df: DataFrame, column: str) -> DataFrame:
    """The most frequent values of one column by rank, each row carrying the column's distinct count."""
    return top_values(df, [column], TOP_UNIQUE).select("unique_count", "rank", "value", "count").orderBy("rank")


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Pearson correlation of two columns read as numbers; null when a side is constant."""
    r = pair_corr(V.number(df, a), V.number(df, b))
    return df.agg(r.alias("r")).select(
        F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.round("r", 4).alias("correlation")
    )
