"""Descriptive statistics for all columns of a role at once, in long form."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions import ranks, values as V
from ledgerline.operators.aggregates import TOP_DESCRIBE, TOP_EDA, top_values
from ledgerline.operators.roles import inline_agg, role_lists

MAX_CONTEXT_COLUMNS = 40
# Rows looked at for a column's first known value, and the share of the sum of squares below which a spread is rounding.
ORIGIN_ROWS = 1000
NO_SPREAD = 1e-13
NUMERIC_METRICS = ("count", "mean", "median", "mode", "std", "min", "max", "q1", "q3")


def numeric_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(code, value) for the present numbers of the chosen columns; the code is the place in ``columns``."""
    pairs = [F.struct(F.lit(i).alias("code"), V.number(df, c).alias("value")) for i, c in enumerate(columns)]
    return df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())


def column_name(columns: Sequence[str]) -> Column:
    """The name behind a code."""
    return F.get(F.array(*[F.lit(c) for c in columns]), F.col("code")).alias("column")


def column_quantiles(df: DataFrame, columns: Sequence[str], picks: Sequence[ranks.Pick], coded: bool = False) -> DataFrame:
    """(column, n, one column per pick); there are as many keys as chosen columns."""
    out = ranks.pick_values(
        numeric_long(df, columns), "value", picks, ["code"], few_keys=True
    )
    return out if coded else out.select(column_name(columns), *[c for c in out.columns if c != "code"])


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, count, mean, median, mode, std, min, max, q1, q3), rounded to four digits."""
    columns = list(columns or role_lists(df)["numeric"])
    moments = inline_agg(
        df,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.count(V.number(df, c)).alias("count"),
                F.avg(V.number(df, c)).alias("mean"),
                F.stddev_samp(V.number(df, c)).alias("std"),
                F.min(V.number(df, c)).alias("min"),
                F.max(V.number(df, c)).alias("max"),
            )
            for c in columns
        ],
    )
    picks = [ranks.quantile("q1", 0.25), ranks.quantile("median", 0.5), ranks.quantile("q3", 0.75)]
    quantiles = column_quantiles(df, columns, picks).drop("n")
    mode = ranks.modes(numeric_long(df, columns), "value", ["code"]).select(column_name(columns), "mode")
    # Both joined sides hold one row per column.
    out = moments.join(F.broadcast(quantiles), "column", "left").join(F.broadcast(mode), "column", "left")
    return out.select("column", "count", *[F.round(m, 4).alias(m) for m in NUMERIC_METRICS[1:]])


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None, k: int = TOP_EDA) -> DataFrame:
    """(column, rank, value, count, total, unique_count); the mode is the value of rank 1."""
    return top_values(df, list(columns or role_lists(df)["categorical"]), k)


def datetime_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, count, min, max, range_days) with ISO texts and whole days."""
    columns = list(columns or role_lists(df)["datetime"])
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(V.timestamp(df, c)).alias("count"),
            F.min(V.timestamp(df, c)).alias("lo"),
            F.max(V.timestamp(df, c)).alias("hi"),
        )
        for c in columns
    ]
    seconds = F.unix_micros(F.col("hi").cast("timestamp")) - F.unix_micros(F.col("lo").cast("timestamp"))
    return inline_agg(df, rows).select(
        "column",
        "count",
        V.iso(F.col("lo")).alias("min"),
        V.iso(F.col("hi")).alias("max"),
        F.floor(seconds / F.lit(86400000000)).alias("range_days"),
    )


def describe_all(df: DataFrame) -> DataFrame:
    """(column, role, metric, number, label) for every column by role."""
    roles = role_lists(df)
    none_text, none_num = F.lit(None).cast("string"), F.lit(None).cast("double")
    parts = []
    if roles["numeric"]:
        metrics = F.array(
            *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("number")) for m in NUMERIC_METRICS]
        )
        parts.append(
            numeric_summary(df, roles["numeric"])
            .select("column", F.inline(metrics))
            .where(F.col("number").isNotNull())
            .select("column", F.lit("numeric").alias("role"), "metric", "number", none_text.alias("label"))
        )
    if roles["categorical"]:
        top = categorical_summary(df, roles["categorical"])
        parts.append(
            top.select(
                "column",
                F.lit("categorical").alias("role"),
                F.concat(F.lit("top_"), F.col("rank")).alias("metric"),
                F.col("count").cast("double").alias("number"),
                F.col("value").alias("label"),
            )
        )
        totals = F.array(
            F.struct(F.lit("count").alias("metric"), F.col("total").cast("double").alias("number")),
            F.struct(F.lit("unique_count").alias("metric"), F.col("unique_count").cast("double").alias("number")),
        )
        parts.append(
            top.where("rank = 1")
            .select("column", F.inline(totals))
            .select("column", F.lit("categorical").alias("role"), "metric", "number", none_text.alias("label"))
        )
    if roles["datetime"]:
        dates = datetime_summary(df, roles["datetime"])
        entries = F.array(
            F.struct(F.lit("count").alias("metric"), F.col("count").cast("double").alias("number"), none_text.alias("label")),
            F.struct(F.lit("min").alias("metric"), none_num.alias("number"), F.col("min").alias("label")),
            F.struct(F.lit("max").alias("metric"), none_num.alias("number"), F.col("max").alias("label")),
            F.struct(
                F.lit("range_days").alias("metric"), F.col("range_days").cast("double").alias("number"), none_text.alias("label")
            ),
        )
        parts.append(
            dates.select("column", F.lit("datetime").alias("role"), F.inline(entries)).where(
                F.col("number").isNotNull() | F.col("label").isNotNull()
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cross_products(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, n, si, sj, qi, qj, p) for each pair i <= j: count, sums, squares and products over the rows where both have a number.

    One pass, whatever the number of columns: each task multiplies its blocks of rows with their masks and gives one row for each
    pair, which are added up. Values are taken relative to the first known one of each column, so that sums of squares stay exact for
    constant columns and lose little for those far from zero. Infinite values count as missing.
    """
    numbers = df.select(*[V.number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    known = numbers.limit(ORIGIN_ROWS).agg(*[F.first(c, ignorenulls=True).alias(c) for c in numbers.columns]).first()
    origin = np.nan_to_num(np.array([0.0 if v is None else v for v in known]), nan=0.0, posinf=0.0, neginf=0.0)

    def run(batches):
        total = None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            mask = np.isfinite(x)
            x = np.where(mask, x - origin, 0.0)
            m = mask.astype(float)
            part = np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
            total = part if total is None else total + part
        if total is None:
            return
        i, j = np.triu_indices(len(origin))
        n, s, q, p = total
        made = (i.astype(np.int64), j.astype(np.int64), n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j])
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in made], names=["i", "j", "n", "si", "sj", "qi", "qj", "p"])

    parts = numbers.mapInArrow(run, "i long, j long, n double, si double, sj double, qi double, qj double, p double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "qi", "qj", "p")])


def _all_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(ordinal_a, ordinal_b, column_a, column_b, correlation) for each pair a <= b of columns, pairwise complete."""
    n = F.col("n")
    spread = [F.col(f"q{k}") - F.try_divide(F.col(f"s{k}") * F.col(f"s{k}"), n) for k in "ij"]
    # What is left of a constant column after rounding is no spread.
    varied = [v > F.lit(NO_SPREAD) * F.col(f"q{k}") for v, k in zip(spread, "ij")]
    r = F.when(varied[0] & varied[1], F.try_divide(F.col("p") - F.try_divide(F.col("si") * F.col("sj"), n), F.sqrt(spread[0]) * F.sqrt(spread[1])))
    label = F.array(*[F.lit(c) for c in columns])
    # A table without rows has no sums: every pair is there all the same.
    k = len(columns)
    pairs = df.sparkSession.range(k * k).select(F.expr(f"id div {k}").alias("i"), F.expr(f"id % {k}").alias("j")).where("i <= j")
    found = pairs.join(cross_products(df, columns), ["i", "j"], "left")
    return found.select(
        F.col("i").alias("ordinal_a"), F.col("j").alias("ordinal_b"),
        F.get(label, F.col("i").cast("int")).alias("column_a"), F.get(label, F.col("j").cast("int")).alias("column_b"),
        F.when(r.isNull(), 0.0).otherwise(F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)), 4)).alias("correlation"),
    )


def pair_correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(ordinal_a, ordinal_b, column_a, column_b, correlation) for each pair a < b, pairwise complete; constant columns give 0."""
    columns = list(columns or role_lists(df)["numeric"])
    if len(columns) < 2:
        empty = "ordinal_a long, ordinal_b long, column_a string, column_b string, correlation double"
        return df.sparkSession.createDataFrame([], empty)
    return _all_pairs(df, columns).where("ordinal_a < ordinal_b")


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_a, column_b, correlation) for every ordered pair, the diagonal included (0 for a constant column)."""
    columns = list(columns or role_lists(df)["numeric"])
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, correlation double")
    once = F.array(F.struct("column_a", "column_b"))
    both = F.array(F.struct("column_a", "column_b"), F.struct(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b")))
    sides = F.when(F.col("ordinal_a") == F.col("ordinal_b"), once).otherwise(both)
    return _all_pairs(df, columns).select(F.explode(sides).alias("p"), "correlation").select("p.*", "correlation")


def strongest_pair(df: DataFrame, columns: Sequence[str] | None = None, least: float = 0.3) -> DataFrame:
    """At most one row: the pair with the largest absolute correlation, the first in column order on a tie."""
    return (
        pair_correlations(df, columns)
        .orderBy(F.desc(F.abs("correlation")), "ordinal_a", "ordinal_b")
        .limit(1)
        .where(F.abs("correlation") >= least)
        .select("column_a", "column_b", "correlation")
    )


def dataset_context(df: DataFrame) -> DataFrame:
    """(ordinal, column, role, dtype, min, max, mean, unique_count, top_values) for the first 40 columns."""
    names = df.columns[:MAX_CONTEXT_COLUMNS]
    head = df.select(*[V.ref(c) for c in names])
    roles = role_lists(head)
    none = {"string": F.lit(None).cast("string"), "double": F.lit(None).cast("double"), "long": F.lit(None).cast("long")}
    rows = []
    for i, c in enumerate(names):
        role = next(r for r, cs in roles.items() if c in cs)
        lo, hi, mean = none["string"], none["string"], none["double"]
        if role == "numeric":
            lo = F.round(F.min(V.number(df, c)), 4).cast("string")
            hi = F.round(F.max(V.number(df, c)), 4).cast("string")
            mean = F.round(F.avg(V.number(df, c)), 4)
        elif role == "datetime":
            lo, hi = V.iso(F.min(V.timestamp(df, c))), V.iso(F.max(V.timestamp(df, c)))
        rows.append(
            F.struct(
                F.lit(i).cast("long").alias("ordinal"),
                F.lit(c).alias("column"),
                F.lit(role).alias("role"),
                F.lit(V.type_of(df, c).simpleString()).alias("dtype"),
                lo.alias("min"),
                hi.alias("max"),
                mean.alias("mean"),
            )
        )
    base = inline_agg(head, rows)
    if not roles["categorical"]:
        return base.withColumn("unique_count", none["long"]).withColumn("top_values", none["string"])
    tops = (
        top_values(head, roles["categorical"], TOP_DESCRIBE)
        .groupBy("column")
        .agg(
            F.max("unique_count").alias("unique_count"),
            F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("t"),
        )
        .select("column", "unique_count", F.array_join("t.value", ", ").alias("top_values"))
    )
    joined = base.join(F.broadcast(tops), "column", "left")
    return joined.select(*base.columns, "unique_count", "top_values")
