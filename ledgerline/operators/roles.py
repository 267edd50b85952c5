"""Column roles: numeric, categorical or datetime; feature roles and task type for training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ledgerline.errors import TrainingError
from ledgerline.functions import values as V

DATE_SHARE = 0.85
MAX_FEATURE_CATEGORIES = 30
MAX_CLASSES = 20
# Bits of the set of hashes that tells columns of many values from those worth counting.
HASH_SLOTS = 32768


def inline_agg(df: DataFrame, rows: Sequence) -> DataFrame:
    """One pass over ``df``; each struct of aggregates becomes a row."""
    return df.agg(F.array(*rows).alias("__rows")).select(F.inline("__rows"))


def _schema_role(dtype: T.DataType) -> str | None:
    if V.is_temporal(dtype):
        return "datetime"
    if V.is_numeric(dtype):
        return "numeric"
    if V.is_text(dtype):
        return None
    return "categorical" if V.is_scalar(dtype) else "unsupported"


def date_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, share): the share of present texts that read as dates, all columns in one pass."""
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.coalesce(
                F.avg(F.when(V.ref(c).isNotNull(), F.when(V.timestamp(df, c).isNotNull(), 1.0).otherwise(0.0))),
                F.lit(0.0),
            ).alias("share"),
        )
        for c in columns
    ]
    return inline_agg(df, rows)


def classify(df: DataFrame) -> DataFrame:
    """(ordinal, column, spark_type, role); text columns are datetime when most values read as dates."""
    rows = []
    for i, field in enumerate(df.schema.fields):
        role = _schema_role(field.dataType)
        if role is None:
            good = F.count(F.when(V.timestamp(df, field.name).isNotNull(), 1))
            known = F.count(V.ref(field.name))
            role_col = F.when((known > 0) & (good >= DATE_SHARE * known), "datetime").otherwise("categorical")
        else:
            role_col = F.lit(role)
        rows.append(
            F.struct(
                F.lit(i).cast("long").alias("ordinal"),
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("spark_type"),
                role_col.alias("role"),
            )
        )
    return inline_agg(df, rows)


def role_lists(df: DataFrame) -> dict[str, list[str]]:
    """Column names per role in column order; reads data only if there are text columns."""
    found = {"numeric": [], "categorical": [], "datetime": [], "unsupported": []}
    fixed = {f.name: _schema_role(f.dataType) for f in df.schema.fields}
    open_ones = [c for c, r in fixed.items() if r is None]
    if open_ones:
        # One row per text column comes back to the driver.
        for row in date_share(df, open_ones).collect():
            fixed[row["column"]] = "datetime" if row["share"] >= DATE_SHARE else "categorical"
    for c in df.columns:
        found[fixed[c]].append(c)
    return found


def dtype_rows(df: DataFrame) -> DataFrame:
    """(column, spark_type) from the schema alone."""
    return df.sparkSession.createDataFrame(df.dtypes, "column string, spark_type string")


def few_values(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, int]:
    """Distinct present values of each column: exact up to ``limit``, some larger number beyond it.

    A first pass marks the hashes of every column's values in a set of bits, which no row is copied or shuffled for. Marks can only
    fall short, when two values share one, so the columns that stay within the limit are counted as (column, value) pairs.
    """
    if not columns:
        return {}
    marks = [
        F.struct(
            F.lit(i).alias("code"),
            F.bitmap_count(
                F.bitmap_construct_agg(
                    F.when(V.present(df, c).isNotNull(), F.bitmap_bit_position(F.pmod(F.xxhash64(V.present(df, c)), F.lit(HASH_SLOTS)) + 1))
                )
            ).alias("n"),
        )
        for i, c in enumerate(columns)
    ]
    # One row per column comes back, here and below.
    found = {columns[r["code"]]: r["n"] for r in inline_agg(df, marks).collect()}
    near = [c for c in columns if found[c] <= limit]
    if near:
        pairs = [F.struct(F.lit(i).alias("code"), V.text(df, c).alias("value")) for i, c in enumerate(near)]
        different = df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull()).groupBy("code", "value").agg(F.count(F.lit(1)).alias("c"))
        found.update({near[r["code"]]: r["u"] for r in different.groupBy("code").agg(F.count(F.lit(1)).alias("u")).collect()})
    return found


def feature_roles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(ordinal, column, role): numeric, categorical (few distinct values) or dropped."""
    other = [c for c in columns if not V.is_numeric(V.type_of(df, c)) and V.is_scalar(V.type_of(df, c))]
    counts = few_values(df, other, MAX_FEATURE_CATEGORIES)

    def role(c: str) -> str:
        if V.is_numeric(V.type_of(df, c)):
            return "numeric"
        return "categorical" if c in counts and counts[c] <= MAX_FEATURE_CATEGORIES else "dropped"

    rows = [(i, c, role(c)) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "ordinal long, column string, role string")


def split_features(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric and categorical feature names; one row per column comes back to the driver."""
    roles = {r["column"]: r["role"] for r in feature_roles(df, columns).collect()}
    return [c for c in columns if roles[c] == "numeric"], [c for c in columns if roles[c] == "categorical"]


def task_type(df: DataFrame, target: str) -> DataFrame:
    """One row (known, task_type); task_type is null for an all-missing target."""
    known = F.count(V.present(df, target)).alias("known")
    if not V.is_numeric(V.type_of(df, target)):
        out = df.agg(known).withColumn("task", F.lit("classification"))
    else:
        few = F.countDistinct(V.present(df, target)) <= MAX_CLASSES
        out = df.agg(known, F.when(few, "classification").otherwise("regression").alias("task"))
    return out.select("known", F.when(F.col("known") > 0, F.col("task")).alias("task_type"))


def detect_task(df: DataFrame, target: str) -> str:
    task = task_type(df, target).first()["task_type"]
    if task is None:
        raise TrainingError(f"{target!r} has no values")
    return task


def can_forecast(df: DataFrame) -> bool:
    roles = role_lists(df)
    return bool(roles["datetime"] and roles["numeric"])
