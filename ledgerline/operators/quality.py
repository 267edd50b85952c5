"""Data-quality scans and the dataset profile."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ledgerline.errors import IngestError
from ledgerline.functions import ranks, values as V
from ledgerline.operators.describe import column_name, column_quantiles, numeric_long
from ledgerline.operators.roles import inline_agg, role_lists

HIGH_CARDINALITY_RATIO = 0.9
HIGH_CARDINALITY_ROWS = 20
IQR_FACTOR = 1.5
MIN_OUTLIER_ROWS = 4
SAMPLE_POSITIONS = 20

# Logical bytes of one value of a fixed-width type.
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4}
DEFAULT_WIDTH = 8


def missing(df: DataFrame) -> DataFrame:
    """(column, count, percentage) for columns with missing values."""
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            (F.count(F.lit(1)) - F.count(V.present(df, c))).alias("count"),
            F.count(F.lit(1)).alias("n"),
        )
        for c in df.columns
    ]
    return (
        inline_agg(df, rows)
        .where(F.col("count") > 0)
        .select("column", "count", F.round(F.col("count") / F.col("n") * 100, 2).alias("percentage"))
    )


def missing_cells(df: DataFrame) -> Column:
    """Aggregate expression: missing cells over all columns."""
    gaps = [F.count(F.lit(1)) - F.count(V.present(df, c)) for c in df.columns]
    return reduce(lambda a, b: a + b, gaps)


def _row_values(df: DataFrame, skip: Sequence[str] = ()) -> list[Column]:
    out = []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        col = V.present(df, f.name)
        # Maps cannot be grouped; their sorted entries can.
        out.append((F.array_sort(F.map_entries(col)) if isinstance(f.dataType, T.MapType) else col).alias(f.name))
    return out


def _suspects(rows: DataFrame) -> DataFrame:
    """The rows whose hash occurs more than once."""
    hashed = rows.withColumn("__h", F.xxhash64("row"))
    repeated = hashed.groupBy("__h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("__h")
    return hashed.join(repeated, "__h", "left_semi").drop("__h")


def repeated_rows(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """One row per set of identical rows: (row, copies[, first]), with missing values equal to each other.

    Row hashes of 8 bytes are counted first; only rows whose hash repeats are then compared in full.
    """
    skip = [row_id] if row_id else []
    keep = [V.ref(row_id).alias("__id")] if row_id else []
    rows = _suspects(df.select(F.struct(*_row_values(df, skip)).alias("row"), *keep))
    aggs = [F.count(F.lit(1)).alias("copies")] + ([F.min("__id").alias("first")] if row_id else [])
    return rows.groupBy("row").agg(*aggs).where("copies > 1")


def duplicates(df: DataFrame) -> DataFrame:
    """One row (count): repeats beyond the first of each set of identical rows."""
    return repeated_rows(df).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("count"))


def duplicate_positions(df: DataFrame, row_id: str, k: int = SAMPLE_POSITIONS) -> DataFrame:
    """The first ``k`` row ids that repeat an earlier row; the id itself is not compared.

    A row that k copies with smaller ids come before cannot be among them, so the first k + 1 ids of each set of copies are enough.
    Tasks apply that limit before the shuffle: a row repeated any number of times costs k + 1 rows from each task.
    """
    rows = df.select(F.struct(*_row_values(df, [row_id])).alias("row"), V.ref(row_id).alias("row_id")).withColumn("__h", F.xxhash64("row"))
    copies = W.partitionBy("__h", "row").orderBy("row_id")
    return (
        rows.where(F.col("row_id").isNotNull())
        .withColumn("nth", F.dense_rank().over(copies))
        .where(F.col("nth") <= k + 1)
        .where("nth > 1")
        .select("row_id")
        .orderBy("row_id")
        .limit(k)
    )


def constant_columns(df: DataFrame) -> DataFrame:
    """(column) with at most one distinct value; extremes suffice, nothing is shuffled by value."""
    names = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    rows = [
        F.struct(
            F.lit(i).cast("long").alias("ordinal"),
            F.lit(c).alias("column"),
            F.coalesce(F.min(V.present(df, c)) == F.max(V.present(df, c)), F.lit(True)).alias("same"),
        )
        for i, c in enumerate(names)
    ]
    return inline_agg(df, rows).where("same").select("ordinal", "column")


def high_cardinality(df: DataFrame) -> DataFrame:
    """(column, ratio) of non-numeric columns whose values are nearly all different."""
    names = [
        f.name for f in df.schema.fields if V.is_scalar(f.dataType) and not V.is_numeric(f.dataType)
    ]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, ratio double")
    # Values are counted as (column, value) pairs, once: no row is copied for each column's own distinct count.
    pairs = [F.struct(F.lit(i).alias("code"), V.text(df, c).alias("value")) for i, c in enumerate(names)]
    different = df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull()).groupBy("code", "value").agg(F.count(F.lit(1)).alias("c"))
    found = different.groupBy("code").agg(F.count(F.lit(1)).alias("u"))
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        found.withColumn("n", rows)
        .where((F.col("n") >= HIGH_CARDINALITY_ROWS) & (F.col("u") >= HIGH_CARDINALITY_RATIO * F.col("n")))
        .select(F.get(F.array(*[F.lit(c) for c in names]), F.col("code")).alias("column"), F.round(F.col("u") / F.col("n"), 4).alias("ratio"))
    )


def iqr_bounds(df: DataFrame, columns: Sequence[str], coded: bool = False) -> DataFrame:
    """(column or code, n, q1, q3, iqr, lower, upper) per numeric column."""
    picks = [ranks.quantile("q1", 0.25), ranks.quantile("q3", 0.75)]
    iqr = F.col("q3") - F.col("q1")
    return column_quantiles(df, columns, picks, coded).select(
        "code" if coded else "column",
        "n",
        "q1",
        "q3",
        iqr.alias("iqr"),
        (F.col("q1") - IQR_FACTOR * iqr).alias("lower"),
        (F.col("q3") + IQR_FACTOR * iqr).alias("upper"),
    )


def outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, count, lower_bound, upper_bound) of numeric columns with values beyond the fences."""
    columns = list(columns or role_lists(df)["numeric"])
    bounds = iqr_bounds(df, columns, coded=True).where((F.col("n") >= MIN_OUTLIER_ROWS) & (F.col("iqr") != 0))
    beyond = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    # One row of bounds per column of the schema.
    return (
        numeric_long(df, columns)
        .join(F.broadcast(bounds), "code")
        .where(beyond)
        .groupBy("code", "lower", "upper")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(column_name(columns), "count", F.round("lower", 4).alias("lower_bound"), F.round("upper", 4).alias("upper_bound"))
    )


def mostly_numeric_text(df: DataFrame) -> DataFrame:
    """(column, looks_numeric_percentage) of text columns where half or more, but not all, values are numbers."""
    names = [f.name for f in df.schema.fields if V.is_text(f.dataType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, looks_numeric_percentage double")
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.avg(F.when(V.ref(c).isNotNull(), F.when(V.number(df, c).isNotNull(), 1.0).otherwise(0.0))).alias("rate"),
        )
        for c in names
    ]
    return (
        inline_agg(df, rows)
        .where("rate >= 0.5 and rate < 1.0")
        .select("column", F.round(F.col("rate") * 100, 2).alias("looks_numeric_percentage"))
    )


def scan(df: DataFrame) -> DataFrame:
    """(check, column, metric, value): every quality check in one long table."""
    numeric = role_lists(df)["numeric"]
    texts = [c for c in df.columns if V.is_text(V.type_of(df, c))]

    def long(part: DataFrame, check: str, metrics: Sequence[str]) -> DataFrame:
        column = F.col("column") if "column" in part.columns else F.lit(None).cast("string")
        entries = F.array(
            *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        )
        return part.select(F.lit(check).alias("check"), column.alias("column"), F.inline(entries))

    # Shape, gaps, constant columns and numbers in texts come from one pass: a row of totals, one entry for each column.
    n = F.count(F.lit(1))
    facts = [
        F.struct(
            F.lit(c).alias("column"),
            (n - F.count(V.present(df, c))).alias("gaps"),
            (F.lit(False) if isinstance(V.type_of(df, c), T.MapType) else F.coalesce(F.min(V.present(df, c)) == F.max(V.present(df, c)), F.lit(True))).alias("same"),
            (F.avg(F.when(V.ref(c).isNotNull(), F.when(V.number(df, c).isNotNull(), 1.0).otherwise(0.0))) if c in texts else F.lit(None).cast("double")).alias("rate"),
        )
        for c in df.columns
    ]
    once = df.agg(n.alias("n"), F.array(*facts).alias("facts"))
    gaps = F.aggregate("facts", F.lit(0).cast("long"), lambda total, f: total + f.gaps)
    entry = lambda check, column, metric, value: F.struct(
        F.lit(check).alias("check"), column.alias("column"), F.lit(metric).alias("metric"), value.cast("double").alias("value")
    )
    none = F.lit(None).cast("string")
    shape = F.array(
        entry("shape", none, "row_count", F.col("n")),
        entry("shape", none, "column_count", F.lit(len(df.columns))),
        entry("shape", none, "total_missing_cells", gaps),
    )
    keep = lambda check, metric, value, where: F.transform(F.filter("facts", where), lambda f: entry(check, f.column, metric, value(f)))
    per_column = [
        keep("missing", "count", lambda f: f.gaps, lambda f: f.gaps > 0),
        keep("missing", "percentage", lambda f: F.round(f.gaps / F.col("n") * 100, 2), lambda f: f.gaps > 0),
        keep("constant", "constant", lambda f: F.lit(1), lambda f: f.same),
        keep("dtype", "looks_numeric_percentage", lambda f: F.round(f.rate * 100, 2), lambda f: (f.rate >= 0.5) & (f.rate < 1.0)),
    ]
    parts = [
        once.select(F.inline(F.concat(shape, *per_column))),
        long(duplicates(df), "duplicates", ["count"]),
        long(high_cardinality(df), "high_cardinality", ["ratio"]),
    ]
    if numeric:
        parts.append(long(outliers(df, numeric), "outliers", ["count", "lower_bound", "upper_bound"]))
    return reduce(DataFrame.unionByName, parts)


def logical_bytes(df: DataFrame) -> Column:
    """Aggregate expression: fixed width times rows plus text lengths in bytes; nested columns not counted."""
    total = F.lit(0).cast("long")
    for f in df.schema.fields:
        if V.is_text(f.dataType):
            total = total + F.coalesce(F.sum(F.octet_length(V.ref(f.name)).cast("long")), F.lit(0))
        elif V.is_scalar(f.dataType):
            total = total + F.count(F.lit(1)) * F.lit(WIDTHS.get(f.dataType.simpleString(), DEFAULT_WIDTH))
    return total


def profile(df: DataFrame, exact_duplicates: bool = True) -> DataFrame:
    """One row: shape, missing cells, duplicates, logical bytes, and the columns of each role."""
    if not df.columns:
        raise IngestError("there is no column to profile")
    roles = role_lists(df)
    base = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("long").alias("column_count"),
        missing_cells(df).alias("missing_values_count"),
        logical_bytes(df).alias("logical_bytes"),
    )
    dup = duplicates(df).scalar() if exact_duplicates else F.lit(None).cast("long")
    return base.select(
        "row_count",
        "column_count",
        "missing_values_count",
        dup.alias("duplicate_rows_count"),
        "logical_bytes",
        *[F.lit(", ".join(roles[r])).alias(f"{r}_columns") for r in ("numeric", "categorical", "datetime")],
        F.lit(not exact_duplicates).alias("duplicate_detection_skipped"),
    )


def compare_profiles(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, original, cleaned, change) for two tables."""
    names = ("row_count", "column_count", "missing_values_count", "duplicate_rows_count", "logical_bytes")

    def long(df: DataFrame, out: str) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias(out)) for m in names])
        return profile(df).select(F.inline(rows))

    # Five rows on either side.
    both = long(before, "original").join(F.broadcast(long(after, "cleaned")), "metric")
    return both.select("metric", "original", "cleaned", (F.col("cleaned") - F.col("original")).alias("change"))
