"""Exact ranks at any scale: quantiles, k-th values and running totals, by one program for every size.

Values are counted by (key, value) first, which spreads a key over the cluster however many rows it has and makes one row of a value
however often it occurs. A bounded quantile sketch then cuts each key's distinct values into CELLS cells of similar numbers, whatever
their spread; exact counts by cell tell which cell holds each wanted rank; only those cells go on, and are cut again while any of
them has more than CELL_VALUES distinct values. The values of the last cells are ordered. No step gathers a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerline.runtime import attach, settle

CELLS = 64
CELL_VALUES = 1 << 20
SKETCH_ACCURACY = 10000
# Distinct values that a running total orders in one task, about.
BUCKET_VALUES = 1 << 16


@dataclass(frozen=True)
class Pick:
    """A wanted zero-based position among the sorted values of a group of ``n``.

    ``share`` is position/(n-1) where that is a constant. ``whole`` marks positions that are whole
    numbers, whose value keeps its own type.
    """

    name: str
    position: Callable[[Column], Column]
    share: float | None = None
    whole: bool = False


def quantile(name: str, p: float) -> Pick:
    """Linear interpolation between the two nearest ranks."""
    return Pick(name, lambda n: (n - F.lit(1)) * F.lit(float(p)), float(p))


def kth(name: str, rank: Callable[[Column], Column]) -> Pick:
    """The value at a one-based rank, computed from the group's count."""
    return Pick(name, lambda n: (rank(n) - F.lit(1)).cast("double"), None, True)


def _cell(x: Column, points: Column) -> Column:
    """How many of the CELLS - 1 points lie below a value, by binary search."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.get(points, middle) < x, search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, CELLS - 1)


def pick_values(
    df: DataFrame,
    value: str,
    picks: Sequence[Pick],
    keys: Sequence[str] = (),
    extras: Sequence[Column] = (),
    few_keys: bool = False,
) -> DataFrame:
    """One row per key: ``n`` non-null values, the extra aggregates, and one column per pick.

    ``extras`` are aggregates a pick's position may refer to by name. ``few_keys`` states that the keys are bounded by the schema
    (column names), which allows a broadcast. The small tables between the passes, and the counted values, are written.
    """
    by = list(keys)
    near = [*by, "__cell"]
    marks = ["__at", "__t"]
    ranks_of = []
    for i, p in enumerate(picks):
        at = p.position(F.col("n"))
        ranks_of += [F.struct(F.lit(2 * i).alias("__t"), F.floor(at).alias("__at")), F.struct(F.lit(2 * i + 1).alias("__t"), F.ceil(at).alias("__at"))]
    whole = settle(df.groupBy(*by).agg(F.count(value).alias("n"), *extras), "rank-keys")
    targets = whole.where(F.col("n") > 0).select(*by, F.inline(F.array(*ranks_of)), F.lit(0).cast("long").alias("__before"), F.lit(0).cast("long").alias("__cell"))
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    rows = settle(counted.withColumn("__cell", F.lit(0).cast("long")), "rank-values")
    largest = None
    while True:
        x = F.col("__v").cast("double")
        shares = [i / CELLS for i in range(1, CELLS)]
        points = settle(rows.groupBy(*near).agg(F.percentile_approx(x, shares, SKETCH_ACCURACY).alias("__points")), "rank-points")
        lone = not by and largest is None
        beside = attach(rows, points.drop("__cell") if lone else points, [] if lone else near, few_keys or not by)
        cell = (F.col("__cell") * CELLS + _cell(x, F.col("__points"))).alias("__cell2")
        placed = beside.select(*near, "__v", "__c", cell)
        if by and not few_keys:
            # Written before it is counted: an oversized partition of this join can be split as nothing else needs its layout.
            placed = settle(placed, "rank-cells")
        sums = placed.groupBy(*near, "__cell2").agg(F.sum("__c").alias("__c"), F.count(F.lit(1)).alias("__m"))
        upto = F.sum("__c").over(W.partitionBy(*near).orderBy("__cell2").rowsBetween(W.unboundedPreceding, W.currentRow))
        counts = sums.withColumn("__upto", upto).withColumn("__below", upto - F.col("__c"))
        holds = (F.col("__before") + F.col("__below") <= F.col("__at")) & (F.col("__at") < F.col("__before") + F.col("__upto"))
        targets = settle(
            targets.join(counts, near)
            .where(holds)
            .select(*by, *marks, (F.col("__before") + F.col("__below")).alias("__before"), F.col("__cell2").alias("__cell"), "__m"),
            "rank-targets",
        )
        wanted = targets.select(*near, "__before").distinct()
        most = targets.agg(F.max("__m")).first()[0] or 0
        rows = placed.select(*by, F.col("__cell2").alias("__cell"), "__v", "__c")
        rows = rows.join(F.broadcast(wanted) if few_keys or not by else wanted, near)
        # Values that no sketch of doubles can part (whole numbers beyond 2**53) are ordered as they are.
        if most <= CELL_VALUES or most == largest:
            break
        largest = most
        rows = settle(rows.drop("__before"), "rank-rows")
        targets = targets.drop("__m")
    running = F.sum("__c").over(W.partitionBy(*near).orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow))
    ends = rows.withColumn("__end", F.col("__before") + running).drop("__before")
    found = targets.select(*near, *marks).join(ends, near).where((F.col("__end") - F.col("__c") <= F.col("__at")) & (F.col("__at") < F.col("__end")))
    chosen = [F.max(F.when(F.col("__t") == t, F.col("__v"))).alias(f"__p{t}") for t in range(2 * len(picks))]
    out = attach(whole, found.groupBy(*by).agg(*chosen), by, few_keys, "left")
    for i, p in enumerate(picks):
        lo, hi, at = F.col(f"__p{2 * i}"), F.col(f"__p{2 * i + 1}"), p.position(F.col("n"))
        out = out.withColumn(p.name, lo if p.whole else lo + (at - F.floor(at)) * (hi - lo))
    return out.drop(*[f"__p{t}" for t in range(2 * len(picks))])


def running_totals(df: DataFrame, value: str, weights: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Distinct values (by key) with, per weight column, its sum and ``before_<weight>``: the sum below the value.

    Distinct values are cut by a sketch into buckets of about BUCKET_VALUES; windows run over the totals of the buckets and
    inside each of them.
    """
    by = list(keys)
    distinct = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*[F.sum(w).alias(w) for w in weights])
    # Three steps read the distinct values: the split points, the bucket totals and the buckets themselves.
    distinct = settle(distinct.withColumn("__x", F.col(value).cast("double")), "distinct-values")
    parts = max(1, min(distinct.count() // BUCKET_VALUES + 1, SKETCH_ACCURACY))
    cuts = sorted(set(distinct.approxQuantile("__x", [i / parts for i in range(1, parts)], 1 / SKETCH_ACCURACY))) if parts > 1 else []
    if cuts:
        cutter = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="__x", outputCol="__bucket")
        placed = cutter.transform(distinct).select(*by, value, *weights, "__bucket")
    else:
        placed = distinct.select(*by, value, *weights, F.lit(0.0).alias("__bucket"))
    every = W.partitionBy(*by).orderBy("__bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = (
        placed.groupBy(*by, "__bucket")
        .agg(*[F.sum(w).alias(w) for w in weights])
        .select(*by, "__bucket", *[(F.sum(w).over(every) - F.col(w)).alias(f"__off_{w}") for w in weights])
    )
    inside = W.partitionBy(*by, "__bucket").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    return placed.join(offsets, [*by, "__bucket"]).select(
        *by,
        value,
        *weights,
        *[(F.sum(w).over(inside) - F.col(w) + F.col(f"__off_{w}")).alias(f"before_{w}") for w in weights],
    )


def modes(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent value per key, the smallest on a tie, with its count.

    Counting by (key, value) first spreads a key over the cluster; the second step merges small maxima.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    best = F.min_by(F.struct(F.col(value), F.col("__c")), F.struct(-F.col("__c"), F.col(value)))
    return (counted.groupBy(*keys) if keys else counted.groupBy()).agg(best.alias("__m")).select(
        *keys, F.col(f"__m.{value}").alias("mode"), F.col("__m.__c").alias("mode_count")
    )
