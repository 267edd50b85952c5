"""Queries over workspace tables: listings, lineage, latest-per-group picks, totals and usage limits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions import values as V


def owned_by(df: DataFrame, owner_column: str, owner) -> DataFrame:
    """Rows of one owner."""
    return df.where(V.ref(owner_column) == F.lit(owner))


def lineage(datasets: DataFrame, dataset_id: str, source_id: str) -> DataFrame:
    """(dataset_id, source_dataset_id): each cleaned copy with its existing source."""
    child = datasets.select(V.ref(dataset_id).alias("dataset_id"), V.ref(source_id).alias("source_dataset_id"))
    parent = datasets.select(V.ref(dataset_id).alias("source_dataset_id"))
    return child.where("source_dataset_id is not null").join(parent, "source_dataset_id").select(
        "dataset_id", "source_dataset_id"
    )


def project_contents(projects: DataFrame, items: DataFrame, project_id: str) -> DataFrame:
    """Items with their project's columns."""
    return projects.join(items, project_id)


def unassigned(items: DataFrame, project_id: str) -> DataFrame:
    return items.where(V.ref(project_id).isNull())


def best_per_group(df: DataFrame, group: str, order: Sequence[Column], largest: bool = True) -> DataFrame:
    """One whole row per group, the one with the largest (or smallest) order values.

    An aggregate merges per-task winners, so a group of any size never meets in one task.
    """
    row = F.struct(*[V.ref(c) for c in df.columns])
    pick = F.max_by if largest else F.min_by
    return df.groupBy(V.ref(group).alias("__g")).agg(pick(row, F.struct(*order)).alias("__r")).select("__r.*")


def first_messages(messages: DataFrame, conversation: str, position: str) -> DataFrame:
    """The opening message of every conversation."""
    return best_per_group(messages, conversation, [V.ref(position)], largest=False)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of a listing; ``order`` must end in a unique column."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def page_order(order: Sequence[tuple[str, bool]]) -> list[Column]:
    """Sort columns for (column, whether it descends); missing values come first going up and last going down."""
    return [V.ref(c).desc_nulls_last() if down else V.ref(c).asc_nulls_first() for c, down in order]


def page_after(df: DataFrame, order: Sequence[tuple[str, bool]], last: dict | None, size: int) -> DataFrame:
    """The ``size`` rows that follow the row ``last`` (its values of the order's columns), or the first ones without it.

    ``order`` must end in a unique column. What is before the key is filtered out where it is read, and each task keeps
    ``size`` rows, so a page far down costs what the first one does; a listing goes on from the last row it has shown.
    """
    if last is not None:
        after, equal = F.lit(False), F.lit(True)
        for c, down in order:
            value, mark = V.ref(c), F.lit(last[c])
            if last[c] is None:
                beyond = F.lit(False) if down else value.isNotNull()
            elif down:
                beyond = (value < mark) | value.isNull()
            else:
                beyond = value > mark
            after = after | (equal & beyond)
            equal = equal & value.eqNullSafe(mark)
        df = df.where(after)
    return df.orderBy(*page_order(order)).limit(size)


def listing(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of a listing with the number of all its rows in ``total``."""
    count = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return page(df, order, number, size).withColumn("total", count)


def latest_messages(headers: DataFrame, messages: DataFrame, dataset: str, stamp: str, conversation: str) -> DataFrame:
    """(dataset, message columns) of the newest conversation of every dataset; ties go to the larger conversation id."""
    newest = best_per_group(headers, dataset, [V.ref(stamp), V.ref(conversation)]).select(V.ref(dataset), V.ref(conversation))
    return newest.join(messages, conversation)


def sums(df: DataFrame, **measures: Column) -> DataFrame:
    """One row: the number of entries and the sum of each measure, 0 without entries."""
    return df.agg(F.count(F.lit(1)).alias("entries"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in measures.items()])


def recent(df: DataFrame, order: Sequence[Column], size: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(size)


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) for several tables."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.union, parts)


def requests_per(df: DataFrame, key: str) -> DataFrame:
    """(key, requests)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("requests"))


def requests_and_failures(df: DataFrame, key: str, failed: Column) -> DataFrame:
    """(key, requests, failures)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("requests"), F.count_if(failed).alias("failures"))


def overall_counts(df: DataFrame, user: str, failed: Column) -> DataFrame:
    """One row (requests, failures, users).

    Users are counted from one row per user, so the busiest user's rows merge inside each task.
    """
    per_user = df.groupBy(user).agg(F.count(F.lit(1)).alias("r"), F.count_if(failed).alias("f"))
    return per_user.agg(
        F.coalesce(F.sum("r"), F.lit(0)).alias("requests"),
        F.coalesce(F.sum("f"), F.lit(0)).alias("failures"),
        F.count(user).alias("users"),
    )


def search(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose column holds the text, in any case."""
    return df.where(F.ilike(V.ref(column), F.lit(f"%{text}%")))


def with_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.where(F.startswith(V.ref(column), F.lit(prefix)))


def usage(df: DataFrame, user: str, stamp: str, unit: str, limit: int, counted: Column | None = None) -> DataFrame:
    """(user, period, requests, over_limit) per day or month; ``counted`` leaves out cache hits."""
    rows = df if counted is None else df.where(counted)
    period = F.trunc(V.timestamp(df, stamp).cast("date"), unit) if unit != "day" else V.timestamp(df, stamp).cast("date")
    return (
        rows.groupBy(V.ref(user).alias("user"), period.alias("period"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .withColumn("over_limit", F.col("requests") >= limit)
    )
