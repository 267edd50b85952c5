"""Calendar periods: the label of a timestamp's period, the list of all labels, and future labels.

Labels follow the right-closed convention: a week is named by its Sunday, a month, quarter or year
by its last day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Short names accepted in plans, and the season length and display name per frequency.
FREQUENCIES = {"D": "D", "W": "W", "M": "ME", "Y": "YE"}
SEASON_LENGTH = {"D": 7, "W": 52, "ME": 12, "QE": 4, "YE": None}
FREQUENCY_LABELS = {"D": "Daily", "W": "Weekly", "ME": "Monthly", "QE": "Quarterly", "YE": "Yearly"}

# Months between two labels of the month-based frequencies.
_MONTHS = {"ME": 1, "QE": 3, "YE": 12}


def label(stamp: Column, freq: str) -> Column:
    """The date naming the period that holds ``stamp``."""
    day = stamp.cast("date")
    if freq == "D":
        return day
    if freq == "W":
        return F.next_day(F.date_sub(day, 1), "SUN")
    if freq == "ME":
        return F.last_day(day)
    if freq == "QE":
        return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    return F.last_day(F.add_months(F.trunc(day, "year"), 11))


def ahead(last: Column, steps: Column, freq: str) -> Column:
    """The label ``steps`` periods after the label ``last``."""
    if freq == "D":
        return F.date_add(last, steps)
    if freq == "W":
        return F.date_add(last, steps * 7)
    return F.last_day(F.add_months(last, steps * _MONTHS[freq]))


def spine(bounds: DataFrame, first: str, last: str, freq: str, out: str) -> DataFrame:
    """Every label from ``first`` to ``last`` (themselves labels), per row of ``bounds``."""
    keep = [c for c in bounds.columns if c not in (first, last)]
    if freq in ("D", "W"):
        step = F.expr("interval 1 day" if freq == "D" else "interval 7 days")
        return bounds.select(*keep, F.explode(F.sequence(F.col(first), F.col(last), step)).alias(out))
    step = F.expr(f"interval {_MONTHS[freq]} month")
    months = F.sequence(F.trunc(F.col(first), "month"), F.trunc(F.col(last), "month"), step)
    return bounds.select(*keep, F.explode(months).alias(out)).withColumn(out, F.last_day(out))
