"""Plain data that is sent to the tasks once, and what each worker process makes of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession


def send(spark: SparkSession, make: Callable, **plain) -> Callable[[], object]:
    """A function for tasks that gives ``make(**plain)``, made once in each worker process.

    Only the arguments are broadcast: built-in types and arrays, which workers read without this package; ``make`` travels with the
    task's code. A broadcast value is unpacked once in each worker and keeps what is made of it.
    """
    sent = spark.sparkContext.broadcast({"plain": plain})

    def made():
        state = sent.value
        if "made" not in state:
            state["made"] = make(**state["plain"])
        return state["made"]

    return made
