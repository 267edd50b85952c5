"""Writing report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def report_to_csv(report: DataFrame, path: str) -> None:
    """(Section, Metric, Value) rows with a header, in order over as many files as the sort needs: one for a small report."""
    rows = report.orderBy("ord", "section").select(
        F.col("section").alias("Section"), F.col("metric").alias("Metric"), F.col("value").alias("Value")
    )
    rows.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def report_to_json(report: DataFrame, path: str) -> None:
    """JSON lines {section, metric, value} in the order of the report; no section is gathered, whatever its number of entries."""
    report.orderBy("ord", "section").select("section", "metric", "value").write.mode("errorifexists").json(path)
