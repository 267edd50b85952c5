"""Usage metering over an append-only request log, as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.runtime import scratch_path


def read_log(spark: SparkSession, folder: str, file_name: str, max_files: int | None = None) -> DataFrame:
    """A stream over the log files of a folder; the schema is taken from the files already there."""
    schema = spark.read.parquet(f"{folder}/{file_name}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_name)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


# What becomes of a row: counted for its day, too late for it, or without a readable time.
COUNTED, LATE, UNDATED = "counted", "late", "undated"


def meter(
    stream: DataFrame, table: str, checkpoint: str, user: str, stamp: str, counted: Column | None = None, delay: str = "1 day"
):
    """Run the available input once; each batch's rows per (user, period, fate) land under its batch number.

    A day is closed once rows have been seen that are ``delay`` past its end; what comes for it after that is late. The mark that
    decides this is the newest time of all batches before, read from what they wrote, so every row of a batch is judged alike, a
    repeated batch overwrites its own folder, and a restart counts nothing twice. No row is dropped without a count, and
    no state is held between batches.
    """
    rows = stream if counted is None else stream.where(counted)
    # Event time needs a zoned type; the session zone is UTC.
    rows = rows.select(F.col(user).alias("user"), F.col(stamp).cast("timestamp").alias("ts"))

    def keep(batch: DataFrame, number: int) -> None:
        day = F.date_trunc("day", "ts")
        fate = F.when(F.col("ts").isNull(), UNDATED)
        if number:
            before = batch.sparkSession.read.parquet(table).where(F.col("batch") < number)
            mark = before.agg(F.max("latest") - F.expr(f"INTERVAL {delay}")).scalar()
            fate = fate.when(day + F.expr("INTERVAL 1 day") <= mark, LATE)
        found = batch.withColumn("fate", fate.otherwise(COUNTED)).withColumn("period", day.cast("date"))
        sums = found.groupBy("user", "period", "fate").agg(F.count(F.lit(1)).alias("requests"), F.max("ts").alias("latest"))
        sums.write.mode("overwrite").parquet(f"{table}/batch={number}")

    query = rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def metered_counts(spark: SparkSession, table: str, limit: int) -> DataFrame:
    """(user, period, requests, over_limit): the requests counted for every user and day."""
    rows = spark.read.parquet(table).where(F.col("fate") == COUNTED)
    return rows.groupBy("user", "period").agg(F.sum("requests").alias("requests")).withColumn("over_limit", F.col("requests") >= limit)


def fates(spark: SparkSession, table: str) -> DataFrame:
    """One row (rows_read, counted, late, undated): what a total of the metered counts leaves out."""
    of = lambda fate: F.coalesce(F.sum(F.when(F.col("fate") == fate, F.col("requests"))), F.lit(0))
    return spark.read.parquet(table).agg(
        F.coalesce(F.sum("requests"), F.lit(0)).alias("rows_read"), *[of(f).alias(f) for f in (COUNTED, LATE, UNDATED)]
    )


def late_rows(spark: SparkSession, table: str) -> DataFrame:
    """(user, period, requests, batch): rows that came for a closed day, by the batch that brought them."""
    rows = spark.read.parquet(table).where(F.col("fate") == LATE)
    return rows.select("user", "period", "requests", F.col("batch").cast("long").alias("batch"))


def usage_stream(spark: SparkSession, folder: str, file_name: str, user: str, stamp: str, limit: int) -> DataFrame:
    """The whole job over a folder of log files."""
    out = scratch_path(spark, "usage")
    meter(read_log(spark, folder, file_name), f"{out}/counts", f"{out}/checkpoint", user, stamp)
    return metered_counts(spark, f"{out}/counts", limit)
