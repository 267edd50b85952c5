"""Session settings and the shared folder for tables between steps."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.errors import AnalyticsError


def build_session(app: str = "ledgerline", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """A session with the settings the operators count on; a cluster's own settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Folders made for sessions in one process, by application.
_LOCAL: dict[str, str] = {}


def _shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise AnalyticsError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # Driver and executors of a local session are one process, so a folder of its own is shared by all of them.
        app = spark.sparkContext.applicationId
        configured = _LOCAL[app] = _LOCAL.get(app) or tempfile.mkdtemp(prefix="ledgerline-")
    return configured


# Folders that this process has written below, by application.
_OWNED: dict[str, tuple[SparkSession, str]] = {}


def _root(spark: SparkSession) -> str:
    """The application's own folder below the shared one; what is written there goes when the process ends."""
    app = spark.sparkContext.applicationId
    root = f"{_shared_dir(spark).rstrip('/')}/ledgerline/{app}"
    if _OWNED.setdefault(app, (spark, root))[1] != root:
        _OWNED[f"{app} {root}"] = (spark, root)
    return root


def release(spark: SparkSession | None = None) -> None:
    """Removes every table that ``settle`` and ``scratch_path`` have placed for the session (default: all sessions).

    Results that still read from them must have been written or collected before.
    """
    for name, (owner, root) in list(_OWNED.items()):
        if spark is not None and owner.sparkContext.applicationId != spark.sparkContext.applicationId:
            continue
        _OWNED.pop(name)
        try:
            place = owner._jvm.org.apache.hadoop.fs.Path(root)
            place.getFileSystem(owner._jsc.hadoopConfiguration()).delete(place, True)
        except Exception as gone:  # the session may have ended before: nothing can be reached through it
            print(f"ledgerline: {root} was not removed ({type(gone).__name__})")


atexit.register(release)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the cluster's shared checkpoint folder."""
    return f"{_root(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to shared storage and read it back.

    Used where several later steps read a costly result; a lost executor then re-reads files.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session has one such setting; it is as before after the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def spent_shuffles_removed(spark: SparkSession) -> AbstractContextManager[None]:
    """What a query in this block shuffles leaves the executors' disks when the query ends.

    Otherwise it goes when the driver's memory happens to be cleaned, and the shuffles of many steps lie side by side until then. For
    steps that write a table and read that from then on; a query that is run again shuffles again.
    """
    return _setting(spark, SHUFFLE_CLEANUP, "true")


def small_batches(spark: SparkSession, size: int) -> AbstractContextManager[None]:
    """Queries in this block give Python batches of about ``size`` bytes: each lies in an executor's memory and in a worker's."""
    return _setting(spark, BATCH_BYTES, str(size))


def attach(df: DataFrame, other: DataFrame, keys: list[str], small: bool = False, how: str = "inner") -> DataFrame:
    """Columns of ``other`` beside the rows of ``df``: by key, or from its only row if there are no keys.

    ``small`` states that ``other`` is bounded by the schema, the class list or the calendar, so that it
    may be broadcast. The only row of a keyless table travels as a scalar subquery.
    """
    if keys:
        return df.join(F.broadcast(other) if small else other, keys, how)
    row = other.select(F.struct(*other.columns).alias("__row")).scalar()
    return df.withColumn("__row", row).select(*df.columns, "__row.*")
