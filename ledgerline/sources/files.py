"""Delimited text: reading with missing tokens and inferred types; checks over landing folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerline.errors import IngestError
from ledgerline.functions import values as V
from ledgerline.operators.quality import missing_cells
from ledgerline.operators.roles import inline_agg
from ledgerline.sources.heads import FileHeads

PREVIEW_ROWS = 15
STALE_HOURS = 24
# With so many broken files the folder is read whole, instead of by two lists of names.
MANY_FILES = 10_000

# Accepted extensions and the first bytes of the binary kinds.
EXTENSIONS = ("csv", "xlsx", "xls")
SIGNATURES = {"xlsx": "504B0304", "xls": "D0CF11E0A1B11AE1"}

# Texts read as truth values.
TRUE_TEXTS = ["True", "TRUE", "true"]
FALSE_TEXTS = ["False", "FALSE", "false"]


def files_with_breaks(spark: SparkSession, path: str) -> DataFrame:
    """(file): the files in which a quoted field holds a line break: a physical line there has an odd number of quotes.

    One cheap pass over splits.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.where(quotes % 2 == 1).select("file").distinct()


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether any quoted field of any file holds a line break."""
    return not files_with_breaks(spark, path).isEmpty()


def read_text_table(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """A delimited file or folder with a header, every column as text, missing tokens as null.

    Files in which a quoted field holds a line break are read whole, one by one; the others are read in splits, whatever else is in
    the folder. ``multiline`` states for all files which of both they are.
    """

    def read(paths, whole: bool) -> DataFrame:
        return spark.read.option("header", True).option("multiLine", whole).option("escape", '"').option("inferSchema", False).csv(paths)

    if multiline is None:
        # The names of these files reach the driver, as a reader's list of paths has to.
        broken = {r["file"] for r in files_with_breaks(spark, path).collect()}
        if broken:
            every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_path").alias("file"))
            sound = sorted(r["file"] for r in every.where(~F.col("file").isin(sorted(broken))).collect()) if len(broken) < MANY_FILES else None
            if sound:
                raw = read(sound, False).unionByName(read(sorted(broken), True), allowMissingColumns=True)
            else:
                raw = read(path, True)
        else:
            raw = read(path, False)
    else:
        raw = read(path, multiline)
    if not raw.columns:
        raise IngestError("there is no column to read")
    return with_missing(raw)


def with_missing(df: DataFrame) -> DataFrame:
    """Missing tokens of text columns become null."""
    return df.select(
        *[F.when(~V.ref(f.name).isin(V.MISSING_TOKENS), V.ref(f.name)).alias(f.name) if V.is_text(f.dataType) else V.ref(f.name) for f in df.schema.fields]
    )


def infer_types(df: DataFrame) -> dict[str, T.DataType]:
    """The narrowest of long, double, boolean and string that every present value fits; one pass for all columns.

    Dates stay text and are recognised by role.
    """
    names = [f.name for f in df.schema.fields if V.is_text(f.dataType)]
    if not names:
        return {}
    rows = []
    for c in names:
        text = F.trim(V.ref(c))
        whole = text.rlike(r"^[+-]?\d+$") & text.try_cast("long").isNotNull()
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(V.ref(c)).alias("known"),
                F.count_if(whole).alias("longs"),
                F.count(V.parse_number(V.ref(c))).alias("doubles"),
                F.count_if(V.ref(c).isin(TRUE_TEXTS + FALSE_TEXTS)).alias("booleans"),
            )
        )
    found: dict[str, T.DataType] = {}
    # One row per column.
    for r in inline_agg(df, rows).collect():
        if r["known"] == 0 or r["known"] == r["doubles"] != r["longs"]:
            found[r["column"]] = T.DoubleType()
        elif r["known"] == r["longs"]:
            found[r["column"]] = T.LongType()
        elif r["known"] == r["booleans"]:
            found[r["column"]] = T.BooleanType()
        else:
            found[r["column"]] = T.StringType()
    return found


def apply_types(df: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    """Text columns read as the given types."""

    def typed(name: str) -> Column:
        kind = types.get(name)
        if isinstance(kind, T.LongType):
            return F.trim(V.ref(name)).try_cast("long").alias(name)
        if isinstance(kind, T.DoubleType):
            return V.parse_number(V.ref(name)).alias(name)
        if isinstance(kind, T.BooleanType):
            return F.when(V.ref(name).isNotNull(), V.ref(name).isin(TRUE_TEXTS)).alias(name)
        return V.ref(name)

    return df.select(*[typed(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """A delimited file or folder as a typed table."""
    text = read_text_table(spark, path, multiline)
    return apply_types(text, infer_types(text))


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """(record): the first rows as JSON texts, dates in ISO form."""
    if not df.columns:
        raise IngestError("there is no column to show")
    cells = [
        V.iso(V.timestamp(df, f.name)).alias(f.name) if V.is_temporal(f.dataType) else V.ref(f.name)
        for f in df.schema.fields
    ]
    return df.limit(n).select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("record"))


def quick_profile(df: DataFrame) -> DataFrame:
    """One row (row_count, column_count, missing_values_count, duplicate_rows_count, duplicate_detection_skipped).

    One partially aggregated pass, without a search for duplicates.
    """
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("long").alias("column_count"),
        missing_cells(df).alias("missing_values_count"),
    ).select("*", F.lit(None).cast("long").alias("duplicate_rows_count"), F.lit(True).alias("duplicate_detection_skipped"))


def profile_file(spark: SparkSession, path: str, exact_duplicates: bool = True) -> DataFrame:
    """One row (row_count, column_count, missing_values_count, duplicate_rows_count, duplicate_detection_skipped) of a file.

    The search for duplicates, which shuffles the rows' hashes, is the caller's choice and not one of size.
    """
    from ledgerline.operators.quality import duplicates

    df = read_csv(spark, path)
    quick = quick_profile(df)
    if not exact_duplicates:
        return quick
    return quick.withColumn("duplicate_rows_count", duplicates(df).scalar()).withColumn("duplicate_detection_skipped", F.lit(False))


def list_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(path, modificationTime, length, head, blank) of every file below a folder, of any size; see ``FileHeads``."""
    spark.dataSource.register(FileHeads)
    reader = spark.read.format(FileHeads.name())
    if max_bytes is not None:
        reader = reader.option("maxBytes", str(max_bytes))
    return reader.load(path)


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """One row (bytes): stored size of a file or folder, from the listing alone."""
    return list_files(spark, path, -1).agg(F.sum("length").alias("bytes"))


def admit(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(path, extension, accepted, reason) for every file of a landing folder, by name, size and first bytes.

    Any size is admitted unless ``max_bytes`` says otherwise. Of a file no more is read than its first bytes and the white space in
    front of the rest; of one that is too large, nothing.
    """
    extension = F.col("extension")
    begins = lambda kind: F.startswith(F.hex("head"), F.lit(SIGNATURES[kind]))
    reason = F.when(F.col("length") > max_bytes, "larger than the limit") if max_bytes is not None else F.when(F.lit(False), "")
    reason = (
        reason.when(~extension.isin(*EXTENSIONS), F.concat(F.lit("no reader for ."), extension))
        .when(F.col("blank"), "nothing in it")
        .when((extension == "xlsx") & ~begins("xlsx"), "named xlsx, but does not begin like one")
        .when((extension == "xls") & ~begins("xls"), "named xls, but does not begin like one")
        .when((extension == "csv") & F.hex("head").rlike("^(..)*00"), "named csv, but holds zero bytes")
    )
    files = list_files(spark, path, max_bytes).withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    return files.select("path", "extension", reason.isNull().alias("accepted"), reason.alias("reason"))


def stale_files(spark: SparkSession, path: str, hours: float = STALE_HOURS) -> DataFrame:
    """(owner, path, modificationTime) of files in per-owner folders older than the limit; nothing is deleted."""
    cutoff = F.current_timestamp() - F.make_dt_interval(secs=F.lit(hours * 3600))
    return (
        list_files(spark, path, -1)
        .where(F.col("modificationTime") < cutoff)
        .select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("owner"), "path", "modificationTime")
    )
