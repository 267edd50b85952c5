"""Typed views of raw columns: what counts as a number, a date, a missing value, a piece of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The texts a delimited file may use for "missing".
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Date spellings accepted everywhere a text column is read as a date, each with the shape
# a text must have before the costly parser is tried on it.
DATE_FORMATS = {
    "yyyy-M-d[['T'][ ]HH:mm[:ss[.SSSSSS]]]": r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$",
    "yyyy/M/d[ HH:mm[:ss]]": r"^\d{4}/\d{1,2}/\d{1,2}( \d{2}:\d{2}(:\d{2})?)?$",
    "M/d/yyyy[ HH:mm[:ss]]": r"^\d{1,2}/\d{1,2}/\d{4}( \d{2}:\d{2}(:\d{2})?)?$",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Z][a-z]{2} \d{4}$",
    "MMM d, yyyy": r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$",
    "MMMM d, yyyy": r"^[A-Z][a-z]{3,8} \d{1,2}, \d{4}$",
}

# Fixed value: plain decimal or scientific notation; keeps out Spark's own suffixes such as 1d.
NUMBER_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"

_FLOATING = (T.FloatType, T.DoubleType)
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers proper; booleans are categories."""
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, _DATES)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_scalar(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def ref(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, name: str) -> Column:
    """The raw column with NaN folded into null, so that one test finds every missing value."""
    if isinstance(type_of(df, name), _FLOATING):
        return F.when(~F.isnan(ref(name)), ref(name))
    return ref(name)


def parse_number(text: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def number(df: DataFrame, name: str) -> Column:
    """The column as a double, null where it holds no number."""
    dtype = type_of(df, name)
    if isinstance(dtype, T.DoubleType):
        return present(df, name)
    if is_numeric(dtype) or isinstance(dtype, T.BooleanType):
        return present(df, name).cast("double")
    if is_text(dtype):
        return parse_number(ref(name))
    return F.lit(None).cast("double")


def parse_timestamp(text: Column) -> Column:
    """Text to a zone-less timestamp by the first spelling whose shape it has."""
    trimmed = F.trim(text)
    out = None
    for spelling, shape in DATE_FORMATS.items():
        stamp = F.try_to_timestamp(trimmed, F.lit(spelling))
        out = F.when(trimmed.rlike(shape), stamp) if out is None else out.when(trimmed.rlike(shape), stamp)
    return out.cast("timestamp_ntz")


def timestamp(df: DataFrame, name: str) -> Column:
    """The column as a zone-less timestamp, null where it holds no date."""
    dtype = type_of(df, name)
    if is_temporal(dtype):
        return ref(name).cast("timestamp_ntz")
    if is_text(dtype):
        return parse_timestamp(ref(name))
    return F.lit(None).cast("timestamp_ntz")


def text(df: DataFrame, name: str) -> Column:
    """The value as text, null when missing."""
    if isinstance(type_of(df, name), T.BooleanType):
        return F.initcap(ref(name).cast("string"))
    return present(df, name).cast("string")


def iso(stamp: Column) -> Column:
    """A timestamp in ISO form; the fraction appears only when there is one."""
    plain = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(stamp, "SSSSSS")
    return F.when(micros == "000000", plain).otherwise(F.concat(plain, F.lit("."), micros))


def two_places(number: Column) -> Column:
    """A double as text with two decimals, rounded by its exact binary value, ties to even.

    Taking off the whole part first is exact and uncovers the digits that the short text form hides.
    """
    whole = F.floor(number)
    rest = F.bround((number - whole).cast("decimal(38,18)"), 2)
    exact = (whole.cast("decimal(36,2)") + rest).cast("decimal(38,2)").cast("string")
    return F.when(F.abs(number) < 1e15, exact).otherwise(F.format_string("%.2f", number))
