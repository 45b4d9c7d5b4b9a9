"""Patterns, number and date recognition on the text form of a value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Recognition patterns. Digits and spaces are ASCII on purpose, which is what both
# Java and RE2 mean by them.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^\+?1?[0-9]{9,15}$"
URL = (
    r"^https?://(?:[-\p{L}\p{N}_.])+(?:[:0-9]+)?"
    r"(?:/(?:[\p{L}\p{N}_/.])*(?:\?(?:[\p{L}\p{N}_&=%.])*)?(?:#(?:[\p{L}\p{N}_.])*)?)?$"
)
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T\s][0-9]{2}:[0-9]{2}:[0-9]{2}"
CURRENCY = r"^[$€£¥]?\s*[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?$"
PERCENTAGE = r"^[0-9]+(?:\.[0-9]+)?%$"
BOOLEAN = r"(?i)^(true|false|yes|no|1|0|t|f|y|n)$"

PATTERNS = {
    "email": EMAIL,
    "phone": PHONE,
    "url": URL,
    "date": DATE,
    "datetime": DATETIME,
    "currency": CURRENCY,
    "percentage": PERCENTAGE,
    "boolean": BOOLEAN,
}

# The accepted date formats in order of preference, as
# (name, Spark pattern, shape the text must have).
_TIME = r" [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}"
DATE_FORMATS = (
    ("%Y-%m-%d", "y-M-d", r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"),
    ("%d/%m/%Y", "d/M/y", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"),
    ("%m/%d/%Y", "M/d/y", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"),
    ("%Y/%m/%d", "y/M/d", r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"),
    ("%d-%m-%Y", "d-M-y", r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"),
    ("%m-%d-%Y", "M-d-y", r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"),
    ("%Y-%m-%d %H:%M:%S", "y-M-d H:m:s", r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}" + _TIME + "$"),
    ("%d/%m/%Y %H:%M:%S", "d/M/y H:m:s", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}" + _TIME + "$"),
    ("%m/%d/%Y %H:%M:%S", "M/d/y H:m:s", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}" + _TIME + "$"),
)
#: Formats a column declared as a date may use.
COLUMN_DATE_FORMATS = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y")

#: A decimal number as text. Keeps Spark's cast from taking ``1d`` and the like for numbers.
NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
SPECIAL_NUMBER = r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$"


def as_text(c: Column, data_type: T.DataType) -> Column:
    """The text form of a value, doubles without an exponent up to 1e16.

    Spark writes 1.0E7 where the patterns above expect 10000000.0.
    """
    text = c.cast("string")
    if not isinstance(data_type, (T.FloatType, T.DoubleType)):
        return text
    x = F.abs(c.cast("double"))
    plain = text.try_cast("decimal(38,18)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", ".0")
    scientific = text.contains("E") & (x < 1e16) & (x >= 1e-4)
    return F.when(scientific, plain).otherwise(text)


def is_number(text: Column) -> Column:
    """Does the text read as a number once thousands separators, $ and % are gone?"""
    bare = F.translate(text, ",$%", "")
    return bare.rlike(NUMBER) | bare.rlike(SPECIAL_NUMBER)


def to_number(text: Column) -> Column:
    """The number a text spells, with thousands separators removed; NULL if none."""
    bare = F.translate(text, ",", "")
    return F.when(bare.rlike(NUMBER), F.trim(bare).try_cast("double"))


def plain_number(text: Column) -> Column:
    """The number a text spells as it stands; NULL if none."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def parses_as(text: Column, name: str) -> Column:
    """Is the text a valid date in the named format?"""
    pattern, shape = next((p, s) for n, p, s in DATE_FORMATS if n == name)
    return F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)).isNotNull()).otherwise(
        F.lit(False)
    )


#: What every accepted date looks like; spares other texts the attempts at parsing.
_DATE_LIKE = r"^[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}( [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2})?$"


def date_format_of(text: Column) -> Column:
    """Name of the first format that reads the text as a valid date; NULL if none does."""
    first = F.coalesce(*[F.when(parses_as(text, n), F.lit(n)) for n, _, _ in DATE_FORMATS])
    return F.when(text.rlike(_DATE_LIKE), first)


def is_date(text: Column) -> Column:
    """Is the text a valid date in any accepted format?"""
    return date_format_of(text).isNotNull()


def is_iso_date(text: Column) -> Column:
    return parses_as(text, "%Y-%m-%d")
