"""String functions of the rule language as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def concat_strings(*parts: Column) -> Column:
    return F.concat(*parts)


def compare_strings(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by code point order."""
    return F.when(a < b, -1).when(a == b, 0).otherwise(1)


def replace_all(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def rest_after(text: Column, prefix: str) -> Column:
    """What follows a prefix; null if the text doesn't begin with it."""
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1 << 30))


def contains(text: Column, part: str) -> Column:
    return text.contains(part)


def ascii_upper(text: Column) -> Column:
    return F.translate(text, LOWER, UPPER)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def is_capitalised(text: Column) -> Column:
    return text.rlike("^[A-Z]")


def member_ignoring_case(text: Column, values: list[str]) -> Column:
    return ascii_lower(text).isin([v.translate(str.maketrans(UPPER, LOWER)) for v in values])


def split_on(text: Column, delimiter: str) -> Column:
    """Pieces between delimiters, without empty ones."""
    quoted = "".join(f"\\x{{{ord(c):x}}}" for c in delimiter)
    return F.filter(F.split(text, quoted), lambda x: x != "")


def reverse_string(text: Column) -> Column:
    return F.reverse(text)


def case_id(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def six_digits(value: Column) -> Column:
    """A number as text with at most six significant digits and no trailing zeros."""
    text = F.format_string("%.6g", value.cast("double"))
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+(e.*)?$", "$1$2"), r"\.(e.*)?$", "$1")
