"""Typed encoding of text fields.

Type codes: 1, 4 and 8 are signed integers of so many bytes, D a date, V a string. What doesn't parse, or doesn't fit, is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = {"1": "tinyint", "4": "int", "8": "bigint", "D": "date", "V": "string"}


def encode(text: Column, code: str) -> Column:
    """A text field as a value of the type; 8-byte integers may also be hexadecimal (0x..) or octal (0..)."""
    if code not in TYPES:
        raise ValueError(f"unknown type {code!r}; one of {', '.join(TYPES)}")
    if code == "V":
        return text
    field = F.trim(text)
    if code == "D":
        return F.try_to_date(field, "yyyy-MM-dd") if hasattr(F, "try_to_date") else field.try_cast("date")
    if code == "8":
        negative = field.startswith("-")
        bare = F.regexp_replace(field, "^[+-]", "")
        magnitude = F.when(bare.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(bare, 3, 15), 16, 10)).when(bare.rlike("^0[0-7]{1,20}$"), F.conv(bare, 8, 10)).otherwise(bare)
        return F.when(bare.rlike("^0"), F.when(negative, -magnitude.try_cast("bigint")).otherwise(magnitude.try_cast("bigint"))).otherwise(field.try_cast("bigint"))
    return field.try_cast(TYPES[code])


def rejected(text: Column, code: str) -> Column:
    """Whether a field that is there could not be encoded."""
    return text.isNotNull() & encode(text, code).isNull()
