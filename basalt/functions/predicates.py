"""Threshold, range and substring predicates, and their boolean combination.

All are plain Column expressions: comparisons, ranges and literal substrings reach the Parquet scan as pushed filters."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

NEGATE_LEFT, NEGATE_RIGHT, BOTH = 0b001, 0b010, 0b100
WILDCARD = "\0"


def at_least(value: Column, threshold: Any) -> Column:
    """value >= threshold; its negation is value < threshold."""
    return value >= F.lit(threshold)


def combine(left: Column, right: Column, word: int = 0) -> Column:
    """Two predicates under a configuration word: NEGATE_LEFT, NEGATE_RIGHT, and BOTH for AND instead of OR."""
    a = ~left if word & NEGATE_LEFT else left
    b = ~right if word & NEGATE_RIGHT else right
    return a & b if word & BOTH else a | b


def thresholds(value: Column, low: Any, high: Any, word: int) -> Column:
    """Two thresholds on one column, combined."""
    return combine(at_least(value, low), at_least(value, high), word)


def in_range(value: Column, low: Any, high: Any) -> Column:
    """low <= value < high."""
    return thresholds(value, low, high, BOTH | NEGATE_RIGHT)


def outside(value: Column, low: Any, high: Any) -> Column:
    """value < low or value >= high."""
    return thresholds(value, low, high, NEGATE_LEFT)


def contains(text: Column, pattern: str, *, exact_bytes: bool = False) -> Column:
    """Whether pattern occurs in text; WILDCARD in it stands for any one character, or any one byte with exact_bytes.

    Trailing wildcards only pad and are dropped. Without inner wildcards this is a pushable substring test."""
    pattern = pattern.rstrip(WILDCARD)
    if WILDCARD not in pattern:
        return text.contains(pattern)
    if exact_bytes:
        raw = pattern.encode().decode("latin-1")
        rule = "(?s)" + "".join("." if c == WILDCARD else re.escape(c) for c in raw)
        return F.decode(F.encode(text, "utf-8"), "iso-8859-1").rlike(rule)
    rule = "".join("_" if c == WILDCARD else "\\" + c if c in "%_\\" else c for c in pattern)
    return text.like(f"%{rule}%")


def contains_pair(text: Column, first: str, second: str, word: int = BOTH, *, exact_bytes: bool = False) -> Column:
    """Two substring tests on one text, combined; nothing is said about their order."""
    return combine(contains(text, first, exact_bytes=exact_bytes), contains(text, second, exact_bytes=exact_bytes), word)


def modular_32(value: Column) -> Column:
    """The low 32 bits of a long, as an unsigned number."""
    return value.bitwiseAND(F.lit(0xFFFFFFFF))
