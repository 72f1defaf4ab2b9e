"""Named reducers: aggregate Columns for the values of one key.

All are associative and commutative, so Spark reduces partly before the shuffle. first and last need an order column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REDUCERS: dict[str, Callable[[Column, Column | None], Column]] = {
    "add": lambda v, o: F.sum(v),
    "multiply": lambda v, o: F.product(v),
    "min": lambda v, o: F.min(v),
    "max": lambda v, o: F.max(v),
    "first": lambda v, o: F.min_by(v, o),
    "last": lambda v, o: F.max_by(v, o),
    "count": lambda v, o: F.count(v),
}
ORDERED = {"first", "last"}


def reducer(name: str, value: Column, order: Column | None = None) -> Column:
    """The aggregate of a registered reducer."""
    if name not in REDUCERS:
        raise ValueError(f"unknown reducer {name!r}; one of {', '.join(REDUCERS)}")
    if name in ORDERED and order is None:
        raise ValueError(f"{name} needs an order column")
    return REDUCERS[name](value, order)


def register(name: str, make: Callable[[Column, Column | None], Column]) -> None:
    """Add a reducer, for instance a grouped-aggregate pandas UDF."""
    REDUCERS[name] = make
