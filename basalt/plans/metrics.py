"""Statistics of a pipeline, gathered while it runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, name: str, **more: Column) -> tuple[DataFrame, Observation]:
    """df, and an observation with n_rows and more aggregates; read its .get after an action."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("n_rows"), *(c.alias(k) for k, c in more.items())), seen


def seen_count(seen: Observation, name: str = "n") -> int:
    """An observed count once an action has run; 0 where adaptive planning found no rows and left the observed part out."""
    return seen.get[name] if seen._jo.getRow().size() else 0
