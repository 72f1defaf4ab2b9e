"""The promotion-effect query, in steps: scan and project, reduce by part, and the final share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.functions.predicates import contains, in_range, modular_32
from basalt.plans.scan import ScanQuery

FROM, TO = "1995-09-01", "1995-10-01"


def revenue(lineitem: DataFrame, low: str = FROM, high: str = TO) -> ScanQuery:
    """price * (1 - discount) by part over a range of ship dates."""
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    return ScanQuery(lineitem, F.col("l_partkey"), F.col("l_extendedprice") * (1 - F.col("l_discount")), in_range(F.col("l_shipdate"), day(low), day(high)))


def fixed_point(lineitem: DataFrame, low: str = FROM, high: str = TO) -> ScanQuery:
    """The same in unsigned 32-bit arithmetic on cents and percent, where 1 - discount wraps."""
    price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    rest = modular_32(1 - F.round(F.col("l_discount") * 100).cast("bigint"))
    base = revenue(lineitem, low, high)
    return ScanQuery(base.table, base.key, modular_32(price * rest), base.predicate)


def promo_share(lineitem: DataFrame, part: DataFrame, low: str = FROM, high: str = TO) -> DataFrame:
    """One row: percent of the revenue that promotion parts make."""
    by_part = revenue(lineitem, low, high).reduce("add")
    joined = by_part.join(part.select(F.col("p_partkey").alias("key"), "p_type"), "key")
    promo = F.sum(F.when(contains(F.col("p_type"), "PROMO"), F.col("value")).otherwise(0.0))
    return joined.agg((100 * promo / F.sum("value")).alias("promo_revenue"))
