"""Exact quantiles without holding a group's values in one buffer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantiles(df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """`by` and a column for each wanted quantile, interpolated between the two values it falls between.

    Equal values are counted first, map-side; a running sum over the different values, a
    sort that spills, then finds the two ranks of each quantile. Null values don't count.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    up = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.select(*by, "_v", F.sum("_c").over(up).alias("_to"), F.sum("_c").over(Window.partitionBy(*by)).alias("_all"))
    ends = []
    for i, q in enumerate(wanted.values()):
        at = (F.col("_all") - 1) * q
        ends += [F.min(F.when(F.col("_to") > F.floor(at), F.col("_v"))).alias(f"_a{i}"), F.min(F.when(F.col("_to") > F.ceil(at), F.col("_v"))).alias(f"_b{i}")]
    got = ranked.groupBy(*by).agg(F.first("_all").alias("_all"), *ends)

    def between(i: int, q: float):
        at = (F.col("_all") - 1) * q
        return F.col(f"_a{i}") + (at - F.floor(at)) * (F.col(f"_b{i}") - F.col(f"_a{i}"))

    return got.select(*by, *[between(i, q).alias(name) for i, (name, q) in enumerate(wanted.items())])
