"""Joins by priority, by nearest value, by rectangle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folhario.runtime import bounded_rows, broadcast_if_small


def prioritised(rows: DataFrame, catalogue: DataFrame, keys: list[tuple[str, float]], value: str, order: str, small: int = 1_000_000) -> DataFrame:
    """`rows` with the catalogue's `value` found by the first key that hits, and that key's confidence.

    Of several catalogue rows with a key the first by `order` counts, so no join
    multiplies rows. Null keys never hit.
    """
    out = rows
    for i, (key, _) in enumerate(keys):
        one = catalogue.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_k{i}")).agg(F.min_by(value, order).alias(f"_v{i}"))
        out = out.join(broadcast_if_small(one, small), out[key] == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    confidence = F.when(F.col("_v0").isNotNull(), keys[0][1])
    for i, (_, c) in enumerate(keys[1:], 1):
        confidence = confidence.when(F.col(f"_v{i}").isNotNull(), c)
    return out.withColumn(value, F.coalesce(*[f"_v{i}" for i in range(len(keys))])).withColumn("confidence", confidence).drop(*[f"_v{i}" for i in range(len(keys))])


def nearest(rows: DataFrame, table: DataFrame, group: str, amount: str, value: str, order: str, tolerance: float) -> DataFrame:
    """`rows` with the entry of their group whose `value` is nearest to `amount`, within a relative tolerance.

    Values are put in buckets whose width is the tolerance on a logarithmic scale, so an
    entry within reach lies in the amount's bucket or beside it: entries stand in three
    buckets, amounts in one. In a bucket both are put in one order, and the nearest entry
    is the last one before or the first one after. No row meets all entries, a hot group
    is spread over its buckets, and repeated amounts are joined once.

    Ties go to the smallest `order`; an amount of 0 or null matches nothing.
    """
    wide = -math.log(1 - tolerance) if 0 < tolerance < 1 else None

    def bucket(c: Column) -> Column:
        return F.when(c != 0, F.signum(c) * (F.floor(F.log(F.abs(c)) / wide) + 10_000)).cast("bigint") if wide else F.lit(0).cast("bigint")

    best = table.where(F.col(value).isNotNull()).groupBy(F.col(group), F.col(value).alias("_x")).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(order)).alias("o"))).alias("_e"))
    around = F.explode(F.array(*[bucket(F.col("_x")) + d for d in ((-1, 0, 1) if wide else (0,))]))
    entries = best.withColumn("_b", around).withColumn("_row", F.lit(False))
    asked = rows.select(group, amount).where(F.col(amount) != 0).distinct()
    both = asked.withColumn("_x", F.col(amount)).withColumn("_b", bucket(F.col(amount))).withColumn("_row", F.lit(True)).unionByName(entries, allowMissingColumns=True)
    up = Window.partitionBy(group, "_b").orderBy("_x", "_row").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(group, "_b").orderBy(F.desc("_x"), "_row").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_low", F.last("_e", ignorenulls=True).over(up)).withColumn("_high", F.last("_e", ignorenulls=True).over(down)).where("_row")
    off = lambda e: F.abs(F.col(f"{e}.v") - F.col(amount))
    take_low = F.col("_high").isNull() | (off("_low") < off("_high")) | ((off("_low") == off("_high")) & (F.col("_low.o") >= F.col("_high.o")))
    picked = met.withColumn("_p", F.when(F.col("_low").isNotNull() & take_low, F.col("_low")).otherwise(F.col("_high")))
    fits = F.coalesce(F.abs(F.col("_p.v") - F.col(amount)) / F.abs(F.col(amount)) <= tolerance, F.lit(False))
    found = picked.select(group, amount, F.when(fits, F.col("_p.v")).alias("matched_value"), F.when(fits, -F.col("_p.o")).alias("matched"))
    return rows.join(found, [group, amount], "left")


def in_rectangles(words: DataFrame, rectangles: DataFrame, mode: str = "overlap", small: int = 100_000, every: int = 1000) -> DataFrame:
    """Words that overlap a template rectangle, or whose centre lies in it; `page` null in a rectangle means every page.

    Rectangles of a page are joined on it. Those of every page are compared with every
    word; they are a handful a template, at most `every`, and more is an error.
    """
    t = F.col("tolerance")
    if mode == "center":
        x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
        hit = x.between(F.col("rx0") - t, F.col("rx1") + t) & y.between(F.col("ry0") - t, F.col("ry1") + t)
    else:
        hit = (F.col("x0") <= F.col("rx1") + t) & (F.col("x1") >= F.col("rx0") - t) & (F.col("y0") <= F.col("ry1") + t) & (F.col("y1") >= F.col("ry0") - t)
    free = bounded_rows(rectangles.where("page is null"), every)
    loose = rectangles.sparkSession.createDataFrame(free, rectangles.schema).drop("page")
    paged = words.join(broadcast_if_small(rectangles.where("page is not null"), small), "page").where(hit)
    return paged.unionByName(words.join(F.broadcast(loose), hit))


def line_groups(words: DataFrame, tolerance: float) -> DataFrame:
    """Words of (doc, page) with the number of their line: a new one where y leaves the word before by more than `tolerance`."""
    w = Window.partitionBy("doc", "page").orderBy(F.desc("y0"), "x0", "ord")
    new = F.when(F.abs(F.col("y0") - F.lag("y0").over(w)) > tolerance, 1).otherwise(0)
    return words.withColumn("_new", new).withColumn("line", F.sum("_new").over(w)).drop("_new")


def first_of(df: DataFrame, key: list[Column], order: Column) -> DataFrame:
    """The first row of each key by `order`."""
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
