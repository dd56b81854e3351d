"""Versions and templates compared: what one has and the other has not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_words(pages: DataFrame) -> DataFrame:
    """(doc, page, word) of every word of every page, case kept, with its place."""
    parts = F.filter(F.split("text", "[ \n\t]"), lambda x: x != "")
    return pages.select("doc", "page", F.posexplode(parts).alias("pos", "word"))


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc, page, line) of every line that isn't blank, trimmed."""
    parts = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return pages.select("doc", "page", F.posexplode(parts).alias("pos", "line"))


def added(old: DataFrame, new: DataFrame, value: str, on: Sequence[str] = ("page",)) -> DataFrame:
    """Rows of `new` whose value, whatever its case, `old` has not on the same page: one anti-join."""
    key = F.lower(F.col(value)).alias("_v")
    return new.withColumn("_v", F.lower(F.col(value))).join(old.select(*on, key).distinct(), [*on, "_v"], "left_anti").drop("_v")


def template_lines(lines: DataFrame, share: float = 0.9) -> DataFrame:
    """(line) of the lines that stand in at least `share` of the documents; the number of documents is one small row."""
    n = lines.agg(F.count_distinct("doc").alias("_n"))
    counted = lines.select("doc", "line").distinct().groupBy("line").agg(F.count("*").alias("docs"))
    return counted.crossJoin(F.broadcast(n)).where(F.col("docs") >= F.col("_n") * share).select("line", "docs")


def variants(lines: DataFrame, template: DataFrame) -> DataFrame:
    """Lines that aren't in the template."""
    return lines.join(template.select("line"), "line", "left_anti")


def verdict(old_date, new_date):
    """Which of two versions is later, by their dates."""
    return F.when(old_date.isNull() | new_date.isNull(), "unknown").when(new_date > old_date, "later").when(new_date < old_date, "earlier").otherwise("same")
