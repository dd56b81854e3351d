"""Flat tables nested again, trees pruned, records by key: the ways back from rows to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nest(parents: DataFrame, children: DataFrame, on: str, name: str, order: str) -> DataFrame:
    """`parents` with their children as an array of structs in order; an empty array without any.

    A parent's children come together in one row, as in the document they came from.
    """
    cols = [c for c in children.columns if c != on]
    listed = children.groupBy(on).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in cols if c != order]))).alias(name))
    joined = parents.join(listed, on, "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(joined.schema[name].dataType)))


def envelope(rows: DataFrame, by: str, name: str, order: str) -> DataFrame:
    """(by, body): one JSON object a document, with how many rows were found and the rows."""
    cols = [c for c in rows.columns if c != by]
    listed = rows.groupBy(by).agg(F.count("*").alias("found"), F.sort_array(F.collect_list(F.struct(order, *[c for c in cols if c != order]))).alias(name))
    return listed.select(by, F.to_json(F.struct("found", name)).alias("body"))


def prune(nodes: DataFrame, keep: Column) -> DataFrame:
    """Nodes (key, node_id) that pass and all of whose ancestors pass; positions joined by dots name the ancestors.

    One row a node and ancestor, so a deep tree costs its depth and not a round of joins a level.
    """
    judged = nodes.withColumn("_ok", F.coalesce(keep, F.lit(False)))
    parts = F.split("node_id", r"\.")
    up = judged.select("key", "node_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("_a"))
    seen = judged.select("key", F.col("node_id").alias("_a"), "_ok")
    whole = up.join(seen, ["key", "_a"], "left").groupBy("key", "node_id").agg(F.bool_and(F.coalesce("_ok", F.lit(True))).alias("_all")).where("_all")
    return nodes.join(whole.select("key", "node_id"), ["key", "node_id"], "left_semi")


def top_values(rows: DataFrame, key: list[str], value: str, weight: str, source: str, most: int) -> DataFrame:
    """The `most` best different values of each key, by weight and then source."""
    best = rows.groupBy(*key, value).agg(F.max(F.struct(weight, source)).alias("_b"))
    w = Window.partitionBy(*key).orderBy(F.desc(f"_b.{weight}"), F.desc(f"_b.{source}"), value)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(*key, value, F.col(f"_b.{weight}").alias(weight), "rank")


def word_gaps(words: DataFrame, share: float = 0.9, factor: float = 0.3, cap: float = 10.0) -> DataFrame:
    """(doc, page, line, gap): the blank that parts words on a line: a high quantile of the positive gaps, scaled, capped."""
    w = Window.partitionBy("doc", "page", "line").orderBy("x0", "ord")
    gaps = words.withColumn("_g", F.col("x0") - F.lag("x1").over(w)).where("_g > 0")
    listed = gaps.groupBy("doc", "page", "line").agg(F.sort_array(F.collect_list("_g")).alias("_gs"))
    at = F.floor((F.size("_gs") - 1) * share).cast("int") + 1
    return listed.select("doc", "page", "line", F.least(F.element_at("_gs", at) * factor, F.lit(cap)).alias("gap"))


def line_texts(words: DataFrame) -> DataFrame:
    """(doc, page, line, text): the words of each line from left to right."""
    listed = F.sort_array(F.collect_list(F.struct("x0", "ord", "word")))
    return words.groupBy("doc", "page", "line").agg(F.array_join(F.transform(listed, lambda s: s["word"]), " ").alias("text"))


def windows_of(pages: DataFrame, sizes: tuple[int, ...] = (2, 3, 4), dense: int = 6) -> DataFrame:
    """(doc, start_page, end_page): candidate ranges from the densest pages of each document, different ones only."""
    w = Window.partitionBy("doc").orderBy(F.desc("words"), "page")
    last = pages.groupBy("doc").agg(F.max("page").alias("_last"))
    top = pages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= dense).join(last, "doc")
    spread = top.select("doc", "page", "_last", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("_s"))
    return spread.select("doc", F.col("page").alias("start_page"), F.least(F.col("page") + F.col("_s") - 1, F.col("_last")).alias("end_page")).distinct()
