"""Idempotent storage: first wins, last wins, key kept, children replaced. All are joins or one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_if_absent(stored: DataFrame, new: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """`stored` and the rows of `new` whose key it lacks; of several new rows of a key the first by `order`."""
    return stored.unionByName(keep_first(new, key, order).join(stored, list(key), "left_anti"))


def upsert(stored: DataFrame, new: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """`new` over `stored`; of several new rows of a key the last by `order`."""
    last = keep_first(new, key, order.desc())
    return stored.join(last, list(key), "left_anti").unionByName(last)


def upsert_keeping(stored: DataFrame, new: DataFrame, key: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """As an upsert of distinct keys, but a null in one of the columns `keep` leaves the stored value."""
    old = stored.select(*key, *[F.col(c).alias(f"_old_{c}") for c in keep])
    merged = new.join(old, list(key), "left").select(*[F.coalesce(c, f"_old_{c}").alias(c) if c in keep else F.col(c) for c in new.columns])
    return stored.join(new, list(key), "left_anti").unionByName(merged)


def keep_first(df: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """One row a key, the first by `order`, which should be total."""
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents that `new` has, replaced by those in `new`."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def remove(stored: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    """`stored` without the keys in `gone`, to be written over the old table."""
    return stored.join(gone.select(*key).distinct(), list(key), "left_anti")


def write_format(df: DataFrame, path: str, kind: str, default: str = "json") -> str:
    """`df` written as json, csv, xml, md, txt, raw or parquet; an unknown kind is the default. Gives the kind used."""
    kinds = ("json", "csv", "xml", "md", "txt", "raw", "parquet")
    use = kind if kind in kinds else default
    if use == "json":
        df.write.mode("overwrite").json(path)
    elif use == "csv":
        df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path)
    elif use == "xml":
        df.write.mode("overwrite").format("xml").option("rowTag", "row").option("rootTag", "rows").save(path)
    elif use == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")) if use == "md" else F.concat_ws("\t", *cells)
        df.select(line.alias("value")).write.mode("overwrite").text(path)
    return use


def clean_json_text(c: Column) -> Column:
    """Text that a JSON store takes: without controls, their escapes, and lone surrogates' escapes."""
    t = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    t = F.regexp_replace(t, r"(?i)\\u00(?:0[0-8bcef]|1[0-9a-f])", "")
    return F.regexp_replace(t, r"(?i)\\ud[89a-f][0-9a-f]{2}", "")


def write_documents(df: DataFrame, path: str, by: str = "doc", order: str | None = None) -> None:
    """One folder of JSON a document, its rows in order; a document's rows go to one file."""
    rows = df.repartition(by)
    rows = rows.sortWithinPartitions(by, order) if order else rows
    rows.write.mode("overwrite").partitionBy(by).json(path)


def workbook(long: DataFrame, key: str, fields: Sequence[str], field: str = "field", value: str = "value") -> dict[str, DataFrame]:
    """The sheets of a report: long (key, field, value), wide (a column a field), summary (found and different values a field)."""
    wide = long.groupBy(key).agg(*[F.min(F.when(F.col(field) == f, F.col(value))).alias(f) for f in fields])
    summary = long.groupBy(field).agg(F.count(value).alias("found"), F.count("*").alias("rows"), F.count_distinct(value).alias("different"))
    return {"long": long.select(key, field, value), "wide": wide, "summary": summary}


def write_workbook(sheets: dict[str, DataFrame], path: str, kind: str = "csv") -> list[str]:
    """Each sheet in a folder of its own under `path`."""
    for name, df in sheets.items():
        write_format(df, f"{path}/{name}", kind)
    return [f"{path}/{name}" for name in sheets]


def count_report(df: DataFrame, by: str | None = None) -> DataFrame:
    """The count format of a result: all rows, or the rows of each value of a column."""
    return df.groupBy(by).agg(F.count("*").alias("n")) if by else df.agg(F.count("*").alias("n"))


def result_envelope(df: DataFrame, by: str, name: str, order: str, **context: str | None) -> DataFrame:
    """(by, body): one JSON object a document with how many rows were found, the rows, and only those filters that were set."""
    cols = [c for c in df.columns if c not in (by, order)]
    listed = df.groupBy(by).agg(F.count("*").alias("found"), F.sort_array(F.collect_list(F.struct(order, *cols))).alias(name))
    said = [F.lit(v).alias(k) for k, v in context.items() if v is not None]
    return listed.select(by, F.to_json(F.struct("found", *said, name)).alias("body"))
