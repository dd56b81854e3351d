"""The page corpus in canonical columns, and small readers of other formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folhario.functions.text import word_count
from folhario.runtime import cut, table


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, text (never null), header, footer, fonts (array), images, words, chars of every page."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.col("cache_id").alias("doc"), F.col("page_number").alias("page"), text.alias("text"), "header", "footer", "page_type",
        F.when(F.col("fonts").isNull(), F.array().cast("array<string>")).otherwise(F.split("fonts", r"\|")).alias("fonts"),
        F.coalesce("image_count", F.lit(0)).alias("images"), word_count(text).alias("words"), F.length(text).cast("bigint").alias("chars"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a stored analysis, with the name its process is known by."""
    return table(spark, sf_dir, "caches").withColumnRenamed("cache_id", "doc")


def newest_first(df: DataFrame, date: str, key: str, name: str = "position") -> DataFrame:
    """`df` with each row's place in newest-first order, from 1; ties go to the smaller key.

    A global position needs one global order: a range-partitioned sort numbers the rows
    of a partition, and only the partitions' sizes (one number each) are summed up.
    """
    order = [F.desc_nulls_last(date), F.asc(key)]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id() % (1 << 33))

    ranged = cut(ranged)
    sizes = ranged.groupBy("_part").agg(F.max("_in").alias("_last"))
    before = sizes.select("_part", F.coalesce(F.sum(F.col("_last") + 1).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_in") + 1).cast("bigint")).drop("_part", "_in", "_before")


def catalogue_csv(spark: SparkSession, path: str, **columns: list[str]) -> DataFrame:
    """A CSV with a header row; each output column takes the first filled of several possible columns, whatever their case."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    by_name = {c.lower(): c for c in raw.columns}
    return raw.select(*[first_filled(*[F.col(f"`{by_name[x.lower()]}`") for x in names if x.lower() in by_name]).alias(c) for c, names in columns.items()])


def first_filled(*columns: Column) -> Column:
    """The first value that isn't null or blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(None).cast("string"))


def json_records(spark: SparkSession, path: str, key: list[str], others: dict[str, list[str]]) -> DataFrame:
    """A JSON array or JSON lines, told apart by the first character; the last record of a key wins."""
    head = spark.read.text(path).where("trim(value) <> ''").select(F.substring(F.trim("value"), 1, 1).alias("c")).first()
    raw = spark.read.option("multiLine", bool(head and head.c == "[")).json(path)
    pick = lambda names: first_filled(*[F.col(f"`{n}`").cast("string") for n in names if n in raw.columns])
    rows = raw.select(pick(key).alias("key"), *[pick(v).alias(k) for k, v in others.items()], F.monotonically_increasing_id().alias("_n")).where("key is not null")
    return rows.groupBy("key").agg(F.max_by(F.struct(*others), "_n").alias("_v")).select("key", "_v.*")


def inbox(spark: SparkSession, path: str, pattern: str = "*.pdf", recursive: bool = True, most: int | None = None) -> DataFrame:
    """Files of a folder as bytes with their size and SHA-256, newest path order; `most` is the user's own limit."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    out = files.select("path", F.col("modificationTime").alias("created_at"), F.col("length").alias("file_size"), F.sha2("content", 256).alias("sha256"), "content")
    return out.orderBy("path").limit(most) if most else out


def zip_entries(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """(path, entry, name, size, content) of every file in the archives of a folder, in archive order; an unreadable archive gives one row with its error."""
    import io
    import zipfile
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, body in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(body)) as z:
                        for i, x in enumerate(z.infolist(), 1):
                            if not x.is_dir():
                                yield pd.DataFrame([(where, i, x.filename, x.file_size, z.read(x), None)], columns=["path", "entry", "name", "size", "content", "error"])
                except zipfile.BadZipFile as e:
                    yield pd.DataFrame([(where, 0, None, 0, None, str(e))], columns=["path", "entry", "name", "size", "content", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "path string, entry int, name string, size long, content binary, error string")


def settings(defaults: dict, *layers: dict | None) -> dict:
    """Settings with later layers over earlier ones; nulls don't hide a value, nested settings are merged."""
    out = dict(defaults)
    for layer in layers:
        for k, v in (layer or {}).items():
            if isinstance(v, dict) and isinstance(out.get(k), dict):
                out[k] = settings(out[k], v)
            elif v is not None:
                out[k] = v
    return out
