"""Incremental storage of raw records: an inbox that is read as it fills.

`first_wins` keeps the first record of a key for good. Within a batch the earliest
counts; over batches the keys already stored are anti-joined, so a repeated batch after
a failure stores nothing twice. `latest_wins` appends each batch's latest rows as a new
generation; `read_latest` is the merged view, and `compact` writes it as one generation.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY, TIME = "process_number", "created_at"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at `path`; None while nothing is there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            return None
        raise


def _one(batch: DataFrame, last: bool) -> DataFrame:
    """One row a key, by time and then by content; an aggregation that combines map-side."""
    row = F.struct(F.col(TIME), *[F.col(c) for c in batch.columns if c not in (KEY, TIME)])
    best = (F.max if last else F.min)(row).alias("_r")
    return batch.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(best).select(KEY, "_r.*").select(*batch.columns)


def first_wins(records: DataFrame, path: str, checkpoint: str, interval: str = "0 seconds", parts: int = 64) -> StreamingQuery:
    """Stream records into the table at `path`, each key once.

    The table is partitioned by the key's hash (`bucket`), so a batch reads only the
    parts that its own keys fall in.
    """

    def store(batch: DataFrame, _: int) -> None:
        new = _one(batch, last=False).withColumn("bucket", F.pmod(F.xxhash64(KEY), F.lit(parts)).cast("int"))
        stored = _stored(batch.sparkSession, path)
        if stored is not None:
            hit = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `parts`
            new = new.join(stored.where(F.col("bucket").isin(hit)).select(KEY), KEY, "left_anti")
        new.write.mode("append").partitionBy("bucket").parquet(path)

    return records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def latest_wins(records: DataFrame, path: str, checkpoint: str, interval: str = "0 seconds") -> StreamingQuery:
    """Stream records into generations under `path`; a batch that runs again overwrites its own generation."""

    def store(batch: DataFrame, n: int) -> None:
        _one(batch, last=True).write.mode("overwrite").parquet(f"{path}/generation={n:012d}")

    return records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of each key over all generations: the later time, then the later generation."""
    every = spark.read.parquet(path)
    cols = [c for c in every.columns if c != "generation"]
    row = F.struct(F.col(TIME), F.col("generation"), *[F.col(c) for c in cols if c not in (KEY, TIME)])
    return every.groupBy(KEY).agg(F.max(row).alias("_r")).select(KEY, "_r.*").select(*cols)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """The merged view written to another folder as its first generation."""
    read_latest(spark, path).write.mode("overwrite").parquet(f"{target}/generation=000000000000")


def arrivals(records: DataFrame, time: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Records a source and window, with a bound on how late they may come; finished windows are final."""
    return records.withWatermark(time, late).groupBy(F.window(time, window), "source").agg(F.count("*").alias("n")).select("window.start", "window.end", "source", "n")
