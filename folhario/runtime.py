"""What every operator needs from the session: tables, lineage cuts, size checks."""

from __future__ import annotations

import tempfile

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    A cluster names it in spark.checkpoint.dir, which is read from the session. Where the
    setting is absent a local session takes a folder of its own; on a cluster, whose
    executors couldn't read such a folder, that is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="folhario-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder and read back: its lineage ends there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` less columns that an operator is about to add, so that clashing names can't arise."""
    return df.drop(*[n for n in names if n in df.columns])


class TooLarge(ValueError):
    """A table that was to be held in memory is larger than its stated bound."""


def bounded_rows(df: DataFrame, limit: int) -> list:
    """The rows of a table that must be small; one row over `limit` is an error, never a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooLarge(f"more than {limit} rows where a small table is required")
    return rows


def is_small(df: DataFrame, limit: int) -> bool:
    """Whether `df` has at most `limit` rows, found without counting all of them."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """A broadcast hint behind a check of the size; past it Spark's own choice (a shuffle) stays."""
    return F.broadcast(df) if is_small(df, limit) else df


def skew_join(rows: DataFrame, facts: DataFrame, on: Sequence[str], counts: DataFrame, how: str = "inner", floor: int = 100_000, share: int = 10_000) -> DataFrame:
    """`rows` joined with `facts` (one row a key), whatever part of the rows one key holds.

    `counts`: the columns `on` and `_n`, the number of rows of a key. A key with more than
    `floor` rows and more than a `share`-th of all is hot; there can't be more than `share`
    such keys, so their list is broadcast. Rows of a hot key are salted by their content
    and its fact is repeated for every salt; all other keys are joined as they are. The
    counts are looked at here, so they should be a table that is cut or cheap; where no
    key is hot, it is a plain join.
    """
    total = counts.agg(F.sum("_n").alias("t")).first()["t"] or 0
    hot = counts.where((F.col("_n") > floor) & (F.col("_n") * share > total))
    if hot.isEmpty():
        return rows.join(facts, [*on], how)
    hot = F.broadcast(hot.select(*on, F.least(F.ceil(F.col("_n") / max(total / 1000, floor)), F.lit(1000)).cast("int").alias("_copies")))
    plain = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    salted = rows.join(hot, [*on], "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_copies", F.lit(1))).cast("int")).drop("_copies")
    copied = facts.where(plain).join(hot, [*on], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    return salted.join(copied, [*on, "_salt"], how).drop("_salt")


def spread(df: DataFrame, per_task: int = 1) -> DataFrame:
    """`df` over at least as many partitions as there are cores, for work heavy in Python."""
    want = df.sparkSession.sparkContext.defaultParallelism * per_task
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
