"""Best representative of each duplicate group, by skyline selection.

Rows are brought together by process and start page. The process of a row is its own
number, digits only; where that is missing, the number other rows give for the same
stored file; where no row knows it, the file stands for it. Only the few rows without
a number are joined.

Every row has a profile: how many fields are filled and how far its method is trusted.
A group is first reduced, map-side, to one cell for each profile with its most recent
row, at most 13 x (methods + 1) cells whatever the group's size, so a group that holds a
third of all rows is no heavier than another; its members are joined to their survivor
with the rows of large groups split (`skew_join`). The skyline of the cells (those that no
other cell beats or equals in completeness, trust and recency) is found on that bounded
list; the survivor is the first of the skyline by a lexicographic policy. Peeling
skylines off gives dominance layers, from which the survivor's empty fields are filled,
best layer first.

Defined cases: rows with neither number nor file, or without a start page, are alone and
give no group; groups of one give no rows; a null date is older than any date; a method
that isn't in the trust table ranks last; equal rows are told apart by the smallest id;
extra columns and an empty table are no matter.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folhario.functions.values import filled, fold
from folhario.runtime import cut, skew_join

FIELDS = ("processo", "juizo", "perito_nome", "cpf_perito", "especialidade", "valor_arbitrado", "valor_tabelado", "numero_autos", "autor", "parte_contraria", "destino", "comarca")
LAST_RANK = 1_000_000


def process_key(c: Column) -> Column:
    """The digits of a process number, however it is written; null without any."""
    bare = F.regexp_replace(F.lower(c), r"^\s*(processo|process|proc|adme)\b\W*(n\s*[ºo°.]+)?", "")
    digits = F.regexp_replace(F.translate(bare, "oli|", "0111"), r"\D", "")
    return F.when(bare.rlike(r"\d") & (F.length(digits) >= 5), digits)


def file_key(c: Column) -> Column:
    """The number in a stored file's name, without folder, leading zeros and copy marks; null without one."""
    name = F.regexp_extract(c, r"([^/\\]*)$", 1)
    return F.nullif(F.ltrim(F.regexp_extract(name, r"(\d{6,})", 1), F.lit("0")), F.lit(""))


def _grouped(df: DataFrame, key: str, process: str, source: str, page: str) -> DataFrame:
    """`df` with `_group`: the process of every row that has one."""
    own = df.withColumn("_p", process_key(F.col(process))).withColumn("_f", file_key(F.col(source)))
    pairs = own.where("_p is not null and _f is not null").groupBy("_f", "_p").count()
    known = pairs.groupBy("_f").agg(F.max_by("_p", F.struct("count", "_p")).alias("_known"))
    direct = own.where("_p is not null").withColumn("_group", F.col("_p"))
    by_file = own.where("_p is null and _f is not null").join(known, "_f", "left").withColumn("_group", F.coalesce("_known", F.concat(F.lit("file "), "_f"))).drop("_known")
    return direct.unionByName(by_file).where(F.col(page).isNotNull()).drop("_p", "_f")


def profiles(df: DataFrame, methods: DataFrame, key: str = "rec_id", fields: Sequence[str] = FIELDS, process: str = "processo", source: str = "source_file", page: str = "start_page", method: str = "extraction_method", date: str = "extraction_date") -> DataFrame:
    """Rows in groups, with `_full` (filled fields), `_rank` (trust, 1 is best) and `_when` (microseconds)."""
    trust = methods.select(F.regexp_replace(fold(F.col("extraction_method")), r"\W", "").alias("_m"), F.col("trust_rank").cast("int").alias("_rank")).groupBy("_m").agg(F.min("_rank").alias("_rank"))
    full = sum((filled(F.col(f).cast("string")).cast("int") for f in fields), F.lit(0))
    # the trust table has a row for each method, 5 today; Spark broadcasts it by its size, or shuffles it beyond that
    rows = (
        _grouped(df.select(key, *dict.fromkeys([*fields, process, source, page, method, date])), key, process, source, page)
        .withColumn("_m", F.regexp_replace(fold(F.col(method)), r"\W", ""))
        .join(trust, "_m", "left")
        .withColumn("_rank", F.coalesce("_rank", F.lit(LAST_RANK)))
        .withColumn("_full", full)
        .withColumn("_when", F.coalesce(F.unix_micros(F.col(date).cast("timestamp")), F.lit(-(2**62))))
    )
    return rows.withColumn("_page", F.col(page)).withColumn("_key", F.col(key))


def cells(rows: DataFrame) -> DataFrame:
    """Per group the bounded list of its profiles, each with its most recent row, and the number of rows."""
    best = F.max(F.struct("_when", (-F.col("_key")).alias("_neg"))).alias("_best")
    per = rows.groupBy("_group", "_page", "_full", "_rank").agg(best, F.count("*").alias("_n"))
    cell = F.struct("_full", F.negate("_rank").alias("_trust"), F.col("_best._when").alias("_when"), F.col("_best._neg").alias("_neg"), "_n")
    return per.groupBy("_group", "_page").agg(F.collect_list(cell).alias("_cells"), F.sum("_n").alias("_n")).where("_n > 1")


def beats(a: Column, b: Column) -> Column:
    """Whether cell `a` is as good as `b` in all three respects and better in one."""
    as_good = (a["_full"] >= b["_full"]) & (a["_trust"] >= b["_trust"]) & (a["_when"] >= b["_when"])
    return as_good & ((a["_full"] > b["_full"]) | (a["_trust"] > b["_trust"]) | (a["_when"] > b["_when"]))


def skyline(groups: DataFrame) -> DataFrame:
    """`groups` with `_sky`: the cells that no other cell of the group beats."""
    return groups.withColumn("_sky", F.filter("_cells", lambda c: ~F.exists("_cells", lambda d: beats(d, c))))


def survivors(df: DataFrame, methods: DataFrame, **columns) -> DataFrame:
    """(rec_id, survivor_id) of each member of a group of two or more rows.

    The policy among the undominated: most filled fields, best trust, latest date,
    smallest id; fields of a cell compare in that order.
    """
    rows = profiles(df, methods, **columns)
    chosen = cut(skyline(cells(rows)).select("_group", "_page", F.negate(F.array_max("_sky")["_neg"]).alias("survivor_id"), "_n"))
    members = rows.select(F.col("_key").alias("rec_id"), "_group", "_page")
    return skew_join(members, chosen.drop("_n"), ["_group", "_page"], chosen).select("rec_id", "survivor_id")


def _layers(lists: pd.Series) -> pd.Series:
    """The dominance layer, from 1, of every cell of a group."""

    def one(cs) -> list[int]:
        a = np.array([[c["_full"], c["_trust"], c["_when"]] for c in cs], dtype=np.int64)
        layer = np.zeros(len(a), dtype=np.int32)
        n = 0
        while (layer == 0).any():
            n += 1
            left = np.flatnonzero(layer == 0)
            b = a[left]
            ge = (b[:, None, :] >= b[None, :, :]).all(2) & (b[:, None, :] > b[None, :, :]).any(2)
            layer[left[~ge.any(0)]] = n
        return layer.tolist()

    return pd.Series([one(cs) for cs in lists], dtype=object)


def golden(df: DataFrame, methods: DataFrame, fields: Sequence[str] = FIELDS, **columns) -> DataFrame:
    """One built record a group: the survivor's id, and each field from the best dominance layer that has it filled.

    Within a layer rows come by the policy's order. A field filled in no row is null.
    """
    rows = profiles(df, methods, fields=fields, **columns)
    grouped = cells(rows).withColumn("_layer", F.pandas_udf(_layers, "array<int>")("_cells"))
    flat = grouped.select("_group", "_page", F.explode(F.arrays_zip("_cells", "_layer")).alias("_c"))
    ranked = flat.select("_group", "_page", F.col("_c._cells._full").alias("_full"), F.negate(F.col("_c._cells._trust")).alias("_rank"), F.col("_c._layer").alias("_layer"), F.col("_c._cells._n").alias("_n"))
    ranked = cut(ranked)
    joined = skew_join(rows, ranked.drop("_n"), ["_group", "_page", "_full", "_rank"], ranked)
    order = F.struct("_layer", (-F.col("_full")).alias("a"), F.col("_rank").alias("b"), (-F.col("_when")).alias("c"), F.col("_key").alias("d"))
    built = [F.min_by(f, F.when(filled(F.col(f).cast("string")), order)).alias(f) for f in fields]
    return joined.groupBy("_group", "_page").agg(F.min_by("_key", order).alias("survivor_id"), F.count("*").alias("members"), *built).drop("_group", "_page")
