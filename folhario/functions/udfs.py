"""The few functions that columns can't express, as Arrow-batched UDFs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a word of bits at a time."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = where.get(c, 0)
        x = row & m
        row = ((row + x) | (row - x)) & full
    return len(a) - row.bit_count()


def diff_similarity(a: str | None, b: str | None) -> float | None:
    """1 - (inserted + deleted characters) / the longer length; 1 for two empty texts, null with a null."""
    if a is None or b is None:
        return None
    longest = max(len(a), len(b))
    if not longest:
        return 1.0
    return 1.0 - (len(a) + len(b) - 2 * lcs_length(a, b)) / longest


def char_similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([diff_similarity(p, q) for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def locate(text: str, pattern: str, most: int) -> int:
    """The first place where a text holds a pattern with at most `most` edits (bit-parallel); -1 without one."""
    m = len(pattern)
    if not m:
        return 0
    mask: dict[str, int] = {}
    for i, c in enumerate(pattern):
        mask[c] = mask.get(c, 0) | 1 << i
    rows = [(1 << d) - 1 for d in range(most + 1)]
    for i, c in enumerate(text):
        f = mask.get(c, 0)
        old = rows[0]
        rows[0] = ((rows[0] << 1) | 1) & f
        for d in range(1, most + 1):
            prev = rows[d]
            rows[d] = (((prev << 1) | 1) & f) | old | (old << 1) | (rows[d - 1] << 1) | 1
            old = prev
        if rows[most] >> (m - 1) & 1:
            return max(0, i - m + 1)
    return -1


def fuzzy_position(text: Column, pattern: str, most: int) -> Column:
    @F.pandas_udf("int")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else locate(t.lower(), pattern.lower(), most) for t in x], dtype="Int32")

    return run(text)


def anchored_lines(words: DataFrame, tolerance: float, mean: bool = False) -> DataFrame:
    """`words` (doc, page, y0, x0, ord) with a `line`: words from top to bottom, a new line where y leaves the
    line's first word (or, with `mean`, the mean of its words) by more than `tolerance`.

    Pages are hashed to partitions, sorted there, and read as one stream, so neither the
    number of pages nor the words of one matter for memory.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*words.schema.fields, T.StructField("line", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, line, anchor, n = None, 0, 0.0, 0
        for batch in batches:
            out = []
            for doc, page, y in zip(batch["doc"], batch["page"], batch["y0"]):
                if (doc, page) != where:
                    where, line, n = (doc, page), 0, 0
                elif abs(y - anchor) > tolerance:
                    line, n = line + 1, 0
                anchor = y if n == 0 else (anchor * n + y) / (n + 1) if mean else anchor
                n += 1
                out.append(line)
            yield batch.assign(line=pd.Series(out, index=batch.index, dtype="int32"))

    placed = words.repartition("doc", "page").sortWithinPartitions("doc", "page", F.desc("y0"), "x0", "ord")
    return placed.mapInPandas(run, schema)


def balanced_object(text: str | None) -> str | None:
    """The first complete {...} of a mixed text, quotes and escapes minded; null without one."""
    if not text:
        return None
    start = text.find("{")
    depth, quoted, skip = 0, False, False
    for i in range(max(start, 0), len(text) if start >= 0 else 0):
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def first_object(text: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([balanced_object(t) for t in x], dtype=object)

    return F.pandas_udf(run, "string")(text)
