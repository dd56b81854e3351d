"""Token ids of a whole corpus by a public byte-level tokenizer.

The rank file is local and its path a parameter. Long texts are split beforehand at
places where the tokenizer's own pattern always starts a new piece, so that the ids are
those of the whole text; ids go back to text by way of raw bytes.

Defined cases: a null and an empty text both give an empty list; blank texts and very
long ones (also a single word of any length) give the ids of the whole text; special
tokens are ordinary text; other columns of the input play no part.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-splitting pattern that belongs to the byte-level vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A single blank between two visible characters: every piece of the pattern ends before it.
SAFE = re.compile(r"(?<=\S)(?=\s\S)")


@lru_cache(maxsize=4)
def encoding(ranks: str = RANKS, pattern: str = PATTERN):
    """The tokenizer, read once in each Python worker."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_chunks(text: str, size: int) -> Iterator[str]:
    """`text` in parts of about `size` characters, cut only where a new piece begins anyway."""
    start = 0
    while len(text) - start > size:
        m = SAFE.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(text: str | None, ranks: str = RANKS, pattern: str = PATTERN, chunk: int = 50_000) -> list[int]:
    """The ids of one text."""
    if not text:
        return []
    enc = encoding(ranks, pattern)
    if len(text) <= chunk:
        return enc.encode_ordinary(text)
    return [i for part in safe_chunks(text, chunk) for i in enc.encode_ordinary(part)]


def decode(ids, ranks: str = RANKS, pattern: str = PATTERN) -> str:
    """The text of a list of ids, joined as bytes before it is read as UTF-8."""
    return encoding(ranks, pattern).decode_bytes([int(i) for i in ids]).decode("utf-8")


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS, pattern: str = PATTERN, chunk: int = 50_000) -> DataFrame:
    """(key, ids) of every row: a map over the scan, with no shuffle."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([encode(t, ranks, pattern, chunk) for t in texts], dtype=object)

    return df.select(F.col(key), ids(F.col(text).cast("string")).alias("ids"))


def decode_corpus(df: DataFrame, ids: str = "ids", out: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """`df` with the text of `ids` in column `out`, replacing a column of that name."""

    @F.pandas_udf("string")
    def back(column: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decode(x, ranks, pattern) for x in column], dtype=object)

    return df.withColumn(out, back(F.col(ids)))
