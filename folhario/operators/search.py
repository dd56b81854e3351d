"""Full-text search over a table of tokens: exact words, prefixes, stems, all or any of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folhario.functions.values import unaccent

#: Endings taken off Portuguese words, one of each step: plurals, adverbs, nouns made of verbs and adjectives, verb forms, last vowel.
STEPS = (
    r"(?:(?<=[a-z]{2})(?:oes|aes|aos)|(?<=[a-z]{2})ns|(?<=[a-z]{3})(?:res|zes|ses)|(?<=[a-z]{2}[aeiou])s|(?<=[a-z]{3})is)$",
    r"(?<=[a-z]{4})mente$",
    r"(?<=[a-z]{3})(?:amento|imento|acao|icao|ador|edor|idor|adora|idade|ista|ismo|avel|ivel|encia|ancia|ario|aria|oso|osa|ico|ica|ivo|iva|cao)$",
    r"(?<=[a-z]{3})(?:ando|endo|indo|aram|eram|iram|ado|ada|ido|ida|ava|ia|ou|eu|iu|ar|er|ir)$",
    r"(?<=[a-z]{3})[aeo]$",
)


def words_of(text: Column) -> Column:
    """The different folded words of a text."""
    return F.array_distinct(F.regexp_extract_all(unaccent(F.lower(text)), F.lit("[a-z0-9]{2,}"), F.lit(0)))


def stem(word: Column) -> Column:
    """A folded word without its Portuguese endings."""
    return reduce(lambda c, step: F.regexp_replace(c, step, ""), STEPS, word)


def index(df: DataFrame, key: str, text: str, stems: bool = False) -> DataFrame:
    """(key, token) of every different folded word, or stem, of a text."""
    tokens = words_of(F.col(text))
    return df.select(key, F.explode(F.array_distinct(F.transform(tokens, stem)) if stems else tokens).alias("token"))


def write_index(tokens: DataFrame, path: str, parts: int = 256) -> None:
    """The index kept in a folder, partitioned by the token's hash, so a search for a word reads one part in `parts`."""
    bucket = F.pmod(F.xxhash64("token"), F.lit(parts)).cast("int").alias("bucket")
    tokens.select("*", bucket).repartition("bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str, wanted: Sequence[str] = (), parts: int = 256) -> DataFrame:
    """The kept index; only the parts of the wanted words are read where all of them are whole words."""
    kept = spark.read.parquet(path)
    if wanted and not any(t.endswith("*") for t in wanted):
        buckets = [r.b for r in spark.createDataFrame([(t,) for t in wanted], "t string").select(F.pmod(F.xxhash64("t"), F.lit(parts)).cast("int").alias("b")).distinct().collect()]
        kept = kept.where(F.col("bucket").isin(buckets))
    return kept.drop("bucket")


def _hit(token: Column, term: str) -> Column:
    return token.startswith(term[:-1]) if term.endswith("*") else token == term


def lookup(tokens: DataFrame, key: str, wanted: Sequence[str], every: bool = True) -> DataFrame:
    """(key, matched) of the rows with all of the terms, or any; `x*` is a prefix. Tokens are filtered before the shuffle."""
    which = F.when(_hit(F.col("token"), wanted[0]), 0)
    for i, t in enumerate(wanted[1:], 1):
        which = which.when(_hit(F.col("token"), t), i)
    found = tokens.select(key, which.alias("w")).where("w is not null").groupBy(key).agg(F.count_distinct("w").alias("matched"))
    return found.where(F.col("matched") == len(wanted)) if every else found


def scan(df: DataFrame, key: str, text: str, wanted: Sequence[str], every: bool = True, stems: bool = False) -> DataFrame:
    """(key, matched) without an index: terms are looked for in each row's own words, so nothing is exploded or shuffled."""
    words = words_of(F.col(text))
    tokens = F.transform(words, stem) if stems else words

    def among(t: str) -> Column:
        return F.exists("_w", lambda x: _hit(x, t)).cast("bigint")

    hits = [among(t) for t in wanted]
    found = df.select(key, tokens.alias("_w")).select(key, reduce(lambda a, b: a + b, hits).alias("matched"))
    return found.where(F.col("matched") == len(wanted) if every else F.col("matched") > 0)
