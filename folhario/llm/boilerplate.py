"""Lines repeated across the documents of one source, named and removed.

Lines are compared by a key without numbers, dates, codes, case, accents, vowels, spacing
and punctuation. First pass: a mergeable heavy-hitter sketch of the keys of each source,
built map-side and merged, so neither a source that holds a third of all pages nor the
number of different lines matters. Second pass: exact counts of the candidates, taking
in lines that differ from one by a misread character or two. Lines that stand on enough
of their source's pages are confirmed, and removed by way of the confirmed set.

The sketch of a source is taken only where it can't have missed a line: its error,
3.5 / (size of its table) of the source's lines, must be less than half the count looked
for, and its list must end below that count. A source of which that isn't so (very long
pages, or more repeated lines than are tracked) is counted exactly instead. Candidates
are taken from `slack` of the share, for counts that misread spellings split up, so a
source has no more of them than its pages have lines on average, divided by
`share` x `slack`.

Defined cases: null, empty and blank fields have no lines to find; blank lines are never
cases; pages whose source isn't known are left alone; a line that stands twice on a page
counts once; repeated pages count each; extra columns pass through `strip_lines`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folhario.runtime import cut, is_small, skew_join

SHARE = 0.15
FIELDS = ("header", "footer", "text")
_MONTHS = "janeiro|fevereiro|mar[cç]o|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro"
_L = "[a-zà-ý]"
_AFTER = rf"(?={_L}+(?![\p{{L}}\d]))"


def _misread(digit: str, most: int = 1) -> str:
    """A digit read for a letter in a word of letters; words of six or more hexadecimal digits are codes."""
    return rf"{digit}(?<=(?<![\p{{L}}\d])(?![a-f\d]{{6,}}(?![\p{{L}}\d])){_L}{{1,30}}{digit}{{1,{most}}})" + (_AFTER if most == 1 else _AFTER.replace("(?=", f"(?={digit}?", 1))


def line_keys(c: Column) -> Column:
    """A text's lines as an array of keys; a blank line's key is empty.

    The whole text is folded at once, line ends kept, and split afterwards. Digits read
    for letters are put back in words, before what has digits becomes a number. Vowels, with
    or without accents, are left out of keys: misread and unaccented letters are mostly
    vowels, and lines that differ in nothing else are one line anyway.
    """
    t = F.lower(c)
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")
    u = F.regexp_replace(t, r"(?<=[a-zà-ý])0(?=[a-zà-ý])|(?<=[a-zà-ý]{2})0(?![0-9a-z])", "o")
    u = F.regexp_replace(u, _misread("5", 2), "s")
    u = F.regexp_replace(u, _misread("8"), "b")
    u = F.regexp_replace(u, rf"{_misread('1')}(?<=[^aeiouà-ý]1)(?=[^aeiouà-ý])", "i")
    u = F.regexp_replace(u, _misread("1"), "l")
    # texts without such a digit behind a letter are spared the search for misread ones
    t = F.when(t.rlike("[a-zà-ý][0158]"), u).otherwise(t)
    t = F.regexp_replace(t, rf"[a-z]*\d[a-z\d]*(?: (?:de )?(?:(?:{_MONTHS}) )?(?:de )?(?=[a-z]*\d)[a-z\d]+)*", "#")
    t = F.replace(t, F.lit("ç"), F.lit("c"))
    t = F.regexp_replace(t, r"[aeiouà-æè-öø-ý\p{Mn}]+", "")
    return F.transform(F.split(t, "\n"), lambda x: F.trim(x))


def _pages(pages: DataFrame, sources: DataFrame, key: str, link: str, source: str, fields: Sequence[str], small: int) -> DataFrame:
    """(page, source, k1, k2, ...): the keys of every field of every page with a known source."""
    known = sources.select(link, F.col(source).alias("_source")).where("_source is not null").dropDuplicates([link])
    keys = [F.coalesce(line_keys(F.col(f)), F.array().cast("array<string>")).alias(f"_k{i}") for i, f in enumerate(fields)]
    wanted = pages.select(F.col(key).alias("_page"), link, *fields)
    if is_small(known, small):
        met = wanted.join(F.broadcast(known), link)
    else:
        met = skew_join(wanted, known, [link], pages.groupBy(link).agg(F.count("*").alias("_n")))
    return met.select("_page", "_source", *keys)


def _clusters(lists: pd.Series) -> pd.Series:
    """For each (key, count) of a source's candidates the place of the key that stands for it.

    Keys are taken by falling count; each joins the nearest key that stands for itself,
    so that small steps don't chain different lines.
    """

    def one(rows) -> list[int]:
        head = list(range(len(rows)))
        of_length: dict[int, list[int]] = {}
        for i in sorted(head, key=lambda i: (-rows[i]["n"], rows[i]["k"])):
            key = rows[i]["k"]
            n, most = len(key), allowance(len(key))
            quarter = max(n // 4, 1)
            parts = [key[j * quarter : (j + 1) * quarter if j < 3 else n] for j in range(4)]
            best = most + 1
            for size in range(n - most, n + most + 1):
                for j in of_length.get(size, ()):
                    other = rows[j]["k"]
                    if any(p in other for p in parts) and (d := _edits(key, other)) < best:
                        best, head[i] = d, j
            if head[i] == i:
                of_length.setdefault(n, []).append(i)
        return head

    return pd.Series([one(list(x)) for x in lists], dtype=object)


def _slices(lists: pd.Series) -> pd.Series:
    """For each length a line may have, where in the list, sorted by length, the keys stand that it may be near: from, number."""

    def one(keys) -> list[dict]:
        sizes = np.array([len(k) for k in keys])
        out = []
        for n in sorted({n for s in set(sizes.tolist()) for n in range(max(s - 3, 1), s + 4)}):
            a, b = np.searchsorted(sizes, [n - allowance(n), n + allowance(n) + 1])
            if b > a:
                out.append({"n": n, "a": int(a) + 1, "size": int(b - a)})
        return out

    return pd.Series([one(k) for k in lists], dtype=object)


def allowance(n: int) -> int:
    """Edits by which keys of n characters may differ and still be one line."""
    return 0 if n < 5 else 1 if n < 10 else 2 if n < 20 else 3


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def candidates(paged: DataFrame, n_fields: int, share: float, tracked: int, slack: float) -> DataFrame:
    """(source, pages, candidate keys sorted by length, heads, slices by length): what the sketches leave."""
    every = F.array_distinct(F.concat(*[f"_k{i}" for i in range(n_fields)]))
    lines = paged.select("_source", F.explode(F.filter(every, lambda k: F.length(F.translate(k, "# ", "")) > 0)).alias("_key"))
    sizes = paged.groupBy("_source").agg(F.count("*").alias("_pages"))
    top = lines.groupBy("_source").agg(F.expr(f"approx_top_k(_key, {tracked}, {tracked})").alias("_top"), F.count("*").alias("_lines"))
    least = share * slack * F.col("_pages")
    table = 2 ** math.ceil(math.log2(math.ceil(tracked / 0.75)))
    sure = (2 * 3.5 / table * F.col("_lines") < least) & ((F.size("_top") < tracked) | (F.element_at("_top", -1)["count"] < least))
    sketched = cut(top.join(sizes, "_source").withColumn("_sure", sure))
    entries = F.transform(F.filter("_top", lambda t: t["count"] >= least), lambda t: F.struct(F.length(t["item"]).alias("size"), t["item"].alias("k"), t["count"].alias("n")))
    kept = sketched.where("_sure").select("_source", "_pages", F.sort_array(entries).alias("_cands"))
    unsure = sketched.where("not _sure").select("_source", "_pages", F.col("_lines").alias("_n"))
    if not unsure.isEmpty():
        again = lines.join(F.broadcast(unsure), "_source") if is_small(unsure, 100_000) else skew_join(lines, unsure.drop("_n"), ["_source"], unsure.select("_source", "_n"))
        counted = again.groupBy("_source", "_key").agg(F.count("*").alias("n"), F.first("_pages").alias("_pages")).where(F.col("n") >= least)
        exact = counted.groupBy("_source").agg(F.first("_pages").alias("_pages"), F.sort_array(F.collect_list(F.struct(F.length("_key").alias("size"), F.col("_key").alias("k"), "n"))).alias("_cands"))
        kept = kept.unionByName(exact)
    kept = kept.where("size(_cands) > 0").select("_source", "_pages", "_cands", F.col("_cands.k").alias("_keys"))
    near = F.pandas_udf(_slices, "array<struct<n int, a int, size int>>")("_keys")
    return kept.select("_source", "_pages", "_keys", F.pandas_udf(_clusters, "array<int>")("_cands").alias("_head"), near.alias("_near")).withColumn("_near", F.map_from_entries(F.transform("_near", lambda x: F.struct(x["n"], F.struct(x["a"], x["size"])))))


def repeated_lines(
    pages: DataFrame, sources: DataFrame, key: str = "page_id", link: str = "cache_id", source: str = "source", fields: Sequence[str] = FIELDS, share: float = SHARE, tracked: int = 4096, slack: float = 0.4, small: int = 500_000, small_lines: int = 2_000_000
) -> DataFrame:
    """(page_id, field_name, line_no) of every line to remove, line numbers from 1."""
    paged = cut(_pages(pages, sources, key, link, source, fields, small))
    cands = cut(candidates(paged, len(fields), share, tracked, slack))
    # the candidates of all sources are counted before the broadcast
    if (cands.agg(F.sum(F.size("_keys"))).first()[0] or 0) <= small_lines:
        met = paged.join(F.broadcast(cands), "_source")
    else:
        met = skew_join(paged, cands, ["_source"], cands.select("_source", F.col("_pages").alias("_n")))

    def numbered(i: int, name: str) -> Column:
        return F.transform(f"_k{i}", lambda k, n: F.struct(F.lit(name).alias("f"), (n + 1).alias("n"), k.alias("k")))

    entries = F.concat(*[numbered(i, f) for i, f in enumerate(fields)])
    lines = met.select("_page", "_source", "_pages", "_keys", "_head", "_near", F.explode(entries).alias("e")).where(F.length(F.translate("e.k", "# ", "")) > 0)
    k = F.col("e.k")
    n = F.length(k)
    lines = lines.withColumn("_in", F.try_element_at("_near", n)).where("_in is not null").withColumn("_some", F.slice("_keys", F.col("_in.a"), F.col("_in.size")))
    third = F.greatest(F.floor(n / 4), F.lit(1)).cast("int")
    allow = F.when(n < 5, 0).when(n < 10, 1).when(n < 20, 2).otherwise(3)
    # with three edits at most, one of a line's four quarters is left whole, so it stands in the candidate
    parts = [F.substring(k, F.lit(1), third), F.substring(k, third + 1, third), F.substring(k, 2 * third + 1, third), F.substring(k, 3 * third + 1, n)]
    place = F.array_position("_some", k)

    def edits(c: Column) -> Column:
        met_part = c.contains(parts[0]) | c.contains(parts[1]) | c.contains(parts[2]) | c.contains(parts[3])
        d = F.levenshtein(c, k, 3)
        return F.when(met_part & d.between(0, allow), d)

    nearest = F.transform("_some", edits)
    lines = lines.withColumn("_at", F.when(place > 0, place).otherwise(F.array_position(nearest, F.array_min(nearest)))).where("_at > 0")
    at = (F.col("_at") + F.col("_in.a") - 1).cast("int")
    hits = cut(lines.select("_page", "_source", "_pages", F.col("e.f").alias("field_name"), F.col("e.n").alias("line_no"), F.element_at("_head", at).alias("_line")))
    counted = hits.groupBy("_source", "_line", "_page").agg(F.first("_pages").alias("_pages"), F.count("*").alias("_hits")).groupBy("_source", "_line").agg(F.count("*").alias("_on"), F.first("_pages").alias("_pages"), F.sum("_hits").alias("_n"))
    confirmed = counted.where(F.col("_on") >= share * F.col("_pages") - 1e-9).select("_source", "_line", "_n")
    if is_small(confirmed, small_lines):
        found = hits.join(F.broadcast(confirmed), ["_source", "_line"])
    else:
        found = skew_join(hits, confirmed.drop("_n"), ["_source", "_line"], confirmed)
    return found.select(F.col("_page").alias(key), "field_name", "line_no")


def strip_lines(pages: DataFrame, removed: DataFrame, key: str = "page_id", fields: Sequence[str] = FIELDS) -> DataFrame:
    """`pages` without the lines in `removed`; fields that were null stay null."""
    gone = removed.groupBy(F.col(key).alias("__page")).agg(*[F.collect_set(F.when(F.col("field_name") == f, F.col("line_no"))).alias(f"__g{i}") for i, f in enumerate(fields)])
    joined = pages.join(gone, pages[key] == gone["__page"], "left")

    def left(f: str, i: int) -> Column:
        kept = F.filter(F.split(pages[f], "\n"), lambda x, n: ~F.coalesce(F.array_contains(f"__g{i}", (n + 1).cast("int")), F.lit(False)))
        return F.when(F.col("__page").isNull(), pages[f]).otherwise(F.array_join(kept, "\n"))

    new = {f: left(f, i) for i, f in enumerate(fields)}
    return joined.select(*[new[c].alias(c) if c in new else pages[c] for c in pages.columns])
