"""Filters and summaries over the node tables of nested records; every condition is a parameter and may be left out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folhario.functions import terms

Span = tuple[float | None, float | None]


def field(name: str, kind: str = "string", body: str = "body") -> Column:
    """A plain field of a node, its key compared without case and underscores; null where it can't be read as `kind`."""
    entries = F.map_entries(F.from_json(body, "map<string,string>"))
    found = F.filter(entries, lambda e: F.replace(F.lower(e["key"]), F.lit("_"), F.lit("")) == name)
    value = F.get(found, 0)["value"]
    return value if kind == "string" else value.try_cast(kind)


def within(c: Column, span: Span | None) -> Column:
    """Whether a value lies in a closed span; an open end is None."""
    lo, hi = span or (None, None)
    return reduce(lambda a, b: a & b, [c >= F.lit(lo) if lo is not None else F.lit(True), c <= F.lit(hi) if hi is not None else F.lit(True)])


def said(c: Column, words: str | None = None, not_words: str | None = None, regex: str | None = None) -> Column:
    """A text's terms (see `functions.terms`), the terms it must not have, and a pattern."""
    out = F.lit(True)
    if words:
        out = out & F.coalesce(terms.matches(c, words), F.lit(False))
    if not_words:
        out = out & ~F.coalesce(terms.matches(c, not_words), F.lit(False))
    if regex:
        out = out & F.coalesce(c.rlike(f"(?iu){regex}"), F.lit(False))
    return out


def page_of(node_id: str = "node_id") -> Column:
    """The page, from 1, that a page's child stands on."""
    return (F.split(node_id, r"\.")[0].cast("int") + 1).alias("page")


def annotations(nodes: DataFrame, types: Sequence[str] | None = None, authors: str | None = None, words: str | None = None, not_words: str | None = None, regex: str | None = None, pages: Span | None = None, modified: tuple[str | None, str | None] | None = None) -> DataFrame:
    """Annotations by type, author, contents, page and date of change."""
    a = nodes.where("kind = 'annotation'").select("key", "node_id", page_of(), field("type").alias("type"), field("author").alias("author"), field("contents").alias("contents"), field("modificationdate").alias("modified"))
    keep = said(F.col("contents"), words, not_words, regex) & within(F.col("page"), pages) & within(F.col("modified"), modified)
    if types:
        keep = keep & F.lower("type").isin([t.lower() for t in types])
    if authors:
        keep = keep & said(F.col("author"), authors)
    return a.where(keep)


def by_type(annotated: DataFrame) -> DataFrame:
    """A record's annotations: how many, of which types, and from when to when."""
    per = annotated.groupBy("key", "type").agg(F.count("*").alias("n"), F.min("modified").alias("a"), F.max("modified").alias("b"))
    kinds = F.sort_array(F.collect_list(F.struct(F.coalesce("type", F.lit("")).alias("t"), "n")))
    return per.groupBy("key").agg(F.sum("n").alias("n"), F.array_join(F.transform(kinds, lambda x: F.concat(x["t"], F.lit("="), x["n"].cast("string"))), " ").alias("types"), F.min("a").alias("first"), F.max("b").alias("last"))


def changed(annotated: DataFrame, by: str | None = None) -> DataFrame:
    """Changes by page: how many, by how many hands, and the latest."""
    return annotated.where(F.col("modified").isNotNull() & said(F.col("author"), by)).groupBy("key", "page").agg(F.count("*").alias("changes"), F.count_distinct("author").alias("hands"), F.max("modified").alias("latest"))


def bookmarks(nodes: DataFrame, words: str | None = None, not_words: str | None = None, regex: str | None = None, depth: Span | None = None, leaf: bool | None = None) -> DataFrame:
    """Bookmarks by title, depth (0 at the root) and whether anything stands below them."""
    m = nodes.where("kind = 'bookmark'").select("key", "node_id", "parent_id", F.col("level").alias("depth"), field("title").alias("title"))
    m = m.where(said(F.col("title"), words, not_words, regex) & within(F.col("depth"), depth))
    if leaf is not None:
        parents = nodes.where("kind = 'bookmark' and parent_id <> ''").select("key", F.col("parent_id").alias("node_id")).distinct()
        m = m.join(parents, ["key", "node_id"], "left_anti" if leaf else "left_semi")
    return m


def fonts(nodes: DataFrame, name: str | None = None, bold: bool | None = None, size: Span | None = None, uses: int = 1) -> DataFrame:
    """A record's fonts: uses, the pages they stand on and their sizes, in order."""
    f = nodes.where("kind = 'font'").select("key", page_of(), field("name").alias("font"), field("size", "double").alias("size"), F.coalesce(field("isbold", "boolean"), F.lit(False)).alias("bold"))
    keep = said(F.col("font"), name) & within(F.col("size"), size)
    if bold is not None:
        keep = keep & (F.col("bold") == bold)
    text = lambda c: F.array_join(F.transform(F.sort_array(F.collect_set(c)), lambda x: x.cast("string")), ",")
    return f.where(keep).groupBy("key", "font").agg(F.count("*").alias("uses"), text("page").alias("pages"), text("size").alias("sizes"), F.bool_or("bold").alias("bold")).where(F.col("uses") >= uses)


def images(nodes: DataFrame, width: Span | None = None, height: Span | None = None, area: Span | None = None, colours: str | None = None) -> DataFrame:
    """Images by their box; sizes that are no numbers fit no condition on them."""
    i = nodes.where("kind = 'image'").select("key", "node_id", page_of(), field("name").alias("name"), field("width", "bigint").alias("width"), field("height", "bigint").alias("height"), field("colorspace").alias("colours"))
    i = i.withColumn("area", F.col("width") * F.col("height"))
    keep = within(F.col("width"), width) & within(F.col("height"), height) & within(F.col("area"), area)
    return i.where(keep & (F.lower("colours").contains(colours.lower()) if colours else F.lit(True)))


def large_images(sized: DataFrame, tracked: int = 250_000, large: int = 1_000_000, box: tuple[int, int] = (500, 700)) -> DataFrame:
    """A record's large images: tracked, very large, beyond a box, and the mean area of those tracked."""
    big = F.col("area") > tracked
    beyond = (F.col("width") > box[0]) & (F.col("height") > box[1])
    return sized.groupBy("key").agg(F.count("*").alias("images"), F.count_if(big).alias("tracked"), F.count_if(F.col("area") > large).alias("large"), F.count_if(beyond).alias("beyond"), F.round(F.avg(F.when(big, F.col("area"))), 4).alias("mean_area"))


def form_fields(nodes: DataFrame, kinds: Sequence[str] | None = None, name: str | None = None, value: bool | None = None) -> DataFrame:
    """Form fields by type, name and whether they hold anything."""
    f = nodes.where("kind = 'form_field'").select("key", "node_id", page_of(), field("name").alias("name"), field("type").alias("type"), field("value").alias("value"))
    keep = said(F.col("name"), name)
    if kinds:
        keep = keep & F.col("type").isin(list(kinds))
    if value is not None:
        keep = keep & (F.coalesce(F.trim("value") != "", F.lit(False)) == value)
    return f.where(keep)


def signatures(nodes: DataFrame, valid: bool | None = None, signer: str | None = None, signed: tuple[str | None, str | None] | None = None) -> DataFrame:
    """Signatures by validity, signer and time."""
    s = nodes.where("kind = 'signature'").select("key", "node_id", field("signername").alias("signer"), field("isvalid", "boolean").alias("valid"), field("signingtime").alias("signed"))
    keep = said(F.col("signer"), signer) & within(F.col("signed"), signed)
    return s.where(keep & (F.col("valid") == valid if valid is not None else F.lit(True)))


def metadata(parts: DataFrame, tagged: bool | None = None, **said_of: str) -> DataFrame:
    """Records by the fields of their metadata section (title, author, producer, ...), each a pattern of terms."""
    m = parts.where("section = 'metadata'").select("key", *[field(k).alias(k) for k in said_of], field("istagged", "boolean").alias("tagged"))
    keep = reduce(lambda a, b: a & b, [said(F.col(k), v) for k, v in said_of.items()], F.lit(True))
    return m.where(keep & (F.col("tagged") == tagged if tagged is not None else F.lit(True)))


def structure(parts: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """How many of the wanted sections a record has."""
    return parts.groupBy("key").agg(F.count_if(F.col("section").isin(list(wanted))).alias("sections"))


def objects(dump: DataFrame, kind: str | None = None, number: Span | None = None, size: Span | None = None, has_key: str | None = None, stream: bool | None = None) -> DataFrame:
    """Objects (type, number, size, keys) of a file's dump; `kind` is exact, or a prefix (x*), or within (*x*), whatever its case."""
    keep = within(F.col("number"), number) & within(F.col("size"), size)
    if kind:
        bare, t = kind.strip("*").lower(), F.lower("type")
        keep = keep & (t.contains(bare) if kind.startswith("*") else t.startswith(bare) if kind.endswith("*") else t == bare)
    if has_key:
        keep = keep & F.array_contains("keys", has_key)
    if stream is not None:
        keep = keep & ((F.col("size") > 0) == stream)
    return dump.where(keep)


def pages(df: DataFrame, words: str | None = None, not_words: str | None = None, regex: str | None = None, pages: Span | None = None, word_count: Span | None = None, has_images: bool | None = None, money: bool | None = None, blank: bool | None = None, fonts_any: Sequence[str] = (), fonts_all: Sequence[str] = ()) -> DataFrame:
    """Pages of the corpus by terms, pattern, place, words, images, amounts of money, blankness and fonts."""
    from folhario.functions.text import money_values

    has = lambda f: F.exists("fonts", lambda x: F.lower(x).contains(f.lower()))
    keep = said(F.col("text"), words, not_words, regex) & within(F.col("page"), pages) & within(F.col("words"), word_count)
    for want, c in ((has_images, F.col("images") > 0), (money, F.size(money_values(F.col("text"))) > 0), (blank, F.col("words") <= 10)):
        if want is not None:
            keep = keep & (c == want)
    if fonts_any:
        keep = keep & reduce(lambda a, b: a | b, [has(f) for f in fonts_any])
    if fonts_all:
        keep = keep & reduce(lambda a, b: a & b, [has(f) for f in fonts_all])
    return df.where(keep)


def documents(df: DataFrame, pages: Span | None = None, any_image: bool | None = None) -> DataFrame:
    """(doc): documents by their number of pages and whether any page has an image."""
    d = df.groupBy("doc").agg(F.count("*").alias("n"), F.bool_or(F.col("images") > 0).alias("i"))
    return d.where(within(F.col("n"), pages) & (F.col("i") == any_image if any_image is not None else F.lit(True))).select("doc")


def term_hits(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(doc, page, n_<term>...): how often each plain term stands on the pages that have them all."""
    from folhario.functions.values import unaccent

    norm = unaccent(F.lower("text"))
    counts = [F.regexp_count(norm, F.lit(terms.plain(t))).alias(f"n_{terms.plain(t)}") for t in wanted]
    return df.select("doc", "page", *counts).where(reduce(lambda a, b: a & b, [F.col(f"n_{terms.plain(t)}") > 0 for t in wanted]))
