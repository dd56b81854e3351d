"""Page sequences to logical documents: neighbour scores, boundaries, ranges, islands."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folhario.functions.text import full_lines
from folhario.functions.values import unaccent

#: Phrases that open and close a paper (fixed values).
STARTS = ("PODER JUDICIÁRIO", "TRIBUNAL DE JUSTIÇA", "MINISTÉRIO PÚBLICO", "DEFENSORIA PÚBLICA", "PROCURADORIA", "Processo n[º°]", "Autos n[º°]", "CERTIDÃO", "DESPACHO", "SENTENÇA", "DECISÃO", "OFÍCIO", "ATA DE")
ENDS = ("Documento assinado eletronicamente", "assinado digitalmente", "código verificador", "autenticidade.*conferida", "Atenciosamente", "Cordialmente", "dou fé", "nada mais")
HEADER_WORDS = ("TRIBUNAL", "PODER", "PROCESSO", "MINISTÉRIO", "DEFENSORIA")


def by_page():
    """Pages of a document in order."""
    return Window.partitionBy("doc").orderBy("page")


def density_change(words: Column, before: Column) -> Column:
    """How far a page's words differ from the page before; 0 at the start and after empty pages."""
    change = F.abs(words - before) / before
    return F.when(before.isNull() | (before == 0), 0.0).when((before > 300) & (words < 100), 0.8).when(change > 0.6, change).otherwise(0.0)


def font_change(now: Column, before: Column) -> Column:
    """1 - Jaccard similarity of two font sets where that similarity is under 0.7."""
    union = F.size(F.array_union(now, before))
    alike = F.size(F.array_intersect(now, before)) / F.nullif(union, F.lit(0))
    return F.when(before.isNull() | (union == 0), 0.0).when(alike < 0.7, 1 - alike).otherwise(0.0)


def neighbourhood(words: Column, reach: int = 3) -> Column:
    """Half the share of the neighbours within `reach` pages whose word counts are very different."""
    near = F.filter(F.array(*[F.lag(words, k).over(by_page()) for k in (*range(-reach, 0), *range(1, reach + 1))]), lambda x: x > 0)
    far = F.size(F.filter(near, lambda x: F.least(x, words) / F.greatest(x, words) < 0.3))
    return F.when((words > 0) & (F.size(near) > 0), far * 0.5 / F.size(near)).otherwise(0.0)


def _hits(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [text.rlike(f"(?iu){p}").cast("int") for p in patterns])


def start_patterns(text: Column) -> Column:
    """0.8 for two or more opening phrases in the first 30 full lines, 0.4 for one."""
    n = _hits(F.array_join(F.slice(full_lines(text), 1, 30), "\n"), STARTS)
    return F.when(n >= 2, 0.8).when(n == 1, 0.4).otherwise(0.0)


def end_patterns(text: Column) -> Column:
    ls = full_lines(text)
    tail = F.array_join(F.slice(ls, F.greatest(F.size(ls) - 29, F.lit(1)), F.lit(30)), "\n")
    return F.when(_hits(tail, ENDS) >= 1, 0.8).otherwise(0.0)


def upper_headers(text: Column) -> Column:
    """Score of capital headings among the first five full lines."""

    def line(x: Column) -> Column:
        upper = F.regexp_count(x, F.lit(r"\p{Lu}"))
        letters = F.regexp_count(x, F.lit(r"\p{L}"))
        key = reduce(lambda a, b: a | b, [x.contains(w) for w in HEADER_WORDS])
        return F.when((F.length(x) >= 5) & (letters > 0) & (upper / letters > 0.8), F.when(key, 0.5).otherwise(0.3)).otherwise(0.0)

    scores = F.transform(F.slice(full_lines(text), 1, 5), line)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return F.least(total + F.when(F.size(F.filter(scores, lambda x: x > 0)) >= 2, 0.2).otherwise(0.0), F.lit(1.0))


def score_pages(pages: DataFrame) -> DataFrame:
    """`pages` (doc, page, text, words, fonts) with the parts of their score and start_score, end_score.

    The parts are weighed in a fixed order: patterns, density and fonts, then the mean
    with the neighbourhood, then capital headings.
    """
    parts = pages.select(
        "*",
        start_patterns(F.col("text")).alias("patterns"),
        end_patterns(F.col("text")).alias("signatures"),
        density_change(F.col("words"), F.lag("words").over(by_page())).alias("density"),
        font_change(F.col("fonts"), F.lag("fonts").over(by_page())).alias("font_change"),
        neighbourhood(F.col("words")).alias("neighbourhood"),
        upper_headers(F.col("text")).alias("headings"),
    )
    start = (F.col("patterns") * 0.3 + F.col("density") * 0.2 + F.col("font_change") * 0.2 + F.col("neighbourhood")) / 2 + F.col("headings") * 0.25
    return parts.withColumn("start_score", start).withColumn("end_score", F.col("signatures") * 0.4)


def boundaries(scored: DataFrame, start: Column, end: Column) -> DataFrame:
    """(doc, segment, start_page, end_page, pages) of the logical documents.

    A start page opens one and closes the one before; an end page that is no start
    closes it; pages between an end and the next start belong to none. Within the pages
    since the last start, a page belongs while no end page stands before it.
    """
    flagged = scored.select("doc", "page", start.cast("int").alias("_s"), (end & ~start).cast("int").alias("_e"))
    island = flagged.withColumn("segment", F.sum("_s").over(by_page())).where("segment > 0")
    w = Window.partitionBy("doc", "segment").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    kept = island.withColumn("_closed", F.coalesce(F.sum("_e").over(w), F.lit(0))).where("_closed = 0")
    return kept.groupBy("doc", "segment").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.count("*").alias("pages"))


def close_gaps(segments: DataFrame, last_page: DataFrame) -> DataFrame:
    """Segments extended to the page before the next one starts; the last to the document's end."""
    w = Window.partitionBy("doc").orderBy("start_page")
    return segments.join(last_page, "doc").withColumn("end_page", F.coalesce(F.lead("start_page").over(w) - 1, "last_page")).drop("last_page")


def mark_ranges(marks: DataFrame, last_page: DataFrame | None = None) -> DataFrame:
    """Bookmarks (doc, start_page, ord) with three readings of where each ends.

    `end_own`: the page before the next, the last one its own start; `end_total`: the
    last one the document's end; `end_kept`: as `end_total`, never before its start.
    """
    w = Window.partitionBy("doc").orderBy("start_page", "ord")
    following = F.lead("start_page").over(w) - 1
    joined = marks.join(last_page, "doc") if last_page is not None else marks.withColumn("last_page", F.col("start_page"))
    return joined.select(
        "*", F.coalesce(following, F.col("start_page")).alias("end_own"), F.coalesce(following, F.col("last_page")).alias("end_total"),
        F.greatest(F.coalesce(following, F.col("last_page")), F.col("start_page")).alias("end_kept"),
    )


def page_islands(pages: DataFrame) -> DataFrame:
    """(doc, first, last) of the runs of consecutive pages in (doc, page); one sort a document."""
    distinct = pages.select("doc", "page").distinct()
    runs = distinct.withColumn("_g", F.col("page") - F.row_number().over(by_page()))
    return runs.groupBy("doc", "_g").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page")).drop("_g")


def pages_within(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pages joined to the page ranges of their document: the range is spelled out, so the join is by equality."""
    spelled = ranges.where("end_page >= start_page").withColumn("page", F.explode(F.sequence(F.col("start_page").cast("int"), F.col("end_page").cast("int"))))
    return pages.join(spelled, ["doc", "page"])


def title(text: Column) -> Column:
    """The likeliest heading among the first eight lines longer than five characters; the first ten words without one."""
    cands = F.slice(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 5), 1, 8)

    def score(x: Column) -> Column:
        n = F.length(x)
        return (
            F.when((n >= 10) & (n <= 100), 3).otherwise(0) + F.when(x.rlike(r"^\p{Lu}"), 2).otherwise(0) - F.when(x.rlike(r"^\d"), 1).otherwise(0)
            - F.when(x.rlike(r"[.,;:]$"), 1).otherwise(0) - F.when(x.rlike(r"\. "), 1).otherwise(0)
        )

    ranked = F.array_max(F.transform(cands, lambda x, i: F.struct(score(x).alias("s"), (-i).alias("p"), x.alias("t"))))
    words = F.filter(F.split(text, "[ \n\t]"), lambda x: x != "")
    return F.coalesce(ranked["t"], F.array_join(F.slice(words, 1, 10), " "))


def size_change(w: Column, h: Column, w0: Column, h0: Column, same_required: bool = True) -> Column:
    """0.9 (0.8 where pages of a paper may differ) for a page whose size is more than 10 points from the page before."""
    changed = (F.abs(w - w0) > 10) | (F.abs(h - h0) > 10)
    return F.when(changed, 0.9 if same_required else 0.8).otherwise(0.0)


def image_signature(images: Column, width: int = 200, height: int = 100) -> Column:
    """0.7 for a page with an image small enough to be a signature."""
    return F.when(F.exists(images, lambda i: (i["width"] < width) & (i["height"] < height)), 0.7).otherwise(0.0)


def top_margin(text: Column) -> Column:
    """0.6 where the first three full lines are mostly letters once set in capitals, 0.4 for an opening phrase in them."""
    head = F.array_join(F.slice(full_lines(text), 1, 3), "\n")
    upper = F.upper(head)
    share = F.regexp_count(upper, F.lit(r"\p{Lu}")) / F.nullif(F.length(upper), F.lit(0))
    return F.when(share > 0.7, 0.6).otherwise(0.0) + F.when(_hits(head, STARTS) > 0, 0.4).otherwise(0.0)


#: What each sign of a boundary weighs; presets are other such tables.
WEIGHTS = {"patterns": 0.3, "signatures": 0.4, "density": 0.2, "fonts": 0.2, "size": 0.1, "image": 0.3, "top_margin": 0.3, "headings": 0.25}
PRESETS = {"all": WEIGHTS, "text": {**WEIGHTS, "fonts": 0.0, "size": 0.0, "image": 0.0}, "layout": {**WEIGHTS, "patterns": 0.1, "signatures": 0.2, "size": 0.3, "fonts": 0.3}}


def full_scores(pages: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """`pages` (doc, page, text, words, fonts, width, height, images) with start_score and end_score by every sign.

    The order matters: patterns, density, fonts and size are added, the sum is averaged
    with the neighbourhood, then the top margin and capital headings are added.
    """
    w = by_page()
    g = weights
    start = (
        start_patterns(F.col("text")) * g["patterns"] + density_change(F.col("words"), F.lag("words").over(w)) * g["density"] + font_change(F.col("fonts"), F.lag("fonts").over(w)) * g["fonts"]
        + size_change(F.col("width"), F.col("height"), F.lag("width").over(w), F.lag("height").over(w)) * g["size"]
    )
    start = (start + neighbourhood(F.col("words"))) / 2 + top_margin(F.col("text")) * g["top_margin"] + upper_headers(F.col("text")) * g["headings"]
    return pages.withColumn("start_score", start).withColumn("end_score", end_patterns(F.col("text")) * g["signatures"] + image_signature(F.col("images")) * g["image"])


def merge_orphans(segments: DataFrame, first_page: DataFrame) -> DataFrame:
    """Pages before a document's first segment go to that segment."""
    w = Window.partitionBy("doc").orderBy("start_page")
    first = F.row_number().over(w) == 1
    return segments.join(first_page, "doc").withColumn("start_page", F.when(first, F.least("start_page", "first_page")).otherwise(F.col("start_page"))).drop("first_page")


def size_checked(pages: DataFrame, segments: DataFrame, tolerance: float = 10, least: int = 1) -> DataFrame:
    """Segments of at least `least` pages, and whether all of their pages have the first one's paper size."""
    met = pages_within(pages.select("doc", "page", "width", "height"), segments)
    first = F.min_by(F.struct("width", "height"), "page")
    box = met.groupBy("doc", "start_page", "end_page").agg(first.alias("f"), *[f(c).alias(f"{n}_{c}") for c in ("width", "height") for f, n in ((F.min, "a"), (F.max, "b"))], F.count("*").alias("pages"))
    near = [F.abs(F.col(f"{n}_{c}") - F.col(f"f.{c}")) <= tolerance for c in ("width", "height") for n in ("a", "b")]
    return box.where(F.col("pages") >= least).select("doc", "start_page", "end_page", "pages", F.coalesce(reduce(lambda a, b: a & b, near), F.lit(False)).alias("same_size"))


def anchored_windows(pages: DataFrame, windows: DataFrame, anchors: dict[str, Sequence[str]], template: Sequence[str]) -> DataFrame:
    """Page windows with the anchors they have and the share of the template's words that stand in them, ranked by document.

    The greatest share comes first, then the most anchors, then the earliest and shortest.
    """
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(unaccent(F.col("text"))), "[^a-z0-9]+", " ")), " "))
    norm = F.lower(unaccent(F.col("text")))
    hits = [reduce(lambda a, b: a | b, [F.contains(norm, F.lit(x)) for x in xs]).alias(f"_{k}") for k, xs in anchors.items()]
    seen = pages.select("doc", "page", F.array_intersect(words, F.array(*map(F.lit, template))).alias("_words"), *hits)
    met = pages_within(seen, windows).groupBy("doc", "start_page", "end_page").agg(F.size(F.array_distinct(F.flatten(F.collect_list("_words")))).alias("_n"), *[F.bool_or(f"_{k}").alias(f"_{k}") for k in anchors])
    found = F.array_compact(F.array(*[F.when(F.col(f"_{k}"), k) for k in anchors]))
    out = met.select("doc", "start_page", "end_page", F.round(F.col("_n") / len(template), 6).alias("share"), F.size(found).alias("anchors"), F.array_join(found, ",").alias("found"))
    w = Window.partitionBy("doc").orderBy(F.desc("share"), F.desc("anchors"), "start_page", "end_page")
    return out.withColumn("rank", F.row_number().over(w))


def verdicts(windows: DataFrame, share: float = 0.5, anchors: int = 1, pages: int = 2) -> DataFrame:
    """Whether a ranked window is taken, or the first reason against it."""
    reason = (
        F.when(F.col("end_page") - F.col("start_page") + 1 < pages, "page_count").when(F.col("anchors") < anchors, "anchors").when(F.col("share") < share, "share").when(F.col("rank") > 1, "rank").otherwise("")
    )
    return windows.select("doc", "start_page", "end_page", (reason == "").alias("taken"), reason.alias("reason"))


def adjusted_ranges(pages: DataFrame, ranges: DataFrame, head: Column, foot: Column, least: int = 2, most: int = 6) -> DataFrame:
    """Ranges taken one page back on to a page with a heading, and on to the first page with a footer.

    A range has at least `least` pages where the document has them and at most `most`;
    where it holds no footer it goes on to the next page that has one.
    """
    w = by_page()
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    known = pages.select("doc", "page", F.lag(head).over(w).alias("_head"), F.min(F.when(foot, F.col("page"))).over(ahead).alias("_foot"), F.max("page").over(Window.partitionBy("doc")).alias("_last"))
    at = known.select("doc", F.col("page").alias("start_page"), "_head", "_last")
    moved = ranges.join(at, ["doc", "start_page"]).withColumn("new_start", F.col("start_page") - F.when(F.coalesce("_head", F.lit(False)), 1).otherwise(0))
    foots = known.select("doc", F.col("page").alias("new_start"), "_foot")
    j = moved.join(foots, ["doc", "new_start"])
    end = F.greatest(F.col("end_page"), F.least(F.col("new_start") + least - 1, F.col("_last")))
    limit = F.least(F.col("_last"), F.col("new_start") + most - 1)
    end = F.when(F.col("_foot") <= end, end).otherwise(F.greatest(end, F.least(F.coalesce("_foot", limit), limit)))
    return j.select("doc", "start_page", "end_page", "new_start", F.least(end, F.col("new_start") + most - 1).alias("new_end"))


def split_at(marks: DataFrame, pattern: str) -> DataFrame:
    """The parts that bookmarks of a title cut out of a document: each goes to the page before the next bookmark of any title."""
    w = Window.partitionBy("doc").orderBy("start_page", "ord")
    ends = marks.withColumn("end_page", F.coalesce(F.lead("start_page").over(w) - 1, "last_page"))
    return ends.where(F.col("title").rlike(f"(?iu){pattern}")).select("doc", "start_page", F.greatest("end_page", "start_page").alias("end_page"), "title")


def without_generic(papers: DataFrame, special: Column) -> DataFrame:
    """Papers (doc, start_page, kind), less those that aren't special where a special one of their kind starts on the same page."""
    flagged = papers.withColumn("_s", F.coalesce(special, F.lit(False)))
    chosen = flagged.where("_s").select("doc", "start_page", "kind").distinct()
    return flagged.where("_s").unionByName(flagged.where("not _s").join(chosen, ["doc", "start_page", "kind"], "left_anti")).drop("_s")


def paragraphs(lines: DataFrame, gap: float) -> DataFrame:
    """`lines` (doc, page, ord, top, bottom) with the paragraph, from 0, that each stands in.

    From the top down, a line opens a paragraph where its top is more than `gap` below
    the lowest bottom so far: that of all lines is that of the paragraph, for paragraphs follow each other down the page.
    """
    w = Window.partitionBy("doc", "page").orderBy(F.desc((F.col("top") + F.col("bottom")) / 2), "ord")
    lowest = F.min("bottom").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = lines.withColumn("_new", F.when(lowest - F.col("top") > gap, 1).otherwise(0))
    return opened.withColumn("paragraph", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")
