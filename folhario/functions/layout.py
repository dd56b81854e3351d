"""Page geometry, scan decisions, name-based classes: small CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name -> width, height in points (fixed values).
PAPERS = {"Letter": (612, 792), "A4": (595, 842), "Legal": (612, 1008), "A5": (420, 595), "A3": (842, 1191)}
CATEGORIES = {"A4": (595, 842), "A3": (842, 1191), "Letter": (612, 792), "B5": (744, 1052)}
#: Signs of a signature, and the ways it is put around a name (fixed values).
SIGNS = ("____", "Assinado por", "Signed by", "Assinatura", "Signature", "Assinado digitalmente", "Digitally signed", "Certificado digital", "Digital certificate")
PHRASES = ("{}", "Assinado por {}", "Signed by {}", "Por: {}", "By: {}", "{} (assinado digitalmente)", "{} (digitally signed)")


def paper_size(w: Column, h: Column) -> Column:
    """The first paper whose sides are within 2 points, else Custom."""
    out = None
    for name, (pw, ph) in PAPERS.items():
        hit = (F.abs(w - pw) <= 2) & (F.abs(h - ph) <= 2)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Custom")


def size_category(w: Column, h: Column) -> Column:
    out = None
    for name, (pw, ph) in CATEGORIES.items():
        hit = (F.abs(w - pw) < 10) & (F.abs(h - ph) < 10)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    area = w * h
    return out.when(area > 1_000_000, "Muito-Grande").when(area > 700_000, "Grande").when(area > 400_000, "Médio").otherwise("Pequeno")


def orientation(w: Column, h: Column) -> Column:
    return F.when(w > h, "landscape").otherwise("portrait")


def inches(c: Column) -> Column:
    return c / 72


def millimetres(c: Column) -> Column:
    return c * 0.352778


def scanned_no_words(words: Column, images: Column) -> Column:
    return (words == 0) & (images > 0)


def scanned_few_words(words: Column, images: Column) -> Column:
    return (images > 0) & (words < 50)


def scan_confidence(words: Column, images: Column) -> Column:
    """How surely a page is a scan, 0 to 95; a page with images counts as one with a large image."""
    return (
        F.when((images > 0) & (words < 50), 95)
        .when(images.between(1, 5) & (words < 200), 85)
        .when((images > 5) & (words < 150), 80)
        .when((images > 0) & (words < 300), 75)
        .when((images > 0) & (words < 100), 70)
        .when((images > 0) & (words < 500), 50)
        .otherwise(0)
    )


def page_kind(chars: Column, images: Column) -> Column:
    """Empty, Text, ScannedImage, Mixed or Unknown by characters and images."""
    return (
        F.when((chars == 0) & (images == 0), "Empty")
        .when((chars > 50) & (images == 0), "Text")
        .when((chars < 50) & (images > 0), "ScannedImage")
        .when((chars > 50) & (images > 0), "Mixed")
        .when((chars <= 50) & (chars > 0), "ScannedImage")
        .otherwise("Unknown")
    )


def document_class(scanned: Column, total: Column) -> Column:
    ratio = scanned * 100.0 / total
    return F.when(total == 0, "empty").when(ratio >= 90, "scanned").when(ratio >= 50, "mixed").otherwise("text")


def font_flags(name: Column) -> dict[str, Column]:
    low = F.lower(name)
    return {
        "bold": low.contains("bold") | low.contains("black"),
        "italic": low.contains("italic") | low.contains("oblique"),
        "mono": name.contains("Courier") | name.contains("Mono"),
        "serif": name.contains("Times") | name.contains("Serif"),
        "sans": name.contains("Arial") | name.contains("Helvetica") | name.contains("Sans"),
    }


def signed_by(text: Column, pattern: str) -> Column:
    """Whether a page looks signed by one of the names (`|`) or all of them (`&`).

    The last 30 % of the page must hold the name or a phrase around it; or the page
    holds both a name of three letters or more and a sign of a signature; or the name
    itself is such a sign.
    """
    mark = "|" if "|" in pattern else "&" if "&" in pattern else ""
    names = [n.strip() for n in (pattern.split(mark) if mark else [pattern]) if n.strip()]
    low = F.lower(text)
    tail = F.substr(low, (F.floor(F.length(text) * 0.7) + 1).cast("int"))
    any_sign = F.lit(False)
    for s in SIGNS:
        any_sign = any_sign | low.contains(s.lower())

    def one(n: str) -> Column:
        hit = F.lit(False)
        for p in PHRASES:
            hit = hit | tail.contains(p.format(n).lower())
        if len(n) > 2:
            hit = hit | low.contains(n.lower()) & any_sign
        if any(s.lower() in n.lower() for s in SIGNS):
            hit = hit | low.contains(n.lower())
        return hit

    out = F.lit(mark == "&") if names else F.lit(False)
    for n in names:
        out = out & one(n) if mark == "&" else out | one(n)
    return F.coalesce((F.length(text) > 0) & out, F.lit(False))


def doc_key(canon: Column, seq: Column, page: Column, safe: bool = False) -> Column:
    key = F.concat(canon, F.lit("_"), F.lpad(seq.cast("string"), 3, "0"), F.lit("_"), F.lpad(page.cast("string"), 4, "0"))
    return F.regexp_replace(F.lower(key), "[^a-z0-9_]", "") if safe else key


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def normalised_box(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column) -> list[Column]:
    """A box as parts of the page's width and height, kept within it."""
    return [clamp01(x0 / w), clamp01(y0 / h), clamp01(x1 / w), clamp01(y1 / h)]


def band(y_centre: Column) -> Column:
    """The horizontal band of a line by its centre, 0 at the foot of the page."""
    return F.when(y_centre >= 0.85, "header").when(y_centre >= 0.70, "subheader").when(y_centre <= 0.15, "footer").otherwise("body")


def magic(b: Column) -> Column:
    """What a file is by its first bytes."""
    h = F.hex(b)
    return (
        F.when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("89504E47"), "png").when(h.startswith("47494638"), "gif").when(h.startswith("424D"), "bmp")
        .when(h.startswith("49492A00") | h.startswith("4D4D002A"), "tiff").when(h.startswith("25504446"), "pdf").when(h.startswith("504B0304"), "zip").otherwise("unknown")
    )


def base64_parts(df: DataFrame, text: str, least: int = 20) -> DataFrame:
    """A row for each run in a text that may be base64: its place in order, length, whether it can be decoded, bytes, kind, and what stands before it."""
    runs = F.regexp_extract_all(text, F.lit(rf"[A-Za-z0-9+/]{{{least},}}={{0,2}}"), F.lit(0))
    each = df.select("*", F.posexplode(runs).alias("_i", "_b"))
    binary = F.when(F.length("_b") % 4 == 0, F.try_to_binary("_b", F.lit("base64")))
    at = F.instr(F.col(text), F.col("_b"))
    return each.withColumn("_x", binary).select(
        *df.columns, (F.col("_i") + 1).alias("n"), F.length("_b").alias("chars"), F.col("_x").isNotNull().alias("decodable"), F.octet_length("_x").cast("bigint").alias("bytes"),
        magic(F.col("_x")).alias("kind"), F.substring(F.col(text), F.greatest(at - 50, F.lit(1)), F.least(at - 1, F.lit(50))).alias("before"),
    )
