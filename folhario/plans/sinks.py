"""Forms of output: modes, workbook sheets, envelopes, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folhario.operators import extract, store
from folhario.plans.base import Plans
from folhario.plans.records import COVER, LONG
from folhario.runtime import table
from folhario.sources import corpus, files

plan = Plans()


def _long(spark, sf_dir):
    return extract.long_form(table(spark, sf_dir, "dados_diretoria_especial_v5"), "rec_id", COVER)


@plan("WITH l AS (" + LONG + ") SELECT rec_id, " + ", ".join(f"min(value) FILTER (field = '{c}') AS {c}" for c in COVER) + " FROM l GROUP BY rec_id")
def workbook_wide(spark, sf_dir):
    return store.workbook(_long(spark, sf_dir), "rec_id", COVER)["wide"]


@plan("WITH l AS (" + LONG + ") SELECT field, count(value) AS found, count(*) AS rows, count(DISTINCT value) AS different FROM l GROUP BY field")
def workbook_summary(spark, sf_dir):
    return store.workbook(_long(spark, sf_dir), "rec_id", COVER)["summary"]


@plan(" SELECT doc, page, words, chars, length(coalesce(header, '')) AS h FROM p", pages=True)
def load_mode_text(spark, sf_dir):
    return files.load_mode(corpus.pages(spark, sf_dir), "text").select("doc", "page", "words", "chars", F.length(F.coalesce("header", F.lit(""))).cast("bigint").alias("h"))


@plan(" SELECT doc, page, CAST(images AS INT) AS images FROM p WHERE images > 0", pages=True)
def load_mode_images(spark, sf_dir):
    return files.load_mode(corpus.pages(spark, sf_dir), "images-only")


@plan(" SELECT doc, count(*) AS n FROM p WHERE contains(strip_accents(lower(text)), 'laudo') GROUP BY doc", pages=True)
def result_counts(spark, sf_dir):
    from folhario.functions import terms

    return store.count_report(corpus.pages(spark, sf_dir).where(terms.matches(F.col("text"), "laudo")), "doc")


@plan(", h AS (SELECT doc, page, words FROM p WHERE contains(strip_accents(lower(text)), 'laudo')) SELECT doc, '{\"found\":' || count(*) || ',\"words\":\"laudo\",\"pages\":[' || string_agg('{\"page\":' || page || ',\"words\":' || words || '}', ',' ORDER BY page) || ']}' AS body FROM h GROUP BY doc", pages=True)
def result_envelopes(spark, sf_dir):
    from folhario.functions import terms

    hits = corpus.pages(spark, sf_dir).where(terms.matches(F.col("text"), "laudo")).select("doc", "page", "words")
    return store.result_envelope(hits, "doc", "pages", "page", words="laudo", regex=None)


@plan(", b AS (SELECT cache_id AS path, 1 AS n FROM caches WHERE false) SELECT CAST(doc AS BIGINT) AS path, CAST(page AS INT) AS entry, CAST(coalesce(sum(images + 1) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS INT) AS start_page, CAST(sum(images + 1) OVER (PARTITION BY doc ORDER BY page) AS INT) AS end_page FROM p", pages=True)
def archive_book(spark, sf_dir):
    entries = corpus.pages(spark, sf_dir).select(F.col("doc").alias("path"), F.col("page").alias("entry"), F.lit("x.pdf").alias("name"), (F.col("images") + 1).alias("pages"))
    return files.book_of(entries).drop("title")


QUERIES, SQL = plan.queries, plan.sql
