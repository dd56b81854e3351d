"""Rollups, distributions, windows and segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folhario.functions import layout, text
from folhario.operators import compare, segment
from folhario.plans.base import Plans
from folhario.runtime import table
from folhario.sources import corpus

plan = Plans()

HEADERS = """SELECT doc, page, array_to_string(list_slice(string_split(text, chr(10)), 1, 5), chr(10)) AS header5,
 array_to_string(list_slice(string_split(text, chr(10)), greatest(len(string_split(text, chr(10))) - 4, 1), len(string_split(text, chr(10)))), chr(10)) AS footer5,
 list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS origin FROM p"""


@plan(HEADERS, pages=True)
def headers_footers(spark, sf_dir):
    t = F.col("text")
    return corpus.pages(spark, sf_dir).select("doc", "page", text.top_lines(t, 5).alias("header5"), text.bottom_lines(t, 5).alias("footer5"), text.nth(text.full_lines(t), 1).alias("origin"))


LINES = """, l AS (SELECT doc, page, string_split(text, chr(10)) AS ls, chars, words FROM p)
SELECT doc, page, chars, words, CAST(len(ls) AS BIGINT) AS lines, round(coalesce(list_avg(list_transform(list_filter(ls, lambda x: trim(x) <> ''), lambda x: length(x))), 0.0), 6) AS mean_line FROM l"""


@plan(LINES, pages=True)
def line_stats(spark, sf_dir):
    t = F.col("text")
    return corpus.pages(spark, sf_dir).select("doc", "page", "chars", "words", F.size(text.lines(t)).cast("bigint").alias("lines"), F.round(text.mean_line_length(t), 6).alias("mean_line"))


def _lang(words: str) -> str:
    return f"regexp_matches(coalesce(text, ''), '(?i)(?:^|$|[^\\p{{L}}\\p{{N}}_])(?:{words})(?:^|$|[^\\p{{L}}\\p{{N}}_])')"


LANGS = "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_lang(w)} THEN '{n}' END" for n, w in text.LANGUAGE_WORDS.items()) + "], lambda x: x IS NOT NULL), ',') AS langs FROM documents"


@plan(LANGS)
def language_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.languages(F.coalesce("text", F.lit(""))), ",").alias("langs"))


REFS = r", r AS (SELECT doc, page, list_distinct(list_concat(regexp_extract_all(text, 'Processo\s+n[º°]\s*[\d.-]+'), regexp_extract_all(text, 'Anexo\s+\(\d+\)'), regexp_extract_all(text, 'Ofício\s+\d+\s+(?:\(\d+\))?'), regexp_extract_all(text, 'SEI\s+\d{6}-\d{2}\.\d{4}\.\d\.\d{2}(?:\s*/\s*pg\.\s*\d+)?'))) AS refs FROM p) SELECT doc, page, unnest(refs) AS ref FROM r"


@plan(REFS, pages=True)
def doc_references(spark, sf_dir):
    return corpus.pages(spark, sf_dir).select("doc", "page", F.explode(text.references(F.col("text"))).alias("ref"))


FLAGS = r"""SELECT doc, page, words = 0 AND images > 0 AS no_words, images > 0 AND words < 50 AS few_words,
 CASE WHEN images > 0 AND words < 50 THEN 95 WHEN images BETWEEN 1 AND 5 AND words < 200 THEN 85 WHEN images > 5 AND words < 150 THEN 80 WHEN images > 0 AND words < 300 THEN 75 WHEN images > 0 AND words < 100 THEN 70 WHEN images > 0 AND words < 500 THEN 50 ELSE 0 END AS confidence,
 CASE WHEN chars = 0 AND images = 0 THEN 'Empty' WHEN chars > 50 AND images = 0 THEN 'Text' WHEN chars < 50 AND images > 0 THEN 'ScannedImage' WHEN chars > 50 AND images > 0 THEN 'Mixed' WHEN chars <= 50 AND chars > 0 THEN 'ScannedImage' ELSE 'Unknown' END AS kind,
 regexp_matches(text, '(?i)R\$ ?[0-9]') AS money_strict, contains(lower(text), 'r$') OR contains(lower(text), 'honor') AS money_loose,
 regexp_matches(text, '(?:^|[^0-9A-Za-z_])(?:\d{3}\.\d{3}\.\d{3}-\d{2}|\d{11})(?:$|[^0-9A-Za-z_])') AS cpf_strict,
 regexp_matches(text, '(?:^|[^0-9A-Za-z_])\d{3}[.-]?\d{3}[.-]?\d{3}[.-]?\d{2}(?:$|[^0-9A-Za-z_])') AS cpf_loose FROM p"""


@plan(FLAGS, pages=True)
def scan_flags_all(spark, sf_dir):
    t, w, i, c = F.col("text"), F.col("words"), F.col("images"), F.col("chars")
    return corpus.pages(spark, sf_dir).select(
        "doc", "page", layout.scanned_no_words(w, i).alias("no_words"), layout.scanned_few_words(w, i).alias("few_words"), layout.scan_confidence(w, i).alias("confidence"), layout.page_kind(c, i).alias("kind"),
        text.has_money_strict(t).alias("money_strict"), text.has_money_loose(t).alias("money_loose"), text.has_cpf_strict(t).alias("cpf_strict"), text.has_cpf_loose(t).alias("cpf_loose"),
    )


@plan(", s AS (SELECT doc, page, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS g FROM p WHERE images > 0), r AS (SELECT doc, min(page) AS a, max(page) AS b FROM s GROUP BY doc, g) SELECT doc, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM r GROUP BY doc", pages=True)
def scanned_page_ranges(spark, sf_dir):
    r = segment.page_islands(corpus.pages(spark, sf_dir).where("images > 0"))
    a, b = F.col("first_page"), F.col("last_page")
    # a document's ranges are at most as many as its pages
    listed = r.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("first_page", "last_page"))).alias("rs"))
    span = lambda x: F.when(x["first_page"] == x["last_page"], x["first_page"].cast("string")).otherwise(F.concat_ws("-", x["first_page"], x["last_page"]))
    del a, b
    return listed.select("doc", F.array_join(F.transform("rs", lambda x: span(x)), ",").alias("ranges"))


ROLLUP = """SELECT doc, count(*) AS pages, CAST(sum(words) AS BIGINT) AS words, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(images) AS BIGINT) AS images, CAST(sum(words) AS BIGINT) // count(*) AS words_a_page,
 count(*) FILTER (images > 0) AS pages_with_images, round(100.0 * avg(CASE WHEN images > 0 AND words < 150 THEN 1.0 ELSE 0.0 END), 2) AS scan_pct FROM p GROUP BY doc"""


@plan(ROLLUP, pages=True)
def doc_rollup(spark, sf_dir):
    g = corpus.pages(spark, sf_dir).groupBy("doc").agg(
        F.count("*").alias("pages"), F.sum("words").alias("words"), F.sum("chars").alias("chars"), F.sum("images").cast("bigint").alias("images"),
        F.count_if(F.col("images") > 0).alias("pages_with_images"), F.round(100 * F.avg(F.when((F.col("images") > 0) & (F.col("words") < 150), 1.0).otherwise(0.0)), 2).alias("scan_pct"),
    )
    return g.withColumn("words_a_page", F.floor(F.col("words") / F.col("pages")).cast("bigint"))


QUICK = """, d AS (SELECT doc, count(*) AS n, count(*) FILTER (images > 0 AND words < 150) AS s FROM p GROUP BY doc)
SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS pages, count(*) FILTER (s * 100.0 / n >= 90) AS scanned, count(*) FILTER (s * 100.0 / n >= 50 AND s * 100.0 / n < 90) AS mixed, count(*) FILTER (s * 100.0 / n < 50) AS text, CAST(sum(s) AS BIGINT) AS scanned_pages, round(avg(CASE WHEN s * 100.0 / n >= 50 THEN s * 100.0 / n END), 6) AS mean_pct FROM d"""


@plan(QUICK, pages=True)
def corpus_quick_stats(spark, sf_dir):
    d = corpus.pages(spark, sf_dir).groupBy("doc").agg(F.count("*").alias("n"), F.count_if((F.col("images") > 0) & (F.col("words") < 150)).alias("s"))
    k, pct = layout.document_class(F.col("s"), F.col("n")), F.col("s") * 100.0 / F.col("n")
    return d.agg(F.count("*").alias("docs"), F.sum("n").alias("pages"), F.count_if(k == "scanned").alias("scanned"), F.count_if(k == "mixed").alias("mixed"), F.count_if(k == "text").alias("text"), F.sum("s").alias("scanned_pages"), F.round(F.avg(F.when(pct >= 50, pct)), 6).alias("mean_pct"))


@plan("WITH t AS (SELECT p_size AS size, count(*) AS n FROM part GROUP BY p_size) SELECT size, n, round(100.0 * n / sum(n) OVER (), 4) AS pct FROM t ORDER BY n DESC, size LIMIT 10")
def size_distribution(spark, sf_dir):
    t = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("size")).agg(F.count("*").alias("n"))
    total = t.agg(F.sum("n").alias("total"))
    return t.crossJoin(F.broadcast(total)).select("size", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("pct")).orderBy(F.desc("n"), "size").limit(10)


TOP = """WITH v AS (SELECT rec_id, trim(comarca) AS v FROM dados_diretoria_especial_v5 WHERE trim(comarca) <> ''), g AS (SELECT lower(v) AS k, count(*) AS n, arg_min(v, rec_id) AS value, min(rec_id) AS sample FROM v GROUP BY lower(v))
SELECT value, n, sample FROM g ORDER BY n DESC, k LIMIT 20"""


@plan(TOP)
def top_values(spark, sf_dir):
    v = table(spark, sf_dir, "dados_diretoria_especial_v5").select("rec_id", F.trim("comarca").alias("v")).where("v <> ''")
    g = v.groupBy(F.lower("v").alias("k")).agg(F.count("*").alias("n"), F.min_by("v", "rec_id").alias("value"), F.min("rec_id").alias("sample"))
    return g.orderBy(F.desc("n"), "k").limit(20).select("value", "n", "sample")


FILLED = ("process_number", "extraction_mode", "source", "cache_name")


@plan("SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (trim({c}) <> '') AS {c}_filled" for c in FILLED) + ", CAST(sum(size_bytes) AS BIGINT) AS size_sum, CAST(sum(doc_total_pages) AS BIGINT) AS pages_sum FROM caches")
def meta_fill_counts(spark, sf_dir):
    d = table(spark, sf_dir, "caches")
    return d.agg(F.count("*").alias("n"), *[F.count_if(F.trim(c) != "").alias(f"{c}_filled") for c in FILLED], F.sum("size_bytes").cast("bigint").alias("size_sum"), F.sum("doc_total_pages").alias("pages_sum"))


LINE_ROWS = ", l AS (SELECT doc, page, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS line FROM p)"


@plan(LINE_ROWS + " SELECT line, count(*) AS n FROM l GROUP BY line HAVING count(*) > 1 ORDER BY n DESC, line LIMIT 10", pages=True)
def repeat_lines(spark, sf_dir):
    lines = compare.page_lines(corpus.pages(spark, sf_dir))
    return lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "line").limit(10)


@plan(", f AS (SELECT doc, unnest(string_split(footer, chr(10))) AS line FROM p WHERE footer IS NOT NULL), g AS (SELECT doc, line, count(*) AS n FROM f WHERE trim(line) <> '' GROUP BY doc, line) SELECT doc, line, n FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, line) AS r FROM g) WHERE r = 1", pages=True)
def footer_mode(spark, sf_dir):
    f = corpus.pages(spark, sf_dir).where("footer is not null").select("doc", F.explode(F.split("footer", "\n")).alias("line")).where("trim(line) <> ''")
    g = f.groupBy("doc", "line").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc").orderBy(F.desc("n"), "line")
    return g.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


@plan(LINE_ROWS + ", n AS (SELECT count(DISTINCT doc) AS n FROM l) SELECT line, docs FROM (SELECT line, count(DISTINCT doc) AS docs FROM l GROUP BY line) WHERE docs >= (SELECT n FROM n) * 0.05", pages=True)
def template_lines(spark, sf_dir):
    return compare.template_lines(compare.page_lines(corpus.pages(spark, sf_dir)), 0.05)


@plan(LINE_ROWS + ", n AS (SELECT count(DISTINCT doc) AS n FROM l), t AS (SELECT line FROM l GROUP BY line HAVING count(DISTINCT doc) >= (SELECT n FROM n) * 0.05) SELECT doc, count(*) AS lines FROM l WHERE line NOT IN (SELECT line FROM t) GROUP BY doc", pages=True)
def template_variants(spark, sf_dir):
    lines = compare.page_lines(corpus.pages(spark, sf_dir))
    return compare.variants(lines, compare.template_lines(lines, 0.05)).groupBy("doc").agg(F.count("*").alias("lines"))


VERSIONS = ", pair AS (SELECT a.cache_id AS old_doc, a.cache_id + 1 AS new_doc FROM caches a JOIN caches b ON b.cache_id = a.cache_id + 1 WHERE a.cache_id % 2 = 1)"
WORDS = VERSIONS + """, o AS (SELECT x.old_doc AS k, p.page, unnest(list_filter(string_split_regex(text, '[ \\n\\t]'), lambda x: x <> '')) AS word FROM p JOIN pair x ON p.doc = x.old_doc),
n AS (SELECT x.old_doc AS k, p.page, unnest(list_filter(string_split_regex(text, '[ \\n\\t]'), lambda x: x <> '')) AS word FROM p JOIN pair x ON p.doc = x.new_doc)
SELECT k, page, count(*) AS added FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k = n.k AND o.page = n.page AND lower(o.word) = lower(n.word)) GROUP BY k, page"""


def _versions(spark, sf_dir):
    """Stored analyses taken two by two as the old and the new version of one paper."""
    d = corpus.documents(spark, sf_dir).select("doc")
    pair = d.where("doc % 2 = 1").join(d.select((F.col("doc") - 1).alias("doc")), "doc", "left_semi").select(F.col("doc").alias("k"))
    p = corpus.pages(spark, sf_dir)
    old = p.join(pair, F.col("doc") == F.col("k"))
    new = p.join(pair, F.col("doc") - 1 == F.col("k"))
    return old.withColumn("doc", F.col("k")), new.withColumn("doc", F.col("k"))


@plan(WORDS, pages=True)
def true_diff_words(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return compare.added(compare.page_words(old), compare.page_words(new), "word", ("doc", "page")).groupBy(F.col("doc").alias("k"), "page").agg(F.count("*").alias("added"))


LASTS = VERSIONS + """, ol AS (SELECT x.old_doc AS k, p.page, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS line FROM p JOIN pair x ON p.doc = x.old_doc),
nl AS (SELECT x.old_doc AS k, p.page, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS line FROM p JOIN pair x ON p.doc = x.new_doc)
SELECT k, page, line FROM nl WHERE NOT EXISTS (SELECT 1 FROM ol WHERE ol.k = nl.k AND ol.page = nl.page AND lower(ol.line) = lower(nl.line))"""


@plan(LASTS, pages=True)
def last_session(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return compare.added(compare.page_lines(old), compare.page_lines(new), "line", ("doc", "page")).select(F.col("doc").alias("k"), "page", "line")


@plan("SELECT a.cache_id AS k, CASE WHEN a.created_at IS NULL OR b.created_at IS NULL THEN 'unknown' WHEN b.created_at > a.created_at THEN 'later' WHEN b.created_at < a.created_at THEN 'earlier' ELSE 'same' END AS verdict FROM caches a JOIN caches b ON b.cache_id = a.cache_id + 1 WHERE a.cache_id % 2 = 1")
def ts_verdict(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).select("doc", "created_at")
    new = d.select((F.col("doc") - 1).alias("doc"), F.col("created_at").alias("new_at"))
    return d.where("doc % 2 = 1").join(new, "doc").select(F.col("doc").alias("k"), compare.verdict(F.col("created_at"), F.col("new_at")).alias("verdict"))


LAG = """, s AS (SELECT doc, page, words, fonts, lag(words) OVER w AS pw, lag(fonts) OVER w AS pf FROM p WINDOW w AS (PARTITION BY doc ORDER BY page)),
j AS (SELECT *, len(list_distinct(list_concat(fonts, pf))) AS u, len(list_distinct(list_intersect(fonts, pf))) AS i FROM s)
SELECT doc, page, round(CASE WHEN pw IS NULL OR pw = 0 THEN 0.0 WHEN pw > 300 AND words < 100 THEN 0.8 WHEN abs(words - pw) / pw::DOUBLE > 0.6 THEN abs(words - pw) / pw::DOUBLE ELSE 0.0 END, 6) AS density,
 round(CASE WHEN pf IS NULL OR u = 0 THEN 0.0 WHEN i / u::DOUBLE < 0.7 THEN 1 - i / u::DOUBLE ELSE 0.0 END, 6) AS fonts FROM j"""


@plan(LAG, pages=True)
def segment_density_lag(spark, sf_dir):
    p = corpus.pages(spark, sf_dir).select("doc", "page", "words", "fonts")
    w = segment.by_page()
    return p.select("doc", "page", F.round(segment.density_change(F.col("words"), F.lag("words").over(w)), 6).alias("density"), F.round(segment.font_change(F.col("fonts"), F.lag("fonts").over(w)), 6).alias("fonts"))


NEAR = ", ".join(f"{'lag' if k < 0 else 'lead'}(words, {abs(k)}) OVER w" for k in (-3, -2, -1, 1, 2, 3))
NEIGHBOURS = f""", s AS (SELECT doc, page, words, list_filter([{NEAR}], lambda x: x > 0) AS near FROM p WINDOW w AS (PARTITION BY doc ORDER BY page))
SELECT doc, page, round(CASE WHEN words > 0 AND len(near) > 0 THEN len(list_filter(near, lambda x: least(x, words) / greatest(x, words)::DOUBLE < 0.3)) * 0.5 / len(near) ELSE 0.0 END, 6) AS score FROM s"""


@plan(NEIGHBOURS, pages=True)
def segment_neighbourhood(spark, sf_dir):
    return corpus.pages(spark, sf_dir).select("doc", "page", F.round(segment.neighbourhood(F.col("words")), 6).alias("score"))


def _count(patterns) -> str:
    return " + ".join(f"CAST(regexp_matches(t, '(?i){p}') AS INT)" for p in patterns)


START = f""", f AS (SELECT doc, page, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM p),
a AS (SELECT doc, page, ls, array_to_string(list_slice(ls, 1, 30), chr(10)) AS t FROM f), b AS (SELECT doc, page, {_count(segment.STARTS)} AS n FROM a),
c AS (SELECT doc, page, array_to_string(list_slice(ls, greatest(len(ls) - 29, 1), len(ls)), chr(10)) AS t FROM f), d AS (SELECT doc, page, {_count(segment.ENDS)} AS m FROM c)
SELECT b.doc, b.page, CASE WHEN n >= 2 THEN 0.8 WHEN n = 1 THEN 0.4 ELSE 0.0 END::DOUBLE AS patterns, CASE WHEN m >= 1 THEN 0.8 ELSE 0.0 END::DOUBLE AS signatures FROM b JOIN d ON b.doc = d.doc AND b.page = d.page"""


@plan(START, pages=True)
def segment_start_score(spark, sf_dir):
    t = F.col("text")
    return corpus.pages(spark, sf_dir).select("doc", "page", segment.start_patterns(t).alias("patterns"), segment.end_patterns(t).alias("signatures"))


HEADINGS = r""", f AS (SELECT doc, page, list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 1, 5) AS ls FROM p),
s AS (SELECT doc, page, list_transform(ls, lambda x: CASE WHEN length(x) >= 5 AND len(regexp_extract_all(x, '\p{L}')) > 0 AND len(regexp_extract_all(x, '\p{Lu}')) / len(regexp_extract_all(x, '\p{L}'))::DOUBLE > 0.8 THEN CASE WHEN regexp_matches(x, 'TRIBUNAL|PODER|PROCESSO|MINISTÉRIO|DEFENSORIA') THEN 0.5 ELSE 0.3 END ELSE 0.0 END::DOUBLE) AS sc FROM f)
SELECT doc, page, round(least(coalesce(list_sum(sc), 0.0) + CASE WHEN len(list_filter(sc, lambda x: x > 0)) >= 2 THEN 0.2 ELSE 0.0 END, 1.0), 6) AS score FROM s"""


@plan(HEADINGS, pages=True)
def segment_headings(spark, sf_dir):
    return corpus.pages(spark, sf_dir).select("doc", "page", F.round(segment.upper_headers(F.col("text")), 6).alias("score"))


BOUNDS = """, f AS (SELECT doc, page, words, CAST(page_type IN ('despacho', 'oficio') AS INT) AS s, CAST(words < 120 AND page_type NOT IN ('despacho', 'oficio') AS INT) AS e FROM p WHERE page_type IS NOT NULL),
i AS (SELECT *, sum(s) OVER (PARTITION BY doc ORDER BY page) AS segment FROM f),
k AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc, segment ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM i WHERE segment > 0)
SELECT doc, CAST(segment AS BIGINT) AS segment, min(page) AS start_page, max(page) AS end_page, count(*) AS pages FROM k WHERE closed = 0 GROUP BY doc, segment"""


def _segments(spark, sf_dir):
    p = corpus.pages(spark, sf_dir).where("page_type is not null")
    start = F.col("page_type").isin("despacho", "oficio")
    return segment.boundaries(p, start, (F.col("words") < 120) & ~start)


@plan(BOUNDS, pages=True)
def boundary_states(spark, sf_dir):
    return _segments(spark, sf_dir)


@plan(BOUNDS.replace("SELECT doc, CAST(segment", ", z AS (SELECT doc, CAST(segment", 1) + ") SELECT z.doc, z.segment, z.start_page, coalesce(lead(z.start_page) OVER (PARTITION BY z.doc ORDER BY z.start_page) - 1, l.last_page) AS end_page, z.pages FROM z JOIN (SELECT doc, max(page) AS last_page FROM p GROUP BY doc) l ON l.doc = z.doc", pages=True)
def boundary_closed_gaps(spark, sf_dir):
    last = corpus.pages(spark, sf_dir).groupBy("doc").agg(F.max("page").alias("last_page"))
    return segment.close_gaps(_segments(spark, sf_dir), last)


SEGROLL = BOUNDS.replace("SELECT doc, CAST(segment", ", z AS (SELECT doc, CAST(segment", 1) + """) SELECT z.doc, z.segment, count(*) AS pages, CAST(sum(p.words) AS BIGINT) AS words, CAST(sum(p.chars) AS BIGINT) AS chars, CAST(sum(p.images) AS BIGINT) AS images, bool_or(p.images > 0) AS any_image, round(100.0 * avg(CASE WHEN p.words = 0 AND p.images > 0 THEN 1.0 ELSE 0.0 END), 2) AS scan_pct FROM z JOIN p ON p.doc = z.doc AND p.page BETWEEN z.start_page AND z.end_page GROUP BY z.doc, z.segment"""


@plan(SEGROLL, pages=True)
def segment_rollup(spark, sf_dir):
    met = segment.pages_within(corpus.pages(spark, sf_dir), _segments(spark, sf_dir).drop("pages"))
    return met.groupBy("doc", "segment").agg(
        F.count("*").alias("pages"), F.sum("words").alias("words"), F.sum("chars").alias("chars"), F.sum("images").cast("bigint").alias("images"), F.bool_or(F.col("images") > 0).alias("any_image"),
        F.round(100 * F.avg(F.when((F.col("words") == 0) & (F.col("images") > 0), 1.0).otherwise(0.0)), 2).alias("scan_pct"),
    )


DET = {k: v.replace("'", "''") for k, v in text.DETECTORS.items()}
SUMMARY = "SELECT doc, count(*) AS pages, max(words) AS most_words, min(words) AS least_words, count(*) FILTER (words <= 10) AS blank, count(*) FILTER (images > 0) AS with_images, " + ", ".join(f"count(*) FILTER (regexp_matches(text, '{v}')) AS n_{k}" for k, v in DET.items()) + " FROM p GROUP BY doc"


@plan(SUMMARY, pages=True)
def characteristics_summary(spark, sf_dir):
    p = corpus.pages(spark, sf_dir)
    return p.groupBy("doc").agg(F.count("*").alias("pages"), F.max("words").alias("most_words"), F.min("words").alias("least_words"), F.count_if(F.col("words") <= 10).alias("blank"), F.count_if(F.col("images") > 0).alias("with_images"), *[F.count_if(F.col("text").rlike(v)).alias(f"n_{k}") for k, v in text.DETECTORS.items()])


UNIQUE = ", f AS (SELECT doc, page, words, " + ", ".join(f"regexp_matches(text, '{v}') AS {k}" for k, v in DET.items()) + " FROM p), c AS (SELECT *, " + ", ".join(f"count(*) FILTER ({k}) OVER (PARTITION BY doc) AS c_{k}" for k in DET) + ", max(words) OVER (PARTITION BY doc) AS mx, count(*) OVER (PARTITION BY doc, words) AS cw FROM f) SELECT doc, page, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {k} AND c_{k} = 1 THEN '{k}' END" for k in DET) + ", CASE WHEN words = mx AND cw = 1 THEN 'most_words' END], lambda x: x IS NOT NULL), ',') AS only_here FROM c"


@plan(UNIQUE, pages=True)
def pages_unique_characteristics(spark, sf_dir):
    w = Window.partitionBy("doc")
    f = corpus.pages(spark, sf_dir).select("doc", "page", "words", *[F.col("text").rlike(v).alias(k) for k, v in text.DETECTORS.items()])
    c = f.select("*", *[F.count_if(F.col(k)).over(w).alias(f"c_{k}") for k in text.DETECTORS], F.max("words").over(w).alias("mx"), F.count("*").over(Window.partitionBy("doc", "words")).alias("cw"))
    tags = [F.when(F.col(k) & (F.col(f"c_{k}") == 1), F.lit(k)) for k in text.DETECTORS] + [F.when((F.col("words") == F.col("mx")) & (F.col("cw") == 1), F.lit("most_words"))]
    return c.select("doc", "page", F.array_join(F.array_compact(F.array(*tags)), ",").alias("only_here"))


QUERIES, SQL = plan.queries, plan.sql
