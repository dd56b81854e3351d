"""Segmentation on the pages of nested records, window ranking, ranges, paragraphs, cleaners and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from folhario.functions import layout, terms, text
from folhario.functions.values import unaccent
from folhario.operators import segment, sift, tree
from folhario.operators.nested import flatten, page_rows
from folhario.plans import rollups
from folhario.plans.base import PAGES, Plans
from folhario.plans.filters import MARKS, _marks
from folhario.plans.more import BOXES, _boxes
from folhario.plans.nodes import MARKS as NODE_MARKS
from folhario.plans.nodes import NODES, _first, _get, _many, _open
from folhario.runtime import table
from folhario.sources import corpus

plan = Plans()

_N = lambda j, kind: f"TRY_CAST(({j} ->> '$') AS {kind})"
#: p: the pages of the records as rows, in the columns that the page queries of SQL read.
RECORD = NODES + f""", q1 AS (SELECT process_number, i, p, {_get('p', 'size')} AS z, {_get('p', 'textinfo')} AS t, {_get('p', 'resources')} AS r, {_get('p', 'annotations')} AS a FROM pq),
q2 AS (SELECT process_number, i, p, {_open('z')} AS z, {_open('t')} AS t, {_open('r')} AS r, {_open('a')} AS a FROM q1), q3 AS (SELECT process_number, i, p, z, {_first('t')} AS t, {_first('r')} AS r, a FROM q2),
q4 AS (SELECT process_number, i, p, z, t, {_get('t', 'fonts')} AS f, {_get('r', 'images')} AS m, a FROM q3), q5 AS (SELECT process_number, i, p, z, t, {_open('f')} AS f, {_open('m')} AS m, a FROM q4),
p AS (SELECT process_number AS doc, CAST(i + 1 AS INT) AS page, {_N(_get('z', 'width'), 'DOUBLE')} AS width, {_N(_get('z', 'height'), 'DOUBLE')} AS height, {_N(_get('p', 'rotation'), 'INT')} AS rotation, coalesce({_N(_get('t', 'wordcount'), 'BIGINT')}, 0) AS words, coalesce(({_get('t', 'pagetext')} ->> '$'), '') AS text,
  list_transform(list_filter({_many('f')}, lambda x: json_type(x) = 'OBJECT'), lambda x: {_get('x', 'name')} ->> '$') AS fonts, list_transform(list_filter({_many('m')}, lambda x: json_type(x) = 'OBJECT'), lambda x: {{'width': {_N(_get('x', 'width'), 'BIGINT')}, 'height': {_N(_get('x', 'height'), 'BIGINT')}}}) AS images,
  CAST(len(list_filter({_many('a')}, lambda x: json_type(x) = 'OBJECT')) AS INT) AS annotations FROM q5)
"""


def record_pages(spark, sf_dir):
    rows = page_rows(table(spark, sf_dir, "raw_processes")).withColumnRenamed("key", "doc")
    return rows.withColumns({"words": F.coalesce("words", F.lit(0)), "text": F.coalesce("text", F.lit(""))})


@plan(RECORD + "SELECT doc, page, width, height, rotation, words, length(text) AS chars, array_to_string(fonts, ',') AS fonts, CAST(len(images) AS INT) AS images, annotations FROM p")
def record_page_table(spark, sf_dir):
    return record_pages(spark, sf_dir).select("doc", "page", "width", "height", "rotation", "words", F.length("text").cast("bigint").alias("chars"), F.array_join("fonts", ",").alias("fonts"), F.size("images").alias("images"), "annotations")


_TOP = "array_to_string(list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 1, 3), chr(10))"
SIGNS = f""", s AS (SELECT *, lag(width) OVER w AS w0, lag(height) OVER w AS h0, {_TOP} AS head FROM p WINDOW w AS (PARTITION BY doc ORDER BY page)), t AS (SELECT *, head AS t FROM s), m AS (SELECT doc, page, width, height, text, images, CASE WHEN abs(width - w0) > 10 OR abs(height - h0) > 10 THEN 0.9 ELSE 0.0 END::DOUBLE AS size_change,
 CASE WHEN len(list_filter(images, lambda x: x.width < 200 AND x.height < 100)) > 0 THEN 0.7 ELSE 0.0 END::DOUBLE AS image_signature,
 CASE WHEN length(head) > 0 AND len(regexp_extract_all(upper(head), '\\p{{Lu}}')) / length(head)::DOUBLE > 0.7 THEN 0.6 ELSE 0.0 END + CASE WHEN {rollups._count(segment.STARTS)} > 0 THEN 0.4 ELSE 0.0 END::DOUBLE AS top_margin FROM t)
"""


@plan(RECORD + SIGNS + "SELECT doc, page, size_change, image_signature, round(top_margin, 4)::DOUBLE AS top_margin, round(length(text) / nullif(width * height, 0), 8) AS text_density, round(coalesce(list_sum(list_transform(images, lambda x: x.width * x.height)), 0) / nullif(width * height, 0), 6)::DOUBLE AS image_density FROM m")
def record_page_signs(spark, sf_dir):
    p, w = record_pages(spark, sf_dir), segment.by_page()
    area = F.nullif(F.col("width") * F.col("height"), F.lit(0.0))
    pics = F.aggregate(F.filter(F.transform("images", lambda i: i["width"] * i["height"]), lambda x: x.isNotNull()), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return p.select(
        "doc", "page", segment.size_change(F.col("width"), F.col("height"), F.lag("width").over(w), F.lag("height").over(w)).alias("size_change"), segment.image_signature(F.col("images")).alias("image_signature"),
        F.round(segment.top_margin(F.col("text")), 4).alias("top_margin"), F.round(F.length("text") / area, 8).alias("text_density"), F.round(pics / area, 6).alias("image_density"),
    )


def _scores(prefix: str) -> str:
    """The four SQL parts of a page's score, each a query of its own over `prefix`."""
    l, n, s, h = (f"({prefix}{x.replace('round(', '(').replace(', 6) AS', ') AS')})" for x in (rollups.LAG, rollups.NEIGHBOURS, rollups.START, rollups.HEADINGS))
    return f"{l} l JOIN {n} n ON n.doc = l.doc AND n.page = l.page JOIN {s} s ON s.doc = l.doc AND s.page = l.page JOIN {h} h ON h.doc = l.doc AND h.page = l.page"


@plan(f"SELECT l.doc, l.page, round((s.patterns * 0.3 + l.density * 0.2 + l.fonts * 0.2 + g.size_change * 0.1 + n.score) / 2 + g.top_margin * 0.3 + h.score * 0.25, 7)::DOUBLE AS start_score, round(s.signatures * 0.4 + g.image_signature * 0.3, 7)::DOUBLE AS end_score FROM {_scores(RECORD)} JOIN ({RECORD + SIGNS} SELECT * FROM m) g ON g.doc = l.doc AND g.page = l.page")
def record_scores(spark, sf_dir):
    scored = segment.full_scores(record_pages(spark, sf_dir))
    return scored.select("doc", "page", F.round("start_score", 7).alias("start_score"), F.round("end_score", 7).alias("end_score"))


@plan(f"SELECT l.doc, l.page, round((s.patterns * 0.3 + l.density * 0.2 + l.fonts * 0.2 + n.score) / 2 + h.score * 0.25, 7)::DOUBLE AS start_score, round(s.signatures * 0.4, 7)::DOUBLE AS end_score FROM {_scores(PAGES)}")
def page_scores(spark, sf_dir):
    scored = segment.score_pages(corpus.pages(spark, sf_dir))
    return scored.select("doc", "page", F.round("start_score", 7).alias("start_score"), F.round("end_score", 7).alias("end_score"))


_CLOSED = "sum(e) OVER (PARTITION BY doc, segment ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@plan(f"WITH r AS (SELECT l.doc, l.page, (s.patterns * 0.3 + l.density * 0.2 + l.fonts * 0.2 + n.score) / 2 + h.score * 0.25 AS a, s.signatures * 0.4 AS b FROM {_scores(PAGES)}), f AS (SELECT doc, page, CAST(a > 0.25 AS INT) AS s, CAST(b > 0.3 AND NOT a > 0.25 AS INT) AS e FROM r), i AS (SELECT *, sum(s) OVER (PARTITION BY doc ORDER BY page) AS segment FROM f), k AS (SELECT *, coalesce({_CLOSED}, 0) AS closed FROM i WHERE segment > 0) SELECT doc, CAST(segment AS BIGINT) AS segment, min(page) AS start_page, max(page) AS end_page, count(*) AS pages FROM k WHERE closed = 0 GROUP BY doc, segment")
def scored_documents(spark, sf_dir):
    scored = segment.score_pages(corpus.pages(spark, sf_dir))
    return segment.boundaries(scored, F.col("start_score") > 0.25, F.col("end_score") > 0.3)


@plan(rollups.BOUNDS.replace("SELECT doc, CAST(segment", ", z AS (SELECT doc, CAST(segment", 1) + ") SELECT z.doc, z.segment, CASE WHEN row_number() OVER (PARTITION BY z.doc ORDER BY z.start_page) = 1 THEN least(z.start_page, l.a) ELSE z.start_page END AS start_page, z.end_page, z.pages FROM z JOIN (SELECT doc, min(page) AS a FROM p GROUP BY doc) l ON l.doc = z.doc", pages=True)
def segments_with_orphans(spark, sf_dir):
    first = corpus.pages(spark, sf_dir).groupBy("doc").agg(F.min("page").alias("first_page"))
    return segment.merge_orphans(rollups._segments(spark, sf_dir), first).select("doc", "segment", "start_page", "end_page", "pages")


@plan(RECORD + ", r AS (SELECT DISTINCT doc, (page - 1) // 3 * 3 + 1 AS a, (page - 1) // 3 * 3 + 3 AS b FROM p), g AS (SELECT r.doc, r.a AS start_page, r.b AS end_page, count(*) AS pages, arg_min(struct_pack(w := p.width, h := p.height), p.page) AS f, min(width) AS w0, max(width) AS w1, min(height) AS h0, max(height) AS h1 FROM r JOIN p ON p.doc = r.doc AND p.page BETWEEN r.a AND r.b GROUP BY ALL) SELECT doc, CAST(start_page AS INT) AS start_page, CAST(end_page AS INT) AS end_page, pages, coalesce(abs(w0 - f.w) <= 10 AND abs(w1 - f.w) <= 10 AND abs(h0 - f.h) <= 10 AND abs(h1 - f.h) <= 10, false) AS same_size FROM g WHERE pages >= 2")
def record_size_check(spark, sf_dir):
    p = record_pages(spark, sf_dir)
    start = (F.floor((F.col("page") - 1) / 3) * 3 + 1).cast("int")
    return segment.size_checked(p, p.select("doc", start.alias("start_page"), (start + 2).alias("end_page")).distinct(), least=2)


_TEMPLATE = "poder judiciario processo honorarios perito autos assinado eletronicamente".split()
_ANCHORS = {"head": ("poder judiciario", "tribunal"), "unit": ("secretaria", "vara"), "foot": ("assinado eletronicamente", "autenticidade"), "fee": ("honorarios",)}
_WIN = ", t AS (SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY words DESC, page) AS r, max(page) OVER (PARTITION BY doc) AS last FROM p), v AS (SELECT DISTINCT doc, page AS a, least(page + s - 1, last) AS b FROM t, (VALUES (2), (3), (4)) v(s) WHERE r <= 6)"
_RANKED = (
    _WIN + ", n AS (SELECT doc, page, strip_accents(lower(text)) AS t, list_distinct(string_split(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')), ' ')) AS ws FROM p), "
    f"g AS (SELECT v.doc, v.a, v.b, len(list_distinct(flatten(list(list_intersect(ws, [{', '.join(repr(x) for x in _TEMPLATE)}]))))) AS k, " + ", ".join("bool_or(" + " OR ".join(f"contains(t, '{x}')" for x in xs) + f") AS c_{k}" for k, xs in _ANCHORS.items()) + " FROM v JOIN n ON n.doc = v.doc AND n.page BETWEEN v.a AND v.b GROUP BY v.doc, v.a, v.b), "
    f"h AS (SELECT doc, a AS start_page, b AS end_page, round(k / {len(_TEMPLATE)}.0, 6)::DOUBLE AS share, list_filter([" + ", ".join(f"CASE WHEN c_{k} THEN '{k}' END" for k in _ANCHORS) + "], lambda x: x IS NOT NULL) AS f FROM g), "
    "k AS (SELECT doc, start_page, end_page, share, CAST(len(f) AS INT) AS anchors, array_to_string(f, ',') AS found, CAST(row_number() OVER (PARTITION BY doc ORDER BY share DESC, len(f) DESC, start_page, end_page) AS INT) AS rank FROM h)"
)


def _ranked(spark, sf_dir):
    p = corpus.pages(spark, sf_dir)
    return segment.anchored_windows(p, tree.windows_of(p.select("doc", "page", "words")), _ANCHORS, _TEMPLATE)


@plan(_RANKED + " SELECT * FROM k", pages=True)
def candidate_ranking(spark, sf_dir):
    return _ranked(spark, sf_dir)


@plan(_RANKED + ", z AS (SELECT *, CASE WHEN end_page - start_page + 1 < 2 THEN 'page_count' WHEN anchors < 3 THEN 'anchors' WHEN share < 0.6 THEN 'share' WHEN rank > 1 THEN 'rank' ELSE '' END AS reason FROM k) SELECT doc, start_page, end_page, reason = '' AS taken, reason FROM z", pages=True)
def candidate_verdicts(spark, sf_dir):
    return segment.verdicts(_ranked(spark, sf_dir), share=0.6, anchors=3)


ADJUST = _WIN + """, k AS (SELECT doc, page, contains(strip_accents(lower(text)), 'poder judiciario') AS hd, contains(lower(text), 'assinado eletronicamente') AS ft FROM p), l AS (SELECT *, lag(hd) OVER w AS ph, min(CASE WHEN ft THEN page END) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nf, max(page) OVER (PARTITION BY doc) AS last FROM k WINDOW w AS (PARTITION BY doc ORDER BY page)),
m AS (SELECT v.doc, v.a, v.b, v.a - CAST(coalesce(l.ph, false) AS INT) AS s, l.last FROM v JOIN l ON l.doc = v.doc AND l.page = v.a), n AS (SELECT m.*, l.nf, greatest(b, least(s + 1, m.last)) AS e, least(m.last, s + 5) AS lim FROM m JOIN l ON l.doc = m.doc AND l.page = m.s)
SELECT doc, a AS start_page, b AS end_page, CAST(s AS INT) AS new_start, CAST(least(CASE WHEN nf <= e THEN e ELSE greatest(e, least(coalesce(nf, lim), lim)) END, s + 5) AS INT) AS new_end FROM n"""


@plan(ADJUST, pages=True)
def adjusted_windows(spark, sf_dir):
    p = corpus.pages(spark, sf_dir)
    w = tree.windows_of(p.select("doc", "page", "words"))
    return segment.adjusted_ranges(p, w, F.contains(unaccent(F.lower("text")), F.lit("poder judiciario")), F.contains(F.lower("text"), F.lit("assinado eletronicamente")))


@plan(MARKS + ", l AS (SELECT doc, max(page) AS last_page FROM p GROUP BY doc), e AS (SELECT m.doc, m.start_page, m.title, coalesce(lead(m.start_page) OVER (PARTITION BY m.doc ORDER BY m.start_page, m.ord) - 1, l.last_page) AS end_page FROM m JOIN l ON l.doc = m.doc) SELECT doc, start_page, greatest(end_page, start_page) AS end_page, title FROM e WHERE regexp_matches(title, '(?i)^(anexos?|junt|este)')", pages=True)
def attachments_split(spark, sf_dir):
    last = corpus.pages(spark, sf_dir).groupBy("doc").agg(F.max("page").alias("last_page"))
    return segment.split_at(_marks(spark, sf_dir).join(last, "doc"), r"^(anexos?|junt|este)")


@plan(", k AS (SELECT doc, page AS start_page, page_id, page_type AS kind, coalesce(has_money = 1, false) AS s FROM (SELECT p.*, q.has_money FROM p JOIN pages q ON q.page_id = p.page_id) WHERE page_type IS NOT NULL UNION ALL SELECT doc, page, -page_id, page_type, false FROM p WHERE page_type IS NOT NULL) SELECT doc, start_page, page_id, kind FROM k WHERE s OR NOT EXISTS (SELECT 1 FROM k j WHERE j.s AND j.doc = k.doc AND j.start_page = k.start_page AND j.kind = k.kind)", pages=True)
def generic_suppressed(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where("page_type is not null").select(F.col("cache_id").alias("doc"), F.col("page_number").alias("start_page"), "page_id", F.col("page_type").alias("kind"), F.col("has_money").alias("m"))
    both = p.unionByName(p.withColumns({"page_id": -F.col("page_id"), "m": F.lit(0)}))
    return segment.without_generic(both, F.col("m") == 1).drop("m")


@plan(BOXES + ", l AS (SELECT doc, page, ord, y0 AS bottom, y1 AS top FROM b), s AS (SELECT *, CASE WHEN min(bottom) OVER (PARTITION BY doc, page ORDER BY (top + bottom) / 2 DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - top > 60 THEN 1 ELSE 0 END AS n FROM l) SELECT doc, page, ord, bottom, CAST(sum(n) OVER (PARTITION BY doc, page ORDER BY (top + bottom) / 2 DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS paragraph FROM s")
def paragraph_split(spark, sf_dir):
    lines = _boxes(spark, sf_dir).select("doc", "page", "ord", F.col("y0").alias("bottom"), F.col("y1").alias("top"))
    return segment.paragraphs(lines, 60).select("doc", "page", "ord", "bottom", "paragraph")


@plan(NODE_MARKS + ", x AS (SELECT key, node_id, list_transform(range(1, len(string_split(node_id, '.')) + 1), lambda i: array_to_string(list_slice(string_split(node_id, '.'), 1, i), '.')) AS up, title FROM m) SELECT key AS process_number, node_id, title FROM x WHERE NOT EXISTS (SELECT 1 FROM x a WHERE a.key = x.key AND list_contains(x.up, a.node_id) AND NOT coalesce(length(a.title) > 35, false))")
def bookmark_tree_pruned(spark, sf_dir):
    flat = flatten(table(spark, sf_dir, "raw_processes")).where("kind = 'bookmark'").select("key", "node_id", sift.field("title").alias("title"))
    return tree.prune(flat, F.length("title") > 35).select(F.col("key").alias("process_number"), "node_id", "title")


# text


@plan(r"""SELECT page_id, header AS line, CASE WHEN len(list_filter(t, lambda x: length(x) = 1)) / nullif(len(t), 0)::DOUBLE > 0.5 THEN regexp_replace(line, '[ \t\n\r\f]+', '', 'g') ELSE line END AS closed, trim(regexp_replace(footer, '[ \t\n\r\f]+', ' ', 'g')) AS footer, reverse(header) AS mirrored, len(string_split(line, ' ')) AS n FROM (SELECT page_id, header, footer, array_to_string(list_transform(range(1, length(header) + 1), lambda i: header[i]), ' ') AS line, list_filter(string_split(array_to_string(list_transform(range(1, length(header) + 1), lambda i: header[i]), ' '), ' '), lambda x: x <> '') AS t FROM pages WHERE header IS NOT NULL AND header <> '')""")
def lines_closed_up(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where("header is not null and header <> ''")
    spaced = F.array_join(F.split("header", ""), " ")
    return p.select("page_id", F.col("header").alias("line"), text.despaced(spaced).alias("closed"), text.compact_footer(F.col("footer")).alias("footer"), F.reverse("header").alias("mirrored"), F.size(F.split(spaced, " ")).cast("bigint").alias("n"))


@plan(r"""SELECT cache_id, trim(regexp_replace(regexp_replace(trim(regexp_replace(trim(regexp_replace(replace(cache_name, '_', ' '), '[ \t\n\r\f]+', ' ', 'g')), '\([0-9A-Za-z]{4,}\)$', '')), '^\d+ *- *', ''), '(?i) *- *SEI.*$', '')) AS title FROM caches""")
def plain_titles(spark, sf_dir):
    return table(spark, sf_dir, "caches").select("cache_id", text.plain_title(F.col("cache_name")).alias("title"))


_CUT = "list_min(list_filter([instr(lower(juizo), ' de '), instr(lower(juizo), 'comarca'), instr(lower(juizo), '/')], lambda i: i > 0))"


@plan(rf"SELECT rec_id, trim(regexp_replace(trim(CASE WHEN {_CUT} > 1 THEN substr(juizo, 1, {_CUT} - 1) ELSE juizo END), '[,;.–-]+$', '')) AS court FROM dados_diretoria_especial_v5")
def values_cut_at_words(spark, sf_dir):
    return table(spark, sf_dir, "dados_diretoria_especial_v5").select("rec_id", text.cut_at(F.col("juizo"), [" de ", "comarca", "/"]).alias("court"))


@plan("SELECT page_id, CAST(length(text) AS BIGINT) AS chars, CAST(ceil(length(text) / 120.0) AS BIGINT) AS pieces, substr(text, 121, 120) AS second FROM pages WHERE length(text) > 0")
def text_chunks(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where("length(text) > 0")
    return p.select("page_id", F.length("text").cast("bigint").alias("chars"), F.size(text.chunks(F.col("text"))).cast("bigint").alias("pieces"), F.coalesce(F.get(text.chunks(F.col("text")), 1), F.lit("")).alias("second"))


_FM = r"trim(regexp_replace(regexp_replace(strip_accents(lower({})), '[^a-z0-9 \t\n\r\f\v/.-]', '', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))"


@plan(f"SELECT rec_id, round(CASE WHEN greatest(length(a), length(b)) > 0 THEN 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE ELSE 1.0 END, 6) AS alike FROM (SELECT rec_id, {_FM.format('autor')} AS a, {_FM.format('parte_contraria')} AS b FROM dados_diretoria_especial_v5 WHERE autor IS NOT NULL AND parte_contraria IS NOT NULL)")
def cleaned_similarity(spark, sf_dir):
    d = table(spark, sf_dir, "dados_diretoria_especial_v5").where("autor is not null and parte_contraria is not null")
    return d.select("rec_id", F.round(text.close_after_cleaning(F.col("autor"), F.col("parte_contraria")), 6).alias("alike"))


# reports


@plan(RECORD + "SELECT doc, count(*) AS pages, count(*) FILTER (width * height > 600000) AS large, round(avg(width * height) FILTER (width * height > 600000) * 0.1247::DOUBLE, 4) AS mean_mm2 FROM p GROUP BY doc")
def large_page_stats(spark, sf_dir):
    area = F.col("width") * F.col("height")
    return record_pages(spark, sf_dir).groupBy("doc").agg(F.count("*").alias("pages"), F.count_if(area > 600000).alias("large"), F.round(F.avg(F.when(area > 600000, area)) * 0.1247, 4).alias("mean_mm2"))


@plan(RECORD + "SELECT doc, CAST(sum(len(images)) AS BIGINT) AS images, count(*) FILTER (len(images) > 0) AS with_images, round(avg(len(images)), 6) AS mean, CAST(max(len(images)) AS INT) AS most, sum(len(fonts))::BIGINT AS fonts, sum(annotations)::BIGINT AS annotations FROM p GROUP BY doc")
def record_totals(spark, sf_dir):
    n = F.size("images")
    return record_pages(spark, sf_dir).groupBy("doc").agg(F.sum(n).cast("bigint").alias("images"), F.count_if(n > 0).alias("with_images"), F.round(F.avg(n), 6).alias("mean"), F.max(n).alias("most"), F.sum(F.size("fonts")).cast("bigint").alias("fonts"), F.sum("annotations").cast("bigint").alias("annotations"))


@plan(RECORD + "SELECT doc, page, width, height FROM p WHERE abs(width - 595) <= 1 AND height BETWEEN 700 AND 900 AND list_contains(fonts, 'Arial') AND len(list_filter(fonts, lambda x: contains(x, 'Times'))) > 0 AND annotations = 0")
def record_pages_boxed(spark, sf_dir):
    p = record_pages(spark, sf_dir)
    return p.where((F.abs(F.col("width") - 595) <= 1) & F.col("height").between(700, 900) & F.array_contains("fonts", "Arial") & F.exists("fonts", lambda x: x.contains("Times")) & (F.col("annotations") == 0)).select("doc", "page", "width", "height")


@plan("SELECT p.page_id, p.cache_id AS doc, p.page_number AS page FROM pages p JOIN caches c ON c.cache_id = p.cache_id WHERE c.size_bytes / c.doc_total_pages / 1024 BETWEEN 20 AND 200")
def pages_by_bytes(spark, sf_dir):
    size = F.col("size_bytes") / F.nullif(F.col("doc_total_pages"), F.lit(0)) / 1024
    c = table(spark, sf_dir, "caches").where(size.between(20, 200)).select("cache_id")
    return table(spark, sf_dir, "pages").join(c, "cache_id").select("page_id", F.col("cache_id").alias("doc"), F.col("page_number").alias("page"))


_WHY = {"money": "regexp_matches(text, 'R\\$ ?\\d')", "case": "regexp_matches(text, '\\d{7}-\\d{2}\\.\\d{4}')", "long": "words > 200", "image": "images > 0", "signed": "contains(lower(text), 'assinado')", "bold": "len(list_filter(fonts, lambda x: contains(lower(x), 'bold'))) > 0"}


@plan(" SELECT * FROM (SELECT doc, page, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _WHY.items()) + "], lambda x: x IS NOT NULL), ',') AS reasons FROM p) WHERE reasons <> ''", pages=True)
def pages_match_reasons(spark, sf_dir):
    t = F.col("text")
    why = {"money": t.rlike(r"R\$ ?\d"), "case": t.rlike(r"\d{7}-\d{2}\.\d{4}"), "long": F.col("words") > 200, "image": F.col("images") > 0, "signed": F.lower(t).contains("assinado"), "bold": F.exists("fonts", lambda x: F.lower(x).contains("bold"))}
    return corpus.pages(spark, sf_dir).select("doc", "page", F.array_join(F.array_compact(F.array(*[F.when(c, k) for k, c in why.items()])), ",").alias("reasons")).where("reasons <> ''")


_POINTS = ("assinado eletronicamente", "honorários", "processo administrativo", "perito", "comarca")


@plan(", a AS (SELECT doc, page, unnest([" + ", ".join(f"'{x}'" for x in _POINTS) + "]) AS anchor, lower(text) AS t, length(text) AS n FROM p WHERE length(text) > 0), h AS (SELECT *, (instr(t, anchor) - 1) / n::DOUBLE AS spot FROM a WHERE contains(t, anchor)), s AS (SELECT anchor, string_agg(doc || ':' || page, ' ' ORDER BY doc, page) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY doc, page) AS r FROM h) WHERE r <= 3 GROUP BY anchor) SELECT h.anchor, count(*) AS found, count(DISTINCT doc) AS docs, round(avg(spot), 6) AS mean, round(min(spot), 6) AS least, any_value(s.samples) AS samples FROM h JOIN s ON s.anchor = h.anchor GROUP BY h.anchor", pages=True)
def anchor_summary(spark, sf_dir):
    low = F.lower("text")
    spots = F.array(*[F.struct(F.lit(x).alias("anchor"), F.instr(low, F.lit(x)).alias("i")) for x in _POINTS])
    h = corpus.pages(spark, sf_dir).where("chars > 0").select("doc", "page", "chars", F.explode(F.filter(spots, lambda s: s["i"] > 0)).alias("s")).select("doc", "page", F.col("s.anchor").alias("anchor"), ((F.col("s.i") - 1) / F.col("chars")).alias("at"))
    top = h.groupBy("anchor").agg(F.count("*").alias("found"), F.count_distinct("doc").alias("docs"), F.round(F.avg("at"), 6).alias("mean"), F.round(F.min("at"), 6).alias("least"))
    from pyspark.sql import Window

    few = h.withColumn("r", F.row_number().over(Window.partitionBy("anchor").orderBy("doc", "page"))).where("r <= 3").groupBy("anchor").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc", "page"))), lambda x: F.concat_ws(":", x["doc"], x["page"])), " ").alias("samples"))
    return top.join(few, "anchor")


_GRAM = r"list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(list_slice(w, i, i + {k} - 1), ' '))"


@plan(r", l AS (SELECT doc, page, trim(regexp_replace(strip_accents(lower(string_split(text, chr(10))[1])), '[^a-z]+', ' ', 'g')) AS a, trim(regexp_replace(strip_accents(lower(coalesce(string_split(text, chr(10))[2], ''))), '[^a-z]+', ' ', 'g')) AS b FROM p), k AS (SELECT doc, unnest([1, 2]) AS idx, unnest([string_split(a, ' '), string_split(b, ' ')]) AS w FROM l), g AS (SELECT doc, idx, 2 AS size, unnest(" + _GRAM.format(k=2) + ") AS gram FROM k UNION ALL SELECT doc, idx, 3, unnest(" + _GRAM.format(k=3) + ") FROM k), t AS (SELECT idx, size, gram, count(DISTINCT doc) AS docs, count(*) AS n FROM g GROUP BY ALL), z AS (SELECT count(DISTINCT doc) AS all_docs FROM p), y AS (SELECT t.*, CASE WHEN docs >= ceil(0.02 * all_docs) THEN 'stable' WHEN docs <= floor(0.002 * all_docs) THEN 'variable' ELSE 'between' END AS kind FROM t, z), r AS (SELECT *, row_number() OVER (PARTITION BY idx, size, kind ORDER BY docs DESC, n DESC, gram) AS rank FROM y) SELECT CAST(idx AS INT) AS idx, CAST(size AS INT) AS size, kind, gram, docs, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20", pages=True)
def paragraph_ngrams(spark, sf_dir):
    from pyspark.sql import Window

    ls = F.split("text", "\n")
    words = lambda c: F.split(F.trim(F.regexp_replace(F.lower(unaccent(c)), "[^a-z]+", " ")), " ")
    k = corpus.pages(spark, sf_dir).select("doc", F.posexplode(F.array(words(F.get(ls, 0)), words(F.coalesce(F.get(ls, 1), F.lit(""))))).alias("idx", "w"))
    gram = lambda size: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: i <= F.size("w") - size + 1), lambda i: F.struct(F.lit(size).alias("size"), F.array_join(F.slice("w", i, size), " ").alias("gram")))
    g = k.select("doc", (F.col("idx") + 1).alias("idx"), F.explode(F.concat(gram(2), gram(3))).alias("g")).select("doc", "idx", "g.*")
    t = g.groupBy("idx", "size", "gram", "doc").agg(F.count("*").alias("k")).groupBy("idx", "size", "gram").agg(F.count("*").alias("docs"), F.sum("k").alias("n"))
    z = corpus.pages(spark, sf_dir).agg(F.count_distinct("doc").alias("all_docs"))
    kind = F.when(F.col("docs") >= F.ceil(0.02 * F.col("all_docs")), "stable").when(F.col("docs") <= F.floor(0.002 * F.col("all_docs")), "variable").otherwise("between")
    r = F.row_number().over(Window.partitionBy("idx", "size", "kind").orderBy(F.desc("docs"), F.desc("n"), "gram"))
    return t.crossJoin(F.broadcast(z)).withColumn("kind", kind).drop("all_docs").withColumn("rank", r).where("rank <= 20")


@plan(" SELECT doc, page, words FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY words, page) AS r, count(*) OVER (PARTITION BY doc) AS n FROM p) WHERE r > n - 2", pages=True)
def pages_last_of_sorted(spark, sf_dir):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("words"), F.desc("page")))
    return corpus.pages(spark, sf_dir).withColumn("r", r).where("r <= 2").select("doc", "page", "words")


_PICK = "words BETWEEN 40 AND 500 AND contains(strip_accents(lower(text)), 'perito') AND NOT contains(strip_accents(lower(text)), 'leiloeiro') AND regexp_matches(text, '(?i)cpf|rg') AND page BETWEEN 1 AND 12 AND images = 0 AND regexp_matches(text, 'R\\$\\s*\\d{1,3}(\\.\\d{3})*,\\d{2}') = false AND len(list_filter(fonts, lambda x: contains(lower(x), 'times'))) > 0 AND len(list_filter(fonts, lambda x: contains(lower(x), 'arial'))) > 0"


@plan(f" SELECT doc, page FROM p WHERE {_PICK}", pages=True)
def pages_selected(spark, sf_dir):
    return sift.pages(corpus.pages(spark, sf_dir), words="perito", not_words="leiloeiro", regex="cpf|rg", pages=(1, 12), word_count=(40, 500), has_images=False, money=False, fonts_all=("times", "arial")).select("doc", "page")


@plan(" SELECT doc, page FROM p WHERE words <= 10 OR (len(list_filter(fonts, lambda x: contains(lower(x), 'courier') OR contains(lower(x), 'verdana'))) > 0 AND images > 0)", pages=True)
def pages_selected_any(spark, sf_dir):
    p = corpus.pages(spark, sf_dir)
    return sift.pages(p, blank=True).unionByName(sift.pages(p, blank=False, fonts_any=("courier", "verdana"), has_images=True)).select("doc", "page")


@plan(", g AS (SELECT doc FROM p GROUP BY doc HAVING count(*) BETWEEN 3 AND 9 AND bool_or(images > 0)), h AS (SELECT p.doc, p.page, CAST((contains(strip_accents(lower(text)), 'perito') AND contains(strip_accents(lower(text)), 'autos')) AS BOOLEAN) AS hit, len(regexp_extract_all(strip_accents(lower(text)), 'perito')) AS a, len(regexp_extract_all(strip_accents(lower(text)), 'autos')) AS b FROM p JOIN g ON g.doc = p.doc) SELECT doc, page, CAST(a AS INT) AS n_perito, CAST(b AS INT) AS n_autos FROM h WHERE hit", pages=True)
def words_found_by_term(spark, sf_dir):
    p = corpus.pages(spark, sf_dir)
    kept = sift.documents(p, pages=(3, 9), any_image=True)
    return sift.term_hits(p.join(kept, "doc", "left_semi"), ["perito", "autos"])


QUERIES, SQL = plan.queries, plan.sql
