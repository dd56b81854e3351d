"""Filter commands over pages, words, bookmarks, annotations, fonts and images."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folhario.functions import layout, ranges, terms, text
from folhario.functions.values import unaccent
from folhario.operators import labels, segment
from folhario.plans.base import Plans
from folhario.runtime import table
from folhario.sources import corpus

plan = Plans()
FOLDED = "strip_accents(lower(text))"


def _found(spark, sf_dir, pattern):
    return corpus.pages(spark, sf_dir).where(terms.matches(F.col("text"), pattern)).select("doc", "page", "words")


@plan(f"SELECT doc, page, words FROM p WHERE contains({FOLDED}, 'honorarios') AND contains({FOLDED}, 'tabela')", pages=True)
def pages_word_and(spark, sf_dir):
    return _found(spark, sf_dir, "Honorários&tabela")


@plan(f"SELECT doc, page, words FROM p WHERE contains({FOLDED}, 'testemunha') OR contains({FOLDED}, 'quesito')", pages=True)
def pages_word_or(spark, sf_dir):
    return _found(spark, sf_dir, "testemunha | QUESITO")


@plan("SELECT doc, page, words FROM p WHERE contains(text, 'PODER JUDICIÁRIO')", pages=True)
def pages_word_exact(spark, sf_dir):
    return _found(spark, sf_dir, "PODER JUDICIÁRIO")


@plan(f"SELECT doc, page, words FROM p WHERE regexp_matches({FOLDED}, 'peri.ia.*designada')", pages=True)
def pages_wildcard(spark, sf_dir):
    return _found(spark, sf_dir, "perí?ia*designada")


@plan(f"SELECT doc, page, words FROM p WHERE NOT contains({FOLDED}, 'honorarios')", pages=True)
def pages_not_words(spark, sf_dir):
    return corpus.pages(spark, sf_dir).where(~terms.matches(F.col("text"), "honorários")).select("doc", "page", "words")


@plan(r"SELECT doc, page FROM p WHERE regexp_matches(text, '(?i)of[íi]cio (à|a) empresa|carga do laudo')", pages=True)
def pages_regex(spark, sf_dir):
    return corpus.pages(spark, sf_dir).where(F.col("text").rlike("(?iu)of[íi]cio (à|a) empresa|carga do laudo")).select("doc", "page")


@plan("SELECT doc, page, words FROM p WHERE words BETWEEN 80 AND 160", pages=True)
def pages_min_max_words(spark, sf_dir):
    return corpus.pages(spark, sf_dir).where(F.col("words").between(80, 160)).select("doc", "page", "words")


@plan("SELECT doc, page, words, chars FROM p WHERE words <= 10", pages=True)
def pages_blank(spark, sf_dir):
    return corpus.pages(spark, sf_dir).where("words <= 10").select("doc", "page", "words", "chars")


@plan("SELECT doc, page, list_contains(fonts, 'Arial') AS arial, list_contains(fonts, 'Courier') AS mono FROM p WHERE len(list_filter(fonts, lambda f: contains(lower(f), 'times'))) > 0", pages=True)
def pages_fonts(spark, sf_dir):
    p = corpus.pages(spark, sf_dir)
    return p.where(F.exists("fonts", lambda f: F.lower(f).contains("times"))).select("doc", "page", F.array_contains("fonts", "Arial").alias("arial"), F.exists("fonts", lambda f: layout.font_flags(f)["mono"]).alias("mono"))


@plan("SELECT doc, page, images FROM p WHERE images > 0 AND words < 150", pages=True)
def pages_images(spark, sf_dir):
    return corpus.pages(spark, sf_dir).where("images > 0 AND words < 150").select("doc", "page", "images")


RANGE = """, t AS (SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page) AS nr, count(*) OVER (PARTITION BY doc) AS total FROM p)
SELECT doc, page, nr FROM t WHERE ((nr BETWEEN 1 AND total AND nr % 2 = 1) OR nr = total) AND nr <> 3"""


@plan(RANGE, pages=True)
def pages_range_spec(spark, sf_dir):
    w = Window.partitionBy("doc")
    numbered = corpus.pages(spark, sf_dir).select("doc", "page", F.row_number().over(w.orderBy("page")).alias("nr"), F.count("*").over(w).alias("total"))
    chosen = numbered.where(F.array_contains(ranges.pages("1-z:odd,r1,x3", F.col("total").cast("int")), F.col("nr")))
    return chosen.select("doc", "page", F.col("nr").cast("bigint").alias("nr"))


@plan("SELECT doc, page FROM (SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page) a, row_number() OVER (PARTITION BY doc ORDER BY page DESC) b FROM p) WHERE a <= 2 OR b <= 1", pages=True)
def pages_first_last(spark, sf_dir):
    w = Window.partitionBy("doc")
    p = corpus.pages(spark, sf_dir).select("doc", "page", F.row_number().over(w.orderBy("page")).alias("a"), F.row_number().over(w.orderBy(F.desc("page"))).alias("b"))
    return p.where("a <= 2 OR b <= 1").select("doc", "page")


@plan("SELECT doc, page, words FROM p ORDER BY words DESC, doc, page LIMIT 25", pages=True)
def pages_sort_words_top(spark, sf_dir):
    return corpus.pages(spark, sf_dir).select("doc", "page", "words").orderBy(F.desc("words"), "doc", "page").limit(25)


SIGNED = """SELECT doc, page FROM p WHERE length(text) > 0 AND (
  contains(lower(substr(text, CAST(floor(length(text) * 0.7) AS BIGINT) + 1)), 'junte-se') OR
  (contains(lower(text), 'junte-se') AND (contains(text, '____') OR len(list_filter(['assinado por','signed by','assinatura','signature','assinado digitalmente','digitally signed','certificado digital','digital certificate'], lambda s: contains(lower(text), s))) > 0)))"""


@plan(SIGNED, pages=True)
def pages_signature_tail(spark, sf_dir):
    return corpus.pages(spark, sf_dir).where(layout.signed_by(F.col("text"), "Junte-se")).select("doc", "page")


@plan(r"SELECT doc, page, regexp_matches(text, '\d') AS any_digit, CAST(len(regexp_extract_all(text, 'R\$\s*(\d{1,3}(?:\.\d{3})*(?:,\d{2})?)', 1)) AS BIGINT) AS amounts FROM p WHERE regexp_matches(text, 'R\$\s*\d')", pages=True)
def pages_currency(spark, sf_dir):
    p = corpus.pages(spark, sf_dir).where(F.col("text").rlike(r"R\$\s*\d"))
    return p.select("doc", "page", F.col("text").rlike(r"\d").alias("any_digit"), F.size(text.money_values(F.col("text"))).cast("bigint").alias("amounts"))


SIZES = """WITH s AS (SELECT p_partkey AS id, 415 + (p_size % 3) * 180 + (p_size % 5) AS w, 592 + (p_size % 2) * 250 + (p_size % 4) AS h FROM part)
SELECT id, w, h, CASE WHEN abs(w-612)<=2 AND abs(h-792)<=2 THEN 'Letter' WHEN abs(w-595)<=2 AND abs(h-842)<=2 THEN 'A4' WHEN abs(w-612)<=2 AND abs(h-1008)<=2 THEN 'Legal' WHEN abs(w-420)<=2 AND abs(h-595)<=2 THEN 'A5' WHEN abs(w-842)<=2 AND abs(h-1191)<=2 THEN 'A3' ELSE 'Custom' END AS paper,
 CASE WHEN abs(w-595)<10 AND abs(h-842)<10 THEN 'A4' WHEN abs(w-842)<10 AND abs(h-1191)<10 THEN 'A3' WHEN abs(w-612)<10 AND abs(h-792)<10 THEN 'Letter' WHEN abs(w-744)<10 AND abs(h-1052)<10 THEN 'B5' WHEN w*h>1000000 THEN 'Muito-Grande' WHEN w*h>700000 THEN 'Grande' WHEN w*h>400000 THEN 'Médio' ELSE 'Pequeno' END AS category,
 CASE WHEN w > h THEN 'landscape' ELSE 'portrait' END AS orientation, round(w * 0.352778::DOUBLE, 2) AS w_mm, round(w / 72.0, 6) AS w_in FROM s"""


@plan(SIZES)
def pages_paper_size(spark, sf_dir):
    s = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "415 + (p_size % 3) * 180 + (p_size % 5) AS w", "592 + (p_size % 2) * 250 + (p_size % 4) AS h")
    w, h = F.col("w"), F.col("h")
    return s.select("id", "w", "h", layout.paper_size(w, h).alias("paper"), layout.size_category(w, h).alias("category"), layout.orientation(w, h).alias("orientation"), F.round(layout.millimetres(w), 2).alias("w_mm"), F.round(layout.inches(w), 6).alias("w_in"))


TOKENS = r"regexp_extract_all(lower(text), '\p{L}[\p{L}\p{N}_.-]*')"
TOP_WORDS = f""", w AS (SELECT doc, page, word, pos FROM (SELECT doc, page, unnest({TOKENS}) AS word, generate_subscripts({TOKENS}, 1) AS pos FROM p) WHERE length(word) >= 4),
c AS (SELECT doc, page, word, count(*) AS n, min(pos) AS first FROM w GROUP BY ALL)
SELECT doc, page, word, n, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY n DESC, first) AS r FROM c) WHERE r <= 10"""


@plan(TOP_WORDS, pages=True)
def words_top10_per_page(spark, sf_dir):
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}[\p{L}\p{N}_.-]*"), F.lit(0))
    w = corpus.pages(spark, sf_dir).select("doc", "page", F.posexplode(tokens).alias("pos", "word")).where("length(word) >= 4")
    c = w.groupBy("doc", "page", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    r = F.row_number().over(Window.partitionBy("doc", "page").orderBy(F.desc("n"), "first"))
    return c.withColumn("rank", r.cast("bigint")).where("rank <= 10").select("doc", "page", "word", "n", "rank")


@plan(r", h AS (SELECT doc, page, unnest(regexp_extract_all(text, 'fls\. \d+')) AS hit FROM p) SELECT doc, page, hit, count(*) AS n FROM h GROUP BY ALL", pages=True)
def words_regex_hits(spark, sf_dir):
    h = corpus.pages(spark, sf_dir).select("doc", "page", F.explode(F.regexp_extract_all("text", F.lit(r"fls\. \d+"), F.lit(0))).alias("hit"))
    return h.groupBy("doc", "page", "hit").agg(F.count("*").alias("n"))


@plan(", g AS (SELECT doc, min(page) AS a, max(page) AS b FROM p GROUP BY doc HAVING count(*) >= 5) SELECT p.doc, p.page, p.words FROM p JOIN g ON p.doc = g.doc WHERE p.page < a + 2 OR p.page > b - 1", pages=True)
def words_guards(spark, sf_dir):
    p = corpus.pages(spark, sf_dir).select("doc", "page", "words")
    g = p.groupBy("doc").agg(F.min("page").alias("a"), F.max("page").alias("b"), F.count("*").alias("n")).where("n >= 5")
    return p.join(g, "doc").where("page < a + 2 OR page > b - 1").select("doc", "page", "words")


@plan(f"SELECT doc, page, words FROM p WHERE contains({FOLDED}, 'testemunha') AND contains({FOLDED}, 'telefone') AND words BETWEEN 50 AND 400 ORDER BY doc, page LIMIT 200", pages=True)
def find_terms_and(spark, sf_dir):
    p = corpus.pages(spark, sf_dir)
    hit = terms.matches(F.col("text"), "testemunha") & terms.matches(F.col("text"), "telefone") & F.col("words").between(50, 400)
    return p.where(hit).select("doc", "page", "words").orderBy("doc", "page").limit(200)


@plan("SELECT doc, page FROM p WHERE contains(strip_accents(lower(header)), 'judiciario') AND contains(strip_accents(lower(footer)), 'autenticidade')", pages=True)
def find_header_footer(spark, sf_dir):
    return corpus.pages(spark, sf_dir).where(terms.matches(F.col("header"), "judiciario") & terms.matches(F.col("footer"), "autenticidade")).select("doc", "page")


@plan("SELECT cache_id AS doc, cache_name, source FROM caches WHERE contains(strip_accents(lower(cache_name)), 'copia') AND doc_total_pages >= 3 AND created_at >= TIMESTAMP '2023-01-01' AND size_bytes BETWEEN 100000 AND 9000000")
def find_docs(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    return d.where(terms.matches(F.col("cache_name"), "copia") & (F.col("doc_total_pages") >= 3) & (F.col("created_at") >= F.lit("2023-01-01").cast("timestamp_ntz")) & F.col("size_bytes").between(100000, 9000000)).select("doc", "cache_name", "source")


@plan(f"SELECT doc, page FROM p WHERE contains({FOLDED}, 'laudo') AND doc IN (SELECT cache_id FROM caches WHERE extraction_mode = 'text' AND doc_total_pages > 5)", pages=True)
def find_doc_level_semi(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).where("extraction_mode = 'text' AND doc_total_pages > 5").select("doc")
    return corpus.pages(spark, sf_dir).where(terms.matches(F.col("text"), "laudo")).join(d, "doc", "left_semi").select("doc", "page")


@plan(f""", f AS (SELECT doc, page, text, list_min(list_filter([instr({FOLDED}, 'protocolo') - 1, instr({FOLDED}, 'dotacao') - 1], lambda x: x >= 0)) AS pos FROM p)
SELECT doc, page, pos, trim(replace(substr(text, CAST(greatest(pos - 60, 0) + 1 AS BIGINT), CAST(least(pos + 120, length(text)) - greatest(pos - 60, 0) AS BIGINT)), chr(10), ' ')) AS snippet FROM f WHERE pos IS NOT NULL""", pages=True)
def find_snippets(spark, sf_dir):
    folded = unaccent(F.lower("text"))
    p = corpus.pages(spark, sf_dir).where(terms.matches(F.col("text"), "protocolo|dotação"))
    at = text.first_position(folded, ["protocolo", "dotacao"])
    return p.select("doc", "page", at.cast("bigint").alias("pos"), text.snippet(F.col("text"), at, 60, 120).alias("snippet"))


INVERTED = r""", t AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]{2,}')) AS token FROM p)
SELECT page_id, CAST(count(DISTINCT CASE WHEN token = 'testemunha' THEN 1 WHEN token LIKE 'perici%' THEN 2 END) AS BIGINT) AS matched FROM t GROUP BY page_id HAVING matched = 2"""


@plan(INVERTED, pages=True)
def find_inverted_index(spark, sf_dir):
    from folhario.operators.search import index, lookup

    p = corpus.pages(spark, sf_dir)
    return lookup(index(p, "page_id", "text"), "page_id", ["testemunha", "perici*"], every=True)


@plan(INVERTED, pages=True)
def find_words_scanned(spark, sf_dir):
    from folhario.operators.search import scan

    return scan(corpus.pages(spark, sf_dir), "page_id", "text", ["testemunha", "perici*"])


@plan(", t AS (SELECT page_id, strip_accents(lower(text)) AS t FROM p) SELECT page_id, CAST(2 AS BIGINT) AS matched FROM t WHERE len(list_filter(regexp_extract_all(t, '[a-z0-9]{2,}'), lambda w: regexp_full_match(w, 'testemunh(a|as|o|e|ar|ado|ada|ados|adas|ou|ando|aram|ava)?'))) > 0 AND len(list_filter(regexp_extract_all(t, '[a-z0-9]{2,}'), lambda w: regexp_full_match(w, 'assin(a|as|o|e|ar|ado|ada|ados|adas|ou|ando|aram|ava|ante|antes)?') AND NOT regexp_full_match(w, 'assinantes?'))) > 0", pages=True)
def find_stemmed(spark, sf_dir):
    from folhario.operators.search import scan

    return scan(corpus.pages(spark, sf_dir), "page_id", "text", ["testemunh", "assin"], stems=True)


@plan(f""", r AS (SELECT cache_id AS doc, 1 AS a, 3 AS b FROM caches UNION ALL SELECT cache_id, 4, 6 FROM caches),
h AS (SELECT r.doc, r.a, bool_or(contains({FOLDED}, 'honorarios')) AS hit, count(*) AS n FROM r JOIN p ON p.doc = r.doc AND p.page BETWEEN r.a AND r.b GROUP BY r.doc, r.a)
SELECT doc, a AS start_page, n AS pages FROM h WHERE hit""", pages=True)
def documents_any_page_matches(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).select("doc")
    r = d.select("doc", F.lit(1).alias("start_page"), F.lit(3).alias("end_page")).unionByName(d.select("doc", F.lit(4).alias("start_page"), F.lit(6).alias("end_page")))
    met = segment.pages_within(corpus.pages(spark, sf_dir), r)
    return met.groupBy("doc", "start_page").agg(F.bool_or(terms.matches(F.col("text"), "honorários")).alias("hit"), F.count("*").alias("pages")).where("hit").drop("hit")


MARKS = """, m AS (SELECT doc, page AS start_page, page_id AS ord, page_type, trim(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1]) AS title FROM p WHERE page_type IN ('despacho', 'oficio'))"""


def _marks(spark, sf_dir):
    """Bookmarks of the stand-in: pages of some types, named by their first full line."""
    first = text.nth(text.full_lines(F.col("text")), 1)
    return corpus.pages(spark, sf_dir).where(F.col("page_type").isin("despacho", "oficio")).select("doc", F.col("page").alias("start_page"), F.col("page_id").alias("ord"), "page_type", first.alias("title"))


@plan(MARKS + " SELECT m.doc, m.start_page, m.title, q.words FROM m JOIN p q ON q.doc = m.doc AND q.page = m.start_page WHERE contains(strip_accents(lower(m.title)), 'vara') AND m.start_page BETWEEN 2 AND 30", pages=True)
def bookmarks_filter(spark, sf_dir):
    m = _marks(spark, sf_dir).where(terms.matches(F.col("title"), "vara") & F.col("start_page").between(2, 30))
    q = corpus.pages(spark, sf_dir).select("doc", F.col("page").alias("start_page"), "words")
    return m.join(q, ["doc", "start_page"]).select("doc", "start_page", "title", "words")


RANGES = MARKS + """, l AS (SELECT doc, max(page) AS last_page FROM p GROUP BY doc),
n AS (SELECT m.doc, m.start_page, l.last_page, lead(m.start_page) OVER (PARTITION BY m.doc ORDER BY m.start_page, m.ord) - 1 AS nx FROM m JOIN l ON l.doc = m.doc)
SELECT doc, start_page, coalesce(nx, start_page) AS end_own, coalesce(nx, last_page) AS end_total, greatest(coalesce(nx, last_page), start_page) AS end_kept FROM n"""


@plan(RANGES, pages=True)
def bookmark_ranges(spark, sf_dir):
    last = corpus.pages(spark, sf_dir).groupBy("doc").agg(F.max("page").alias("last_page"))
    return segment.mark_ranges(_marks(spark, sf_dir), last).select("doc", "start_page", "end_own", "end_total", "end_kept")


GAPS = MARKS + """, r AS (SELECT doc, start_page, coalesce(lead(start_page) OVER (PARTITION BY doc ORDER BY start_page, ord) - 1, start_page) AS end_page FROM m),
u AS (SELECT p.doc, p.page FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc = p.doc AND p.page BETWEEN r.start_page AND r.end_page)),
g AS (SELECT doc, page, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS k FROM u)
SELECT doc, min(page) AS first_page, max(page) AS last_page FROM g GROUP BY doc, k"""


@plan(GAPS, pages=True)
def bookmark_gap_fill(spark, sf_dir):
    p = corpus.pages(spark, sf_dir).select("doc", "page")
    r = segment.mark_ranges(_marks(spark, sf_dir)).select("doc", "start_page", F.col("end_own").alias("end_page"))
    covered = segment.pages_within(p, r).select("doc", "page").distinct()
    return segment.page_islands(p.join(covered, ["doc", "page"], "left_anti"))


_RULED = "CASE WHEN contains(t, 'laudo') OR contains(t, 'pericia') THEN {} WHEN contains(t, 'senten') THEN {} WHEN contains(t, 'capa') THEN {} WHEN contains(t, 'sighope') OR contains(t, 'perito') THEN {} WHEN contains(t, 'requer') OR contains(t, 'pedido') THEN {} WHEN contains(t, 'oficio') THEN {} WHEN contains(t, 'certidao') THEN {} WHEN contains(t, 'despach') THEN {} WHEN contains(t, 'pagamento') OR contains(t, 'honor') OR contains(t, 'reserva') OR contains(t, 'rpv') THEN {} ELSE {} END"
_OWN = "array_to_string(list_transform(string_split(t, ' '), lambda x: upper(x[1]) || x[2:]), ' ')"
_FOLDED_TITLE = "trim(regexp_replace(lower(strip_accents(title)), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
LABELS = _RULED.format("'Laudo'", "'Sentenca'", "'Capa'", "'SIGHOPE'", "'Requerimento'", "'Oficio'", "'Certidao'", "'Despacho'", "'Pagamento/Honorarios'", _OWN)
MACROS = _RULED.format("'anexo'", "'anexo'", "'anexo'", "'anexo'", "'requerimento'", "'oficio'", "'certidao'", "'despacho'", "'anexo'", "'outros'")
SUBS = _RULED.format("'laudo'", "'sentenca'", "'capa'", "'sighope'", "'outros'", "'outros'", "'outros'", "'outros'", "'pagamento'", "'outros'")


@plan(MARKS + f", t AS (SELECT doc, start_page, title, {_FOLDED_TITLE} AS t FROM m) SELECT doc, start_page, {LABELS} AS label, {MACROS} AS macro, {SUBS} AS sub, false AS known FROM t", pages=True)
def bookmark_classify(spark, sf_dir):
    return labels.labelled(_marks(spark, sf_dir).select("doc", "start_page", "title")).drop("title")


@plan(MARKS + f", k AS (SELECT trim(regexp_replace(lower(strip_accents(especialidade)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS t, min(especialidade) AS a, min(area) AS b FROM especialidades_ref GROUP BY 1), t AS (SELECT rec_id, especialidade AS title, trim(regexp_replace(lower(strip_accents(especialidade)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS t FROM dados_diretoria_especial_v5 WHERE especialidade IS NOT NULL) SELECT rec_id, CASE WHEN k.t IS NOT NULL THEN a ELSE {LABELS.replace('(t,', '(t.t,')} END AS label, CASE WHEN k.t IS NOT NULL THEN b ELSE {MACROS.replace('(t,', '(t.t,')} END AS macro, CASE WHEN k.t IS NOT NULL THEN 'outros' ELSE {SUBS.replace('(t,', '(t.t,')} END AS sub, k.t IS NOT NULL AS known FROM t LEFT JOIN k ON k.t = t.t".replace("string_split(t,", "string_split(t.t,"), pages=True)
def labels_by_dictionary(spark, sf_dir):
    known = table(spark, sf_dir, "especialidades_ref").select(F.col("especialidade").alias("original"), F.lit(None).cast("string").alias("canonical"), F.col("area").alias("macro"), F.lit("").alias("sub"))
    rows = table(spark, sf_dir, "dados_diretoria_especial_v5").where("especialidade is not null").select("rec_id", F.col("especialidade").alias("title"))
    return labels.labelled(rows, known).drop("title")


@plan("SELECT event_id, event_type, user_id, value FROM events WHERE contains(lower(event_type), 'c') AND value > 20 AND ts >= TIMESTAMP '2024-01-02' AND json_extract_string(props, '$.k')::INT % 2 = 0")
def annotations_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where(F.lower("event_type").contains("c") & (F.col("value") > 20) & (F.col("ts") >= F.lit("2024-01-02").cast("timestamp_ntz")) & (F.get_json_object("props", "$.k").cast("int") % 2 == 0)).select("event_id", "event_type", "user_id", "value")


@plan("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id")
def annotation_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "error").alias("errors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@plan(", f AS (SELECT doc, page, unnest(fonts) AS font FROM p) SELECT font, count(*) AS uses, count(DISTINCT doc) AS docs, min(page) AS first_page, contains(font, 'Times') AS serif, contains(font, 'Courier') OR contains(font, 'Mono') AS mono FROM f WHERE font <> '' GROUP BY font HAVING count(*) >= 3", pages=True)
def fonts_rollup(spark, sf_dir):
    f = corpus.pages(spark, sf_dir).select("doc", "page", F.explode("fonts").alias("font")).where("font <> ''")
    flags = layout.font_flags(F.col("font"))
    g = f.groupBy("font").agg(F.count("*").alias("uses"), F.count_distinct("doc").alias("docs"), F.min("page").alias("first_page")).where("uses >= 3")
    return g.select("font", "uses", "docs", "first_page", flags["serif"].alias("serif"), flags["mono"].alias("mono"))


@plan("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 20 AS w, CAST(l_quantity AS BIGINT) * 28 AS h, CAST(l_quantity AS BIGINT) * 20 * CAST(l_quantity AS BIGINT) * 28 * 8 // 8 AS bytes FROM lineitem WHERE l_quantity * 20 BETWEEN 700 AND 800 AND l_quantity * 28 BETWEEN 1000 AND 1100")
def images_filter(spark, sf_dir):
    q = F.col("l_quantity").cast("bigint")
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (q * 20).alias("w"), (q * 28).alias("h"))
    return i.where(F.col("w").between(700, 800) & F.col("h").between(1000, 1100)).withColumn("bytes", F.floor(F.col("w") * F.col("h") * 8 / 8).cast("bigint"))


@plan(", t AS (SELECT images, count(*) AS pages FROM p GROUP BY images) SELECT images, pages, round(100.0 * pages / sum(pages) OVER (), 4) AS pct FROM t ORDER BY pages DESC, images LIMIT 10", pages=True)
def images_distribution(spark, sf_dir):
    t = corpus.pages(spark, sf_dir).groupBy("images").agg(F.count("*").alias("pages"))
    total = t.agg(F.sum("pages").alias("total"))
    return t.crossJoin(F.broadcast(total)).select("images", "pages", F.round(100.0 * F.col("pages") / F.col("total"), 4).alias("pct")).orderBy(F.desc("pages"), "images").limit(10)


@plan("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * CAST(floor(l_extendedprice / 100) AS BIGINT) AS area FROM lineitem ORDER BY area DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20")
def largest_images(spark, sf_dir):
    area = F.col("l_quantity").cast("bigint") * F.floor(F.col("l_extendedprice") / 100)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", area.cast("bigint").alias("area")).orderBy(F.desc("area"), "l_orderkey", "l_linenumber", "l_partkey").limit(20).drop("l_partkey")


@plan("SELECT l_orderkey, max(l_extendedprice) AS price, CAST(arg_max(l_linenumber, l_extendedprice * 1000 - l_linenumber) AS INT) AS line FROM lineitem GROUP BY l_orderkey")
def largest_image_per_page(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("price"), F.max_by("l_linenumber", F.col("l_extendedprice") * 1000 - F.col("l_linenumber")).alias("line"))


QUERIES, SQL = plan.queries, plan.sql
