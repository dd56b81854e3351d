"""Storage, lookups, field extraction, statistics and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folhario.functions import layout, text, udfs
from folhario.functions.values import STAND_INS, filled, fold, unaccent
from folhario.operators import extract, lookup, quantile, segment, store
from folhario.plans.base import Plans
from folhario.runtime import table
from folhario.sources import corpus

plan = Plans()
DADOS = "dados_diretoria_especial_v5"


def _fold(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({c})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _filled(c: str) -> str:
    return f"coalesce({_fold(c)} NOT IN ('', " + ", ".join(f"'{s}'" for s in STAND_INS) + "), false)"


# storage


def _again(o):
    """A second version of a whole table: keys shifted, so that some are known and some are new, and another status."""
    return o.select((F.col("o_orderkey") + 3).alias("o_orderkey"), "o_custkey", F.concat("o_orderstatus", F.lit("+")).alias("o_orderstatus"))


@plan("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders UNION ALL SELECT o_orderkey + 3, o_custkey, o_orderstatus || '+' FROM orders WHERE o_orderkey + 3 NOT IN (SELECT o_orderkey FROM orders)")
def insert_if_absent(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return store.insert_if_absent(o, _again(o), ["o_orderkey"], F.col("o_custkey"))


@plan("SELECT o_orderkey + 3 AS o_orderkey, o_custkey, o_orderstatus || '+' AS o_orderstatus FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey - 3 NOT IN (SELECT o_orderkey FROM orders)")
def upsert_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return store.upsert(o, _again(o), ["o_orderkey"], F.col("o_custkey"))


@plan("SELECT cache_name, coalesce(CASE WHEN cache_id % 2 = 0 THEN process_number END, process_number) AS process_number, size_bytes + 1 AS size_bytes FROM caches WHERE cache_id % 5 <> 0 UNION ALL SELECT cache_name, process_number, size_bytes FROM caches WHERE cache_id % 5 = 0")
def upsert_coalesce_key(spark, sf_dir):
    c = table(spark, sf_dir, "caches")
    new = c.where("cache_id % 5 <> 0").select("cache_name", F.when(F.col("cache_id") % 2 == 0, F.col("process_number")).alias("process_number"), (F.col("size_bytes") + 1).alias("size_bytes"))
    return store.upsert_keeping(c.select("cache_name", "process_number", "size_bytes"), new, ["cache_name"], ["process_number"])


@plan("SELECT process_number, cache_id, cache_name FROM (SELECT *, row_number() OVER (PARTITION BY process_number ORDER BY created_at NULLS FIRST, cache_id) AS n FROM caches WHERE process_number IS NOT NULL) WHERE n = 1")
def dedupe_keep_first(spark, sf_dir):
    c = table(spark, sf_dir, "caches").where("process_number is not null")
    first = c.groupBy("process_number").agg(F.min(F.struct(F.col("created_at"), F.col("cache_id"), F.col("cache_name"))).alias("b"))
    return first.select("process_number", "b.cache_id", "b.cache_name")


@plan("SELECT process_number, cache_id FROM caches c WHERE NOT EXISTS (SELECT 1 FROM raw_processes r WHERE r.process_number = c.process_number)")
def anti_processes(spark, sf_dir):
    return table(spark, sf_dir, "caches").join(table(spark, sf_dir, "raw_processes").select("process_number"), "process_number", "left_anti").select("process_number", "cache_id")


@plan("SELECT process_number, source FROM raw_processes WHERE source ILIKE '%a%' ORDER BY created_at DESC, process_number LIMIT 20 OFFSET 5")
def raw_list_ilike_paged(spark, sf_dir):
    return table(spark, sf_dir, "raw_processes").where(F.col("source").ilike("%a%")).orderBy(F.desc("created_at"), "process_number").offset(5).limit(20).select("process_number", "source")


@plan("SELECT process_number, row_number() OVER (ORDER BY created_at DESC NULLS LAST, process_number) AS position FROM raw_processes")
def process_by_index(spark, sf_dir):
    return corpus.newest_first(table(spark, sf_dir, "raw_processes").select("process_number", "created_at"), "created_at", "process_number").select("process_number", "position")


# lookups


@plan("SELECT d.rec_id, coalesce(a.perito_id, b.perito_id) AS perito_id, CASE WHEN a.perito_id IS NOT NULL THEN 0.9 WHEN b.perito_id IS NOT NULL THEN 0.75 END::DOUBLE AS confidence FROM (SELECT rec_id, nullif(regexp_replace(cpf_perito, '\\D', '', 'g'), '') AS cpf, " + _fold("perito_nome") + " AS name FROM dados_diretoria_especial_v5) d LEFT JOIN (SELECT nullif(regexp_replace(cpf, '\\D', '', 'g'), '') AS cpf, min(perito_id) AS perito_id FROM peritos_ref GROUP BY 1) a ON a.cpf = d.cpf LEFT JOIN (SELECT " + _fold("perito") + " AS name, min(perito_id) AS perito_id FROM peritos_ref GROUP BY 1) b ON b.name = d.name")
def catalog_priority_lookup(spark, sf_dir):
    digits = lambda c: F.nullif(F.regexp_replace(c, r"\D", ""), F.lit(""))
    d = table(spark, sf_dir, DADOS).select("rec_id", digits("cpf_perito").alias("cpf"), fold(F.col("perito_nome")).alias("name"))
    r = table(spark, sf_dir, "peritos_ref").select("perito_id", digits("cpf").alias("cpf"), fold(F.col("perito")).alias("name"))
    return lookup.prioritised(d, r, [("cpf", 0.9), ("name", 0.75)], "perito_id", "perito_id").select("rec_id", "perito_id", "confidence")


NEAREST = """WITH o AS (SELECT o_orderkey, 'Brand#' || (o_custkey % 25) AS brand, floor(o_totalprice / 3) / 100 AS amount FROM orders WHERE o_orderkey % 20 = 0), c AS (SELECT o.*, p.p_retailprice AS v, p.p_partkey AS k, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY abs(p.p_retailprice - o.amount), p.p_partkey) AS n FROM o LEFT JOIN part p ON p.p_brand = o.brand)
SELECT o_orderkey, brand, amount, CASE WHEN abs(v - amount) / amount <= 0.01 THEN v END AS matched_value, CASE WHEN abs(v - amount) / amount <= 0.01 THEN k END AS matched FROM c WHERE n = 1"""


@plan(NEAREST.replace("WHERE o_orderkey % 20 = 0", ""))
def nearest_fee_match(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Brand#"), F.col("o_custkey") % 25).alias("brand"), (F.floor(F.col("o_totalprice") / 3) / 100).alias("amount"))
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), "p_retailprice", "p_partkey")
    return lookup.nearest(o, p, "brand", "amount", "p_retailprice", "p_partkey", 0.01)


BOXES = "WITH b AS (SELECT l_orderkey AS doc, CAST(l_linenumber % 3 + 1 AS INT) AS page, l_partkey AS ord, l_returnflag AS word, l_quantity * 10 AS x0, floor(l_extendedprice / 120) AS y0, l_quantity * 10 + 30 AS x1, floor(l_extendedprice / 120) + 10 AS y1 FROM lineitem)"


def _boxes(spark, sf_dir):
    """Word boxes of the stand-in: order lines as words with a place on a page."""
    q, e = F.col("l_quantity"), F.floor(F.col("l_extendedprice") / 120).cast("double")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 3 + 1).alias("page"), F.col("l_partkey").alias("ord"), F.col("l_returnflag").alias("word"), (q * 10).alias("x0"), e.alias("y0"), (q * 10 + 30).alias("x1"), (e + 10).alias("y1"))


@plan(BOXES + " SELECT 'head' AS region, doc, page, ord, word FROM b WHERE page = 1 AND x0 <= 301 AND x1 >= 99 AND y0 <= 801 AND y1 >= 699 UNION ALL SELECT 'foot', doc, page, ord, word FROM b WHERE x0 <= 201 AND x1 >= 9 AND y0 <= 61 AND y1 >= 9")
def rect_template_hits(spark, sf_dir):
    r = spark.createDataFrame([("head", 1, 100.0, 700.0, 300.0, 800.0, 1.0), ("foot", None, 10.0, 10.0, 200.0, 60.0, 1.0)], "region string, page int, rx0 double, ry0 double, rx1 double, ry1 double, tolerance double")
    return lookup.in_rectangles(_boxes(spark, sf_dir), r).select("region", "doc", "page", "ord", "word")


@plan(BOXES + " SELECT doc, page, ord, round(least(greatest((y0 + y1) / 2 / 900, 0.0), 1.0), 6) AS y, CASE WHEN least(greatest((y0 + y1) / 2 / 900, 0.0), 1.0) >= 0.85 THEN 'header' WHEN least(greatest((y0 + y1) / 2 / 900, 0.0), 1.0) >= 0.70 THEN 'subheader' WHEN least(greatest((y0 + y1) / 2 / 900, 0.0), 1.0) <= 0.15 THEN 'footer' ELSE 'body' END AS band FROM b")
def bands(spark, sf_dir):
    y = layout.clamp01((F.col("y0") + F.col("y1")) / 2 / 900)
    return _boxes(spark, sf_dir).select("doc", "page", "ord", F.round(y, 6).alias("y"), layout.band(y).alias("band"))


@plan(BOXES + " SELECT doc, page, word, round(x0, 3) AS x, min(ord) AS ord FROM b GROUP BY doc, page, word, round(x0, 3)")
def word_dedupe(spark, sf_dir):
    b = _boxes(spark, sf_dir).withColumn("x", F.round("x0", 3))
    return lookup.first_of(b, [F.col(c) for c in ("doc", "page", "word", "x")], F.col("ord")).select("doc", "page", "word", "x", "ord")


@plan(BOXES + ", s AS (SELECT doc, page, ord, y0, x0, CASE WHEN abs(y0 - lag(y0) OVER w) > 40 THEN 1 ELSE 0 END AS n FROM b WINDOW w AS (PARTITION BY doc, page ORDER BY y0 DESC, x0, ord)) SELECT doc, page, ord, y0, CAST(sum(n) OVER (PARTITION BY doc, page ORDER BY y0 DESC, x0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS line FROM s")
def line_sessions(spark, sf_dir):
    return lookup.line_groups(_boxes(spark, sf_dir), 40).select("doc", "page", "ord", "y0", "line")


@plan()
def line_anchors(spark, sf_dir):
    return udfs.anchored_lines(_boxes(spark, sf_dir), 40.0).select("doc", "page", "ord", "line")


# statistics


NGRAMS = r""", w AS (SELECT doc, string_split(trim(regexp_replace(lower(strip_accents(text)), '[^a-z]+', ' ', 'g')), ' ') AS t FROM p), g AS (SELECT doc, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS gram FROM w)
SELECT gram, count(DISTINCT doc) AS docs, count(*) AS n FROM g GROUP BY gram ORDER BY docs DESC, n DESC, gram LIMIT 40"""


@plan(NGRAMS, pages=True)
def ngram_docfreq(spark, sf_dir):
    words = F.split(F.trim(F.regexp_replace(F.lower(unaccent(F.col("text"))), "[^a-z]+", " ")), " ")
    w = corpus.pages(spark, sf_dir).select("doc", words.alias("t"))
    grams = F.when(F.size("t") > 1, F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat_ws(" ", F.element_at("t", i), F.element_at("t", i + 1))))
    g = w.select("doc", F.explode(grams).alias("gram")).groupBy("gram", "doc").agg(F.count("*").alias("k"))
    return g.groupBy("gram").agg(F.count("*").alias("docs"), F.sum("k").alias("n")).orderBy(F.desc("docs"), F.desc("n"), "gram").limit(40)


@plan("SELECT l_returnflag, round(median(l_quantity), 6) AS med, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3 FROM lineitem GROUP BY l_returnflag")
def mode_median_quantile(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    middle, ends = quantile.quantiles(l, ["l_returnflag"], "l_quantity", {"med": 0.5}), quantile.quantiles(l, ["l_returnflag"], "l_extendedprice", {"q1": 0.25, "q3": 0.75})
    return middle.join(ends, "l_returnflag").select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("med", "q1", "q3")])


@plan("WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY event_type) SELECT event_id, e.event_type, value, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS outlier FROM events e JOIN q ON q.event_type = e.event_type")
def iqr_outliers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    q = quantile.quantiles(e, ["event_type"], "value", {"a": 0.25, "b": 0.75})
    v, a, b = F.col("value"), F.col("a"), F.col("b")
    return e.join(q, "event_type").select("event_id", "event_type", "value", ((v < a - 1.5 * (b - a)) | (v > b + 1.5 * (b - a))).alias("outlier"))


COVER = ["processo", "juizo", "perito_nome", "cpf_perito", "especialidade", "valor_arbitrado", "numero_autos", "autor", "parte_contraria", "comarca"]
LONG = " UNION ALL ".join(f"SELECT rec_id, '{c}' AS field, CASE WHEN {_filled(c)} THEN {c} END AS value FROM {DADOS}" for c in COVER)


@plan(LONG)
def fields_long(spark, sf_dir):
    return extract.long_form(table(spark, sf_dir, DADOS), "rec_id", COVER)


BODY = " OR ".join(f"contains(nv, '{w}')" for w in ("juizo", "vara", "comarca", "tribunal", "diretoria", "poder judiciario", "secretaria", "cartorio"))
SUSPECT = (
    "CASE WHEN field = 'cpf_perito' THEN length(regexp_replace(value, '\\D', '', 'g')) <> 11 OR regexp_full_match(regexp_replace(value, '\\D', '', 'g'), '(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)') "
    "WHEN field = 'numero_autos' THEN NOT regexp_matches(value, '\\d{7}-\\d{2}\\.\\d{4}\\.\\d\\.\\d{2}\\.\\d{4}') "
    "WHEN starts_with(field, 'valor_') THEN NOT regexp_full_match(value, '\\s*(?:R\\$ ?)?\\d{1,3}(?:\\.?\\d{3})*(?:[.,]\\d{2})?\\s*') "
    f"WHEN field IN ('autor', 'parte_contraria', 'perito_nome') THEN {BODY} OR regexp_matches(value, '\\d') "
    "WHEN field IN ('juizo', 'comarca') THEN NOT contains(nv, 'vara') AND NOT contains(nv, 'comarca') AND length(nv) < 6 ELSE false END"
)
COVERAGE = f"""WITH l AS ({LONG}), f AS (SELECT *, {_fold('value')} AS nv FROM l), s AS (SELECT *, coalesce(value IS NOT NULL AND ({SUSPECT}), false) AS bad FROM f),
e AS (SELECT field, string_agg(value, ' | ' ORDER BY rec_id) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY rec_id) AS n FROM s WHERE bad) WHERE n <= 5 GROUP BY field)
SELECT c.*, e.examples FROM (SELECT field, count(*) AS n, count(value) AS filled, count(*) FILTER (bad) AS suspect, count(*) - count(value) AS missing FROM s GROUP BY field) c LEFT JOIN e ON e.field = c.field"""


@plan(COVERAGE)
def field_coverage_report(spark, sf_dir):
    return extract.coverage(extract.long_form(table(spark, sf_dir, DADOS), "rec_id", COVER), "rec_id")


@plan(f"WITH l AS ({LONG}), f AS (SELECT *, {_fold('value')} AS nv FROM l WHERE value IS NOT NULL) SELECT rec_id, field, value FROM f WHERE {SUSPECT}")
def suspect_rules(spark, sf_dir):
    long = extract.long_form(table(spark, sf_dir, DADOS), "rec_id", COVER).where("value is not null")
    return long.where(extract.suspect(F.col("field"), F.col("value")))


def _stage(p: str, g: int) -> str:
    return f"regexp_extract(t, '{p}', {g})"


EXTRACT = ", x AS (SELECT doc, page, regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g') AS t FROM p), c AS (" + " UNION ALL ".join(
    f"SELECT doc, page, '{f}' AS field, {i} AS stage, {_stage(p, g)} AS value, '{m}' AS method, {c}::DOUBLE AS confidence FROM x" for f, st in extract.CASCADES.items() for i, (p, g, m, c) in enumerate(st)
) + ") SELECT doc, field, value, method, confidence, page FROM (SELECT *, row_number() OVER (PARTITION BY doc, field ORDER BY stage, page) AS n FROM c WHERE value <> '') WHERE n = 1"


@plan(EXTRACT, pages=True)
def extract_fields(spark, sf_dir):
    return extract.fields(extract.candidates(corpus.pages(spark, sf_dir)))


_CUES = (
    ("words BETWEEN 400 AND 600", 0.10), ("images = 1", 0.10), ("images = 0", 0.05), ("len(list_filter(fonts, lambda x: contains(x, 'TimesNewRoman'))) > 0", 0.05), ("regexp_matches(text, '(?i)PODER JUDICIÁRIO.*TRIBUNAL DE JUSTIÇA')", 0.15), ("regexp_matches(text, '(?i)Despacho [a-z]+ n[ºo°]')", 0.20),
    ("contains(lower(text), 'pagamento de honorários')", 0.15), ("regexp_matches(text, '(?i)arbitrados em favor do Perito|favor do.*Perito')", 0.10), ("contains(lower(text), 'protocolo')", 0.15), ("contains(lower(text), 'resolução 09/2017') OR contains(lower(text), 'resolução 232')", 0.10), (r"regexp_matches(text, '\d{6}-\d{2}\.\d{4}\.\d\.\d{2}')", 0.05),
)


@plan(" SELECT doc, page, round(" + " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w in _CUES) + ", 4)::DOUBLE AS score FROM p", pages=True)
def type_score(spark, sf_dir):
    t, low = F.col("text"), F.lower("text")
    score = extract.weighted_score([
        (F.col("words").between(400, 600), 0.10), (F.col("images") == 1, 0.10), (F.col("images") == 0, 0.05), (F.exists("fonts", lambda x: x.contains("TimesNewRoman")), 0.05), (t.rlike("(?iu)PODER JUDICIÁRIO.*TRIBUNAL DE JUSTIÇA"), 0.15), (t.rlike("(?iu)Despacho [a-z]+ n[ºo°]"), 0.20),
        (low.contains("pagamento de honorários"), 0.15), (t.rlike("(?iu)arbitrados em favor do Perito|favor do.*Perito"), 0.10), (low.contains("protocolo"), 0.15), (low.contains("resolução 09/2017") | low.contains("resolução 232"), 0.10), (t.rlike(r"\d{6}-\d{2}\.\d{4}\.\d\.\d{2}"), 0.05),
    ])
    return corpus.pages(spark, sf_dir).select("doc", "page", F.round(score, 4).alias("score"))


BUCKETS = (("laudo", "laudo|quesito|perícia|pericial|esclarecimento|parecer"), ("principal", "despacho|decisão|decisao|senten|certidao|certidão|oficio|ofício|nota de empenho|autorizacao|autorização|requisição|requisicao"), ("apoio", "anexo|relatório|relatorio|planilha"))


@plan("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(substr(coalesce(text, ''), 1, 2000)), '{p}') OR regexp_matches(lower(coalesce(doc_type, '')), '{p}') THEN '{b}'" for b, p in BUCKETS) + " ELSE 'outro' END AS bucket FROM documents")
def bucket_class(spark, sf_dir):
    # the first 2,000 characters are what this classifier is defined on
    head, name = F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 2000)), F.lower(F.coalesce("doc_type", F.lit("")))
    out = F.when(head.rlike(BUCKETS[0][1]) | name.rlike(BUCKETS[0][1]), BUCKETS[0][0])
    for b, p in BUCKETS[1:]:
        out = out.when(head.rlike(p) | name.rlike(p), b)
    return table(spark, sf_dir, "documents").select("doc_id", out.otherwise("outro").alias("bucket"))


KINDS = (("DESPACHO", "Despacho"), ("SENTENÇA", "Sentença"), ("DECISÃO", "Decisão"), ("CERTIDÃO", "Certidão"), ("OFÍCIO", "Ofício"), ("ATA", "Ata"), ("PROCESSO|AUTOS", "Processo Judicial"), ("RELATÓRIO", "Relatório"))


@plan(", f AS (SELECT doc, page, upper(array_to_string(list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 1, 20), chr(10))) AS t FROM p) SELECT doc, page, CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for p, k in KINDS) + " ELSE 'Documento' END AS kind FROM f", pages=True)
def doc_type_rules(spark, sf_dir):
    t = F.upper(F.array_join(F.slice(text.full_lines(F.col("text")), 1, 20), "\n"))
    out = F.when(t.rlike(KINDS[0][0]), KINDS[0][1])
    for p, k in KINDS[1:]:
        out = out.when(t.rlike(p), k)
    return corpus.pages(spark, sf_dir).select("doc", "page", out.otherwise("Documento").alias("kind"))


TITLE = r""", c AS (SELECT doc, page, text, list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 5), 1, 8) AS ls FROM p),
s AS (SELECT doc, page, text, unnest(ls) AS t, generate_subscripts(ls, 1) AS i FROM c), b AS (SELECT doc, page, t FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY CASE WHEN length(t) BETWEEN 10 AND 100 THEN 3 ELSE 0 END + CASE WHEN regexp_matches(t, '^\p{Lu}') THEN 2 ELSE 0 END - CASE WHEN regexp_matches(t, '^\d') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(t, '[.,;:]$') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(t, '\. ') THEN 1 ELSE 0 END DESC, i) AS n FROM s) WHERE n = 1)
SELECT p.doc, p.page, coalesce(b.t, array_to_string(list_slice(list_filter(string_split_regex(p.text, '[ \n\t]'), lambda x: x <> ''), 1, 10), ' ')) AS title FROM p LEFT JOIN b ON b.doc = p.doc AND b.page = p.page"""


@plan(TITLE, pages=True)
def title_heuristic(spark, sf_dir):
    return corpus.pages(spark, sf_dir).select("doc", "page", segment.title(F.col("text")).alias("title"))


# scalar functions


MONEY = r"""WITH v AS (SELECT rec_id, trim(regexp_replace(valor_arbitrado, 'R\$|\s', '', 'g')) AS v FROM dados_diretoria_especial_v5) SELECT rec_id, CAST(CASE WHEN regexp_full_match(v, '-?\d{1,3}(?:\.\d{3})*(?:,\d{1,2})?|-?\d+(?:,\d{1,2})?') THEN replace(replace(v, '.', ''), ',', '.') END AS DECIMAL(18,2))::DOUBLE AS amount FROM v"""


@plan(MONEY)
def money_parse(spark, sf_dir):
    return table(spark, sf_dir, DADOS).select("rec_id", text.parse_money(F.col("valor_arbitrado")).cast("double").alias("amount"))


DATES = r"""WITH d AS (SELECT page_id, regexp_extract(coalesce(text, ''), '(\d{1,2}) de ([a-zç]+) de (\d{4})', ['d', 'm', 'y']) AS x FROM pages WHERE regexp_matches(text, '\d{1,2} de [a-zç]+ de \d{4}')) SELECT page_id, strftime(try_strptime(x.y || '-' || lpad(CAST(list_position(['janeiro','fevereiro','marco','abril','maio','junho','julho','agosto','setembro','outubro','novembro','dezembro'], strip_accents(x.m)) AS VARCHAR), 2, '0') || '-' || lpad(x.d, 2, '0'), '%Y-%m-%d'), '%Y-%m-%d') AS day FROM d"""


@plan(DATES)
def date_parse_pt(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where(F.col("text").rlike(r"\d{1,2} de [a-zç]+ de \d{4}"))
    written = F.regexp_extract("text", r"(\d{1,2} de [a-zç]+ de \d{4})", 1)
    return p.select("page_id", F.date_format(text.parse_date(written), "yyyy-MM-dd").alias("day"))


@plan(r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[\x00-\x1f\x7f]+', ' ', 'g'), ' +', ' ', 'g'))) AS text_hash, md5(lower(trim(coalesce(header, '')))) AS header_hash FROM pages")
def text_hashes(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.for_hash(t), 256).alias("text_hash"), F.md5(F.lower(F.trim(F.coalesce("header", F.lit(""))))).alias("header_hash"))


@plan(r"SELECT page_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g')) AS flat, trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^a-z0-9 \t\n\r\f\v/.-]', '', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS matchable FROM pages")
def text_clean(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", text.collapse_space(t).alias("flat"), text.for_match(t).alias("matchable"))


DOUBLED = """WITH n AS (SELECT n_nationkey AS k, list_reduce(list_transform(string_split(n_name, ''), lambda c: c || c), lambda a, b: a || b) AS s FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region),
p AS (SELECT k, s, list_transform(range(1, length(s), 2), lambda i: substr(s, i, 2)) AS ps FROM n) SELECT k, CASE WHEN length(s) >= 4 AND length(s) % 2 = 0 AND len(list_filter(ps, lambda x: x[1] = x[2])) >= 3 AND len(list_filter(ps, lambda x: x[1] = x[2])) >= 0.7 * len(ps) THEN list_reduce(list_transform(ps, lambda x: x[1]), lambda a, b: a || b) ELSE s END AS plain FROM p"""


@plan(DOUBLED)
def collapse_doubled(spark, sf_dir):
    twice = F.array_join(F.transform(F.split("n_name", ""), lambda c: F.concat(c, c)), "")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), twice.alias("s"))
    r = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("k"), F.col("r_name").alias("s"))
    return n.unionByName(r).select("k", text.collapse_doubled(F.col("s")).alias("plain"))


_SCAN = "regexp_extract_all(t, '[A-Za-z0-9+/]{20,}={0,2}')"


@plan(f"WITH c AS (SELECT c_custkey, 'em anexo: ' || to_base64(encode(c_name || '/' || c_mktsegment)) || ' e ' || substr(to_base64(encode(c_name || c_name)), 1, 21) || '; ' || c_name AS t FROM customer), h AS (SELECT c_custkey, t, unnest({_SCAN}) AS b, generate_subscripts({_SCAN}, 1) AS n FROM c) SELECT c_custkey, CAST(n AS INT) AS n, CAST(length(b) AS INT) AS chars, length(b) % 4 = 0 AND TRY(from_base64(b)) IS NOT NULL AS decodable, CASE WHEN length(b) % 4 = 0 THEN octet_length(TRY(from_base64(b))) END::BIGINT AS bytes FROM h")
def base64_scan(spark, sf_dir):
    whole, cut = F.base64(F.encode(F.concat_ws("/", "c_name", "c_mktsegment"), "UTF-8")), F.substring(F.base64(F.encode(F.concat("c_name", "c_name"), "UTF-8")), 1, 21)
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("em anexo: "), whole, F.lit(" e "), cut, F.lit("; "), "c_name").alias("t"))
    return layout.base64_parts(c, "t").select("c_custkey", "n", "chars", "decodable", "bytes")


_HEADS = ("FFD8FFE0", "89504E470D0A", "474946383961", "424D3600", "255044462D31", "504B03040A00", "00010203")
_HEX = "hex(encode(o_orderstatus)) || hex(encode(o_orderpriority))"


@plan("WITH o AS (SELECT o_orderkey, [" + ", ".join(f"'{h}'" for h in _HEADS) + f"][CAST(abs(o_custkey) % 7 AS INT) + 1] || {_HEX} AS h FROM orders) SELECT o_orderkey, CASE WHEN starts_with(h, 'FFD8FF') THEN 'jpeg' WHEN starts_with(h, '89504E47') THEN 'png' WHEN starts_with(h, '47494638') THEN 'gif' WHEN starts_with(h, '424D') THEN 'bmp' WHEN starts_with(h, '25504446') THEN 'pdf' WHEN starts_with(h, '504B0304') THEN 'zip' ELSE 'unknown' END AS kind FROM o")
def magic_sniff(spark, sf_dir):
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (F.abs("o_custkey") % 7 + 1).cast("int"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.unhex(F.concat(head, F.hex(F.encode("o_orderstatus", "UTF-8")), F.hex(F.encode("o_orderpriority", "UTF-8")))).alias("b"))
    return o.select("o_orderkey", layout.magic(F.col("b")).alias("kind"))


@plan("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def json_props_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"), F.get_json_object("props", "$.none").alias("missing"))


@plan("SELECT cache_id, lower(process_number) || '_' || lpad(CAST(cache_id % 1000 AS VARCHAR), 3, '0') || '_' || lpad(CAST(doc_total_pages AS VARCHAR), 4, '0') AS doc_key, regexp_extract(cache_name, '(\\d+)', 1) AS digits FROM caches WHERE process_number IS NOT NULL AND doc_total_pages IS NOT NULL")
def doc_keys(spark, sf_dir):
    c = table(spark, sf_dir, "caches").where("process_number is not null and doc_total_pages is not null")
    return c.select("cache_id", layout.doc_key(F.col("process_number"), F.col("cache_id") % 1000, F.col("doc_total_pages"), safe=True).alias("doc_key"), F.regexp_extract("cache_name", r"(\d+)", 1).alias("digits"))


@plan(r"SELECT page_id, regexp_replace(coalesce(text, ''), '(^|[^\p{L}\p{N}_])(?i:(laudo))([^\p{L}\p{N}_]|$)', '\1__\2__\3', 'g') AS marked FROM pages WHERE regexp_matches(text, '(?i)laudo') AND NOT regexp_matches(text, '(?i)laudo[^\p{L}\p{N}_]laudo')")
def highlight_terms(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where(F.col("text").rlike("(?iu)laudo") & ~F.col("text").rlike(r"(?iu)laudo[^\p{L}\p{N}_]laudo"))
    return p.select("page_id", text.highlight(F.coalesce("text", F.lit("")), "laudo").alias("marked"))


@plan()
def char_diff_similarity(spark, sf_dir):
    d = table(spark, sf_dir, DADOS).where(filled(F.col("perito_nome")))
    v = d.groupBy("perito_nome").agg(F.max("autor").alias("other"))
    return v.select("perito_nome", udfs.char_similarity(F.lower("perito_nome"), F.lower("other")).alias("similarity"))


@plan()
def fuzzy_anchor(spark, sf_dir):
    return corpus.pages(spark, sf_dir).select("doc", "page", udfs.fuzzy_position(F.col("text"), "documento assinado eletronicamente", 3).alias("at")).where("at >= 0")


@plan()
def mixed_json_object(spark, sf_dir):
    return table(spark, sf_dir, "raw_processes").select("process_number", F.length(udfs.first_object(F.concat(F.lit("log: "), "raw_json", F.lit(" end")))).alias("n")).where("n is not null")


QUERIES, SQL = plan.queries, plan.sql
