"""Further queries: documents from rows, merged fields, geometry, summaries, classes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folhario.functions import text
from folhario.functions.values import fold
from folhario.operators import lookup, quantile, segment, tree
from folhario.operators.nested import flatten
from folhario.plans.base import Plans
from folhario.plans.records import BOXES, DADOS, _boxes, _fold
from folhario.runtime import table
from folhario.sources import corpus

plan = Plans()


@plan("SELECT c.cache_id AS doc, c.source, count(p.page_id) AS n, coalesce(string_agg(CAST(p.page_number AS VARCHAR), ',' ORDER BY p.page_number), '') AS page_list FROM caches c LEFT JOIN pages p ON p.cache_id = c.cache_id GROUP BY c.cache_id, c.source")
def rebuild_documents(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).select("doc", "source")
    p = corpus.pages(spark, sf_dir).select("doc", "page", "words", "chars")
    n = tree.nest(d, p, "doc", "pages", "page")
    return n.select("doc", "source", F.size("pages").cast("bigint").alias("n"), F.array_join(F.transform("pages", lambda x: x["page"].cast("string")), ",").alias("page_list"))


@plan("SELECT doc, '{\"found\":' || count(*) || ',\"pages\":[' || string_agg('{\"page\":' || page || ',\"words\":' || words || '}', ',' ORDER BY page) || ']}' AS body FROM p WHERE words < 60 GROUP BY doc", pages=True)
def json_envelope(spark, sf_dir):
    return tree.envelope(corpus.pages(spark, sf_dir).where("words < 60").select("doc", "page", "words"), "doc", "pages", "page")


@plan("SELECT p.page_id, c.cache_name, c.source, p.page_number FROM pages p JOIN caches c ON c.cache_id = p.cache_id WHERE p.has_money = 1 AND p.has_cpf = 1")
def corpus_scan(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where("has_money = 1 AND has_cpf = 1").select("page_id", "cache_id", "page_number")
    return p.join(table(spark, sf_dir, "caches").select("cache_id", "cache_name", "source"), "cache_id").drop("cache_id")


@plan("SELECT c.cache_id, coalesce(count(p.page_id) FILTER (p.page_type = 'despacho'), 0) AS marks FROM caches c LEFT JOIN pages p ON p.cache_id = c.cache_id GROUP BY c.cache_id")
def mark_counts(spark, sf_dir):
    m = table(spark, sf_dir, "pages").where("page_type = 'despacho'").groupBy("cache_id").agg(F.count("*").alias("marks"))
    return table(spark, sf_dir, "caches").select("cache_id").join(m, "cache_id", "left").na.fill(0, ["marks"])


@plan("WITH a AS (SELECT cache_id, page_number, text FROM pages WHERE cache_id % 2 = 1), b AS (SELECT cache_id - 1 AS cache_id, page_number, text FROM pages WHERE cache_id % 2 = 0) SELECT b.cache_id, b.page_number, a.text IS NULL AS only_new, coalesce(length(b.text), 0) - coalesce(length(a.text), 0) AS grown FROM a RIGHT JOIN b ON a.cache_id = b.cache_id AND a.page_number = b.page_number")
def pages_matched(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("cache_id", "page_number", "text")
    a = p.where("cache_id % 2 = 1").withColumnRenamed("text", "old")
    b = p.where("cache_id % 2 = 0").withColumn("cache_id", F.col("cache_id") - 1)
    j = a.join(b, ["cache_id", "page_number"], "right")
    return j.select("cache_id", "page_number", F.col("old").isNull().alias("only_new"), (F.coalesce(F.length("text"), F.lit(0)) - F.coalesce(F.length("old"), F.lit(0))).cast("bigint").alias("grown"))


HEAD = """, f AS (SELECT doc, arg_min(text, page) AS a, arg_max(text, page) AS b FROM p GROUP BY doc), l AS (SELECT doc, list_filter(list_transform(string_split(a, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS x, list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS y FROM f)
SELECT doc, x[1] AS origin, x[2] AS title, x[3] AS subtitle, array_to_string(list_slice(y, greatest(len(y) - 9, 1), len(y)), chr(10)) AS footer_raw FROM l"""


@plan(HEAD, pages=True)
def document_heads(spark, sf_dir):
    g = corpus.pages(spark, sf_dir).groupBy("doc").agg(F.min_by("text", "page").alias("a"), F.max_by("text", "page").alias("b"))
    x, y = text.full_lines(F.col("a")), text.full_lines(F.col("b"))
    tail = F.array_join(F.slice(y, F.greatest(F.size(y) - 9, F.lit(1)), F.lit(10)), "\n")
    return g.select("doc", text.nth(x, 1).alias("origin"), text.nth(x, 2).alias("title"), text.nth(x, 3).alias("subtitle"), tail.alias("footer_raw"))


@plan(BOXES + " SELECT doc, page, round(least(sum((x1 - x0) * (y1 - y0)) / (595.0 * 842.0), 1.0), 6)::DOUBLE AS density FROM b GROUP BY doc, page")
def text_density(spark, sf_dir):
    area = F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))) / (595.0 * 842.0)
    return _boxes(spark, sf_dir).groupBy("doc", "page").agg(F.round(F.least(area, F.lit(1.0)), 6).alias("density"))


@plan(BOXES + ", g AS (SELECT doc, page, word, max(x1) AS weight, max_by(ord, x1 * 1000000 + ord) AS src FROM b GROUP BY doc, page, word) SELECT doc, page, word, weight, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY weight DESC, src DESC, word) AS n FROM g) WHERE n <= 2")
def merged_fields_top2(spark, sf_dir):
    b = _boxes(spark, sf_dir).select("doc", "page", "word", F.col("x1").alias("weight"), F.col("ord").alias("src"))
    return tree.top_values(b, ["doc", "page"], "word", "weight", "src", 2)


@plan(BOXES + ", s AS (SELECT doc, page, CAST(floor(y0 / 100) AS INT) AS line, x0, x1, ord FROM b), g AS (SELECT doc, page, line, x0 - lag(x1) OVER (PARTITION BY doc, page, line ORDER BY x0, ord) AS g FROM s), l AS (SELECT doc, page, line, list_sort(list(g)) AS gs FROM g WHERE g > 0 GROUP BY ALL) SELECT doc, page, line, round(least(gs[CAST(floor((len(gs) - 1) * 0.9) AS INT) + 1] * 0.3, 10.0), 6)::DOUBLE AS gap FROM l")
def word_gap_quantile(spark, sf_dir):
    s = _boxes(spark, sf_dir).withColumn("line", F.floor(F.col("y0") / 100).cast("int"))
    return tree.word_gaps(s).withColumn("gap", F.round("gap", 6))


@plan(BOXES + ", s AS (SELECT doc, page, CAST(floor(y0 / 100) AS INT) AS line, x0, ord, word FROM b) SELECT doc, page, line, string_agg(word, ' ' ORDER BY x0, ord, word) AS text FROM s GROUP BY doc, page, line")
def line_texts(spark, sf_dir):
    return tree.line_texts(_boxes(spark, sf_dir).withColumn("line", F.floor(F.col("y0") / 100).cast("int")))


@plan(", t AS (SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY words DESC, page) AS r, max(page) OVER (PARTITION BY doc) AS last FROM p) SELECT DISTINCT doc, page AS start_page, least(page + s - 1, last) AS end_page FROM t, (VALUES (2), (3), (4)) v(s) WHERE r <= 6", pages=True)
def candidate_windows(spark, sf_dir):
    return tree.windows_of(corpus.pages(spark, sf_dir).select("doc", "page", "words"))


@plan(", s AS (SELECT doc, max(CASE WHEN contains(lower(substr(text, CAST(floor(length(text) * 0.7) AS BIGINT) + 1)), 'assinado eletronicamente') THEN page END) AS a, max(CASE WHEN contains(lower(text), 'assinado') THEN page END) AS b, max(page) AS c FROM p GROUP BY doc) SELECT doc, coalesce(a, b, c) AS page FROM s", pages=True)
def signature_page(spark, sf_dir):
    low = F.lower("text")
    tail = F.substr(low, (F.floor(F.length("text") * 0.7) + 1).cast("int"))
    s = corpus.pages(spark, sf_dir).groupBy("doc").agg(F.max(F.when(tail.contains("assinado eletronicamente"), F.col("page"))).alias("a"), F.max(F.when(low.contains("assinado"), F.col("page"))).alias("b"), F.max("page").alias("c"))
    return s.select("doc", F.coalesce("a", "b", "c").alias("page"))


@plan(BOXES + ", k AS (SELECT *, CASE WHEN y0 >= 700 THEN 'top' WHEN y0 >= 300 THEN 'middle' ELSE 'bottom' END AS band FROM b) SELECT band, count(*) AS n, round(median(x0), 4) AS x_median, round(quantile_cont(y0, 0.25), 4) AS y_p25, round(quantile_cont(y0, 0.75), 4) AS y_p75 FROM k GROUP BY band")
def band_summary(spark, sf_dir):
    y = F.col("y0")
    k = _boxes(spark, sf_dir).withColumn("band", F.when(y >= 700, "top").when(y >= 300, "middle").otherwise("bottom"))
    x, y = quantile.quantiles(k, ["band"], "x0", {"x_median": 0.5}), quantile.quantiles(k, ["band"], "y0", {"y_p25": 0.25, "y_p75": 0.75})
    return k.groupBy("band").agg(F.count("*").alias("n")).join(x, "band").join(y, "band").select("band", "n", *[F.round(c, 4).alias(c) for c in ("x_median", "y_p25", "y_p75")])


@plan("WITH m AS (SELECT o_orderpriority, median(o_totalprice) AS med FROM orders GROUP BY 1) SELECT o.o_orderkey, o.o_totalprice FROM orders o JOIN m ON m.o_orderpriority = o.o_orderpriority WHERE abs(o.o_totalprice - med) / med > 0.95 ORDER BY o_orderkey LIMIT 10")
def outlier_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = quantile.quantiles(o, ["o_orderpriority"], "o_totalprice", {"med": 0.5})
    return o.join(m, "o_orderpriority").where(F.abs(F.col("o_totalprice") - F.col("med")) / F.col("med") > 0.95).select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(10)


@plan("SELECT comarca, count(*) AS n, round(sum(amount), 2)::DOUBLE AS total FROM (SELECT " + _fold("comarca") + r" AS comarca, TRY_CAST(CASE WHEN regexp_full_match(trim(regexp_replace(valor_arbitrado, 'R\$|\s', '', 'g')), '-?\d{1,3}(?:\.\d{3})*(?:,\d{1,2})?|-?\d+(?:,\d{1,2})?') THEN replace(replace(trim(regexp_replace(valor_arbitrado, 'R\$|\s', '', 'g')), '.', ''), ',', '.') END AS DECIMAL(18,2)) AS amount FROM dados_diretoria_especial_v5) GROUP BY comarca")
def amount_by_court(spark, sf_dir):
    d = table(spark, sf_dir, DADOS).select(fold(F.col("comarca")).alias("comarca"), text.parse_money(F.col("valor_arbitrado")).alias("amount"))
    return d.groupBy("comarca").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).cast("double").alias("total"))


@plan("SELECT extract('year' FROM extraction_date) AS year, count(*) AS n, count(DISTINCT processo) AS processes, min(rec_id) AS first_rec FROM dados_diretoria_especial_v5 GROUP BY 1")
def counts_by_year(spark, sf_dir):
    return table(spark, sf_dir, DADOS).groupBy(F.year("extraction_date").cast("bigint").alias("year")).agg(F.count("*").alias("n"), F.count_distinct("processo").alias("processes"), F.min("rec_id").alias("first_rec"))


PATTERNS = {"labelled": r"^Processo", "dashes": r"\d{4}-\d{2}-\d{7}", "slash": r"\d{4}/\d{2}-\d{7}", "plain": r"^\d{13}$", "dots": r"\d{4}\.\d{2}\.\d{7}"}


@plan("SELECT name, rate, row_number() OVER (ORDER BY rate DESC, name) AS rank FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS name, round(avg(CASE WHEN regexp_matches(processo, '{p}') THEN 1.0 ELSE 0.0 END), 6) AS rate FROM {DADOS} WHERE processo IS NOT NULL" for k, p in PATTERNS.items()) + ")")
def pattern_success(spark, sf_dir):
    d = table(spark, sf_dir, DADOS).where("processo is not null")
    one = d.agg(*[F.round(F.avg(F.col("processo").rlike(p).cast("int")), 6).alias(k) for k, p in PATTERNS.items()])
    # five rows, one for each pattern
    long = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("rate")) for k in PATTERNS])).alias("e")).select("e.*")
    return long.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rate"), "name")).cast("bigint"))


@plan("WITH k AS (SELECT cache_id, regexp_extract(cache_name, '(\\d+)', 1) AS process, size_bytes FROM caches) SELECT process, count(*) AS files, count(DISTINCT size_bytes) AS sizes, CASE WHEN count(DISTINCT size_bytes) > 1 THEN 'strong' ELSE 'weak' END AS kind FROM k GROUP BY process HAVING count(*) > 1")
def duplicate_files(spark, sf_dir):
    k = table(spark, sf_dir, "caches").select(F.regexp_extract("cache_name", r"(\d+)", 1).alias("process"), "size_bytes")
    g = k.groupBy("process").agg(F.count("*").alias("files"), F.count_distinct("size_bytes").alias("sizes")).where("files > 1")
    return g.withColumn("kind", F.when(F.col("sizes") > 1, "strong").otherwise("weak"))


@plan("SELECT process_number, source, extraction_mode, doc_total_pages FROM caches WHERE extraction_mode IS NULL UNION ALL SELECT process_number, source, NULL, NULL FROM raw_processes")
def concat_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "caches").where("extraction_mode is null").select("process_number", "source", "extraction_mode", "doc_total_pages")
    return a.unionByName(table(spark, sf_dir, "raw_processes").select("process_number", "source"), allowMissingColumns=True)


@plan("SELECT process_number, doc_total_pages FROM caches ORDER BY process_number NULLS LAST, cache_id LIMIT 50")
def sort_nulls_last(spark, sf_dir):
    return table(spark, sf_dir, "caches").orderBy(F.asc_nulls_last("process_number"), "cache_id").limit(50).select("process_number", "doc_total_pages")


@plan("SELECT process_number, source, CAST(position AS BIGINT) AS position FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC NULLS LAST, process_number) AS position FROM raw_processes) WHERE position BETWEEN 3 AND 12 OR position = 20")
def corpus_index_range(spark, sf_dir):
    d = corpus.newest_first(table(spark, sf_dir, "raw_processes").select("process_number", "source", "created_at"), "created_at", "process_number")
    return d.where("position BETWEEN 3 AND 12 OR position = 20").select("process_number", "source", "position")


@plan(BOXES + " SELECT doc, page, count(*) AS words, bool_and(abs(x0 - mx) <= 300) AS same_width FROM (SELECT *, min(x0) OVER (PARTITION BY doc, page) AS mx FROM b) GROUP BY doc, page")
def same_size_check(spark, sf_dir):
    w = Window.partitionBy("doc", "page")
    b = _boxes(spark, sf_dir).withColumn("mx", F.min("x0").over(w))
    return b.groupBy("doc", "page").agg(F.count("*").alias("words"), F.bool_and(F.abs(F.col("x0") - F.col("mx")) <= 300).alias("same_width"))


SEI = r"SELECT page_id, nullif(regexp_extract(text, 'Processo administrativo n[º°] ([\d.]+)', 1), '') AS process, nullif(regexp_extract(text, 'https?://[^ \n\t]+', 0), '') AS auth_url, nullif(regexp_extract(text, 'c[óo]digo ([0-9A-F]{8})', 1), '') AS verifier, nullif(trim(regexp_extract(text, 'eletronicamente por ([^,\n]+),', 1)), '') AS signer FROM pages WHERE text IS NOT NULL"


@plan(SEI)
def tail_metadata(spark, sf_dir):
    got = lambda p, g: F.nullif(F.trim(F.regexp_extract("text", p, g)), F.lit(""))
    p = table(spark, sf_dir, "pages").where("text is not null")
    return p.select("page_id", got(r"Processo administrativo n[º°] ([\d.]+)", 1).alias("process"), got(r"https?://[^ \n\t]+", 0).alias("auth_url"), got(r"c[óo]digo ([0-9A-F]{8})", 1).alias("verifier"), got(r"eletronicamente por ([^,\n]+),", 1).alias("signer"))


@plan(r", m AS (SELECT doc, page, text FROM p WHERE regexp_matches(text, '(?i)honorários')), v AS (SELECT doc, page, unnest(list_transform(regexp_extract_all(text, 'R\$\s*(\d{1,3}(?:\.\d{3})*(?:,\d{2})?)', 1), lambda x: CAST(replace(replace(x, '.', ''), ',', '.') AS DECIMAL(18,2)))) AS amount FROM m) SELECT doc, count(*) AS n, max(amount)::DOUBLE AS most, sum(amount)::DOUBLE AS total FROM v GROUP BY doc", pages=True)
def directed_amounts(spark, sf_dir):
    m = corpus.pages(spark, sf_dir).where(F.col("text").rlike("(?iu)honorários"))
    v = m.select("doc", F.explode(text.money_values(F.col("text"))).alias("amount"))
    return v.groupBy("doc").agg(F.count("*").alias("n"), F.max("amount").cast("double").alias("most"), F.sum("amount").cast("double").alias("total"))


@plan("SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bucket, count(*) AS n, round(avg(value), 6) AS mean, min(event_id) AS sample FROM events GROUP BY ALL")
def value_histogram(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.floor(F.col("value") / 10).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("event_id").alias("sample"))


@plan(BOXES + " SELECT doc, page, ord, line FROM (SELECT doc, page, ord, dense_rank() OVER (PARTITION BY doc, page ORDER BY y0 DESC) AS line, row_number() OVER (PARTITION BY doc, page, word ORDER BY ord, y0 DESC) AS n FROM b) WHERE n = 1")
def reading_order(spark, sf_dir):
    b = _boxes(spark, sf_dir).withColumn("line", F.dense_rank().over(Window.partitionBy("doc", "page").orderBy(F.desc("y0"))).cast("bigint"))
    return lookup.first_of(b, [F.col(c) for c in ("doc", "page", "word")], F.struct("ord", "line")).select("doc", "page", "ord", "line")


QUERIES, SQL = plan.queries, plan.sql
