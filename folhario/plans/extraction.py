"""Field extraction: strategies, preference, checks, kinds of order, templates and the report of what was found."""

from __future__ import annotations

from pyspark.sql import functions as F

from folhario.functions.values import fold
from folhario.operators import cascades as cs
from folhario.operators import extract
from folhario.plans.base import Plans
from folhario.plans.records import _fold
from folhario.runtime import table
from folhario.sources import corpus

plan = Plans()


def _steps(value: str, clean: str) -> str:
    for pattern, new in cs.CLEANERS[clean]:
        value = f"regexp_replace({value}, '{pattern.replace(chr(39), chr(39) * 2)}', '{new}', 'g')"
    return value


def _ok(v: str, check: str) -> str:
    if check == "cpf":
        return f"length(regexp_replace({v}, '\\D', '', 'g')) = 11 AND NOT regexp_full_match(regexp_replace({v}, '\\D', '', 'g'), '0+|1+|2+|3+|4+|5+|6+|7+|8+|9+')"
    if check in ("party", "person"):
        clean = " AND ".join(f"NOT contains({_fold(v)}, '{w}')" for w in ("juizo", "vara", "comarca", "tribunal", "diretoria", "poder judiciario", "secretaria", "cartorio"))
        return f"{clean} AND length({_fold(v)}) >= 5 AND NOT regexp_matches({v}, '\\d')" + (f" AND contains({_fold(v)}, ' ')" if check == "person" else "")
    return "true"


def found_sql(strategies) -> str:
    """`c`: what each strategy finds on each page, before empty and unfit values are dropped."""
    stage: dict[str, int] = {}
    parts = []
    for s in strategies:
        stage[s.field] = stage.get(s.field, -1) + 1
        where = "substr(t, CAST(floor(length(t) * 0.7) AS BIGINT) + 1)" if s.scope == "tail" else "t"
        raw = f"regexp_extract({where}, '(?i){s.pattern}', {s.group})"
        hint = f"WHERE contains(lower(t), '{s.hint}')" if s.hint else ""
        parts.append(f"SELECT doc, page, field, stage, value, method, confidence FROM (SELECT doc, page, '{s.field}' AS field, {stage[s.field]} AS stage, {_steps(raw, s.clean)} AS value, '{s.method}' AS method, {s.confidence}::DOUBLE AS confidence FROM x {hint}) WHERE value <> '' AND {_ok('value', s.check)}")
    return ", x AS (SELECT doc, page, regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g') AS t FROM p), c AS (" + " UNION ALL ".join(parts) + "), b AS (SELECT doc, field, value, method, confidence, page FROM (SELECT *, row_number() OVER (PARTITION BY doc, field ORDER BY stage, page) AS n FROM c) WHERE n = 1)"


FOUND = found_sql(cs.STRATEGIES)


def _found(spark, sf_dir):
    return extract.fields(cs.candidates(corpus.pages(spark, sf_dir)))


@plan(FOUND + " SELECT doc, field, value, method, confidence, page FROM b", pages=True)
def extract_twenty_fields(spark, sf_dir):
    return _found(spark, sf_dir)


NAMED = ", n AS (SELECT cache_id AS doc, 'processo_administrativo' AS field, regexp_extract(cache_name, '(\\d{6,})', 1) AS value, 'filename' AS method, 0.35::DOUBLE AS confidence FROM caches), m AS (SELECT doc, field, value, method, confidence, page FROM b UNION ALL SELECT n.doc, n.field, n.value, n.method, n.confidence, NULL FROM n WHERE n.value <> '' AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc = n.doc AND b.field = n.field))"


def _named(spark, sf_dir):
    named = cs.name_fallback(corpus.documents(spark, sf_dir), "processo_administrativo", "cache_name", r"(\d{6,})")
    return cs.merge_seed(_found(spark, sf_dir), named)


@plan(FOUND + NAMED + " SELECT * FROM m WHERE field = 'processo_administrativo'", pages=True)
def extract_name_fallback(spark, sf_dir):
    return _named(spark, sf_dir).where("field = 'processo_administrativo'")


@plan(FOUND + NAMED + ", g AS (SELECT field, method, count(*) AS n, sum(confidence) AS s, min(confidence) AS a, max(confidence) AS z, count(*) FILTER (confidence < 0.6) AS low FROM m GROUP BY ALL) SELECT field, CAST(sum(n) AS BIGINT) AS found, round(sum(s) / sum(n), 6) AS mean, min(a) AS least, max(z) AS greatest, CAST(sum(low) AS BIGINT) AS unsure, CAST(sum(CASE WHEN method = 'filename' THEN n ELSE 0 END) AS BIGINT) AS from_name, string_agg(method || '=' || n, ' ' ORDER BY method) AS methods, CAST((SELECT count(*) FROM caches) - sum(n) AS BIGINT) AS missing FROM g GROUP BY field", pages=True)
def field_confidence_report(spark, sf_dir):
    return cs.confidence_report(_named(spark, sf_dir), corpus.documents(spark, sf_dir))


#: The seed of the preference queries: the same fields as another reader would give them, parties and signers among them.
SEED = ", s AS (SELECT doc, field, CASE WHEN field = 'promovido' AND doc % 3 = 0 THEN 'Juízo da Comarca' ELSE upper(value) END AS value, 'seed' AS method, CASE WHEN doc % 2 = 0 THEN 0.95::DOUBLE ELSE 0.5::DOUBLE END AS confidence, page FROM b WHERE field IN ('promovido', 'perito', 'assinante', 'valor_jz', 'valor_tabelado'))"
PREFER = ", j AS (SELECT coalesce(s.doc, b.doc) AS doc, coalesce(s.field, b.field) AS field, s.value AS v, s.method AS m, s.confidence AS c, s.page AS p, b.value, b.method, b.confidence, b.page FROM s FULL JOIN b ON s.doc = b.doc AND s.field = b.field), k AS (SELECT *, coalesce(v IS NOT NULL AND field <> 'assinante' AND NOT (field IN ('promovente', 'promovido') AND (contains({n}, 'juizo') OR contains({n}, 'vara') OR contains({n}, 'comarca') OR contains({n}, 'tribunal') OR contains({n}, 'diretoria') OR contains({n}, 'poder judiciario') OR contains({n}, 'secretaria') OR contains({n}, 'cartorio'))) AND (value IS NULL OR c >= confidence) AND (field <> 'valor_jz' OR p = 1), false) AS mine FROM j)".replace("{n}", _fold("v"))


@plan(FOUND + SEED + PREFER + " SELECT doc, field, CASE WHEN mine THEN v ELSE value END AS value, CASE WHEN mine THEN m ELSE method END AS method, CASE WHEN mine THEN c ELSE confidence END AS confidence, CASE WHEN mine THEN p ELSE page END AS page FROM k WHERE CASE WHEN mine THEN v ELSE value END IS NOT NULL", pages=True)
def fields_preferred(spark, sf_dir):
    b = _found(spark, sf_dir)
    other = F.when((F.col("field") == "promovido") & (F.col("doc") % 3 == 0), "Juízo da Comarca").otherwise(F.upper("value"))
    seed = b.where(F.col("field").isin("promovido", "perito", "assinante", "valor_jz", "valor_tabelado")).select("doc", "field", other.alias("value"), F.lit("seed").alias("method"), F.when(F.col("doc") % 2 == 0, 0.95).otherwise(0.5).alias("confidence"), "page")
    return cs.prefer(seed, b, by_page={"valor_jz": 1})


DADOS_LONG = "WITH l AS (SELECT rec_id AS doc, unnest(['processo_judicial', 'cpf_perito', 'perito', 'promovido']) AS field, unnest([numero_autos, cpf_perito, perito_nome, parte_contraria]) AS value FROM dados_diretoria_especial_v5), f AS (SELECT * FROM l WHERE value IS NOT NULL)"


@plan(DADOS_LONG + f" SELECT doc, field, CASE WHEN CASE WHEN field = 'processo_judicial' THEN regexp_full_match(value, '\\d{{7}}-\\d{{2}}\\.\\d{{4}}\\.\\d\\.\\d{{2}}\\.\\d{{4}}') WHEN field = 'cpf_perito' THEN {_ok('value', 'cpf')} WHEN field = 'perito' THEN {_ok('value', 'person')} ELSE {_ok('value', 'party')} END THEN value END AS value FROM f")
def fields_validated(spark, sf_dir):
    d = table(spark, sf_dir, "dados_diretoria_especial_v5")
    names = {"processo_judicial": "numero_autos", "cpf_perito": "cpf_perito", "perito": "perito_nome", "promovido": "parte_contraria"}
    long = d.select(F.col("rec_id").alias("doc"), F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(v).alias("value")) for k, v in names.items()])).alias("e")).select("doc", "e.*")
    return cs.validated(long.where("value is not null"))


@plan(f"WITH f AS (SELECT d.rec_id AS doc, d.perito_nome AS value, CASE WHEN d.rec_id % 4 = 0 THEN 0.5 ELSE 0.8 END::DOUBLE AS confidence, r.perito AS known FROM dados_diretoria_especial_v5 d LEFT JOIN (SELECT regexp_replace(cpf, '\\D', '', 'g') AS k, min(perito) AS perito FROM peritos_ref WHERE length(regexp_replace(cpf, '\\D', '', 'g')) = 11 GROUP BY 1) r ON r.k = regexp_replace(d.cpf_perito, '\\D', '', 'g') WHERE d.perito_nome IS NOT NULL OR r.perito IS NOT NULL), w AS (SELECT *, known IS NOT NULL AND (value IS NULL OR confidence < 0.6 OR regexp_matches({_fold('value')}, '@|perito|engenheir|medic|grafo|psicol|assistente social') OR contains(value, '@')) AS take FROM f) SELECT doc, 'perito' AS field, CASE WHEN take THEN known ELSE value END AS value, CASE WHEN take THEN 'catalogue' ELSE 'found' END AS method, CASE WHEN take THEN 0.9::DOUBLE ELSE confidence END AS confidence FROM w")
def fields_enriched(spark, sf_dir):
    d = table(spark, sf_dir, "dados_diretoria_especial_v5")
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    ref = table(spark, sf_dir, "peritos_ref").where(F.length(digits("cpf")) == 11).groupBy(digits("cpf").alias("k")).agg(F.min("perito").alias("value"))
    known = d.select(F.col("rec_id").alias("doc"), digits("cpf_perito").alias("k")).join(ref, "k").select("doc", "value")
    found = d.where("perito_nome is not null").select(F.col("rec_id").alias("doc"), F.lit("perito").alias("field"), F.col("perito_nome").alias("value"), F.lit("found").alias("method"), F.when(F.col("rec_id") % 4 == 0, 0.5).otherwise(0.8).alias("confidence"))
    return cs.enriched(found, "perito", known)


_TAIL = _fold("substr(text, CAST(floor(length(text) * 0.7) AS BIGINT) + 1)")


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


@plan(f"WITH d AS (SELECT doc_id, coalesce(doc_type, '') AS doc_type, {_TAIL} AS t FROM (SELECT doc_id, doc_type, coalesce(text, '') AS text FROM documents)) SELECT doc_id, CASE WHEN contains(lower(doc_type), 'certid') THEN 'certidao_cm' WHEN {_any(['autorizado', 'autoriza', 'autorizacao', 'encaminhem se os presentes autos', 'encaminhe se', 'encaminhem os presentes autos', 'encaminhem se os autos', 'gerencia de programacao orcamentaria', 'georc'])} THEN 'autorizacao' WHEN contains(t, 'conselho da magistratura') AND {_any(['encaminh', 'submet', 'remet', 'remessa'])} THEN 'encaminhamento_cm' ELSE 'indefinido' END AS kind FROM d")
def order_kinds(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", cs.order_kind(F.coalesce("text", F.lit("")), F.lower(F.coalesce("doc_type", F.lit(""))).contains("certid")).alias("kind"))


#: A page's own data: for each field the patterns in order (Java and RE2 alike).
PAGE_DATA = {
    "signed_by": [(r"assinado eletronicamente por ([^,\n]{5,60})", 1), (r"(?:subscrito|firmado) por ([^,.\n]{5,60}?) em ", 1)], "signed_at": [(r"em (\d{1,2}/\d{1,2}/\d{4}) às", 1), (r"em (\d{1,2} de [a-zç]+ de \d{4}) às", 1)],
    "page_mark": [(r"Pág\. (\d+) de \d+", 1), (r"fl\. (\d+) ", 1)], "amount": [(r"R\$ ?(\d{1,3}(?:\.\d{3})*,\d{2})", 1)], "case_number": [(r"(\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4})", 1), (r"(\d{4}\.\d{2}\.\d{7})", 1)],
    "tax_number": [(r"CPF (?:n[º°] )?(\d{3}\.\d{3}\.\d{3}-\d{2})", 1)], "unit": [(r"(\d{1,2}ª (?:Vara|Secretaria|Câmara)[^,;.(|\n]{0,60})", 1)], "phone": [(r"Fone:? ?([\d() +.-]{8,20}\d)", 1)], "resolution": [(r"Resolução n[º°] (\d+/\d{4})", 1)], "protocol": [(r"protocolo (\d{9,11}(?:-\d)?)", 1)],
}


@plan(" SELECT doc, page, " + ", ".join("coalesce(" + ", ".join(f"nullif(trim(regexp_extract(text, '(?i){p}', {g})), '')" for p, g in ps) + f") AS {name}" for name, ps in PAGE_DATA.items()) + " FROM p", pages=True)
def page_data(spark, sf_dir):
    return corpus.pages(spark, sf_dir).select("doc", "page", *[cs.first_match(F.col("text"), ps).alias(name) for name, ps in PAGE_DATA.items()])


_L = r"assinado\s*eletronicamente\s*por\s*(.{1,80}?)\s*,\s*em\s*(.{1,80}?)\s*às"


@plan(r", x AS (SELECT doc, page, regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g') AS t FROM p) SELECT doc, page, trim(regexp_extract(t, '" + _L + r"', 1)) AS signer, trim(regexp_extract(t, '" + _L + r"', 2)) AS day FROM x WHERE regexp_matches(t, '" + _L + "')", pages=True)
def template_fields(spark, sf_dir):
    return cs.from_template(corpus.pages(spark, sf_dir), "assinado eletronicamente por {{signer}}, em {{day}} às")


_WAYS = cs.template_strategies("autos nº {{autos}}, movidos", "autos")


@plan(found_sql(_WAYS) + " SELECT method, count(*) AS pages, count(DISTINCT value) AS different FROM c GROUP BY method", pages=True)
def template_strategy_hits(spark, sf_dir):
    return cs.candidates(corpus.pages(spark, sf_dir), _WAYS).groupBy("method").agg(F.count("*").alias("pages"), F.count_distinct("value").alias("different"))


_LEARNT = cs.learned([("contendo protocolo 12345678901, firmado", "12345678901"), ("com protocolo 99887766554, subscrito", "99887766554"), ("de protocolo 10203040506, assinado", "10203040506")], "protocolo")


@plan(found_sql(_LEARNT) + " SELECT doc, page, method, value FROM c", pages=True)
def learned_patterns(spark, sf_dir):
    return cs.candidates(corpus.pages(spark, sf_dir), _LEARNT).select("doc", "page", "method", "value")


_CUES = (("contains(lower(text), 'empenho')", 0.25), ("regexp_matches(text, '\\d{4}NE\\d{4}')", 0.2), ("contains(lower(text), 'dotação')", 0.15), ("regexp_matches(text, 'R\\$ ?\\d')", 0.15), ("contains(lower(text), 'favorecido')", 0.1), ("regexp_matches(text, 'CNPJ|CPF')", 0.1), ("words BETWEEN 30 AND 400", 0.05))


@plan(" SELECT doc, page, round(" + " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w in _CUES) + ", 4)::DOUBLE AS score FROM p", pages=True)
def commitment_score(spark, sf_dir):
    t, low = F.col("text"), F.lower("text")
    cues = [(low.contains("empenho"), 0.25), (t.rlike(r"\d{4}NE\d{4}"), 0.2), (low.contains("dotação"), 0.15), (t.rlike(r"R\$ ?\d"), 0.15), (low.contains("favorecido"), 0.1), (t.rlike("CNPJ|CPF"), 0.1), (F.col("words").between(30, 400), 0.05)]
    return corpus.pages(spark, sf_dir).select("doc", "page", F.round(extract.weighted_score(cues), 4).alias("score"))


@plan(f"SELECT rec_id, {_steps('coalesce(autor, ' + chr(39) * 2 + ')', 'party')} AS party, {_steps('coalesce(perito_nome, ' + chr(39) * 2 + ')', 'person')} AS person FROM dados_diretoria_especial_v5")
def names_cleaned(spark, sf_dir):
    d = table(spark, sf_dir, "dados_diretoria_especial_v5")
    return d.select("rec_id", cs.cleaned(F.coalesce("autor", F.lit("")), "party").alias("party"), cs.cleaned(F.coalesce("perito_nome", F.lit("")), "person").alias("person"))


QUERIES, SQL = plan.queries, plan.sql
