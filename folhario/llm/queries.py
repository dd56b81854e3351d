"""The pN_ queries of this package."""

from __future__ import annotations

from folhario.llm import boilerplate, canonical, leaks, mojibake, pii, survivor, tokens, variants
from folhario.plans.records import _filled, _fold
from folhario.runtime import spread, table


def p1_found(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "text"))
    fields = spread(table(spark, sf_dir, "dados_diretoria_especial_v5").select("rec_id", "cpf_perito"))
    return pii.find_items(pages, "page_id", "text", "pages").unionByName(pii.find_items(fields, "rec_id", "cpf_perito", "dados_diretoria_especial_v5"))


def p1_redacted(spark, sf_dir):
    return pii.redact(spread(table(spark, sf_dir, "pages").select("page_id", "text"))).select("page_id", "redacted")


def p2_found(spark, sf_dir):
    return survivor.survivors(table(spark, sf_dir, "dados_diretoria_especial_v5"), table(spark, sf_dir, "extraction_methods"))


def p2_golden(spark, sf_dir):
    return survivor.golden(table(spark, sf_dir, "dados_diretoria_especial_v5"), table(spark, sf_dir, "extraction_methods"))


def p4_found(spark, sf_dir):
    fields = {
        "especialidade": ("trade", table(spark, sf_dir, "especialidades_ref"), "especialidade_id", "especialidade"),
        "comarca": ("place", table(spark, sf_dir, "comarcas_ref"), "comarca_id", "comarca"),
        "perito_nome": ("person", table(spark, sf_dir, "peritos_ref"), "perito_id", "perito"),
    }
    return canonical.canonical(table(spark, sf_dir, "dados_diretoria_especial_v5"), fields)


def p5_found(spark, sf_dir):
    return boilerplate.repeated_lines(table(spark, sf_dir, "pages"), table(spark, sf_dir, "caches"))


def p5_cleaned(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    removed = boilerplate.repeated_lines(pages, table(spark, sf_dir, "caches"))
    return boilerplate.strip_lines(pages, removed).select("page_id", "header", "footer", "text")


NAME_COLUMNS = ("perito_nome", "autor", "parte_contraria")


def p6_found(spark, sf_dir):
    return variants.pairs(variants.entities(table(spark, sf_dir, "dados_diretoria_especial_v5"), NAME_COLUMNS))


def p6_entities(spark, sf_dir):
    return variants.entities(table(spark, sf_dir, "dados_diretoria_especial_v5"), NAME_COLUMNS)


def p7_ids(spark, sf_dir):
    return tokens.encode_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p8_found(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return leaks.leaks(docs, table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_found(spark, sf_dir):
    return mojibake.garbled_rows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p9_repaired(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return mojibake.repair_corpus(docs).where("garbled").select("doc_id", "repaired")


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p4_found": p4_found, "p6_found": p6_found, "p6_entities": p6_entities, "p2_found": p2_found, "p2_golden": p2_golden, "p5_found": p5_found, "p5_cleaned": p5_cleaned, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found, "p9_repaired": p9_repaired}
_FULL = " + ".join(f"CAST({_filled(c)} AS INT)" for c in survivor.FIELDS)
SQL: dict[str, str] = {
    "p2_found": f"""WITH a AS (SELECT *, regexp_replace(lower(processo), '^\\s*(processo|process|proc|adme)\\b\\W*(n\\s*[ºo°.]+)?', '') AS bare, regexp_extract(source_file, '([^/\\\\]*)$', 1) AS name FROM dados_diretoria_especial_v5),
b AS (SELECT *, regexp_replace(translate(bare, 'oli|', '0111'), '\\D', '', 'g') AS digits, nullif(ltrim(regexp_extract(name, '(\\d{{6,}})', 1), '0'), '') AS f FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(bare, '\\d') AND length(digits) >= 5 THEN digits END AS p FROM b),
k AS (SELECT f, max_by(p, n * 100000000000000 + TRY_CAST(p AS BIGINT)) AS known FROM (SELECT f, p, count(*) AS n FROM c WHERE f IS NOT NULL AND p IS NOT NULL GROUP BY f, p) GROUP BY f),
g AS (SELECT c.rec_id, coalesce(c.p, k.known, 'file ' || c.f) AS g, c.start_page, {_FULL} AS filled, coalesce(m.trust_rank, 1000000) AS rank, c.extraction_date FROM c LEFT JOIN k ON k.f = c.f AND c.p IS NULL
  LEFT JOIN extraction_methods m ON replace({_fold('m.extraction_method')}, ' ', '') = replace({_fold('c.extraction_method')}, ' ', '') WHERE c.start_page IS NOT NULL AND (c.p IS NOT NULL OR c.f IS NOT NULL))
SELECT rec_id, first_value(rec_id) OVER (PARTITION BY g, start_page ORDER BY filled DESC, rank, extraction_date DESC NULLS LAST, rec_id) AS survivor_id FROM g QUALIFY count(*) OVER (PARTITION BY g, start_page) > 1""",
}
