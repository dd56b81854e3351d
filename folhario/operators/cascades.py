"""Field extraction by strategies: rows of a table, compiled to column expressions; merging, preference and checks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folhario.functions.values import fold

CASE = r"\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}"
ADMIN = r"\d{4}\.\d{2}\.\d{7}"
MONEY = r"\d{1,3}(?:\.\d{3})*,\d{2}"
DATE = r"\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{2,4}|\d{1,2} de [a-zç]+ de \d{4}"


class Strategy(NamedTuple):
    """One way to a field. `hint`: small letters that must be on the page; `scope`: all or tail; `clean`, `check`: by name."""

    field: str
    pattern: str
    method: str
    confidence: float
    hint: str = ""
    scope: str = "all"
    clean: str = ""
    check: str = ""
    group: int = 1


#: The fields of a fee order, stage by stage (patterns in a form that Java and RE2 read alike).
STRATEGIES = (
    Strategy("processo_administrativo", rf"processo administrativo n[º°] ({ADMIN})", "label", 0.9, "processo"), Strategy("processo_administrativo", rf"processo ({ADMIN})", "body", 0.7, "processo"),
    Strategy("processo_judicial", rf"autos n[º°] ({CASE})", "label", 0.85, "autos"), Strategy("processo_judicial", rf"({CASE})", "pattern", 0.6),
    Strategy("vara", r"(\d{1,2}ª (?:vara|secretaria|câmara)[^,;.(|]{0,60})", "label", 0.7, "ª ", clean="edge"),
    Strategy("comarca", r"comarca de ([^,.;]{4,50})[,.;]", "label", 0.7, "comarca", clean="edge"),
    Strategy("promovente", r"(?:movidos|propostos|ajuizados) por ([^,;]{5,60}?) em face de", "context", 0.7, " por ", clean="party", check="party"), Strategy("promovente", r"(?:requerente|autor|promovente): ([^.;,]{5,60})", "label", 0.65, ": ", clean="party", check="party"),
    Strategy("promovido", r"em face de ([^,]{4,80}),", "context", 0.7, "em face de", clean="party", check="party"), Strategy("promovido", r"(?:requerido|réu|promovido): ([^.;,]{5,60})", "label", 0.65, ": ", clean="party", check="party"),
    Strategy("perito", r"perit[oa] ([^,]{5,60}), [^,]{4,40}, cpf", "label", 0.75, "perit", clean="person", check="person"), Strategy("perito", r"expert ([^,.]{5,60}?) (?:disse|afirmou|respondeu|declarou)", "answer", 0.6, "expert", clean="person", check="person"),
    Strategy("cpf_perito", r"cpf (\d{3}\.\d{3}\.\d{3}-\d{2})", "label", 0.75, "cpf", check="cpf"), Strategy("cpf_perito", r"(\d{3}\.\d{3}\.\d{3}-\d{2})", "pattern", 0.5, check="cpf"),
    Strategy("especialidade", r"perit[oa] [^,]{5,60}, ([^,]{4,40}), cpf", "label", 0.75, "perit", clean="edge"), Strategy("especialidade", r"perícia de ([^,.]{4,40}?) (?:feita|realizada|concluída|designada|marcada|prevista)", "context", 0.6, "perícia", clean="edge"),
    Strategy("especie", r"laudo de ([^,.]{4,40}?) com \d", "context", 0.5, "laudo", clean="edge"),
    Strategy("valor_jz", rf"(?:arbitro|fixo|mantenho|estimo) os honorários[^.]{{0,80}}r\$ ({MONEY})", "decision", 0.85, "honorários"), Strategy("valor_jz", rf"honorários[^.]{{0,80}}r\$ ({MONEY})", "fee", 0.65, "honorários"),
    Strategy("valor_de", rf"valor de r\$ ({MONEY})[^.]{{0,90}}(?:empenhado|reservado|lançado)", "commitment", 0.65, "valor de"), Strategy("valor_cm", rf"conselho[^.]{{0,90}}r\$ ({MONEY})", "council", 0.6, "conselho"),
    Strategy("valor_tabelado", rf"r\$ ({MONEY}),[^.]{{0,60}}tabela", "table", 0.55, "tabela"),
    Strategy("adiantamento", rf"adiantamento[^.]{{0,60}}r\$ ({MONEY})", "regex", 0.65, "adiantamento"), Strategy("percentual", r"(?:^|[^\d,])(\d{1,2}%)", "regex", 0.6, "%"), Strategy("parcela", r"(\d+ª parcela|primeira parcela|segunda parcela|terceira parcela)", "regex", 0.6, "parcela"),
    Strategy("data", rf"assinado eletronicamente por [^,]{{3,60}}, em ({DATE})", "signature", 0.75, "assinado"), Strategy("data", rf"em ({DATE})", "tail", 0.6, " em ", scope="tail"),
    Strategy("assinante", r"assinado eletronicamente por ([^,]{5,60}), em", "footer", 0.9, "assinado", clean="person", check="person"), Strategy("assinante", r"(?:subscrito|assinado|firmado) por ([^,.]{5,60}?) em ", "body", 0.6, " por ", clean="person", check="person"),
    *(Strategy("num_perito", rf"{w}[ :-]*(\d{{3,}})", "regex", 0.55, w) for w in ("matrícula", "cadastro", "número do perito")), Strategy("num_perito", r"pis[^\d.]{0,12}(\d{3}\.?\d{5}\.?\d{2}-?\d)", "regex", 0.5, "pis"),
)
#: Words by which an institution gives itself away where a party's name is expected (fixed values).
INSTITUTIONS = ("juizo", "vara", "comarca", "tribunal", "diretoria", "poder judiciario", "secretaria", "cartorio")
#: Steps of cleaning by name: (pattern, replacement), in order; both sides of the SQL check read the same patterns.
CLEANERS = {
    "": (),
    "edge": ((r"[ ,;.–-]+$", ""),),
    "party": ((r"(?i)(?:^|[^\p{L}])(?:cpf|cnpj)(?:[^\p{L}].*)?$", ""), (r"(?i) perante .*$", ""), (r"(?i) ju[ií]zo .*$", ""), (r"\d+", ""), (r"[^\p{L} '-]+", " "), (r" +", " "), (r"^[ ,;–-]+|[ ,;–-]+$", "")),
    "person": ((r"(?i)^(?:[oa] )?(?:sr|sra|dr|dra|prof|profa)\.? ", ""), (r"(?i) (?:cpf|rg|oab) .*$", ""), (r"[^\p{L} .'-]+", " "), (r" +", " "), (r"^[ ,;–-]+|[ ,;.–-]+$", "")),
}


def cleaned(c: Column, name: str) -> Column:
    return reduce(lambda x, step: F.regexp_replace(x, step[0].replace("(?i)", "(?iu)"), step[1]), CLEANERS[name], c)


def passes(c: Column, name: str) -> Column:
    """Whether a value can be what its field says."""
    if name == "cpf":
        digits = F.regexp_replace(c, r"\D", "")
        return (F.length(digits) == 11) & ~digits.rlike(r"^(?:0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$")
    if name in ("party", "person"):
        norm = fold(c)
        clean = reduce(lambda a, b: a & b, [~norm.contains(w) for w in INSTITUTIONS])
        return clean & (F.length(norm) >= 5) & ~c.rlike(r"\d") & (norm.contains(" ") if name == "person" else F.lit(True))
    return F.lit(True)


def tail(c: Column, share: float = 0.7) -> Column:
    return F.substring(c, F.floor(F.length(c) * share).cast("int") + 1, F.length(c))


def _flagged(pattern: str) -> str:
    """A pattern without regard to case, where it has letters at all: without the flag the search is much faster."""
    return f"(?iu){pattern}" if re.search(r"[^\W\d_]", re.sub(r"\\[a-zA-Z]", "", pattern)) else pattern


def candidates(pages: DataFrame, strategies: Iterable[Strategy] = STRATEGIES, text: str = "text") -> DataFrame:
    """(doc, page, field, stage, value, method, confidence): what each strategy finds on each page, in one pass.

    A strategy's pattern is tried only where its hint stands; empty finds are dropped in
    the row, before anything is exploded; only what was found is cleaned and checked.
    """
    strategies = list(strategies)
    stage: dict[str, int] = {}
    entries = []
    for s in strategies:
        stage[s.field] = stage.get(s.field, -1) + 1
        raw = F.regexp_extract(F.col("_end") if s.scope == "tail" else F.col("_t"), _flagged(s.pattern), s.group)
        raw = F.when(F.contains("_low", F.lit(s.hint)), raw).otherwise("") if s.hint else raw
        entries.append(F.struct(*[F.lit(v).alias(k) for k, v in (("field", s.field), ("stage", stage[s.field]), ("method", s.method), ("confidence", s.confidence), ("clean", s.clean), ("check", s.check))], raw.alias("raw")))
    flat = pages.select("doc", "page", F.regexp_replace(text, r"[ \t\n\r\f]+", " ").alias("_t")).select("*", F.lower("_t").alias("_low"), tail(F.col("_t")).alias("_end"))
    hits = flat.select("doc", "page", F.explode(F.filter(F.array(*entries), lambda e: e["raw"] != "")).alias("e")).select("doc", "page", "e.*")
    value, good = F.col("raw"), F.lit(True)
    for name in sorted({s.clean for s in strategies} - {""}):
        value = F.when(F.col("clean") == name, cleaned(F.col("raw"), name)).otherwise(value)
    for name in sorted({s.check for s in strategies} - {""}):
        good = F.when(F.col("check") == name, passes(F.col("value"), name)).otherwise(good)
    kept = hits.withColumn("value", value).where(F.col("value") != "").where(good)
    return kept.select("doc", "page", "field", "stage", "value", "method", "confidence")


def name_fallback(docs: DataFrame, field: str, column: str, pattern: str, confidence: float = 0.35) -> DataFrame:
    """A field from a document's name, for where its pages have none."""
    found = docs.select("doc", F.regexp_extract(column, pattern, 1).alias("value")).where("value <> ''")
    return found.select("doc", F.lit(field).alias("field"), "value", F.lit("filename").alias("method"), F.lit(confidence).alias("confidence"), F.lit(None).cast("int").alias("page"))


def merge_seed(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Two tables of fields as one: the higher confidence wins, the base on a tie."""
    both = base.withColumn("_o", F.lit(1)).unionByName(extra.withColumn("_o", F.lit(0)), allowMissingColumns=True)
    return both.groupBy("doc", "field").agg(F.max(F.struct("confidence", "_o", "value", "method", "page")).alias("b")).select("doc", "field", "b.value", "b.method", "b.confidence", "b.page")


def prefer(seed: DataFrame, fallback: DataFrame, always: Sequence[str] = ("assinante",), parties: Sequence[str] = ("promovente", "promovido"), by_page: dict[str, int] | None = None) -> DataFrame:
    """The seed's value where it is at least as sure as the fallback's.

    Never for the fields in `always`, nor for a party that is an institution, nor for a
    field in `by_page` that wasn't found on the page it must stand on.
    """
    f = fallback.select("doc", "field", *[F.col(c).alias(f"_{c}") for c in ("value", "method", "confidence", "page")])
    j = seed.join(f, ["doc", "field"], "full")
    norm = fold(F.col("value"))
    institution = F.col("field").isin(list(parties)) & reduce(lambda a, b: a | b, [norm.contains(w) for w in INSTITUTIONS])
    mine = F.col("value").isNotNull() & ~F.col("field").isin(list(always)) & ~institution & (F.col("_value").isNull() | (F.col("confidence") >= F.col("_confidence")))
    for field, page in (by_page or {}).items():
        mine = mine & ((F.col("field") != field) | (F.col("page") == page))
    kept = j.select("doc", "field", *[F.when(mine, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ("value", "method", "confidence", "page")])
    return kept.where("value is not null")


def validated(fields: DataFrame) -> DataFrame:
    """Values that can't be right as nulls: case numbers by their shape, tax numbers by their digits, names by their letters."""
    f, v = F.col("field"), F.col("value")
    good = (
        F.when(f == "processo_judicial", v.rlike(f"^{CASE}$")).when(f == "cpf_perito", passes(v, "cpf"))
        .when(f.isin("perito", "assinante"), passes(v, "person")).when(f.isin("promovente", "promovido"), passes(v, "party")).otherwise(F.lit(True))
    )
    return fields.withColumn("value", F.when(good, v))


def enriched(fields: DataFrame, field: str, known: DataFrame, least: float = 0.6, noise: str = "@|perito|engenheir|medic|grafo|psicol|assistente social", confidence: float = 0.9) -> DataFrame:
    """A field's value from a catalogue (doc, value) where the one found is missing, unsure or noise."""
    k = known.select("doc", F.col("value").alias("_known"))
    own = fields.where(F.col("field") == field).join(k, "doc", "full")
    weak = F.col("value").isNull() | (F.col("confidence") < least) | fold(F.col("value")).rlike(noise) | F.col("value").contains("@")
    take = F.col("_known").isNotNull() & weak
    return own.select("doc", F.lit(field).alias("field"), F.when(take, F.col("_known")).otherwise(F.col("value")).alias("value"), F.when(take, F.lit("catalogue")).otherwise(F.col("method")).alias("method"), F.when(take, F.lit(confidence)).otherwise(F.col("confidence")).alias("confidence"))


#: Phrases that tell what an order does (fixed values), folded.
AUTHORISES = ("autorizado", "autoriza", "autorizacao", "encaminhem se os presentes autos", "encaminhe se", "encaminhem os presentes autos", "encaminhem se os autos", "gerencia de programacao orcamentaria", "georc")
COUNCIL, SENDS = ("conselho da magistratura",), ("encaminh", "submet", "remet", "remessa")


def order_kind(text: Column, certificate: Column) -> Column:
    """certidao_cm, autorizacao, encaminhamento_cm or indefinido, by the end of a paper."""
    norm = fold(tail(text))
    has = lambda words: reduce(lambda a, b: a | b, [norm.contains(w) for w in words])
    return F.when(certificate, "certidao_cm").when(has(AUTHORISES), "autorizacao").when(has(COUNCIL) & has(SENDS), "encaminhamento_cm").otherwise("indefinido")


def first_match(text: Column, patterns: Sequence[tuple[str, int]]) -> Column:
    """The first pattern's group that isn't empty."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, f"(?iu){p}", g)), F.lit("")) for p, g in patterns])


def loose(literal: str) -> str:
    """A pattern for a literal with any blanks, or none, between its characters."""
    return r"\s*".join(re.escape(c) for c in literal if not c.isspace())


def template_pattern(template: str, value: str = "(.{1,80}?)") -> tuple[str, list[str]]:
    """A template with {{FIELD}} places as a pattern of loose literals, and the fields in order of their groups."""
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    names = parts[1::2]
    out = "".join(loose(p) if i % 2 == 0 else rf"\s*{value}\s*" for i, p in enumerate(parts))
    return out, names


def from_template(pages: DataFrame, template: str, text: str = "text") -> DataFrame:
    """(doc, page, and a column a field): what stands in a template's places, where all of it is met."""
    pattern, names = template_pattern(template)
    flat = F.regexp_replace(text, r"[ \t\n\r\f]+", " ")
    return pages.where(flat.rlike(pattern)).select("doc", "page", *[F.trim(F.regexp_extract(flat, pattern, i)).alias(n) for i, n in enumerate(names, 1)])


def template_strategies(template: str, field: str) -> list[Strategy]:
    """Strategies from one template with a place: all of it, its start, its end, and the least around the place."""
    before, after = template.split("{{" + field + "}}")
    b, a = before.split(), after.split()
    some = r"([^,;]{2,80}?)"
    return [
        Strategy(field, loose(before) + r"\s*" + some + r"\s*" + loose(after), "full", 0.9), Strategy(field, loose(before) + r"\s*([^,;.]{2,80})", "start", 0.7),
        Strategy(field, r"([^,;.]{2,80}?)\s*" + loose(after), "end", 0.6), Strategy(field, loose(" ".join(b[-1:])) + r"\s*" + some + r"\s*" + loose(" ".join(a[:1])), "minimal", 0.5),
    ]


def learned(examples: Sequence[tuple[str, str]], field: str, most: int = 30) -> list[Strategy]:
    """Strategies from (text, value) examples: what stands before and after the values in all of them, and their shape."""
    before, after = [], []
    for text, value in examples:
        i = text.find(value)
        if value and i >= 0:
            before.append(text[max(0, i - most) : i])
            after.append(text[i + len(value) : i + len(value) + most])
    if not before:
        return []

    def common(xs: Sequence[str]) -> str:
        return "".join(c[0] for c in next(([z for z in zip(*xs)][:n] for n in range(min(map(len, xs)), -1, -1) if len({x[:n] for x in xs}) == 1), []))

    lead, trail = common([x[::-1] for x in before])[::-1], common(after)
    values = [v for _, v in examples if v]
    shape = {re.sub(r"\d+", r"\\d+", re.escape(v)) for v in values}
    body = shape.pop() if len(shape) == 1 else rf".{{{min(map(len, values))},{max(map(len, values))}}}?"
    out = [Strategy(field, f"{re.escape(lead)}({body}){re.escape(trail)}", "around", 0.8)] if lead or trail else []
    return out + ([Strategy(field, f"{re.escape(lead)}({body})", "before", 0.6)] if lead else [])


def confidence_report(fields: DataFrame, total: DataFrame) -> DataFrame:
    """By field: found, missing, mean, least and greatest confidence, how many are unsure, from a name, and by which methods."""
    per = fields.groupBy("field", "method").agg(F.count("*").alias("n"), F.sum("confidence").alias("s"), F.min("confidence").alias("a"), F.max("confidence").alias("b"), F.count_if(F.col("confidence") < 0.6).alias("low"))
    methods = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("method", "n"))), lambda x: F.concat(x["method"], F.lit("="), x["n"].cast("string"))), " ")
    out = per.groupBy("field").agg(F.sum("n").alias("found"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean"), F.min("a").alias("least"), F.max("b").alias("greatest"), F.sum("low").alias("unsure"), F.sum(F.when(F.col("method") == "filename", F.col("n")).otherwise(0)).alias("from_name"), methods.alias("methods"))
    return out.crossJoin(F.broadcast(total.agg(F.count("*").alias("_all")))).withColumn("missing", F.col("_all") - F.col("found")).drop("_all")
