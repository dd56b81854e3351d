"""Typed fields from page text: cascades of patterns with confidence, coverage and suspects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folhario.functions.values import fold, said

CASE_NUMBER = r"\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}"
ADMIN_NUMBER = r"\d{4}\.\d{2}\.\d{7}"
#: field -> stages in order: (pattern, group, method, confidence). The first stage that hits gives the value.
CASCADES: dict[str, list[tuple[str, int, str, float]]] = {
    "processo_judicial": [(rf"autos n[º°] ({CASE_NUMBER})", 1, "label", 0.85), (rf"({CASE_NUMBER})", 1, "pattern", 0.6)],
    "processo_administrativo": [(rf"Processo administrativo n[º°] ({ADMIN_NUMBER})", 1, "label", 0.9), (rf"processo ({ADMIN_NUMBER})", 1, "body", 0.7)],
    "valor_arbitrado": [(r"honorários[^.]{0,80}R\$ (\d{1,3}(?:\.\d{3})*,\d{2})", 1, "fee", 0.8), (r"R\$ (\d{1,3}(?:\.\d{3})*,\d{2})", 1, "money", 0.55)],
    "perito": [(r"perit[oa] ([^,]{5,60}), [^,]{4,40}, CPF", 1, "label", 0.75), (r"expert ([^,.]{5,60}) (?:disse|afirmou|respondeu)", 1, "answer", 0.6)],
    "cpf_perito": [(r"CPF (\d{3}\.\d{3}\.\d{3}-\d{2})", 1, "label", 0.75), (r"(\d{3}\.\d{3}\.\d{3}-\d{2})", 1, "pattern", 0.5)],
    "promovido": [(r"em face de ([^,]{4,80}),", 1, "label", 0.7)],
    "comarca": [(r"comarca de ([^,.;]{4,50})[,.;]", 1, "label", 0.7)],
}


def candidates(pages: DataFrame, text: str = "text") -> DataFrame:
    """(doc, page, field, stage, value, method, confidence): every stage's hit on every page, in one pass."""
    flat = F.regexp_replace(text, r"\s+", " ")
    entries = [
        F.struct(F.lit(f).alias("field"), F.lit(i).alias("stage"), F.regexp_extract(flat, p, g).alias("value"), F.lit(m).alias("method"), F.lit(c).alias("confidence"))
        for f, stages in CASCADES.items()
        for i, (p, g, m, c) in enumerate(stages)
    ]
    return pages.select("doc", "page", F.explode(F.filter(F.array(*entries), lambda e: e["value"] != "")).alias("e")).select("doc", "page", "e.*")


def fields(cands: DataFrame) -> DataFrame:
    """One row a document and field: the first stage that hit, on the earliest page. An aggregation, not a sort."""
    best = F.min(F.struct("stage", "page", "value", "method", "confidence")).alias("b")
    return cands.groupBy("doc", "field").agg(best).select("doc", "field", "b.value", "b.method", "b.confidence", "b.page")


def prefer(seed: DataFrame, fallback: DataFrame) -> DataFrame:
    """Of two tables of fields the seed's value where its confidence is at least the fallback's."""
    f = fallback.select("doc", "field", *[F.col(c).alias(f"_{c}") for c in ("value", "method", "confidence")])
    j = seed.join(f, ["doc", "field"], "full")
    mine = F.col("value").isNotNull() & (F.col("_value").isNull() | (F.col("confidence") >= F.col("_confidence")))
    return j.select("doc", "field", *[F.when(mine, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ("value", "method", "confidence")])


def long_form(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, value): a row for every field of every row, absent values as null."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), said(F.col(c).cast("string")).alias("value")) for c in columns])
    return df.select(key, F.explode(pairs).alias("p")).select(key, "p.field", "p.value")


def suspect(field: Column, value: Column) -> Column:
    """Whether a filled value can't well be what its field says."""
    digits = F.regexp_replace(value, r"\D", "")
    norm = fold(value)
    body = reduce(lambda a, b: a | b, [norm.contains(w) for w in ("juizo", "vara", "comarca", "tribunal", "diretoria", "poder judiciario", "secretaria", "cartorio")])
    return (
        F.when(field == "cpf_perito", (F.length(digits) != 11) | digits.rlike(r"^(?:0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$"))
        .when(field == "numero_autos", ~value.rlike(CASE_NUMBER))
        .when(field.startswith("valor_"), ~value.rlike(r"^\s*(?:R\$ ?)?\d{1,3}(?:\.?\d{3})*(?:[.,]\d{2})?\s*$"))
        .when(field.isin("autor", "parte_contraria", "perito_nome"), body | value.rlike(r"\d"))
        .when(field.isin("juizo", "comarca"), ~norm.contains("vara") & ~norm.contains("comarca") & (F.length(norm) < 6))
        .otherwise(F.lit(False))
    )


def coverage(long: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """A row a field: rows, filled, missing, suspect, and the first few suspect values in order."""
    flagged = long.withColumn("_s", F.coalesce(F.col("value").isNotNull() & suspect(F.col("field"), F.col("value")), F.lit(False)))
    counts = flagged.groupBy("field").agg(F.count("*").alias("n"), F.count("value").alias("filled"), F.count_if("_s").alias("suspect"))
    w = Window.partitionBy("field").orderBy(key)
    # the few examples of a field are ranked over its suspects only; the rank is pushed down as a limit a group
    few = flagged.where("_s").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= examples).groupBy("field").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "value"))), lambda x: x["value"]), " | ").alias("examples"))
    return counts.withColumn("missing", F.col("n") - F.col("filled")).join(few, "field", "left")


def weighted_score(indicators: list[tuple[Column, float]]) -> Column:
    """The weights of the indicators that hold, added up in order."""
    return reduce(lambda a, b: a + b, [F.when(c, F.lit(w)).otherwise(F.lit(0.0)) for c, w in indicators])


def evidence_box(words: DataFrame, value: str) -> DataFrame:
    """(doc, page, x0, y0, x1, y1): the box around the first run of words that spells a value, word by word."""
    wanted = [w for w in value.split(" ") if w]
    w = Window.partitionBy("doc", "page").orderBy("ord")
    ahead = [F.lead("word", i).over(w) for i in range(len(wanted))]
    hit = reduce(lambda a, b: a & b, [F.lower(c) == x.lower() for c, x in zip(ahead, wanted)])
    span = w.rowsBetween(0, len(wanted) - 1)
    boxes = words.select("doc", "page", "ord", hit.alias("_hit"), F.min("x0").over(span).alias("x0"), F.min("y0").over(span).alias("y0"), F.max("x1").over(span).alias("x1"), F.max("y1").over(span).alias("y1"))
    return boxes.where("_hit").groupBy("doc", "page").agg(F.min_by(F.struct("x0", "y0", "x1", "y1"), "ord").alias("b")).select("doc", "page", "b.*")
