"""Labels of bookmarks: a dictionary of known titles first, ordered rules otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folhario.functions.values import fold
from folhario.runtime import broadcast_if_small

#: words any of which a folded title has -> label, macro class, subclass; the first that fits counts (fixed values).
RULES = (
    (("laudo", "pericia"), "Laudo", "anexo", "laudo"),
    (("senten",), "Sentenca", "anexo", "sentenca"),
    (("capa",), "Capa", "anexo", "capa"),
    (("sighope", "perito"), "SIGHOPE", "anexo", "sighope"),
    (("requer", "pedido"), "Requerimento", "requerimento", "outros"),
    (("oficio",), "Oficio", "oficio", "outros"),
    (("certidao",), "Certidao", "certidao", "outros"),
    (("despach",), "Despacho", "despacho", "outros"),
    (("pagamento", "honor", "reserva", "rpv"), "Pagamento/Honorarios", "anexo", "pagamento"),
)


def by_rules(title: Column) -> Column:
    """(label, macro, sub) of a title; one that no rule fits is its own label."""
    norm = fold(title)
    out = None
    for words, *names in RULES:
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(norm, w))
        value = F.struct(*[F.lit(v).alias(k) for k, v in zip(("label", "macro", "sub"), names)])
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(F.initcap(norm).alias("label"), F.lit("outros").alias("macro"), F.lit("outros").alias("sub")))


def labelled(marks: DataFrame, known: DataFrame | None = None, title: str = "title", small: int = 100_000) -> DataFrame:
    """`marks` with label, macro and sub, and whether a dictionary (original, canonical, macro, sub) gave them.

    The first entry of a title counts; what an entry leaves blank is its own title, or `outros`.
    """
    judged = marks.withColumn("_r", by_rules(F.col(title)))
    if known is None:
        return judged.select(*marks.columns, "_r.*", F.lit(False).alias("known"))
    blank = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), other)
    entries = known.where("trim(original) <> ''").select(fold(F.col("original")).alias("_t"), blank("canonical", F.trim("original")).alias("a"), blank("macro", F.lit("outros")).alias("b"), blank("sub", F.lit("outros")).alias("c"))
    one = entries.groupBy("_t").agg(F.min(F.struct("a", "b", "c")).alias("_k"))
    met = judged.withColumn("_t", fold(F.col(title))).join(broadcast_if_small(one, small), "_t", "left")
    pick = lambda k, r: F.when(F.col("_k").isNotNull(), F.col(f"_k.{k}")).otherwise(F.col(f"_r.{r}")).alias(r)
    return met.select(*marks.columns, pick("a", "label"), pick("b", "macro"), pick("c", "sub"), F.col("_k").isNotNull().alias("known"))
