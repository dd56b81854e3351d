"""Whether a value says anything, and text folded for comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stand-ins that only say a value is absent or unknown, folded as `fold` does (fixed values).
STAND_INS = (
    "s i", "n a", "n d", "n i", "na", "nd", "null", "none", "nan", "nil", "nao consta", "nao informado", "nao informada",
    "nao identificado", "nao identificada", "nao localizado", "nao localizada", "nao encontrado", "nao disponivel", "nao ha",
    "sem informacao", "sem dados", "sem identificacao", "indisponivel", "ignorado", "desconhecido", "desconhecida", "ilegivel",
    "vazio", "em branco", "a definir", "a apurar", "prejudicado",
)
_WITH = "áàâãäåéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
_LESS = "aaaaaaeeeeiiiiooooouuuucnyAAAAAAEEEEIIIIOOOOOUUUUCNY"


def unaccent(c: Column) -> Column:
    """Composed and decomposed accents of Latin letters dropped."""
    return F.regexp_replace(F.translate(c, _WITH, _LESS), r"\p{Mn}+", "")


def fold(c: Column) -> Column:
    """Lower case, no accents, everything but letters and digits one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(unaccent(c)), r"[^\p{L}\p{N}]+", " "))


def filled(c: Column) -> Column:
    """True where a value is neither null nor blank nor a stand-in for an absent one."""
    f = fold(c)
    return F.coalesce((f != "") & ~f.isin(*STAND_INS), F.lit(False))


def said(c: Column) -> Column:
    """The value, or null where it says nothing."""
    return F.when(filled(c), c)
