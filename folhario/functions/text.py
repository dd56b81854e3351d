"""Columns derived from text: counts, slices, flags, cleaning, hashes, dates and money."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folhario.functions.values import unaccent

#: A place where a word may begin or end, letters of any language counted (for Java and RE2 alike).
EDGE = r"(?:^|$|[^\p{L}\p{N}_])"
#: Words that give a language away (fixed values).
LANGUAGE_WORDS = {"English": "the|and|of|to|in|is|are", "Português": "de|da|do|que|para|com|em|por", "Español": "el|la|de|que|en|es|un|una"}
#: References to other papers (fixed patterns).
REFERENCES = (r"SEI\s+\d{6}-\d{2}\.\d{4}\.\d\.\d{2}(?:\s*/\s*pg\.\s*\d+)?", r"Processo\s+n[º°]\s*[\d.-]+", r"Ofício\s+\d+\s+(?:\(\d+\))?", r"Anexo\s+\(\d+\)")
MONTHS = "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split()
#: Content detectors of a page (patterns in a form that Java and RE2 read alike).
DETECTORS = {
    "cpf": r"\d{3}\.\d{3}\.\d{3}-\d{2}",
    "cnpj": r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}",
    "currency": r"R\$ ?\d",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "url": r"https?://[^\s]+",
    "phone": r"\(\d{2}\) ?\d{4,5}-\d{4}",
    "date": r"\d{1,2}/\d{1,2}/\d{4}",
    "caps": r"[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ]{11,}",
    "case_number": r"\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}",
}


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def word_count(c: Column) -> Column:
    """Pieces between blanks, tabs and line ends."""
    return F.size(F.filter(F.split(c, "[ \n\t]"), lambda x: x != "")).cast("bigint")


def regex_word_count(c: Column) -> Column:
    """Runs of letters, digits and underscores of any language."""
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+")).cast("bigint")


def mean_line_length(c: Column) -> Column:
    """Mean length of the lines that aren't blank; 0 without any."""
    kept = F.transform(F.filter(lines(c), lambda x: F.trim(x) != ""), F.length)
    return F.coalesce(F.aggregate(kept, F.lit(0).cast("double"), lambda a, x: a + x) / F.nullif(F.size(kept), F.lit(0)), F.lit(0.0))


def top_lines(c: Column, n: int) -> Column:
    return F.array_join(F.slice(lines(c), 1, n), "\n")


def bottom_lines(c: Column, n: int) -> Column:
    ls = lines(c)
    return F.array_join(F.slice(ls, F.greatest(F.size(ls) - n + 1, F.lit(1)), F.lit(n)), "\n")


def full_lines(c: Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(lines(c), lambda x: F.trim(x)), lambda x: x != "")


def nth(a: Column, n: int) -> Column:
    """The n-th element from 1, or null past the end."""
    return F.try_element_at(a, F.lit(n))


def languages(c: Column) -> Column:
    """Names of the languages that a text's small words point to; they may overlap."""
    each = [F.when(c.rlike(f"(?iu){EDGE}(?:{w}){EDGE}"), F.lit(name)) for name, w in LANGUAGE_WORDS.items()]
    return F.array_compact(F.array(*each))


def references(c: Column) -> Column:
    return F.array_distinct(F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in REFERENCES]))


def has_money_strict(c: Column) -> Column:
    return c.rlike(r"(?i)R\$ ?[0-9]")


def has_money_loose(c: Column) -> Column:
    return F.lower(c).contains("r$") | F.lower(c).contains("honor")


def has_cpf_strict(c: Column) -> Column:
    """Eleven digits with the usual marks, or eleven digits in a row."""
    return c.rlike(r"(?:^|[^0-9A-Za-z_])(?:\d{3}\.\d{3}\.\d{3}-\d{2}|\d{11})(?:$|[^0-9A-Za-z_])")


def has_cpf_loose(c: Column) -> Column:
    """Eleven digits with or without marks between their groups."""
    return c.rlike(r"(?:^|[^0-9A-Za-z_])\d{3}[.-]?\d{3}[.-]?\d{3}[.-]?\d{2}(?:$|[^0-9A-Za-z_])")


def money_values(c: Column) -> Column:
    """Amounts written after R$, in order, as decimals."""
    found = F.regexp_extract_all(c, F.lit(r"R\$\s*(\d{1,3}(?:\.\d{3})*(?:,\d{2})?)"), F.lit(1))
    return F.transform(found, parse_money)


def parse_money(c: Column) -> Column:
    """`R$ 1.234,56` as decimal(18,2); null if it is no amount."""
    bare = F.trim(F.regexp_replace(c, r"R\$|\s", ""))
    return F.when(bare.rlike(r"^-?\d{1,3}(?:\.\d{3})*(?:,\d{1,2})?$|^-?\d+(?:,\d{1,2})?$"), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).cast("decimal(18,2)")


def format_money(c: Column) -> Column:
    """A decimal as `R$ 1.234,56`."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(c, 2), ",.", ".,"))


def parse_date(c: Column) -> Column:
    """Day-first dates in figures (two-digit years are 20xx), ISO dates, and `2 de março de 2024`; null otherwise."""
    d = F.regexp_extract(c, r"(\d{1,2})[/.](\d{1,2})[/.](\d{4}|\d{2})(?:\D|$)", 1)
    m = F.regexp_extract(c, r"(\d{1,2})[/.](\d{1,2})[/.](\d{4}|\d{2})(?:\D|$)", 2)
    y = F.regexp_extract(c, r"(\d{1,2})[/.](\d{1,2})[/.](\d{4}|\d{2})(?:\D|$)", 3)
    figures = F.try_to_date(F.concat_ws("-", F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    iso = F.try_to_date(F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    pattern = r"(?i)(\d{1,2})\s+de\s+([a-zç]+)\s+de\s+(\d{4})"
    name = unaccent(F.lower(F.regexp_extract(c, pattern, 2)))
    number = reduce(lambda acc, i: F.when(name == F.lit(MONTHS[i].replace("ç", "c")), F.lit(f"{i + 1:02d}")).otherwise(acc), range(12), F.lit(None).cast("string"))
    words = F.try_to_date(F.concat_ws("-", F.regexp_extract(c, pattern, 3), number, F.lpad(F.regexp_extract(c, pattern, 1), 2, "0")), "yyyy-MM-dd")
    return F.coalesce(F.when(d != "", figures), iso, F.when(number.isNotNull(), words))


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def for_hash(c: Column) -> Column:
    """Lower case, controls as blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[\x00-\x1f\x7f]+", " "), " +", " "))


def for_match(c: Column) -> Column:
    """Folded, with nothing but letters, digits, blanks and a few marks left."""
    return F.trim(F.regexp_replace(F.regexp_replace(unaccent(F.lower(c)), r"[^a-z0-9\s/.-]", ""), r"\s+", " "))


def collapse_spaced(c: Column) -> Column:
    """Runs of single characters with blanks between them joined: `D E S P A C H O de` as `DESPACHO de`."""
    one = r"[\p{L}\p{N}$/\-–.,ªº°]"
    return F.regexp_replace(c, rf"(?<=(?:^|\s){one})[ \t]+(?={one}(?:\s|$))", "")


def collapse_doubled(c: Column) -> Column:
    """`aabbcc` as `abc`, where at least 70 % of the pairs (three or more) are doubles."""
    n = F.length(c)
    starts = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)), F.lit(2))
    pairs = F.transform(starts, lambda i: F.substr(c, i, F.lit(2)))
    doubles = F.size(F.filter(pairs, lambda p: F.substring(p, 1, 1) == F.substring(p, 2, 1)))
    firsts = F.array_join(F.transform(pairs, lambda p: F.substring(p, 1, 1)), "")
    return F.when((n >= 4) & (n % 2 == 0) & (doubles >= 3) & (doubles >= 0.7 * F.size(pairs)), firsts).otherwise(c)


def snippet(c: Column, position: Column, before: int, after: int) -> Column:
    """Text around a position counted from 0, line ends as blanks."""
    start = F.greatest(position - before, F.lit(0))
    length = F.least(position + after, F.length(c)) - start
    return F.trim(F.replace(F.substr(c, (start + 1).cast("int"), length.cast("int")), F.lit("\n"), F.lit(" ")))


def first_position(c: Column, wanted: list[str]) -> Column:
    """The first place, from 0, of any of some strings in a folded text; 0 without any."""
    at = F.array(*[F.instr(c, w) - 1 for w in wanted])
    return F.coalesce(F.array_min(F.filter(at, lambda x: x >= 0)), F.lit(0))


def highlight(c: Column, word: str) -> Column:
    """Whole words put between double underscores, whatever their case."""
    return F.regexp_replace(c, rf"(?iu)(?<![\p{{L}}\p{{N}}_])({word})(?![\p{{L}}\p{{N}}_])", "__$1__")


def despaced(c: Column) -> Column:
    """A line set in single letters with blanks between, closed up; any other as it is."""
    tokens = F.filter(F.split(c, " "), lambda x: x != "")
    single = F.size(F.filter(tokens, lambda x: F.length(x) == 1))
    return F.when(single / F.nullif(F.size(tokens), F.lit(0)) > 0.5, F.regexp_replace(c, r"[ \t\n\r\f]+", "")).otherwise(c)


def compact_footer(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " "))


def plain_title(c: Column) -> Column:
    """A bookmark's title without underscores, codes in brackets at its end, a number before it or a system's mark after it."""
    t = F.trim(F.regexp_replace(F.replace(c, F.lit("_"), F.lit(" ")), r"[ \t\n\r\f]+", " "))
    t = F.trim(F.regexp_replace(t, r"\([0-9A-Za-z]{4,}\)$", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"^\d+ *- *", ""), r"(?i) *- *SEI.*$", "")
    return F.trim(t)


def title_case(c: Column) -> Column:
    return F.initcap(F.lower(F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " "))))


def cut_at(c: Column, words: list[str]) -> Column:
    """A value up to the first of some words, whatever their case, and without the marks before it; from its start on it stays whole."""
    low = F.lower(c)
    at = F.array_min(F.filter(F.array(*[F.instr(low, F.lit(w.lower())) for w in words]), lambda i: i > 0))
    return F.trim(F.regexp_replace(F.trim(F.when(at > 1, F.substring(c, F.lit(1), at - 1)).otherwise(c)), "[,;.–-]+$", ""))


def chunks(c: Column, size: int = 120) -> Column:
    """A text in pieces of `size` characters."""
    n = F.ceil(F.length(c) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(c, i * size + 1, F.lit(size))))


def close_after_cleaning(a: Column, b: Column) -> Column:
    """1 less the edits between two cleaned texts, in parts of the longer one's length."""
    x, y = for_match(a), for_match(b)
    most = F.greatest(F.length(x), F.length(y))
    return F.when(most > 0, 1 - F.levenshtein(x, y) / most).otherwise(F.lit(1.0))
