"""Names of people and organisations, taken apart for comparison.

A name becomes folded content tokens in the order first ... last: titles, notes and
particles are dropped, "Last, First" is turned round, digits read for letters are put
back, and a descendant's mark (Filho, Junior, Neto) is kept apart because it names
another person. Organisations become a kind and the words that tell them apart.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

from folhario.llm.pii_table import GIVEN

PARTICLES = frozenset("de da do das dos e d del".split())
TITLES = frozenset("dr dra sr sra srta sra. prof profa perito perita expert exmo exma ilmo ilma eng enga adv dona seu o a".split())
SUFFIXES = {"filho": "filho", "fo": "filho", "f.o": "filho", "fi": "filho", "junior": "junior", "jr": "junior", "jnr": "junior", "jun": "junior", "neto": "neto", "nto": "neto", "nt": "neto", "n.to": "neto", "sobrinho": "sobrinho"}
#: Nicknames in common use and the given names they stand for (general knowledge).
NICKNAMES = {
    "bene": "benedito", "bia": "beatriz bianca", "ze": "jose", "lu": "lucia luiza luis lourdes luciana", "chica": "francisca", "chico": "francisco",
    "rafa": "rafael rafaela", "terezinha": "teresa", "teresinha": "teresa", "tete": "teresa", "mane": "manoel manuel", "zefa": "josefa", "gera": "geraldo",
    "dani": "daniel daniela", "cida": "aparecida", "cidinha": "aparecida", "mariinha": "maria", "mariazinha": "maria", "biel": "gabriel", "gabi": "gabriel gabriela",
    "mundinho": "raimundo", "raimundinho": "raimundo", "tonho": "antonio", "toninho": "antonio", "toinho": "antonio", "edu": "eduardo eduarda", "duda": "eduardo eduarda",
    "beto": "roberto gilberto alberto humberto", "lourdinha": "lourdes", "nanda": "fernanda", "nando": "fernando", "guto": "augusto gustavo", "guga": "gustavo",
    "tiao": "sebastiao", "leo": "leandro leonor leonardo", "ju": "julia juliana", "lena": "helena", "nato": "renato", "quim": "joaquim", "isa": "isaura isabel",
    "cacilda": "cacilda", "ceica": "conceicao", "fafa": "fatima", "nena": "irene", "nono": "leonor", "giba": "gilberto", "gil": "gilberto", "toni": "antonio", "sil": "silvia", "lia": "eliane", "nata": "natalia", "marcao": "marcos", "rosinha": "rosa", "zezinho": "jose", "pedrinho": "pedro", "marquinhos": "marcos",
    "carlinhos": "carlos", "jorginho": "jorge", "luisinho": "luis", "paulinha": "paula", "martinha": "marta", "claudinha": "claudia", "serginho": "sergio", "kiko": "francisco",
}
NICK = {k: frozenset(v.split()) for k, v in NICKNAMES.items()}
#: Leading words of organisations, folded, with the kind they tell (fixed vocabulary).
KINDS = {
    "seguradora": "seguradora", "seg": "seguradora", "viacao": "viacao", "viac": "viacao", "distribuidora": "distribuidora", "distrib": "distribuidora",
    "hospital": "hospital", "hosp": "hospital", "supermercados": "supermercados", "superm": "supermercados", "supermercado": "supermercados", "construtora": "construtora",
    "constr": "construtora", "cooperativa": "cooperativa", "coop": "cooperativa", "companhia": "companhia", "cia": "companhia", "financeira": "financeira",
    "financ": "financeira", "fin": "financeira", "instituto": "instituto", "inst": "instituto", "fundo": "fundo", "fdo": "fundo", "departamento": "departamento",
    "depto": "departamento", "dep": "departamento", "dept": "departamento", "agencia": "agencia", "ag": "agencia", "autarquia": "autarquia", "aut": "autarquia",
    "superintendencia": "superintendencia", "superint": "superintendencia", "banco": "banco", "bco": "banco", "municipio": "municipio", "mun": "municipio", "prefeitura": "municipio",
    "empresa": "empresa", "emp": "empresa", "associacao": "associacao", "assoc": "associacao", "sindicato": "sindicato", "sind": "sindicato", "fundacao": "fundacao", "fund": "fundacao",
    "universidade": "universidade", "univ": "universidade", "estado": "estado", "industria": "industria", "ind": "industria", "comercio": "comercio", "transportadora": "transportadora", "transp": "transportadora",
}
#: Words of organisations that don't tell one from another.
COMMON = frozenset(
    "est energia energ maternidade mat agricola agric aguas agua saude estadual est previdencia prev vale estradas estr rodagem transito trans municipal munic mun defesa def rural rur obras publicas pub publ "
    "ltda me epp sa s a filial matriz eireli cia e de da do das dos grupo unidade".split()
)
#: Words that tell the kind of organisation where its leading word is only a letter.
TELLING = {"saude": "fundo", "previdencia": "instituto", "prev": "instituto", "estradas": "departamento", "estr": "departamento", "transito": "autarquia", "trans": "autarquia", "defesa": "agencia", "obras": "superintendencia", "energia": "distribuidora", "aguas": "companhia", "agricola": "cooperativa", "maternidade": "hospital"}
LEGAL = frozenset("ltda sa epp eireli filial matriz".split())
#: Common given names, folded, that are known for names before any are learnt.
COMMON_GIVEN = frozenset(
    unicodedata.normalize("NFKD", g).encode("ascii", "ignore").decode().lower() for g in GIVEN
)
_WORDS = re.compile(r"[^\W_]+(?:[.'][^\W_]+)*\.?")


class Name(NamedTuple):
    """kind: 'person', 'org', 'acronym' or '' (no name); tokens: first ... last, or the telling words of an organisation."""

    kind: str
    tokens: tuple[str, ...]
    suffix: str
    org: str
    acronym: str


NOTHING = Name("", (), "", "", "")


@lru_cache(maxsize=60_000)
def skeleton(token: str) -> str:
    """A token spelled plainly: like-sounding letters as one, doubled letters single."""
    t = token.replace("ph", "f").replace("th", "t").replace("y", "i").replace("que", "ce").replace("qui", "ci").replace("k", "c").replace("w", "v")
    t = re.sub(r"([pbdgcrl])h(?=[aeiou])", lambda m: m.group(1) + ("h" if m.group(1) in "cl" else ""), t)
    t = re.sub(r"z(?=$|[^aeiou])", "s", t)
    return re.sub(r"(.)\1+", r"\1", t)


def fold(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.replace("º", "o").replace("°", "o").replace("ª", "a"))
        text = "".join(c for c in text if not unicodedata.combining(c))
    return text.lower()


def unread(word: str) -> str:
    """Digits that stand for letters, put back."""
    if word.isalpha() or not any(c.isalpha() for c in word):
        return word
    return word.translate(str.maketrans("01583", "olsbe"))


_NOTE = re.compile(r"\(\s*(?!a\s*\))[^)]*\)|\bcpf\b.*|\boab\b.*|\bcrea\b.*|\bcrm\b.*|\bnos autos\b.*|\bnomead[oa]\b.*|\btrata(?:-se)?\b.*|\bja qualificad[oa]\b.*|\be outr[oa]s?\b.*|\bpor seu\b.*", re.S)


def parse(text: str | None) -> Name:
    """The parts of a name; NOTHING for what isn't one."""
    if not text:
        return NOTHING
    f = fold(text).strip()
    acronym = ""
    m = re.match(r"\s*([a-z]{4,9})\s+[-–]\s+(\S.*)$", f, re.S)
    if m and text.strip()[: len(m.group(1))].isupper() and m.group(1) not in KINDS:
        acronym, f = m.group(1), m.group(2)
    if re.fullmatch(r"[A-Z]{5,9}", text.strip()) and fold(text.strip()) not in KINDS:
        return Name("acronym", (), "", "", fold(text.strip()))
    words = [unread(w) for w in re.findall(r"[^\W_]+", f)]
    ends = [w for w in words[:1] + [w for w in words if w not in LEGAL and w not in ("me", "s", "a")][-1:] if kind_of(w)]
    kinds = ends or [w for w in words if kind_of(w) and len(w) > 6]
    if kinds:
        told = tuple(w for w in words if not kind_of(w) and not common(w) and len(w) > 2 and skeleton(w) not in PARTICLES)
        return Name("org", told, "", kind_of(kinds[0]), acronym)
    hints = [TELLING[w] for w in words[1:] if w in TELLING]
    if hints and (len(words[0]) <= 2 or set(words) & LEGAL):
        return Name("org", tuple(w for w in words if not common(w) and len(w) > 2), "", hints[0], acronym)
    f = _NOTE.sub(" ", f)
    f = re.sub(r"\b(srs?|dr)\s*\(\s*a\s*\)\.?", " ", f)
    parts = f.split(",", 1)
    sides = []
    suffix = ""
    for part in parts:
        out = []
        for w in _WORDS.findall(part):
            bare = w.rstrip(".")
            if len(bare) == 1 and bare.isalpha() and (not out or w.endswith(".") or bare not in "eoa"):
                out.append(bare + ".")
                continue
            if bare in SUFFIXES or unread(bare) in SUFFIXES:
                suffix = SUFFIXES.get(bare) or SUFFIXES[unread(bare)]
                continue
            for x in bare.split("."):
                x = unread(x.replace("'", ""))
                if x and x not in PARTICLES and not x.isdigit() and not (len(x) <= 4 and out and skeleton(x) in PARTICLES):
                    out.append(x if len(x) > 1 else x + ".")
        sides.append(out)
    if len(sides) == 2 and sides[1]:
        first = [w for w in sides[1] if w not in TITLES]
        tokens = first + sides[0][::-1] if first else sides[0]
    else:
        tokens = sides[0]
    while tokens and tokens[0].rstrip(".") in TITLES and len(tokens) > 1 and not (len(tokens[0]) == 2 and tokens[0].endswith(".")):
        tokens = tokens[1:]
    tokens = [t for t in tokens if t.rstrip(".") not in TITLES or t.endswith(".")]
    if not tokens or not any(len(t) > 2 for t in tokens):
        return NOTHING
    return Name("person", tuple(tokens), suffix, "", acronym)


def osa(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours being one; `most` + 1 where there are more."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return most + 1
    two: list[int] = []
    one = list(range(lb + 1))
    for i in range(1, la + 1):
        row = [i] + [0] * lb
        ca = a[i - 1]
        for j in range(1, lb + 1):
            cost = one[j - 1] + (ca != b[j - 1])
            if row[j - 1] + 1 < cost:
                cost = row[j - 1] + 1
            if one[j] + 1 < cost:
                cost = one[j] + 1
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == b[j - 1] and two[j - 2] + 1 < cost:
                cost = two[j - 2] + 1
            row[j] = cost
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[lb], most + 1)


def allowed(a: str, b: str) -> int:
    """Edits by which two words may differ and still be one, misspelled."""
    n = min(len(a), len(b))
    return 0 if n < 4 else 1 if n < 7 else 2


@lru_cache(maxsize=100_000)
def spelled(a: str, b: str) -> int | None:
    """Edits between two spellings of one word, or None for two words."""
    if a == b:
        return 0
    sa, sb = skeleton(a), skeleton(b)
    if sa == sb:
        return 0
    most = allowed(a, b)
    d = osa(a, b, most)
    if d > most:
        most = min(most, allowed(sa, sb))
        d = osa(sa, sb, most)
    return d if d <= most else None


@lru_cache(maxsize=100_000)
def kind_of(word: str) -> str:
    """The kind of organisation a word tells, also if the word is long and misspelled; empty if none."""
    if word in KINDS:
        return KINDS[word]
    if len(word) >= 7:
        for k, kind in KINDS.items():
            if len(k) >= 8 and abs(len(k) - len(word)) <= 1 and osa(skeleton(word), skeleton(k), 1) <= 1:
                return kind
    return ""


@lru_cache(maxsize=100_000)
def common(word: str) -> bool:
    """Whether a word of an organisation's name is one that many share."""
    return word in COMMON or len(word) >= 6 and any(len(k) >= 6 and osa(skeleton(word), skeleton(k), 1) <= 1 for k in COMMON)


def is_initial(t: str) -> bool:
    return len(t) == 2 and t[1] == "."


def given_match(a: str, b: str, given: frozenset[str] | set[str]) -> int | None:
    """How two first names agree: 0 for one name or its nickname, 1 for an initial, edits + 0 otherwise; None if they don't."""
    if a == b:
        return 0
    if is_initial(a) or is_initial(b):
        return 0 if a[0] == b[0] else None
    if b in NICK.get(a, ()) or a in NICK.get(b, ()):
        return 0
    if skeleton(a) == skeleton(b):
        return 0
    if a in given and b in given:
        return None
    d = spelled(a, b)
    if d is None and (a in given or b in given) and min(len(a), len(b)) == 3 and osa(a, b, 1) <= 1:
        return 1  # a letter lost from a short name
    return d


class Agreement(NamedTuple):
    full: int  # tokens that agree as whole words
    initials: int
    edits: int
    missing: int  # inner tokens of the longer name without a partner


def agree(a: tuple[str, ...], b: tuple[str, ...], given: frozenset[str] | set[str]) -> Agreement | None:
    """How two names (first ... last) may be of one person, or None.

    First and last must agree; every inner token of the shorter name must agree, in
    order, with one of the longer.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(a) < 2:
        return None
    f = given_match(a[0], b[0], given)
    last = spelled(a[-1], b[-1]) if not (is_initial(a[-1]) or is_initial(b[-1])) else None
    if f is None or last is None:
        return None
    full = 1 + (not (is_initial(a[0]) or is_initial(b[0])))
    initials = int(is_initial(a[0]) or is_initial(b[0]))
    edits, at, skipped = f + last, 1, 0
    inner = b[1:-1]
    pos = 0
    for t in a[1:-1]:
        while pos < len(inner):
            u = inner[pos]
            pos += 1
            if is_initial(t) or is_initial(u):
                if t[0] == u[0]:
                    initials += 1
                    break
            elif (d := spelled(t, u)) is not None:
                full += 1
                edits += d
                break
            skipped += 1
        else:
            return None
    return Agreement(full, initials, edits, skipped + len(inner) - pos)
