"""Personal data in free text: found, typed, and replaced by placeholders.

A linear-chain conditional random field over word shapes reads whole texts, trained
once on the driver from a small labelled table (`pii_table`, `rows` of it) and sent to
the workers, who decode it by Viterbi in numpy batches. What the model marks is then
checked exactly: a tax number must have its eleven digits, an e-mail its sign, an
address its word for the street, and an item's first character is put in its place.

Defined cases: null, empty and blank texts hold no items and come back as they are;
texts of any length are read to their end; every mention counts, in repeated rows too;
columns of the input other than those named play no part, or pass through `redact`;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folhario.llm import pii_table
from folhario.llm.crf import Model, tokenise, tokenise_batch
from folhario.llm.names import COMMON_GIVEN, fold, kind_of
from folhario.runtime import without

LABELS = ("O", *pii_table.KINDS)
PLACEHOLDER = {"name": "[NOME]", "cpf": "[CPF]", "rg": "[RG]", "pis": "[PIS]", "email": "[EMAIL]", "phone": "[TELEFONE]", "address": "[ENDERECO]"}


def lexicon() -> dict[str, str]:
    """Small word lists that the model sees as features."""
    out = {g.lower(): "given" for g in pii_table.GIVEN}
    out |= {w: "month" for w in pii_table.MONTHS}
    out |= {w: "street" for w in pii_table.STREET_WORDS}
    out |= {w: "title" for w in pii_table.TITLES}
    out |= {w: "particle" for w in pii_table.PARTICLES}
    return out


@lru_cache(maxsize=2)
def model(rows: int = 2400, seed: int = 11) -> Model:
    """The trained model; the table's size is the bound of the sample it is fitted on."""
    number = {k: i for i, k in enumerate(LABELS)}
    data = []
    for text, spans in pii_table.labelled(rows, seed):
        tokens, starts, before = tokenise(text)
        y = np.zeros(len(tokens), np.int64)
        for a, b, kind in spans:
            y[(starts >= a) & (starts < b)] = number[kind]
        if tokens:
            data.append((tokens, before.astype(np.int64), y))
    return Model(list(LABELS), lexicon()).fit(data)


_D = r"[\dOoIlSsBA]"
ELEVEN = re.compile(rf"{_D}(?:[\s.\-/]{{0,3}}{_D}){{10}}(?![\dA-Za-z])")
SEVEN = re.compile(rf"{_D}(?:[.\-]?{_D}){{5,8}}(?![\dA-Za-z])")
SHAPED = re.compile(rf"{_D}{{3}}\.{_D}{{3}}\.{_D}{{3}}[-/]{_D}{{2}}(?![\dA-Za-z])")
PHONE = re.compile(r"(?:\+\s?\d{2}\s?)?\(?\s?\d[\d\s().\-]{5,20}\d")
MAIL = re.compile(r"[\w.+\-]+\s?(?:@|\(at\)|\[at\]|\[arroba\]|\(arroba\)|\barroba\b)\s?[\w\-]+(?:\s?(?:\.|\bponto\b)\s?[\w\-]+)+", re.I)
SIGN = re.compile(r"@|\(at\)|\[at\]|\[arroba\]|\(arroba\)|\barroba\b", re.I)
STREET = re.compile(r"\b(?:" + "|".join(sorted(pii_table.STREET_WORDS | {"r"}, key=len, reverse=True)) + r")\b", re.I)
TITLE = re.compile(r"(?:(?:[oa]\s+)?(?:exm[oa]|ilm[oa]|sr|sra|srta|dr|dra|prof|profa|des|dona)\b\.?\s*(?:\(a\)\.?)?\s*)+", re.I)
ROAD = re.compile(r"(?:r\.|rua|av\.|avenida|trav\.|travessa|praça|alameda|ladeira|rodovia|qd\.)\s+(?:dona|padre|coronel|conselheiro|doutor|barão|dom|frei|general|major)\b", re.I)
NUMBER = re.compile(r",?\s+(?:n\s*[.º°o]{0,2}\s*)?\d|,\s+(?:s/n|km)", re.I)
#: What stands before a name that is no person's: a building, or a street whose word the model left out.
BUILDING = re.compile(r"\b(?:f[óo]rum|edif[íi]cio|pal[áa]cio|escola)\s+(?:des|dr|dra|prof|min|juiz)\b\.?\s*$", re.I)
STREET_BEFORE = re.compile(r"\b(?:r\.|rua|av\.|avenida|trav\.|travessa|praça|alameda|ladeira|rodovia|qd\.|beco|estrada|largo)\s+(?:(?:dona|padre|coronel|conselheiro|doutor|barão|dom|frei|general|major)\s+)?$", re.I)
#: A court or unit of which what follows is the place, and words that open one.
SEAT = re.compile(r"\b(?:vara|secretaria|câmara|comarca|cartório|juizado|turma)(?:\s+(?:d[aeo]s?\s+)?[^\W\d_]+){0,2}\s+d[aeo]s?\s+(?:[^\W\d_]+\s+d[aeo]s?\s+)?$", re.I)
#: Words for kinds of place (general vocabulary): what begins with one, or with a numeral, is no person's name.
PLACE_WORDS = frozenset(
    "agua aguas alto arraial baia baixa baixo barra barreiro brejo cachoeira campo campos chapada corrego estacao fazenda grota ilha ilheus lago lagoa lajes mata mato morro monte montes olho pantano parque pedra pedras ponta ponte porto "
    "poco pouso praia ribeirao riacho rio salto santo sao serra sertao sitio vale vargem varzea vila um dois tres quatro cinco seis sete oito nove dez onze doze treze quatorze quinze dezesseis vinte trinta fazendas".split()
)
#: A street begun before what the model marked: its word and up to three more.
STREET_LEAD = re.compile(r"\b(?:r\.|rua|av\.|avenida|trav\.|travessa|praça|alameda|ladeira|rodovia|beco|estrada|largo)\s+(?:[^\W\d_]+\s+){0,3}$", re.I)
SEAT_ENDS = frozenset("de da do das dos são sao sã0 santo santa".split())
HONOURS = frozenset("des dr dra prof min juiz".split())
ROADS = frozenset("r rua av avenida trav travessa praça alameda ladeira rodovia qd beco estrada largo dona padre coronel conselheiro doutor barão dom frei general major".split())
#: A label right before a number settles which number it is.
LABEL = re.compile(r"\b(CPF|C\.P\.F\.|PIS|NIT|PASEP|RG|Identidade)\b[^\w]{0,3}(?:(?:sob|com|de)\s+)?(?:o\s+)?(?:n\s*[.º°o]{0,2}\s*)?$", re.I)
LABELLED = {"cpf": "cpf", "c.p.f.": "cpf", "pis": "pis", "nit": "pis", "pasep": "pis", "rg": "rg", "identidade": "rg"}
WORDS = re.compile(r"[^\W\d_]+")
#: What no name goes over; words that stand between the parts of a name; verbs that open a sentence.
PIECE = re.compile(r"[^?!;:()\[\]|\"“”]+")
SMALL = frozenset("de da do das dos e del di du von van der la y".split())
VERB = re.compile(r"[aei]u$|[^aeiou]ou$|[aei]ram$|ndo$|eci$|[tdrgsv]ei$|ebi$")
_NOT_FIRST = frozenset("de da do das dos e o a".split())


def _number(pattern: re.Pattern, text: str, a: int, b: int) -> tuple[int, int] | None:
    while a and (text[a - 1].isdigit() or text[a - 1] in ".-/OoIlSsBA"):
        a -= 1
    m = pattern.search(text, a, min(len(text), b + 12))
    if not m or m.start() >= b or m.start() and text[m.start() - 1].isalnum():
        return None
    digits = sum(c.isdigit() for c in m.group())
    return (m.start(), m.end()) if digits >= 0.6 * len(re.sub(r"[\s.\-/]", "", m.group())) else None


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A marked name cut to what can be one: no stops, no small words between capitals, no verb before it, no street after it."""
    best = (a, b)
    for m in PIECE.finditer(text, a, b):
        if sum(w.group()[0].isupper() for w in WORDS.finditer(m.group())) > 1 or m.end() == b:
            best = m.span()
            break
    a, b = best
    words = [w for w in WORDS.finditer(text, a, b)]
    capital = [w for w in words if w.group()[0].isupper()]
    if len(capital) > 1:
        # runs of capitals between small words that are no particles; the first run of two or more is the name
        runs: list[list[re.Match]] = [[]]
        for w in words:
            if w.group().islower() and len(w.group()) > 1 and w.group() not in SMALL:
                runs.append([])
            else:
                runs[-1].append(w)
        good = next((r for r in runs if sum(w.group()[0].isupper() for w in r) > 1), None)
        if good and len(runs) > 1:
            a, b = good[0].start(), min(b, good[-1].end() + (text[good[-1].end() : good[-1].end() + 1] == "." and len(good[-1].group()) == 1))
            words = good
        first = words[0].group()
        if len(capital) > 2 and VERB.search(first) and fold(first) not in COMMON_GIVEN and words[1].group()[0].isupper():
            a = words[1].start()
    street = next((m for m in re.finditer(r",\s*", text[a:b]) if STREET.match(text, a + m.end())), None)
    return a, a + street.start() if street else b


def checked(kind: str, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The exact place of an item that the model marked at text[a:b], or None if it can't be one."""
    if kind in ("cpf", "pis"):
        return _number(ELEVEN, text, a, b)
    if kind == "rg":
        return _number(SEVEN, text, a, b)
    if kind == "phone":
        while a and text[a - 1] in "(+" or a > 1 and text[a - 1] == " " and text[a - 2] in "(+":
            a -= 1 if text[a - 1] in "(+" else 2
        m = PHONE.match(text, a) or PHONE.search(text, a, b + 4)
        if not m or m.start() >= b:
            return None
        digits = sum(c.isdigit() for c in m.group())
        return (m.start(), m.end()) if 8 <= digits <= 13 else None
    if kind == "email":
        # from the sign the local part is walked back to its start, however long it is; signs are sought in
        # the whole run of address letters around the mark, and a little beyond it for those written with blanks
        left, right = a, b
        while left and (text[left - 1].isalnum() or text[left - 1] in ".+-_@"):
            left -= 1
        while right < len(text) and (text[right].isalnum() or text[right] in ".+-_@"):
            right += 1
        for sign in SIGN.finditer(text, max(0, left - 60), min(len(text), right + 12)):
            start = sign.start() - (text[sign.start() - 1 : sign.start()].isspace())
            while start and (text[start - 1].isalnum() or text[start - 1] in ".+-_"):
                start -= 1
            m = MAIL.match(text, start)
            if m and m.end() > a and m.start() < b:
                return m.start(), m.end()
        return None
    if kind == "address":
        m = STREET.search(text, a, b)
        if not m or m.group().lower() == "r" and text[m.end() : m.end() + 1] != ".":
            return None
        return (m.start(), b) if re.search(r"\d|s/n", text[m.start() : min(len(text), b + 3)], re.I) else None
    m = TITLE.match(text, a)
    if m and m.end() < b:
        a = m.end()
    a, b = trimmed(text, a, b)
    words = [(w.start(), w.group()) for w in WORDS.finditer(text, a, b)]
    while words and (words[0][1] in _NOT_FIRST or len(words[0][1]) > 1 and words[0][1].lower() in _NOT_FIRST):
        words.pop(0)
    if len(words) < 2 or not any(len(w) > 2 for _, w in words) or kind_of(fold(words[0][1])) or fold(words[0][1]) in PLACE_WORDS:
        return None
    if text[a:b].islower() and not any(fold(w) in COMMON_GIVEN for _, w in words) and len(words[0][1]) > 1:
        return None  # small letters throughout and no given name: ordinary words
    return words[0][0], b


def items(texts: list[str | None], m: Model) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the items of each text, by place; starts from 0."""
    parts = tokenise_batch(texts, m.numbered)
    out = []
    for text, (_, starts, ends, _b), labels in zip(texts, parts, m.decode([(p[0], p[3]) for p in parts])):
        found: list[tuple[int, int, str]] = []
        marked = np.flatnonzero(labels)
        if len(marked):
            named = labels[marked]
            cuts = np.flatnonzero((marked[1:] - marked[:-1] > 1) | (named[1:] != named[:-1])) + 1
            heads, tails = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(marked)])) - 1
            last = -1
            for label, a, b in zip(named[heads].tolist(), starts[marked[heads]].tolist(), ends[marked[tails]].tolist()):
                kind = LABELS[label]
                if kind == "name" and (ROAD.match(text, a) or STREET.match(text, a)) and (number := NUMBER.search(text, a, min(len(text), b + 10))):
                    kind, b = "address", max(b, number.end())  # a street named after a person, short form included
                elif kind == "name" and (road := STREET_LEAD.search(text, max(0, a - 50), a)) and NUMBER.match(text, b) and road.start() > last:
                    kind, a = "address", road.start()
                elif kind == "name":
                    before = text[max(0, a - 30) : a]
                    word = before.split()[-1] if not before.isspace() and before else ""
                    bare = word.rstrip(".").lower()
                    if bare in HONOURS and BUILDING.search(before) or bare in SEAT_ENDS and SEAT.search(text[max(0, a - 60) : a]):
                        continue
                    if bare in ROADS and (road := STREET_BEFORE.search(before)) and NUMBER.search(text, a, min(len(text), b + 10)):
                        kind, a = "address", a - len(before) + road.start()
                    elif len(bare) > 2 and before[-1].isspace() and fold(bare) in COMMON_GIVEN and (at := text.rfind(word, max(0, a - 30), a)) > last:
                        a = at  # a given name that the model left outside
                if kind in ("cpf", "pis", "rg") and (label := LABEL.search(text, max(0, a - 24), a)):
                    kind = LABELLED[label.group(1).lower()]
                if kind in ("rg", "pis") and (place := SHAPED.search(text, max(0, a - 3), min(len(text), b + 12))) and place.start() < b and not (place.start() and text[place.start() - 1].isalnum()):
                    kind = "cpf"  # only a tax number is written so
                place = checked(kind, text, a, b)
                if place and place[0] > last:
                    found.append((*place, kind))
                    last = place[1] - 1
        out.append(found)
    return out


def _held(df: DataFrame, rows: int, seed: int):
    """The trained weights, broadcast: a few megabytes whatever the corpus."""
    m = model(rows, seed)
    m.types, m.tables, m.shapes = {}, None, None
    return df.sparkSession.sparkContext.broadcast(m)


def find_items(df: DataFrame, key: str, text: str, table_name: str, rows: int = 2400, seed: int = 11) -> DataFrame:
    """(table_name, row_id, kind, start_pos) of every item in `df[text]`; a map, without a shuffle."""
    held = _held(df, rows, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 2000):
                part = batch.iloc[a : a + 2000]
                got = items(list(part["t"]), held.value)
                out = [(table_name, k, kind, s + 1) for k, found in zip(part["k"], got) for s, _, kind in found]
                yield pd.DataFrame(out, columns=["table_name", "row_id", "kind", "start_pos"])

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).where("t is not null").mapInPandas(run, "table_name string, row_id long, kind string, start_pos int")


def redact(df: DataFrame, text: str = "text", rows: int = 2400, seed: int = 11) -> DataFrame:
    """`df` with `redacted`: the text with a typed placeholder in place of every item, otherwise unchanged."""
    held = _held(df, rows, seed)
    kept = without(df, "redacted")

    def one(t: str | None, found: list[tuple[int, int, str]]) -> str | None:
        if not found:
            return t
        out, at = [], 0
        for a, b, kind in found:
            out += [t[at:a], PLACEHOLDER[kind]]
            at = b
        return "".join(out) + t[at:]

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            done = []
            for a in range(0, len(batch), 2000):
                part = list(batch.iloc[a : a + 2000])
                done += [one(t, f) for t, f in zip(part, items(part, held.value))]
            yield pd.Series(done, dtype=object)

    return kept.withColumn("redacted", F.pandas_udf(run, "string")(F.col(text).cast("string")))
