"""Values typed freely, mapped to the entries of a reference list or reported as none of them.

Token-level repair. The different values are cut into tokens; each different token is
joined to the reference vocabulary by edit distance (tokens and vocabulary meet on the
strings they have in common after a few deletions, an equi-join, and the distance is
then checked). A word of a trade is in the vocabulary under the forms of its family too
(`FAMILIES`) and by its beginnings, for abbreviations. The repaired tokens rank the
entries by soft TF-IDF. An exact check follows for the kind of value: every word of a
place must be accounted for on both sides; the parts of a person's name must agree in
order; a trade needs a clear score, or no other entry that has all of its words.

All rows of one value are one row from the start (aggregated map-side), and the answers
are joined back with the rows of frequent values split (`skew_join`), so a value that
a third of all rows hold is no heavier than another. The reference lists are small
tables with a checked bound (`largest`). Words that only general knowledge connects
with a trade are an optional list (`other_words`), which may be empty.

Defined cases: nulls, blanks and stand-ins for an absent value give no row; every other
value gives exactly one row, -1 where no entry is meant; ties of score go to the
smallest id; values of any length are read to their end; repeated rows each get a row;
an empty reference list gives -1 throughout; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folhario.functions.values import filled
from folhario.llm.names import COMMON_GIVEN, Name, agree, allowed, fold, is_initial, osa, parse, skeleton
from folhario.runtime import bounded_rows, cut, skew_join

NONE = -1

#: Endings that words of one trade take in Portuguese: who does it, what it is, what belongs to it.
FAMILIES = (
    "logista logia logo loga logico logica", "nomista nomia nomo noma nomicas nomico nomica", "scopista scopia scopico", "grafo grafia grafa grafico grafica", "terapeuta terapia", "iatra iatria",
    "cionista cao", "ricista rica rico", "edista edia edico edica", "alista alise", "anista anismo ano", "eiro eira aria agem", "iador ia iadora", "ador adora acao ativo ativa", "utor utora ucao",
    "ensor ensora ensura", "etor etora etagem", "eto eta etura", "ceutico ceutica cia", "dico dica dicina", "nico nica nia", "ario aria ariais", "prete pretacao", "ico ica", "ivil ivis", "al ais", "o a", "or ora",
)
#: Other words for a trade that neither its letters nor its family show (general knowledge): a word for a word, or a phrase for a phrase.
OTHER_WORDS = {
    "traumatologista": "ortopedista", "oculista": "oftalmologista", "generalista": "clinico", "odontologo": "dentista", "grafologista": "grafotecnico", "grafoscopista": "grafotecnico", "grafocopista": "grafotecnico",
    "datiloscopista": "papiloscopista", "topografo": "agrimensor", "imobiliario": "imoveis", "contabilidade": "contador", "contabil": "contador", "contabeis": "contador", "legal": "legista", "bioquimico": "farmaceutico",
    "trabalhista": "trabalho", "saude mental": "psiquiatria", "servico social": "assistente social", "exame grafotecnico": "grafotecnico", "exame de documentos": "documentoscopista", "avaliador de imoveis": "corretor de imoveis",
    "ciencias contabeis": "contador", "ciencias economicas": "economista", "ciencias atuariais": "atuario", "informatica": "analista de sistemas", "ti": "analista de sistemas", "interprete": "tradutor e interprete",
    "traducao juramentada": "tradutor", "administrador de empresas": "administrador", "clinica medica": "medico clinico geral", "generalista medicina": "medico clinico geral", "tradutor de libras": "interprete de libras",
    "engenheiro agrimensor": "agrimensor", "topografo agrimensor": "agrimensor", "farmaceutico bioquimico": "farmaceutico", "cirurgia odontologica": "cirurgiao dentista",
}
#: Words around a trade that say nothing about it (fixed vocabulary).
TRADE_NOISE = frozenset("perito perita peritos area cpf nomeado nomeada judicial trata trate nos autos profissao especialidade habilitacao formacao em dr dra sr sra oficial".split())
TRADE_STOP = frozenset("de da do das dos e".split())
#: Short forms in the names of places (general knowledge).
PLACE_SHORT = {
    "cpo": "campo", "pda": "pedra", "pto": "porto", "sto": "santo", "sta": "santa", "sa": "serra", "sra": "senhora", "n": "nossa", "ns": "nossa", "nsa": "nossa", "varz": "varzea",
    "vz": "varzea", "lag": "lagoa", "lg": "lagoa", "rch": "riacho", "rcho": "riacho", "bjo": "brejo", "brj": "brejo", "mte": "monte", "mt": "monte", "s": "sao", "s.": "sao", "br": "barra",
    "bra": "barra", "vl": "vila", "v": "vila", "pc": "poco", "pco": "poco", "j": "jardim", "fz": "fazenda", "st": "santo",
}
PLACE_NOISE = frozenset("comarca com foro forum municipio mun cidade zz da do de das dos e".split())


class Entry(NamedTuple):
    ref_id: int
    tokens: tuple[str, ...]


def _words(text: str) -> list[str]:
    # a full stop that slipped in before the last letter of a short form is put back
    return re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z]{2})\.(?=[a-z]\b)", "", fold(text)))


def trade_tokens(text: str) -> list[str]:
    """The telling words of a trade as typed; single letters stand behind them, or alone where there is nothing else."""
    words = [w for w in _words(re.sub(r"\(\s*[aA]\s*\)", " ", text)) if not w.isdigit()]
    telling = [w for w in words if len(w) > 1 and w not in TRADE_NOISE and w not in TRADE_STOP]
    letters = [w for w in words if len(w) == 1]
    return telling + [w for w in letters if w not in "eo"] if telling else letters


def place_tokens(text: str) -> list[str]:
    return [PLACE_SHORT.get(w, w) for w in _words(text) if w not in PLACE_NOISE]


def person_tokens(text: str) -> list[str]:
    p = parse(text)
    return list(p.tokens) if p.kind == "person" else []


TOKENS = {"trade": trade_tokens, "place": place_tokens, "person": person_tokens}


def family(token: str) -> set[str]:
    """A word of a trade and the words its family makes of it."""
    out = {token}
    for endings in map(str.split, FAMILIES):
        out |= {token[: -len(e)] + x for e in endings if token.endswith(e) and (len(token) - len(e) >= 2 or len(e) > 6) for x in endings}
    return out


def forms_of(kind: str, tokens: Iterable[str], other_words: dict[str, str]) -> list[tuple[str, str, float]]:
    """(token, form, how surely the form stands for it) of a vocabulary."""
    if kind != "trade":
        return [(t, t, 1.0) for t in tokens]
    typed = defaultdict(list)
    for a, b in other_words.items():
        if " " not in a and " " not in b:
            typed[b].append(a)
    best: dict[tuple[str, str], float] = {}
    for t in tokens:
        for form, sure in [(t, 1.0), *((f, 0.97) for f in family(t)), *((f, 0.95) for a in typed[t] for f in family(a))]:
            best[t, form] = max(best.get((t, form), 0.0), sure)
    return [(t, f, s) for (t, f), s in sorted(best.items())]


def entries_of(kind: str, rows: list[tuple[int, str]], other_words: dict[str, str] | None = None) -> list[Entry]:
    """The entries of a reference list, for trades also under the other phrases that mean one of them."""
    out = [Entry(ref_id, tuple(TOKENS[kind](name))) for ref_id, name in rows if name is not None]
    if kind == "trade":
        ranker = Ranker(kind, [e for e in dict.fromkeys(out) if e.tokens])
        known = defaultdict(list)
        for t, form, sure in forms_of(kind, ranker.where, {}):
            known[form].append((t, sure))
        for typed, meant in (other_words or {}).items():
            if " " in typed or " " in meant:
                tokens = trade_tokens(meant)
                ref_id = ranker.meant(meant, tokens, {t: known[t] for t in tokens if t in known})
                if ref_id != NONE:
                    out.append(Entry(ref_id, tuple(trade_tokens(typed))))
    return [e for e in dict.fromkeys(out) if e.tokens]


def deletions(token: str, depth: int) -> set[str]:
    """A token and what is left after deleting up to `depth` letters."""
    out = {token}
    last = {token}
    for _ in range(depth):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        out |= last
    return out


def depth_of(token: str) -> int:
    return 0 if len(token) < 3 else 1 if len(token) < 7 else 2


def similar(a: str, b: str) -> float:
    """1 for the same word, less by its edits for a misspelling of it, 0 for another word."""
    if a == b:
        return 1.0
    most = allowed(a, b) or (1 if min(len(a), len(b)) == 3 and a[0] == b[0] else 0)
    d: float = osa(a, b, most)
    if d > most:
        sa, sb = skeleton(a), skeleton(b)
        few = min(most, allowed(sa, sb))
        d = osa(sa, sb, few)
        if d > few:
            return 0.0
        d += 0.5
    return 1.0 - d / max(len(a), len(b)) if most else 0.0


def beginnings(form: str) -> set[str]:
    """How a word may be cut short, with a slip."""
    return {k for n in range(1, min(len(form), 9)) for k in deletions(form[:n], n > 3)}


def shortened(a: str, form: str) -> float:
    """How surely `a` is `form` cut short: the more letters the surer, less with a slip."""
    if len(a) == 4 and a[-1] in "oa" and form.startswith(a[:3]):
        a = a[:3]  # the raised letter of an abbreviation
    if len(a) >= len(form):
        return 0.0
    if form.startswith(a):
        return {1: 0.6, 2: 0.7, 3: 0.85}.get(len(a), 0.95)
    near = len(a) >= 3 and a[0] == form[0] and any(a == form[: len(a) + 1][:i] + form[: len(a) + 1][i + 1 :] for i in range(1, len(a) + 1))
    near = near or len(a) >= 4 and len(form) > len(a) + 1 and a[0] == form[0] and min(osa(a, form[: len(a) + x], 1) for x in (-1, 0, 1)) <= 1
    return 0.75 if near else 0.0


class Ranker:
    """Soft TF-IDF over the entries of one reference list."""

    def __init__(self, kind: str, entries: list[Entry]):
        self.kind, self.entries = kind, entries
        seen: dict[str, set[int]] = defaultdict(set)
        for i, e in enumerate(entries):
            for t in e.tokens:
                seen[t].add(i)
        n = max(len(entries), 1)
        self.weight = {t: math.log(1 + n / len(s)) for t, s in seen.items()}
        self.unknown = math.log(1 + n)
        self.where = {t: sorted(s) for t, s in seen.items()}
        self.norm = [math.sqrt(sum(self.weight[t] ** 2 for t in e.tokens)) for e in entries]
        self.given = frozenset(e.tokens[0] for e in entries) | COMMON_GIVEN if kind == "person" else frozenset()

    def rank(self, tokens: list[str], repairs: dict[str, list[tuple[str, float]]]) -> list[tuple[float, int]]:
        """(score, entry) by falling score."""
        dot: dict[int, float] = defaultdict(float)
        own = 0.0
        for t in dict.fromkeys(tokens):
            if is_initial(t):
                continue
            fits = repairs.get(t, [])
            own += (self.weight[max(fits, key=lambda f: (f[1], self.weight[f[0]]))[0]] if fits else self.unknown) ** 2
            best: dict[int, float] = {}
            for r, s in fits:
                for i in self.where[r]:
                    best[i] = max(best.get(i, 0.0), s * self.weight[r] ** 2)
            for i, x in best.items():
                dot[i] += x
        size = math.sqrt(own) or 1.0
        return sorted(((x / (size * self.norm[i]), i) for i, x in dot.items()), key=lambda p: (-p[0], self.entries[p[1]].ref_id))

    def meant(self, text: str, tokens: list[str], repairs: dict[str, list[tuple[str, float]]]) -> int:
        """The id of the entry that a value means, or NONE."""
        ranked = self.rank(tokens, repairs)
        if not ranked:
            return NONE
        return {"trade": self._trade, "place": self._place, "person": self._person}[self.kind](text, tokens, repairs, ranked)

    def _trade(self, text, tokens, repairs, ranked) -> int:
        tokens = list(dict.fromkeys(tokens))
        if len(tokens) > 1 and all(len(t) == 1 for t in tokens):
            ids = {e.ref_id for e in self.entries if [t[0] for t in e.tokens] == tokens}
            return ids.pop() if len(ids) == 1 else NONE
        scored = []
        for _, i in ranked:
            e, dot, own, whole = self.entries[i], 0.0, 0.0, True
            for t in tokens:
                fits = repairs.get(t, [])
                mine = max(((s, self.weight[r]) for r, s in fits if r in e.tokens), default=(0.0, 0.0))
                whole = whole and mine[0] >= 0.7
                dot += mine[0] * mine[1] ** 2
                own += (mine[1] or max((self.weight[r] for r, _ in fits), default=self.unknown)) ** 2
            scored.append((-dot / (math.sqrt(own) * self.norm[i]), e.ref_id, whole))
        scored.sort()
        score, ref_id, whole = scored[0]
        if -score >= TRADE_LEAST:
            return ref_id
        alone = whole and not any(w and r != ref_id for _, r, w in scored)
        return ref_id if alone and -score >= TRADE_ALONE else NONE

    def _place(self, text, tokens, repairs, ranked) -> int:
        for _, i in ranked:
            want = set(self.entries[i].tokens)
            got = [{r for r, _ in repairs.get(t, [])} & want for t in tokens]
            if all(got) and set().union(*got) == want and len(tokens) == len(self.entries[i].tokens):
                return self.entries[i].ref_id
        return NONE

    def _person(self, text, tokens, repairs, ranked) -> int:
        name: Name = parse(text)
        fits = []
        for score, i in ranked:
            e = self.entries[i]
            if name.suffix != self.suffixes.get(i, ""):
                continue
            a = agree(tuple(tokens), e.tokens, self.given)
            if a and a.edits <= 3 and a.full + (a.initials > 0) >= 2:
                fits.append((a.full, -a.edits, -a.missing, score, -e.ref_id))
        if not fits:
            return NONE
        best = max(fits)
        return -best[4]

    suffixes: dict[int, str] = {}


#: The score a trade needs, and the one that will do where no other entry has all of its words.
TRADE_LEAST, TRADE_ALONE = 0.7, 0.45


def canonical(df: DataFrame, fields: dict[str, tuple[str, DataFrame, str, str]], key: str = "rec_id", largest: int = 100_000, other_words: dict[str, str] = OTHER_WORDS) -> DataFrame:
    """(rec_id, field_name, ref_id) of every value that says something.

    `fields`: field -> (kind: trade, place or person; reference table; its id; its name).
    """
    rankers: dict[str, tuple[str, list[tuple[int, str]]]] = {}
    for field, (kind, ref, ref_id, ref_name) in fields.items():
        rankers[field] = kind, [(int(r[0]), r[1]) for r in bounded_rows(ref.select(ref_id, ref_name), largest)]
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(rankers)

    stacked = reduce(DataFrame.unionByName, [df.select(key, F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields]).where(filled(F.col("value")))
    values = cut(stacked.groupBy("field_name", "value").agg(F.count("*").alias("_n")))

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for field, value in zip(batch["field_name"], batch["value"]):
                rows.append((field, value, TOKENS[held.value[field][0]](value)))
            yield pd.DataFrame(rows, columns=["field_name", "value", "tokens"])

    pieces = values.mapInPandas(cut_up, "field_name string, value string, tokens array<string>")
    tokens = pieces.select("field_name", F.explode("tokens").alias("token")).distinct()
    vocabulary = spark.createDataFrame(
        [(f, kind, *form) for f, (kind, rows) in rankers.items() for form in forms_of(kind, sorted({t for e in entries_of(kind, rows, other_words) for t in e.tokens}), other_words)],
        "field_name string, kind string, ref string, form string, sure double",
    )

    def token_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, t, k) for f, t in zip(batch["field_name"], batch["token"]) for k in {*deletions(t, depth_of(t)), *deletions(skeleton(t), min(depth_of(t), 1))}]
            yield pd.DataFrame(rows, columns=["field_name", "token", "k"])

    def form_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f, kind, r, form, sure in batch.itertuples(index=False):
                every = {*deletions(form, depth_of(form)), *deletions(skeleton(form), min(depth_of(form), 1))} | (beginnings(form) if kind == "trade" else set())
                rows += [(f, kind, r, form, sure, k) for k in every]
            yield pd.DataFrame(rows, columns=[*batch.columns, "k"])

    @F.pandas_udf("double")
    def likeness(kind: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([max(similar(x, y), shortened(x, y) if k == "trade" else 0.0) for k, x, y in zip(kind, a, b)], dtype="float64")

    # the vocabulary is a few thousand words of checked tables; Spark takes its size into account by itself
    forms = vocabulary.mapInPandas(form_keys, "field_name string, kind string, ref string, form string, sure double, k string")
    met = tokens.mapInPandas(token_keys, "field_name string, token string, k string").join(forms, ["field_name", "k"]).select("field_name", "token", "kind", "ref", "form", "sure").distinct()
    liked = met.withColumn("s", likeness("kind", "token", "form") * F.col("sure")).where("s > 0").groupBy("field_name", "token", "ref").agg(F.max("s").alias("s"))
    repaired = liked.groupBy("field_name", "token").agg(F.collect_list(F.struct("ref", "s")).alias("fits"))
    ready = (
        pieces.select("field_name", "value", F.posexplode_outer("tokens").alias("pos", "token"))
        .join(repaired, ["field_name", "token"], "left")
        .groupBy("field_name", "value")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "token", "fits"))).alias("parts"))
    )

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, Ranker] = {}
        for batch in batches:
            rows = []
            for field, value, parts in zip(batch["field_name"], batch["value"], batch["parts"]):
                if field not in made:
                    kind, refs = held.value[field]
                    made[field] = Ranker(kind, entries_of(kind, refs, other_words))
                    if kind == "person":
                        named = {r: parse(n).suffix for r, n in refs if n}
                        made[field].suffixes = {i: named.get(e.ref_id, "") for i, e in enumerate(made[field].entries)}
                seq = [p["token"] for p in parts if p["token"] is not None]
                fits = {p["token"]: [(x["ref"], x["s"]) for x in p["fits"]] for p in parts if p["token"] is not None and p["fits"] is not None}
                rows.append((field, value, made[field].meant(value, seq, fits)))
            yield pd.DataFrame(rows, columns=["field_name", "value", "ref_id"])

    mapping = ready.mapInPandas(decide, "field_name string, value string, ref_id int")
    return skew_join(stacked, mapping, ["field_name", "value"], values, "left").select(key, "field_name", F.coalesce("ref_id", F.lit(NONE)).alias("ref_id"))
