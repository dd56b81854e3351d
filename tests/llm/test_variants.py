"""Name variants: parsing, the trie, links against all-pairs comparison on a small fixture."""

import random

from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from folhario.llm import variants
from folhario.llm.names import agree, osa, parse, spelled

PEOPLE = {
    "p1": ["Fernanda Gorbinjo do Tornaante", "NANDA GORBINJO TORNAANTE", "Tornaante Gorbinjo, Fernanda", "F. Gorbinjo do Tornaante", "Dra. Fernanda Gorbimjo Tornaante", "fernanda  gorbinjo d0 tornaante "],
    "p2": ["Fernanda Gorbinjo do Tornaante Filho", "Fernanda Gorbinjo Tornaante Fº"],
    "p3": ["Marta Cláudio Lorvilles Brareestre", "Marta Lorvilles Brareestre", "MARTA C. LORVILLES BRAREESTRE", "Brareestre, Marta Cláudio Lorvilles", "Marta Lorvlles Braerestre"],
    "p4": ["Maria Lorvilles Brareestre"],
    "o1": ["Seguradora Tormaorval S/A", "SEGURADORA TORMAORVAL", "Tormaorval Seguradora", "Seg. Tormaorval S.A.", "Seguradora Tormaorvall"],
    "o2": ["Seguradora Tordiorval S/A", "SEGURADORA TORDIORVAL", "Tordiorval Seguradora", "Seg. Tordiorval S.A."],
    "o3": ["IPVLORA - Instituto de Previdência do Vale de Lorlaelo", "IPVLORA", "Inst. de Previdência do Vale de Lorlaelo", "Instituto de Previdência do Vale dee Lorlaelo"],
}


def test_links_and_pairs(spark):
    names = [(n, "clash", None) for group in PEOPLE.values() for n in group]
    more = [("Sônia Outra Pessoa", "x", "Teresa Outra Pessoa"), (None, "x", "n/d"), ("  ", "x", "Abel"), ("Sônia Outra Pessoa", "x", None)]
    df = spark.createDataFrame(names + more, "a string, entity string, b string")
    ent = variants.entities(df, ["a", "b"])
    by = {}
    for n, e in rows(ent, "name", "entity"):
        by.setdefault(e, set()).add(n)
    sets = {frozenset(v) for v in by.values()}
    for key, group in PEOPLE.items():
        assert frozenset(group) in sets, key
    got = set(rows(variants.pairs(ent), "name_a", "name_b"))
    want = {(a, b) for g in PEOPLE.values() for a in g for b in g if a < b}
    assert got == want


def test_ambiguous_short_forms_stay_alone(spark):
    names = ["Júlia Silbatto Dramaado", "Júlia Melmantela Dramaado", "Júlia Dramaado", "Júlia S. Dramaado"]
    df = spark.createDataFrame([(n,) for n in names], "a string")
    got = rows(variants.pairs(variants.entities(df, ["a"])), "name_a", "name_b")
    assert got == [("Júlia S. Dramaado", "Júlia Silbatto Dramaado")]


def test_split_shards_lose_no_full_name(spark):
    r = random.Random(2)
    firsts = ["Pedro", "Marta", "Celso", "Irene"]
    names = [f"{r.choice(firsts)} {m} Salneanha" for m in ("Bordilho", "Cordilho", "Vanempos", "Trelaffa", "Gribazes", "Dornembra")] * 2
    names += [n.upper() for n in names] + [n.replace("lneanha", "lneamha") for n in names]
    df = spark.createDataFrame([(n,) for n in names], "a string")
    base = rows(variants.pairs(variants.entities(df, ["a"])), "name_a", "name_b")
    assert rows(variants.pairs(variants.entities(df, ["a"], largest=3)), "name_a", "name_b") == base


def test_large_shards_lose_no_link(spark):
    names = ["Joaquim Perandrilho Salneanha", "JOAQUIM PERANDRILHO SALNEANHA", "J. P. Salneanha", "Quim Salneanha", "Joquim Salneanha", "J. Perandrilho Salneanha"]
    names += ["Marta Bordilho Salneanha", "Marta Cordambe Salneanha", "Marta Salneanha", "M. Salneanha", "M. C. Salneanha", "Martha Bordlho Salneanha", "Irene Salneanha", "Irenne Salneanha", "IRENE SALNEANHA"]
    names += ["Seguradora Tormao S/A", "Seg. Tormao", "Seguradora Torxmao", "SEGURADORA TORMAO", "Viação Gulpe", "Viação Gudpe", "VIACAO GULPE", "Viac. Gulpe Ltda"]
    df = spark.createDataFrame([(n,) for n in names], "a string")
    want = rows(variants.pairs(variants.entities(df, ["a"])), "name_a", "name_b")
    linked = {n for p in want for n in p}
    assert {"J. P. Salneanha", "Quim Salneanha", "Joquim Salneanha", "Irenne Salneanha"} <= linked and not {"Marta Salneanha", "M. Salneanha"} & linked
    for largest in (1, 3):
        assert rows(variants.pairs(variants.entities(df, ["a"], largest=largest)), "name_a", "name_b") == want


def test_empty(spark):
    df = spark.createDataFrame([], "a string")
    assert variants.pairs(variants.entities(df, ["a"])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=6), max_size=20), st.text(alphabet="abc", min_size=1, max_size=6), st.integers(0, 2))
def test_trie_against_all_words(words, wanted, most):
    trie = variants.Trie()
    for w in words:
        trie.add(w)
    assert sorted(trie.near(wanted, most)) == sorted({w for w in words if osa(w, wanted, most) <= most})


def test_parts_of_names():
    assert parse("MARNIADO VATOSSARA, CÍCERO").tokens == ("cicero", "vatossara", "marniado")
    assert parse("Sr(a). E. N0rrenque do Vale Jr.").tokens == ("e.", "norrenque", "vale") and parse("X. Y Jr.").kind == ""
    assert parse("Paula Otília Zamvempos Júnior").suffix == "junior"
    assert parse("Hosp. e Mat. Ralvaigo Ltda.")[:2] == ("org", ("ralvaigo",))
    assert parse("  ").kind == parse(None).kind == ""
    assert spelled("gorbinjo", "gorbimjo") == 1 and spelled("rosa", "rita") is None
    assert agree(("ana", "dorvalho"), ("ana", "lima", "dorvalho"), frozenset()).missing == 1
    assert agree(("marta", "x"), ("maria", "x"), frozenset({"marta", "maria"})) is None


def test_names_put_in_order_with_many_given_names():
    import random
    import time

    r = random.Random(4)
    given = frozenset("".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(4)) for _ in range(20_000)) | {"marta"}
    turned = variants.Turner(given)
    assert turned(["souza", "lima", "marta"]) == ["marta", "lima", "souza"]
    assert turned(["zwxqwz", "marta", "lima"]) == ["marta", "lima", "zwxqwz"]
    assert turned(["martha", "marta", "lima"]) == ["martha", "marta", "lima"], "a given name misspelled stays first"
    assert turned(["marta", "lima"]) == ["marta", "lima"] and turned(["m.", "marta", "lima"]) == ["m.", "marta", "lima"] and turned([]) == []
    began = time.time()
    for i in range(300):
        turned([f"xyzw{i}", "marta", "lima"])
    assert time.time() - began < 10
