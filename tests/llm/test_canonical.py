"""Free-entered values to reference entries."""

from helpers import rows

from folhario.llm import canonical


def refs(spark):
    t = spark.createDataFrame([(1, "Médico Psiquiatra"), (2, "Engenheiro Civil"), (3, "Assistente Social"), (4, "Tradutor e Intérprete"), (5, None)], "id int, name string")
    p = spark.createDataFrame([(1, "Brejo da Garoa"), (2, "Barra da Garoa"), (3, "Nossa Senhora do Calumbi")], "id int, name string")
    n = spark.createDataFrame([(1, "Fernanda Gorbinjo do Tornaante"), (2, "Marta Lorvilles Brareestre"), (3, "Antônio Crenompos Criândria Filho")], "id int, name string")
    return t, p, n


CASES = {
    "a": [("MEDICO  PSIQUIATRRA, CPF", 1), ("perito Psiquiatria", 1), ("Eng. Cvil", 2), ("A. Social", 3), ("tradutora\nnos autos", 4), ("Luthier", -1), ("conforme fls.", -1), ("n/d", None), (None, None), (" ", None), ("z" * 5000, -1)],
    "b": [("comarca de bjo. da garroa/ZZ", 1), ("Barra Garoa\n", 2), ("N. Sra. do Calumbi - ZZ", 3), ("Lagoa da Garoa", -1), ("Brejo", -1), ("Garoa", -1), ("?", None)],
    "c": [("NANDA GORBINJO TORNAANTE", 1), ("Tornaante, F. Gorbinjo", 1), ("dr. fernanda do tornaante", 1), ("Maria Lorvilles Brareestre", -1), ("M. Lorvilles Brareestre", 2), ("Antonio Crenompos Criandria", -1), ("Tonho Crenompos Criândria Fº", 3), ("Pedro Outro Nome", -1), ("N/A", None)],
}


def test_cases(spark):
    t, p, n = refs(spark)
    longest = max(map(len, CASES.values()))
    recs = [(i, *[CASES[f][i][0] if i < len(CASES[f]) else None for f in "abc"], "clash", 5) for i in range(longest)]
    df = spark.createDataFrame(recs + [(100 + r[0], *r[1:]) for r in recs], "rec_id long, a string, b string, c string, value string, ref_id int")
    got = canonical.canonical(df, {"a": ("trade", t, "id", "name"), "b": ("place", p, "id", "name"), "c": ("person", n, "id", "name")})
    have = {(r, f): x for r, f, x in rows(got, "rec_id", "field_name", "ref_id")}
    want = {(o + i, f): x for f, cs in CASES.items() for i, (_, x) in enumerate(cs) if x is not None for o in (0, 100)}
    assert have == want


def test_empty_tables(spark):
    t, _, _ = refs(spark)
    empty = spark.createDataFrame([], "rec_id long, a string")
    assert canonical.canonical(empty, {"a": ("trade", t, "id", "name")}).count() == 0
    some = spark.createDataFrame([(1, "x")], "rec_id long, a string")
    assert rows(canonical.canonical(some, {"a": ("trade", t.limit(0), "id", "name")}), "rec_id", "ref_id") == [(1, -1)]


def means(text, names, other_words):
    """What a trade means among `names`, all forms tried."""
    entries = canonical.entries_of("trade", list(enumerate(names)), other_words)
    ranker = canonical.Ranker("trade", entries)
    forms = canonical.forms_of("trade", ranker.where, other_words)
    tokens = canonical.trade_tokens(text)
    fits = {}
    for t in tokens:
        best = {}
        for r, form, sure in forms:
            best[r] = max(best.get(r, 0.0), sure * max(canonical.similar(t, form), canonical.shortened(t, form)))
        fits[t] = [(r, s) for r, s in best.items() if s > 0]
    return ranker.meant(text, tokens, fits)


def test_words_of_a_family_without_a_word_list():
    names = ["Médico Psiquiatra", "Médico Cardiologista", "Engenheiro Agrônomo", "Arquiteto e Urbanista", "Terapeuta Ocupacional", "Historiador da Arte", "Tradutor e Intérprete", "Enfermeiro", "Engenheiro Mecânico", "Administrador"]
    same = [("psiquiatria", 0), ("méd. psiquiatra", 0), ("cardiologia", 1), ("med. cardio", 1), ("engª agrônoma", 2), ("agronomia", 2), ("arquitetura", 3), ("arq.", 3), ("T.O.", 4), ("terapia ocupacional", 4), ("hst. da arte", 5), ("tradução", 6), ("enfermagem", 7), ("eng. mec.", 8), ("adm.", 9), ("médico", -1), ("engenheiro", -1), ("piscicultor", -1), ("t", -1)]
    assert [means(t, names, {}) for t, _ in same] == [i for _, i in same]


def test_other_words_are_optional_and_know_no_entry():
    names = ["Agrimensor", "Médico Oftalmologista"]
    assert means("topógrafo", names, {}) == -1
    assert means("topógrafo", names, canonical.OTHER_WORDS) == 0
    assert means("oculistta", names, canonical.OTHER_WORDS) == 1
    assert means("saúde mental", names, canonical.OTHER_WORDS) == -1


def test_every_ranked_entry_is_checked():
    people = [(i, f"{chr(97 + i % 25)}natolio bord{chr(97 + i // 25)}{chr(97 + i % 25)}lho Salneanha") for i in range(75)] + [(100, "Zulmira Tornaante Salneanha")]
    ranker = canonical.Ranker("person", canonical.entries_of("person", people))
    assert ranker.meant("Z. Salneanha", ["z.", "salneanha"], {"salneanha": [("salneanha", 1.0)]}) == 100
    longer = [canonical.Entry(i, ("garoa", f"lag{chr(97 + i)}", "vale")) for i in range(14)]
    ranker = canonical.Ranker("place", [*longer, canonical.Entry(50, ("garoa", "lagu"))])
    fits = {"garoa": [("garoa", 1.0)], "lago": [*((e.tokens[1], 0.9) for e in longer), ("lagu", 0.5)]}
    assert ranker.meant("garoa lago", ["garoa", "lago"], fits) == 50
