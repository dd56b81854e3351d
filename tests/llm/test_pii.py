"""Personal data: held-out accuracy, exact places, odd inputs, redaction."""

import os
import sys

from helpers import rows

sys.path.insert(0, os.path.dirname(__file__))
import unseen

from folhario.llm import pii, pii_table
from folhario.llm.crf import tokenise, tokenise_batch


def test_held_out_accuracy():
    held = pii_table.labelled(300, seed=901)
    got = pii.items([t for t, _ in held], pii.model())
    want = [{(a, k) for a, _, k in spans} for _, spans in held]
    have = [{(a, k) for a, _, k in g} for g in got]
    hit = sum(len(w & h) for w, h in zip(want, have))
    assert hit / sum(map(len, want)) > 0.96
    assert hit / sum(map(len, have)) > 0.96


def test_sentences_of_other_kinds_and_names_of_other_stocks():
    held = unseen.rows(600)
    got = [{(a, k) for a, _, k in g} for g in pii.items([t for t, _ in held], pii.model())]
    hit = sum(len(w & h) for (_, w), h in zip(held, got))
    assert hit / sum(len(w) for _, w in held) > 0.85
    assert hit / sum(map(len, got)) > 0.9


def test_names_end_where_they_end():
    for text, names in (
        ("Compareceu Wanderley Kowalczyk Brandenburg, morador da Alameda Santos 45, tel. 21 2555-1234.", ["Wanderley Kowalczyk Brandenburg"]),
        ("Paciente: Ingrid Schneider, 45 anos, CPF 123.456.789-00.", ["Ingrid Schneider"]),
        ("Intime-se Maria de Souza Andrade Filho, com morada na Rua Sete, 10.", ["Maria de Souza Andrade Filho"]),
    ):
        found = pii.items([text], pii.model())[0]
        assert [text[a:b] for a, b, k in found if k == "name"] == names, text
    assert pii.trimmed("Enviar para Yasmin Rocha Azevedo, Alameda", 0, 41) == (12, 32)
    assert pii.trimmed("Olá, falo com Kauê Nakamura? Ligue", 0, 34) == (14, 27)
    assert pii.trimmed("SOUZA, Ana Maria", 0, 16) == (0, 16)


def test_long_addresses_of_mail():
    text = f"Contato: {'a' * 150}.silva@{'x' * 90}.exemplo.invalid, fim"
    at = text.index("a" * 150)
    assert pii.checked("email", text, text.index("@") - 3, text.index("@") + 4) == (at, text.index(", fim"))


def test_tokens_partition_a_text():
    text = "  Dr. Á2b\n\n x-9\t."
    tokens, starts, before = tokenise(text)
    assert [text[s : s + len(t)] for t, s in zip(tokens, starts)] == tokens == ["Dr", ".", "Á", "2", "b", "x", "-", "9", "."]
    assert before.tolist() == [2, 0, 1, 0, 0, 2, 0, 0, 1]
    assert tokenise("")[0] == [] and tokenise(" \n ")[0] == []


def test_batches_tokenise_as_single_texts():
    texts = ["  Dr. Á2b\n\n x-9\t.", "", None, " \n ", "um\n  dois", "x", "a  b\n"]
    m = pii.model()
    for t, (types, starts, ends, before) in zip(texts, tokenise_batch(texts, m.numbered)):
        tokens, s, b = tokenise(t or "")
        assert [t[i:j] for i, j in zip(starts, ends)] == tokens
        assert starts.tolist() == s.tolist() and before.tolist() == b.tolist() and types.tolist() == m.lookup(tokens).tolist()


LINE = "Intime-se o Sr. Pedro Torvares Galeume, residente na Rua das Flores, 120, para ciência. CPF 123.456.789-01, telefone (21) 91234-5678 ou pedro@correio.example."


def test_places_and_placeholders(spark):
    cases = [(1, LINE), (1, LINE), (2, None), (3, ""), (4, "  \n "), (5, "CNPJ 12.345.678/0001-99, processo 0001234-11.2020.8.98.0001, ***.111.222-**"), (6, "x" * 200_000 + "\n" + LINE)]
    df = spark.createDataFrame([(k, t, "clash", 9) for k, t in cases], "page_id long, text string, kind string, row_id int")
    got = rows(pii.find_items(df, "page_id", "text", "pages"), "table_name", "row_id", "kind", "start_pos")
    at = lambda s: LINE.index(s) + 1
    want = {("name", at("Pedro")), ("address", at("Rua")), ("cpf", at("123.456")), ("phone", at("(21)")), ("email", at("pedro@"))}
    assert {(k, s) for _, r, k, s in got if r == 1} == want
    assert sum(r == 1 for _, r, _, _ in got) == 2 * len(want), "repeated rows count each"
    assert {(k, s - 200_001) for _, r, k, s in got if r == 6} == want
    assert {r for _, r, _, _ in got} == {1, 6}
    red = {r.page_id: (r.redacted, r.text, r.kind) for r in pii.redact(df.withColumnRenamed("row_id", "redacted")).collect()}
    assert red[1][0] == "Intime-se o Sr. [NOME], residente na [ENDERECO], para ciência. CPF [CPF], telefone [TELEFONE] ou [EMAIL]."
    assert red[1][1:] == (LINE, "clash") and red[2][0] is None and red[3][0] == "" and red[5][0] == cases[5][1]


def test_field_values():
    m = pii.model()
    one = lambda t: [(k, a) for a, _, k in pii.items([t], m)[0]]
    assert one("11885248318") == [("cpf", 0)] and one("642.8O1.159-37") == [("cpf", 0)] and one("NIT: 507.05330.30-4") == [("pis", 5)]
    assert one("64.759.297/0001-49") == [] and one("n/d") == [] and one("a.b arroba postal ponto test") == [("email", 0)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, text string")
    assert pii.find_items(df, "page_id", "text", "pages").count() == 0
    assert pii.redact(df).count() == 0
