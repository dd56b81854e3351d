"""Encoding repair: exact round trips, what belongs to a text, odd inputs."""

import pytest
from helpers import rows

from folhario.llm import mojibake

TEXT = "A ação nº 3 não incluiu honorários; vista à Câmara de Conciliação, após análise técnica.\nOfício do Sr. Élcio às 9h — § 2º, 35 m²."
CLEAN = ["", "plain ascii", TEXT, "AVALIAÇÃO DA MANHÃ: SÃO JOÃO, ÂNGULO DE 30°", "Œuvre complète, tomo II – cf. nota ½", "Über-Gutachten, naïve", "Medição: 35 µm ± 2 µm a 20 °C", "海風丸 نسخة مصدقة", "✅ 👍🏽 ⚠️ 👩‍⚖️", "« parado às 9h »", "acao̧ão", "Custo: € 40,00", "par\xadtida", "Σ dos lançamentos", '"Ångström"']


def read_as(text, *encodings):
    for e in encodings:
        table = {b: c for c, b in mojibake._table(e)[0].items()}
        text = "".join(table[b] for b in text.encode("utf-8"))
    return text


@pytest.mark.parametrize("encodings", [("cp1252",), ("latin-1",), ("mac_roman",), ("cp850",), ("cp1251",), ("cp1252", "cp1252"), ("latin-1", "cp1252"), ("cp1252", "cp1252", "cp1252")])
def test_utf8_round_trips(encodings):
    plain = TEXT.replace("—", "-")
    assert mojibake.repair(read_as(plain, *encodings)) == (plain, True)
    half = plain.split("\n")[0] + "\n" + read_as(plain.split("\n")[1], *encodings)
    assert mojibake.repair(half) == (plain, True)


@pytest.mark.parametrize("wrong", ["mac_roman", "cp850"])
def test_single_byte_round_trips(wrong):
    plain = "A ação não incluiu honorários; vista à Câmara de Conciliação, após análise técnica."
    bad = plain.encode("cp1252").decode(wrong)
    assert mojibake.repair(bad) == (plain, True)
    assert mojibake.repair(f"linha boa: não\n{bad}\noutra") == (f"linha boa: não\n{plain}\noutra", True)


def test_clean_texts_stay():
    for t in CLEAN:
        assert mojibake.repair(t) == (t, False), t
    assert mojibake.repair(None) == (None, False)


def test_lost_characters_are_named_but_kept():
    assert mojibake.repair("presen�a") == ("presen�a", True)


def test_corpus(spark):
    bad = read_as(TEXT, "cp1252")
    data = [(1, bad, "c", 1), (2, None, "c", 1), (3, "", "c", 1), (4, "  ", "c", 1), (5, TEXT, "c", 1), (1, bad, "c", 1), (6, "x" * 300_000 + bad, "c", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, repaired string, garbled int")
    assert rows(mojibake.garbled_rows(df), "doc_id") == [(1,), (1,), (6,)]
    got = mojibake.repair_corpus(df)
    assert got.columns == ["doc_id", "text", "repaired", "garbled"] and got.count() == 7
    by = {r.doc_id: (r.repaired, r.garbled) for r in got.collect()}
    assert by[1] == (TEXT, True) and by[2] == (None, False) and by[6] == ("x" * 300_000 + TEXT, True) and by[5] == (TEXT, False)
    assert mojibake.garbled_rows(df.limit(0)).count() == 0


def test_layers_without_a_bound():
    text = "Ação ímpar é coração, Über-gutachten nº 3"
    bad = text
    for _ in range(9):
        bad = bad.encode("utf-8").decode("latin-1")
        assert mojibake.repair(bad) == (text, True)
