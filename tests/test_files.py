"""Loose files: settings in layers, rule files, CSV globs, archives as books, modes, sheets, kept indexes."""

import zipfile

from helpers import rows

from folhario.operators import cascades, quantile, search, store
from folhario.sources import corpus, files


def test_layers(tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1, "deep": {"y": 2, "z": 3}}')
    (tmp_path / "a.env").write_text('# note\nexport FOLHARIO_DEEP__Y=5\nFOLHARIO_NAME="n b"\nOTHER=1\n')
    got = files.layered({"x": 0, "name": None, "deep": {"y": 0, "w": 9}}, str(tmp_path / "a.json"), str(tmp_path / "a.env"), {"FOLHARIO_X": "7", "PATH": "p"})
    assert got == {"x": 7, "name": "n b", "deep": {"y": 5, "z": 3, "w": 9}}
    assert files.layered({"x": 1}, str(tmp_path / "none.json"), None, {}) == {"x": 1}


def test_rule_files(tmp_path):
    text = "# rules\nname: abc\nfields:\n  - field: perito\n    pattern: 'perit[oa] (\\w+)'\n    weight: 0.5\n  - field: cpf\n    on: true\nlist: [1, b, 2.5]\nempty:\nwords:\n- x\n- \"y: z\"\n"
    want = {"name": "abc", "fields": [{"field": "perito", "pattern": "perit[oa] (\\w+)", "weight": 0.5}, {"field": "cpf", "on": True}], "list": [1, "b", 2.5], "empty": None, "words": ["x", "y: z"]}
    assert files.plain_yaml(text) == want
    (tmp_path / "r.yaml").write_text(text)
    got = files.rules(str(tmp_path / "r.yaml"))
    assert {k: v for k, v in got.items() if k != "fields"} == {k: v for k, v in want.items() if k != "fields"}
    assert files.plain_yaml("") is None


def test_csv_glob(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Nome,Valor\n"A ""x"" b",1\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("valor,outro\n2,z\n")
    (tmp_path / "c.csv").write_text("")
    got, failed = files.csv_glob(spark, str(tmp_path / "*.csv"))
    assert sorted((r.nome or "", r.valor, r.outro or "") for r in got.collect()) == [("", "2", "z"), ('A "x" b', "1", "")]
    assert [r.path.rsplit("/", 1)[1] for r in failed.collect()] == ["c.csv"]


def test_archives_as_books(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        for name, body in (("d/um.pdf", "aaa"), ("dois.pdf", "b"), ("vazio.pdf", "")):
            z.writestr(name, body)
    entries = corpus.zip_entries(spark, str(tmp_path)).withColumn("pages", store.F.length("content"))
    assert rows(files.book_of(entries), "title", "start_page", "end_page") == [("dois", 4, 4), ("um", 1, 3)]


def test_documents_and_sheets(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (2, "a", "y")], "doc int, field string, value string")
    store.write_documents(df, str(tmp_path / "docs"), "doc", "field")
    assert rows(spark.read.json(str(tmp_path / "docs")), "doc", "field") == [(1, "a"), (1, "b"), (2, "a")]
    sheets = store.workbook(df, "doc", ["a", "b"])
    assert len(store.write_workbook(sheets, str(tmp_path / "book"))) == 3
    assert rows(sheets["wide"], "doc", "a", "b") == [(1, "x", None), (2, "y", None)]
    assert rows(store.count_report(df, "doc"), "doc", "n") == [(1, 2), (2, 1)]


def test_kept_index(spark, tmp_path):
    df = spark.createDataFrame([(1, "Testemunhas assinaram"), (2, "uma assinatura"), (3, None), (4, "")], "id int, text string")
    path = str(tmp_path / "index")
    search.write_index(search.index(df, "id", "text"), path, parts=8)
    kept = search.read_index(spark, path, ["testemunhas"], parts=8)
    assert rows(search.lookup(kept, "id", ["testemunhas"]), "id") == [(1,)]
    assert kept.count() < 4
    assert rows(search.lookup(search.read_index(spark, path), "id", ["assin*"]), "id") == [(1,), (2,)]
    assert rows(search.scan(df, "id", "text", ["testemunh"], stems=True), "id") == [(1,)]


def test_quantiles(spark):
    import numpy as np

    values = [float(x % 17) ** 1.5 for x in range(101)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 3.0), ("c", None)], "g string, v double")
    got = {r.g: (r.q, r.m, r.z) for r in quantile.quantiles(df, ["g"], "v", {"q": 0.1, "m": 0.5, "z": 0.99}).collect()}
    assert np.allclose(got["a"], np.quantile(values, [0.1, 0.5, 0.99])) and got["b"] == (3.0, 3.0, 3.0) and "c" not in got


def test_learned_and_templates():
    learnt = cascades.learned([("no valor de 12 reais", "12"), ("o valor de 345 reais", "345")], "v")
    assert [s.method for s in learnt] == ["around", "before"] and "\\d+" in learnt[0].pattern
    assert cascades.learned([("x", "y")], "v") == []
    pattern, names = cascades.template_pattern("Em {{dia}} por {{quem}}.")
    assert names == ["dia", "quem"] and __import__("re").search(pattern, "E m 3/4 p or Ana Lima .").groups() == ("3/4", "Ana Lima")
