"""Repeated lines of a source against exact counting; removal."""

import random

from helpers import rows
from pyspark.sql import functions as F

from folhario.llm import boilerplate

SCHEMA = "page_id long, cache_id long, header string, footer string, text string, field_name string, _page int"


def corpus(spark, n=200, seed=1):
    r = random.Random(seed)
    recs = []
    for i in range(n):
        u = 1 if i % 3 else 2
        note = f"Pág. {i} de {r.randrange(900)} | Unidade {'A' if u == 1 else 'B'}"
        if i % 10 == 0:
            note = note.replace("Unidade", "Unidode").upper() + "."
        rare = "Aviso que volta só às vezes no diário" if i % 13 == 0 else f"linha própria {'x' * (i % 40)} {chr(97 + i % 26) * 9}"
        body = f"{rare}\n\n{'Visto em' if i % 2 else 'VISTO  EM'} {i % 28 + 1} de março de 20{i % 25:02d}\nfrase de número único {chr(97 + i % 26)}{chr(97 + i // 26)}"
        recs.append((i, u, note if i % 4 else None, "" if i % 5 else None, body, "clash", 3))
    recs += [(900, 1, None, None, None, "x", 1), (901, 77, "Pág. 1 de 2 | Unidade A", None, "x", "x", 1), (902, None, "a", "b", "c", "x", 1)]
    return spark.createDataFrame(recs, SCHEMA), spark.createDataFrame([(1, "u1"), (2, "u2"), (77, None), (1, "u1")], "cache_id long, source string")


def test_repeated_lines(spark):
    pages, sources = corpus(spark)
    got = set(rows(boilerplate.repeated_lines(pages, sources), "page_id", "field_name", "line_no"))
    want = {(i, "header", 1) for i in range(200) if i % 4} | {(i, "text", 3) for i in range(200)}
    assert got == want


def test_removal(spark):
    pages, sources = corpus(spark)
    clean = boilerplate.strip_lines(pages, boilerplate.repeated_lines(pages, sources))
    assert clean.columns == pages.columns
    got = {r.page_id: (r.header, r.footer, r.text, r.field_name) for r in clean.collect()}
    assert len(got) == 203 and got[1][0] == "" and got[4][0] is None and got[1][2].count("\n") == 2 and got[1][3] == "clash"
    assert got[900] == (None, None, None, "x") and got[901][0] == "Pág. 1 de 2 | Unidade A"


def test_share_is_of_pages(spark):
    recs = [(i, 1, None, None, "sempre igual aqui\nsempre igual aqui" if i < 15 else f"outra {chr(97 + i % 26) * 12}{chr(97 + i // 26) * 9}", "", 0) for i in range(100)]
    pages = spark.createDataFrame(recs, SCHEMA)
    src = spark.createDataFrame([(1, "u")], "cache_id long, source string")
    assert len(rows(boilerplate.repeated_lines(pages, src), "page_id")) == 30
    assert rows(boilerplate.repeated_lines(pages.where("page_id <> 3"), src), "page_id") == []


def test_misread_digits(spark):
    same = [("Processo", "Proces5o", "Proce5so", "Proce55o"), ("sistema", "si5tema"), ("dispensa", "dispen5a"), ("farseelo", "far5eelo"), ("não substitui", "não sub5titui"), ("tabelião", "ta8elião"), ("oficial", "ofic1al"), ("criminal", "crim1nal"), ("Ação vara", "Açã0 vara"), ("conosco", "c0nosco"), ("narlaésio", "narlaé5io")]
    df = spark.createDataFrame([(w[0], x) for w in same for x in w], "a string, b string").select("a", "b", boilerplate.line_keys(F.col("a"))[0].alias("k"), boilerplate.line_keys(F.col("b"))[0].alias("l"))
    met = {(r.a, r.b): boilerplate._edits(r.k, r.l) for r in df.collect()}
    assert {k: v for k, v in met.items() if v} == {("oficial", "ofic1al"): 1}
    codes = ["c8afbbbd", "FDB5DDEB", "ee1ebbba", "7b5a7ba2", "x7k5f", "15", "A1B5"]
    got = spark.createDataFrame([(f"conferida em {x}",) for x in codes], "a string").select(boilerplate.line_keys(F.col("a"))[0].alias("k")).distinct()
    assert [r.k for r in got.collect()] == ["cnfrd m #"]


def test_misread_lines_are_found(spark):
    slips = ["Dispen5a a assinatura do si5tema", "Dispensa a a5sinatura do sistema", "DISPEN5A A A5SINATURA DO SISTEMA", "Di5pensa a as5inatura do sistema"]
    recs = [(i, 1, slips[i // 9] if i % 9 == 0 and i < 36 else "Dispensa a assinatura do sistema", None, None, "", 0) for i in range(60)]
    src = spark.createDataFrame([(1, "u")], "cache_id long, source string")
    got = rows(boilerplate.repeated_lines(spark.createDataFrame(recs, SCHEMA), src), "page_id")
    assert got == [(i,) for i in range(60)]


def many_lines(spark):
    """One source, twenty pages, 1,500 lines on every page."""
    letters = "bcdfghjklmnpqrstvwxz"
    word = lambda i, m: "".join(letters[(i // m**j) % m] for j in range(4))
    lines = [f"{word(i * 7919 % 160_000, 20)} {word((i + 3) * 104_729 % 160_000, 20)} {word(i * i % 160_000, 20)}" for i in range(1500)]
    pages = spark.createDataFrame([(p, 1, None, None, "\n".join(lines), "", 0) for p in range(20)], SCHEMA)
    return pages, spark.createDataFrame([(1, "u")], "cache_id long, source string")


def test_no_line_is_lost_to_a_full_sketch(spark):
    pages, sources = many_lines(spark)
    for tracked in (4096, 256):  # enough counters, and so few that the source is counted exactly
        got = boilerplate.repeated_lines(pages, sources, tracked=tracked)
        assert got.count() == 20 * 1500


def test_large_tables_are_joined_not_broadcast(spark):
    pages, sources = corpus(spark)
    got = rows(boilerplate.repeated_lines(pages, sources, small=0, small_lines=0, tracked=16), "page_id", "field_name", "line_no")
    assert got == rows(boilerplate.repeated_lines(pages, sources), "page_id", "field_name", "line_no")


def test_small_steps_do_not_chain(spark):
    import pandas as pd

    keys = ["bcdfghjklmnpqrstvwxz"[i:] + "bcdfghjklmnpqrstvwxz"[:i] for i in (0,)] + ["bcdfghjklmnpqrstvwzz", "bcdfghjklmnpqrsbvwzz", "bcdfghjklmnpbbsbvwzz", "bcbfgbjklmnpbbsbvwzz"]
    heads = boilerplate._clusters(pd.Series([[{"k": k, "n": 100 - i} for i, k in enumerate(keys)]]))[0]
    assert heads == [0, 0, 0, 3, 3]


def test_empty_tables(spark):
    pages, sources = corpus(spark, 3)
    assert boilerplate.repeated_lines(pages.limit(0), sources).count() == 0
    assert boilerplate.repeated_lines(pages, sources.limit(0)).count() == 0
    assert boilerplate.strip_lines(pages, boilerplate.repeated_lines(pages.limit(0), sources)).count() == pages.count()
