"""Graph, storage, lookups, segments, sources, streaming and scalar functions on small cases."""

import datetime
import json
import random

from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from folhario.functions import layout, text, udfs
from folhario.functions.values import filled, fold
from folhario.operators import compare, extract, lookup, segment, store
from folhario.operators.graph import components
from folhario.sources import corpus
from pyspark.sql import functions as F


def test_components_against_union_find(spark):
    r = random.Random(3)
    edges = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(45)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)] + [("n1", None), ("z", "z")]
    head = {}

    def root(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for a, b in edges:
        if a and b:
            x, y = sorted((root(a), root(b)))
            head[y] = x
    got = dict(rows(components(spark.createDataFrame(edges, "a string, b string")), "node", "component"))
    low = {}
    for n in got:
        low[root(n)] = min(low.get(root(n), n), n)
    assert got == {n: low[root(n)] for n in got}
    star = edges + [("n0", f"s{i}") for i in range(40)]
    assert rows(components(spark.createDataFrame(star, "a string, b string"), hub=5), "node", "component") == rows(components(spark.createDataFrame(star, "a string, b string")), "node", "component")
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_storage(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, v string, p string")
    new = spark.createDataFrame([(2, "B", None), (3, "c", "y"), (3, "C", "z")], "k int, v string, p string")
    assert rows(store.insert_if_absent(old, new, ["k"], F.col("v")), "k", "v") == [(1, "a"), (2, "b"), (3, "C")]
    assert rows(store.upsert(old, new, ["k"], F.col("v")), "k", "v") == [(1, "a"), (2, "B"), (3, "c")]
    assert rows(store.upsert_keeping(old, new.where("v <> 'C'"), ["k"], ["p"]).na.fill("-"), "k", "p") == [(1, "-"), (2, "x"), (3, "y")]
    assert rows(store.remove(old, new, ["k"]), "k") == [(1,)]
    assert rows(store.replace_children(old, new, "k"), "k", "v") == [(1, "a"), (2, "B"), (3, "C"), (3, "c")]


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "x", y'), (2, None)], "k int, v string")
    for kind in ("json", "csv", "xml", "md", "txt", "parquet"):
        assert store.write_format(df, str(tmp_path / kind), kind) == kind
    assert store.write_format(df, str(tmp_path / "odd"), "nonsense") == "json"
    back = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(str(tmp_path / "csv"))
    assert rows(back.where("v is not null"), "v") == [('say "x", y',)]
    assert spark.createDataFrame([("a\x01b\\u0000\\ud83dc",)], "t string").select(store.clean_json_text(F.col("t")).alias("t")).first().t == "abc"


def test_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text('NOME,Perito,cpf\n"a ""b""",,1\n ,x,2\nshort\n')
    got = corpus.catalogue_csv(spark, str(tmp_path / "c.csv"), name=["PERITO", "NOME"], cpf=["CPF", "DOC"])
    assert rows(got.na.fill("-"), "name", "cpf") == [('a "b"', "1"), ("short", "-"), ("x", "2")]
    (tmp_path / "a.json").write_text(json.dumps([{"hash": "h1", "kind": "x"}, {"laudo_hash": "h1", "kind": "y"}]))
    (tmp_path / "l.json").write_text('{"hash": "h1", "kind": "x"}\n{"hash": "h1", "kind": "z"}\n')
    pick = lambda f: rows(corpus.json_records(spark, str(tmp_path / f), ["laudo_hash", "hash"], {"kind": ["kind"]}), "key", "kind")
    assert pick("a.json") == [("h1", "y")] and pick("l.json") == [("h1", "z")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "in" / "b.txt").write_bytes(b"no")
    one = corpus.inbox(spark, str(tmp_path / "in")).collect()
    assert [(r.file_size, r.sha256[:8]) for r in one] == [(6, __import__("hashlib").sha256(b"%PDF-1").hexdigest()[:8])]


def test_archives_and_settings(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.pdf", b"%PDF")
        z.writestr("d/", b"")
        z.writestr("y.txt", b"abc")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    got = rows(corpus.zip_entries(spark, str(tmp_path)).na.fill("-"), "entry", "name", "size")
    assert got == [(0, "-", 0), (1, "x.pdf", 4), (3, "y.txt", 3)]
    assert corpus.settings({"a": 1, "b": {"c": 2, "d": 3}}, None, {"a": None, "b": {"c": 5}}) == {"a": 1, "b": {"c": 5, "d": 3}}


def test_pruning_takes_whole_branches(spark):
    from folhario.operators import tree

    nodes = spark.createDataFrame([("k", "0", True), ("k", "0.0", False), ("k", "0.0.1", True), ("k", "0.1", True), ("k", "10", None)], "key string, node_id string, ok boolean")
    assert rows(tree.prune(nodes, F.col("ok")), "node_id") == [("0",), ("0.1",)]


def test_nearest_against_brute_force(spark):
    r = random.Random(4)
    entries = [(g, float(r.randrange(100)), i) for i in range(40) for g in [r.choice("ab")]]
    amounts = [(i, r.choice("abc"), float(r.randrange(-5, 110))) for i in range(200)] + [(900, "a", None), (901, None, 5.0)]
    rws = spark.createDataFrame(amounts, "id int, g string, x double")
    tab = spark.createDataFrame(entries, "g string, v double, k int")
    got = {i: k for i, k in rows(lookup.nearest(rws, tab, "g", "x", "v", "k", 0.2).na.fill(-1, ["matched"]), "id", "matched")}
    want = {}
    for i, g, x in amounts:
        c = [(abs(v - x), k) for h, v, k in entries if h == g] if x is not None else []
        want[i] = min(c)[1] if c and x and min(c)[0] / abs(x) <= 0.2 else -1
    tied = {i for i, g, x in amounts if x is not None and len({k for h, v, k in entries if h == g and abs(v - x) == min([abs(w - x) for hh, w, _ in entries if hh == g], default=None)}) > 1}
    assert {i: k for i, k in got.items() if i not in tied} == {i: k for i, k in want.items() if i not in tied}
    assert len(got) == len(amounts)


def test_prioritised_lookup_never_multiplies(spark):
    rws = spark.createDataFrame([(1, "c1", "n1"), (2, None, "n2"), (3, "zz", "zz"), (4, None, None)], "id int, cpf string, name string")
    cat = spark.createDataFrame([(7, "c1", "q"), (5, "c1", "n2"), (6, None, None)], "pid int, cpf string, name string")
    got = lookup.prioritised(rws, cat, [("cpf", 0.9), ("name", 0.75)], "pid", "pid").na.fill(-1)
    assert rows(got, "id", "pid", "confidence") == [(1, 5, 0.9), (2, 5, 0.75), (3, -1, -1.0), (4, -1, -1.0)]


def test_boundaries(spark):
    flags = [(1, 1, 0, 0), (1, 2, 1, 1), (1, 3, 0, 0), (1, 4, 0, 1), (1, 5, 0, 0), (1, 6, 1, 0), (1, 7, 0, 0)]
    df = spark.createDataFrame(flags, "doc int, page int, s int, e int")
    got = segment.boundaries(df, F.col("s") == 1, F.col("e") == 1)
    assert rows(got, "start_page", "end_page") == [(2, 4), (6, 7)]
    last = spark.createDataFrame([(1, 9)], "doc int, last_page int")
    assert rows(segment.close_gaps(got, last), "start_page", "end_page") == [(2, 5), (6, 9)]


def test_scores_run_on_whole_documents(spark):
    df = spark.createDataFrame([(1, p, "PODER JUDICIÁRIO\nDESPACHO\nfim, dou fé", w, ["A"]) for p, w in enumerate((10, 400, 50), 1)], "doc int, page int, text string, words int, fonts array<string>")
    got = segment.score_pages(df).orderBy("page").collect()
    assert [r.density for r in got] == [0.0, 39.0, 0.8] and all(r.end_score > 0.3 for r in got)


def test_compare(spark):
    old = spark.createDataFrame([(1, 1, "a B c")], "doc int, page int, text string")
    new = spark.createDataFrame([(1, 1, "A b d"), (1, 2, "a")], "doc int, page int, text string")
    got = compare.added(compare.page_words(old), compare.page_words(new), "word", ("doc", "page"))
    assert rows(got, "page", "word") == [(1, "d"), (2, "a")]


def test_fields_and_evidence(spark):
    df = spark.createDataFrame([(1, 2, "autos nº 0000001-11.2020.8.98.0001, honorários em R$ 1.234,56"), (1, 1, "CPF 111.222.333-44"), (2, 1, None)], "doc int, page int, text string")
    got = {f: (v, m) for f, v, m in rows(extract.fields(extract.candidates(df)), "field", "value", "method")}
    assert got == {"processo_judicial": ("0000001-11.2020.8.98.0001", "label"), "valor_arbitrado": ("1.234,56", "fee"), "cpf_perito": ("111.222.333-44", "label")}
    w = spark.createDataFrame([(1, 1, i, x, float(i), 0.0, i + 1.0, 1.0) for i, x in enumerate("o Perito João da Silva disse".split())], "doc int, page int, ord int, word string, x0 double, y0 double, x1 double, y1 double")
    assert rows(extract.evidence_box(w, "joão da silva"), "x0", "x1") == [(2.0, 5.0)]
    a = spark.createDataFrame([(1, "f", "x", "m", 0.7), (1, "g", "y", "m", 0.5)], "doc int, field string, value string, method string, confidence double")
    b = spark.createDataFrame([(1, "f", "X", "n", 0.7), (1, "g", "Y", "n", 0.6), (1, "h", "Z", "n", 0.1)], "doc int, field string, value string, method string, confidence double")
    assert rows(extract.prefer(a, b), "field", "value") == [("f", "x"), ("g", "Y"), ("h", "Z")]


def test_values(spark):
    df = spark.createDataFrame([("N/A",), ("  ",), (None,), ("Não Informado.",), ("x",), ("--",), ("0",)], "v string")
    assert [r.f for r in df.select(filled(F.col("v")).alias("f")).collect()] == [False, False, False, False, True, False, True]
    assert spark.createDataFrame([("É  só—1º",)], "v string").select(fold(F.col("v")).alias("f")).first().f == "e so 1º"


def test_dates_and_money(spark):
    d = datetime.date
    cases = {"1/2/24": d(2024, 2, 1), "31/02/2024": None, "05.11.2023": d(2023, 11, 5), "em 7 de março de 2022, ": d(2022, 3, 7), "7 de marco de 2022": d(2022, 3, 7), "2020-01-09T1": d(2020, 1, 9), "x": None, None: None, "3 de foo de 2020": None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, d date")
    assert df.where(~text.parse_date(F.col("t")).eqNullSafe(F.col("d"))).collect() == []
    m = spark.createDataFrame([("R$ 1.234,56", 1234.56), ("12", 12.0), ("1.2.3", None), ("", None), (None, None), ("-3,5", -3.5)], "t string, v double")
    assert m.where(~text.parse_money(F.col("t")).cast("double").eqNullSafe(F.col("v"))).collect() == []
    assert m.select(text.format_money(F.lit(1234567.5)).alias("f")).first().f == "R$ 1.234.567,50"


def test_layout_and_text(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("c")).first().c
    assert get(layout.paper_size(F.lit(596.0), F.lit(841.0))) == "A4"
    assert get(layout.page_kind(F.lit(50), F.lit(1))) == "ScannedImage"
    assert get(text.collapse_doubled(F.lit("aabbcc"))) == "abc" and get(text.collapse_doubled(F.lit("abcd"))) == "abcd"
    assert get(text.collapse_spaced(F.lit("D E S P A C H O de 1 2 e a B c"))) == "DESPACHO de 12eaBc"
    assert get(text.highlight(F.lit("O Laudo, laudos e LAUDO"), "laudo")) == "O __Laudo__, laudos e __LAUDO__"
    assert get(text.bottom_lines(F.lit("a\nb"), 5)) == "a\nb"
    assert get(layout.signed_by(F.lit("x" * 90 + " Assinado por Ana"), "Bia|Ana"))
    assert not get(layout.signed_by(F.lit(None).cast("string"), "Ana"))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12))
def test_lcs_against_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert udfs.lcs_length(a, b) == t[-1][-1]


def test_fuzzy_places_and_objects(spark):
    assert udfs.locate("xx documento assinodo", "documento assinado", 1) >= 2
    assert udfs.locate("nada", "documento", 2) == -1
    assert udfs.balanced_object('log {"a": "}", "b": {}} tail') == '{"a": "}", "b": {}}'
    assert udfs.balanced_object("none") is None and udfs.balanced_object("{") is None
    w = spark.createDataFrame([(1, 1, y, 0.0, i) for i, y in enumerate((100.0, 97.0, 94.0, 50.0))], "doc int, page int, y0 double, x0 double, ord int")
    assert rows(udfs.anchored_lines(w, 5.0), "ord", "line") == [(0, 0), (1, 0), (2, 1), (3, 2)]
    assert rows(udfs.anchored_lines(w, 5.0, mean=True), "ord", "line") == [(0, 0), (1, 0), (2, 0), (3, 1)]


def test_streaming_inbox(spark, tmp_path):
    from folhario.streaming.inbox import first_wins, latest_wins

    src = tmp_path / "src"
    src.mkdir()
    schema = "process_number string, source string, created_at timestamp, raw_json string"

    def drop(name, *recs):
        (src / name).write_text("\n".join(json.dumps(dict(zip(("process_number", "source", "created_at", "raw_json"), r))) for r in recs))

    drop("a.json", ("1", "s", "2024-01-01T00:00:00", "x"), ("1", "s", "2024-01-01T00:01:00", "y"), ("2", "s", "2024-01-01T00:00:00", "z"))
    stream = lambda: spark.readStream.schema(schema).json(str(src))
    for name, start in (("first", first_wins), ("latest", latest_wins)):
        q = start(stream(), str(tmp_path / name), str(tmp_path / f"{name}_cp"))
        q.processAllAvailable()
        q.stop()
    drop("b.json", ("1", "s", "2024-01-02T00:00:00", "late"))
    for name, start in (("first", first_wins), ("latest", latest_wins)):
        q = start(stream(), str(tmp_path / name), str(tmp_path / f"{name}_cp"))
        q.processAllAvailable()
        q.stop()
    from folhario.streaming.inbox import read_latest

    assert rows(spark.read.parquet(str(tmp_path / "first")), "process_number", "raw_json") == [("1", "x"), ("2", "z")]
    assert rows(read_latest(spark, str(tmp_path / "latest")), "process_number", "raw_json") == [("1", "late"), ("2", "z")]


def test_skew_join(spark):
    from pyspark.sql import functions as F

    from folhario.runtime import skew_join

    data = [(i, "hot" if i % 3 else f"k{i % 7}") for i in range(300)] + [(900, None), (901, "none")]
    left = spark.createDataFrame(data, "id int, k string").repartition(3)
    facts = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(7)], (None, 9)], "k string, v int")
    counts = left.where("k is not null").groupBy("k").agg(F.count("*").alias("_n"))
    for how in ("inner", "left"):
        want = rows(left.join(facts, "k", how), "id", "v")
        assert rows(skew_join(left, facts, ["k"], counts, how, floor=10, share=4), "id", "v") == want
        assert rows(skew_join(left, facts, ["k"], counts.limit(0), how), "id", "v") == want
