"""The term and page-range languages against their plain models."""

from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from folhario.functions import ranges, terms
from pyspark.sql import functions as F

TEXTS = ["", "Ação de Cobrança", "acao", "LAUDO pericial nº 3", "uma linha\noutra linha", "a&b", "x|y", "Perícia Médica"]
PATTERNS = ["", "acao", "AÇÃO", "!Ação", "laudo|ação", "laudo&pericial", "uma linha", '"LAUDO"', "~laudo~", "per?cia*", "linha*outra", "a&b|x", "|", "&", "(", "*"]


def test_terms_match_the_model(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, t string")
    for p in PATTERNS:
        got = dict(rows(df.select("i", terms.matches(F.col("t"), p).alias("m")), "i", "m"))
        assert got == {i: terms.model(t, p) for i, t in enumerate([*TEXTS, None])}, p


def test_terms_say_what_they_mean():
    assert terms.model("Ação", "acao") and not terms.model("Ação", "!acao")
    assert terms.model("x b", "a|b") and not terms.model("x b", "a&b")
    assert not terms.model("A linha", "a linha"), "blanks make a term exact"
    assert terms.model("a&b", "a&b|zz"), "an & inside an | part is literal"


SPECS = ["1-3", "5-2", "z", "r1", "1-z:even", "1-z,x2-4", "0", "99", "abc", "1,1,2", "r3-r1", "1-2-3", "z-1:odd", "x1", "", " 2 , 4 "]


def test_ranges_match_the_model(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 5, 10)], "n int")
    for s in SPECS:
        got = {r.n: r.p for r in df.select("n", ranges.pages(s, F.col("n")).alias("p")).collect()}
        assert got == {n: ranges.model(s, n) for n in (1, 2, 5, 10)}, s


def test_range_cases():
    assert ranges.model("5-2", 10) == [5, 4, 3, 2]
    assert ranges.model("3-z:even", 6) == [4, 6], "by place in the range"
    assert ranges.model("1-z,x2-4", 6) == [1, 5, 6]
    assert ranges.model("r2,z,99,0", 10) == [9, 10]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="0123456789-,zrx: oden", max_size=20), st.integers(1, 30))
def test_ranges_never_leave_the_document(spec, total):
    assert all(1 <= p <= total for p in ranges.model(spec, total))
