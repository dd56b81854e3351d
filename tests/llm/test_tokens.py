"""Token ids: another library's ids, exact round trips, splitting of long texts."""

import os

import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from folhario.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.RANKS), reason="needs the rank file")

TEXTS = ["", None, " ", "\n\n  \t", "Ação nº 3: 'tis   d'água\r\n\n", "海風丸 👩‍⚖️ <|endoftext|> \x00", "a" * 30_000, "palavra " * 20_000, " " * 5000 + "x", "é" * 100]


def test_corpus_and_round_trip(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, "", "x")], "doc_id long, text string, ids string")
    got = tokens.encode_corpus(df)
    assert got.columns == ["doc_id", "ids"] and got.count() == len(TEXTS) + 1
    ids = {r.doc_id: r.ids for r in got.collect()}
    assert ids[0] == [] and ids[1] == []
    back = dict(rows(tokens.decode_corpus(got.where("doc_id > 0")), "doc_id", "text"))
    assert back == {i: t or "" for i, t in enumerate(TEXTS) if i}


def test_the_other_library_agrees():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.RANKS.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    for x in TEXTS:
        if x:
            assert tokens.encode(x) == t.encode(x, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1.'s \n\té海"), max_size=80), st.integers(1, 9))
def test_splitting_changes_nothing(text, size):
    assert "".join(tokens.safe_chunks(text, size)) == text
    assert tokens.encode(text, chunk=size) == tokens.encode(text)


def test_empty_table(spark):
    assert tokens.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0
