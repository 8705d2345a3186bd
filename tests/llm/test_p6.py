import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorewright.llm import p6_tokens as P

E = P.encoding(os.path.join(P.TOKENIZER_DIR, P.VOCABULARY))


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab's tr '\n\t12.,!?é中。　￼​"), st.characters(codec="utf-8")), max_size=200), st.sampled_from([1, 2, 5, 16]))
def test_tree_equals_one_pass(text, leaf):
    ids = P.encode_tree(text, E.encode_ordinary, leaf)
    assert ids == E.encode_ordinary(text)
    assert P.decode_tree(ids, E.decode_single_token_bytes).decode("utf-8") == text


def test_long_runs_without_a_cut():
    for text in ("a" * 5000, "中" * 3000, " " * 5000, "x" * 2000 + " " * 2000 + "'s" * 900):
        assert P.encode_tree(text, E.encode_ordinary, 64) == E.encode_ordinary(text)


def test_table(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(P.TOKENIZER_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [None, "", "hola <|endoftext|> mundo", " \n", "palabra " * 3000, "日本語のテキスト。" * 400, "\x07\x1b[0m"]
    df = spark.createDataFrame([(i, x, [1]) for i, x in enumerate(texts)], "doc_id bigint, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in P.encode_texts(df, "doc_id", "text").collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert P.encode_texts(df.where("false"), "doc_id", "text").count() == 0
