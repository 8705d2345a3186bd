import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorewright.llm import p2_split as P


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=300), st.data())
def test_range_max_is_the_rightmost_strongest(values, data):
    index = P.RangeMax(np.array(values, dtype=np.int64), 10, 64)
    lo = data.draw(st.integers(0, len(values) - 1))
    hi = data.draw(st.integers(lo, min(len(values) - 1, lo + 60)))
    best = max(values[lo : hi + 1])
    assert index.strongest(lo + 10, hi + 10) == 10 + max(i for i in range(lo, hi + 1) if values[i] == best)


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="ab .,!?\n\r。、é́👍🏽​", max_size=600), st.sampled_from([(20, 3), (50, 0), (30, 14)]))
def test_pieces_give_the_text_back(text, size):
    limit, overlap = size
    cuts = P.cut_points(text, limit, overlap)
    pieces = [text[a:b] for a, b in cuts]
    assert all(0 < len(p) <= limit for p in pieces)
    assert "".join([pieces[0], *(p[overlap:] for p in pieces[1:])] if pieces else []) == text
    assert all(b0 - a1 == overlap for (_, b0), (a1, _) in zip(cuts, cuts[1:]))


def test_cuts_are_those_of_a_plain_scan():
    random.seed(1)
    text = " ".join(random.choice(["uno", "dos,", "tres.", "cuatro\n", "cinco\n\n"]) for _ in range(3000))
    values, at, plain = P.strengths(text), 0, []
    while len(text) - at > 100:
        window = range(at + 50, at + 101)
        best = max(values[i] for i in window)
        plain.append((at, max(i for i in window if values[i] == best)))
        at = plain[-1][1] - 10
    assert P.cut_points(text, 100, 10) == [*plain, (at, len(text))]


def test_natural_boundaries_and_bad_overlap():
    text = "a" * 30 + ".\n\n" + "b" * 10 + ". " + "c" * 40
    assert text[: P.cut_points(text, 50, 5)[0][1]].endswith("\n\n")
    with pytest.raises(ValueError):
        P.cut_points(text, 10, 5)


def test_table(spark):
    rows = [(1, "x" * 401, "k"), (2, "x" * 400, "k"), (3, "", "k"), (4, None, "k"), (5, "palabra " * 4000, "k"), (6, "é" * 401, "k")]
    df = spark.createDataFrame(rows, "row_id bigint, text string, piece string")
    out = P.split_texts(df, "row_id", "text", 400, 40).collect()
    by = {i: sorted((r for r in out if r["row_id"] == i), key=lambda r: r["piece_no"]) for i, *_ in rows}
    assert [len(by[i]) for i in (1, 2, 3, 4, 6)] == [2, 1, 0, 0, 2]
    for i, text, _ in rows:
        if text:
            p = [r["piece"] for r in by[i]]
            assert p[0] + "".join(x[40:] for x in p[1:]) == text and by[i][0]["n_pieces"] == len(p)
    assert P.split_texts(df.where("false"), "row_id", "text", 400, 40).count() == 0
