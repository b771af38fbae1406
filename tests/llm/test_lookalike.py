"""Problem 10: one form for texts that look the same."""

from __future__ import annotations

import pytest

from tidemark.llm.lookalike import consistent, lookalike_classes, lookalike_pairs

SAME = [
    ("ＧＥＴ ／ｘ", "GET /x"),
    ("café", "café"),
    ("a​b­c", "abc"),
    ("a b c", "a b c"),
    ("Сreate а space", "Create a space"),
    ("ΑΒΕ list", "ABE list"),
    ("ﬁle", "file"),
    ("Ⅳ", "IV"),
    ("𝙶𝙴𝚃 𝖺", "GET a"),
    ("ꓮꓐ ᎪᏴ", "AB AB"),
    ("ёлка", "ёлка"),
    ("Вот сор", "Bот cop"),
    ("ρath νalue", "path value"),
]
DIFFERENT = ["a b", "ab", "A b", "a  b", "a\tb", "a\nb", "á b", "a. b", "a b.", "1 b", "l b", "𝐚 b", "ø b", "ß b", "ss b", "x² b", "x2 b", "½ b", "1/2 b", "№ b", "No b", "ж b", "λ b", "т b", "в b", "m b", "н b"]


@pytest.mark.parametrize("one,two", SAME)
def test_same_look(one, two):
    assert consistent(one) == consistent(two)


def test_different_looks_stay_different():
    assert len({consistent(t) for t in DIFFERENT}) == len(DIFFERENT)


def test_form_is_its_own_form():
    for t in [x for pair in SAME for x in pair] + DIFFERENT:
        assert consistent(consistent(t)) == consistent(t)
    assert consistent(None) is None and consistent("") == ""


def test_pairs_and_classes(spark):
    texts = ["café", "café", "café", "ｃafé", "other", "other", None, "", "Other"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, form string")
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if texts[a] != texts[b] and texts[a] is not None and texts[b] is not None and consistent(texts[a]) == consistent(texts[b])}
    got = lookalike_pairs(df, "id", "text").collect()
    assert len(got) == len(want) == 5 and set(map(tuple, got)) == want
    assert {tuple(r) for r in lookalike_classes(df, "id", "text").collect()} == {(0, 0, 0), (1, 0, 1), (2, 0, 0), (3, 0, 3)}
    assert lookalike_pairs(df.limit(0), "id", "text").count() == 0


def test_many_copies_of_one_spelling_cost_no_pairs_of_copies(spark):
    n = 20_000
    df = spark.range(n).selectExpr("id", "'aé' AS text").union(spark.sql(f"SELECT {n}L AS id, 'aé' AS text"))
    assert lookalike_pairs(df, "id", "text").count() == n
