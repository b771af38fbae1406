"""Problem 8: leaks, against tiling and counting by brute force."""

from __future__ import annotations

import random

import pytest

from tidemark.llm import leak
from tidemark.llm.leak import Items, leaks, tile, words

ITEM = "Which call lists the open invitations of a space and what does it return when the space has none at all"
DOCS = [
    (1, f"Intro. {ITEM}. End."),
    (2, "which CALL lists,​the open invitations of a space & what does it return when"),
    (3, "what does it return when the space has none at all. Which call lists the open invitations of a space and"),
    (4, "Whіch саll lists thе open invitations of a space аnd what does it return"),
    (5, "Which call lists the open"),
    (6, "Nothing of it."),
    (7, None),
    (8, ""),
    (9, f"Intro. {ITEM}. End."),
]


def naive(a, b, least):
    """Greedy tiling by looking at all pairs of places each time."""
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                    n += 1
                if n >= least and (best is None or (-n, i, j) < best):
                    best = (-n, i, j)
        if best is None:
            return out
        n, i, j = -best[0], best[1], best[2]
        out.append((i, j, n))
        fa[i : i + n] = [False] * n
        fb[j : j + n] = [False] * n


def test_tiles_are_those_of_the_plain_algorithm():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.randint(1, 3) for _ in range(rng.randint(0, 14))] for _ in "ab")
        assert tile(a, b, 2) == naive(a, b, 2)


def test_stretches_hold_all_tiles():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(9)]
    for _ in range(300):
        item, doc = (" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, n))) for n in (20, 60))
        one, ids = Items([(1, item)], 3), {}
        number = lambda t: [ids.setdefault(w, len(ids) + 1) for w in words(t)]
        tiles = tile(number(item), number(doc), 3)
        want = [(0, 1, max(n for *_, n in tiles), len(tiles), sum(n for *_, n in tiles), len(words(item)))] if tiles else []
        assert [leak._report(0, found, 1, one.ids[1], 3) for _, found in one.matches(doc)] == want


@pytest.mark.parametrize("most", [32_000_000, 0])
def test_both_ways_of_joining(spark, most):
    docs = spark.createDataFrame([(k, t, "x") for k, t in DOCS], "doc_id long, text string, seed string")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    got = {(r["doc"], r["item"]): r for r in leaks(docs, "doc_id", "text", items, "item_id", "text", most_item_chars=most).collect()}
    n = len(words(ITEM))
    assert {k: r.longest for k, r in got.items()} == {(1, 1): n, (2, 1): 9, (3, 1): 11, (4, 1): 14, (5, 1): 5, (9, 1): n}
    assert got[3, 1].coverage == 1.0 and got[3, 1].tiles == 2
    assert got[1, 1].covered == n


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert leaks(docs, "doc_id", "text", docs.limit(0), "doc_id", "text").count() == 0
    assert leaks(docs.limit(0), "doc_id", "text", docs, "doc_id", "text").count() == 0
