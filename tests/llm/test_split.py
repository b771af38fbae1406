"""Problem 2: splitting at natural boundaries, by ranges."""

from __future__ import annotations

import random

import pytest

from tidemark.llm.split import oversized, split_column, split_files

TEXTS = {
    1: "Ein Satz mit Umlauten äöü. " * 300,
    2: "x" * 5000,
    3: "short",
    4: "",
    5: None,
    6: "🙂é " * 3000 + "y" * 2001 + " end",
    7: "a\n\nb\r\n" * 1000,
    8: "w" * 2000,
    9: ("z" * 1950 + " ") * 5,
}


def check(pieces, text, limit, overlap):
    pieces = sorted(pieces, key=lambda p: p.piece_no)
    assert [p.piece_no for p in pieces] == list(range(1, len(pieces) + 1))
    assert all(0 < len(p.piece) <= limit and text[p.piece_start : p.piece_end] == p.piece for p in pieces)
    assert pieces[0].piece_start == 0 and pieces[-1].piece_end == len(text)
    assert all(b.piece_start == a.piece_end - overlap for a, b in zip(pieces, pieces[1:]))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, t, "x") for k, t in TEXTS.items()], "id long, text string, piece string")


@pytest.mark.parametrize("range_bytes", [16_000, 1 << 18])
def test_columns(spark, rows, range_bytes):
    got = {}
    for p in split_column(rows, "id", "text", range_bytes=range_bytes, small=True).collect():
        got.setdefault(int(p.key), []).append(p)
    assert set(got) == {k for k, t in TEXTS.items() if t}
    for k, pieces in got.items():
        check(pieces, TEXTS[k], 2000, 100)
    told = {int(r.key): r for r in oversized(rows, "id", "text", range_bytes=range_bytes).collect()}
    assert {k: (r.chars, r.pieces) for k, r in told.items()} == {k: (len(TEXTS[k]), len(got[k])) for k in (1, 2, 6, 7, 9)}
    assert {k for k, r in told.items() if r.long_run} == {2, 6}
    # pieces of 1,950 unbroken characters fit once the overlap is taken off only by a forced cut
    assert told[9].forced > 0 and not told[9].long_run


def test_natural_boundaries(rows):
    kinds = {p.kind for p in split_column(rows.where("id = 1"), "id", "text").collect()}
    assert kinds == {"sentence", "end"}


def test_repeated_rows_are_split_each_for_itself(spark, rows):
    twice = rows.where("id = 1").unionAll(rows.where("id = 1"))
    pieces = split_column(twice, "id", "text").collect()
    assert len({p.text_no for p in pieces}) == 2
    for no in {p.text_no for p in pieces}:
        check([p for p in pieces if p.text_no == no], TEXTS[1], 2000, 100)


def test_empty_table(rows):
    assert split_column(rows.limit(0), "id", "text", small=True).count() == 0


def test_files_by_ranges(spark, tmp_path):
    rng = random.Random(5)
    texts = {f"{tmp_path}/{i}.txt": "".join(rng.choice(["word ", "é", "漢字", "🙂 ", "\n", "\n\n", "End. ", "q" * 30]) for _ in range(n)) for i, n in enumerate((3, 2_000, 40_000))}
    for path, text in texts.items():
        with open(path, "wb") as f:
            f.write(text.encode())
    files = [(p, len(t.encode())) for p, t in texts.items()]
    got = {}
    for p in split_files(spark, files, range_bytes=20_000).collect():
        got.setdefault(p.key, []).append(p)
    for path, text in texts.items():
        check(got[path], text, 2000, 100)


def test_bounds_are_checked(rows):
    with pytest.raises(ValueError):
        split_column(rows, "id", "text", overlap=1000)
    with pytest.raises(ValueError):
        split_column(rows, "id", "text", range_bytes=100)
