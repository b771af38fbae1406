"""Problem 5: markup residue."""

from __future__ import annotations

from tidemark.llm.markup import clean
from tidemark.llm.queries import QUERIES

ROWS = [
    (1, "<p>Kept from an <b>earlier</b> edition.</p>", "The limit holds while a < b and c > d."),
    (2, None, "## Limits\n\n- one\n- two\n\n```\nGET /x\n```"),
    (3, "Paths such as {owner} or *.md are matched as text.", "\\section{Limits} The value follows $x^2$."),
    (4, "", "See [[Guide|the guide]] of '''sites'''."),
]
FOUND = {(1, "description"), (2, "text"), (3, "text"), (4, "text")}


def test_p5(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_pos bigint, description string, text string").write.parquet(f"{tmp_path}/raw_documents.parquet")
    found = QUERIES["p5_found"](spark, str(tmp_path))
    assert found.columns == ["doc_pos", "field"]
    assert sorted(map(tuple, found.collect())) == sorted(FOUND)
    clean = {(r.doc_pos, r.field): r.clean for r in QUERIES["p5_clean"](spark, str(tmp_path)).collect()}
    assert len(clean) == 2 * len(ROWS)
    assert clean[1, "description"] == "Kept from an earlier edition."
    assert clean[2, "text"] == "Limits\n\n• one\n• two\n\n    GET /x"
    assert clean[4, "text"] == "See the guide of sites."
    kept = {(k, f): v for k, *values in ROWS for f, v in zip(("description", "text"), values) if (k, f) not in FOUND}
    assert {k: clean[k] for k in kept} == kept


def test_long_inline_formulas():
    """Inline formulas of more than 300 characters stayed as they were."""
    body = " + ".join(f"x_{{{i}}}" for i in range(80))
    for text in (f"The value follows ${body}$ here.", f"The value follows \\({body}\\) here."):
        assert clean(text)[0] == f"The value follows {body} here."
    plain = "Plan prices start at $5 " + "and go on " * 50 + "and end at $40 per seat."
    assert clean(plain) == (plain, [{"kind": "text", "text": plain, "depth": 0}], {})


def test_structure_is_kept():
    assert clean("<ul><li>one</li><li>two<ul><li>in</li></ul></li></ul>")[0] == "• one\n• two\n  • in"
    assert clean("- a\n  - b\n    - c")[0] == "• a\n  • b\n    • c"
    assert clean("* x\n** y")[0] == "• x\n  • y"
    assert clean("<table><tr><td>a</td><td>b</td></tr><tr><th>c</th><td>d</td></tr></table>")[0] == "a\tb\nc\td"
    done, blocks, _ = clean("Text \\section{Intro} more text")
    assert done == "Text\n\nIntro\n\nmore text" and [b["kind"] for b in blocks] == ["text", "heading", "text"]
    assert clean("A <h2>Part</h2> b")[0] == "A\n\nPart\n\nb"


def test_nesting_of_any_depth():
    commands = "textbf textit emph underline textsc texttt textbf textit".split()
    assert clean("".join(f"\\{c}{{" for c in commands) + "x" + "}" * len(commands) + " y")[0] == "x y"
    assert clean("<b>" * 50 + "deep" + "</b>" * 50 + " text")[0] == "deep text"
    assert clean("<o:p>x</o:p> and <custom-el a=\"1\">y</custom-el>")[0] == "x and y"


def test_blocks_of_markup_fall_and_text_stays():
    bar = "".join(f"<a href='/some/long/path/{i}'>Go{i}</a>\n" for i in range(5))
    assert clean(bar + "\nA paragraph that says something.\n")[0] == "A paragraph that says something."
    assert clean("<b>One</b>\n\n**two**\n\n[three](http://x.example/a/long/path/to/it)")[0] == "One\n\ntwo\n\nthree"


def test_private_characters_stay():
    assert clean(" keep  *it* ")[0] == " keep  it "


def test_plain_signs_stay():
    for text in ["a < b and c > d", "It costs $5 or $6.", "/x/{owner}/y", "See #42 and *.md", "items[0]", "snake_case_name", "^a.*b$", '{"a": [1, 2], "b": null}', "<your-token> goes here", "", "  ", "x * y * z"]:
        assert clean(text)[0] == text and clean(text)[2] == {}


def test_empty_table_and_nulls(spark):
    from tidemark.llm.markup import clean_markup

    rows = spark.createDataFrame([(1, None, "x"), (None, "*a*", "y")], "id long, value string, clean string")
    got = {(r.key, r.clean, r.pieces) for r in clean_markup(rows, "id", ["value"]).collect()}
    assert got == {(1, None, 0), (None, "a", 1)}
    assert clean_markup(rows.limit(0), "id", ["value", "clean"]).count() == 0


def test_long_values_take_time_in_proportion():
    """Openings that nothing ends used to be followed to the end of the value, each of them."""
    import time

    started = time.time()
    for text in ("<a:b> " * 100_000, "<pre>x " * 100_000, "{{code|x " * 50_000, "\\begin{verbatim} " * 50_000, "**a " * 30_000, "_a " * 30_000, "<ul>" * 50_000 + "<li>x", " " * 200_000 + "x"):
        clean(text)
    assert time.time() - started < 20


def test_ends_looked_for_first_change_nothing(monkeypatch):
    import random

    from tidemark.llm import markup

    rng = random.Random(5)
    bits = ["**a", "b**", " *c", "d*", "__e", "f__", "_g", "h_", "~~i", "j~~", "`k", "l`", " ", "word", "''x''", "[a](b)", "\n", "* "]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(2000)]
    plain = [clean(t) for t in texts]
    monkeypatch.setattr(markup, "LONG", -1)
    assert [clean(t) for t in texts] == plain
