"""Text functions and calls."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.calls import answer_calls, answered_endpoint, fits, match_calls, split_path


def apply(spark, column, values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string").orderBy("i").select(column.alias("x")).collect()]


def test_tokens(spark):
    cases = {"Create a Table, in the Hall!": ["create", "table", "hall"], "per_page owner": ["per_page", "owner"], "": [], "the of": [], "!!! ---": [], "İstanbul": ["istanbul"], "go go GO": ["go", "go", "go"], "Ünï 3": ["n", "3"]}
    assert apply(spark, T.tokens("c"), cases) == list(cases.values())
    assert apply(spark, T.tokens("c"), [None]) == [[]]


def test_clean_text(spark):
    cases = {
        "Say **this**\n> [!NOTE]\n> [one](http://x.example) and <b>two</b>": "Say this one and two",
        "Before. **Fine-grained access tokens for \"X\"**\n\nmore": "Before.",
        "  a \t b  ": "a b",
        "# Head `code`": "Head code",
    }
    assert apply(spark, T.clean_text("c"), cases) == list(cases.values())
    assert apply(spark, T.clean_text("c"), [None, ""]) == ["", ""]


def test_path_words_and_segments(spark):
    assert apply(spark, T.path_words("c"), ["/a-b/{c_d}/e", None, "///"]) == ["a b c d e", "", ""]
    assert apply(spark, T.segments("c"), ["//a//b/", "/", "", None, "/x"]) == [["a", "", "b"], [], [], [], ["x"]]
    assert apply(spark, T.is_generated_id(F.col("c")), ["{_id}", "{a_id}", "{id}", "a_id", "{a_id"]) == [True, True, False, False, False]


def test_word_count(spark):
    assert apply(spark, T.word_count("c"), ["a b c\n d", "", None, "   x "]) == [4, 0, 0, 1]


@pytest.mark.parametrize("most", [1, 3, 5, 7, 11, 40])
def test_truncate(spark, most):
    values = ["short", "one two three four", "é é é é é é", "ééééééé", "nospacesatallhere", " leading", ""]

    def plain(t):
        raw = t.encode()
        if len(raw) <= most:
            return t
        cut = raw[:most].rfind(b" ")
        return raw[: cut if cut > 0 else most].decode(errors="ignore") + " […]"

    assert apply(spark, T.truncate("c", most), values) == [plain(v) for v in values]
    assert apply(spark, T.truncate("c", 0), values) == values


def test_clean_query(spark):
    cases = {'"remove table"\n': "remove table", "Query: stop a run.": "stop a run", "  list halls  ": "list halls", "make it\nmake it\nmake": "make it", "“quoted”": "quoted"}
    assert apply(spark, T.clean_query("c"), cases) == list(cases.values())
    assert apply(spark, T.clean_query("c"), [None]) == [""]


def test_language(spark):
    asked = ["como eu apago isto?", "how do I stop it?", "Já está?", "Qual?", "", None]
    assert apply(spark, T.is_portuguese("c"), asked) == [True, False, True, True, False, False]


def test_looping(spark):
    def plain(t):
        raw = t.encode()
        seen = raw[-1600:]
        return len(raw) >= 180 and seen.count(raw[-60:]) >= 3

    line = "- owner: the account that owns this table of the hall, é.\n"
    values = ["short", line * 6, line * 2 + "Something else stands here at the end of all of it, once.", "x" * 200, "ab" * 400, "", line + "y" * 1600]
    assert apply(spark, T.is_looping("c"), values) == [plain(v) for v in values]
    assert apply(spark, T.is_looping("c"), [None]) == [False]


HOST = "api.kelpforge.example"


def test_answer_calls(spark):
    answer = f"Use `DELETE /a/{{b}}/c/{{c_id}}`.\ncurl -X POST https://{HOST}/a/<B>/d/<D>/rename\ncurl \"https://{HOST}/a/o/c?per_page=5\" -X GET\nAgain: DELETE /a/{{b}}/c/{{c_id}}. FORGET /no"
    got = [tuple(x) for x in apply(spark, answer_calls("c"), [answer])[0]]
    assert got == [("DELETE", "/a/{b}/c/{c_id}"), ("POST", "/a/<B>/d/<D>/rename"), ("GET", "/a/o/c")]
    assert apply(spark, answer_calls("c"), [None, "", "get /a"]) == [[], [], []]


def test_answered_endpoint(spark):
    assert apply(spark, answered_endpoint("c"), ["First GET `x`, then PUT /a/b) ok", "none", None]) == ["PUT /a/b", None, None]


CATALOGUE = [("get", "/a/{x}/c", "one"), ("GET", "/a/{x}/{y}", "two"), ("post", "/a", "three"), ("get", "", "root"), (None, "/a", "none"), ("get", None, "null")]
CALLS = [("GET", "/a/1/c"), ("GET", "/a/1/d"), ("POST", "/a/"), ("POST", "/a/b"), ("GET", "/"), ("GET", "/b/1/c"), ("GET", "/a/{x}/c")]


def test_calls_meet_all_templates_they_fit(spark):
    calls, catalogue = spark.createDataFrame(CALLS, "method string, path string"), spark.createDataFrame(CATALOGUE, "method string, path string, id string")

    def plain(method, path):
        got = path.strip("/").split("/")
        for m, t, i in CATALOGUE:
            want = (t or "").strip("/").split("/")
            if m and m.upper() == method and len(want) == len(got) and all(w.startswith("{") or w == g for w, g in zip(want, got)):
                yield method, path, i

    assert {tuple(r) for r in match_calls(calls, catalogue, "id").collect()} == {x for c in CALLS for x in plain(*c)}
    one = spark.createDataFrame([("/a/{x}/c", "/a/1/c"), ("/a/{x}/c", "/a/1/d"), ("/a/{x}", "/a/1/c")], "t string, p string")
    assert [r[0] for r in one.select(fits(split_path("t"), split_path("p"))).collect()] == [True, False, False]
