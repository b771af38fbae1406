"""Problem 1: broken pairs."""

from __future__ import annotations

import random

import pyarrow as pa

from tidemark.llm import pairs
from tidemark.llm.pairs import unknown_calls
from tidemark.llm.queries import QUERIES

CATALOGUE = [("get", "/repos/{o}/x/"), ("POST", "/repos"), ("GET", None), (None, "/repos/{o}/y")]
PAIRS = [
    (1, "How do I list the x of a repo?", "Call GET /repos/abc/x and check the returned status."),
    (2, "How do I list the x of a repo?", "Call DELETE /repos/abc/x and check the returned status."),
    (3, "How do I list the y of a repo?", "Call GET /repos/abc/y and check the returned status."),
    (4, "How do I list the x of a repo?", None),
    (5, "How do I list the x of a repo?", "How do I list the x of a repo?"),
    (6, "How do I list the x of a repo?", "Call GET /repos/abc/x and check the"),
]


def test_calls_are_looked_up_by_segments(spark):
    """The slashes around a template were trimmed off the wrong argument: no template had its segments."""
    calls = spark.createDataFrame([("GET", "repos/abc/x"), ("GET", "repos/abc/z"), ("POST", "repos"), ("GET", "repos")], "method string, path string")
    catalogue = spark.createDataFrame(CATALOGUE, "method string, path string")
    assert sorted(map(tuple, unknown_calls(calls, catalogue).collect())) == [("GET", "repos"), ("GET", "repos/abc/z")]


def test_p1_found(spark, tmp_path):
    spark.createDataFrame(PAIRS, "record_id bigint, pergunta string, resposta string").write.parquet(f"{tmp_path}/llm_records.parquet")
    spark.createDataFrame(CATALOGUE, "method string, path string").write.parquet(f"{tmp_path}/raw_documents.parquet")
    found = QUERIES["p1_found"](spark, str(tmp_path))
    assert found.columns == ["record_id", "defect"]
    assert {r.record_id: r.defect for r in found.collect()} == {2: "invented", 3: "invented", 4: "empty", 5: "copied", 6: "truncated"}


def _components(links, texts):
    of = {t: {t} for t in texts}
    for a, b in links:
        both = of[a] | of[b]
        of.update(dict.fromkeys(both, both))
    return {frozenset(x) for x in of.values()}


def _linked(rows, size=7):
    schema = pa.schema([("bucket", pa.int64()), ("opening", pa.string()), ("shingles", pa.list_(pa.int64()))])
    batches = [pa.RecordBatch.from_pylist([{"bucket": k, "opening": t, "shingles": sorted(s)} for k, t, s in rows[i : i + size]], schema=schema) for i in range(0, len(rows), size)]
    return [(x["a"], x["b"]) for b in pairs._link(iter(batches)) for x in b.to_pylist()]


def test_followers_of_different_leaders_are_linked():
    """Only leaders were compared: c and d, which are similar, followed a and b, which aren't."""
    rows = [(1, t, set(range(k, k + 100))) for t, k in (("a", 0), ("b", 30), ("c", 10), ("d", 20))]
    assert _components(_linked(rows), "abcd") == {frozenset("abcd")}


def test_links_join_what_all_pairs_join():
    rng = random.Random(3)
    rows = []
    for bucket in range(20):
        start = [rng.randrange(60) for _ in range(3)]
        for i in range(30):
            own = set(range(k := rng.choice(start) + rng.randrange(12), k + 20 + rng.randrange(12))) - {rng.randrange(90)}
            rows.append((bucket, f"{bucket}-{i:02}", {x * 7919 % 1009 for x in own}))
    every = [(t, u) for k, t, a in rows for q, u, b in rows if k == q and t < u and len(a & b) >= pairs.SIMILAR * len(a | b)]
    texts = [t for _, t, _ in rows]
    assert _components(_linked(rows), texts) == _components(every, texts)


def test_long_answers_without_content_are_empty():
    """Answers of more than 400 characters were judged by their first 200."""
    for answer in ("N/A" + "." * 400, "&nbsp;" * 100, "null " + "-" * 500, "<p>" + "&nbsp;" * 100 + "</p>", "." * 500):
        assert pairs.is_empty(answer)
    assert not pairs.is_empty("N/A" + "." * 400 + " Call GET /repos.")


def test_long_curl_commands_are_read_to_their_end():
    """A command was read for 2,000 characters only."""
    body = '{"note": "' + "use curl here, " * 300 + '"}'
    url = "https://api.kelpforge.example"
    assert pairs.calls_in(f"curl -X POST -d '{body}' {url}/repos/abc") == [("POST", "repos/abc")]
    assert pairs.calls_in(f"curl -X POST {url}/a -d '{'x' * 3000}'; curl -X PUT {url}/b/curl/c") == [("POST", "a"), ("PUT", "b/curl/c")]
    assert pairs.calls_in(f"curl {url}/a && curl -X PUT {url}/b") == [("PUT", "b")]


def test_copies_of_any_length():
    """Repetitions were tried up to 40 times the question, introductions up to 60 characters."""
    q = "How do I list the x of a repo?"
    assert pairs.is_copy(q, " ".join([q] * 100))
    assert pairs.is_copy(q, " ".join([q] * 99 + [q.replace("repo", "rpo")]))
    assert pairs.is_copy(q, f"Thank you for your message, I have read it with care and this is the question you asked me: {q}")
    assert not pairs.is_copy(q, " ".join([q] * 50) + " Call GET /repos/abc/x and check the returned status.")
    assert not pairs.is_copy(q, f"Call GET /repos/abc/x and check the returned status, as this is the answer to what you asked: {q}")


def test_languages_beyond_those_of_the_prompts():
    asked = "How do I list the branches of a repository?"
    for answer in ("Per questo si usa la chiamata giusta, che è nella lista delle operazioni.", "Gebruik het juiste verzoek en roep dit daarna niet opnieuw aan voor de lijst.", "请调用列表操作。", "Bunun için doğru işlem budur ve daha sonra liste gelir.", "Najpierw użyj listy, potem sprawdź odpowiedź, która nie jest pusta."):
        assert pairs.other_language(asked, answer), answer
    assert not pairs.other_language(asked, "You can use the list of branches and then check the answer.")
    assert not pairs.other_language(asked, "`GET /x`") and not pairs.other_language(None, "Bonjour")


def test_copies():
    q = "How do I list the branches of a repository?"
    for a in (q, q.upper(), f"> {q}", f"You asked: {q}", f"You asked: {q}\nI will repeat: {q}", " ".join([q] * 60), q.replace("branches", "brnches")):
        assert pairs.is_copy(q, a), a
    for a in (f"{q} Use GET /repos.", f"To answer: GET /repos/x\n{q}", "How do I list", ""):
        assert not pairs.is_copy(q, a), a


def test_lines_that_others_begin_with(spark):
    closing = ["finally check the result in the listing", "ab", "finally check the rest"]
    asked = ["finally check the result", "finally check the re", "finally check the rest", "a", "ab", "b", "finally check the result in the listing", "finally check the rexx"]
    frames = [spark.createDataFrame([(x,) for x in xs], "line string") for xs in (asked, closing)]
    got = {r.line for r in pairs._begun(*frames).collect()}
    assert got == {a for a in asked if any(c.startswith(a) and c != a for c in closing)}


def test_empty_tables_nulls_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, None, None, "x"), (2, None, "Call GET /a now.", "x"), (3, "q", "", "x")], "record long, asked string, answer string, line string")
    catalogue = spark.createDataFrame([], "method string, path string")
    got = {tuple(r) for r in pairs.broken_pairs(rows, "record", "asked", "answer", catalogue).collect()}
    assert got == {(1, "empty"), (2, "invented"), (3, "empty")}
    assert pairs.broken_pairs(rows.limit(0), "record", "asked", "answer", catalogue).count() == 0


def test_long_answers_take_time_in_proportion():
    import time

    started = time.time()
    for text in ("curl -X GET " * 50_000, "curl " * 100_000, "- item\n" * 100_000, "GET /a " * 100_000, "a: " * 100_000):
        pairs._read_pair(1, "How do I list it?", text)
    assert time.time() - started < 20
