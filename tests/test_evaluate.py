"""Rankings and answers against a gold set."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate as E

HITS = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 1, "q"), ("c", 7, "x")]
GOLD = [("a", ["y", "z"]), ("b", ["x"]), ("c", ["x", "x"]), ("d", ["x"]), ("e", None), ("f", [])]


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(HITS, "qid string, rank int, id string"), spark.createDataFrame(GOLD, "qid string, relevant array<string>")


@pytest.mark.parametrize("k,want", [(5, {"a": (2, 0.4, 3), "b": (0, 0.0, 1), "c": (7, 0.0, 1), "d": (0, 0.0, 0), "e": (0, 0.0, 0), "f": (0, 0.0, 0)}), (2, {"a": (2, 0.5, 3), "b": (0, 0.0, 1), "c": (7, 0.0, 1), "d": (0, 0.0, 0), "e": (0, 0.0, 0), "f": (0, 0.0, 0)}), (0, {"a": (2, 0.0, 3), "b": (0, 0.0, 1), "c": (7, 0.0, 1), "d": (0, 0.0, 0), "e": (0, 0.0, 0), "f": (0, 0.0, 0)})])
def test_rank_and_precision(frames, k, want):
    got = {r.qid: (r["rank"], r.precision, r.candidates) for r in E.evaluated(*frames, k).collect()}
    assert got == want


def test_summary(spark):
    results = spark.createDataFrame([("a", 1, 0.2, 10), ("b", 7, 0.0, 10), ("c", 0, 0.1, 0)], "qid string, rank int, precision double, candidates int")
    s = E.summary(results, 5).first()
    assert (s.queries, s.hits_at_k, s.empty, s.mean_rank) == (3, 1, 1, 4.0) and s.mean_precision == pytest.approx(0.1)
    assert tuple(E.summary(results.limit(0), 5).first()) == (0, 0, 0, 0.0, 0.0)


def test_found_expanded(spark, frames):
    results = E.evaluated(*frames, 5)
    related = spark.createDataFrame([("b", "x"), ("d", "y")], "qid string, id string")
    assert {r.qid for r in E.found_expanded(results, related, frames[1]).where("found").collect()} == {"a", "b", "c"}


DOCS = [("list-cups", "get", "/bars/{a}/{b}/cups"), ("drop-cup", "delete", "/bars/{a}/{b}/cups/{cup_id}"), ("get-cup", "get", "/bars/{a}/{b}/cups/{cup_id}"), ("rename", "post", "/bars/{a}/{b}/lids/{lid}/rename"), ("me", "patch", "/me"), ("null", None, None)]
BOTH = "First GET /bars/{a}/{b}/cups, then DELETE /bars/{a}/{b}/cups/{cup_id}."
#: answer, relevant, needed, context -> correct, cited before, invented, use
CASES = [
    (BOTH, ["drop-cup"], [["list-cups"]], ["drop-cup"], True, True, [], "trouxe_e_usou"),
    ("curl -X DELETE https://api.kelpforge.example/bars/o/r/cups/42", ["drop-cup"], [["list-cups"]], ["drop-cup"], True, False, [], "trouxe_e_usou"),
    ("Use PUT /bars/{a}/{b}/cups/{cup_id} and then DELETE /me.", ["drop-cup"], [["list-cups"]], ["drop-cup"], False, False, ["PUT /bars/{a}/{b}/cups/{cup_id}", "DELETE /me"], "trouxe_e_nao_usou"),
    ("GET /bars/{a}/{b}/cups", ["drop-cup"], [["list-cups"]], [], False, False, [], "busca_falhou"),
    (BOTH, ["drop-cup"], [["list-cups"], ["get-cup"]], None, True, False, [], "de_memoria"),
    (BOTH + " GET /bars/1/2/cups/3", ["drop-cup", "me"], [["rename", "list-cups"], ["get-cup"]], ["me"], True, True, [], "trouxe_e_usou"),
    ("There is no such operation.", [], None, None, True, False, [], ""),
    ("There is none, but PATCH /me does it.", None, None, None, False, False, [], ""),
    (None, ["me"], [], ["me"], False, False, [], "trouxe_e_nao_usou"),
]


@pytest.fixture(scope="module")
def records(spark):
    rows = [(i, f"question {i}", *c[:4], "x") for i, c in enumerate(CASES)]
    return spark.createDataFrame(rows, "record_id long, pergunta string, resposta string, relevantes array<string>, pre_requisitos array<array<string>>, contexto array<string>, cited string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id string, method string, path string")


def test_scored_answers(records, docs):
    got = {r.record_id: (r.correct, r.cited_before, r.invented, r.context_use) for r in E.scored_answers(records, docs).collect()}
    assert got == {i: c[4:] for i, c in enumerate(CASES)}
    first = E.scored_answers(records, docs).where("record_id = 0").first()
    assert first.cited == ["GET /bars/{a}/{b}/cups", "DELETE /bars/{a}/{b}/cups/{cup_id}"] and first.needs_before and first.in_context
    assert E.scored_answers(records.limit(0), docs).count() == 0
    assert {r.record_id for r in E.scored_answers(records, docs.limit(0)).where("correct").collect()} == {6}


def test_rescored(spark, records, docs):
    gold = spark.createDataFrame([(f"question {i}", ["list-cups"], None) for i in range(len(CASES))], "question string, relevant array<string>, needed array<array<string>>")
    got = {r.record_id for r in E.rescored(records, gold, docs).where("correct").collect()}
    assert got == {0, 3, 4, 5}
    with pytest.raises(Exception, match="outside the gold set"):
        E.rescored(records, gold.where("question != 'question 3'"), docs).collect()


def test_context_ids(spark):
    row = spark.createDataFrame([(["a", "b"], ["b", "c"], [["d", "a"], ["e"]]), (None, None, None)], "r array<string>, n array<string>, p array<array<string>>")
    assert [x[0] for x in row.select(E.context_ids(F.col("r"), F.col("n"), F.col("p"))).collect()] == [["a", "b", "c", "d", "e"], []]
