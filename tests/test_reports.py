"""Reports, conversations, trees, rendering and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import render, reports
from tidemark.operators.search import Engine
from tidemark.streaming.queries import search_stream, statistics_per_window


def test_scenarios(spark):
    assert reports.scenario_matrix(spark).count() == 27 and reports.graph_scenarios(spark).count() == 8
    assert reports.run_count(reports.scenario_matrix(spark), 10).first().runs == 540
    assert [r.name for r in reports.conditions(spark, "B, D").orderBy("name").collect()] == ["B", "D"]


def test_hardware(spark, tmp_path):
    (tmp_path / "cpuinfo").write_text("processor : 0\nmodel name\t: Some CPU\n")
    (tmp_path / "meminfo").write_text("MemTotal:       2097152 kB\n")
    assert tuple(reports.hardware(spark, str(tmp_path)).first())[::2] == ("Some CPU", 2.0)
    assert reports.hardware(spark, str(tmp_path / "none")).first().cpu is None


def test_bars_and_shares(spark):
    hits = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("b", 0.0)], "qid string, score double")
    assert sorted(tuple(r) for r in reports.score_bars(hits).select("qid", "bar").collect()) == [("a", 50.0), ("a", 100.0), ("b", 0.0)]
    rows = spark.createDataFrame([(100.0, 50.0, 1), (None, None, None)], "s double, g double, m long")
    assert [r[0] for r in rows.select(reports.time_share(F.col("s"), F.col("g"), F.col("m"))).collect()] == [pytest.approx(100 * 150 / 1150), None]


def test_earlier_questions(spark):
    turns = [("c", i, "user" if i % 2 == 0 else "assistant", f"q{i}") for i in range(16)] + [("d", 0, "assistant", "x"), ("d", 1, None, None)]
    got = {(r.conversation, r.turn): r.earlier for r in reports.earlier_questions(spark.createDataFrame(turns, "conv string, n int, role string, text string"), "conv", "n", "role", "text").collect()}
    lead = "Earlier questions in this conversation, for context only: "
    for c, n, _, _ in turns:
        asked = [t for d, i, r, t in turns if d == c and i < n and r == "user"][-5:]
        assert got[c, n] == (lead + " | ".join(asked) + "\n\n" if asked else "")


def test_tree(spark):
    paths = [("q", "GET", "/a/b/c"), ("q", "POST", "/a/b/c"), ("q", "GET", "/a/b/c/d/e"), ("q", "GET", "/a/x"), ("r", "GET", "/")]
    rows = reports.tree_rows(spark.createDataFrame(paths, "qid string, method string, path string"))
    got = {(r.qid, r.kind, r.depth, r.label, r.method) for r in rows.collect()}
    assert {g for g in got if g[0] == "q"} == {("q", 0, 0, "/a", None), ("q", 0, 1, "/b/c", None), ("q", 1, 2, "/a/b/c", "GET"), ("q", 1, 2, "/a/b/c", "POST"), ("q", 0, 2, "/d/e", None), ("q", 1, 3, "/a/b/c/d/e", "GET"), ("q", 0, 1, "/x", None), ("q", 1, 2, "/a/x", "GET")}
    row = spark.createDataFrame([("PUT",), ("GET",), ("HEAD",)], "m string")
    assert [r[0] for r in row.select(reports.method_place(F.col("m"))).collect()] == [3, 1, 0]


def test_tree_operations(spark):
    results = spark.createDataFrame([("q", "get", "/a", 1, 2.0)], "qid string, method string, path string, rank int, score double")
    related = spark.createDataFrame([("q", "GET", "/a", 3), ("q", "GET", "/b", 4)], "qid string, method string, path string, hops int")
    plans = spark.createDataFrame([("q", "GET", "/b")], "qid string, method string, path string")
    answers = spark.createDataFrame([("q", "Use GET /b now")], "qid string, answer string")
    got = {tuple(r) for r in reports.tree_operations(results, related, plans, answers).collect()}
    assert got == {("q", "GET", "/a", 1, 2.0, 3, False, False), ("q", "GET", "/b", None, None, 4, True, True)}


def test_run_statistics(spark):
    runs = spark.createDataFrame([("a", 1, 10.0), ("a", 0, 20.0), ("a", None, None), ("b", None, None)], "cenario string, posicao int, consulta_us double")
    got = {r.cenario: tuple(r)[1:] for r in reports.run_statistics(runs).collect()}
    assert got == {"a": (3, 1, 1.0, 15.0, 10.0, 20.0), "b": (1, 0, None, None, None, None)}


FIELD = "array<struct<name: string, description: string>>"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(0, "a", "GET", "/a", "red hall", "", None, None, "Red hall text", "http://x.example"), (1, "b", "GET", "/b", "blue hall", None, None, None, None, None), (2, "c", "PUT", "/c", "blue", None, None, None, None, None)]
    return spark.createDataFrame(rows, f"doc_pos long, id string, method string, path string, summary string, description string, params {FIELD}, body {FIELD}, text string, docs_url string")


def test_rendering(spark, docs):
    queries = spark.createDataFrame([("q", "red", False), ("e", "the of", True), ("n", 'so "x"', False)], "qid string, query string, empty_query boolean")
    context = docs.where("doc_pos = 0").select(F.lit("q").alias("qid"), F.lit(1).alias("rank"), "*")
    got = {r.qid: r.shown for r in render.rendered(queries, context).collect()}
    assert got["q"] == '1 REST API operations for "red", most relevant first:\n\n[1] GET /a\nRed hall text\nDocs: http://x.example\n\n'
    assert got["e"] == render.NO_TERMS and got["n"] == render.NO_MATCH.format('"so \\"x\\""')
    related = spark.createDataFrame([("q", 2, "b"), ("q", 1, "c")], "qid string, pos int, id string")
    assert render.rendered_related(related, docs).first().shown == render.RELATED_HEAD + "- PUT /c: blue. Docs: \n- GET /b: blue hall. Docs: \n\n"
    plans = spark.createDataFrame([("q", 2, ["a", "c"]), ("q", 1, ["b"])], "qid string, rank int, steps array<string>")
    assert render.rendered_plans(plans, docs).first().shown == render.PLANS_HEAD + "For [2] PUT /c:\n  1. GET /a\n  2. PUT /c\n\n"


def test_streams(spark, docs, tmp_path):
    spark.createDataFrame([("1", "red"), ("2", "blue hall")], "qid string, query string").write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("qid string, query string").json(f"{tmp_path}/in")
    search_stream(stream, "qid", "query", Engine(docs), f"{tmp_path}/out", f"{tmp_path}/check", k=1).awaitTermination()
    assert {(r.qid, r.id) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("1", "a"), ("2", "b")}
    spark.sql("SELECT timestamp'2025-01-01 00:00:01' AS ts, 'x' AS kind, 1.5D AS value UNION ALL SELECT timestamp'2025-01-01 00:00:59', 'x', 2.5D UNION ALL SELECT timestamp'2025-01-01 00:01:01', 'y', null").write.parquet(f"{tmp_path}/runs")
    runs = spark.readStream.schema("ts timestamp, kind string, value double").parquet(f"{tmp_path}/runs")
    told = statistics_per_window(runs, "ts", "value", "kind")
    told.writeStream.format("memory").queryName("told").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    assert {(r.group, r.n, r.sum, r.least, r.most) for r in spark.table("told").collect()} == {("x", 2, 4.0, 1.5, 2.5), ("y", 1, None, None, None)}
