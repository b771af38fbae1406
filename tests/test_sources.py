"""Sources and sinks: specifications, files, logs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import corpus
from tidemark.sources import files, logs
from tidemark.sources.specs import clean_documents, extract_operations, read_specs

SPEC = {
    "info": {"title": "Bars", "version": "1"},
    "paths": {
        "/b": {"post": {"operationId": "make", "summary": "**Make**", "tags": ["x", "y"], "requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Cup"}}, "text/plain": {"schema": {"properties": {"no": {}}}}}}}, "get": {"operationId": "list", "parameters": [{"$ref": "#/components/parameters/page"}, {"$ref": "#/components/parameters/none"}, {"$ref": "other.json#/p", "name": "own"}, {"name": "q", "in": "query", "required": True, "description": "a <b>query</b>"}]}, "parameters": [{"name": "stray"}], "head": {"operationId": "no"}},
        "/a/{a_id}": {"delete": {"operationId": "drop", "deprecated": True, "externalDocs": {"url": "http://x.example"}, "parameters": None}, "put": None, "patch": "text"},
        "/c": None,
    },
    "components": {
        "parameters": {"page": {"name": "per_page", "in": "query", "description": "size"}},
        "schemas": {
            "Cup": {"required": ["size"], "properties": {"size": {"description": "how large"}, "lid": {"$ref": "#/components/schemas/Lid"}, "bad": None}, "allOf": [{"$ref": "#/components/schemas/Lid"}], "oneOf": [{"properties": {"z": {"description": "last"}, "a": {}}, "anyOf": [{"properties": {"deep": {}}}]}]},
            "Lid": {"description": "a lid", "properties": {"lock": {}, "size": {"description": "again"}}},
        },
    },
}


@pytest.fixture(scope="module")
def operations(spark):
    rows = [(1, json.dumps(SPEC)), (2, None), (3, "{broken"), (4, "[]"), (5, "{}"), (6, json.dumps({"paths": {"/x": {"get": {}}}}))]
    return extract_operations(spark.createDataFrame(rows, "spec_id long, spec_json string"), "spec_id", "spec_json").cache()


def test_operations_in_order(operations):
    got = [(r.key, r.doc_pos, r.method, r.path, r.id) for r in operations.orderBy("key", "doc_pos").collect()]
    assert got == [(1, 0, "DELETE", "/a/{a_id}", "drop"), (1, 1, "GET", "/b", "list"), (1, 2, "POST", "/b", "make"), (6, 0, "GET", "/x", "")]
    drop = operations.where("id = 'drop'").first()
    assert drop.deprecated and drop.docs_url == "http://x.example" and drop.params == [] and drop.body == [] and drop.category == ""
    assert operations.where("id = 'make'").first().category == "x"


def test_references_of_parameters(operations):
    got = [tuple(p) for p in operations.where("id = 'list'").first().params]
    assert got == [("per_page", "query", False, "size"), ("", "", False, ""), ("own", "", False, ""), ("q", "query", True, "a <b>query</b>")]


def test_body_fields(operations):
    got = [tuple(p) for p in operations.where("id = 'make'").first().body]
    assert got == [("bad", "body", False, ""), ("lid", "body", False, "a lid"), ("size", "body", True, "how large"), ("a", "body", False, ""), ("z", "body", False, "last"), ("lock", "body", False, ""), ("size", "body", False, "again")]


def test_clean_documents(operations):
    got = {r.id: r.text for r in clean_documents(operations).where("key = 1").collect()}
    assert got["drop"] == ". DELETE a a id"
    assert got["list"] == ". GET b. per page: size. . own. q: a query"
    assert got["make"].startswith("Make. POST b. bad. lid: a lid. size: how large")


def test_word_statistics(spark):
    rows = spark.createDataFrame([(1,), (2,), (4,), (9,)], "words long")
    assert tuple(corpus.word_stats(rows).first()) == (16, 1, 3.0, 4.0, 9)
    assert tuple(corpus.word_stats(rows.limit(0)).first()) == (0, 0, 0.0, 0.0, 0)


def test_files_round_trip(spark, operations, tmp_path):
    docs = clean_documents(operations).where("key = 1").select("doc_pos", "id", "method", "path", "summary", "description", "category", F.transform("params", lambda p: F.struct(p["name"].alias("name"), p["loc"].alias("in"), p["required"].alias("required"), p["description"].alias("description"))).alias("params"), F.lit(None).cast(files.FIELD).alias("body"), "deprecated", "docs_url", "text")
    files.write_documents(docs, f"{tmp_path}/docs")
    back = files.read_documents(spark, f"{tmp_path}/docs")
    assert sorted(back.collect(), key=str) == sorted(docs.drop("doc_pos").select(*back.columns).collect(), key=str)
    (tmp_path / "bad.json").write_text('{"id": "x"}\n{broken\n')
    with pytest.raises(Exception):
        files.read_documents(spark, f"{tmp_path}/bad.json").collect()
    (tmp_path / "gold.json").write_text(json.dumps([{"query": "q", "relevant": ["a"]}, {"query": "r", "relevant": [], "prerequisites": [["x", "y"]]}]))
    assert [(r.query, r.relevant, r.prerequisites) for r in files.read_gold(spark, f"{tmp_path}/gold.json").orderBy("query").collect()] == [("q", ["a"], None), ("r", [], [["x", "y"]])]
    (tmp_path / "s").mkdir()
    (tmp_path / "s/spec.json").write_text(json.dumps(SPEC, indent=1))
    assert extract_operations(read_specs(spark, f"{tmp_path}/s"), "file", "spec_json").count() == 3


def test_csv_and_quoting(spark, tmp_path):
    rows = spark.createDataFrame([('a,"b"', "c\nd", None)], "x string, y string, z string")
    assert rows.select(files.csv_line(F.col("x"), F.col("y"), F.col("z"))).first()[0] == '"a,""b""","c\nd",'
    assert rows.select(files.string_quoted("x")).first()[0] == '"a,\\"b\\""'
    files.write_csv(rows.select("x"), f"{tmp_path}/csv")
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").first().x == 'a,"b"'


def test_resolve(tmp_path):
    (tmp_path / "pyproject.toml").write_text("")
    (tmp_path / "a/b").mkdir(parents=True)
    assert files.resolve("data/x", str(tmp_path / "a/b")) == str(tmp_path / "data/x")
    assert files.resolve("/abs", str(tmp_path)) == "/abs" and files.resolve("hdfs://x/y", "z") == "hdfs://x/y"


def test_manifest(spark, operations):
    docs = operations.where("key = 1")
    words = corpus.word_stats(spark.createDataFrame([(2,), (4,)], "words long"))
    got = json.loads(files.manifest(docs, words, "Bars", "1", "MIT", {"load": 1.5}, "2025-01-01T00:00:00Z").first().manifest)
    assert got == {"spec": "Bars", "version": "1", "license": "MIT", "docs": 3, "words": 6, "words_per_doc": {"min": 2, "median": 3.0, "mean": 3.0, "max": 4}, "stage_ms": {"load": 1.5}, "generated_at": "2025-01-01T00:00:00Z"}


OUTPUT = """config=indexed   select=topk
 1. op-a   GET /a  9.00
    one
12. op-b   GET /b  8.00
    two

N=100  candidatos=7  comparações=9  seleção=topk  carga=60ms  índice=6.5ms  mem=8025kB  consulta=177µs

relacionadas pelo grafo (1):
  custo=2.0  op-r   GET    /r
grafo: V=10  E=22  construção=1.2ms  expansão=bfs  visitados=5  arestas=6  relacionadas=1  expansão_tempo=13µs  planos=2  pré_requisitos=3  plano_arestas=4  plano_tempo=1.5s
"""


def test_parse_runs(spark):
    rows = spark.createDataFrame([(1, OUTPUT, ["op-b"], 2), (2, OUTPUT, ["op-r"], 2), (3, OUTPUT.split("\nrelacionadas")[0], ["op-r"], 5), (4, "no statistics", ["x"], 5), (5, None, None, 5), (6, OUTPUT, None, 0)], "run long, output string, relevant array<string>, k int")
    got = {r.run: r for r in logs.parse_runs(rows, "output", "relevant", "k").collect()}
    assert set(got) == {1, 2, 3, 6}
    r = got[1]
    assert (r.config, r.selection, r.n, r.candidates, r.comparisons, r.load_ms, r.index_us, r.mem_kb, r.query_us) == ("indexed", "topk", "100", "7", "9", "60.000", "6500.000", "8025", "177.000")
    assert (r["rank"], r.precision, r.hit_ids if "hit_ids" in r else None) == (2, 0.5, None) and r.found_expanded
    assert (r.vertices, r.edges, r.build_us, r.expand, r.visited, r.scanned, r.related, r.expand_us, r.plans, r.prerequisites, r.plan_edges, r.plan_us) == ("10", "22", "1200.000", "bfs", "5", "6", "1", "13.000", "2", "3", "4", "1500000.000")
    assert got[2]["rank"] == 0 and got[2].found_expanded
    assert got[3].vertices == "" and got[3].plans == "" and not got[3].found_expanded
    assert got[6].precision == 0.0 and got[6]["rank"] == 0


def test_durations(spark):
    given = ["1.5ms", "13µs", "2s", "7ns", "3h", "", None, ".5ms", "x"]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, d string").orderBy("i")
    assert [r[0] for r in rows.select(logs.duration("d")).collect()] == ["1500.000", "13.000", "2000000.000", "0.007", "0.000", "0.000", "0.000", "500.000", "0.000"]
    assert [r[0] for r in rows.select(logs.duration("d", "ms")).collect()][:3] == ["1.500", "0.013", "2000.000"]


def test_trimmed(spark):
    rows = spark.createDataFrame([(OUTPUT,), ("plain",), (None,)], "o string")
    cut, plain, none = [r[0] for r in rows.select(logs.trimmed("o", 1)).collect()]
    assert plain == "plain" and none == ""
    assert "op-a" in cut and "op-b" not in cut and "two" not in cut and "op-r" in cut
    assert cut.endswith("... (1 resultados omitidos do log; contagem completa no CSV)")
    assert rows.select(logs.trimmed("o")).first()[0] == OUTPUT
