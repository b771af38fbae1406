"""Problem 6: nested records as flat tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators.nested import _parse_deep, body_fields, enclose, label_nodes, node_table, read_spec, walk


def spec(schema, **schemas):
    return {"paths": {"/p": {"POST": {"requestBody": {"required": True, "content": {"m/1": {"schema": schema}, "m/2": {}}}}, "x": {"requestBody": {}}, "get": None}, "/q": []}, "components": {"schemas": schemas}}


CASES = [
    (spec({"properties": {"a": {"properties": {"b": None}}, "c": {}}}), {"a", "a.b", "c"}),
    (spec({"allOf": [{"properties": {"a": {}}}, {"oneOf": [{"$ref": "#/components/schemas/S"}]}], "properties": {"z": None}}, S={"properties": {"s": {"$ref": "#/components/schemas/S"}, "t": {}}}), {"a", "z", "s", "t"}),
    (spec({"$ref": "#/components/schemas/A"}, A={"properties": {"b": {"$ref": "#/components/schemas/B"}}}, B={"properties": {"a": {"$ref": "#/components/schemas/A"}, "n": {}}}), {"b", "b.a", "b.n"}),
    (spec({"$ref": "#/components/schemas/unknown"}), set()),
    (spec({"properties": "text", "allOf": {"a": 1}}), set()),
    (spec(None), set()),
]


def test_fields(spark):
    rows = [(i, json.dumps(s), "x") for i, (s, _) in enumerate(CASES)] + [(90, None, "x"), (91, "{bad", "x"), (92, "[]", "x"), (93, "", "x")]
    df = spark.createDataFrame(rows, "spec_id long, spec_json string, path string")
    got = {}
    for r in body_fields(df, "spec_id", "spec_json").collect():
        assert (r.path, r.method) == ("/p", "post")
        got.setdefault(r.record, set()).add(r.field_path)
    assert got == {i: f for i, (_, f) in enumerate(CASES) if f}
    assert body_fields(df.limit(0), "spec_id", "spec_json").count() == 0


def test_intervals_hold_what_lies_below(spark):
    rows = [row for s, _ in CASES for row in [list(walk(s))]]
    for nodes in rows:
        assert sorted(n[0] for n in nodes) == sorted(n[1] for n in nodes) == list(range(len(nodes)))
        for n in nodes:
            around = [m for m in nodes if m[0] < n[0] and n[1] < m[1]]
            assert len(around) == n[2] - 1
    df = spark.createDataFrame([(1, json.dumps(CASES[0][0])), (1, json.dumps(CASES[1][0])), (None, json.dumps(CASES[0][0]))], "k long, t string")
    nodes = label_nodes(df, "k", "t")
    assert node_table(nodes, "media").groupBy("name").count().orderBy("name").collect() == [("m/1", 3), ("m/2", 3)]
    found = enclose(nodes, "field", "path", "operation", "media").select("row", "field_path", "path.name", F.col("media.name").alias("media")).collect()
    assert len(found) == 3 + 4 + 3 and {r.media for r in found} == {"m/1"}
    assert {r.type for r in label_nodes(df, "k", "t", "path").collect()} == {"path"}


def test_any_depth():
    def deep(n):
        return '{"paths":{"/p":{"post":{"requestBody":{"content":{"m":{"schema":' + '{"properties":{"a":' * n + "{}" + "}}" * n + "}}}}}}}"

    for n in (10, 3_000, 20_000):
        assert sum(1 for _ in walk(read_spec(deep(n)))) == n + 4


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, {"b": null}, [], {}], "c": "x\\u00e9\\n", "d": true}', "[]", "{}", " [1 , 2] ", '{"a" 1}', "[1,]", '{"a":1,}', "{", "[", '{"a":1} x', "", '{"a":}', ",", "]", "[1 2]", "{1:2}", '"x', "01", "[01]", '{"a":1]', "nul", "[1}"])
def test_both_parsers_agree(text):
    def tried(parse):
        try:
            return parse(text)
        except ValueError:
            return ValueError

    assert tried(_parse_deep) == tried(json.loads)
