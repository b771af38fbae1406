"""Deeply nested records as related flat tables, linked by interval labels.

Every node of a record (here an API specification: paths, operations, request bodies, media types, schemas,
fields) is labelled in one depth-first traversal with its pre-order and post-order number. A node table is
emitted for each type; a node lies below another exactly if its interval lies inside: ``a.pre < d.pre and
d.post < a.post``. So every table joins to every other by record and interval, without stored chains of ids.

Schemas are expanded where they are used: ``$ref`` is replaced by its target in ``components.schemas``; an
unknown target, or one that is already being expanded further out, adds nothing. ``allOf``, ``oneOf`` and
``anyOf`` add the fields of their members at the same level.

Defined results: null, unreadable or non-object JSON has no nodes; members of an unexpected type (null
operations, lists instead of objects) are passed over; a null member of ``properties`` is a field without
children; repeated records are labelled and reported each for itself, and so are records with a null key.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METHODS = ("get", "post", "put", "patch", "delete")
_GROUPS = ("allOf", "oneOf", "anyOf")
_REF = "#/components/schemas/"
_NODE = pa.schema([("row", pa.int64()), ("record", pa.int64()), ("pre", pa.int32()), ("post", pa.int32()), ("depth", pa.int32()), ("type", pa.string()), ("name", pa.string()), ("field_path", pa.string()), ("required", pa.bool_()), ("description", pa.string())])
_NODE_DDL = "row bigint, record bigint, pre int, post int, depth int, type string, name string, field_path string, required boolean, description string"


#: A child of a node: its values (depth, type, name, field_path, required, description) and its own children.
_Child = tuple[tuple, Iterator]


class _Spec:
    """The children of every node of one specification, each level a generator, so no depth of nesting is too deep."""

    def __init__(self, spec: dict):
        parts = spec.get("components")
        schemas = parts.get("schemas") if isinstance(parts, dict) else None
        self.schemas = schemas if isinstance(schemas, dict) else {}
        self.spec = spec

    def paths(self) -> Iterator[_Child]:
        for path, item in _members(self.spec.get("paths")):
            yield (1, "path", path, None, None, None), self.operations(item)

    def operations(self, item: object) -> Iterator[_Child]:
        for key, operation in _members(item):
            if key.lower() in METHODS and isinstance(operation, dict):
                yield (2, "operation", key.lower(), None, None, _text(operation.get("summary"))), self.bodies(operation)

    def bodies(self, operation: dict) -> Iterator[_Child]:
        body = operation.get("requestBody")
        if isinstance(body, dict):
            yield (3, "body", "requestBody", None, body.get("required") is True, None), self.media(body)

    def media(self, body: dict) -> Iterator[_Child]:
        for media, content in _members(body.get("content")):
            if isinstance(content, dict):
                yield (4, "media", media, None, None, None), self.fields(content.get("schema"), 5, "", frozenset())

    def target(self, ref: str) -> tuple[str, object] | None:
        if not ref.startswith(_REF):
            return None
        name = ref[len(_REF) :]
        if name not in self.schemas:
            name = name.replace("~1", "/").replace("~0", "~")
        return (name, self.schemas[name]) if name in self.schemas else None

    def fields(self, schema: object, depth: int, prefix: str, open_refs: frozenset[str]) -> Iterator[_Child]:
        """The fields of a schema and of all schemas that add to the same level; each schema once under the same open references."""
        stack, seen = [(schema, open_refs)], set()
        while stack:
            s, refs = stack.pop()
            if not isinstance(s, dict) or (id(s), refs) in seen:
                continue
            seen.add((id(s), refs))
            if isinstance(ref := s.get("$ref"), str):
                if (found := self.target(ref)) and found[0] not in refs:
                    stack.append((found[1], refs | {found[0]}))
                continue
            required = {x for x in s["required"] if isinstance(x, str)} if isinstance(s.get("required"), list) else set()
            for name, value in _members(s.get("properties")):
                path = f"{prefix}.{name}" if prefix else name
                told = _text(value.get("description")) if isinstance(value, dict) else None
                yield (depth, "field", name, path, name in required, told), self.fields(value, depth + 1, path, refs)
            stack += [(x, refs) for g in reversed(_GROUPS) if isinstance(s.get(g), list) for x in reversed(s[g])]


def walk(spec: dict) -> Iterator[list]:
    """[pre, post, depth, type, name, field_path, required, description] of every node, given out as it is left.

    Only a node and those around it are held at a time.
    """
    pre = post = 0
    open_now: list[tuple[list | None, Iterator]] = [(None, _Spec(spec).paths())]
    while open_now:
        row, children = open_now[-1]
        if (child := next(children, None)) is not None:
            open_now.append(([pre, 0, *child[0]], child[1]))
            pre += 1
            continue
        open_now.pop()
        if row is not None:
            row[1] = post
            post += 1
            yield row


def _members(x: object) -> list[tuple[str, object]]:
    return list(x.items()) if isinstance(x, dict) else []


def _text(x: object) -> str | None:
    return x if isinstance(x, str) else None


def _parse_deep(text: str) -> object:
    """A JSON value without recursion, for nesting that the library's parser gives up on."""
    scan, number, blank = json.decoder.scanstring, re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?"), re.compile(r"[ \t\n\r]*")
    words = {"true": True, "false": False, "null": None}
    root: list = []
    held: list[tuple] = [(root, None)]  # containers with the key the next value goes to
    at, state = 0, "value"
    while True:
        at = blank.match(text, at).end()
        ch = text[at : at + 1]
        into, key = held[-1]
        if state == "end" and len(held) == 1:
            if ch:
                raise ValueError("text after the value")
            return root[0]
        if state in ("value", "first") and not (state == "first" and ch == ("}" if isinstance(into, dict) else "]")):
            if isinstance(into, dict):
                if ch != '"':
                    raise ValueError("no key")
                key, at = scan(text, at + 1)
                at = blank.match(text, at).end()
                if text[at : at + 1] != ":":
                    raise ValueError("no colon")
                at = blank.match(text, at + 1).end()
                ch = text[at : at + 1]
            state = "end"
            if ch and ch in "{[":
                value, at, state = ({} if ch == "{" else []), at + 1, "first"
            elif ch == '"':
                value, at = scan(text, at + 1)
            elif (word := next((w for w in words if text.startswith(w, at)), None)) is not None:
                value, at = words[word], at + len(word)
            elif (m := number.match(text, at)) is not None:
                value, at = json.loads(m[0]), m.end()
            else:
                raise ValueError("no value")
            if isinstance(into, dict):
                into[key] = value
            else:
                into.append(value)
            if state == "first":
                held.append((value, None))
        elif ch == "," and state == "end":
            at, state = at + 1, "value"
        elif ch == ("}" if isinstance(into, dict) else "]") and len(held) > 1:
            held.pop()
            at, state = at + 1, "end"
        else:
            raise ValueError("unexpected character")


def read_spec(text: str | None) -> dict | None:
    """The object of a specification, or None if it can't be read as one; nesting may be of any depth."""
    if text is None:
        return None
    try:
        try:
            spec = json.loads(text)
        except RecursionError:
            spec = _parse_deep(text)
    except ValueError:
        return None
    return spec if isinstance(spec, dict) else None


def _label(kinds: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _NODE)], schema=_NODE)
            out.clear()
            return made

        for b in batches:
            for no, record, text in zip(*[b.column(c).to_pylist() for c in ("row", "record", "text")]):
                if (spec := read_spec(text)) is not None:
                    for row in walk(spec):
                        if not kinds or row[3] in kinds:
                            out.append((no, record, *row))
                            if len(out) >= 20_000:
                                yield emit()
        if out:
            yield emit()

    return run


def label_nodes(df: DataFrame, record: str, text: str, *kinds: str) -> DataFrame:
    """(row, record, pre, post, depth, type, name, field_path, required, description): all nodes of all records.

    ``row`` tells input rows apart, of equal or null records too.

    With ``kinds`` only nodes of these types come out; labels are the same.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(record).cast("bigint").alias("record"), F.col(text).alias("text")).where("text is not null")
    return rows.mapInArrow(_label(frozenset(kinds)), _NODE_DDL)


def node_table(nodes: DataFrame, kind: str) -> DataFrame:
    """The table of one type: path, operation, body, media or field."""
    return nodes.where(F.col("type") == kind).drop("type", "row")


def enclose(nodes: DataFrame, inner: str, *outer: str) -> DataFrame:
    """The nodes of type ``inner`` with, for each outer type, the name and label of the node whose interval holds them.

    In pre-order the last outer node before a node is the only one of its type (outer types don't nest) that can
    hold it; so one pass over each record's nodes replaces a range join, and the interval test decides.
    """
    order = W.partitionBy("row").orderBy("pre").rowsBetween(W.unboundedPreceding, 0)
    kept = nodes.where(F.col("type").isin(inner, *outer))
    for o in outer:
        kept = kept.withColumn(o, F.last(F.when(F.col("type") == o, F.struct("pre", "post", "name", "required")), ignorenulls=True).over(order))
    found = kept.where(F.col("type") == inner)
    for o in outer:
        found = found.where((F.col(f"{o}.pre") < F.col("pre")) & (F.col("post") < F.col(f"{o}.post")))
    return found.drop("type")


def body_fields(df: DataFrame, record: str, text: str) -> DataFrame:
    """(record, path, method, field_path): the fields of the request bodies of all operations, distinct in each row."""
    fields = enclose(label_nodes(df, record, text, "path", "operation", "field"), "field", "path", "operation")
    found = fields.select("row", "record", F.col("path.name").alias("path"), F.col("operation.name").alias("method"), "field_path").distinct()
    return found.drop("row")
