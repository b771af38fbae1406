"""API specifications as documents: one row per operation, by VARIANT expressions inside the row.

Nothing is joined or shuffled: references are looked up in the specification's own components, which are in the
same row. Paths come in ascending byte order and methods in a fixed order, which gives each document its
``doc_pos`` within its specification.

Defined results: null or unreadable JSON gives no documents; members that aren't objects are passed over; an
unknown parameter gives an empty field, an unknown schema no fields; what is missing is the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, composed_text

# The order of methods, and prefixes of references.
METHODS = ["get", "post", "put", "patch", "delete"]
PARAMETERS, SCHEMAS = "#/components/parameters/", "#/components/schemas/"
_OBJECT, _LIST = "map<string,variant>", "array<variant>"


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """(file, spec_json): every file under a path as one value."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("spec_json"))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _str(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "string"), F.lit(""))


def _bool(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "boolean"), F.lit(False))


def _field(v: Column, loc: Column | None = None) -> Column:
    place = _str(v, "$.in") if loc is None else loc
    return F.struct(_str(v, "$.name").alias("name"), place.alias("loc"), _bool(v, "$.required").alias("required"), _str(v, "$.description").alias("description"))


def parameters(operation: Column, known: Column) -> Column:
    """ARRAY<STRUCT<name, loc, required, description>> of an operation, references looked up in ``known``."""

    def one(p: Column) -> Column:
        ref = _str(p, '$["$ref"]')
        target = F.try_element_at(known, F.substring(ref, len(PARAMETERS) + 1, 1 << 30))
        return _field(F.when(ref.startswith(PARAMETERS), target).otherwise(p))

    return F.transform(F.coalesce(_get(operation, "$.parameters", _LIST), F.array().cast(_LIST)), one)


def _resolved(schema: Column, known: Column) -> Column:
    """A schema, or what its reference names; one step only."""
    ref = _str(schema, '$["$ref"]')
    return F.when(ref.startswith(SCHEMAS), F.try_element_at(known, F.substring(ref, len(SCHEMAS) + 1, 1 << 30))).otherwise(schema)


def _properties(schema: Column, known: Column) -> Column:
    """The fields of a resolved schema, by name."""
    held = _get(schema, "$.properties", _OBJECT)
    required = F.coalesce(_get(schema, "$.required", "array<string>"), F.array().cast("array<string>"))
    names = F.array_sort(F.coalesce(F.map_keys(held), F.array().cast("array<string>")))
    one = lambda n: F.struct(n.alias("name"), F.lit("body").alias("loc"), F.array_contains(required, n).alias("required"), _str(_resolved(held[n], known), "$.description").alias("description"))
    return F.transform(names, one)


def body_fields(operation: Column, known: Column) -> Column:
    """The fields of a JSON body: its schema's, then those of its oneOf, anyOf and allOf members, in that order."""
    schema = _resolved(_get(operation, '$.requestBody.content["application/json"].schema', "variant"), known)
    members = F.concat(*[F.coalesce(_get(schema, f"$.{g}", _LIST), F.array().cast(_LIST)) for g in ("oneOf", "anyOf", "allOf")])
    return F.concat(_properties(schema, known), F.flatten(F.transform(members, lambda m: _properties(_resolved(m, known), known))))


def extract_operations(df: DataFrame, key: str, spec_json: str) -> DataFrame:
    """(key, doc_pos, id, method, path, summary, description, category, params, body, deprecated, docs_url)."""
    spec = df.select(F.col(key).alias("key"), F.try_parse_json(F.col(spec_json)).alias("v"))
    parts = spec.select("key", _get(F.col("v"), "$.paths", _OBJECT).alias("paths"), F.coalesce(_get(F.col("v"), "$.components.parameters", _OBJECT), F.create_map().cast(_OBJECT)).alias("kp"), F.coalesce(_get(F.col("v"), "$.components.schemas", _OBJECT), F.create_map().cast(_OBJECT)).alias("ks"))
    item = lambda p: _get(F.col("paths")[p], "$", _OBJECT)
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    there = lambda p: F.transform(F.filter(F.array(*map(F.lit, METHODS)), lambda m: F.coalesce(is_object(F.try_element_at(item(p), m)), F.lit(False))), lambda m: F.struct(p.alias("path"), m.alias("m")))
    listed = F.flatten(F.transform(F.array_sort(F.map_keys("paths")), there))
    ops = parts.where("paths is not null").select("key", "kp", "ks", "paths", F.posexplode(listed).alias("doc_pos", "at"))
    ops = ops.select("key", F.col("doc_pos").cast("bigint").alias("doc_pos"), "at.path", F.upper("at.m").alias("method"), "kp", "ks", F.try_element_at(item(F.col("at.path")), F.col("at.m")).alias("o"))
    o = F.col("o")
    return ops.select(
        "key", "doc_pos", _str(o, "$.operationId").alias("id"), "method", "path", _str(o, "$.summary").alias("summary"), _str(o, "$.description").alias("description"),
        _str(o, "$.tags[0]").alias("category"), parameters(o, F.col("kp")).alias("params"), body_fields(o, F.col("ks")).alias("body"), _bool(o, "$.deprecated").alias("deprecated"), _str(o, "$.externalDocs.url").alias("docs_url"),
    )


def clean_documents(docs: DataFrame) -> DataFrame:
    """Documents with clean summary and descriptions and their composed ``text``; other columns pass through."""
    clean = lambda fields: F.transform(F.coalesce(fields, F.array()), lambda f: f.withField("description", clean_text(f["description"])))
    done = docs.withColumns({"summary": clean_text("summary"), "description": clean_text("description"), "params": clean(F.col("params")), "body": clean(F.col("body"))})
    return done.withColumn("text", composed_text(F.col("method"), F.col("path"), F.col("summary"), F.col("description"), F.concat("params", "body")))
