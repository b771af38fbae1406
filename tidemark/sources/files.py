"""Files in and out: documents and gold questions as JSON, the manifest, and CSV reports."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELD = "ARRAY<STRUCT<name: STRING, `in`: STRING, required: BOOLEAN, description: STRING>>"
DOCUMENT = f"id STRING, method STRING, path STRING, summary STRING, description STRING, category STRING, params {FIELD}, body {FIELD}, deprecated BOOLEAN, docs_url STRING, text STRING"
GOLD = "pergunta STRING, query STRING, relevant ARRAY<STRING>, prerequisites ARRAY<ARRAY<STRING>>"


def resolve(path: str, root: str, marker: str = "pyproject.toml") -> str:
    """An absolute path or URI as it is; another one below the folder, ``root`` or above it, that has the marker."""
    if "://" in path or Path(path).is_absolute():
        return path
    here = Path(root).absolute()
    base = next((p for p in (here, *here.parents) if (p / marker).exists()), here)
    return str(base / path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a JSON-lines file; a line that can't be read fails the job; null lists of fields stay null."""
    return spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(path)


def write_documents(docs: DataFrame, path: str, order: str = "doc_pos") -> None:
    """JSON lines in order of ``order``, one file per range of it, named so that files sort as their lines do."""
    docs.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").json(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions, a JSON array."""
    return spark.read.schema(GOLD).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A report with a header; quotes inside a quoted value are doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def csv_quoted(c: Column | str) -> Column:
    """A value as a CSV field: in quotes, inner quotes doubled, if it has a comma, a quote or a line break."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def string_quoted(c: Column | str) -> Column:
    """A value as a quoted string literal, with backslash escapes."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), c, F.lit('"'))


def csv_line(*columns: Column) -> Column:
    """One line of a report: values as text, null as the empty string."""
    return F.array_join(F.array(*[csv_quoted(c.cast("string")) for c in columns]), ",")


def manifest(docs: DataFrame, words: DataFrame, title: str, version: str, license_name: str, stage_ms: dict[str, float], generated_at: str) -> DataFrame:
    """(manifest): one JSON value about an ingest; ``words`` is its word statistics."""
    count = docs.agg(F.count(F.lit(1)).alias("docs"))
    stages = F.create_map(*[F.lit(x) for kv in stage_ms.items() for x in kv]) if stage_ms else F.create_map().cast("map<string,double>")
    body = F.struct(
        F.lit(title).alias("spec"), F.lit(version).alias("version"), F.lit(license_name).alias("license"), "docs", F.col("total").alias("words"),
        F.struct("min", "median", "mean", "max").alias("words_per_doc"), stages.alias("stage_ms"), F.lit(generated_at).alias("generated_at"),
    )
    return words.crossJoin(F.broadcast(count)).select(F.to_json(body).alias("manifest"))
