"""Calls written in free text, and the templates of a catalogue that they fit."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import segments

# Methods, and how a call is written.
METHODS = "GET|POST|PUT|PATCH|DELETE"
PLAIN = rf"\b({METHODS})[\t\n\f\r ]+(/[^\t\n\f\r `)\]*,\"']+)"
SHOWN = rf"\b({METHODS})\s+(/[^\s`)\]*,]+)"
HOST = "api.kelpforge.example"


def _curl(host: str) -> str:
    url = rf"https?://{re.escape(host)}(/[^\t\n\f\r \"'`)?]+)"
    return rf"(?:-X[\t\n\f\r ]*|--request[\t\n\f\r ]+)({METHODS})\b[^\n]{{0,120}}?{url}|{url}[^\n]{{0,60}}?-X[\t\n\f\r ]*({METHODS})"


def answer_calls(answer: Column | str, host: str = HOST) -> Column:
    """ARRAY<STRUCT<method, path>> of the calls of an answer: plain ones, then curl commands, first occurrences.

    The query part of a path and trailing ``.:;`` are cut off. Null holds no call.
    """
    text = F.coalesce(F.col(answer) if isinstance(answer, str) else answer, F.lit(""))
    groups = lambda pattern, n: F.regexp_extract_all(text, F.lit(pattern), F.lit(n))
    own = lambda m, p: F.struct(m.alias("method"), F.regexp_replace(F.split(p, "[?]")[0], "[.:;]+$", "").alias("path"))
    curl = _curl(host)
    plain = F.zip_with(groups(PLAIN, 1), groups(PLAIN, 2), own)
    either = lambda a, b: F.zip_with(groups(curl, a), groups(curl, b), lambda x, y: F.when(x != "", x).otherwise(y))
    return F.array_distinct(F.concat(plain, F.zip_with(either(1, 4), either(2, 3), own)))


def answered_endpoint(answer: Column | str) -> Column:
    """The first ``METHOD /path`` of an answer, null if it has none."""
    text = F.coalesce(F.col(answer) if isinstance(answer, str) else answer, F.lit(""))
    method, path = (F.regexp_extract(text, SHOWN, n) for n in (1, 2))
    return F.when(method != "", F.concat_ws(" ", method, path))


def fits(template: Column, path: Column) -> Column:
    """Whether a path (as segments) fits a template (as segments): as many, each equal unless the template's is a slot."""
    same = F.zip_with(template, path, lambda t, p: t.startswith("{") | F.coalesce(t == p, F.lit(False)))
    return (F.size(template) == F.size(path)) & F.forall(same, lambda x: x)


def split_path(path: Column | str) -> Column:
    """Segments to be matched: the empty path has one, empty, segment."""
    found = segments(path)
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def match_calls(calls: DataFrame, catalogue: DataFrame, *carry: str) -> DataFrame:
    """(method, path, *carry), distinct: calls (method, path) with ``carry`` columns of the catalogue rows they fit.

    Every template makes a key of its segments with ``{`` for slots; a call makes one key for each arrangement of
    slots that templates of its length and method have. So an equi-join on few, short keys replaces comparing
    every call with every template. The table of arrangements grows with the shapes of the catalogue only.
    """
    rows = catalogue.select(F.upper("method").alias("method"), split_path("path").alias("t"), *carry).where("method is not null")
    slots = F.transform("t", lambda s: s.startswith("{"))
    rows = rows.select("method", slots.alias("slots"), F.array_join(F.transform("t", lambda s: F.when(s.startswith("{"), "{").otherwise(s)), "/").alias("key"), *carry).distinct()
    shapes = rows.select("method", "slots").distinct().withColumn("size", F.size("slots"))
    asked = calls.select("method", "path").distinct().select("*", F.upper("method").alias("m"), split_path("path").alias("p"))
    keys = asked.withColumn("size", F.size("p")).join(shapes.withColumnRenamed("method", "m"), ["m", "size"])
    keys = keys.select("method", "path", "m", "slots", F.array_join(F.zip_with("p", "slots", lambda s, w: F.when(w, "{").otherwise(s)), "/").alias("key"))
    return keys.join(rows.withColumnRenamed("method", "m"), ["m", "slots", "key"]).select("method", "path", *carry).distinct()
