"""The text blocks a search is shown as: results, related operations, call plans, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate
from ..sources.files import string_quoted

# What is said where there is nothing to show, and the heads of the blocks.
NO_TERMS = "The query has no searchable terms after normalization. Rephrase it with concrete words (resource name and action)."
NO_MATCH = "No API operation matches {}. Try other words for the resource or the action."
RESULTS_HEAD = "{} REST API operations for {}, most relevant first:\n\n"
RELATED_HEAD = "Related operations (same resources as the results above, not ranked by the search):\n\n"
PLANS_HEAD = "Call order (prerequisites first; earlier calls return the ids used by later ones):\n\n"


def _fill(pattern: str, *parts: Column) -> Column:
    bits = pattern.split("{}")
    return F.concat(F.lit(bits[0]), *[x for p, b in zip(parts, bits[1:]) for x in (p, F.lit(b))])


def _blocks(df: DataFrame, order: str, block: Column, name: str) -> DataFrame:
    """(qid, name): the blocks of each query in order; their number is bounded by k."""
    return df.select("qid", F.struct(F.col(order).alias("o"), block.alias("b")).alias("x")).groupBy("qid").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("qid", F.array_join(F.col("xs.b"), "").alias(name), F.size("xs").alias("n"))


def rendered(queries: DataFrame, context: DataFrame, most_bytes: int = 0) -> DataFrame:
    """(qid, shown): for every query (qid, query, empty_query) its hits (with_context) as text."""
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    block = _fill("[{}] {} {}\n{}\nDocs: {}\n\n", F.col("rank").cast("string"), none("method"), none("path"), truncate("text", most_bytes), none("docs_url"))
    both = queries.join(_blocks(context, "rank", block, "body"), "qid", "left")
    quoted = string_quoted("query")
    shown = F.when(F.col("empty_query"), NO_TERMS).when(F.col("n").isNull(), _fill(NO_MATCH, quoted)).otherwise(F.concat(_fill(RESULTS_HEAD, F.col("n").cast("string"), quoted), F.col("body")))
    return both.select("qid", shown.alias("shown"))


def rendered_related(related: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, shown) of related operations (qid, pos, id); docs has one row an id."""
    rows = related.join(docs.select("id", "method", "path", "summary", "docs_url"), "id")
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    line = _fill("- {} {}: {}. Docs: {}\n", *map(none, ("method", "path", "summary", "docs_url")))
    return _blocks(rows, "pos", line, "body").select("qid", F.concat(F.lit(RELATED_HEAD), "body", F.lit("\n")).alias("shown"))


def rendered_plans(plans: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, shown) of plans (qid, rank, steps) with a prerequisite; docs has one row an id."""
    steps = plans.where(F.size("steps") > 1).select("qid", "rank", F.size("steps").alias("all"), F.posexplode("steps").alias("at", "id"))
    named = steps.join(docs.select("id", F.concat_ws(" ", "method", "path").alias("call")), "id")
    one = named.groupBy("qid", "rank").agg(F.array_sort(F.collect_list(F.struct("at", "call"))).alias("cs"))
    lines = F.array_join(F.transform("cs", lambda c: F.concat(F.lit("  "), (c["at"] + 1).cast("string"), F.lit(". "), c["call"], F.lit("\n"))), "")
    block = F.concat(_fill("For [{}] {}:\n", F.col("rank").cast("string"), F.element_at("cs", -1)["call"]), lines, F.lit("\n"))
    return _blocks(one, "rank", block, "body").select("qid", F.concat(F.lit(PLANS_HEAD), "body").alias("shown"))
