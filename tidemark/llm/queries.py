"""Queries of the training-data operators: (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .distinct import chosen_terms, distinctive_terms, record_text
from .leak import leaks
from .lookalike import lookalike_classes, lookalike_pairs, with_form
from .markup import clean_markup
from .mix import mix
from .pairs import broken_pairs
from .split import oversized, split_column
from .terms import term_counts
from .topn import top_n_per_group

LEAK_WORDS = 12
RECORD_TEXT = ("summary", "path", "description", "params")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = broken_pairs(table(spark, d, "llm_records"), "record_id", "pergunta", "resposta", table(spark, d, "raw_documents"))
    return found.withColumnRenamed("record", "record_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = oversized(table(spark, d, "raw_documents"), "doc_pos", "text")
    return found.select(F.col("key").cast("bigint").alias("doc_pos"), F.when(F.col("long_run"), "forced").otherwise("boundary").alias("cut"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_column(table(spark, d, "raw_documents"), "doc_pos", "text", small=True)
    return pieces.withColumn("doc_pos", F.col("key").cast("bigint")).drop("key", "text_no", "long_run")


def p2_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """(doc_pos, digest, within, shared): the digest of each large text put together from its pieces, whether all are within the limit and share 100 characters."""
    pieces = split_column(table(spark, d, "raw_documents"), "doc_pos", "text")
    whole = F.array_sort(F.collect_list(F.struct("piece_no", "piece_start", "piece_end", "piece")))
    rows = pieces.groupBy(F.col("key").cast("bigint").alias("doc_pos")).agg(whole.alias("ps"), F.max(F.char_length("piece")).alias("longest"))
    text = F.aggregate("ps", F.lit(""), lambda s, p: F.concat(s, p["piece"].substr(F.when(p["piece_no"] == 1, 1).otherwise(101), F.lit(1 << 30))))
    shared = F.forall(F.transform("ps", lambda p, i: (i == 0) | ((F.get("ps", i - 1)["piece_end"] - p["piece_start"] == 100) & (F.get("ps", i - 1)["piece"].substr(F.lit(-100), F.lit(100)) == F.left(p["piece"], F.lit(100))))), lambda x: x)
    return rows.select("doc_pos", F.md5(text).alias("digest"), (F.col("longest") <= 2000).alias("within"), shared.alias("shared"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_terms(spark, d).where("mark is not null").select("term", "mark")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_counts(table(spark, d, "raw_documents"), ["summary", "description"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n_per_group(table(spark, d, "hits"), "query_text", "id", "score", "len").select(F.col("grp").alias("query_text"), F.col("item").alias("id"))


def p4_ranked(spark: SparkSession, d: str) -> DataFrame:
    best = top_n_per_group(table(spark, d, "hits"), "query_text", "id", "score", "len")
    return best.select(F.col("grp").alias("query_text"), F.col("rank").cast("bigint").alias("rank"), F.col("item").alias("id"), "score", F.col("len").alias("len"))


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    return clean_markup(table(spark, d, "raw_documents"), "doc_pos", ["description", "text"]).withColumnRenamed("key", "doc_pos")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d).where("pieces > 0").select("doc_pos", "field")


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    """The clean text of both fields of every row, with the kinds of its blocks and the notations found."""
    return _cleaned(spark, d)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The set the bounds on frequency choose. No score takes part in it: the scores are p7_scores."""
    found = chosen_terms(table(spark, d, "raw_documents"), "doc_pos", record_text(*RECORD_TEXT), least_tf=3, least_df=2, most_df=8)
    return found.select(F.col("key").alias("doc_pos"), "term")


def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = distinctive_terms(table(spark, d, "raw_documents"), "doc_pos", record_text(*RECORD_TEXT))
    return scored.select(F.col("key").alias("doc_pos"), "term", F.col("tf").cast("bigint").alias("tf"), "df", F.round("score", 6).alias("score"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where(F.col("longest") >= LEAK_WORDS).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Also reordered passages: items of which half the words lie in tiles of the document."""
    found = _leaks(spark, d).where((F.col("longest") >= LEAK_WORDS) | (F.col("coverage") >= 0.5))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "longest", "tiles", "covered", "item_words", F.round("coverage", 6).alias("coverage"))


def _mix(spark: SparkSession, d: str, **how: bool) -> tuple[DataFrame, DataFrame]:
    return mix(table(spark, d, "documents"), "doc_id", "source", "text", table(spark, d, "mix_targets"), **how)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0].withColumnRenamed("key", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p9_shares_all_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The report of a mix as large as all documents with a target: small sources fall short of their share."""
    return _mix(spark, d, all_tokens=True)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(table(spark, d, "documents"), "doc_id", "text").withColumnsRenamed({"key_a": "doc_id_a", "key_b": "doc_id_b"})


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row for each document with a look-alike, with the least document of its look and of its spelling."""
    return lookalike_classes(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    return with_form(table(spark, d, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "form", (F.col("form") != F.col("text")).alias("changed"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for name, f in list(globals().items()) if name[0] == "p" and name[1:2].isdigit()}
