"""Quality of rankings and of answers, against a gold set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calls import HOST, answer_calls, match_calls

_NONE = "array<string>"


def evaluated(hits: DataFrame, gold: DataFrame, k: int, counts: DataFrame | None = None) -> DataFrame:
    """(qid, rank, precision, candidates): for each gold query (qid, relevant) the place of its first relevant hit.

    hits are (qid, rank, id). rank is 0 if no relevant document is among them; precision is the relevant ones among
    the first k, over k (0 if k is 0 or less). candidates comes from counts (qid, candidates), else from the hits.
    """
    rows = gold.select("qid", F.coalesce("relevant", F.array().cast(_NONE)).alias("relevant"))
    wanted = rows.select("qid", F.explode(F.array_distinct("relevant")).alias("id"))
    found = hits.select("qid", "rank", "id").join(wanted, ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("rank"), F.count_if(F.col("rank") <= k).alias("near"))
    seen = counts if counts is not None else hits.groupBy("qid").agg(F.count(F.lit(1)).alias("candidates"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    precision = F.lit(0.0) if k <= 0 else zero(F.col("near")) / F.lit(float(k))
    return rows.select("qid").join(found, "qid", "left").join(seen.select("qid", "candidates"), "qid", "left").select("qid", zero("rank").alias("rank"), precision.alias("precision"), zero("candidates").alias("candidates"))


def summary(results: DataFrame, k: int) -> DataFrame:
    """(queries, hits_at_k, empty, mean_precision, mean_rank) over all results; zeros without any."""
    rank = F.nullif(F.col("rank"), F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return results.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("rank").between(1, k)).alias("hits_at_k"), F.count_if(F.col("candidates") == 0).alias("empty"),
        zero(F.avg("precision")).alias("mean_precision"), zero(F.avg(rank)).alias("mean_rank"),
    )


def found_expanded(results: DataFrame, related: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, found): whether a relevant document is among the hits or the related operations (qid, id)."""
    wanted = gold.select("qid", F.explode(F.array_distinct("relevant")).alias("id"))
    more = related.join(wanted, ["qid", "id"], "left_semi").select("qid").distinct().withColumn("more", F.lit(True))
    return results.join(more, "qid", "left").select("qid", ((F.col("rank") > 0) | F.coalesce("more", F.lit(False))).alias("found"))


def context_ids(results: Column, related: Column, plans: Column) -> Column:
    """The ids that went into a context: results, related, steps of plans (a list of lists), first occurrences."""
    none = F.array().cast(_NONE)
    return F.array_distinct(F.concat(F.coalesce(results, none), F.coalesce(related, none), F.coalesce(F.flatten(plans), none)))


def cited_operations(calls: DataFrame, docs: DataFrame) -> DataFrame:
    """(method, path, id), distinct: the calls with the ids of all documents they fit."""
    return match_calls(calls, docs, "id")


def scored_answers(df: DataFrame, docs: DataFrame, *, key: str = "record_id", answer: str = "resposta", relevant: str = "relevantes", needed: str = "pre_requisitos", context: str = "contexto", host: str = HOST) -> DataFrame:
    """(key, cited, invented, in_context, correct, needs_before, cited_before, context_use) of every answer.

    cited are its calls in order, invented those no document fits. correct: a relevant operation is cited, or, if
    none is relevant, no call at all. cited_before: correct, something is needed, and of each step one operation is
    cited. Distinct calls are matched with the catalogue once for all answers.
    """
    none = F.array().cast(_NONE)
    rows = df.select(F.col(key).alias("key"), answer_calls(answer, host).alias("calls"), F.coalesce(relevant, none).alias("relevant"), F.coalesce(needed, F.array().cast("array<array<string>>")).alias("needed"), F.coalesce(context, none).alias("context"))
    written = rows.select("key", F.posexplode("calls").alias("at", "c")).select("key", "at", "c.method", "c.path")
    fits = cited_operations(written, docs)
    # which of the ids an answer is judged by are cited: only those are gathered, so common calls stay small
    judged = rows.select("key", F.explode(F.array_distinct(F.concat("relevant", F.flatten("needed")))).alias("id"))
    hit = written.join(fits, ["method", "path"]).join(judged, ["key", "id"]).groupBy("key").agg(F.collect_set("id").alias("ids"))
    known = fits.select("method", "path").distinct().withColumn("known", F.lit(True))
    told = written.join(known, ["method", "path"], "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", F.concat_ws(" ", "method", "path").alias("call"), F.coalesce("known", F.lit(False)).alias("known")))).alias("told"))
    j = rows.join(hit, "key", "left").join(told, "key", "left").withColumns({"ids": F.coalesce("ids", none), "told": F.coalesce("told", F.array().cast("array<struct<at:int,call:string,known:boolean>>"))})
    cited, invented = F.col("told.call"), F.transform(F.filter("told", lambda t: ~t["known"]), lambda t: t["call"])
    asked = F.size("relevant") > 0
    correct = F.when(asked, F.arrays_overlap("relevant", "ids")).otherwise(F.size("calls") == 0)
    needs = F.size("needed") > 0
    before = needs & correct & F.forall("needed", lambda step: F.arrays_overlap(step, F.col("ids")))
    inside = F.arrays_overlap("relevant", "context")
    use = F.when(~asked, "").when(correct & inside, "trouxe_e_usou").when(correct, "de_memoria").when(inside, "trouxe_e_nao_usou").otherwise("busca_falhou")
    sure = lambda c: F.coalesce(c, F.lit(False))
    return j.select("key", cited.alias("cited"), invented.alias("invented"), sure(inside).alias("in_context"), sure(correct).alias("correct"), needs.alias("needs_before"), sure(before).alias("cited_before"), use.alias("context_use")).withColumnRenamed("key", key)


def rescored(df: DataFrame, gold: DataFrame, docs: DataFrame, *, question: str = "pergunta", **columns: str) -> DataFrame:
    """``scored_answers`` with the relevant and needed operations of the gold set (question, relevant, needed).

    An answer to a question outside the gold set is an error.
    """
    one = gold.groupBy(F.col("question").alias(question)).agg(F.max(F.struct("relevant", "needed")).alias("g"))
    both = df.drop("relevantes", "pre_requisitos").join(one, question, "left")
    message = F.concat(F.lit("question outside the gold set: "), F.coalesce(question, F.lit("null")))
    both = both.withColumn("relevantes", F.when(F.col("g").isNull(), F.raise_error(message).cast("array<string>")).otherwise(F.col("g.relevant")))
    return scored_answers(both.withColumn("pre_requisitos", F.col("g.needed")), docs, **columns)
