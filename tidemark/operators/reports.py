"""Run statistics, scenarios, and the rows behind the views of a search."""

from __future__ import annotations

import os
import platform
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calls import answered_endpoint

# The scenarios of a benchmark, the conditions of an experiment, and the order of methods in a tree.
SIZES, SWEEP, HALF, REPETITIONS, GRAPH_REPETITIONS = (0, 612), (5, 50, 500, 1224), 612, 2, 3
CONDITIONS = [("A", 5, 0, 0, False), ("B", 5, 5, 3, False), ("C", 10, 0, 0, False), ("D", 5, 0, 0, True)]
METHOD_ORDER = ("GET", "POST", "PUT", "PATCH", "DELETE")


def _settings(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few rows of settings, in one partition."""
    return spark.createDataFrame(rows, ddl).coalesce(1)


def scenario_matrix(spark: SparkSession) -> DataFrame:
    """(name, preset, select, order_strategy, k, limit, repetitions): presets by size, and all selections by k; distinct."""
    presets = _settings(spark, [(p,) for p in (1, 2, 3)], "preset int")
    sizes = _settings(spark, [(n,) for n in SIZES], "limit int")
    ks = _settings(spark, [(k,) for k in SWEEP], "k int")
    ways = _settings(spark, [(f"preset{p}", p, "", "") for p in (1, 2, 3)] + [("heap", 0, "heap", "")] + [(f"sort_{s}", 0, "sort", s) for s in ("quick", "std")], "way string, preset int, select string, order_strategy string")
    size = F.when(F.col("limit") == 0, "full").otherwise(F.concat(F.lit("n"), F.col("limit").cast("string")))
    required = presets.crossJoin(sizes).select(F.concat(F.lit("preset"), F.col("preset").cast("string"), F.lit("_"), size, F.lit("_k5")).alias("name"), "preset", F.lit("").alias("select"), F.lit("").alias("order_strategy"), F.lit(5).alias("k"), "limit")
    swept = ways.crossJoin(ks).select(F.concat("way", F.lit("_full_k"), F.col("k").cast("string")).alias("name"), "preset", "select", "order_strategy", "k", F.lit(0).alias("limit"))
    return required.unionByName(swept).dropDuplicates(["name"]).withColumn("repetitions", F.lit(REPETITIONS))


def graph_scenarios(spark: SparkSession) -> DataFrame:
    """(name, preset, k, limit, repetitions, expand, hops, budget, plan): each way through the graph by size."""
    ways = _settings(spark, [("base", "", False), ("bfs", "bfs", False), ("dijkstra", "dijkstra", False), ("plan", "", True)], "way string, expand string, plan boolean")
    sizes = _settings(spark, [(n,) for n in SIZES], "limit int")
    size = F.when(F.col("limit") == 0, "full").otherwise(F.concat(F.lit("n"), F.col("limit").cast("string")))
    return ways.crossJoin(sizes).select(F.concat_ws("_", F.lit("grafo"), "way", size).alias("name"), F.lit(2).alias("preset"), F.lit(5).alias("k"), "limit", F.lit(GRAPH_REPETITIONS).alias("repetitions"), "expand", F.lit(3).alias("hops"), F.lit(3.0).alias("budget"), "plan")


def run_count(scenarios: DataFrame, queries: int) -> DataFrame:
    return scenarios.agg((F.coalesce(F.sum("repetitions"), F.lit(0)) * queries).alias("runs"))


def conditions(spark: SparkSession, names: str = "A,B,C,D") -> DataFrame:
    """(name, k, related, hops, plan) of the named conditions."""
    wanted = [n.strip() for n in names.split(",")]
    return spark.createDataFrame([c for c in CONDITIONS if c[0] in wanted], "name string, k int, related int, hops int, plan boolean")


def hardware(spark: SparkSession, root: str = "/proc") -> DataFrame:
    """(cpu, cores, memory_gib, os): the machine of the driver, one row; what can't be read is null."""

    def told(name: str, key: str) -> str | None:
        try:
            lines = Path(root, name).read_text().splitlines()
        except OSError:
            return None
        return next((x.split(":", 1)[1].strip() for x in lines if x.split(":", 1)[0].strip() == key), None)

    kb = told("meminfo", "MemTotal")
    row = (told("cpuinfo", "model name"), os.cpu_count(), round(int(kb.split()[0]) / 2**20, 1) if kb else None, platform.system().lower())
    return spark.createDataFrame([row], "cpu string, cores int, memory_gib double, os string")


def run_statistics(runs: DataFrame) -> DataFrame:
    """(cenario, runs, found, mean_rank, median_us, min_us, max_us) of every scenario; nulls don't count."""
    place = F.when(F.col("posicao") > 0, F.col("posicao"))
    return runs.groupBy("cenario").agg(F.count(F.lit(1)).alias("runs"), F.count(place).alias("found"), F.avg(place).alias("mean_rank"), F.median("consulta_us").alias("median_us"), F.min("consulta_us").alias("min_us"), F.max("consulta_us").alias("max_us"))


def score_bars(hits: DataFrame, group: str = "qid") -> DataFrame:
    """The hits with ``bar``, their score in percent of the best of their group; a best score of 0 counts as 1.

    The best score is grouped first and joined, so that a large group isn't one task.
    """
    best = hits.groupBy(group).agg(F.max("score").alias("_best"))
    top = F.coalesce(F.nullif(F.col("_best"), F.lit(0.0)), F.lit(1.0))
    return hits.join(best, group).withColumn("bar", 100 * F.col("score") / top).drop("_best")


def time_share(search_us: Column, graph_us: Column, model_ms: Column) -> Column:
    """Search and graph in percent of the whole time; null if nothing took time."""
    own = F.coalesce(search_us, F.lit(0)) + F.coalesce(graph_us, F.lit(0))
    return 100 * own / F.nullif(own + F.coalesce(model_ms, F.lit(0)) * 1000, F.lit(0))


def earlier_questions(turns: DataFrame, conversation: str, turn: str, role: str, text: str, last: int = 5) -> DataFrame:
    """(conversation, turn, earlier): for each turn the last user questions before it, joined by `` | ``; '' without any.

    Only user turns are windowed; a turn of another role looks up the count of user turns before it.
    """
    rows = turns.select(F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), (F.coalesce(F.col(role), F.lit("")) == "user").alias("asks"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    before = W.partitionBy("conversation").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("n", F.coalesce(F.sum(F.col("asks").cast("int")).over(before), F.lit(0)))
    asked = placed.where("asks")
    joined = asked.select("conversation", F.col("n").alias("_n"), F.collect_list("text").over(W.partitionBy("conversation").orderBy("turn").rowsBetween(1 - last, 0)).alias("texts"))
    got = placed.join(joined.withColumn("n", F.col("_n") + 1).drop("_n"), ["conversation", "n"], "left")
    lead = F.lit("Earlier questions in this conversation, for context only: ")
    return got.select("conversation", "turn", F.when(F.col("texts").isNull(), "").otherwise(F.concat(lead, F.array_join("texts", " | "), F.lit("\n\n"))).alias("earlier"))


def tree_operations(results: DataFrame, related: DataFrame, plans: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """(qid, method, path, rank, score, hops, prerequisite, answer): what a search gave, one row per method and path.

    results are (qid, method, path, rank, score), related (qid, method, path, hops), plans the prerequisites
    (qid, method, path), answers (qid, answer) the text whose first endpoint is marked.
    """
    blank = {"rank": "int", "score": "double", "hops": "int", "prerequisite": "boolean"}
    fill = lambda df, **own: df.select("qid", F.upper("method").alias("method"), "path", *[(own.get(c, F.lit(None))).cast(t).alias(c) for c, t in blank.items()])
    every = fill(results, rank=F.col("rank"), score=F.col("score")).unionByName(fill(related, hops=F.col("hops"))).unionByName(fill(plans, prerequisite=F.lit(True)))
    last = every.groupBy("qid", "method", "path").agg(F.max("rank").alias("rank"), F.max("score").alias("score"), F.max("hops").alias("hops"), F.coalesce(F.max("prerequisite"), F.lit(False)).alias("prerequisite"))
    if answers is None:
        return last.withColumn("answer", F.lit(False))
    told = answers.groupBy("qid").agg(F.max(answered_endpoint("answer")).alias("_told"))
    return last.join(told, "qid", "left").withColumn("answer", F.coalesce(F.concat_ws(" ", "method", "path") == F.col("_told"), F.lit(False))).drop("_told")


def tree_rows(ops: DataFrame) -> DataFrame:
    """(qid, prefix, kind, depth, label, method): the rows of a tree of paths, in order of (prefix, kind, place).

    Resources with no operation and a single child are joined with it into one label, ``/a/b``; kind is 0 for such
    a segment and 1 for an operation. ops are (qid, method, path). Segments are compared without empty ones.
    """
    segs = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = ops.select("qid", "method", segs.alias("whole")).distinct()
    nodes = rows.select("qid", "whole", F.explode(F.sequence(F.lit(1), F.greatest(F.size("whole"), F.lit(1)))).alias("n")).where(F.size("whole") > 0).select("qid", F.slice("whole", 1, F.col("n")).alias("prefix")).distinct()
    own = rows.groupBy("qid", F.col("whole").alias("prefix")).agg(F.count(F.lit(1)).alias("ops"))
    inner = nodes.groupBy("qid", F.slice("prefix", 1, F.size("prefix") - 1).alias("prefix")).agg(F.count(F.lit(1)).alias("children"))
    known = nodes.join(own, ["qid", "prefix"], "left").join(inner, ["qid", "prefix"], "left")
    shown = known.where((F.coalesce("ops", F.lit(0)) > 0) | (F.coalesce("children", F.lit(0)) != 1)).select("qid", "prefix")
    # the shown resources above each: how many, and how long the nearest is
    up = shown.select("qid", "prefix", F.explode(F.sequence(F.lit(1), F.size("prefix"))).alias("n")).select("qid", F.col("prefix").alias("of"), F.slice("prefix", 1, F.col("n")).alias("prefix"), "n")
    above = up.join(shown, ["qid", "prefix"]).where(F.size("of") > F.col("n")).groupBy("qid", F.col("of").alias("prefix")).agg(F.count(F.lit(1)).alias("depth"), F.max("n").alias("from"))
    placed = shown.join(above, ["qid", "prefix"], "left").select("qid", "prefix", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("from", F.lit(0)).alias("from"))
    part = F.concat(F.lit("/"), F.array_join(F.slice("prefix", F.col("from") + 1, F.size("prefix") - F.col("from")), "/"))
    segments = placed.select("qid", "prefix", F.lit(0).alias("kind"), F.col("depth").cast("int").alias("depth"), part.alias("label"), F.lit(None).cast("string").alias("method"))
    leaves = rows.withColumnRenamed("whole", "prefix").join(placed, ["qid", "prefix"]).select("qid", "prefix", F.lit(1).alias("kind"), (F.col("depth") + 1).cast("int").alias("depth"), F.concat(F.lit("/"), F.array_join("prefix", "/")).alias("label"), "method")
    return segments.unionByName(leaves)


def method_place(method: Column) -> Column:
    """The place of a method among the operations of a resource; unknown ones come first."""
    return F.array_position(F.array(*map(F.lit, METHOD_ORDER)), method)
