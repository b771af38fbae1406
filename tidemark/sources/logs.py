"""Logs of runs as rows: statistics lines read out of text, durations brought to one unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a run writes its header, statistics, hits and graph.
HEADER = r"config=(\S+)\s+select=(\S+)"
STATS = r"N=(\d+)\s+candidatos=(\d+)\s+comparações=(\d+)\s+seleção=\S+\s+carga=(\S+)\s+índice=(\S+)\s+mem=(\d+)kB\s+consulta=(\S+)"
HIT = r"(?m)^\s*\d+\. (\S+)"
GRAPH = r"grafo: V=(\d+)\s+E=(\d+)\s+construção=(\S+)\s+expansão=(\S+)\s+visitados=(\d+)\s+arestas=(\d+)\s+relacionadas=(\d+)\s+expansão_tempo=(\S+)"
PLAN = r"planos=(\d+)\s+pré_requisitos=(\d+)\s+plano_arestas=(\d+)\s+plano_tempo=(\S+)"
RELATED = r"(?m)^\s+custo=\S+\s+(\S+)"
SECTIONS = ["\nrelacionadas pelo grafo", "\nplano de chamadas"]
HIT_LINE, DETAIL, LOGGED_HITS = r"^\s*\d+\. ", "    ", 5
_US = {"ns": 1e-3, "µs": 1.0, "ms": 1e3, "s": 1e6}


def duration(c: Column | str, unit: str = "us") -> Column:
    """A duration such as ``1.5ms`` in microseconds (or ``ms``), as text with 3 decimals; another suffix gives 0."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    value, suffix = F.regexp_extract(c, r"^(\d+(?:\.\d*)?|\.\d+)", 1), F.regexp_replace(c, r"^[0-9.]+", "")
    factor = F.lit(0.0)
    for name, us in _US.items():
        factor = F.when(suffix == name, F.lit(us / 1e3 if unit == "ms" else us)).otherwise(factor)
    return F.format_string("%.3f", F.coalesce(value.try_cast("double"), F.lit(0.0)) * factor)


def parse_runs(df: DataFrame, output: str, relevant: str, k: str) -> DataFrame:
    """The rows whose output has a header and statistics, with them as columns; other columns pass through."""
    out = F.coalesce(F.col(output), F.lit(""))
    stat = lambda pattern, n: F.regexp_extract(out, pattern, n)
    section = F.split_part(F.split_part(out, F.lit(SECTIONS[0]), F.lit(1)), F.lit(SECTIONS[1]), F.lit(1))
    ids = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    rows = df.where(out.rlike(HEADER) & out.rlike(STATS)).withColumns({"hit_ids": ids(section, HIT), "related_ids": ids(out, RELATED)})
    has_graph, has_plan = out.rlike(GRAPH), out.rlike(GRAPH + r"\s+" + PLAN)
    g = lambda n: F.when(has_graph, stat(GRAPH, n)).otherwise("")
    p = lambda n: F.when(has_plan, stat(PLAN, n)).otherwise("")
    gold = F.coalesce(F.col(relevant), F.array().cast("array<string>"))
    rank = F.coalesce(F.array_min(F.filter(F.transform("hit_ids", lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda x: x.isNotNull())), F.lit(0))
    near = F.size(F.filter(F.slice("hit_ids", 1, F.greatest(F.col(k), F.lit(0))), lambda x: F.array_contains(gold, x)))
    return rows.select(
        *[c for c in df.columns], stat(HEADER, 1).alias("config"), stat(HEADER, 2).alias("selection"), stat(STATS, 1).alias("n"), stat(STATS, 2).alias("candidates"), stat(STATS, 3).alias("comparisons"),
        duration(stat(STATS, 4), "ms").alias("load_ms"), duration(stat(STATS, 5)).alias("index_us"), stat(STATS, 6).alias("mem_kb"), duration(stat(STATS, 7)).alias("query_us"),
        rank.alias("rank"), F.when(F.col(k) > 0, near / F.col(k)).otherwise(0.0).alias("precision"),
        g(1).alias("vertices"), g(2).alias("edges"), F.when(has_graph, duration(stat(GRAPH, 3))).otherwise("").alias("build_us"), g(4).alias("expand"), g(5).alias("visited"), g(6).alias("scanned"), g(7).alias("related"),
        F.when(has_graph, duration(stat(GRAPH, 8))).otherwise("").alias("expand_us"), ((rank > 0) | (has_graph & F.arrays_overlap("related_ids", gold))).alias("found_expanded"),
        p(1).alias("plans"), p(2).alias("prerequisites"), p(3).alias("plan_edges"), F.when(has_plan, duration(stat(PLAN, 4))).otherwise("").alias("plan_us"),
    )


def trimmed(output: Column | str, keep: int = LOGGED_HITS) -> Column:
    """An output with only its first ``keep`` hits (a line and its detail each) before the graph sections."""
    out = F.coalesce(F.col(output) if isinstance(output, str) else output, F.lit(""))
    lines = F.split(out, "\n")
    marks = F.transform(lines, lambda x, i: F.when(x.startswith(SECTIONS[0][1:]) | x.startswith(SECTIONS[1][1:]), i))
    end = F.coalesce(F.array_min(F.filter(marks, lambda m: m.isNotNull())), F.size(lines))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("hits"), F.lit(0).alias("hidden"), F.lit(0).alias("at"))

    def step(s: Column, line: Column) -> Column:
        inside = s["at"] < end
        hits = s["hits"] + F.when(inside & line.rlike(HIT_LINE), 1).otherwise(0)
        hide = inside & (hits > keep) & (line.rlike(HIT_LINE) | line.startswith(DETAIL))
        return F.struct(F.when(hide, s["kept"]).otherwise(F.array_append(s["kept"], line)).alias("kept"), hits.alias("hits"), (s["hidden"] + F.when(hide, 1).otherwise(0)).alias("hidden"), (s["at"] + 1).alias("at"))

    note = lambda s: F.when(s["hidden"] > 0, F.array_append(s["kept"], F.format_string("... (%d resultados omitidos do log; contagem completa no CSV)", F.floor(s["hidden"] / 2)))).otherwise(s["kept"])
    return F.aggregate(lines, start, step, lambda s: F.array_join(note(s), "\n"))
