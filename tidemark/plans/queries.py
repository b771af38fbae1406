"""All queries outside the training-data subpackage: (spark, sf_dir) -> DataFrame, each over its whole tables.

The catalogue is raw_documents; the queries searched for are the distinct llm_records.consulta, their gold sets the
relevantes and pre_requisitos of their records. Scores are rounded to 6 decimals, ranked by 9.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calls import answer_calls, answered_endpoint, match_calls
from ..functions.text import clean_query, clean_text, is_looping, language_order, path_words, tokens, truncate, word_count
from ..operators import corpus, evaluate, graph, render, reports, traverse
from ..operators.nested import body_fields, enclose, label_nodes, node_table
from ..operators.search import Engine, Options, ranked, with_context
from ..session import checkpoint, release, table
from ..sources.files import csv_line, manifest
from ..sources.logs import duration, parse_runs, trimmed
from ..sources.specs import clean_documents, extract_operations

#: Decimals of scores where they are compared, and where they are shown.
RANKED, SHOWN = 9, 6
#: The stated queries of the scan: repeated words, words no document holds, stopwords only, nothing.
STATED = [("repeated", "list branches list"), ("plain", "How do I create a webhook in a space?"), ("identifier", "delete branch_id per_page"), ("unknown", "xyzzy"), ("stopwords", "the of"), ("empty", "")]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_documents")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """(qid, query) of all distinct queries."""
    return table(spark, d, "llm_records").where("consulta is not null").select(F.col("consulta").alias("qid"), F.col("consulta").alias("query")).distinct()


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """(qid, relevant): what the records of a query have as relevant."""
    rows = table(spark, d, "llm_records").where("consulta is not null").select(F.col("consulta").alias("qid"), F.explode_outer("relevantes").alias("id"))
    return rows.groupBy("qid").agg(F.sort_array(F.collect_set("id")).alias("relevant"))


def _engine(spark: SparkSession, d: str, **options) -> Engine:
    return Engine(_docs(spark, d), Options(config="indexed", **options))


def _hits(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """The k best documents of every query, searched when this is called."""
    hits = checkpoint(_found(spark, d, k))
    release(spark)
    return hits


def _found(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    return _engine(spark, d).search(_asked(spark, d), "qid", "query", k=k, digits=RANKED)


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("qid", F.col("rank").cast("bigint").alias("rank"), "doc_pos", "id", "len", F.round("score", SHOWN).alias("score"))


def _joined(c: str | Column, sep: str = " ") -> Column:
    return F.array_join(c, sep)


# ---- text


def tokenize_documents(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_pos", _joined(tokens("text")).alias("tokens"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_pos", F.size(tokens("text")).cast("bigint").alias("tokens"), word_count("text").cast("bigint").alias("words"))


def clean_fields(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_pos", clean_text("summary").alias("summary"), clean_text("description").alias("description"), clean_text("text").alias("text"))


def path_word_list(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_pos", path_words("path").alias("words"))


def compose_text(spark: SparkSession, d: str) -> DataFrame:
    return clean_documents(_docs(spark, d)).select("doc_pos", "text")


def word_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus.word_stats(_docs(spark, d).select(word_count("text").cast("bigint").alias("words")))


def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_pos", truncate("text", 200).alias("text"), truncate("text", 0).alias("whole"))


def clean_queries(spark: SparkSession, d: str) -> DataFrame:
    written = F.concat(F.lit(' "Query: '), F.coalesce("pergunta", F.lit("")), F.lit('."\nsecond line'))
    return table(spark, d, "llm_records").select("record_id", clean_query(F.concat(F.lit('"Query: '), F.coalesce("consulta", F.lit("")), F.lit('."\nsecond line'))).alias("query"), clean_query(written).alias("asked"))


def language_rule(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "llm_records").select("record_id", language_order("pergunta").alias("told"))


def loop_detector(spark: SparkSession, d: str) -> DataFrame:
    """Answers as they are, and four times over."""
    return table(spark, d, "llm_records").select("record_id", is_looping("resposta").alias("looping"), is_looping(F.repeat(F.coalesce("resposta", F.lit("")), F.lit(4))).alias("repeated"))


def earlier_questions(spark: SparkSession, d: str) -> DataFrame:
    """Each model's records under one condition as a conversation; records with a note are turns of the assistant."""
    turns = table(spark, d, "llm_records").select(F.concat_ws(" ", "modelo", "condicao").alias("conv"), "record_id", F.when(F.col("aviso").isNull(), "user").otherwise("assistant").alias("role"), "pergunta")
    return reports.earlier_questions(turns, "conv", "record_id", "role", "pergunta").select("conversation", F.col("turn").alias("record_id"), "earlier")


# ---- corpus and search


def tf_by_field(spark: SparkSession, d: str) -> DataFrame:
    return corpus.doc_terms(_docs(spark, d)).select("doc_pos", "field", "term", "tf")


def doc_len(spark: SparkSession, d: str) -> DataFrame:
    return corpus.doc_stats(_docs(spark, d))


def term_df(spark: SparkSession, d: str) -> DataFrame:
    return corpus.term_stats(_docs(spark, d)).select("term", "df")


def term_idf(spark: SparkSession, d: str) -> DataFrame:
    return corpus.term_stats(_docs(spark, d)).select("term", F.round("idf", SHOWN).alias("idf"))


def postings_per_term(spark: SparkSession, d: str) -> DataFrame:
    return corpus.posting_lists(_docs(spark, d)).select("term", "block", _joined(F.col("positions").cast("array<string>")).alias("positions"))


def search_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_found(spark, d, 10))


def search_indexed(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame(STATED, "qid string, query string")
    return _shown(_engine(spark, d).search(asked, "qid", "query", k=10, digits=RANKED))


def search_linear(spark: SparkSession, d: str) -> DataFrame:
    return _shown(ranked(Engine(_docs(spark, d)).scan(STATED), 10, RANKED))


def linear_equals_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Rows in which scan and index differ in any bit: none."""
    engine = _engine(spark, d)
    asked = spark.createDataFrame(STATED, "qid string, query string")
    one = engine.scan(STATED).select("qid", "doc_pos", "id", "len", "score")
    other = engine.matches(asked, "qid", "query").select("qid", "doc_pos", "id", "len", "score")
    return one.exceptAll(other).unionAll(other.exceptAll(one))


def search_asc(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_engine(spark, d, ascending=True).search(_asked(spark, d), "qid", "query", k=5, digits=RANKED))


def search_limit_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the first 612 documents only."""
    return _shown(_engine(spark, d, limit=612).search(_asked(spark, d), "qid", "query", k=5, digits=RANKED))


def search_stats(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d).query_stats(_asked(spark, d), "qid", "query").select("qid", "n", F.col("candidates").cast("bigint").alias("candidates"), "empty_query", "selection")


def search_empty_query(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame(STATED, "qid string, query string")
    return _engine(spark, d).query_stats(asked, "qid", "query").select("qid", F.col("candidates").cast("bigint").alias("candidates"), "empty_query")


def search_context_join(spark: SparkSession, d: str) -> DataFrame:
    return with_context(_hits(spark, d), _docs(spark, d)).select("qid", F.col("rank").cast("bigint").alias("rank"), "id", "method", "path", "text", "docs_url")


def _comparisons(select: str, order: str, config: str = "linear") -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        engine = Engine(_docs(spark, d), Options(config=config, select=select, order_strategy=order))
        return engine.comparisons(_asked(spark, d), "qid", "query")

    return query


def score_bars(spark: SparkSession, d: str) -> DataFrame:
    """Of every logged hit with a score, its share of the best of its run."""
    hits = table(spark, d, "hits").where("score is not null and not isnan(score)").select("hit_id", "run_id", "score")
    return reports.score_bars(hits, "run_id").select("hit_id", F.round("bar", SHOWN).alias("bar"))


def render_results(spark: SparkSession, d: str) -> DataFrame:
    engine, asked = _engine(spark, d), _asked(spark, d)
    told = asked.select("qid", "query", (F.size(tokens("query")) == 0).alias("empty_query"))
    return render.rendered(told, with_context(engine.search(asked, "qid", "query", k=3, digits=RANKED), _docs(spark, d)), 400)


def _by_id(docs: DataFrame) -> DataFrame:
    """The first document of every id."""
    return docs.where("id is not null").groupBy("id").agg(F.min_by(F.struct("method", "path", "summary", "docs_url"), "doc_pos").alias("d")).select("id", "d.*")


def render_related(spark: SparkSession, d: str) -> DataFrame:
    return render.rendered_related(traverse.expand(_reach(spark, d, "bfs")[1], 3), _by_id(_docs(spark, d)))


def render_plans(spark: SparkSession, d: str) -> DataFrame:
    return render.rendered_plans(_plans(spark, d), _by_id(_docs(spark, d)))


def tree_operations(spark: SparkSession, d: str) -> DataFrame:
    """What the searches gave, one row for each query, method and path."""
    docs, hits, g = _docs(spark, d), _hits(spark, d), _graph(spark, d)
    one = _by_id(docs).select("id", "method", "path")
    results = with_context(hits, docs).select("qid", "method", "path", "rank", F.round("score", SHOWN).alias("score"))
    related = traverse.expand(traverse.reach(g, hits), 3).join(one, "id").select("qid", "method", "path", "hops")
    steps = traverse.needing(traverse.call_plans(g, hits)).select("qid", F.explode(F.slice("steps", 1, F.size("steps") - 1)).alias("id")).join(one, "id").select("qid", "method", "path")
    told = table(spark, d, "llm_records").where("consulta is not null").groupBy(F.col("consulta").alias("qid")).agg(F.max("resposta").alias("answer"))
    rows = reports.tree_operations(results, related, steps, told)
    return rows.select("qid", "method", "path", F.col("rank").cast("bigint").alias("rank"), "score", F.col("hops").cast("bigint").alias("hops"), "prerequisite", "answer")


# ---- graph


def _graph(spark: SparkSession, d: str) -> graph.Graph:
    return graph.Graph.build(_docs(spark, d))


def graph_vertices(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).vertices.select("vertex", F.col("kind").cast("bigint").alias("kind"), "label", "id", "doc_pos")


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return graph.checked_edges(g.edges, g.vertices).select("src", "dst", F.col("kind").cast("bigint").alias("kind"), "weight")


def graph_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, graph.KINDS)), F.col("kind") + 1)
    return _graph(spark, d).edges.groupBy(names.alias("kind")).agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"))


def graph_e_formula(spark: SparkSession, d: str) -> DataFrame:
    c = _graph(spark, d).counts()
    return c.select("v", "e", "resources", "operations", "dependencies", (F.col("e") == 2 * (F.col("resources") - 1) + 2 * F.col("operations") + F.col("dependencies")).alias("holds"))


def path_prefix_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.prefixes(_docs(spark, d)).select(graph.label(F.col("segments")).alias("label"), F.size("segments").cast("bigint").alias("depth"))


def adjacency_sorted(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(_graph(spark, d).edges).select("src", F.col("pos").cast("bigint").alias("pos"), F.col("kind").cast("bigint").alias("kind"), "dst", "weight")


def depends_on_edges(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    v = g.vertices.select("vertex", "label")
    e = g.edges.where(graph.only(graph.DEPENDS_ON))
    return e.join(v.withColumnsRenamed({"vertex": "src", "label": "operation"}), "src").join(v.withColumnsRenamed({"vertex": "dst", "label": "needs"}), "dst").select("operation", "needs")


def _reach(spark: SparkSession, d: str, method: str) -> tuple[graph.Graph, DataFrame]:
    g = _graph(spark, d)
    return g, traverse.reach(g, _found(spark, d), method=method)


def expand_bfs_h3(spark: SparkSession, d: str) -> DataFrame:
    return traverse.expand(_reach(spark, d, "bfs")[1]).select("qid", F.col("pos").cast("bigint").alias("pos"), "id", "cost", F.col("hops").cast("bigint").alias("hops"))


def expand_dijkstra_b3(spark: SparkSession, d: str) -> DataFrame:
    return traverse.expand(_reach(spark, d, "dijkstra")[1]).select("qid", F.col("pos").cast("bigint").alias("pos"), "id", "cost", F.col("hops").cast("bigint").alias("hops"))


def expand_stats(spark: SparkSession, d: str) -> DataFrame:
    g, hits = _graph(spark, d), _hits(spark, d)
    one = lambda method: traverse.expand_stats(g, traverse.reach(g, hits, method=method), method=method).select("qid", F.lit(method).alias("method"), "visited", "scanned")
    return one("bfs").unionByName(one("dijkstra"))


def _plans(spark: SparkSession, d: str) -> DataFrame:
    return traverse.call_plans(_graph(spark, d), _found(spark, d))


def call_plans(spark: SparkSession, d: str) -> DataFrame:
    return _plans(spark, d).select("qid", F.col("rank").cast("bigint").alias("rank"), _joined("steps").alias("steps"), "scanned")


def plans_with_prereqs(spark: SparkSession, d: str) -> DataFrame:
    return traverse.needing(_plans(spark, d)).select("qid", F.col("rank").cast("bigint").alias("rank"), _joined("steps").alias("steps"))


def plans_grouped(spark: SparkSession, d: str) -> DataFrame:
    return traverse.grouped_plans(_plans(spark, d)).select("qid", _joined("before").alias("before"), _joined(F.col("ranks").cast("array<string>")).alias("ranks"))


def plan_stats(spark: SparkSession, d: str) -> DataFrame:
    return traverse.plan_stats(_plans(spark, d)).select("qid", F.col("with_prerequisites").cast("bigint").alias("with_prerequisites"), F.col("prerequisites").cast("bigint").alias("prerequisites"), "scanned")


def _roots(g: graph.Graph) -> DataFrame:
    """The first operations of the catalogue's resources below the root, as seeds of a search."""
    return g.vertices.where((F.col("kind") == graph.RESOURCE) & (F.size("segments") == 1)).select("vertex")


def bfs_iterative(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return traverse.bfs(g.edges.where(graph.only(*graph.STRUCTURAL)), _roots(g), 4).select("vertex", F.col("depth").cast("bigint").alias("depth"), "parent")


def sssp_iterative(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return traverse.shortest_paths(g.edges, _roots(g), 3.0).select("vertex", "dist")


def topo_levels(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return traverse.topo_levels(g.edges.where(graph.only(graph.DEPENDS_ON)), g.vertices).select("vertex", F.col("level").cast("bigint").alias("level"))


def shortest_path_lists(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    reached = traverse.bfs(g.edges.where(graph.only(*graph.STRUCTURAL)), _roots(g), 4)
    return traverse.with_paths(reached).select("vertex", _joined(F.col("path").cast("array<string>")).alias("path"))


def dfs_order(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    return traverse.dfs(g.edges.where(graph.only(graph.CONTAINS, graph.EXPOSES)), g.vertices).select("vertex", "pre", "parent", "on_cycle")


def path_tree_rows(spark: SparkSession, d: str) -> DataFrame:
    """The trees of the hits of all queries."""
    hits = with_context(_hits(spark, d), _docs(spark, d)).select("qid", F.upper("method").alias("method"), "path")
    rows = reports.tree_rows(hits)
    return rows.select("qid", F.concat(F.lit("/"), _joined("prefix", "/")).alias("prefix"), F.col("kind").cast("bigint").alias("kind"), F.col("depth").cast("bigint").alias("depth"), "label", "method")


# ---- evaluation


def rank_and_precision(spark: SparkSession, d: str) -> DataFrame:
    r = evaluate.evaluated(_hits(spark, d), _gold(spark, d), 5)
    return r.select("qid", F.col("rank").cast("bigint").alias("rank"), "precision", F.col("candidates").cast("bigint").alias("hits"))


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    asked = _asked(spark, d)
    counts = _engine(spark, d).query_stats(asked, "qid", "query").select("qid", "candidates")
    s = evaluate.summary(evaluate.evaluated(_hits(spark, d), _gold(spark, d), 5, counts), 5)
    return s.select("queries", F.col("hits_at_k").cast("bigint").alias("hits_at_k"), F.col("empty").cast("bigint").alias("empty"), F.round("mean_precision", SHOWN).alias("mean_precision"), F.round("mean_rank", SHOWN).alias("mean_rank"))


def found_expanded(spark: SparkSession, d: str) -> DataFrame:
    gold = _gold(spark, d)
    related = traverse.expand(_reach(spark, d, "bfs")[1])
    return evaluate.found_expanded(evaluate.evaluated(_hits(spark, d), gold, 5), related, gold)


def extract_calls(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "llm_records").select("record_id", F.posexplode(answer_calls("resposta")).alias("place", "c"))
    return rows.select("record_id", F.col("place").cast("bigint").alias("place"), "c.method", "c.path")


def answer_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "llm_records").select("record_id", answered_endpoint("resposta").alias("endpoint"))


def match_templates(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "llm_records").select(F.explode(answer_calls("resposta")).alias("c")).select("c.method", "c.path")
    return match_calls(calls, _docs(spark, d), "id")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.scored_answers(table(spark, d, "llm_records"), _docs(spark, d))


def answer_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("record_id", _joined("cited", " | ").alias("cited"), _joined("invented", " | ").alias("invented"), "correct", "needs_before", "cited_before")


def context_use(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("record_id", "in_context", "context_use")


def rescore(spark: SparkSession, d: str) -> DataFrame:
    """Against a gold set by question: the largest lists any record of the question has."""
    records = table(spark, d, "llm_records").where("pergunta is not null")
    gold = records.groupBy(F.col("pergunta").alias("question")).agg(F.max("relevantes").alias("relevant"), F.max("pre_requisitos").alias("needed"))
    return evaluate.rescored(records, gold, _docs(spark, d)).select("record_id", "correct", "cited_before", "context_use")


def context_ids(spark: SparkSession, d: str) -> DataFrame:
    """What a search gives to a model: hits, two related operations, and the steps of plans."""
    hits = _hits(spark, d)
    g = _graph(spark, d)
    gather = lambda df, order, value, name: df.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(order, F.col(value).alias("v")))).alias(name)).select("qid", F.col(f"{name}.v").alias(name))
    plans = gather(traverse.needing(traverse.call_plans(g, hits)), "rank", "steps", "plans")
    related = gather(traverse.expand(traverse.reach(g, hits), 2), "pos", "id", "related")
    rows = gather(hits, "rank", "id", "results").join(related, "qid", "left").join(plans, "qid", "left")
    return rows.select("qid", _joined(evaluate.context_ids(F.col("results"), F.col("related"), F.col("plans"))).alias("ids"))


# ---- runs and reports


def run_statistics(spark: SparkSession, d: str) -> DataFrame:
    r = reports.run_statistics(table(spark, d, "runs"))
    return r.select("cenario", "runs", "found", F.round("mean_rank", SHOWN).alias("mean_rank"), "median_us", "min_us", "max_us")


def scenario_matrix(spark: SparkSession, d: str) -> DataFrame:
    return reports.scenario_matrix(spark).withColumns({c: F.col(c).cast("bigint") for c in ("preset", "k", "limit", "repetitions")})


def graph_scenarios(spark: SparkSession, d: str) -> DataFrame:
    return reports.graph_scenarios(spark).withColumns({c: F.col(c).cast("bigint") for c in ("preset", "k", "limit", "repetitions", "hops")})


def run_count(spark: SparkSession, d: str) -> DataFrame:
    """Runs of both matrices with the ten gold questions."""
    return reports.run_count(reports.scenario_matrix(spark).select("repetitions").unionAll(reports.graph_scenarios(spark).select("repetitions")), 10)


def conditions(spark: SparkSession, d: str) -> DataFrame:
    return reports.conditions(spark, "A,B,D").withColumns({c: F.col(c).cast("bigint") for c in ("k", "related", "hops")})


def _logs(spark: SparkSession, d: str) -> DataFrame:
    """Runs as the text a run writes; those without a query time have no statistics line."""
    out = F.concat(
        F.lit("config=indexed   select=topk\n 1. "), F.concat_ws("-", F.lit("op"), F.col("k").cast("string")), F.lit("   GET /x  1.00\n    one\n 2. op-b POST /y 0.50\n    two\n"),
        F.when(F.col("consulta_us").isNull(), "").otherwise(F.concat(F.lit("\nN="), F.col("n").cast("string"), F.lit("  candidatos=7  comparações=9  seleção=topk  carga="), F.floor("carga_ms").cast("string"), F.lit("ms  índice=1.5ms  mem="), F.col("mem_kb").cast("string"), F.lit("kB  consulta="), F.floor("consulta_us").cast("string"), F.lit("µs\n"))),
        F.when(F.col("repeticao") == 1, F.lit("\nrelacionadas pelo grafo (1):\n  custo=2.0  op-r   GET    /r\ngrafo: V=10  E=22  construção=1.2ms  expansão=bfs  visitados=5  arestas=6  relacionadas=1  expansão_tempo=13µs\n")).otherwise(""),
    )
    return table(spark, d, "runs").select("run_id", "k", out.alias("output"), F.array(F.when(F.col("k") == 5, "op-5").when(F.col("k") == 50, "op-r").otherwise("none")).alias("relevant"))


def parse_logs(spark: SparkSession, d: str) -> DataFrame:
    rows = parse_runs(_logs(spark, d), "output", "relevant", "k")
    return rows.select("run_id", "config", "selection", "n", "candidates", "comparisons", "load_ms", "index_us", "mem_kb", "query_us", F.col("rank").cast("bigint").alias("rank"), F.round("precision", SHOWN).alias("precision"), "vertices", "edges", "build_us", "expand", "visited", "scanned", "related", "expand_us", "found_expanded")


def trim_logs(spark: SparkSession, d: str) -> DataFrame:
    return _logs(spark, d).select("run_id", trimmed("output", 1).alias("output"))


def parse_durations(spark: SparkSession, d: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("ns", "µs", "ms", "s", "h"))), (F.col("run_id") % 5 + 1).cast("int"))
    written = F.concat(F.format_string("%.3f", F.coalesce("consulta_us", F.lit(0.0))), unit)
    return table(spark, d, "runs").select("run_id", duration(written).alias("us"), duration(written, "ms").alias("ms"))


def csv_report(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "llm_records").select("record_id", csv_line(F.col("modelo"), F.col("condicao"), F.col("repeticao"), F.col("pergunta"), F.col("acertou"), F.col("aviso"), F.col("resposta")).alias("line"))


def time_share(spark: SparkSession, d: str) -> DataFrame:
    """Search time of each run against the mean model time of all answers."""
    model = table(spark, d, "llm_records").agg((F.sum("llm_ms") / F.count("llm_ms")).alias("model_ms"))
    rows = table(spark, d, "runs").crossJoin(F.broadcast(model))
    return rows.select("run_id", F.round(reports.time_share(F.col("consulta_us"), F.col("indice_us"), F.col("model_ms")), SHOWN).alias("share"))


# ---- ingest


def _operations(spark: SparkSession, d: str) -> DataFrame:
    return extract_operations(table(spark, d, "specs"), "spec_id", "spec_json").withColumnRenamed("key", "spec_id")


def ingest_extract(spark: SparkSession, d: str) -> DataFrame:
    return _operations(spark, d).select("spec_id", "doc_pos", "id", "method", "path", "summary", "description", "category", "deprecated", "docs_url")


def _fields(spark: SparkSession, d: str, column: str) -> DataFrame:
    rows = _operations(spark, d).select("spec_id", "doc_pos", F.posexplode(column).alias("place", "f"))
    return rows.select("spec_id", "doc_pos", F.col("place").cast("bigint").alias("place"), "f.name", "f.loc", "f.required", "f.description")


def ingest_params(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d, "params")


def ingest_body_fields(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d, "body")


def ingest_manifest(spark: SparkSession, d: str) -> DataFrame:
    """One manifest over all specifications."""
    docs = clean_documents(_operations(spark, d))
    words = corpus.word_stats(docs.select(word_count("text").cast("bigint").alias("words")))
    return manifest(docs, words, "all", "1", "", {}, "")


def ingest_documents(spark: SparkSession, d: str) -> DataFrame:
    return clean_documents(_operations(spark, d)).select("spec_id", "doc_pos", "text")


# ---- nested records


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return body_fields(table(spark, d, "specs"), "spec_id", "spec_json").withColumnRenamed("record", "spec_id")


def p6_operations(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of operations with the path that holds each and the number of its body fields."""
    nodes = label_nodes(table(spark, d, "specs"), "spec_id", "spec_json", "path", "operation", "field")
    fields = enclose(nodes, "field", "operation").groupBy("row", F.col("operation.pre").alias("pre")).agg(F.count(F.lit(1)).alias("fields"))
    found = enclose(nodes, "operation", "path").select("row", "record", "pre", "post", F.col("path.name").alias("path"), F.col("name").alias("method"), F.col("description").alias("summary"))
    return found.join(fields, ["row", "pre"], "left").na.fill(0, ["fields"]).drop("row").withColumnRenamed("record", "spec_id")


def p6_media(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of media types of request bodies, with path, method and whether a body is required."""
    nodes = label_nodes(table(spark, d, "specs"), "spec_id", "spec_json", "path", "operation", "body", "media")
    found = enclose(nodes, "media", "path", "operation", "body")
    return found.select(F.col("record").alias("spec_id"), "pre", "post", F.col("path.name").alias("path"), F.col("operation.name").alias("method"), F.col("name").alias("media"), F.col("body.required").alias("required"))


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    nodes = label_nodes(table(spark, d, "specs"), "spec_id", "spec_json", "path")
    return node_table(nodes, "path").select(F.col("record").alias("spec_id"), "pre", "post", F.col("name").alias("path"))


def p6_paths_per_spec(spark: SparkSession, d: str) -> DataFrame:
    return p6_paths(spark, d).groupBy("spec_id").agg(F.count(F.lit(1)).alias("paths"))


def p6_operation_list(spark: SparkSession, d: str) -> DataFrame:
    """The table of operations without its labels."""
    return p6_operations(spark, d).select("spec_id", "path", "method", "summary")


def p6_media_list(spark: SparkSession, d: str) -> DataFrame:
    """The table of media types without its labels."""
    return p6_media(spark, d).select("spec_id", "path", "method", "media", "required")


_COUNTERS = {f"comparisons_{n}": _comparisons(*how) for n, how in {"topk": ("topk", "merge"), "topk_indexed": ("topk", "merge", "indexed"), "kheap": ("heap", "merge"), "quick": ("sort", "quick"), "heapsort": ("sort", "heap"), "merge": ("sort", "merge"), "std": ("sort", "std")}.items()}
_OWN = [f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OWN} | _COUNTERS
