"""Queries taken apart: what they share is scored once, and no pair of each query and document is made."""

from __future__ import annotations

from functools import partial
from pathlib import Path

import pytest
from sqlcheck import TABLES, connection, same

from tidemark.operators import search, selection
from tidemark.operators.search import Engine, Options
from tidemark.plans import queries as plans
from tidemark.plans.oracle import ORACLE

SCHEMA = "doc_pos long, id string, method string, path string, summary string, description string, params array<struct<name: string, description: string>>, body array<struct<name: string, description: string>>"
#: Words of few documents before, between and after the common ones, repeated, alone, and unknown.
QUERIES = [("q1", "list cups ada"), ("q2", "ada list cups"), ("q3", "list ada cups bob ada"), ("q4", "list list lids"), ("q5", "bob"), ("q6", "xyzzy"), ("q7", ""), ("q8", "cups show eve"), ("q9", "list cups eve")]


@pytest.fixture(scope="module")
def docs(spark):
    verbs, nouns, names = ["list", "show", "make", "drop"], ["cups", "lids", "jobs"], ["ada", "bob", "eve", "ida", "kim", "leo", "mia", "ned", "oda", "pia"]
    # ids and texts repeat, so scores are equal often
    rows = [(i, f"op-{i % 31:02}" if i % 7 else None, "get", f"/{nouns[i % 3]}/{names[i % 10]}", f"{verbs[i % 4]} {nouns[(i // 4) % 3]}", "cups of ada" if i % 9 == 0 else None, None, None) for i in range(80)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "qid string, text string").cache()


@pytest.fixture(scope="module")
def hits(docs, queries):
    """(first_token, doc_pos, key) of all hits of each query."""
    found = {}
    for r in Engine(docs).matches(queries, "qid", "text").collect():
        found.setdefault(r.qid, []).append((r.first_token, r.doc_pos, (-r.score, r.len, (r.id or "").encode())))
    return found


@pytest.fixture()
def no_pairs(monkeypatch):
    def never(*_):
        raise AssertionError("all pairs of queries and documents")

    monkeypatch.setattr(search, "candidates", never)


def counts(docs, queries, hits, select, order, config, few):
    got = {r.qid: r.comparisons for r in Engine(docs, Options(config=config, select=select, order_strategy=order, k=3), few=few).comparisons(queries, "qid", "text").collect()}
    come = {q: [key for *_, key in sorted(h, key=(lambda x: x[:2]) if config == "indexed" else lambda x: x[1])] for q, h in hits.items()}
    assert got == {q: selection.counted(keys, 3, select, order) for q, keys in come.items()}


@pytest.mark.parametrize("few", [0, 12, 1000])
def test_comparisons_merge(docs, queries, hits, no_pairs, few):
    counts(docs, queries, hits, "sort", "merge", "linear", few)


def test_merges_are_counted_as_they_are_made():
    import random

    import numpy as np

    rng = random.Random(3)
    for n in (0, 1, 2, 3, 5, 64, 301):
        for given in ([rng.randrange(9) for _ in range(n)], rng.sample(range(n), n), list(range(n)), list(range(n))[::-1]):
            assert selection.merge_count(np.array(given, np.int64)) == selection.merge_sort(list(given))


@pytest.mark.parametrize("few", [0, 12])
def test_comparisons_topk(docs, queries, hits, no_pairs, few):
    counts(docs, queries, hits, "topk", "merge", "linear", few)


@pytest.mark.parametrize("few", [0, 12])
def test_comparisons_heapsort(docs, queries, hits, no_pairs, few):
    counts(docs, queries, hits, "sort", "heap", "linear", few)


@pytest.mark.parametrize("few", [0, 12])
def test_comparisons_quick(docs, queries, hits, no_pairs, few):
    counts(docs, queries, hits, "sort", "quick", "linear", few)


@pytest.mark.parametrize("few", [0, 12])
def test_comparisons_topk_indexed(docs, queries, hits, no_pairs, few):
    counts(docs, queries, hits, "topk", "merge", "indexed", few)


@pytest.mark.parametrize("few", [0, 12])
def test_comparisons_kheap(docs, queries, hits, no_pairs, few):
    counts(docs, queries, hits, "heap", "merge", "linear", few)


@pytest.mark.parametrize("few", [0, 12])
def test_comparisons_std(docs, queries, hits, no_pairs, few):
    counts(docs, queries, hits, "sort", "std", "linear", few)


@pytest.mark.parametrize("few,most", [(0, 2), (12, 0), (1000, 0)])
def test_search_of_many_queries(docs, queries, no_pairs, few, most):
    found = lambda e: sorted((r.qid, r["rank"], r.doc_pos, r.score) for r in e.search(queries, "qid", "text", k=4).collect())
    many, one = Engine(docs, most_queries=most, few=few), Engine(docs)
    assert found(many) == found(one)
    told = lambda e: sorted((r.qid, r.candidates) for r in e.query_stats(queries, "qid", "text").collect())
    assert told(many) == told(one)


@pytest.fixture()
def many(monkeypatch, no_pairs):
    """The registered queries with bounds that their few distinct queries pass."""
    monkeypatch.setattr(plans, "Engine", partial(Engine, most_queries=50, few=3))


@pytest.mark.skipif(not Path(TABLES).exists(), reason="no tables")
@pytest.mark.parametrize("name", ["eval_summary", "expand_dijkstra_b3"])
def test_many_queries_give_what_sql_gives(spark, many, name):
    same(spark, connection(), plans.QUERIES[name], ORACLE[name])
