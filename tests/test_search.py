"""Corpus and search, against a plain version."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from tidemark.functions.text import STOPWORDS
from tidemark.operators import corpus, selection
from tidemark.operators.search import Engine, Options, ranked, tool_limits

FIELD = "array<struct<name: string, description: string>>"
SCHEMA = f"doc_pos long, id string, method string, path string, summary string, description string, params {FIELD}, body {FIELD}, len string, score string"
WEIGHTS = (3, 2, 1, 1)
QUERIES = [("q1", "list red tables"), ("q2", "table table hall"), ("q3", ""), ("q4", "the of"), ("q5", "xyzzy"), ("q6", "per_page hall_id show"), ("q7", "common")]


def words(t):
    return [w for w in re.findall("[a-z0-9_]+", (t or "").lower()) if w not in STOPWORDS]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    verbs, nouns = ["list", "create", "show", "delete"], ["table", "tables", "hall", "red", "chair"]
    out = [(i, f"op-{i % 55:03}", "get", f"/{rng.choice(nouns)}s/{{hall_id}}", f"{rng.choice(verbs)} {rng.choice(nouns)} common", rng.choice([None, "", "the red hall " * rng.randint(1, 4)]), [(rng.choice(["per_page", "red"]), rng.choice([None, "a table"]))] if i % 3 else None, [] if i % 2 else None, "x", "y") for i in range(60)]
    return [*out, (60, "empty", None, None, None, None, None, None, "x", "y")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def fields(r):
    return [words(r[4]), words(r[3]), words(r[5]), [w for f in (r[6] or []) + (r[7] or []) for w in words(f[0].replace("_", " ")) + words(f[1])]]


def plain(rows, text):
    df = Counter(t for r in rows for t in set(sum(fields(r), [])))
    hits = []
    for r in rows:
        own = [Counter(f) for f in fields(r)]
        score = 0.0
        for t in words(text):
            idf = math.log(len(rows) / df[t]) if df[t] else 0
            for w, f in zip(WEIGHTS, own):
                if idf and f[t]:
                    score += w * (1 + math.log(f[t])) * idf
        if score:
            hits.append((-score, sum(map(len, fields(r))), r[1], r[0]))
    return sorted(hits)


def test_corpus(docs, rows):
    got = {(r.doc_pos, r.field, r.term): r.tf for r in corpus.doc_terms(docs).collect()}
    want = {(r[0], name, t): n for r in rows for name, f in zip(corpus.FIELDS, fields(r)) for t, n in Counter(f).items()}
    assert got == want
    df = Counter(t for r in rows for t in set(sum(fields(r), [])))
    index = corpus.forward_index(docs)
    for stats in (corpus.term_stats(docs), corpus.term_stats(docs, index)):
        told = {r.term: (r.df, r.idf) for r in stats.collect()}
        assert {t: d for t, (d, _) in told.items()} == dict(df)
        assert all(i == pytest.approx(math.log(len(rows) / d)) for d, i in told.values())
    assert {(r.doc_pos, r.id, r.len) for r in corpus.doc_stats(docs).collect()} == {(r[0], r[1], sum(map(len, fields(r)))) for r in rows}
    # postings have every document once, blocks of lists ascend
    lists = corpus.posting_lists(docs, block=10).collect()
    assert all(r.positions == sorted(set(r.positions)) and {p // 10 for p in r.positions} == {r.block} for r in lists)
    assert {(r.term, p) for r in lists for p in r.positions} == {(t, r[0]) for r in rows for t in set(sum(fields(r), []))}
    assert {(r.term, r.doc_pos) for r in corpus.postings(index).collect()} == {(r.term, p) for r in lists for p in r.positions}


@pytest.mark.parametrize("most", [100_000, 0])
@pytest.mark.parametrize("k", [0, 1, 5, 500])
def test_batch_search_is_the_plain_search(spark, docs, rows, k, most):
    queries = spark.createDataFrame(QUERIES, "qid string, text string")
    got = {}
    for r in Engine(docs, Options(config="indexed"), most).search(queries, "qid", "text", k=k).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.doc_pos, r.score))
    want = {q: plain(rows, t)[:k] for q, t in QUERIES}
    assert {q: [d for _, d, _ in sorted(h)] for q, h in got.items()} == {q: [h[3] for h in hs] for q, hs in want.items() if hs}
    assert all(s == pytest.approx(-want[q][n - 1][0], rel=1e-12) for q, h in got.items() for n, _, s in h)


def test_scan_and_index_agree_bit_for_bit(spark, docs):
    engine = Engine(docs)
    queries = spark.createDataFrame(QUERIES, "qid string, text string")
    one = {(r.qid, r.doc_pos): r.score for r in engine.scan(QUERIES).collect()}
    two = {(r.qid, r.doc_pos): r.score for r in engine.matches(queries, "qid", "text").collect()}
    assert one == two and one
    assert one == {(r.qid, r.doc_pos): r.score for r in engine.search(queries, "qid", "text", k=500).collect()}
    assert one == {(r.qid, r.doc_pos): r.score for r in engine.persist().matches(queries, "qid", "text").collect()}
    engine.unpersist()


def test_chunks_of_a_shard(docs, rows, monkeypatch):
    from tidemark.operators import scorer

    index = corpus.forward_index(docs).toArrow().to_batches()
    assert sum(map(len, scorer._chunks(iter(index)))) == len(rows)
    monkeypatch.setattr(scorer, "CHUNK", 7)
    assert [len(c) for c in scorer._chunks(b for i in index for b in (i.slice(n, 3) for n in range(0, len(i), 3)))][:2] == [9, 9]


@pytest.mark.parametrize("most", [100_000, 0])
def test_statistics_of_queries(spark, docs, rows, most):
    queries = spark.createDataFrame(QUERIES, "qid string, text string")
    got = {r.qid: (r.n, r.candidates, r.empty_query, r.selection) for r in Engine(docs, Options(select="sort"), most).query_stats(queries, "qid", "text").collect()}
    assert got == {q: (len(rows), len(plain(rows, t)), not words(t), "sort/merge") for q, t in QUERIES}


def test_ascending_limit_and_overrides(spark, docs, rows):
    queries = spark.createDataFrame(QUERIES[:1], "qid string, text string")
    engine = Engine(docs, Options(k=3))
    down = [r.doc_pos for r in engine.search(queries, "qid", "text").orderBy("rank").collect()]
    up = [r.doc_pos for r in Engine(docs, Options(k=3, ascending=True)).search(queries, "qid", "text").orderBy("rank").collect()]
    assert up == down[::-1] and len(up) == 3
    assert engine.override(k=7).search(queries, "qid", "text").count() == 7
    assert engine.override(k=0).options.k == 3
    few = [r.doc_pos for r in Engine(docs, Options(k=3, limit=20)).search(queries, "qid", "text").orderBy("rank").collect()]
    assert few == [h[3] for h in plain(rows[:20], "list red tables")[:3]]
    assert Engine(docs, Options(limit=-1)).docs.count() == len(rows)


def test_options():
    assert Options().preset(2).config == "indexed" and Options().preset(3).select == "sort" and Options(k=9).preset(0) == Options(k=9)
    for wrong in (Options(k=-1), Options(config="x"), Options(select="x"), Options(order_strategy="x")):
        with pytest.raises(ValueError):
            wrong.validate()
    with pytest.raises(ValueError):
        Options().preset(4)
    assert Options(select="sort", order_strategy="quick").label == "sort/quick" and Options().label == "topk"
    assert tool_limits() == (3, 0, 3) and tool_limits(99, 99, 99) == (10, 10, 5) and tool_limits(-1, -1, -1) == (3, 0, 3)


def test_empty_corpus(spark, docs):
    queries = spark.createDataFrame(QUERIES, "qid string, text string")
    engine = Engine(docs.limit(0))
    assert engine.search(queries, "qid", "text").count() == 0 and engine.stats.count() == 0
    assert Engine(docs).search(queries.limit(0), "qid", "text").count() == 0


def keys(n):
    return [(-(i % 5), i % 7, f"doc-{i:03}".encode()) for i in range(n)]


@pytest.mark.parametrize("name", list(selection.SORTS))
def test_sorts_sort_and_count(name):
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 64, 300):
        for given in (keys(n), sorted(keys(n)), sorted(keys(n), reverse=True), rng.sample(keys(n), n)):
            a = list(given)
            count = selection.SORTS[name](a)
            assert a == sorted(given) and (count > 0 or n < 2)


def test_quick_sort_is_not_quadratic():
    n = 1000
    assert selection.quick_sort(sorted(keys(n))) < n * n / 4


def test_counters_of_bounded_selection():
    def insertion(ks, k):
        held, count = [], 0
        for x in ks if k > 0 else ():
            if len(held) == k:
                count += 1
                if not x < held[-1]:
                    continue
                held.pop()
            held.append(x)
            at = len(held) - 1
            while at > 0:
                count += 1
                if not held[at] < held[at - 1]:
                    break
                held[at], held[at - 1] = held[at - 1], held[at]
                at -= 1
        return count

    rng = random.Random(6)
    for k in (0, 1, 5, 50, 500):
        given = rng.sample(keys(200), 200)
        assert selection.bounded_insertion(given, k) == insertion(given, k)
        assert (selection.bounded_heap(given, k) > 0) == (k > 0)
    assert selection.merge_sort([3, 1, 2]) == 3 and selection.merge_sort([1, 2]) == 1


@pytest.mark.parametrize("select,order", [("topk", "merge"), ("heap", "merge"), ("sort", "quick"), ("sort", "heap")])
def test_comparisons_follow_the_order_of_arrival(spark, docs, rows, select, order):
    queries = spark.createDataFrame(QUERIES, "qid string, text string")
    got = {r.qid: r.comparisons for r in Engine(docs, Options(select=select, order_strategy=order)).comparisons(queries, "qid", "text").collect()}
    want = {}
    for q, t in QUERIES:
        hits = sorted(plain(rows, t), key=lambda h: h[3])
        if hits:
            want[q] = selection.counted([(round(h[0], 12), h[1], h[2].encode()) for h in hits], 5, select, order)
    assert got == want


def test_equal_scores_go_by_length_id_and_place(spark):
    hits = spark.createDataFrame([("q", 3, "b", 2, 1.0), ("q", 1, "a", 2, 1.0), ("q", 0, "z", 1, 1.0), ("q", 2, "a", 2, 1.0), ("q", 4, "c", 9, 2.0)], "qid string, doc_pos long, id string, len long, score double")
    assert [r.doc_pos for r in ranked(hits, 9).orderBy("rank").collect()] == [4, 0, 1, 2, 3]
