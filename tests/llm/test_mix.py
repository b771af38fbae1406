"""Problem 9: mixtures."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.mix import mix, thresholds, token_counts

TARGETS = [("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 4), ("none", None, 3), ("gone", 0.1, 1), (None, 0.5, 1)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("aaaabbbc") if i % 11 else None, None if i % 50 == 3 else "" if i % 40 == 1 else "word " * rng.randint(1, 60), "x") for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, tokens string"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_no_source_is_over_its_budget_or_its_repeats(tables):
    docs, targets = tables
    mixed, report = mix(docs, "doc_id", "source", "text", targets)
    told = {r.source: r for r in report.collect()}
    assert set(told) == {"a", "b", "c", "none", "gone"}
    used = {r.source: r.used for r in mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used")).collect()}
    assert set(used) == {"a", "b", "c"}
    largest = docs.agg(F.max(F.char_length("text"))).first()[0] // 5 + 1
    for s, n in used.items():
        assert n <= told[s].budget * (1 + 1e-9) and told[s].used_tokens == n
        assert told[s].most_copies <= told[s].max_repeats
        assert told[s].shortfall < largest
    assert sum(r.actual_share or 0 for r in told.values()) == pytest.approx(1)
    assert abs(told["a"].actual_share - told["a"].share) < 0.01


def test_a_stated_total_shows_what_falls_short(tables):
    docs, targets = tables
    _, report = mix(docs, "doc_id", "source", "text", targets, total_tokens=10_000_000)
    told = {r.source: r for r in report.collect()}
    assert told["b"].used_tokens == told["b"].available and told["b"].shortfall > 0
    assert told["a"].used_tokens == 2 * told["a"].available


def test_threshold_is_the_largest_that_fits(spark, tables):
    counted = token_counts(tables[0], "doc_id", "source", "text").cache()
    rests = {"a": 5000.0, "b": 0.0, "c": 1e9}
    cut = thresholds(counted, rests, step=5)
    for s, rest in rests.items():
        rows = sorted((r.h, r.tokens) for r in counted.where(F.col("source") == s).collect())
        below = sum(t for h, t in rows if h < cut[s])
        assert below <= rest
        above = [t for h, t in rows if h >= cut[s] and t]
        assert not above or below + above[0] > rest


def test_empty_tables(tables):
    docs, targets = tables
    mixed, report = mix(docs.limit(0), "doc_id", "source", "text", targets)
    assert mixed.count() == 0 and {r.used_tokens for r in report.collect()} == {0}
    mixed, report = mix(docs, "doc_id", "source", "text", targets.limit(0))
    assert mixed.count() == 0 and report.count() == 0
