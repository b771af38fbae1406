"""Problems 3, 4 and 7 against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm.distinct import distinctive_terms
from tidemark.llm.terms import term_counts
from tidemark.llm.topn import top_n_per_group

WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    made = [(" ".join(rng.choices(WORDS + ["hot"], [1] * 40 + [60], k=rng.randint(0, 25))), rng.choice([None, "", "Tail_1 HOT"])) for _ in range(400)]
    return [*made, (None, None), ("", ""), ("--", None), ("ä ß Ünïcode", "x")]


@pytest.mark.parametrize("how", [{}, {"most_heavy": 3, "local_terms": 5}, {"heavy_share": 2.0}])
def test_term_counts(spark, texts, how):
    df = spark.createDataFrame([(*t, "x") for t in texts], "a string, b string, term string").repartition(5)
    occurrences, records = Counter(), Counter()
    for a, b in texts:
        found = re.findall("[a-z0-9_]+", " ".join(x for x in (a, b) if x).lower())
        occurrences.update(found)
        records.update(set(found))
    mark = lambda n: "rare" if n <= 2 else "common" if n > 0.25 * len(texts) else None
    got = {(r.term, r.occurrences, r.records, r.mark) for r in term_counts(df, ["a", "b"], **how).collect()}
    assert got == {(t, occurrences[t], records[t], mark(records[t])) for t in occurrences}


def test_term_counts_of_an_empty_table(spark):
    assert term_counts(spark.createDataFrame([], "a string"), ["a"]).count() == 0


def best(rows, n):
    kept = {}
    for g, i, s, length in rows:
        if g is not None and i is not None and s is not None and s == s:
            key = (-s + 0.0, length is None, length or 0, i.encode())
            kept[g, i] = min(kept.get((g, i), key), key)
    out = set()
    for g in {g for g, _ in kept}:
        for rank, (k, i) in enumerate(sorted((k, i) for (h, i), k in kept.items() if h == g)[:n], 1):
            out.add((g, i, -k[0] + 0.0, None if k[1] else k[2], rank))
    return out


@pytest.mark.parametrize("fan_in,buckets", [(256, None), (3, 5), (2, 1)])
def test_top_n(spark, fan_in, buckets):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None, "é"]), rng.choice([None, *(f"i{j}" for j in range(30))]), rng.choice([None, math.nan, 1.0, 2.0, 0.0, -0.0, 3.5]), rng.choice([None, 1, 2, 3]), "x") for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, i string, s double, l int, rank string").repartition(13)
    got = [tuple(r) for r in top_n_per_group(df, "g", "i", "s", "l", 5, fan_in, buckets).collect()]
    assert len(got) == len(set(got)) and set(got) == best([r[:4] for r in rows], 5)
    assert top_n_per_group(df.limit(0), "g", "i", "s", "l").count() == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_scores(spark, texts, most):
    df = spark.createDataFrame([(i, a, "x") for i, (a, _) in enumerate(texts)], "id long, a string, tf string")
    found = [re.findall("[a-z0-9_]+", (a or "").lower()) for a, _ in texts]
    n, whole = len(found), sum(map(len, found))
    df_, cf = Counter(t for f in found for t in set(f)), Counter(t for f in found for t in f)
    want = {}
    for i, f in enumerate(found):
        for t, tf in Counter(f).items():
            rate, tfn = cf[t] / n, tf * math.log2(1 + whole / n / len(f))
            want[i, t] = (tf, df_[t], (math.log2(1 + rate) + tfn * math.log2((1 + rate) / rate)) / (tfn + 1))
    got = {(r.key, r.term): (r.tf, r.df, r.score) for r in distinctive_terms(df, "id", F.col("a"), heavy_part=20, most_broadcast=most).collect()}
    assert got.keys() == want.keys()
    for k, (tf, d, score) in want.items():
        assert got[k][:2] == (tf, d) and got[k][2] == pytest.approx(score)
    assert distinctive_terms(df.limit(0), "id", F.col("a")).count() == 0
