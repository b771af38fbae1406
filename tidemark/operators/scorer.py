"""Scores a batch of queries against a shard of documents with array arithmetic.

A worker takes the documents of its shard in chunks, lays the postings of the queries' terms out as arrays, and adds
the contributions of each query's tokens, field by field, to the scores of the chunk's documents: the order of the
additions is that of the tokens and fields, as everywhere, so scores are the same to the bit. What leaves a chunk is
the k best of each query, or its number of candidates. A chunk, not a partition, bounds the memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Shared
from .corpus import FIELDS

_HIT = pa.schema([("qid", pa.string()), ("doc_pos", pa.int64()), ("id", pa.string()), ("len", pa.int64()), ("score", pa.float64())])
_HIT_DDL = "qid string, doc_pos bigint, id string, len bigint, score double"
_COUNT = pa.schema([("qid", pa.string()), ("candidates", pa.int64())])
_COUNT_DDL = "qid string, candidates bigint"
_ALL = _HIT.append(pa.field("first_token", pa.int32()))
_ALL_DDL = f"{_HIT_DDL}, first_token int"
#: Documents of a chunk at most; scores closer than this may be ordered anew by whoever rounds them.
CHUNK, NEAR = 50_000, 1e-8
#: Rows of a batch that leaves a chunk, about, where all documents that score do.
ROWS = 20_000


class Queries:
    """Queries as numbers of terms, and the terms with their IDF; terms that add nothing are left out."""

    def __init__(self, rows: list[tuple[str, list[str]]], idf: dict[str, float]):
        number = {t: i for i, t in enumerate(idf)}
        self.terms, self.idf = pa.array(list(idf), pa.string()), np.array(list(idf.values()), np.float64)
        self.rows = [(q, [number[t] for t in ts if t in number]) for q, ts in rows]


class Chunk:
    """Documents with their postings by term and field."""

    def __init__(self, batch: pa.RecordBatch, queries: Queries):
        self.doc_pos, self.ids = batch.column("doc_pos").to_numpy(), batch.column("id").to_pylist()
        self.len = batch.column("len").to_numpy()
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, (self.ids[i] or "").encode()))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        terms = batch.column("terms")
        flat, counts = terms.flatten(), np.diff(terms.offsets.to_numpy())
        known = pc.index_in(flat.field("term"), value_set=queries.terms)
        at = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))
        term = known.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64)
        docs = np.repeat(np.arange(len(counts)), counts)[at]
        by_term = np.argsort(term, kind="stable")
        term, docs, at = term[by_term], docs[by_term], at[by_term]
        self.fields = []
        for name in FIELDS:
            x = flat.field(name).to_numpy(zero_copy_only=False)[at]
            some = np.flatnonzero(x)
            starts = np.searchsorted(term[some], np.arange(len(queries.idf) + 1))
            self.fields.append((docs[some], x[some] * queries.idf[term[some]], starts))
        self.scores = np.zeros(len(counts), np.float64)

    def score(self, terms: list[int]) -> np.ndarray:
        """The scores of all documents; they hold until the next call."""
        self.scores[:] = 0.0
        for t in terms:
            for docs, x, starts in self.fields:
                a, z = starts[t], starts[t + 1]
                if a < z:
                    self.scores[docs[a:z]] += x[a:z]
        return self.scores

    def first(self, terms: list[int]) -> np.ndarray:
        """The place of the first token that each document holds."""
        at = np.full(len(self.len), len(terms), np.int32)
        for place in reversed(range(len(terms))):
            for docs, _, starts in self.fields:
                at[docs[starts[terms[place]] : starts[terms[place] + 1]]] = place
        return at

    def best(self, terms: list[int], k: int) -> np.ndarray:
        """The k best documents, and those that are as good as the k-th but for rounding, at most k of equal score."""
        scores = self.score(terms)
        found = np.flatnonzero(scores)
        if len(found) > k:
            least = np.partition(scores[found], len(found) - k)[len(found) - k]
            found = found[scores[found] >= least - NEAR * max(1.0, abs(least))]
        if len(found) <= k:
            return found
        found = found[np.lexsort((self.doc_pos[found], self.place[found], self.len[found], -scores[found]))]
        s = scores[found]
        first = np.concatenate(([0], np.flatnonzero(np.diff(s)) + 1))
        nth = np.arange(len(s)) - np.repeat(first, np.diff(np.concatenate((first, [len(s)]))))
        return found[nth < k]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if any(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _run(held: Shared, k: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = held.get()
        for batch in _chunks(batches):
            chunk = Chunk(batch, queries)
            names, sizes, docs, scores = [], [], [], []
            for q, terms in queries.rows:
                found = np.flatnonzero(chunk.score(terms)) if k is None else chunk.best(terms, k)
                if len(found):
                    names.append(q)
                    sizes.append(len(found))
                    if k is not None:
                        docs.append(found)
                        scores.append(chunk.scores[found])
            if not names:
                continue
            if k is None:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], schema=_COUNT)
                continue
            at = pa.array(np.concatenate(docs))
            qids = pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), sizes)))
            yield pa.RecordBatch.from_arrays([qids, batch.column("doc_pos").take(at), batch.column("id").take(at), batch.column("len").take(at), pa.array(np.concatenate(scores))], schema=_HIT)

    return run


def _run_all(held: Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = held.get()
        for batch in _chunks(batches):
            chunk = Chunk(batch, queries)
            rows: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]] = []

            def told(rows: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                names, docs, scores, first = zip(*rows)
                at = pa.array(np.concatenate(docs))
                qids = pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), [len(d) for d in docs])))
                return pa.RecordBatch.from_arrays([qids, batch.column("doc_pos").take(at), batch.column("id").take(at), batch.column("len").take(at), pa.array(np.concatenate(scores)), pa.array(np.concatenate(first))], schema=_ALL)

            for q, terms in queries.rows:
                found = np.flatnonzero(chunk.score(terms))
                rows.append((q, found, chunk.scores[found], chunk.first(terms)[found]))
                if sum(len(r[1]) for r in rows) >= ROWS:
                    yield told(rows)
                    rows = []
            if rows:
                yield told(rows)

    return run


def _weighted(index: DataFrame) -> DataFrame:
    """(doc_pos, id, len, terms) with what each term adds to each field but for its IDF."""

    def weight(tfs, field: int):
        tf = F.get(F.filter(tfs, lambda x: x["fpos"] == field), F.lit(0))["tf"]
        return F.coalesce(F.lit(list(FIELDS.values())[field]) * (1 + F.ln(tf)), F.lit(0.0))

    # the JVM's logarithm, as in the other ways of scoring
    terms = F.transform("terms", lambda t: F.struct(t["term"].alias("term"), *[weight(t["tfs"], i).alias(name) for i, name in enumerate(FIELDS)]))
    return index.select(F.col("doc_pos").cast("bigint").alias("doc_pos"), "id", F.col("len").cast("bigint").alias("len"), terms.alias("terms"))


def score_all(index: DataFrame, queries: list[tuple[str, list[str]]], idf: dict[str, float]) -> DataFrame:
    """(qid, doc_pos, id, len, score, first_token): all documents that score, for every query (qid, tokens)."""
    held = Shared(index.sparkSession, (queries, idf), lambda v: Queries(*v))
    return _weighted(index).mapInArrow(_run_all(held), _ALL_DDL)


def score_batch(index: DataFrame, queries: list[tuple[str, list[str]]], idf: dict[str, float], k: int | None) -> DataFrame:
    """(qid, doc_pos, id, len, score): for each shard and chunk the best documents of every query (qid, tokens).

    Without k (qid, candidates): in each chunk, how many documents score. Queries and IDF are sent to every executor.
    """
    held = Shared(index.sparkSession, (queries, idf), lambda v: Queries(*v))
    return _weighted(index).mapInArrow(_run(held, k), _COUNT_DDL if k is None else _HIT_DDL)
