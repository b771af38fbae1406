"""Evaluation texts leaking into training text: greedy string tiling by running Karp-Rabin.

Words are compared in a consistent form (case, punctuation, spacing, invisible characters, width and look-alike
letters set aside). Documents and items that share a seed, ``seed`` consecutive words by rolling hash, are
joined; each pair is tiled: the longest matches of unmarked words are marked first, then shorter ones down to
``seed`` words, so a passage that is reordered is still covered by its tiles. Hashes of all windows of a document
come from running sums at once; only the stretches of it that hold the item's seeds are tiled, as no tile can lie
elsewhere. Items go to every executor only if their characters have been summed up and stay below
``most_item_chars``; beyond it seeds are joined by a shuffle, with the same result.

Defined results: null and empty texts, and items or documents shorter than ``seed`` words, leak nothing;
repeated documents are reported each for itself; empty tables give an empty table.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Shared
from .lookalike import consistent, latin_alone, to_latin

_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_BASE, _MOD = 1_000_003, (1 << 61) - 1
_ODD = 0x9E3779B97F4A7C15
_LEAK = pa.schema([("doc", pa.int64()), ("item", pa.int64()), ("longest", pa.int32()), ("tiles", pa.int32()), ("covered", pa.int32()), ("item_words", pa.int32())])
_LEAK_DDL = "doc bigint, item bigint, longest int, tiles int, covered int, item_words int"


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    if latin_alone(text):
        return _WORD.findall(unicodedata.normalize("NFC", text).lower())
    return _WORD.findall(to_latin(consistent(text).lower()))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    base, inverse = np.full(n, _ODD, np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    base[0] = inverse[0] = 1
    return np.cumprod(base), np.cumprod(inverse)


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive ids (uint64), by running sums of id times power."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    size = 1 << max(12, int(len(ids)).bit_length())
    power, inverse = _powers(size)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ids * power[: len(ids)], dtype=np.uint64)))
    return (sums[n:] - sums[:-n]) * inverse[: len(ids) - n + 1]


def _windows(ids: list[int], n: int) -> Iterator[tuple[int, int]]:
    """(position, Karp-Rabin hash) of every n consecutive ids."""
    if len(ids) < n:
        return
    top, h = pow(_BASE, n - 1, _MOD), 0
    for x in ids[:n]:
        h = (h * _BASE + x) % _MOD
    yield 0, h
    for i in range(n, len(ids)):
        h = ((h - ids[i - n] * top) * _BASE + ids[i]) % _MOD
        yield i - n + 1, h


def tile(a: list[int], b: list[int], least: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length): greedy string tiling of two texts, longest matches first, then the first in a and b.

    Rolling hashes give the places where ``least`` ids agree; each is followed to its end once, from where it can't
    be carried on to the left. What marked ids leave of a match is a match of its own.
    """
    table: dict[int, list[int]] = {}
    for i, h in _windows(a, least):
        table.setdefault(h, []).append(i)
    matches = []
    for j, h in _windows(b, least):
        for i in table.get(h, ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= least:
                matches.append((-n, i, j))
    heapify(matches)
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while matches:
        n, i, j = heappop(matches)
        n, t = -n, 0
        free = [x and y for x, y in zip(free_a[i : i + n], free_b[j : j + n])]
        if all(free):
            out.append((i, j, n))
            free_a[i : i + n] = free_b[j : j + n] = [False] * n
            continue
        for whole, run in groupby(free):
            size = sum(1 for _ in run)
            if whole and size >= least:
                heappush(matches, (-size, i + t, j + t))
            t += size
    return out


def _seeded(ids: np.ndarray, seeds: np.ndarray, n: int, hashes: np.ndarray) -> list[int]:
    """The stretches of ids whose windows of n have one of the seeds (sorted), with a 0 between them."""
    at = np.flatnonzero(_in(hashes, seeds))
    if not len(at):
        return []
    out: list[int] = []
    for part in np.split(at, np.flatnonzero(np.diff(at) > n) + 1):
        out += [*ids[part[0] : part[-1] + n].tolist(), 0]
    return out[:-1]


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[place] == values


class Items:
    """Items by word ids and seeds, held by a worker."""

    def __init__(self, rows: list[tuple[int, str]], seed: int):
        self.seed, self.ids, self.seeds, self.vocabulary = seed, {}, {}, {}
        of: dict[int, set[int]] = defaultdict(set)
        for key, text in rows:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.uint64)
            own = np.unique(window_hashes(ids, seed))
            self.ids[key], self.seeds[key] = ids.tolist(), own
            for h in own.tolist():
                of[h].add(key)
        self.known = np.array(sorted(of), np.uint64)
        self.of = [of[h] for h in self.known.tolist()]

    def matches(self, text: str) -> Iterator[tuple[int, list[int]]]:
        """(item, stretches of the document's ids that hold its seeds); an id of 0 is a word of no item."""
        if not len(self.known):
            return
        ids = np.array([self.vocabulary.get(w, 0) for w in words(text)], np.uint64)
        hashes = window_hashes(ids, self.seed)
        if not len(hashes):
            return
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        for key in sorted(set().union(*(self.of[i] for i in np.unique(at[self.known[at] == hashes])))):
            yield key, _seeded(ids, self.seeds[key], self.seed, hashes)


def _report(doc: int, ids: list[int], item: int, own: list[int], least: int) -> tuple:
    tiles = tile(own, ids, least)
    return doc, item, max((n for *_, n in tiles), default=0), len(tiles), sum(n for *_, n in tiles), len(own)


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LEAK)], schema=_LEAK)


def _scan(held: Shared, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.get()
        for b in batches:
            out = [_report(doc, ids, k, items.ids[k], seed) for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()) for k, ids in items.matches(text)]
            if out:
                yield _emit(out)

    return run


def _seeds(seed: int):
    schema = pa.schema([("key", pa.int64()), ("seed", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, seeds = [], []
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                own = np.unique(window_hashes(np.array([xxhash.xxh64_intdigest(w) for w in words(text)], np.uint64), seed))
                keys += [key] * len(own)
                seeds += own.astype(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(seeds, pa.int64())], schema=schema)

    return run


def _tile_pairs(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, item, item_text in zip(*[b.column(c).to_pylist() for c in ("doc", "text", "item", "item_text")]):
                one = Items([(item, item_text)], seed)
                out += [_report(doc, ids, item, one.ids[item], seed) for _, ids in one.matches(text)]
            if out:
                yield _emit(out)

    return run


def leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, *, seed: int = 5, most_item_chars: int = 32_000_000) -> DataFrame:
    """(doc, item, longest, tiles, covered, item_words, coverage) of every document and item that share a seed.

    ``longest`` is the longest tile in words, ``covered`` the words of the item in tiles, ``coverage`` their share.
    """
    d = docs.select(F.col(doc_key).cast("bigint").alias("doc"), F.col(doc_text).alias("text")).where("doc is not null and text is not null")
    e = items.select(F.col(item_key).cast("bigint").alias("item"), F.col(item_text).alias("item_text")).where("item is not null and item_text is not null")
    chars = e.agg(F.coalesce(F.sum(F.char_length("item_text") + 64), F.lit(0))).first()[0]
    if chars <= most_item_chars:
        held = Shared(docs.sparkSession, [tuple(r) for r in e.collect()], lambda rows: Items(rows, seed))
        out = d.mapInArrow(_scan(held, seed), _LEAK_DDL)
    else:
        of_doc, of_item = (x.select(F.col(k).alias("key"), F.col(t).alias("text")).mapInArrow(_seeds(seed), "key bigint, seed bigint") for x, k, t in ((d, "doc", "text"), (e, "item", "item_text")))
        pairs = of_doc.withColumnRenamed("key", "doc").join(of_item.withColumnRenamed("key", "item"), "seed").select("doc", "item").distinct()
        out = pairs.join(d, "doc").join(e, "item").select("doc", "text", "item", "item_text").mapInArrow(_tile_pairs(seed), _LEAK_DDL)
    return out.withColumn("coverage", F.col("covered") / F.col("item_words"))
