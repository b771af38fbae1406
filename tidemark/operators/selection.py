"""Comparisons that a selection strategy makes on the hits of a query, in the order they arrive.

Spark selects the top k by itself; these counters only reproduce a statistic that is sequential by definition.
Queries come in groups that share a part of their hits. A task reads a group's shared hits once and of each query only
what it changes, so what is shuffled doesn't grow with the product of queries and documents. Hits are ranked once for a
group: comparisons are of numbers. ``topk`` and ``heap`` look only at the hits that may be held (each of the others is
compared once and left), ``sort`` at all hits of a query; more than ``most`` of them are refused.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Key = tuple
_OUT = pa.schema([("qid", pa.string()), ("selection", pa.string()), ("comparisons", pa.int64())])


def bounded_insertion(arriving: list[Key], k: int) -> int:
    """Each hit is compared with the k-th, then from the back of the list until a better one is met."""
    held: list[Key] = []
    count = 0
    for key in arriving if k > 0 else ():
        if len(held) == k:
            count += 1
            if key >= held[-1]:
                continue
            held.pop()
        at = bisect_right(held, key)  # equal hits stay behind those before them
        count += len(held) - at + (at > 0)
        held.insert(at, key)
    return count


class _Worst:
    """A heap with the worst of the k best hits on top, that counts."""

    def __init__(self) -> None:
        self.a: list[Key] = []
        self.count = 0

    def worse(self, i: Key, j: Key) -> bool:
        self.count += 1
        return i > j

    def rise(self) -> None:
        a, at = self.a, len(self.a) - 1
        while at and self.worse(a[at], a[(at - 1) // 2]):
            a[at], a[(at - 1) // 2] = a[(at - 1) // 2], a[at]
            at = (at - 1) // 2

    def sink(self) -> None:
        a, at = self.a, 0
        while (below := 2 * at + 1) < len(a):
            if below + 1 < len(a) and self.worse(a[below + 1], a[below]):
                below += 1
            if not self.worse(a[below], a[at]):
                break
            a[at], a[below], at = a[below], a[at], below


def bounded_heap(arriving: list[Key], k: int) -> int:
    h = _Worst()
    for key in arriving if k > 0 else ():
        if len(h.a) < k:
            h.a.append(key)
            h.rise()
        elif h.worse(h.a[0], key):
            h.a[0] = key
            h.sink()
    while h.a:
        last = h.a.pop()
        if h.a:
            h.a[0] = last
            h.sink()
    return h.count


def heap_sort(a: list[Key]) -> int:
    count = 0

    def sink(at: int, size: int) -> None:
        nonlocal count
        own, last, met = a[at], size - 1, 0
        while (below := 2 * at + 1) < last:
            met += 2
            if (x := a[below]) < (y := a[below + 1]):
                x, below = y, below + 1
            if not own < x:
                break
            a[at] = x
            at = below
        else:
            if below == last:  # the only child of the last parent
                met += 1
                if own < (x := a[below]):
                    a[at] = x
                    at = below
        a[at] = own
        count += met

    for at in reversed(range(len(a) // 2)):
        sink(at, len(a))
    for size in reversed(range(1, len(a))):
        a[0], a[size] = a[size], a[0]
        sink(0, size)
    return count


def merge_sort(a: list[Key]) -> int:
    """Halves are merged; at a tie the right one goes first."""
    if len(a) < 2:
        return 0
    left, right = a[: len(a) // 2], a[len(a) // 2 :]
    count = merge_sort(left) + merge_sort(right)
    out: list[Key] = []
    i = j = 0
    while i < len(left) and j < len(right):
        count += 1
        if left[i] < right[j]:
            out.append(left[i])
            i += 1
        else:
            out.append(right[j])
            j += 1
    a[:] = out + left[i:] + right[j:]
    return count


def merge_count(ranks: np.ndarray) -> int:
    """What ``merge_sort`` counts, for numbers: of each merge all but what is left over when one half is used up.

    Left over is what is greater than the smaller one of the greatest of both halves. Halves are cut as there; all
    merges of a depth are looked at together.
    """
    n = len(ranks)
    if n < 2:
        return 0
    # equal ones differ here, the later one is smaller: at a tie the right one goes first
    place = np.empty(n, np.int64)
    place[np.lexsort((-np.arange(n), ranks))] = np.arange(n)
    edges, count = np.array([0, n]), 0
    while True:
        size = np.diff(edges)
        if size.max() < 2:
            return count
        cut = edges[:-1] + size // 2
        some = size > 1
        halves = np.sort(np.concatenate((edges, cut[some])))
        top = np.maximum.reduceat(place, halves[:-1])
        left = np.searchsorted(halves, edges[:-1])
        least = np.full(len(size), n)
        least[some] = np.minimum(top[left[some]], top[left[some] + 1])
        count += int(size[some].sum()) - np.count_nonzero(place > np.repeat(least, size))
        edges = halves


def quick_sort(a: list[Key]) -> int:
    """The median of first, middle and last is the pivot (3 comparisons); smaller ones are gathered to the left."""
    count, todo = 0, [(0, len(a) - 1)]
    while todo:
        low, high = todo.pop()
        if high - low == 1:
            count += 1
            if a[high] < a[low]:
                a[low], a[high] = a[high], a[low]
        if high - low < 2:
            continue
        mid = (low + high) // 2
        for x, y in ((low, mid), (low, high), (mid, high)):
            if a[y] < a[x]:
                a[x], a[y] = a[y], a[x]
        a[mid], a[high] = a[high], a[mid]
        count += 3 + high - low
        edge, pivot = low, a[high]
        for at in range(low, high):
            if (x := a[at]) < pivot:
                a[at] = a[edge]
                a[edge] = x
                edge += 1
        a[edge], a[high] = a[high], a[edge]
        todo += [(low, edge - 1), (edge + 1, high)]
    return count


def library_sort(a: list[Key]) -> int:
    """Python's own sort; its number of comparisons is its own matter."""
    from functools import cmp_to_key

    count = 0

    def order(x: Key, y: Key) -> int:
        nonlocal count
        count += 1
        return -1 if x < y else 0  # a sort only asks whether x is less

    a.sort(key=cmp_to_key(order))
    return count


SORTS: dict[str, Callable[[list[Key]], int]] = {"quick": quick_sort, "heap": heap_sort, "merge": merge_sort, "std": library_sort}


def counted(arriving: list[Key], k: int, select: str, order_strategy: str) -> int:
    if select == "sort":
        return SORTS[order_strategy](list(arriving))
    return (bounded_insertion if select == "topk" else bounded_heap)(arriving, k)


def _may_hold(ranks: np.ndarray, k: int) -> np.ndarray:
    """Where the hits are that have less than k before them as good as they are."""
    held: list[int] = []
    found = []
    for at, r in enumerate(ranks.tolist()):
        if len(held) < k or r < held[-1]:
            insort(held, r)
            del held[k:]
            found.append(at)
    return np.array(found, np.int64)


class _Group:
    """The shared hits of a group of queries, and the ranks of all hits that the group has."""

    def __init__(self, rows: pa.Table, indexed: bool, k: int, select: str, order_strategy: str, most: int):
        self.indexed, self.k, self.select, self.order_strategy, self.most = indexed, k, select, order_strategy, most
        self.shared = len(rows) - pc.count(rows.column("qid")).as_py()
        known = rows.column("doc_pos").is_valid().to_numpy()
        hits = rows.select(["score", "len", "id"]).set_column(2, "id", pc.fill_null(rows.column("id"), "")).filter(pa.array(known))
        by = pc.sort_indices(hits, sort_keys=[("score", "descending"), ("len", "ascending"), ("id", "ascending")])
        ordered = hits.take(by)
        new = np.zeros(len(by), bool)
        for name in ("score", "len", "id"):
            c = ordered.column(name).combine_chunks()
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, max(0, len(c) - 1))).to_numpy(zero_copy_only=False)
        rank = np.empty(len(by), np.int64)
        rank[by.to_numpy()] = np.cumsum(new)
        self.rank, self.doc, self.at = (np.zeros(len(rows), np.int64) for _ in range(3))
        self.rank[known] = rank
        docs, self.doc[known] = np.unique(rows.column("doc_pos").drop_null().to_numpy(), return_inverse=True)
        self.docs = len(docs) + 1
        self.at[known] = rows.column("at").drop_null().to_numpy()
        # the shared hits in order of arrival, and where each document is among them
        n = self.shared
        by = np.lexsort((self.doc[:n], self.at[:n])) if indexed else np.argsort(self.doc[:n], kind="stable")
        self.s_rank, self.s_doc, self.s_at = self.rank[by], self.doc[by], self.at[by]
        self.where = np.full(self.docs, -1, np.int64)
        self.where[self.s_doc] = np.arange(n)
        self.some = None if select == "sort" else _may_hold(self.s_rank, k)

    def arrival(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return at * self.docs + doc if self.indexed else doc

    def count(self, rows: slice, places: list[int]) -> int | None:
        """Comparisons for a query with hits of its own in these rows, whose shared tokens have these places."""
        doc, rank = self.doc[rows], self.rank[rows]
        met = self.where[doc]
        n = self.shared + np.count_nonzero(met < 0)
        if n == 0:
            return None
        if n > self.most:
            raise ValueError(f"more than {self.most} hits of one query to count comparisons of")
        if self.some is None:
            s_at, s_doc, s_rank, gone = self.s_at, self.s_doc, self.s_rank, met[met >= 0]
        else:
            s_at, s_doc, s_rank = self.s_at[self.some], self.s_doc[self.some], self.s_rank[self.some]
            gone = np.flatnonzero(np.isin(s_doc, doc))
        came = self.arrival(np.array(places, np.int64)[s_at] if self.indexed and len(s_at) else s_at, s_doc)
        left, came = np.delete(s_rank, gone), np.delete(came, gone)
        own = self.arrival(self.at[rows], doc)
        by = np.argsort(own)
        arriving = np.insert(left, np.searchsorted(came, own[by]), rank[by])
        if self.select == "sort":
            return merge_count(arriving) if self.order_strategy == "merge" else counted(arriving.tolist(), self.k, self.select, self.order_strategy)
        # the others are met when k better ones are held, and are compared with the k-th only
        return counted(arriving.tolist(), self.k, self.select, self.order_strategy) + (n - len(arriving) if self.k > 0 else 0)


def _starts(*columns: pa.ChunkedArray) -> list[int]:
    """Where rows begin that differ from the row before in one of the columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        c = c.combine_chunks()
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, max(0, len(c) - 1))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new).tolist()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each group, which come one after the other."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        starts = [*_starts(pa.chunked_array([b.column("shared")]), pa.chunked_array([b.column("part")])), len(b)]
        for a, z in zip(starts, starts[1:]):
            key = (b.column("shared")[a].as_py(), b.column("part")[a].as_py())
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def comparison_counts(shared: DataFrame, queries: DataFrame, touched: DataFrame, indexed: bool, k: int, select: str, order_strategy: str, most: int = 2_000_000, queries_a_group: int = 5_000) -> DataFrame:
    """(qid, selection, comparisons) of every query that has hits.

    queries are (qid, shared, places): what a query shares, and the places of those tokens in it. shared are the hits
    (shared, doc_pos, id, len, score, first_token) of what is shared, first_token a place in it; touched (qid, doc_pos,
    id, len, score, first_token) the hits that a query adds or whose score it raises. Hits arrive by document, or
    ``indexed`` by first token and document.
    """
    label = f"sort/{order_strategy}" if select == "sort" else select

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            group = _Group(rows, indexed, k, select, order_strategy, most)
            own = rows.slice(group.shared).combine_chunks()
            starts = [*_starts(own.column("qid")), len(own)] if len(own) else []
            qids, counts = [], []
            # a query's first row has its places, the hits follow
            for a, z in zip(starts, starts[1:]):
                n = group.count(slice(group.shared + a + 1, group.shared + z), own.column("places")[a].as_py())
                if n is not None:
                    qids.append(own.column("qid")[a].as_py())
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(qids, pa.string()), pa.array([label] * len(qids), pa.string()), pa.array(counts, pa.int64())], schema=_OUT)

    parts = queries.groupBy("shared").agg(F.ceil(F.count(F.lit(1)) / queries_a_group).cast("int").alias("parts"))
    placed = queries.join(parts, "shared").select("qid", "shared", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int").alias("part"), "places")
    hit = ["doc_pos", "id", "len", "score", F.col("first_token").cast("int").alias("at")]
    none = {"qid": "string", "doc_pos": "bigint", "id": "string", "len": "bigint", "score": "double", "at": "int", "places": "array<int>"}
    blank = lambda *names: [F.lit(None).cast(none[n]).alias(n) for n in names]
    columns = ["shared", "part", *none]
    whole = shared.join(parts, "shared").select("shared", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *blank("qid"), *hit, *blank("places"))
    heads = placed.select("shared", "part", "qid", *blank("doc_pos", "id", "len", "score", "at"), "places")
    own = touched.join(placed.select("qid", "shared", "part"), "qid").select("shared", "part", "qid", *hit, *blank("places"))
    rows = whole.select(columns).unionAll(heads.select(columns)).unionAll(own.select(columns))
    # nulls come first: the shared hits before the queries, a query's head before its hits
    return rows.repartition("shared", "part").sortWithinPartitions("shared", "part", "qid", "doc_pos").mapInArrow(run, "qid string, selection string, comparisons bigint")
