"""Top N items within every group: stored sorted runs, merged by a loser tree.

Every input partition becomes one run: sorted by bucket (a hash of the group), group and best first by Spark's
external sort, with only its own N best distinct items of each group kept. A run is stored as one file in the shared
folder, in batches of rows that end where a bucket ends; a manifest has the file and the batches of every bucket. A
task merges the runs of one bucket: a loser tree draws the best head of all runs, and after N outputs of a group
every run seeks, by bisection in its batch, to the next group. Only a batch of each run is in memory. Where a bucket
has more than ``fan_in`` runs, bundles of them are merged into longer runs first, round by round.

A task writes a file of its own name and tells it in the manifest, which is checkpointed: what a lost or repeated
task has left behind is not read.

Defined results: a null group, a null item and a null or NaN score make no output; an item counts once per
group with its best row; ties in score go to the smaller length (null last), then to the smaller item by
bytes; an empty table gives an empty table. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint, shared_folder

_FIELDS = [("grp", pa.string()), ("item", pa.string()), ("score", pa.float64()), ("len", pa.int64())]
_RUN = pa.schema(_FIELDS)
_OUT = pa.schema([*_FIELDS, ("rank", pa.int32())])
_OUT_DDL = "grp string, item string, score double, len bigint, rank int"
_PART = pa.schema([("bucket", pa.int32()), ("path", pa.string()), ("first", pa.int32()), ("batches", pa.int32())])
_PART_DDL = "bucket int, path string, first int, batches int"
_CHUNK, _BATCH = 20_000, 4_096
_ZSTD = ipc.IpcWriteOptions(compression="zstd")


class Run:
    """A stored run, read in batches of rows (group, -score, no length, length, item), all in that order."""

    def __init__(self, batches: Iterator[list[tuple]]):
        self.batches, self.rows, self.groups, self.at = batches, [], [], 0
        self._fill()

    def _fill(self) -> None:
        while self.at >= len(self.rows):
            if (rows := next(self.batches, None)) is None:
                self.rows, self.groups, self.at = [], [], 0
                return
            self.rows, self.groups, self.at = rows, [r[0] for r in rows], 0

    def head(self) -> tuple | None:
        return self.rows[self.at] if self.rows else None

    def advance(self) -> None:
        self.at += 1
        self._fill()

    def seek_past(self, group: bytes) -> None:
        """To the first row of a later group."""
        while self.rows and self.rows[self.at][0] <= group:
            self.at = bisect_right(self.groups, group, self.at)
            self._fill()


class LoserTree:
    """Tournament over runs: ``least`` is the run with the least head; after it has moved, ``replay`` its path."""

    def __init__(self, runs: list[Run]):
        self.runs, self.k = runs, len(runs)
        self.build()

    def build(self) -> None:
        k = self.k
        self.tree, winners = [-1] * max(k, 1), [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._before(a, b) else (b, a)
        self.tree[0] = winners[1] if k > 1 else (0 if k else -1)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.runs[a].head(), self.runs[b].head()
        return x is not None and (y is None or x <= y)

    def least(self) -> Run | None:
        w = self.tree[0]
        return self.runs[w] if w >= 0 and self.runs[w].head() is not None else None

    def replay(self) -> None:
        w = self.tree[0]
        node = (w + self.k) // 2
        while node >= 1:
            if self._before(self.tree[node], w):
                w, self.tree[node] = self.tree[node], w
            node //= 2
        self.tree[0] = w


def merge(runs: list[Run], n: int) -> Iterator[tuple[tuple, int]]:
    """(row, rank) of the n best distinct items of every group, group by group."""
    tree = LoserTree(runs)
    group, seen = None, set()
    while (run := tree.least()) is not None:
        row = run.head()
        if row[0] != group:
            group, seen = row[0], set()
        if row[4] not in seen:
            seen.add(row[4])
            yield row, len(seen)
        if len(seen) < n:
            run.advance()
            tree.replay()
        else:  # what runs have left of this group is passed over without a match
            for r in runs:
                r.seek_past(group)
            tree.build()


def _best(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(bucket, rows) of sorted batches, with the n best distinct items of each group kept; a bucket's rows follow each other."""
    group, seen = None, set()
    for b in batches:
        buckets = b.column("bucket").to_pylist()
        keep: dict[int, list[int]] = {}
        for i, (g, item) in enumerate(zip(b.column("grp").to_pylist(), b.column("item").to_pylist())):
            if g != group:
                group, seen = g, set()
            if len(seen) < n and item not in seen:
                seen.add(item)
                keep.setdefault(buckets[i], []).append(i)
        rows = pa.RecordBatch.from_arrays([b.column(c) for c, _ in _FIELDS], schema=_RUN)
        for bucket, at in keep.items():
            yield bucket, rows.take(pa.array(at, pa.int32()))


def _store(folder: str, rows: Iterable[tuple[int, pa.RecordBatch]]) -> pa.RecordBatch | None:
    """Writes a run and gives its part of the manifest; None if it has no rows."""
    path = f"{folder}/{uuid.uuid4().hex}.arrow"
    system, where = fs.FileSystem.from_uri(path)
    parts: list[list] = []
    out = sink = None
    at, held, now = 0, [], None

    def put() -> None:
        nonlocal at
        for chunk in pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=_BATCH) if held else []:
            out.write_batch(chunk)
            at += 1
            parts[-1][3] += 1
        held.clear()

    for bucket, batch in rows:
        if out is None:
            system.create_dir(where.rsplit("/", 1)[0], recursive=True)
            sink = system.open_output_stream(where)
            out = ipc.new_file(sink, _RUN, options=_ZSTD)
        if bucket != now:
            put()
            parts.append([bucket, path, at, 0])
            now = bucket
        held.append(batch)
        if sum(len(h) for h in held) >= _BATCH:
            put()
    if out is None:
        return None
    put()
    out.close()
    sink.close()
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*parts), _PART)], schema=_PART)


def _runs(folder: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (told := _store(folder, _best(n, batches))) is not None:
            yield told

    return run


def _read(path: str, first: int, count: int) -> Iterator[list[tuple]]:
    system, where = fs.FileSystem.from_uri(path)
    with system.open_input_file(where) as f:
        reader = ipc.open_file(f)
        for i in range(first, first + count):
            b = reader.get_batch(i)
            yield [(g.encode(), -s, length is None, length or 0, item.encode()) for g, item, s, length in zip(*[b.column(c).to_pylist() for c, _ in _FIELDS])]


def _merged(parts: list[dict], n: int) -> Iterator[tuple]:
    """(group, item, score, length, rank) of the merged runs of a bucket."""
    for (g, neg, none, length, item), rank in merge([Run(_read(p["path"], p["first"], p["batches"])) for p in parts], n):
        yield g.decode(), item.decode(), -neg, None if none else length, rank


def _chunks(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) >= _CHUNK:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _longer_runs(folder: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, parts in zip(b.column("bucket").to_pylist(), b.column("parts").to_pylist()):
                rows = (r[:4] for r in _merged(parts, n))
                if (told := _store(folder, ((bucket, batch) for batch in _chunks(rows, _RUN)))) is not None:
                    yield told

    return run


def _last(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for parts in b.column("parts").to_pylist():
                yield from _chunks(_merged(parts, n), _OUT)

    return run


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, length: str, n: int = 5, fan_in: int = 256, buckets: int | None = None) -> DataFrame:
    """(grp, item, score, len, rank): the n best distinct items of every group.

    Runs are stored when this is called; ``buckets`` defaults to the session's number of shuffle partitions.
    """
    spark = df.sparkSession
    buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    s = F.col(score).cast("double")
    rows = df.select(F.col(group).cast("string").alias("grp"), F.col(item).cast("string").alias("item"), (s + F.lit(0.0)).alias("score"), F.col(length).cast("bigint").alias("len"))
    rows = rows.where(F.col("grp").isNotNull() & F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    bucketed = rows.select(F.pmod(F.xxhash64("grp"), F.lit(buckets)).cast("int").alias("bucket"), "*")
    ordered = bucketed.sortWithinPartitions("bucket", "grp", F.col("score").desc(), F.col("len").asc_nulls_last(), "item")
    manifest = checkpoint(ordered.mapInArrow(_runs(shared_folder(spark, "runs"), n), _PART_DDL))
    part = F.struct("path", "first", "batches")
    while (most := manifest.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0) > fan_in:
        bundles = -(-most // fan_in)
        by_bundle = manifest.withColumn("bundle", F.row_number().over(W.partitionBy("bucket").orderBy("path", "first")) % bundles).repartition(min(buckets * bundles, 100_000), "bucket", "bundle")
        bundled = by_bundle.groupBy("bucket", "bundle").agg(F.collect_list(part).alias("parts")).select("bucket", "parts")
        manifest = checkpoint(bundled.mapInArrow(_longer_runs(shared_folder(spark, "runs"), n), _PART_DDL))
    by_bucket = manifest.repartition(buckets, "bucket").groupBy("bucket").agg(F.collect_list(part).alias("parts"))
    return by_bucket.mapInArrow(_last(n), _OUT_DDL)
