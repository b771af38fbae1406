"""Splitting oversized texts at natural boundaries, by ranges of bytes with halos.

A text, a file or the UTF-8 bytes of a column's value, is cut into ranges of bytes; a worker gets one range and a
halo of bytes around it and never the whole. A character belongs to the range its first byte lies in. From the halo
two neighbours find, each on its own, the same anchor: the best boundary in a window at the seam. A worker cuts from
its anchor to the next one.

1. Boundary table: each range tells its length in characters, its number of pieces and whether it meets an unbroken
   stretch longer than a piece.
2. Stitching: running sums of lengths and numbers over the ranges before give each range its offset in characters and
   its first piece number. The table has one small row a range, whatever the texts hold.
3. Pieces are emitted by offset: cut again in their range and placed by the range's row; a join by (text, range),
   so one giant text is spread over all tasks.

A piece ends, as far as the text allows, after a paragraph, else a line, else a sentence, else a word, and is
never longer than ``limit`` characters; each piece but the first starts ``overlap`` characters before the end of the
one before it.

Defined results: null and empty texts have no pieces; a text of ``limit`` characters or fewer is one piece, if small
ones are asked for; repeated rows, of equal keys too, are split each for itself (``text_no`` tells them apart); bytes
that are no UTF-8 are read as replacement characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A cut may come after one of these; the best kind found in the later half of the room wins.
_KINDS = [re.compile(r"\n[ \t]*\n\s*"), re.compile(r"\r?\n"), re.compile(r"[.!?;:]['\")\]]*[ \t\n\r]+"), re.compile(r"[ \t\n\r]+")]
#: Characters around a position that decide whether a cut there is natural.
CONTEXT = 64
_NAMES = ("paragraph", "line", "sentence", "word")
_BOUND = pa.schema([("key", pa.string()), ("text_no", pa.int64()), ("range_no", pa.int64()), ("chars", pa.int64()), ("pieces", pa.int64()), ("long_run", pa.bool_()), ("forced", pa.int64())])
_BOUND_DDL = "key string, text_no bigint, range_no bigint, chars bigint, pieces bigint, long_run boolean, forced bigint"
_PIECE = pa.schema([("key", pa.string()), ("text_no", pa.int64()), ("range_no", pa.int64()), ("place", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("kind", pa.string()), ("piece", pa.string())])
_PIECE_DDL = "key string, text_no bigint, range_no bigint, place bigint, low bigint, high bigint, kind string, piece string"
_RANGE = ("key", "text_no", "range_no", "size", "low", "raw")


def _best(text: str, low: int, high: int) -> tuple[int, str]:
    """The best cut in (low, high]: of the best kind, the last; from the later half if there is one."""
    for start in (low + (high - low) // 2, low):
        for name, kind in zip(_NAMES, _KINDS):
            at = -1
            for m in kind.finditer(text, max(0, start - CONTEXT), min(len(text), high + 1)):
                if start < m.end() <= high:
                    at = m.end()
            if at > low:
                return at, name
    return high, "forced"


def _anchor(text: str, seam: int, room: int) -> int:
    """The cut both neighbours of a seam agree on; it depends only on text within CONTEXT of the window."""
    window = text[max(0, seam - CONTEXT) : seam + room + 1]
    shift = max(0, seam - CONTEXT)
    return _best(window, seam - shift, min(len(window), seam - shift + room))[0] + shift


def cut(text: str, begin: int, end: int, limit: int, overlap: int, first: bool) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pieces of text[begin:end]; a first piece has no overlap before it."""
    out, at = [], begin
    while at < end:
        room = limit - (0 if first and not out else overlap)
        stop, kind = (end, "end") if end - at <= room else _best(text, at, at + room)
        out.append((at if first and not out else at - overlap, stop, kind))
        at = stop
    return out


def halo(limit: int) -> int:
    """Bytes a worker sees on either side of its range: two pieces and the context of a cut, at four bytes a character."""
    return 4 * (2 * limit + CONTEXT)


def _first_of(raw: bytes, at: int) -> int:
    """The first byte at or after ``at`` that begins a character."""
    return next((i for i in range(at, min(at + 4, len(raw))) if raw[i] & 0xC0 != 0x80), min(at, len(raw)))


def cut_range(raw: bytes, low: int, begin: int, end: int, size: int, limit: int, overlap: int) -> tuple[str, int, int, list[tuple[int, int, str]], bool]:
    """(text, own, chars, pieces, long_run) of bytes begin to end of a text of ``size`` bytes; raw starts at byte low.

    ``own`` is where the range begins in the decoded text, ``chars`` its length; pieces are offsets in that text.
    """
    start, a = _first_of(raw, 0) if low else 0, _first_of(raw, begin - low) if begin else 0
    z = _first_of(raw, end - low) if end < size else len(raw)
    stop = len(raw)
    if low + len(raw) < size:  # the halo may end inside a character
        while stop > z and raw[stop - 1] & 0xC0 == 0x80:
            stop -= 1
        if stop > z and raw[stop - 1] & 0xC0 == 0xC0:
            stop -= 1
    before, mine, after = (raw[x:y].decode("utf-8", "replace") for x, y in ((start, a), (a, z), (z, stop)))
    text, own, room = before + mine + after, len(before), (limit - overlap) // 2
    first = own if begin == 0 else _anchor(text, own, room)
    following = len(text) if end >= size else _anchor(text, own + len(mine), room)
    long_run = re.search(rf"[^ \t\n\r]{{{limit + 1}}}", text) is not None
    return text, own, len(mine), cut(text, first, following, limit, overlap, begin == 0), long_run


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _bytes(path: str, low: int, high: int) -> bytes:
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_file(where) as f:
        return f.read_at(high - low, low)


def _scan(limit: int, overlap: int, range_bytes: int, pieces: bool):
    """The boundary table of ranges, or their pieces; a range comes with its bytes or with the path of its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _PIECE if pieces else _BOUND
        for b in batches:
            out: list[tuple] = []
            for key, text_no, no, size, low, raw in zip(*[b.column(c).to_pylist() for c in _RANGE]):
                begin, end = no * range_bytes, min((no + 1) * range_bytes, size)
                raw = raw if isinstance(raw, bytes) else _bytes(key, low, min(size, end + halo(limit)))
                text, own, chars, found, long_run = cut_range(raw, low, begin, end, size, limit, overlap)
                if not pieces:
                    out.append((key, text_no, no, chars, len(found), long_run, sum(k == "forced" for *_, k in found)))
                    continue
                for i, (p, q, kind) in enumerate(found):
                    out.append((key, text_no, no, i, p - own, q - own, kind, text[p:q]))
                    if len(out) >= 5000:
                        yield _emit(out, schema)
                        out = []
            if out:
                yield _emit(out, schema)

    return run


def _check(limit: int, overlap: int, range_len: int) -> None:
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and less than half of limit")
    if range_len < 2 * limit:
        raise ValueError("a range must hold at least two pieces")


def column_ranges(df: DataFrame, key: str, text: str, limit: int, range_bytes: int) -> DataFrame:
    """(key, text_no, range_no, size, low, raw): the ranges of texts longer than limit, each with its halo."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.monotonically_increasing_id().alias("text_no"), F.col(text).alias("t")).where(F.char_length("t") > limit)
    raw = rows.select("key", "text_no", F.col("t").cast("binary").alias("whole"), F.octet_length("t").cast("bigint").alias("size"))
    low = lambda i: F.greatest(F.lit(0).cast("bigint"), i * range_bytes - halo(limit))
    part = lambda i: F.struct(i.alias("range_no"), low(i).alias("low"), F.substring("whole", (low(i) + 1).cast("int"), ((i + 1) * range_bytes + halo(limit) - low(i)).cast("int")).alias("raw"))
    # the slices are made once, as a list: no text is copied for each of its ranges
    numbers = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / range_bytes))
    cut_up = raw.select("key", "text_no", "size", F.explode(F.transform(numbers, part)).alias("r"))
    return cut_up.select("key", "text_no", "r.range_no", "size", "r.low", "r.raw")


def file_ranges(spark: SparkSession, files: list[tuple[str, int]], limit: int, range_bytes: int) -> DataFrame:
    """(key, text_no, range_no, size, low, raw) of files given as (path, bytes); raw is null, workers read it."""
    listed = spark.createDataFrame([(p, i, n) for i, (p, n) in enumerate(files) if n > 0], "key string, text_no bigint, size bigint")
    ranges = listed.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / range_bytes))).alias("range_no"))
    low = F.greatest(F.lit(0).cast("bigint"), F.col("range_no") * range_bytes - halo(limit))
    tasks = max(1, min(10_000, sum(-(-n // range_bytes) for _, n in files)))
    return ranges.select("key", "text_no", "range_no", "size", low.alias("low"), F.lit(None).cast("binary").alias("raw")).repartition(tasks, "text_no", "range_no")


def boundary_table(ranges: DataFrame, limit: int, overlap: int, range_bytes: int) -> DataFrame:
    """(key, text_no, range_no, chars, pieces, long_run, forced) of every range."""
    return ranges.select(*_RANGE).mapInArrow(_scan(limit, overlap, range_bytes, False), _BOUND_DDL)


def stitched(bounds: DataFrame) -> DataFrame:
    """(text_no, range_no, offset, number, long_run): characters and pieces before each range; long_run of the whole text."""
    before = W.partitionBy("text_no").orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for c, name in (("chars", "offset"), ("pieces", "number"))]
    return bounds.select("text_no", "range_no", *sums, F.max("long_run").over(W.partitionBy("text_no")).alias("long_run"))


def _placed(ranges: DataFrame, limit: int, overlap: int, range_bytes: int) -> DataFrame:
    table = stitched(boundary_table(ranges, limit, overlap, range_bytes))
    pieces = ranges.select(*_RANGE).mapInArrow(_scan(limit, overlap, range_bytes, True), _PIECE_DDL)
    both = pieces.join(table, ["text_no", "range_no"])
    return both.select("key", "text_no", (F.col("number") + F.col("place") + 1).cast("int").alias("piece_no"), (F.col("low") + F.col("offset")).alias("piece_start"), (F.col("high") + F.col("offset")).alias("piece_end"), "kind", "long_run", "piece")


def oversized(df: DataFrame, key: str, text: str, *, limit: int = 2000, overlap: int = 100, range_bytes: int = 1 << 18) -> DataFrame:
    """(key, text_no, chars, pieces, long_run, forced) of every text longer than limit, from the boundary table alone.

    ``long_run`` tells that the text has a stretch of more than limit characters without white space, ``forced`` how
    many of its pieces end at no boundary.
    """
    _check(limit, overlap, range_bytes // 4)
    table = boundary_table(column_ranges(df, key, text, limit, range_bytes), limit, overlap, range_bytes)
    return table.groupBy("key", "text_no").agg(F.sum("chars").alias("chars"), F.sum("pieces").alias("pieces"), F.max("long_run").alias("long_run"), F.sum("forced").alias("forced"))


def split_column(df: DataFrame, key: str, text: str, *, limit: int = 2000, overlap: int = 100, range_bytes: int = 1 << 18, small: bool = False) -> DataFrame:
    """(key, text_no, piece_no, piece_start, piece_end, kind, long_run, piece), offsets in characters.

    Only texts longer than ``limit``; with ``small`` also the others, as one piece each.
    """
    _check(limit, overlap, range_bytes // 4)
    out = _placed(column_ranges(df, key, text, limit, range_bytes), limit, overlap, range_bytes)
    if small:
        rows = df.select(F.col(key).cast("string").alias("key"), F.monotonically_increasing_id().alias("text_no"), F.col(text).alias("piece"))
        whole = rows.where(F.char_length("piece").between(1, limit))
        out = out.unionByName(whole.select("key", "text_no", F.lit(1).alias("piece_no"), F.lit(0).cast("bigint").alias("piece_start"), F.char_length("piece").cast("bigint").alias("piece_end"), F.lit("end").alias("kind"), F.lit(False).alias("long_run"), "piece"))
    return out


def split_files(spark: SparkSession, files: list[tuple[str, int]], *, limit: int = 2000, overlap: int = 100, range_bytes: int = 1 << 20) -> DataFrame:
    """As ``split_column`` for UTF-8 files given as (path, bytes): no worker reads more than a range and its halos.

    Each range is read twice, for the boundary table and for its pieces. Every executor must be able to read the path.
    """
    _check(limit, overlap, range_bytes // 4)
    return _placed(file_ranges(spark, files, limit, range_bytes), limit, overlap, range_bytes)
