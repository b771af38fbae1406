"""Frequency of every distinct term by heavy-light aggregation.

1. ``approx_top_k`` over all terms names those that look heavy. It only routes; no count comes from it. The
   list has at most ``most_heavy`` members whatever the size of the data, so it may be sent to every task.
2. Each task counts heavy terms exactly in two local arrays, which leave it as one row, and the others in a
   dictionary that is handed on when it grows past ``local_terms`` (so memory is bounded). Both local tables are
   written once.
3. The arrays are added up position by position; only light terms are shuffled by term. The two tables of
   counts, which share no term, are united.

Defined results: null and empty values hold no term but their rows count among all rows; an empty table has
no term; names of other columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

_TERM = re.compile("[a-z0-9_]+")
_COUNTS = pa.struct([("occurrences", pa.int64()), ("records", pa.int64())])
_LOCAL = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64()), ("heavy", pa.list_(_COUNTS))])
_LOCAL_DDL = "term string, occurrences bigint, records bigint, heavy array<struct<occurrences: bigint, records: bigint>>"


def heavy_terms(tokens: DataFrame, most_heavy: int, share: float) -> list[str]:
    """Terms that make up at least ``share`` of all terms, by a sketch over all rows of (term)."""
    top, total = tokens.agg(F.expr(f"approx_top_k(term, {most_heavy}, {most_heavy * 16})"), F.count("term")).first()
    return [x["item"] for x in top if x["count"] >= share * total] if total else []


def _count(heavy: list[str], local_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {t: i for i, t in enumerate(heavy)}
        occurrences, records = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)
        occ, rec = Counter(), Counter()

        def light() -> pa.RecordBatch:
            terms = list(occ)
            out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([occ[t] for t in terms], pa.int64()), pa.array([rec[t] for t in terms], pa.int64()), pa.nulls(len(terms), pa.list_(_COUNTS))], schema=_LOCAL)
            occ.clear(), rec.clear()
            return out

        for b in batches:
            for text in b.column(0).to_pylist():
                for t, n in Counter(_TERM.findall(text)).items():
                    if (i := index.get(t)) is not None:
                        occurrences[i] += n
                        records[i] += 1
                    else:
                        occ[t] += n
                        rec[t] += 1
                if len(occ) > local_terms:
                    yield light()
        if occ:
            yield light()
        if records.any():
            own = [{"occurrences": int(o), "records": int(r)} for o, r in zip(occurrences, records)]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([own], pa.list_(_COUNTS))], schema=_LOCAL)

    return run


def term_counts(df: DataFrame, columns: list[str], *, rare_rows: int = 2, common_share: float = 0.25, most_heavy: int = 1024, heavy_share: float = 1e-4, local_terms: int = 200_000) -> DataFrame:
    """(term, occurrences, records, mark) over the given columns of all rows; mark is rare, common or null."""
    whole = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    texts = df.select(whole.alias("whole"))
    heavy = heavy_terms(texts.select(F.explode(F.regexp_extract_all("whole", F.lit("[a-z0-9_]+"), F.lit(0))).alias("term")), most_heavy, heavy_share)
    local = checkpoint(texts.mapInArrow(_count(heavy, local_terms), _LOCAL_DDL))
    add = [F.sum(c).alias(c) for c in ("occurrences", "records")]
    arrays = local.where("heavy is not null").select(F.posexplode("heavy").alias("place", "c")).groupBy("place").agg(F.sum("c.occurrences").alias("occurrences"), F.sum("c.records").alias("records"))
    names = df.sparkSession.createDataFrame(list(enumerate(heavy)), "place int, term string")
    counts_of_heavy = arrays.join(F.broadcast(names), "place").where("records > 0").select("term", "occurrences", "records")
    sums = local.where("term is not null").groupBy("term").agg(*add).unionByName(counts_of_heavy)
    total = df.agg(F.count(F.lit(1)).alias("all_rows"))
    mark = F.when(F.col("records") <= rare_rows, "rare").when(F.col("records") > common_share * F.col("all_rows"), "common")
    return sums.crossJoin(F.broadcast(total)).select("term", "occurrences", "records", mark.alias("mark"))
