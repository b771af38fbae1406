"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash in [0, 2^60). Tokens are summed by source and leading bits of the hash; in each
source the bucket in which the budget is crossed is found by a running sum over buckets, and only that bucket
is split by the next bits, until it is one document. What lies below the threshold is taken: a filter, no sort.
A document is used ``floor(budget / available)`` times, at most ``max_repeats``, and once more below the
threshold.

The total is the largest at which every targeted source with documents has its share, or ``total_tokens`` if
given; then a source that can't fill its share even with ``max_repeats`` falls short, and the report shows it.
No source is ever over its budget, and unless it runs out it is under it by less than one document.

Defined results: documents with a null key, null text or a source without a target are not used (empty texts
have no tokens and take part); a source with a null or non-positive share or null or non-positive max_repeats
has no target; shares are taken relative to their sum over sources with tokens; empty tables give empty results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, Shared, checkpoint

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splitting of texts before byte pairs are merged, as published with this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BITS, STEP = 60, 12


#: Bytes of a vocabulary that may be sent to every executor.
MOST_VOCABULARY = 64 << 20


def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(vocabulary: Shared):
    schema = pa.schema([("key", pa.int64()), ("source", pa.string()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary.get()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("source").cast(pa.string()), pa.array([len(encoding.encode_ordinary(t)) for t in b.column("text").to_pylist()], pa.int64())], schema=schema)

    return run


def token_counts(df: DataFrame, key: str, source: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, source, tokens, h): tokens of the whole text and the hash of the key.

    The vocabulary is read where this is called and sent to the executors.
    """
    with open(tokenizer, "rb") as f:
        vocabulary = f.read(MOST_VOCABULARY + 1)
    if len(vocabulary) > MOST_VOCABULARY:
        raise ValueError(f"a vocabulary of more than {MOST_VOCABULARY} bytes")
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(source).alias("source"), F.col(text).alias("text")).where("key is not null and source is not null and text is not null")
    counted = rows.mapInArrow(_count(Shared(df.sparkSession, vocabulary, _encoding)), "key bigint, source string, tokens bigint")
    return counted.withColumn("h", F.shiftrightunsigned(F.xxhash64("key"), 64 - BITS))


def _budgets(counted: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    """(source, target_share, max_repeats, available, documents, share, total, budget, full, rest) by source."""
    have = counted.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("documents"))
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").cast("bigint").alias("max_repeats")).where("source is not null")
    known = wanted.join(have, "source", "left").withColumn("used", (F.col("target_share") > 0) & (F.col("max_repeats") > 0) & (F.coalesce("available", F.lit(0)) > 0))
    known = known.withColumn("share", F.when(F.col("used"), F.col("target_share") / F.sum(F.when(F.col("used"), F.col("target_share"))).over(W.partitionBy())))
    largest = F.min(F.when(F.col("used"), F.col("available") * F.col("max_repeats") / F.col("share"))).over(W.partitionBy())
    known = known.withColumn("total", largest if total_tokens is None else F.lit(float(total_tokens)))
    known = known.withColumn("budget", F.when(F.col("used"), F.col("share") * F.col("total") * (1 + 1e-12)).otherwise(0.0))
    known = known.withColumn("full", F.when(F.col("used"), F.least(F.col("max_repeats"), F.floor(F.col("budget") / F.col("available")))).otherwise(0))
    return known.withColumn("rest", F.when(F.col("used") & (F.col("full") < F.col("max_repeats")), F.col("budget") - F.col("full") * F.col("available")).otherwise(0.0))


def thresholds(counted: DataFrame, rests: dict[str, float], step: int = STEP) -> dict[str, int]:
    """For each source the hash below which its documents hold at most ``rest`` tokens; the largest such.

    Each round sums tokens by source and bucket inside the boundary buckets found so far. The driver gets one
    row per source and round.
    """
    spark = counted.sparkSession
    state = {s: (0, r) for s, r in rests.items() if r > 0}  # the prefix of the boundary bucket, what is left of the rest
    done = {s: 0 for s, r in rests.items() if r <= 0}
    for level in range(1, -(-BITS // step) + 1):
        if not state:
            break
        shift = max(0, BITS - level * step)
        before = BITS - (level - 1) * step
        edge = F.broadcast(spark.createDataFrame([(s, p, float(r)) for s, (p, r) in state.items()], "source string, prefix bigint, rest double"))
        inside = counted.join(edge, "source").where(F.shiftright("h", before) == F.col("prefix"))
        buckets = inside.groupBy("source", F.shiftright("h", shift).alias("bucket"), "rest").agg(F.sum("tokens").alias("tokens"))
        running = buckets.withColumn("through", F.sum("tokens").over(W.partitionBy("source").orderBy("bucket")))
        crossed = running.where("through > rest").groupBy("source").agg(F.min(F.struct("bucket", (F.col("rest") - F.col("through") + F.col("tokens")).alias("left"))).alias("x"))
        found = {r["source"]: (r["x"]["bucket"], r["x"]["left"]) for r in crossed.collect()}
        for s, (p, _) in state.items():
            if s not in found:  # everything inside fits
                done[s] = (p + 1) << before
            elif shift == 0:
                done[s] = found[s][0]
        state = {s: x for s, x in found.items() if s not in done}
    return done


def mix(docs: DataFrame, key: str, source: str, text: str, targets: DataFrame, *, total_tokens: int | None = None, all_tokens: bool = False, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mix (key, source, tokens, copies) and its report, one row per source of the targets.

    The report has target_share, share (relative to the sources with tokens), max_repeats, documents, available,
    budget, used_documents, used_tokens, actual_share, most_copies and shortfall, the tokens missing to its budget. ``all_tokens`` sets the total to all tokens.
    Targets are settings, one row per source; more than ``BROADCAST_ROWS`` of them are refused.
    """
    if targets.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError("too many sources in the targets")
    counted = checkpoint(token_counts(docs, key, source, text, tokenizer))
    if all_tokens:
        total_tokens = counted.join(F.broadcast(targets.where("target_share > 0 and max_repeats > 0").select("source").distinct()), "source", "left_semi").agg(F.sum("tokens")).first()[0] or 0
    plan = _budgets(counted, targets, total_tokens).collect()
    spark = docs.sparkSession
    cut = thresholds(counted, {r["source"]: r["rest"] for r in plan if r["used"]})
    fields = "source string, target_share double, share double, max_repeats bigint, documents bigint, available bigint, budget double, full bigint, below bigint"
    rows = [(r["source"], r["target_share"], r["share"], r["max_repeats"], r["documents"] or 0, r["available"] or 0, r["budget"], int(r["full"]), cut.get(r["source"], 0)) for r in plan]
    sources = spark.createDataFrame(rows, fields)
    chosen = counted.join(F.broadcast(sources.select("source", "full", "below")), "source")
    copies = F.col("full") + (F.col("h") < F.col("below")).cast("bigint")
    mixed = chosen.select("key", "source", "tokens", copies.alias("copies")).where("copies > 0")
    used = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("used_documents"), F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    report = sources.join(used, "source", "left").na.fill(0, ["used_documents", "used_tokens", "most_copies"])
    whole = F.sum("used_tokens").over(W.partitionBy())
    report = report.withColumn("actual_share", F.when(whole > 0, F.col("used_tokens") / whole)).withColumn("shortfall", F.col("budget") - F.col("used_tokens")).drop("full", "below")
    return mixed, report
