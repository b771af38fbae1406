"""The retrieval corpus: term frequencies by field, document statistics, IDF and postings.

A document's terms are counted inside its row, so the corpus is read and tokenised without a shuffle; only
the document frequencies are grouped by term, after a map-side count. ``doc_pos``, the order of documents, is a
column of the input.

Defined results: null fields are empty; a document without terms has length 0 and counts among N; repeated
documents count each for itself; an empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import joined_fields, tokens
from ..session import checked_broadcast

#: Fields in the order in which a score adds them up, with their weights.
FIELDS = {"summary": 3.0, "path": 2.0, "description": 1.0, "params": 1.0}


def limited(docs: DataFrame, n: int) -> DataFrame:
    """The first n documents by doc_pos; all of them if n is 0 or less. Statistics are made after the cut."""
    return docs if n <= 0 else docs.where(F.col("doc_pos") < n)


def tokenised(docs: DataFrame) -> DataFrame:
    """(doc_pos, id, len, summary, path, description, params): the fields as tokens."""
    fields = {"summary": tokens("summary"), "path": tokens("path"), "description": tokens("description"), "params": tokens(joined_fields("params", "body"))}
    cut = docs.select("doc_pos", "id", *[c.alias(n) for n, c in fields.items()])
    # explode(array(x)) makes x an attribute, computed once
    held = cut.select("doc_pos", "id", F.explode(F.array(F.struct(*fields))).alias("f"))
    return held.select("doc_pos", "id", sum((F.size(f"f.{n}") for n in fields), F.lit(0)).cast("bigint").alias("len"), *[f"f.{n}" for n in fields])


def doc_stats(docs: DataFrame) -> DataFrame:
    """(doc_pos, id, len): len is the number of tokens over all fields, repeats included."""
    return tokenised(docs).select("doc_pos", "id", "len")


def doc_terms(docs: DataFrame) -> DataFrame:
    """(doc_pos, field, fpos, term, tf): how often each field of each document holds a term."""
    rows = tokenised(docs)
    of = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(i).alias("fpos"), F.array_sort(n).alias("terms")) for i, n in enumerate(FIELDS)])
    each = rows.select("doc_pos", F.explode(of).alias("f")).where(F.size("f.terms") > 0).select("doc_pos", "f.field", "f.fpos", "f.terms")
    # runs of equal terms in sorted order: where one starts and how long it is
    first = F.filter(F.sequence(F.lit(0), F.size("terms") - 1), lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", i - 1)))
    cut = each.select("doc_pos", "field", "fpos", "terms", F.explode(F.array(first)).alias("first"))
    runs = F.transform("first", lambda at, j: F.struct(F.get("terms", at).alias("term"), (F.coalesce(F.get("first", j + 1), F.size("terms")) - at).cast("bigint").alias("tf")))
    return cut.select("doc_pos", "field", "fpos", F.explode(runs).alias("r")).select("doc_pos", "field", "fpos", "r.term", "r.tf")


def term_stats(docs: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(term, df, idf): documents that hold the term, and ln(N / df); from the index if it is at hand."""
    if index is None:
        held = tokenised(docs).select(F.explode(F.array_distinct(F.concat(*FIELDS))).alias("term"))
    else:
        held = index.select(F.explode("terms.term").alias("term"))
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.ln(F.col("n") / F.col("df")).alias("idf"))


def forward_index(docs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(doc_pos, id, len, terms): of each document its terms with their frequencies by field,
    ARRAY<STRUCT<term, tfs: ARRAY<STRUCT<fpos, tf>>>>, sorted by term. Made inside the row.

    With the terms that are asked for (term), distinct, only those are kept, and documents that hold one.
    """
    rows = tokenised(docs)
    marked = lambda name, fpos: F.transform(name, lambda t: F.struct(t.alias("term"), F.lit(fpos).alias("fpos")))
    whole = F.flatten(F.array(*[marked(n, i) for i, n in enumerate(FIELDS)]))
    key = ["doc_pos", "id", "len"]
    if asked is None:
        held = rows.select(*key, F.explode(F.array(F.array_sort(whole))).alias("s"))
    else:
        each = rows.select(*key, F.explode(whole).alias("x")).select(*key, "x", "x.term")
        held = each.join(checked_broadcast(asked), "term", "left_semi").groupBy(*key).agg(F.array_sort(F.collect_list("x")).alias("s"))
    places = lambda c: F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1, F.lit(1))).otherwise(F.array().cast("array<int>"))
    first = F.filter(places("s"), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    cut = held.select(*key, "s", F.explode(F.array(first)).alias("first"))
    runs = F.transform("first", lambda at, j: F.struct(F.get("s", at)["term"].alias("term"), F.get("s", at)["fpos"].alias("fpos"), (F.coalesce(F.get("first", j + 1), F.size("s")) - at).cast("bigint").alias("tf")))
    got = cut.select(*key, F.explode(F.array(runs)).alias("r"))
    starts = F.filter(places("r"), lambda i: (i == 0) | (F.get("r", i)["term"] != F.get("r", i - 1)["term"]))
    placed = got.select(*key, "r", F.explode(F.array(starts)).alias("at"))
    per = F.transform("at", lambda p, j: F.struct(F.get("r", p)["term"].alias("term"), F.transform(F.slice("r", p + 1, F.coalesce(F.get("at", j + 1), F.size("r")) - p), lambda x: F.struct(x["fpos"].alias("fpos"), x["tf"].alias("tf"))).alias("tfs")))
    return placed.select(*key, per.alias("terms"))


def postings(index: DataFrame) -> DataFrame:
    """(term, doc_pos, id, len, tfs) of a forward index; the terms of a document stay in its partition."""
    return index.select("doc_pos", "id", "len", F.explode("terms").alias("t")).select("t.term", "doc_pos", "id", "len", "t.tfs")


def posting_lists(docs: DataFrame, block: int = 100_000) -> DataFrame:
    """(term, block, positions): ascending document positions, in lists of at most ``block`` consecutive ones.

    A list is bounded by the block, however common the term.
    """
    held = tokenised(docs).select("doc_pos", F.explode(F.array_distinct(F.concat(*FIELDS))).alias("term"))
    return held.groupBy("term", F.floor(F.col("doc_pos") / block).alias("block")).agg(F.sort_array(F.collect_list("doc_pos")).alias("positions"))


def write_index(docs: DataFrame, path: str) -> None:
    """Postings as Parquet, clustered by term: a search for few terms reads few row groups."""
    postings(forward_index(docs)).repartitionByRange("term").sortWithinPartitions("term", "doc_pos").write.mode("overwrite").parquet(path)


def word_stats(docs: DataFrame, words: str = "words") -> DataFrame:
    """(total, min, median, mean, max) of a column of word counts; zeros without documents."""
    made = docs.agg(F.sum(words).alias("total"), F.min(words).alias("min"), F.median(words).alias("median"), F.avg(words).alias("mean"), F.max(words).alias("max"))
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    mean = F.coalesce(F.round(F.col("mean") * 100) / 100, F.lit(0.0)).alias("mean")
    return made.select(zero("total", "bigint"), zero("min", "bigint"), zero("median", "double"), mean, zero("max", "bigint"))
