"""The graph of a catalogue: resources (path prefixes) and operations, and what depends on what.

Vertices are numbered as a walk meets them that takes a resource, its operations by method and then its children
by segment; that is the order of (segments, kind, method), so vertices are made by a sort in ranges and edges by
equi-joins on path prefixes. The first document of each (path, method) is its operation.

Edges: contains and within between a resource and its children (weight 1), exposes and exposed_by between a
resource and its operations (0.5), depends_on from an operation to the GET of the parent of each ``{…_id}``
segment on its path (1). All structural edges run both ways.

Defined results: a null path is the root; the root is always there; a null method is the empty one; documents
that repeat an operation have no vertex of their own; of a repeated id the first vertex counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_generated_id, segments
from ..session import numbered

RESOURCE, OPERATION = 0, 1
KINDS = ("contains", "within", "exposes", "exposed_by", "depends_on")
CONTAINS, WITHIN, EXPOSES, EXPOSED_BY, DEPENDS_ON = range(5)
WEIGHTS = (1.0, 1.0, 0.5, 0.5, 1.0)
STRUCTURAL = (CONTAINS, WITHIN, EXPOSES, EXPOSED_BY)


def only(*kinds: int) -> Column:
    return F.col("kind").isin(*kinds)


def excluding(*kinds: int) -> Column:
    return ~only(*kinds)


def operations(docs: DataFrame) -> DataFrame:
    """(segments, method, id, doc_pos): the first document of every path and method."""
    rows = docs.select(segments("path").alias("segments"), F.upper(F.coalesce("method", F.lit(""))).alias("method"), "id", F.col("doc_pos").cast("bigint").alias("doc_pos"))
    first = rows.groupBy("segments", "method").agg(F.min(F.struct("doc_pos", "id")).alias("d"))
    return first.select("segments", "method", "d.id", "d.doc_pos")


def prefixes(docs: DataFrame) -> DataFrame:
    """(segments), distinct: all prefixes of all paths, the empty one included."""
    paths = docs.select(segments("path").alias("whole")).distinct()
    found = paths.select(F.explode(F.sequence(F.lit(0), F.size("whole"))).alias("n"), "whole").select(F.slice("whole", 1, F.col("n")).alias("segments"))
    root = docs.sparkSession.range(1).select(F.array().cast("array<string>").alias("segments"))
    return found.union(root).distinct()


def label(segs: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(segs, "/"))


def parent(segs: Column) -> Column:
    return F.slice(segs, 1, F.size(segs) - 1)


def build_vertices(docs: DataFrame) -> DataFrame:
    """(vertex, kind, method, segments, label, id, doc_pos); id and doc_pos are null for resources."""
    resources = prefixes(docs).select("segments", F.lit(RESOURCE).alias("kind"), F.lit("").alias("method"), label(F.col("segments")).alias("label"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("bigint").alias("doc_pos"))
    ops = operations(docs).select("segments", F.lit(OPERATION).alias("kind"), "method", F.concat_ws(" ", "method", label(F.col("segments"))).alias("label"), "id", "doc_pos")
    made = numbered(resources.unionByName(ops), "segments", "kind", "method", name="vertex")
    return made.select("vertex", "kind", "method", "segments", "label", "id", "doc_pos")


def vertex_of_id(vertices: DataFrame) -> DataFrame:
    """(id, vertex): the first vertex of every document id."""
    return vertices.where((F.col("kind") == OPERATION) & F.col("id").isNotNull()).groupBy("id").agg(F.min("vertex").alias("vertex"))


def build_edges(vertices: DataFrame) -> DataFrame:
    """(src, dst, kind, weight)."""
    resources = vertices.where(F.col("kind") == RESOURCE).select("segments", "vertex")
    ops = vertices.where(F.col("kind") == OPERATION)
    edge = lambda src, dst, kind: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("kind"), F.lit(WEIGHTS[kind]).alias("weight"))
    inner = resources.where(F.size("segments") > 0).select(parent(F.col("segments")).alias("segments"), F.col("vertex").alias("child"))
    nested = inner.join(resources, "segments").select(F.explode(F.array(edge("vertex", "child", CONTAINS), edge("child", "vertex", WITHIN))).alias("e"))
    shown = ops.select("segments", F.col("vertex").alias("op")).join(resources, "segments").select(F.explode(F.array(edge("vertex", "op", EXPOSES), edge("op", "vertex", EXPOSED_BY))).alias("e"))
    # the parents of generated ids on each path, then the document of their GET, then the first vertex of its id
    at = F.filter(F.sequence(F.lit(1), F.size("segments")), lambda i: is_generated_id(F.element_at("segments", i)))
    needs = ops.where(F.size("segments") > 0).select(F.col("vertex").alias("op"), "segments", F.explode(at).alias("i")).select("op", F.slice("segments", 1, F.col("i") - 1).alias("segments"))
    lists = ops.where(F.col("method") == "GET").select("segments", "id").join(vertex_of_id(vertices), "id").select("segments", F.col("vertex").alias("list"))
    depends = needs.join(lists, "segments").select(edge("op", "list", DEPENDS_ON).alias("e"))
    return nested.union(shown).union(depends).select("e.*")


def checked_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The edges, or an error if one has an unknown end or a weight that is null, negative or not a number."""
    known = vertices.select("vertex", F.lit(True).alias("known"))
    ends = edges.join(known.withColumnsRenamed({"vertex": "src", "known": "known_src"}), "src", "left").join(known.withColumnsRenamed({"vertex": "dst", "known": "known_dst"}), "dst", "left")
    bad = F.col("known_src").isNull() | F.col("known_dst").isNull() | F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0)
    message = F.format_string("edge %s to %s (weight %s) is not of this graph", F.col("src"), F.col("dst"), F.col("weight"))
    return ends.select(F.when(bad, F.raise_error(message).cast("bigint")).otherwise(F.col("src")).alias("src"), "dst", "kind", "weight")


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, pos, kind, dst, weight): the edges of every vertex by (kind, dst), from position 0.

    As rows and not as a list in a row, since a vertex may have edges without bound.
    """
    return edges.select("src", (F.row_number().over(W.partitionBy("src").orderBy("kind", "dst")) - 1).alias("pos"), "kind", "dst", "weight")


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    @classmethod
    def build(cls, docs: DataFrame) -> Graph:
        vertices = build_vertices(docs)
        return cls(vertices, build_edges(vertices))

    def persist(self) -> Graph:
        self.vertices.persist(), self.edges.persist()
        return self

    def counts(self) -> DataFrame:
        """(v, e, resources, operations, dependencies); e is 2 (resources - 1) + 2 operations + dependencies."""
        v = self.vertices.agg(F.count(F.lit(1)).alias("v"), F.count_if(F.col("kind") == RESOURCE).alias("resources"), F.count_if(F.col("kind") == OPERATION).alias("operations"))
        e = self.edges.agg(F.count(F.lit(1)).alias("e"), F.count_if(F.col("kind") == DEPENDS_ON).alias("dependencies"))
        return v.crossJoin(F.broadcast(e)).select("v", "e", "resources", "operations", "dependencies")

    def degrees(self) -> DataFrame:
        """(vertex, degree): outgoing edges of all kinds; vertices without any are left out."""
        return self.edges.groupBy(F.col("src").alias("vertex")).agg(F.count(F.lit(1)).alias("degree"))

    def seeds(self, hits: DataFrame) -> DataFrame:
        """(qid, vertex, rank): the vertices of the hits (qid, rank, id); hits without a vertex have none."""
        return hits.join(vertex_of_id(self.vertices), "id").groupBy("qid", "vertex").agg(F.min("rank").alias("rank"))
