"""Traversals: expansion of hits and call plans in closed form, and frontier loops for any graph.

Without depends_on the graph of a catalogue is a tree with edges both ways. The way between two operations goes
up to a common prefix of their paths and down again, so all vertices within reach of the hits come from one
equi-join on prefixes, bounded in the number of steps up and down; there is no loop. For graphs of another shape
``bfs``, ``shortest_paths`` and ``topo_levels`` go by rounds: the frontier joins the edges, what is reached already
is left out, and a checkpoint cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint, release
from .graph import DEPENDS_ON, OPERATION, Graph, vertex_of_id

HOPS, BUDGET, RELATED = 3, 3.0, 10


def reach(graph: Graph, hits: DataFrame, *, method: str = "bfs", hops: int = HOPS, budget: float = BUDGET) -> DataFrame:
    """(qid, vertex, kind, id, hops, cost): all vertices the hits (qid, rank, id) reach, themselves included.

    ``bfs`` is bounded by hops and costs them; ``dijkstra`` (edges to an operation cost a half) by budget. A negative
    bound is none. Hops and cost are those of the nearest hit.
    """
    v = graph.vertices
    # the hits, k for each query, are looked at twice: they are found once
    seeds = checkpoint(graph.seeds(hits).select("qid", "vertex"))
    release(v.sparkSession)
    # steps between resources that the bound leaves after leaving the hit's operation
    dijkstra = method == "dijkstra"
    bound = budget if dijkstra else hops
    most = None if bound < 0 else int(bound - 0.5 if dijkstra else bound - 1)
    steps = lambda n: F.sequence(F.lit(0), n if most is None else F.least(n, F.lit(max(most, 0))))
    shorter = lambda c: F.slice("segments", 1, F.size("segments") - F.col(c))
    up = seeds.join(v.select("vertex", "segments"), "vertex").select("qid", "segments", F.explode(steps(F.size("segments"))).alias("up")).select("qid", shorter("up").alias("prefix"), "up")
    up = up.groupBy("qid", "prefix").agg(F.min("up").alias("up"))
    # a vertex is reached from its own resource; an operation is one step further
    down = v.select("vertex", "kind", "id", "segments", F.explode(steps(F.size("segments"))).alias("down")).select("vertex", "kind", "id", shorter("down").alias("prefix"), "down")
    if most is None:
        near = up.join(down, "prefix")
    else:  # by the steps down that are left, too: a common prefix far up doesn't meet all that is below it
        left = F.sequence(F.lit(0), F.lit(max(most, 0)) - F.col("up"))
        near = up.select("qid", "prefix", "up", F.explode(left).alias("down")).join(down, ["prefix", "down"])
    near = near.groupBy("qid", "vertex").agg(F.first("kind").alias("kind"), F.first("id").alias("id"), F.min(F.col("up") + F.col("down")).alias("way"))
    is_op = F.col("kind") == OPERATION
    near = near.join(seeds.select("qid", "vertex", F.lit(True).alias("hit")), ["qid", "vertex"], "left")
    walked = F.when(F.col("hit"), 0).otherwise(1 + F.col("way") + is_op.cast("int"))
    paid = F.when(F.col("hit"), 0.0).otherwise(0.5 + F.col("way") + F.when(is_op, 0.5).otherwise(0.0)) if dijkstra else walked.cast("double")
    found = near.select("qid", "vertex", "kind", "id", walked.alias("hops"), paid.alias("cost"))
    if most is not None and most < 0:  # a bound below the first step leaves the hits
        return seeds.select("qid", "vertex").join(v.select("vertex", "kind", "id"), "vertex").select("qid", "vertex", "kind", "id", F.lit(0).alias("hops"), F.lit(0.0).alias("cost"))
    return found if bound < 0 else found.where(F.col("cost") <= bound)


def expand(reached: DataFrame, limit: int = RELATED) -> DataFrame:
    """(qid, pos, id, cost, hops): the operations reached that aren't hits, nearest first, then by id; limit 0 keeps all."""
    ops = reached.where((F.col("kind") == OPERATION) & (F.col("hops") > 0))
    placed = ops.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy("cost", "id", "vertex")))
    return (placed.where(F.col("pos") <= limit) if limit > 0 else placed).select("qid", "pos", "id", "cost", "hops")


def expand_stats(graph: Graph, reached: DataFrame, *, method: str = "bfs", hops: int = HOPS) -> DataFrame:
    """(qid, visited, scanned): vertices reached, and the edges of all kinds of those whose edges were followed."""
    both = reached.join(graph.degrees(), "vertex", "left")
    followed = F.lit(True) if method == "dijkstra" or hops < 0 else F.col("cost") < hops
    return both.groupBy("qid").agg(F.count(F.lit(1)).alias("visited"), F.coalesce(F.sum(F.when(followed, F.coalesce("degree", F.lit(0)))), F.lit(0)).alias("scanned"))


def call_plans(graph: Graph, hits: DataFrame) -> DataFrame:
    """(qid, rank, id, steps, scanned) of every hit that has a vertex: ids of what must be called before, then its own.

    An operation depends directly on all it depends on; the prerequisites by vertex come from the outer resource
    inwards. A plan is as long as its path has ids, so it is a list in a row.
    """
    v = graph.vertices.where(F.col("kind") == OPERATION).select("vertex", F.col("id").alias("step"))
    degree = graph.degrees()
    known = v.join(degree, "vertex", "left").select("vertex", "step", F.coalesce("degree", F.lit(0)).alias("degree"))
    needs = graph.edges.where(F.col("kind") == DEPENDS_ON).where("src != dst").select(F.col("src").alias("op"), F.col("dst").alias("vertex")).distinct()
    before = needs.join(known, "vertex").groupBy("op").agg(F.array_sort(F.collect_list(F.struct("vertex", "step"))).alias("before"), F.sum("degree").alias("more"))
    own = known.withColumnsRenamed({"vertex": "op", "degree": "own", "step": "id"}).join(before, "op", "left")
    first = hits.select("qid", "rank", "id").join(vertex_of_id(graph.vertices), "id").withColumnRenamed("vertex", "op")
    rows = first.join(own.drop("id"), "op")
    none = F.array().cast("array<string>")
    return rows.select("qid", "rank", "id", F.concat(F.coalesce(F.col("before.step"), none), F.array("id")).alias("steps"), (F.col("own") + F.coalesce("more", F.lit(0))).alias("scanned"))


def needing(plans: DataFrame) -> DataFrame:
    """The plans with a prerequisite."""
    return plans.where(F.size("steps") > 1)


def plan_stats(plans: DataFrame) -> DataFrame:
    """(qid, with_prerequisites, prerequisites, scanned)."""
    return plans.groupBy("qid").agg(F.count_if(F.size("steps") > 1).alias("with_prerequisites"), F.sum(F.size("steps") - 1).alias("prerequisites"), F.sum("scanned").alias("scanned"))


def grouped_plans(plans: DataFrame) -> DataFrame:
    """(qid, before, ranks): hits with the same prerequisites together, ranks ascending."""
    some = needing(plans).select("qid", "rank", F.slice("steps", 1, F.size("steps") - 1).alias("before"))
    return some.groupBy("qid", "before").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))


# ---- any graph


def bfs(edges: DataFrame, seeds: DataFrame, most: int = -1) -> DataFrame:
    """(vertex, depth, parent): what the seeds (vertex) reach over edges (src, dst) within ``most`` steps; -1 is no bound.

    Of several ways of equal length the one from the smallest parent counts. Rounds end when nothing new is met.
    """
    edges = edges.select("src", "dst").distinct()
    reached = checkpoint(seeds.select(F.col("vertex").cast("bigint").alias("vertex")).distinct().select("vertex", F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("parent")))
    depth = 0
    while most < 0 or depth < most:
        front = reached.where(F.col("depth") == depth).select(F.col("vertex").alias("src"))
        new = front.join(edges, "src").groupBy(F.col("dst").alias("vertex")).agg(F.min("src").alias("parent")).join(reached.select("vertex"), "vertex", "left_anti")
        depth += 1
        new = checkpoint(new.select("vertex", F.lit(depth).alias("depth"), "parent"))
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
        if depth % 16 == 0:
            reached = checkpoint(reached)
    return reached


def shortest_paths(edges: DataFrame, seeds: DataFrame, most: float = -1.0) -> DataFrame:
    """(vertex, dist, parent): least sums of weights over edges (src, dst, weight) within ``most``; below 0 is no bound.

    Rounds of relaxation from the vertices that came nearer in the round before; of equal ways the one from the
    smallest parent counts. Weights must be 0 or more.
    """
    edges = edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    at = checkpoint(seeds.select(F.col("vertex").cast("bigint").alias("vertex")).distinct().select("vertex", F.lit(0.0).alias("dist"), F.lit(None).cast("bigint").alias("parent"), F.lit(True).alias("moved")))
    while True:
        step = at.where("moved").select(F.col("vertex").alias("src"), "dist").join(edges, "src").select(F.col("dst").alias("vertex"), F.struct((F.col("dist") + F.col("weight")).alias("dist"), F.col("src").alias("parent")).alias("way"))
        if most >= 0:
            step = step.where(F.col("way.dist") <= most)
        best = step.groupBy("vertex").agg(F.min("way").alias("way"))
        both = at.join(best, "vertex", "full")
        nearer = F.col("way").isNotNull() & (F.col("dist").isNull() | (F.col("way.dist") < F.col("dist")))
        at = checkpoint(both.select("vertex", F.when(nearer, F.col("way.dist")).otherwise(F.col("dist")).alias("dist"), F.when(nearer, F.col("way.parent")).otherwise(F.col("parent")).alias("parent"), nearer.alias("moved")))
        if at.where("moved").isEmpty():
            return at.drop("moved")


def with_paths(reached: DataFrame) -> DataFrame:
    """``reached`` (vertex, parent, …) with ``path``, the vertices from a seed to each, by doubling the known ends."""
    at = checkpoint(reached.select("vertex", F.col("parent").alias("up"), F.array("vertex").alias("path")))
    while not at.where("up is not null").isEmpty():
        above = at.select(F.col("vertex").alias("up"), F.col("up").alias("further"), F.col("path").alias("head"))
        at = checkpoint(at.join(above, "up", "left").select("vertex", F.col("further").alias("up"), F.when(F.col("head").isNotNull(), F.concat("head", "path")).otherwise(F.col("path")).alias("path")))
    return reached.join(at.select("vertex", "path"), "vertex")


def topo_levels(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vertex, level): vertices without incoming edges have level 0, others one more than the highest before them.

    An order by level puts every vertex after all that point to it. A cycle is an error.
    """
    edges = edges.select("src", "dst").distinct()
    left = checkpoint(vertices.select("vertex"))
    done, level = None, 0
    while not left.isEmpty():
        held = edges.join(left.select(F.col("vertex").alias("src")), "src", "left_semi").select(F.col("dst").alias("vertex")).distinct()
        free = checkpoint(left.join(held, "vertex", "left_anti"))
        if free.isEmpty():
            raise ValueError("the edges have a cycle")
        left = checkpoint(left.join(free, "vertex", "left_anti"))
        free = free.withColumn("level", F.lit(level))
        done, level = free if done is None else done.unionByName(free), level + 1
    return done if done is not None else left.withColumn("level", F.lit(0))


_DFS = pa.schema([("vertex", pa.int64()), ("pre", pa.int64()), ("post", pa.int64()), ("parent", pa.int64()), ("on_cycle", pa.bool_())])


def dfs(edges: DataFrame, vertices: DataFrame, seeds: list[int] | None = None, most: int = 5_000_000) -> DataFrame:
    """(vertex, pre, post, parent, on_cycle) of a depth-first search, edges by (kind, dst); seeds default to all, by vertex.

    A depth-first order is sequential by nature: one task holds the graph, and more than ``most`` edges are an error
    before it starts. ``on_cycle`` marks the vertices of the first cycle that is met.
    """
    if edges.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} edges for a depth-first search in one task")
    rows = edges.select(F.col("src").cast("bigint").alias("a"), F.col("kind").cast("int").alias("kind"), F.col("dst").cast("bigint").alias("b"))
    rows = rows.unionByName(vertices.select(F.col("vertex").cast("bigint").alias("a"), F.lit(-1).alias("kind"), F.lit(None).cast("bigint").alias("b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, list[int]] = {}
        for b in batches:
            for src, kind, dst in zip(*[b.column(c).to_pylist() for c in ("a", "kind", "b")]):
                out.setdefault(src, [])
                if kind >= 0:
                    out[src].append(dst)
        pre: dict[int, int] = {}
        post: dict[int, int] = {}
        parent: dict[int, int | None] = {}
        cycle: set[int] | None = None
        for s in sorted(out) if seeds is None else seeds:
            if s not in out or s in pre:
                continue
            pre[s], parent[s] = len(pre), None
            open_now = [(s, iter(out[s]))]
            while open_now:
                u, rest = open_now[-1]
                to = next(rest, None)
                if to is None:
                    post[u] = len(post)
                    open_now.pop()
                elif to not in pre:
                    pre[to], parent[to] = len(pre), u
                    open_now.append((to, iter(out.get(to, []))))
                elif to not in post and cycle is None:
                    chain = [x for x, _ in open_now]
                    cycle = set(chain[chain.index(to) :])
        found = sorted(pre)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((found, [pre[v] for v in found], [post[v] for v in found], [parent[v] for v in found], [cycle is not None and v in cycle for v in found]), _DFS)], schema=_DFS)

    ordered = rows.repartition(1).sortWithinPartitions("a", "kind", "b")
    return ordered.mapInArrow(run, "vertex bigint, pre bigint, post bigint, parent bigint, on_cycle boolean")
