"""Graph, traversals and plans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.operators import traverse as T

DOCS = [
    ("list-cups", "get", "/bars/{bar}/cups"), ("make-cup", "post", "/bars/{bar}/cups"), ("get-cup", "get", "/bars/{bar}/cups/{cup_id}"), ("drop-cup", "delete", "/bars/{bar}/cups/{cup_id}"),
    ("list-lids", "get", "/bars/{bar}/cups/{cup_id}/lids"), ("get-lid", "get", "/bars/{bar}/cups/{cup_id}/lids/{lid_id}"), ("get-bar", "get", "/bars/{bar}"), ("list-jobs", "get", "/bars/{bar}/jobs"),
    ("get-job", "get", "/bars/{bar}/jobs/{number}"), ("get-org", "get", "/orgs/{org}"), ("list-cups", "GET", "/bars/{bar}/cups"), ("again", "get", "/bars/{bar}/cups"), ("root", "get", None), ("none", None, "//x//"),
]


@pytest.fixture(scope="module")
def built(spark):
    docs = spark.createDataFrame([(i, *d, "x") for i, d in enumerate(DOCS)], "doc_pos long, id string, method string, path string, vertex string")
    return G.Graph.build(docs)


@pytest.fixture(scope="module")
def plain():
    """The same graph by a walk: labels, ids, adjacency of (kind, to, weight)."""
    tree = {}
    for pos, (i, m, p) in enumerate(DOCS):
        segs = tuple((p or "").strip("/").split("/")) if (p or "").strip("/") else ()
        for n in range(len(segs) + 1):
            tree.setdefault(segs[:n], {})
        tree[segs].setdefault((m or "").upper(), (i, pos))
    vertices, number, op, first = [], {}, {}, {}
    def walk(node):
        number[node] = len(vertices)
        vertices.append(("/" + "/".join(node), None))
        for m, (i, _) in sorted(tree[node].items()):
            op[node, m] = len(vertices)
            first.setdefault(i, len(vertices))
            vertices.append((f"{m} /" + "/".join(node), i))
        for child in sorted(n for n in tree if len(n) == len(node) + 1 and n[:-1] == node):
            walk(child)
    walk(())
    adj = [[] for _ in vertices]
    for node in tree:
        v = number[node]
        if node:
            adj[number[node[:-1]]].append((0, v, 1.0))
            adj[v].append((1, number[node[:-1]], 1.0))
        for m in tree[node]:
            adj[v].append((2, op[node, m], 0.5))
            adj[op[node, m]].append((3, v, 0.5))
            for n in range(1, len(node) + 1):
                if node[n - 1].startswith("{") and node[n - 1].endswith("_id}") and "GET" in tree[node[: n - 1]]:
                    adj[op[node, m]].append((4, first[tree[node[: n - 1]]["GET"][0]], 1.0))
    return vertices, [sorted(a) for a in adj], first


def test_vertices_and_edges(built, plain):
    vertices, adj, _ = plain
    assert [(r.label, r.id) for r in built.vertices.orderBy("vertex").collect()] == vertices
    assert [r.vertex for r in built.vertices.orderBy("vertex").collect()] == list(range(len(vertices)))
    rows = G.adjacency(built.edges).orderBy("src", "pos").collect()
    assert [(r.src, r.pos, r.kind, r.dst, r.weight) for r in rows] == [(v, n, *e) for v, es in enumerate(adj) for n, e in enumerate(es)]
    c = built.counts().first()
    assert c.e == 2 * (c.resources - 1) + 2 * c.operations + c.dependencies and c.operations == 12


def test_filters_and_checked_edges(spark, built):
    assert {r.kind for r in built.edges.where(G.only(G.DEPENDS_ON)).collect()} == {4}
    assert {r.kind for r in built.edges.where(G.excluding(G.DEPENDS_ON)).collect()} == {0, 1, 2, 3}
    assert G.checked_edges(built.edges, built.vertices).count() == built.edges.count()
    for bad in ((0, 999, 0, 1.0), (0, 1, 0, -1.0), (0, 1, 0, float("nan"))):
        with pytest.raises(Exception, match="not of this graph"):
            G.checked_edges(spark.createDataFrame([bad], "src long, dst long, kind int, weight double"), built.vertices).collect()


def test_empty_catalogue_has_the_root(spark):
    g = G.Graph.build(spark.createDataFrame([], "doc_pos long, id string, method string, path string"))
    assert [tuple(r)[:2] for r in g.vertices.collect()] == [(0, 0)] and g.edges.count() == 0


def distances(adj, seeds, structural, cost):
    dist = {s: (0.0, 0) for s in seeds}
    changed = True
    while changed:
        changed = False
        for u in list(dist):
            for kind, to, w in adj[u]:
                if structural and kind == 4:
                    continue
                new = (dist[u][0] + (w if cost else 1), dist[u][1] + 1)
                if to not in dist or new < dist[to]:
                    dist[to], changed = new, True
    return dist


HITS = [("a", 1, "drop-cup"), ("a", 2, "get-org"), ("a", 3, "unknown"), ("a", 4, "again"), ("b", 1, "list-lids"), ("c", 1, "nothing")]


@pytest.mark.parametrize("method,bound", [("bfs", 0), ("bfs", 1), ("bfs", 2), ("bfs", 3), ("bfs", 5), ("bfs", -1), ("dijkstra", 0.0), ("dijkstra", 0.5), ("dijkstra", 2.7), ("dijkstra", 3.0), ("dijkstra", -1.0)])
def test_reach_is_that_of_a_search(spark, built, plain, method, bound):
    vertices, adj, first = plain
    hits = spark.createDataFrame(HITS, "qid string, rank int, id string")
    how = {"hops": bound} if method == "bfs" else {"budget": bound}
    reached = T.reach(built, hits, method=method, **how)
    got = {(r.qid, r.vertex): (r.cost, r.hops) for r in reached.collect()}
    want, scanned = {}, {}
    for q in {h[0] for h in HITS}:
        seeds = [first[i] for p, _, i in HITS if p == q and i in first]
        for v, (c, n) in distances(adj, seeds, True, method == "dijkstra").items():
            if bound < 0 or c <= bound:
                want[q, v] = (c, n)
                if method == "dijkstra" or bound < 0 or c < bound:
                    scanned[q] = scanned.get(q, 0) + len(adj[v])
    assert got == want
    told = {r.qid: (r.visited, r.scanned) for r in T.expand_stats(built, reached, method=method, hops=bound if method == "bfs" else 3).collect()}
    assert told == {q: (sum(k[0] == q for k in want), scanned.get(q, 0)) for q in {k[0] for k in want}}
    near = sorted((q, c, vertices[v][1]) for (q, v), (c, n) in want.items() if vertices[v][1] and n)
    assert sorted((r.qid, r.cost, r.id) for r in T.expand(reached, 0).collect()) == near
    assert all(r.pos <= 2 for r in T.expand(reached, 2).collect())


def test_plans(spark, built, plain):
    _, adj, _ = plain
    hits = spark.createDataFrame([("a", 1, "get-lid"), ("a", 2, "get-org"), ("a", 3, "drop-cup"), ("a", 4, "get-cup"), ("a", 5, "unknown")], "qid string, rank int, id string")
    plans = {r["rank"]: (r.steps, r.scanned) for r in T.call_plans(built, hits).collect()}
    assert {k: s for k, (s, _) in plans.items()} == {1: ["list-cups", "list-lids", "get-lid"], 2: ["get-org"], 3: ["list-cups", "drop-cup"], 4: ["list-cups", "get-cup"]}
    rows = T.call_plans(built, hits)
    assert {r["rank"] for r in T.needing(rows).collect()} == {1, 3, 4}
    s = T.plan_stats(rows).first()
    assert (s.with_prerequisites, s.prerequisites, s.scanned) == (3, 4, sum(n for _, n in plans.values()))
    assert {(tuple(r.before), tuple(r.ranks)) for r in T.grouped_plans(rows).collect()} == {(("list-cups", "list-lids"), (1,)), (("list-cups",), (3, 4))}


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, kind int, weight double")


@pytest.mark.parametrize("seed", range(3))
def test_rounds_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(5, 25)
    rows = [(rng.randrange(n), rng.randrange(n), 0, rng.randint(0, 7) / 2) for _ in range(rng.randrange(2 * n) + 1)]
    adj = [[] for _ in range(n)]
    for s, d, k, w in rows:
        adj[s].append((k, d, w))
    seeds = spark.createDataFrame([(0,), (n - 1,)], "vertex long")
    for most in (-1.0, 2.5):
        got = {r.vertex: r.dist for r in T.shortest_paths(edges_of(spark, rows), seeds, most).collect()}
        assert got == {v: c for v, (c, _) in distances(adj, [0, n - 1], False, True).items() if most < 0 or c <= most}
    for most in (-1, 2):
        reached = T.bfs(edges_of(spark, rows), seeds, most)
        got = {r.vertex: r.depth for r in reached.collect()}
        assert got == {v: c for v, (c, _) in distances(adj, [0, n - 1], False, False).items() if most < 0 or c <= most}
    paths = {r.vertex: r.path for r in T.with_paths(reached).collect()}
    pairs = {(s, d) for s, d, *_ in rows}
    assert all(len(p) == got[v] + 1 and p[-1] == v and p[0] in (0, n - 1) and set(zip(p, p[1:])) <= pairs for v, p in paths.items()) and paths.keys() == got.keys()


def test_order_and_cycles(spark):
    vertices = spark.createDataFrame([(i,) for i in range(4)], "vertex long")
    line = edges_of(spark, [(0, 1, 4, 1.0), (1, 2, 4, 1.0), (0, 2, 4, 1.0)])
    assert {r.vertex: r.level for r in T.topo_levels(line, vertices).collect()} == {0: 0, 1: 1, 2: 2, 3: 0}
    ring = edges_of(spark, [(0, 1, 4, 1.0), (1, 2, 4, 1.0), (2, 0, 4, 1.0)])
    with pytest.raises(ValueError):
        T.topo_levels(ring, vertices)
    found = {r.vertex: r for r in T.dfs(ring, vertices).collect()}
    assert {v for v, r in found.items() if r.on_cycle} == {0, 1, 2}
    got = {r.vertex: (r.pre, r.post, r.parent) for r in T.dfs(line, vertices).collect()}
    assert got == {0: (0, 2, None), 1: (1, 1, 0), 2: (2, 0, 1), 3: (3, 3, None)}
    assert {r.vertex for r in T.dfs(line, vertices, [1, 9]).collect()} == {1, 2}
    with pytest.raises(ValueError):
        T.dfs(line, vertices, most=2)


def test_ways_by_number_and_by_weight_differ(spark):
    e = edges_of(spark, [(0, 3, 0, 10.0), (0, 1, 0, 1.0), (1, 2, 0, 1.0), (2, 3, 0, 1.0)])
    seed = spark.createDataFrame([(0,)], "vertex long")
    by_steps = {r.vertex: r.path for r in T.with_paths(T.bfs(e, seed)).collect()}
    by_cost = {r.vertex: r.path for r in T.with_paths(T.shortest_paths(e, seed)).collect()}
    assert by_steps[3] == [0, 3] and by_cost[3] == [0, 1, 2, 3]


def test_numbers_follow_the_order(spark):
    from tidemark.session import numbered

    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x")).repartition(7)
    assert [(r.x, r.n) for r in numbered(rows, "x", name="n").orderBy("x").collect()] == [(i, i) for i in range(1000)]
