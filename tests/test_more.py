import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions.text import suffix_array_of
from quillgraph.operators import bounded, geometry, graph, learning, trees
from quillgraph.sources import graphs


def test_range_min(spark):
    rng = random.Random(1)
    v = [rng.randrange(9) if rng.random() > 0.1 else None for _ in range(150)]
    q = [(k, i, j) for k, (i, j) in enumerate((rng.randrange(150), rng.randrange(150)) for _ in range(60))] + [(90, 0, 149), (91, 7, 7)]
    s = spark.createDataFrame(list(enumerate(v)), "idx long, value long").repartition(3)
    for fan in (2, 4, 16):
        got = {r.qid: (r.pos, r.value) for r in trees.range_min(s, spark.createDataFrame(q, "qid long, i long, j long"), fan).collect()}
        for k, i, j in q:
            m = min(((v[p], p) for p in range(i, j + 1) if v[p] is not None), default=(None, None))
            assert got[k] == (m[1], m[0])
    assert trees.range_min(s.limit(0), spark.createDataFrame([(0, 0, 1)], "qid long, i long, j long")).first().pos is None


def test_trees(spark):
    assert trees.cartesian_parents(np.array([3, 1, 4, 1, 5])).tolist() == [1, 1, 3, 1, 3]
    rows = spark.createDataFrame([("banana",), ("",), (None,), ("aaaa",)], "t string").select("t", trees.suffix_tree("t").alias("n"), trees.cartesian_tree(F.transform(F.split("t", ""), F.ascii)).alias("c")).collect()
    for r in rows:
        if r.t is None:
            assert r.n is None and r.c is None
            continue
        nodes = {x.node: x for x in r.n}
        assert sorted(x // 2 for x in nodes if x % 2 == 0) == list(range(len(r.t)))
        branches = {r.t[i : i + k] for i in range(len(r.t)) for k in range(1, len(r.t)) if len({r.t[p + k : p + k + 1] for p in range(len(r.t)) if r.t.startswith(r.t[i : i + k], p)}) > 1}
        assert {r.t[x.start : x.start + x.depth] for x in r.n if x.node % 2} == branches | {""}
        for x in r.n:
            above = nodes[x.parent]
            assert x.node == x.parent or (above.depth < x.depth or x.node % 2 == 0) and r.t[x.start :].startswith(r.t[above.start : above.start + above.depth])
    h = trees.huffman_tree(spark.createDataFrame([("a", 5.0), ("b", 9.0), ("c", 12.0), ("d", 13.0), ("e", 16.0), ("f", 45.0)], "symbol string, weight double")).collect()
    assert {r.symbol: r.depth for r in h if r.symbol} == {"a": 4, "b": 4, "c": 3, "d": 3, "e": 3, "f": 1}
    assert trees.huffman_tree(spark.createDataFrame([], "symbol string, weight double")).isEmpty()
    assert list(suffix_array_of("ba")) == [1, 0]


def test_find_in_suffix_tree(spark):
    rng = random.Random(4)
    texts = ["banana", "", "aaaa", "a", "é𝄞é𝄞e", *("".join(rng.choice("ab") for _ in range(rng.randrange(30))) for _ in range(12))]
    pairs = {(t, t[i : i + k] + end) for t in texts for i in range(0, len(t) + 1, 3) for k in (0, 1, 2, 5, 40) for end in ("", "b", "\0")} | {("banana", "nab"), (None, "a"), ("a", None)}
    df = spark.createDataFrame(sorted(pairs, key=repr), "t string, p string").withColumn("nodes", trees.suffix_tree("t"))
    rows = df.select("t", "p", "nodes", trees.suffix_tree_find(F.col("t"), F.col("nodes"), F.col("p")).alias("f")).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        at = [i for i in range(len(r.t)) if r.t.startswith(r.p, i)] if r.t is not None and r.p is not None else []
        if r.t is None or r.p is None or not at and r.p:
            assert (r.f.node, r.f.start, r.f.n) == (None, None, None)
            continue
        assert (r.f.start, r.f.n) == (min(at, default=None), len(at))
        node = {x.node: x for x in r.nodes}
        up = node[node[r.f.node].parent]
        assert node[r.f.node].depth >= len(r.p) and (up.node == r.f.node or up.depth < len(r.p))
    assert df.limit(0).select(trees.suffix_tree_find(F.col("t"), F.col("nodes"), F.col("p")).alias("f")).isEmpty()


def grow(rows, names, discrete, threshold):
    """The rules of the tree, read off one node at a time: a function from a row to a label."""
    def bits(ys):
        return sum(-c * math.log2(c / len(ys)) for c in (ys.count(y) for y in set(ys)))

    ys = [r["y"] for r in rows]
    best = min(set(ys), key=lambda y: (-ys.count(y), y))
    options = []
    for k, f in enumerate(names):
        for c in [None] if f in discrete else range(1, max(r[f] for r in rows) + 1):
            parts = {}
            for r in rows:
                parts.setdefault(r[f] if c is None else r[f] >= c, []).append(r)
            options.append((round(sum(bits([r["y"] for r in p]) for p in parts.values()), 9), k, c or 0, parts))
    if len(rows) < 2 or len(set(ys)) < 2 or not options:
        return lambda r: best
    cost, k, c, parts = min(options, key=lambda o: o[:3])
    if bits(ys) - cost < threshold:
        return lambda r: best
    below = {v: grow(p, names, discrete, threshold) for v, p in parts.items()}
    return lambda r: below.get(r[names[k]] >= c if c else r[names[k]], lambda r: best)(r)


def test_c45(spark):
    rng = random.Random(4)
    rows = [{"a": rng.randrange(4), "b": rng.randrange(30), "c": rng.randrange(5)} for _ in range(300)]
    for r in rows:
        r["y"] = (r["a"] == 2) + 2 * (r["b"] > 11 and r["c"] != 1) if rng.random() < 0.9 else rng.randrange(3)
    df = spark.createDataFrame([(r["a"], r["b"], r["c"], r["y"]) for r in rows] + [(None, 1, 1, 1)], "a int, b int, c int, y int")
    tree = learning.c45(df, "y", ["a", "c"], ["b"])
    want = grow(rows, ["a", "c", "b"], {"a", "c"}, math.log2(4))
    test = [{"a": a, "b": b, "c": c} for a in range(6) for b in (0, 11, 12, 40) for c in range(6)]
    got = learning.classify(spark.createDataFrame([(r["a"], r["b"], r["c"]) for r in test], "a int, b int, c int"), tree)
    assert len(tree.child) > 3 and all(r.predicted == want({"a": r.a, "b": r.b, "c": r.c}) for r in got.collect())
    assert learning.classify(df, learning.c45(df.limit(0), "y", ["a"], ["b"])).first().predicted == -1


def test_lasso(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(200, 5))
    a[:, 4] = 0
    y = a @ [2.0, 0, -1, 0, 7] + 0.1 * rng.normal(size=200)
    df = spark.createDataFrame([(list(map(float, r)), float(t)) for r, t in zip(a, y)] + [(None, 1.0)], "v array<double>, y double").repartition(3)
    w, value = learning.lasso(df, 60.0)
    pull = 2 * a.T @ (y - a @ w)
    for j in range(5):
        assert abs(pull[j]) <= 60 + 1e-6 if w[j] == 0 else pull[j] == pytest.approx(math.copysign(60, w[j]), abs=1e-6)
    assert value == pytest.approx(((a @ w - y) ** 2).sum() + 60 * abs(w).sum()) and w[1] == w[4] == 0
    assert len(learning.lasso(df.limit(0), 1.0)[0]) == 0


def test_linear_program(spark):
    rng = random.Random(6)
    h = [(math.cos(t), math.sin(t), rng.uniform(1, 3)) for t in (rng.uniform(0, 6.28) for _ in range(60))]
    df = spark.createDataFrame(h + [(None, 1.0, 0.0)], "a double, b double, c double")
    for cx, cy in ((1, 0), (-0.3, 2)):
        x, y = learning.linear_program_2d(df, cx, cy)
        best = max(cx * p + cy * q for g, k in itertools.combinations(h, 2) for d in [g[0] * k[1] - g[1] * k[0]] for p, q in [((k[1] * g[2] - g[1] * k[2]) / d, (g[0] * k[2] - k[0] * g[2]) / d)] if all(r[0] * p + r[1] * q <= r[2] + 1e-9 for r in h))
        assert cx * x + cy * y == pytest.approx(best) and all(r[0] * x + r[1] * y <= r[2] + 1e-7 for r in h)
    assert learning.linear_program_2d(spark.createDataFrame([(1.0, 0.0, 1.0)], "a double, b double, c double"), 1, 1) == (math.inf, math.inf)
    flat = spark.createDataFrame([(-1.0, 1.0, 1.0), (1.0, 1.0, 1.0), (0.0, 1.0, 0.5)], "a double, b double, c double")
    assert learning.linear_program_2d(flat, 0, 1)[1] == pytest.approx(0.5)


def test_flow_and_partition(spark):
    rng = random.Random(8)
    rows = [(g, rng.randrange(8), rng.randrange(8), rng.randrange(9)) for g in range(6) for _ in range(24)]
    got = {r.graph: r.flow for r in bounded.max_flow(spark.createDataFrame(rows, "graph long, src long, dst long, cap long"), 0, 7).collect()}
    for g in range(6):
        sides = ({0, *c} for k in range(7) for c in itertools.combinations(range(1, 7), k))
        assert got[g] == min(sum(c for h, u, v, c in rows if h == g and u in side and v not in side) for side in sides)
    e = [(0, u, v) for k in (0, 10) for u, v in itertools.combinations(range(k, k + 6), 2)] + [(0, 5, 10), (0, 3, 3)]
    p = {r.vid: r.side for r in bounded.spectral_partition(spark.createDataFrame(e, "graph long, src long, dst long")).collect()}
    assert p == {v: v < 6 for v in (*range(6), *range(10, 16))}
    with pytest.raises(ValueError):
        bounded.max_flow(spark.createDataFrame(rows, "graph long, src long, dst long, cap long"), 0, 7, max_edges=3)


def test_le_lists(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(55)]
    order = list(range(30))
    rng.shuffle(order)
    dist = {}
    for s in range(30):
        dist[s, s], todo = 0, [s]
        for u in todo:
            for a, b in edges:
                if a == u and (s, b) not in dist:
                    dist[s, b] = dist[s, u] + 1
                    todo.append(b)
    want = {(v, u, dist[u, v]) for v in range(30) for i, u in enumerate(order) if (u, v) in dist and all(dist.get((w, v), 99) > dist[u, v] for w in order[:i])}
    got = graph.le_lists(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(v, i) for i, v in enumerate(order)], "vid long, ord long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_ray_cast(spark):
    tri = spark.createDataFrame([(5, [0.0, 0.0, 2.0], [4.0, 0.0, 2.0], [0.0, 4.0, 2.0]), (3, [0.0, 0.0, 1.0], [1.0, 0.0, 1.0], [0.0, 1.0, 1.0]), (9, [0.0, 0.0, 1.0], [1.0, 0.0, 1.0], [0.0, 1.0, 1.0]), (7, None, [0.0] * 3, [0.0] * 3)], "tid long, a array<double>, b array<double>, c array<double>")
    up, rays = [0.0, 0.0, 1.0], [(0, [0.2, 0.2, 0.0]), (1, [1.0, 1.0, 0.0]), (2, [3.0, 3.0, 0.0]), (3, [0.2, 0.2, 1.5]), (4, [0.2, 0.2, 5.0])]
    for levels in (0, 1, 6):
        got = geometry.ray_cast(spark.createDataFrame([(i, o, up) for i, o in rays] + [(6, None, up)], "rid long, o array<double>, d array<double>"), tri.repartition(2), levels)
        assert {r.rid: r.tid for r in got.collect()} == {0: 3, 1: 5, 2: -1, 3: 5, 4: -1, 6: -1}


def test_gap_adjacency(spark, tmp_path):
    e = [(0, 3), (0, 1), (0, 2), (2, 4), (4, 0)]
    df = spark.createDataFrame(e, "src long, dst long").repartition(3)
    graphs.write_gap_adjacency(df, 5, f"{tmp_path}/g")
    assert [r.value for r in spark.read.text(f"{tmp_path}/g").collect()] == ["5", "5", "3", "0", "1", "0", "1", "1", "1", "1", "4", "0"]
    assert sorted(map(tuple, graphs.read_gap_adjacency(spark, f"{tmp_path}/g").collect())) == sorted(e)
    both = graph.symmetrise(df)
    graphs.write_gap_adjacency(both, 5, f"{tmp_path}/s", symmetric=True)
    assert sorted(map(tuple, graphs.read_gap_adjacency(spark, f"{tmp_path}/s", symmetric=True).collect())) == sorted(map(tuple, both.collect()))
    (tmp_path / "bad").write_text("2 5 1 1 1\n")
    with pytest.raises(ValueError):
        graphs.read_gap_adjacency(spark, f"{tmp_path}/bad")
