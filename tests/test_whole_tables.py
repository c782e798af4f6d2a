"""Queries over whole tables, against brute force on small ones, and all SQL on the smallest tables."""

import random
from collections import Counter, deque

import duckdb
import numpy as np
import pytest

from quillgraph import catalog
from quillgraph.operators.components import UnionFind

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Line items and orders with cycles, and their folder."""
    rng, folder = random.Random(11), str(tmp_path_factory.mktemp("tables"))
    rows = [(rng.randrange(40), 1 + rng.randrange(9), k, float(rng.randrange(1, 51)), rng.randrange(100, 9999) / 100) for k in range(70)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{folder}/lineitem.parquet")
    orders = [(k, rng.randrange(9), rng.randrange(100, 99999) / 100) for k in range(40)] + [(90, 20, 5.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    so = {}
    for o, s, _, _, price in rows:
        e = 2 * s, 2 * o + 1
        so[e] = min(so.get(e, 10**9), round(price * 100))
    co, last = {}, {}
    for o, c, price in sorted(orders):
        co[2 * c, 2 * o + 1] = round(price * 100)
        if c in last:
            co[2 * last[c] + 1, 2 * o + 1] = (round(price * 100) + 1) // 2
        last[c] = o
    return folder, so, co


def ran(spark, name, folder):
    return [tuple(r) for r in catalog.QUERIES[name](spark, folder).collect()]


def neighbours(w):
    near = {}
    for u, v in w:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    return near


def forest_of(w, weight):
    eids, sets, forest = {e: k for k, e in enumerate(sorted(w))}, UnionFind(), []
    for e in sorted(w, key=lambda e: (weight(e), eids[e])):
        if sets.union(*e):
            forest.append((eids[e], *e))
    return forest, sets


def test_forests_and_components(spark, tables):
    folder, so, co = tables
    for name, w in (("msf_supplier_orders", so), ("msf_customer_orders", co)):
        forest, sets = forest_of(w, w.get)
        assert len(forest) < len(w)  # there are cycles
        assert sorted(ran(spark, name, folder)) == sorted((k, u, v, w[u, v]) for k, u, v in forest)
    labels = {v: sets.find(v) for v in neighbours(co)}
    assert dict(ran(spark, "cc_labels", folder)) == labels
    assert dict(ran(spark, "cc_sizes", folder)) == Counter(labels.values()) and len(set(labels.values())) > 5
    assert sorted(ran(spark, "spanning_forest", folder)) == sorted(forest_of(co, lambda e: 0)[0])
    assert dict(ran(spark, "edge_degrees", folder)) == {v: len(n) for v, n in neighbours(so).items()}


def test_walks(spark, tables):
    folder, so, _ = tables
    near = neighbours(so)
    level = {min(u for u, _ in so): 0}
    todo = deque(level)
    while todo:
        v = todo.popleft()
        for x in near[v]:
            if x not in level:
                level[x] = level[v] + 1
                todo.append(x)
    assert dict(ran(spark, "bfs_levels", folder)) == level


def test_choices(spark, tables):
    folder, _, co = tables
    near = neighbours(co)
    core, left, k = {}, {v: set(n) for v, n in near.items()}, 0
    while left:
        v = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[v]))
        core[v] = k
        for x in left.pop(v):
            left[x].discard(v)
    assert max(core.values()) > 1 and dict(ran(spark, "kcore_customer_orders", folder)) == core
    chosen = {v for v, in ran(spark, "maximal_independent_set", folder)}
    assert all((v in chosen) != bool(near[v] & chosen) for v in near)
    colour = dict(ran(spark, "colouring", folder))
    assert set(colour) == set(near) and all(colour[u] != colour[v] for u, v in co)
    matched = ran(spark, "maximal_matching", folder)
    ends = [x for _, u, v in matched for x in (u, v)]
    assert len(ends) == len(set(ends)) and all({u, v} & set(ends) for u, v in co)

    def parted(e):
        sets = UnionFind()
        for f in co:
            if f != e:
                sets.union(*f)
        return sets.find(e[0]) != sets.find(e[1])

    want = {(min(e), max(e)) for e in co if parted(e)}
    assert want and set(ran(spark, "bridges", folder)) == want


def test_whole_fourier(spark, tmp_path):
    rng = random.Random(3)
    sizes = {1: 1, 2: 2, 3: 3, 4: 5, 5: 8, 6: 9, 7: 37}
    rows = [(c * 1000 + k, c, rng.randrange(1, 10**6) / 100) for c, n in sizes.items() for k in range(n)]
    spark.createDataFrame(rng.sample(rows, len(rows)), "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r[0], r[1]): r[2:] for r in ran(spark, "fourier", str(tmp_path))}
    want = {}
    for c, n in sizes.items():
        x = [p for _, d, p in rows if d == c]
        for k, y in enumerate(np.fft.fft(x + [0.0] * ((1 << (n - 1).bit_length()) - n))):
            want[c, k] = y.real, y.imag
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=2e-3) for k in want)


@pytest.mark.parametrize("name", ["cc_supplier_orders", "msf_supplier_parts", "msf_filtered", "msf_hybrid", "bucketed_dijkstra", "bfs_directed", "betweenness", "low_diameter_clusters", "adjacency_file", "matrix_market_file", "triangles_file", "map_insert", "range_min", "suffix_tree_nodes", "suffix_tree_find", "kmeans", "knn", "ray_cast", "seq_scan_custom"])
def test_sql_of_the_smallest_tables(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(catalog.ORACLES[name])
    at = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
