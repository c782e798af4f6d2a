"""Readers, writers, keyed tables, tags and sweeps of the core, on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.scalar import hash10_weight, hash32, hash64, hash_combine, mix, mix_sql
from quillgraph.operators import biconnected, geometry, graph, keyed, msf, numeric, scan, seq, sort
from quillgraph.sources import graphs


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_writers(spark, tmp_path):
    e = spark.createDataFrame([(0, 1, 2.5), (0, 3, 1.0), (2, 0, 4.0)], "src long, dst long, w double").repartition(3)
    graphs.write_adjacency(e, 4, f"{tmp_path}/a")
    assert rows(graphs.read_graph(spark, f"{tmp_path}/a", "adjacency")) == rows(e)
    graphs.write_adjacency(e.drop("w"), 4, f"{tmp_path}/b", ordered=False)
    back = graphs.read_adjacency(spark, f"{tmp_path}/b")
    assert back.count() == 3 and sorted(r.n for r in back.groupBy("src").agg(F.count("*").alias("n")).collect()) == [1, 2]
    graphs.write_edge_text(e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")), 4, f"{tmp_path}/t")
    assert rows(graphs.read_graph(spark, f"{tmp_path}/t", "edges")) == [(0, 1), (0, 2), (0, 3)]
    w = spark.createDataFrame([(0, 1, 7), (2, 1, 5)], "u long, v long, w long")
    graphs.write_matrix_market(w, 3, f"{tmp_path}/m")
    assert [tuple(r) for r in graphs.read_graph(spark, f"{tmp_path}/m", "mtx").orderBy("eid").collect()] == [(0, 0, 1, 7), (1, 0, 1, 7), (2, 1, 2, 5), (3, 1, 2, 5)]
    with pytest.raises(ValueError):
        graphs.read_graph(spark, f"{tmp_path}/m", "csv")
    with pytest.raises(ValueError):
        graphs.read_matrix_market(spark, f"{tmp_path}/m", weight="none")
    p = spark.createDataFrame([(0, 0.5, 1.0, 2.0), (1, 3.0, 4.0, 5.5)], "idx long, x double, y double, z double")
    graphs.write_points(p, f"{tmp_path}/p")
    assert rows(graphs.read_points(spark, f"{tmp_path}/p")) == rows(p)
    graphs.write_triangles(p, spark.createDataFrame([(0, 0, 1, 1)], "tid long, a long, b long, c long"), f"{tmp_path}/tri")
    points, triangles = graphs.read_triangles(spark, f"{tmp_path}/tri", 3)
    assert rows(points) == rows(p) and rows(triangles) == [(0, 0, 1, 1)]
    (tmp_path / "c.txt").write_text("hello")
    assert [bytes(graphs.read_chars(spark, f"{tmp_path}/c.txt", *r).first().content) for r in ((), (1, 3), (2, 99), (9,))] == [b"hello", b"el", b"llo", b""]


def test_decision_table(spark, tmp_path):
    (tmp_path / "t.csv").write_text("d,i,d\n1,20,0\n2,30,1\n3,7,1\n1,1,0\n5,5,0\n")
    t, kinds = graphs.read_decision_table(spark, f"{tmp_path}/t.csv")
    assert kinds == ["d", "i", "d"] and [tuple(r) for r in t.orderBy("idx").collect()][1] == (1, 2, 30, 1)
    a, b = graphs.split_by_position(t)
    assert (a.count(), b.count()) == (4, 1)
    (tmp_path / "bad.csv").write_text("x,i\n1,2\n")
    with pytest.raises(ValueError):
        graphs.read_decision_table(spark, f"{tmp_path}/bad.csv")


def test_hashes(spark):
    import duckdb

    v = [0, 1, 2, 3, 61, 10**6, 2**31, 2**40 + 5]
    got = spark.createDataFrame([(x,) for x in v], "x long").select("x", mix(F.col("x")).alias("a"), mix(F.col("x"), 9).alias("b"), hash10_weight(F.col("x")).alias("w"), hash32(F.col("x")).alias("h"), hash_combine(hash64(F.col("x")), F.lit(1)).alias("c")).collect()
    con = duckdb.connect()
    assert [(r.a, r.b) for r in got] == [con.execute(f"select {mix_sql(str(x))}, {mix_sql(str(x), 9)}").fetchone() for x in v]
    assert all(1 <= r.w <= 10 for r in got) and len({r.h for r in got}) == len({r.c for r in got}) == len(v)


def test_keyed_tables(spark):
    at = spark.createDataFrame([(1, 10, 0), (2, 20, 1), (1, 11, 2), (None, 5, 3)], "key long, value long, at long")
    t = keyed.build(at)
    assert rows(t) == [(1, 10), (2, 20)] and keyed.size(t).first().n == 2
    more = spark.createDataFrame([(2, 1, 0), (3, 30, 2), (3, 31, 1)], "key long, value long, at long")
    assert rows(keyed.insert(t, more)) == [(1, 10, False), (2, 20, False), (3, 31, True)]
    assert rows(keyed.update(t, more)) == [(1, 10), (2, 1), (3, 30)]
    assert rows(keyed.delete(t, spark.createDataFrame([(2,), (2,), (9,)], "key long"))) == [(1, 10)]
    assert sorted(map(tuple, keyed.find(t, spark.createDataFrame([(1,), (9,), (1,), (None,)], "key long")).collect()), key=str) == [(1, 10, True), (1, 10, True), (9, None, False), (None, None, False)]
    assert keyed.build(at.limit(0)).isEmpty()


def test_tags(spark):
    e = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (6, 7), (3, 3), (1, 0)]
    t = {r.vid: r for r in biconnected.tags(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert {v: (r.root, r.level) for v, r in t.items()} == {0: (0, 0), 1: (0, 1), 2: (0, 1), 3: (0, 2), 4: (0, 3), 5: (0, 3), 6: (6, 0), 7: (6, 1)}
    assert {v: (r.first, r.last) for v, r in t.items() if r.root == 0} == {0: (0, 5), 1: (1, 1), 2: (2, 5), 3: (3, 5), 4: (4, 4), 5: (5, 5)}
    assert (t[1].low, t[1].high, t[4].high, t[3].low) == (1, 2, 5, 3)
    assert rows(biconnected.bridges(spark.createDataFrame(e, "src long, dst long"))) == [(2, 3), (6, 7)]
    assert biconnected.tags(spark.createDataFrame([], "src long, dst long")).isEmpty()


def test_forests_in_parts(spark):
    rng = random.Random(3)
    e = spark.createDataFrame([(k, rng.randrange(30), rng.randrange(30), rng.randrange(9)) for k in range(200)], "eid long, u long, v long, w long").repartition(3)
    want = rows(msf.minimum_spanning_forest(e))
    assert rows(msf.filter_kruskal(e)) == rows(msf.filter_kruskal(e, 0.01, 0)) == rows(msf.hybrid_msf(e, 3)) == want
    assert sum(msf.chunk_sizes(1000, 4)) == 1000 and msf.chunk_sizes(10**9, 2)[-1] == 10**8
    assert msf.hybrid_msf(e.limit(0), 2).isEmpty() and msf.filter_kruskal(e.limit(0)).isEmpty()


def test_buckets(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(25), rng.randrange(25), rng.randrange(12)) for _ in range(70)]
    e = spark.createDataFrame(edges, "src long, dst long, w long")
    want = rows(graph.bellman_ford(e, 0))
    assert all(rows(graph.bucketed_dijkstra(e, 0, width)) == want for width in (1, 5, 1000))
    with pytest.raises(ValueError):
        graph.bucketed_dijkstra(spark.createDataFrame([(0, 1, -1)], "src long, dst long, w long"), 0, 1)


def test_sequences(spark):
    s = spark.createDataFrame(list(enumerate([3, 1, 2, 5])), "idx long, value long").repartition(2)
    got = lambda df, c="value": [r[c] for r in df.orderBy("idx").collect()]
    assert got(seq.split_two(s, "value % 2 = 0")) == [3, 1, 5, 2]
    assert got(seq.resize(s, 6, 9)) == [3, 1, 2, 5, 9, 9] and got(seq.resize(s, 2)) == [3, 1]
    assert got(scan.scan(s, "product"), "scan") == [1, 3, 3, 6]
    text = s.select("idx", F.col("value").cast("string").alias("value"))
    assert got(scan.custom_scan(text, lambda a, b: a + b, "", "string", block=2), "scan") == ["", "3", "31", "312"]
    assert got(scan.custom_scan(text, lambda a, b: a + b, "", "string", True, block=3), "scan") == ["3", "31", "312", "3125"]
    assert sort.kth_smallest_approximate(s, 2).first().value in (2, 3, 5) and sort.kth_smallest_approximate(s, 9).isEmpty()
    m = spark.createDataFrame([(0, 1, 5)], "row long, col long, value long")
    assert rows(numeric.transpose(m)) == [(1, 0, 5)]


@pytest.mark.parametrize("seed", range(3))
def test_nearest(spark, seed):
    """Clusters, repeated places and queries far off."""
    rng = random.Random(seed)
    pts = [(i, [rng.choice([0.0, 100.0, 1e4]) + rng.random(), rng.random(), float(rng.randrange(3)), rng.random()]) for i in range(60)] + [(100 + i, [5.0, 5.0, 5.0, 5.0]) for i in range(9)]
    queries = [(i, p) for i, p in pts[::7]] + [(1000, [-1e6, 0.0, 0.0, 0.0]), (1001, [5.0, 5.0, 5.0, 5.0])]
    schema = "id long, v array<double>"
    got = {r.id: r.neighbours for r in numeric.knn(spark.createDataFrame(pts, schema), 4, queries=spark.createDataFrame(queries, schema)).collect()}
    for i, q in queries:
        near = sorted((sum((a - b) ** 2 for a, b in zip(p, q)), j) for j, p in pts if j != i)[:4]
        assert got[i] == [j for _, j in reversed(near)]
    assert numeric.knn(spark.createDataFrame(pts[:1], schema), 2).first().neighbours == [-1, -1]


def test_rays_and_hulls(spark):
    rng = random.Random(7)
    tri = [(i, *([rng.uniform(0, 10) for _ in range(3)] for _ in range(3))) for i in range(40)] + [(50 + i, *([x + rng.uniform(0, 0.3) for x in (i, i, 5.0)] for _ in range(3))) for i in range(8)]
    rays = [(i, [rng.uniform(-5, 15) for _ in range(3)], [rng.choice([0.0, rng.uniform(-1, 1)]) for _ in range(3)]) for i in range(40)]
    got = {r.rid: r.tid for r in geometry.ray_cast(spark.createDataFrame(rays, "rid long, o array<double>, d array<double>"), spark.createDataFrame(tri, "tid long, a array<double>, b array<double>, c array<double>")).collect()}

    def minus(x, y):
        return [a - b for a, b in zip(x, y)]

    def cross(x, y):
        return [x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0]]

    def dot(x, y):
        return sum(a * b for a, b in zip(x, y))

    for i, o, d in rays:
        met = []
        for k, a, b, c in tri:
            e1, e2, s = minus(b, a), minus(c, a), minus(o, a)
            p, q = cross(d, e2), cross(s, e1)
            if abs(det := dot(e1, p)) > 1e-12 and dot(s, p) / det >= 0 and dot(d, q) / det >= 0 and (dot(s, p) + dot(d, q)) / det <= 1 and dot(e2, q) / det > 0:
                met.append((dot(e2, q) / det, k))
        assert got[i] == min(met, default=(0, -1))[1]
    p = spark.range(0, 2000, 1, 16).select(F.col("id").alias("idx"), F.cos("id").alias("x"), F.sin("id").alias("y"))
    hull = geometry.upper_hull(p)
    xs = [r.x for r in hull.orderBy("x").collect()]
    assert xs == sorted(xs) and len(xs) > 500


def in_files(path, *texts):
    """A folder of files in the order of their names, as a written table has."""
    path.mkdir()
    for i, text in enumerate(texts):
        (path / f"part-{i:05d}.txt").write_text(text)
    return str(path)


def test_decision_table_of_files_of_rising_size(spark, tmp_path):
    from quillgraph.sources.graphs import read_decision_table

    path = in_files(tmp_path / "t", "d,i,d\n0,0,0\n", "".join(f"{i},{i},1\n" for i in range(1, 50)), "".join(f"{i},{i},2\n" for i in range(50, 200)))
    rows, kinds = read_decision_table(spark, path)
    assert kinds == ["d", "i", "d"]
    assert sorted((r.idx, r.c0) for r in rows.collect()) == [(i, i) for i in range(200)]


def test_sequence_of_files_of_rising_size(spark, tmp_path):
    path = in_files(tmp_path / "s", "sequenceInt\n0\n", "".join(f"{i}\n" for i in range(1, 50)), "".join(f"{i}\n" for i in range(50, 200)))
    assert rows(graphs.read_sequence(spark, path)) == [(i, i) for i in range(200)]


def test_triangles_of_files_of_rising_size(spark, tmp_path):
    path = in_files(tmp_path / "t", "pbbs_triangles\n4\n40\n", "".join(f"{i}.5 0.0\n" for i in range(4)), "".join(f"{1 + i % 4} {1 + (i + 1) % 4} {1 + (i + 2) % 4}\n" for i in range(40)))
    points, found = graphs.read_triangles(spark, path)
    assert rows(points) == [(i, i + 0.5, 0.0) for i in range(4)]
    assert rows(found) == [(i, i % 4, (i + 1) % 4, (i + 2) % 4) for i in range(40)]


def test_adjacency_of_files_of_rising_size(spark, tmp_path):
    ends = [(u, v) for u in range(10) for v in range(10) if u != v]
    path = in_files(tmp_path / "a", "AdjacencyGraph\n10\n90\n", "".join(f"{9 * u}\n" for u in range(10)), "".join(f"{v}\n" for _, v in ends))
    assert rows(graphs.read_adjacency(spark, path)) == ends


def test_edge_text_of_files_of_rising_size(spark, tmp_path):
    path = in_files(tmp_path / "e", "50 98\n", "".join(f"{i} {i + 1}\n{i + 1} {i}\n" for i in range(9)), "".join(f"{i} {i + 1}\n{i + 1} {i}\n" for i in range(9, 49)))
    assert rows(graphs.read_edge_text(spark, path)) == [(i, i + 1) for i in range(49)]


def test_generated_weights_of_files_of_rising_size(spark, tmp_path):
    path = in_files(tmp_path / "g", "%%MatrixMarket\n90 90 80\n", "".join(f"{i} {i + 1} 7\n" for i in range(1, 10)), "".join(f"{i} {i + 1} 7\n" for i in range(10, 81)))
    assert rows(graphs.read_matrix_market(spark, path, weight="generated")) == [(i, i, i + 1, i * (i + 1) % 90 + 1) for i in range(80)]


def test_matrix_market_of_files_of_rising_size(spark, tmp_path):
    path = in_files(tmp_path / "m", "%%MatrixMarket\n90 90 80\n", "".join(f"{i} {i + 1} {i}\n" for i in range(1, 10)), "".join(f"{i} {i + 1} {i}\n" for i in range(10, 81)))
    assert rows(graphs.read_matrix_market(spark, path)) == [(i, i, i + 1, i + 1) for i in range(80)]


def test_digits_of_numbers_beyond_two_digits(spark):
    numbers = [0, 5, 2**31, 2**32 - 1, 2**32, 2**63 - 1, 2**63, 2**64 - 1, 2**64, 9 * 10**20, 10**37, -1, -(2**63) - 1]
    d = spark.createDataFrame([(str(x),) for x in numbers], "x string").select("x", numeric.big_digits(F.col("x").cast("decimal(38,0)")).alias("d"))
    one = F.array(F.lit(1).cast("long"))
    for r in d.select("x", "d", numeric.big_multiply("d", one).alias("least")).collect():
        assert list(r.d) == [(int(r.x) >> 32 * i) % 2**32 for i in range(4)], r.x
        x, n = int(r.x), len(r.least)
        assert list(r.least) == [(x >> 32 * i) % 2**32 for i in range(n)] and -(2 ** (32 * n - 1)) <= x < 2 ** (32 * n - 1), r.x


def test_custom_scan_beyond_a_million_positions(spark):
    from quillgraph.catalog_files import custom_maximum

    s = spark.createDataFrame([(2_000_000, 3), (2_000_001, 1), (2_000_002, 7)], "idx long, value long")
    assert rows(custom_maximum(s)) == [(2_000_000, 3, 5_000_000), (2_000_001, 1, 5_000_000), (2_000_002, 7, 9_000_002)]


def test_points_of_files_of_rising_size(spark, tmp_path):
    path = in_files(tmp_path / "p", "pbbs_sequencePoint2d\n", "".join(f"{i}.5 1.0\n" for i in range(9)), "".join(f"{i}.5 1.0\n" for i in range(9, 40)))
    assert rows(graphs.read_points(spark, path)) == [(i, i + 0.5, 1.0) for i in range(40)]


def test_box_join_of_one_file_is_spread(spark):
    b = spark.range(0, 300, 1, 1).selectExpr("id", "cast(id % 20 as double) as x0", "id % 20 + 1.5 as x1", "cast(id % 15 as double) as y0", "id % 15 + 1.5 as y1")
    found = geometry.box_overlaps(b, 4.0)
    assert found.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    side = [(i, i % 20, i % 15) for i in range(300)]
    assert rows(found) == sorted((i, j) for i, x, y in side for j, v, w in side if i < j and abs(x - v) < 1.5 and abs(y - w) < 1.5)


def test_rays_through_many_triangles(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    # corners on a lattice, so that ends and sides are met and many triangles at once; edges along axes are solved without rounding
    a = rng.integers(0, 5, (400, 3)) / 4
    flat = rng.integers(0, 3, 400)
    e = np.zeros((2, 400, 3))
    e[0, np.arange(400), (flat + 1) % 3], e[1, np.arange(400), (flat + 2) % 3] = 0.5, 0.5
    o = rng.integers(0, 9, (60, 3)) / 8
    d = np.eye(3)[rng.integers(0, 3, 60)] * rng.choice([-1.0, 1.0], (60, 1)) + np.where(rng.random((60, 3)) < 0.3, 0.25, 0.0)
    want = []
    for i in range(60):
        best = (np.inf, -1)
        for j in range(400):
            k, p, q = flat[j], (flat[j] + 1) % 3, (flat[j] + 2) % 3
            if d[i, k] and (t := (a[j, k] - o[i, k]) / d[i, k]) > 0:
                u, v = ((o[i, x] + t * d[i, x] - a[j, x]) / 0.5 for x in (p, q))
                if u >= 0 and v >= 0 and u + v <= 1:
                    best = min(best, (t, j))
        want.append((i, best[1]))
    assert len({x for _, x in want}) > 10
    rays = spark.createDataFrame([(i, o[i].tolist(), d[i].tolist()) for i in range(60)], "rid long, o array<double>, d array<double>")
    tri = spark.createDataFrame([(j, a[j].tolist(), e[0, j].tolist(), e[1, j].tolist()) for j in range(400)], "tid long, a array<double>, ab array<double>, ac array<double>")
    assert rows(geometry.ray_cast(rays, tri)) == want
    whole = tri.select("tid", "a", *(F.zip_with("a", k, lambda x, y: x + y).alias(k[1]) for k in ("ab", "ac")))
    assert rows(geometry.ray_cast(rays, whole)) == want


def shuffled(spark, f):
    """The rows of f(), and how many rows were shuffled for them where no table is small enough to be broadcast."""
    sc, name = spark.sparkContext, "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    spark.conf.set(name, "-1")
    sc.setJobGroup("shuffled", "shuffled")
    try:
        known, tracker, store = set(sc.statusTracker().getJobIdsForGroup("shuffled")), sc.statusTracker(), sc._jsc.sc().statusStore()
        got = rows(f())
        jobs = set(tracker.getJobIdsForGroup("shuffled")) - known
        stages = {x for j in jobs for x in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(x) is not None}
        return got, sum(store.lastStageAttempt(x).shuffleWriteRecords() for x in stages)
    finally:
        spark.conf.set(name, old)
        sc.setJobGroup("other", "other")


def test_range_min_shuffles_few_rows_a_query(spark):
    from quillgraph.operators import trees

    n = 4000
    s = spark.range(n).select(F.col("id").alias("idx"), (F.col("id") * 7919 % 3001).alias("value"))
    q = spark.range(n).selectExpr("id as qid", "id div 3 as i", f"id div 3 + id * 31 % ({n} - id div 3) as j")
    got, n_rows = shuffled(spark, lambda: trees.range_min(s, q))
    value = [i * 7919 % 3001 for i in range(n)]
    assert got == [(k, m[1], m[0]) for k in range(n) for i in [k // 3] for m in [min((value[p], p) for p in range(i, i + k * 31 % (n - i) + 1))]]
    assert 0 < n_rows <= 10 * n


def test_kcore_shuffles_the_edges_few_times(spark):
    ends = [(u, v) for u in range(100) for v in range(u)] + [(v, v + 1) for v in range(1000, 1020)]
    e = spark.createDataFrame(ends, "src long, dst long")
    found, n_rows = shuffled(spark, lambda: graph.kcore(e))
    assert found == [(v, 99) for v in range(100)] + [(v, 1) for v in range(1000, 1021)]
    assert 0 < n_rows <= 8 * len(ends)
