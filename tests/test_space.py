"""Cell joins, nearest neighbours and groupings against brute force, on crowded fixtures."""
import collections
import math
import hashlib
import random

from pyspark.sql import functions as F
import pytest

from ringside.functions import geo
from ringside.operators import cluster, facets, spatial
from ringside.plans import coverage

c = F.col


def metres(a, b):
    p = math.pi / 180
    h = math.sin((b[0] - a[0]) * p / 2) ** 2 + math.cos(a[0] * p) * math.cos(b[0] * p) * math.sin((b[1] - a[1]) * p / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(min(1, math.sqrt(h)))


def crowd(seed, n):
    """A third at one coordinate, a third packed in a few hundred metres, a third far apart."""
    r = random.Random(seed)
    spread = [(46 + r.random() * 3, -1 + r.random() * 3) for _ in range(n // 3)]
    packed = [(47.2 + r.gauss(0, 0.002), -1.55 + r.gauss(0, 0.002)) for _ in range(n // 3)]
    return packed + spread + [(47.2, -1.55)] * (n - len(packed) - len(spread))


def frame(spark, points, key):
    return spark.createDataFrame([(f"{key}{i:04}", float(y), float(x)) for i, (y, x) in enumerate(points)], f"{key} string, {key}_lat double, {key}_lon double")


@pytest.mark.parametrize("radius", [80.0, 5000.0])
def test_within_radius_meets_every_pair_once(spark, radius):
    a, b = crowd(1, 90), crowd(2, 60) + [(47.2, 179.9999), (47.2, -179.9999)]
    pairs = spatial.within_radius(frame(spark, a, "a"), frame(spark, b, "b"), radius, left_point=("a_lat", "a_lon"), right_point=("b_lat", "b_lon"))
    got = sorted((r.a, r.b) for r in pairs.select("a", "b").collect())
    assert got == sorted((f"a{i:04}", f"b{j:04}") for i, p in enumerate(a) for j, q in enumerate(b) if metres(p, q) <= radius)


def test_within_radius_sees_east_and_west_of_a_narrow_degree(spark):
    # 18.97 km apart at 47 N, two cells of a quarter of a degree apart
    a, b = frame(spark, [(47.0, 1.1249)], "a"), frame(spark, [(47.0, 1.3751)], "b")
    assert spatial.within_radius(a, b, 20000.0, left_point=("a_lat", "a_lon"), right_point=("b_lat", "b_lon")).count() == 1


def test_anti_join_keeps_the_far_ones(spark):
    a, b = crowd(3, 30), crowd(4, 60)
    left = frame(spark, a, "a")
    kept = spatial.within_radius(left, frame(spark, b, "b"), 200.0, left_point=("a_lat", "a_lon"), right_point=("b_lat", "b_lon"), how="left_anti")
    assert sorted(r.b for r in kept.collect()) == [f"b{j:04}" for j, q in enumerate(b) if all(metres(p, q) > 200 for p in a)]


@pytest.mark.parametrize("k,within", [(1, None), (4, None), (5, 3000.0)])
def test_nearest_is_exact(spark, k, within):
    q, cands = crowd(5, 60) + [(47.0, 179.9999)], crowd(6, 90) + [(47.0, -179.9999)]
    queries, candidates = frame(spark, q, "q"), frame(spark, cands, "c")
    found = spatial.nearest(queries.withColumnRenamed("q", "q_id"), candidates.withColumnRenamed("c", "c_id"), k, within_m=within)
    got = sorted((r.q_id, r["rank"], r.c_id) for r in found.collect())
    want = []
    for i, p in enumerate(q):
        near = sorted((round(metres(p, s), 3), f"c{j:04}") for j, s in enumerate(cands))
        near = [n for n in near if within is None or n[0] <= within][:k]
        want += [(f"q{i:04}", rank, ident) for rank, (_, ident) in enumerate(near, 1)]
    assert got == sorted(want)


def test_queries_beside_a_dense_spot_meet_few_points(spark):
    """5,000 points in 50 m, a thousand queries a few hundred metres away, and one far point that keeps the spot's cell company."""
    r = random.Random(12)
    dense = [(47.2 + r.uniform(0, 4.5e-4), -1.55 + r.uniform(0, 6.6e-4)) for _ in range(5000)] + [(47.9, -1.0)]
    asked = [(47.2 + r.uniform(-3e-3, 3e-3), -1.557 + r.uniform(-3e-3, 3e-3)) for _ in range(1000)]
    queries, candidates = frame(spark, asked, "q").withColumnRenamed("q", "q_id"), frame(spark, dense, "c").withColumnRenamed("c", "c_id")
    met = spatial.pairs_met(queries, candidates, 6)
    most = met.groupBy("q_id").count().agg(F.max("count"), F.min("count")).first()
    assert most[0] <= 2000 and most[1] >= 6
    got = {(x.q_id, x["rank"]): x.c_id for x in spatial.nearest(queries, candidates, 6).collect()}
    for i in range(0, 1000, 50):
        near = sorted((round(metres(asked[i], p), 3), f"c{j:04}") for j, p in enumerate(dense))[:6]
        assert [got[f"q{i:04}", k] for k in range(1, 7)] == [ident for _, ident in near]


def test_the_tree_has_levels_and_every_key_its_run(spark, monkeypatch):
    monkeypatch.setattr(spatial.Packed, "FAN", 16)
    r = random.Random(13)
    points = [(f"p{i}", "abc"[i % 3], r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(9000)]
    tree = spatial.Packed(spark.createDataFrame(points, "p string, dep string, lat double, lon double"), "lat", "lon", ["p"], ["dep"])
    assert len(tree.levels) == 3 and tree.size == 9000
    assert {x.dep: x["_hi"] - x["_lo"] for x in tree.runs.collect()} == {"a": 3000, "b": 3000, "c": 3000}
    assert tree.points.groupBy("_node").count().where(f"count > {tree.LEAF}").isEmpty()


def test_nearest_under_keys_around_the_globe(spark):
    r = random.Random(14)
    spots = lambda n: [("ab"[r.randrange(2)], r.choice([90.0, -90.0, 0.0, r.uniform(-90, 90)]), r.choice([180.0, -180.0, 0.0, r.uniform(-180, 180)])) for _ in range(n)]
    q, cands = spots(60), spots(300)
    queries = spark.createDataFrame([(f"q{i:04}", *map(lambda x: x, s)) for i, s in enumerate(q)] + [("none", None, 1.0, 1.0), ("lost", "a", None, 1.0), ("other", "z", 1.0, 1.0)], "q_id string, dep string, q_lat double, q_lon double")
    candidates = spark.createDataFrame([(f"c{i:04}", *s) for i, s in enumerate(cands)], "c_id string, dep string, c_lat double, c_lon double")
    got = collections.defaultdict(list)
    for x in spatial.nearest(queries, candidates, 5, by=["dep"]).collect():
        got[x.q_id].append((x["rank"], x.metres, x.c_id))
    for i, (dep, y, x) in enumerate(q):
        near = sorted((round(metres((y, x), c_[1:]), 2)) for c_ in cands if c_[0] == dep)[:5]
        assert [round(m, 2) for _, m, _ in sorted(got[f"q{i:04}"])] == pytest.approx(near, abs=0.02)
    assert len(got) == len(q)


def test_queries_go_down_in_blocks(spark, monkeypatch):
    """Blocks hold at most BLOCK queries, none reaches over a jump of the curve, and boxes are met as rows, not in interpreted functions over arrays."""
    monkeypatch.setattr(spatial, "BLOCK", 4)
    r = random.Random(16)
    asked = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(60)] + [(47.2, -1.55)] * 20 + [(0.01, 0.01), (-0.01, -0.01)]
    cands = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(300)]
    queries, candidates = frame(spark, asked, "q").withColumnRenamed("q", "q_id"), frame(spark, cands, "c").withColumnRenamed("c", "c_id")
    whole = queries.withColumns({"_z": geo.along_curve(c("q_lat"), c("q_lon")), "_lo": F.lit(0), "_hi": F.lit(300)})
    blocks = spatial._blocked(spatial.ranking.placed(whole, ["_lo", "_z"], "_q")).groupBy("_b").agg(F.count("*"), F.collect_set("q_id")).collect()
    assert max(b[1] for b in blocks) == 4 and sum(b[1] for b in blocks) == 82 and not [b for b in blocks if {"q0080", "q0081"} <= set(b[2])]
    met = spatial.pairs_met(queries, candidates, 3)
    assert "lambda" not in met._jdf.queryExecution().optimizedPlan().toString().lower()
    got = collections.defaultdict(list)
    for x in spatial.nearest(queries, candidates, 3).collect():
        got[x.q_id].append((x["rank"], x.c_id))
    for i, q in enumerate(asked):
        assert [ident for _, ident in sorted(got[f"q{i:04}"])] == [ident for _, ident in sorted((round(metres(q, p), 3), f"c{j:04}") for j, p in enumerate(cands))[:3]]


def test_rings_crowded_in_a_spot_are_met_by_cell(spark):
    """5,000 rings within 50 m: a venue in reach of all meets a row a cell; venues at the edge find the same winner as a full scan."""
    r = random.Random(15)
    rings = [(f"r{i:04}", 47.2 + r.uniform(0, 4.5e-4), -1.55 + r.uniform(0, 6.6e-4), r.uniform(150, 500)) for i in range(5000)]
    venues = [(f"v{i:02}", 47.2 + r.uniform(-2.5e-3, 2.5e-3), -1.55 + r.uniform(-3e-3, 3e-3)) for i in range(30)] + [(f"near{i}", 47.2003 + i * 1e-5, -1.5498) for i in range(10)]
    left = spark.createDataFrame(venues, "id string, lat double, lon double")
    right = spark.createDataFrame(rings, "ring_id string, ring_lat double, ring_lon double, m double")
    pairs = spatial.best_within(left, right, 200.0, F.struct((-c("m")).alias("s"), c("ring_id")))
    counts = {x.id: x["count"] for x in pairs.groupBy("id").count().collect()}
    assert all(counts[f"near{i}"] <= 10 for i in range(10))
    won = {x.id: x.w for x in pairs.groupBy("id").agg(F.max_by("best.ring_id", "best.m").alias("w")).collect()}
    for ident, y, x in venues:
        inside = [(m, ring) for ring, ry, rx, m in rings if metres((y, x), (ry, rx)) < 200]
        assert won.get(ident) == (max(inside)[1] if inside else None)


def test_fewer_candidates_than_asked(spark):
    q, cands = frame(spark, [(10.0, 10.0), (-60.0, 100.0)], "q"), frame(spark, [(0.0, 0.0), (50.0, -170.0)], "c")
    found = spatial.nearest(q.withColumnRenamed("q", "q_id"), cands.withColumnRenamed("c", "c_id"), 3)
    assert found.count() == 4


def test_neighbours_of_a_crowded_department(spark):
    points = crowd(7, 60)
    rows = [(f"v{i:04}", "44" if i % 3 else "49", y, x) for i, (y, x) in enumerate(points)]
    got = sorted((r.id, r["rank"], r.near_id) for r in facets.neighbours(spark.createDataFrame(rows, "id string, dep string, lat double, lon double")).collect())
    want = []
    for ident, dep, y, x in rows:
        near = sorted((round(metres((y, x), (b[2], b[3])), 3), b[0]) for b in rows if b[1] == dep and b[0] != ident)[:6]
        want += [(ident, rank, other) for rank, (_, other) in enumerate(near, 1)]
    assert got == sorted(want)


def greedy(points, radius):
    leaders, out = [], {}
    for ident, p in points:
        for leader, q in leaders:
            if metres(p, q) <= radius:
                out[ident] = leader
                break
        else:
            leaders.append((ident, p))
            out[ident] = ident
    return out


@pytest.mark.parametrize("seed,shuffled", [(8, True), (9, True), (10, False)])
def test_leader_groups_equal_the_sequential_loop(spark, seed, shuffled):
    points = crowd(seed, 150)
    if not shuffled:      # a chain along a road, in order: the slowest case
        points = [(47.0 + i * 0.0004, -1.5) for i in range(40)] + points[:60]
    order = list(range(len(points)))
    if shuffled:
        random.Random(seed).shuffle(order)
    rows = [(f"p{i:04}", rank, *map(float, points[i])) for rank, i in enumerate(order)]
    got = cluster.leader_groups(spark.createDataFrame(rows, "id string, n int, lat double, lon double"), 80.0, ["n"])
    want = greedy([(ident, (y, x)) for ident, _, y, x in rows], 80.0)
    assert {r.id: r.leader for r in got.collect()} == want


def test_grouping_along_a_line_ends_soon_in_hash_order(spark, monkeypatch):
    rows = [(f"p{i}", hashlib.md5(f"p{i}".encode()).hexdigest(), 47.0 + i * 0.0014, -1.5) for i in range(600)]
    rounds, cut = [], cluster.cut_lineage
    monkeypatch.setattr(cluster, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    got = cluster.leader_groups(spark.createDataFrame(rows, "id string, hash string, lat double, lon double"), 200.0, ["hash"])
    assert {r.id: r.leader for r in got.collect()} == greedy([(i, (y, x)) for i, _, y, x in sorted(rows, key=lambda r: r[1])], 200.0)
    assert len(rounds) / 2 < 12


def test_joins_of_growing_sides_are_not_gathered_on_the_driver(spark, monkeypatch):
    """However small the tables, neither the rounds nor their result plan a broadcast of leaders, firsts or probes."""
    plans, cut = [], cluster.cut_lineage
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(cluster, "cut_lineage", lambda df: planned(df) or cut(df))
    rows = [(f"p{i:04}", i, float(y), float(x)) for i, (y, x) in enumerate(crowd(20, 60))]
    found = cluster.leader_groups(spark.createDataFrame(rows, "id string, n int, lat double, lon double"), 80.0, ["n"])
    planned(found)
    a, b = frame(spark, crowd(21, 9), "a"), frame(spark, crowd(22, 9), "b")
    planned(spatial.within_radius(a, b, 200.0, left_point=("a_lat", "a_lon"), right_point=("b_lat", "b_lon"), how="left_anti"))
    missing = spark.createDataFrame([("t0", "a0000")], "trace_id string, near_id string").withColumn("osm", c("trace_id"))
    planned(coverage.with_nearest_venue(missing, a.select(c("a").alias("id"), F.lit("n").alias("nom"), F.lit("v").alias("ville"))))
    rings = spark.createDataFrame([("t", [(47.0, -2.0), (48.0, -2.0), (48.0, -1.0), (47.0, -2.0)])], "name string, ring array<struct<lat:double,lon:double>>")
    planned(spatial.in_rings(a, rings, level=8, point=("a_lat", "a_lon")))
    assert len(plans) >= 7 and not [p for p in plans if "Broadcast" in p]


def test_in_rings(spark):
    r = random.Random(11)
    points = [(47 + r.random() * 0.1, -1.5 + r.random() * 0.1) for _ in range(200)]
    triangle = [(47.01, -1.49), (47.09, -1.45), (47.02, -1.41), (47.01, -1.49)]
    rings = spark.createDataFrame([("t", triangle)], "name string, ring array<struct<lat:double,lon:double>>")
    got = spatial.in_rings(frame(spark, points, "p"), rings, level=12, point=("p_lat", "p_lon"))

    def inside(y, x):
        hit = False
        for (y1, x1), (y2, x2) in zip(triangle, triangle[1:]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                hit = not hit
        return hit
    assert sorted(row.p for row in got.collect()) == [f"p{i:04}" for i, p in enumerate(points) if inside(*p)]
