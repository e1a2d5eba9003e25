"""Operators on small clouds, against brute force and by hand."""

import math
import random

import numpy as np
import pytest
from cumulo.operators import affine, arrays, blocks, crop, knn, metrics, mixing, normals, report, sampling, sdf, volume
from cumulo.plans import chunks
from cumulo.plans.planner import compose, interpolate, merge_configs, plan
from pyspark.sql import functions as F

FULL = "shape_id string, point_id long, x double, y double, z double, nx double, ny double, nz double, sx double, sy double, sz double, r double, g double, b double"


def cloud(spark, rows):
    return spark.createDataFrame([(s, i, *map(float, p), 0.0, 0.0, 1.0, 0.0, 0.0, 5.0, 0.1, 0.2, 0.3) for s, i, p in rows], FULL)


def scatter(spark, n, seed, shapes=("a", "b")):
    rng = random.Random(seed)
    return cloud(spark, [(s, i, [round(rng.random() * 8) / 8 if rng.random() < 0.3 else rng.random() for _ in range(3)]) for s in shapes for i in range(n)])


def brute(points, refs, k):
    out = set()
    p, r = points.toPandas(), refs.toPandas()
    for s in p.shape_id.unique():
        q, t = p[p.shape_id == s], r[r.shape_id == s]
        for _, a in q.iterrows():
            d = ((t.x - a.x) ** 2 + (t.y - a.y) ** 2 + (t.z - a.z) ** 2).to_numpy()
            for i in np.lexsort((t.point_id.to_numpy(), d))[:k]:
                out.add((s, a.point_id, int(t.point_id.iloc[i])))
    return out


@pytest.mark.parametrize("size", [0.05, 0.3, 2.0])
def test_grid_is_brute_force(spark, size):
    q, r = scatter(spark, 40, 1), scatter(spark, 60, 2)
    found = knn.grid(knn.as_queries(q), knn.as_refs(r), 5, size).select("shape_id", "query_id", "ref_id").collect()
    assert {tuple(x) for x in found} == brute(q, r, 5) and len(found) == 400


def test_large_shapes_go_over_the_grid(spark, monkeypatch):
    q = scatter(spark, 50, 3)
    monkeypatch.setattr(knn, "DIRECT_PAIRS", 10)
    found = knn.knn(knn.as_queries(q), knn.as_refs(q), 4).select("shape_id", "query_id", "ref_id").collect()
    assert {tuple(x) for x in found} == brute(q, q, 4)


def test_more_neighbours_than_points(spark):
    q = cloud(spark, [("a", 0, (0, 0, 0)), ("a", 1, (1, 0, 0)), ("b", 0, (0, 0, 0))])
    assert knn.grid(knn.as_queries(q), knn.as_refs(q), 5, 0.5).count() == 5
    assert knn.direct(knn.as_queries(q), knn.as_refs(q), 5).count() == 5


def test_a_cloud_is_at_no_distance_from_itself(spark):
    c = scatter(spark, 30, 4)
    row = metrics.evaluate(c, c).collect()
    assert all(r.chamfer_l1 == 0 and r.f_score == 1 and abs(r.normal_consistency - 1) < 1e-12 for r in row)
    one = metrics.evaluate(c.where("shape_id = 'a'"), c).where("shape_id = 'b'").first()
    assert all(math.isnan(v) for k, v in one.asDict().items() if k != "shape_id")


def test_crops(spark):
    c = cloud(spark, [("a", 0, (0, 0, 0)), ("a", 1, (1, 1, 1)), ("a", 2, (0.5, 0.5, 0.5))])
    assert [r.point_id for r in crop.crop_box(c, (0, 0, 0), (1, 1, 1)).collect()] == [2]
    twice = crop.crop_box(crop.crop_box(c, (0, 0, 0), (1, 1, 1)), (0, 0, 0), (1, 1, 1))
    assert twice.count() == 1
    assert crop.empty_shapes(c.where("false"), c).first().n == 0
    assert crop.crop_random(scatter(spark, 50, 5), 0.2, 0.4, 0.0).count() <= 100


def test_affine(spark):
    c = scatter(spark, 20, 6)
    turned = affine.rotate_axis(c, "y", 10, 80, seed=3)
    d = lambda x: {(r.query_id, r.ref_id): r.d2 for r in knn.direct(knn.as_queries(x), knn.as_refs(x), 3).where("shape_id = 'a'").collect()}
    one, two = d(c), d(turned)
    assert set(one) == set(two) and all(abs(one[k] - two[k]) < 1e-9 for k in one)
    point = affine.bound_scale(cloud(spark, [("a", 0, (3, 3, 3))]), 0.5, 1.0).first()
    assert (point.x, point.y, point.z) == (0, 0, 0)
    with pytest.raises(ValueError):
        affine.transform_bounds(spark.range(1), [[0, -1, 0], [1, 0, 0], [0, 0, 1]], (0, 0, 0), 1.0)


def test_sampling(spark):
    c = scatter(spark, 30, 7)
    for n in (1, 10, 30, 45):
        sizes = {r.shape_id: r["count"] for r in sampling.resize(c, n).groupBy("shape_id").count().collect()}
        assert sizes == {"a": n, "b": n}
    assert sampling.bound_size(c, 20, 10).count() == 40 and sampling.bound_size(c, 50, 40).count() == 80 and sampling.bound_size(c, 50, 10).count() == 60
    assert sampling.jitter(c, 0.0) is c and sampling.outliers(c, 0.0) is c
    a, b = (sorted(map(tuple, sampling.subsample(x, 7).select("shape_id", "point_id").collect())) for x in (c, c.repartition(3)))
    assert a == b
    assert sampling.density(cloud(spark, [("a", 0, (0, 0, 0)), ("a", 1, (0.05, 0, 0)), ("a", 2, (0.15, 0, 0))]), 0.1).first().density == 1.5
    assert sampling.expand(spark.createDataFrame([("a", 0, 0, 0)], "shape_id string, i long, j long, k long"), 4).agg(F.min("i"), F.max("i"), F.count("*")).first()[:] == (-1, 2, 64)


def test_signed_distance(spark):
    plane = cloud(spark, [("a", i * 5 + j, (i / 4, j / 4, 0)) for i in range(5) for j in range(5)])
    asked = cloud(spark, [("a", 0, (0.5, 0.5, 0.3)), ("a", 1, (0.5, 0.5, -0.3))])
    rows = {r.query_id: r for r in sdf.vote(asked, plane, 8, 10.0, gradient=True).collect()}
    assert rows[0].sdf == pytest.approx(0.3) and rows[1].sdf == pytest.approx(-0.3) and rows[0].gz == 1 and rows[1].gz == 1
    assert {r.query_id: round(r.sdf, 6) for r in sdf.imls(asked, plane, 8, 0.5).collect()} == {0: 0.3, 1: -0.3}
    assert {r.query_id: r.sdf > 0 for r in sdf.geometry_sdf(asked, plane).collect()} == {0: False, 1: True}


def test_volume(spark):
    lattice = volume.Lattice((0, 0, 0), (1, 1, 1), (3, 3, 3))
    cells = spark.createDataFrame([("a", 0, 0, 0, 0.1), ("a", 1, 1, 1, 5.0), ("a", 2, 2, 2, float("nan"))], "shape_id string, i int, j int, k int, val double")
    asked = cloud(spark, [("a", 0, (0, 0, 0)), ("a", 1, (0.5, 0.5, 0.5)), ("a", 2, (1, 1, 1)), ("a", 3, (2, 0, 0)), ("a", 4, (0, 1, 0))])
    assert {r.point_id: r.kind for r in volume.classify(asked, cells, lattice).collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2}
    rows, small = volume.crop(cells, lattice, (0.4, 0.4, 0.4), (0.6, 0.6, 0.6))
    assert small.n == [3, 3, 3] and rows.count() == 3
    with pytest.raises(ValueError):
        volume.Lattice((0, 0, 0), (0, 1, 1), (1, 1, 1))


def test_normals_of_a_plane(spark):
    plane = cloud(spark, [("a", i * 6 + j, (i / 5, j / 5, 0)) for i in range(6) for j in range(6)])
    assert all(abs(r.nz - 1) < 1e-9 for r in normals.estimate(plane, 9).collect())


def test_planner(spark):
    chain = [{"name": "FixedScale", "args": {"scale": 2.0}}, {"name": "PointcloudNoise", "args": {"stddev": 0}}, {"name": "FixedScale", "args": {"scale": 3.0}}]
    assert [n for n, _ in plan(chain)] == ["Similarity"] and plan(chain)[0][1]["matrix"][0][0] == 6
    assert compose(chain)(cloud(spark, [("a", 0, (1, 1, 1))])).first().x == 6
    with pytest.raises(ValueError):
        plan([{"name": "exec"}])
    assert interpolate(merge_configs({"a": {"b": 1}}, {"a": {"c": "${a.b}"}})) == {"a": {"b": 1, "c": 1}}


def test_focus(spark):
    rows = spark.range(10).withColumnRenamed("id", "batch_idx")
    sizes = {g: rows.where(mixing.focus(g)).count() for g in ("none", "all", "g7", "l3", "1,4", "5")}
    assert sizes == {"none": 0, "all": 10, "g7": 2, "l3": 3, "1,4": 2, "5": 1}
    assert mixing.available(["z", "q", "x"], ["x", "y", "z"]) == ["z", "x"]


def test_empty_inputs(spark):
    none = cloud(spark, [])
    for made in (crop.crop_box(none, (0, 0, 0), (1, 1, 1)), sampling.resize(none, 5), affine.bound_scale(none, 1, 2), sampling.voxels(none, 0.1), knn.knn(knn.as_queries(none), knn.as_refs(none), 3)):
        assert made.count() == 0


def test_mesh_samples_follow_area(spark):
    from cumulo.operators import mesh

    vertices = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.0), ("a", 1, 1.0, 0.0, 0.0), ("a", 2, 0.0, 1.0, 0.0), ("a", 3, 9.0, 0.0, 0.0)], "shape_id string, vertex_id long, x double, y double, z double")
    faces = spark.createDataFrame([("a", 0, 0, 1, 2), ("a", 1, 1, 3, 2), ("a", 2, 1, 1, 2)], "shape_id string, face_id long, a long, b long, c long")
    triangles = mesh.from_tables(vertices, faces)
    assert {r.face_id: r.area for r in mesh.areas(triangles).collect()} == {0: 0.5, 1: 4.0, 2: 0.0}
    rows = mesh.sample(triangles, 900).collect()
    share = sum(r.face_id == 1 for r in rows) / 900
    assert len(rows) == 900 and abs(share - 8 / 9) < 0.05 and all(r.z == 0 and r.x >= 0 and r.y >= 0 and r.x / 9 + r.y <= 1 + 1e-12 for r in rows)


def test_normals_face_the_sensor(spark):
    plane = cloud(spark, [("a", i * 6 + j, (i / 5, j / 5, 0)) for i in range(6) for j in range(6)])
    below = plane.withColumn("sz", F.lit(-5.0))
    assert {round(r.nz) for r in normals.oriented(plane, 9).collect()} == {1} and {round(r.nz) for r in normals.oriented(below, 9).collect()} == {-1}


def test_places_without_whole_groups(spark):
    from cumulo.operators import ranks
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("g"), F.pmod(F.col("id") * 7919, F.lit(3001)).alias("v"), (F.col("id") % 5 / 4.0).alias("w"))
    by = {}
    for r in rows.collect():
        by.setdefault(r.g, []).append((r.v, r.w))
    got = {(r.g, r.v): r["rank"] for r in ranks.by_value(rows, ["g"], ["v"], "rank").collect()}
    summed = {(r.g, r.v): r.s for r in ranks.running_sum(rows, ["g"], ["v"], "w", "s").collect()}
    hashed = {(r.g, r.v): r["rank"] for r in ranks.by_digest(rows, ["g"], F.md5(F.col("v").cast("string")), "v", "rank").collect()}
    for g, values in by.items():
        total = 0.0
        for i, (v, w) in enumerate(sorted(values), 1):
            assert got[g, v] == i and summed[g, v] == pytest.approx(total)
            total += w
        import hashlib

        order = sorted((v for v, _ in values), key=lambda v: (hashlib.md5(str(v).encode()).hexdigest(), v))
        assert [hashed[g, v] for v in order] == list(range(1, len(order) + 1))


def test_side_tables_beyond_the_broadcast(spark, monkeypatch):
    from cumulo.operators import ranks

    rows, table = spark.range(20).selectExpr("id % 4 as g", "id"), spark.range(3).selectExpr("id as g", "id * 10 as t")
    want = sorted((i % 4, i, i % 4 * 10) for i in range(20) if i % 4 < 3)
    for most in (0, 100):
        monkeypatch.setattr(ranks, "SMALL_ROWS", most)
        assert sorted(map(tuple, ranks.with_group(rows, table, "g").collect())) == want


def test_failures_and_best_over_many_blocks(spark):
    log = spark.range(500).selectExpr("id as step", "'m' as name", "cast(abs(250 - id) as double) as value")
    best = {r.step: r.best for r in report._before(log.selectExpr("name", "step as _block", "value"), ["name"], "value", F.min, 20).selectExpr("_block as step", "least(_inner, _top) as best").collect()}
    assert best[0] is None and all(best[i] == min(abs(250 - j) for j in range(i)) for i in range(1, 500))
    fails = {r.step: r.failures for r in report.running_failures(log, log["value"] < 100, block=7).collect()}
    assert all(fails[i] == sum(abs(250 - j) < 100 for j in range(i + 1)) for i in range(500))


def test_l1_over_the_grid(spark, monkeypatch):
    q, r = scatter(spark, 40, 1), scatter(spark, 60, 2)
    plain = knn.knn(knn.as_queries(q), knn.as_refs(r), 3, metric="l1").select("shape_id", "query_id", "rank", "ref_id").collect()
    monkeypatch.setattr(knn, "DIRECT_PAIRS", 0)
    assert set(map(tuple, knn.knn(knn.as_queries(q), knn.as_refs(r), 3, metric="l1").select("shape_id", "query_id", "rank", "ref_id").collect())) == set(map(tuple, plain))


def test_configurations_are_put_together():
    from cumulo.plans.planner import load_config

    held = {
        "conf/base.yaml": {"a": {"b": 1, "c": "${size}"}, "size": 3}, "conf/more/own.yaml": {"include_configs": ["../base.yaml"], "_kind": "fine", "name": "run-{_kind}", "list": ["{_kind}"], "a": {"b": 2}},
        "loop.yaml": {"include_configs": ["loop.yaml"]},
    }
    config = load_config(held.__getitem__, "conf/more/own.yaml", ["size=7", "a.d.e=text", "flag=True"])
    assert config["a"] == {"b": 2, "c": 7, "d": {"e": "text"}} and config["name"] == "run-fine" and config["list"] == ["fine"] and config["flag"] is True
    with pytest.raises(ValueError):
        load_config(held.__getitem__, "loop.yaml")


def test_small_contracts(spark):
    from cumulo.functions import vec

    assert mixing.fields("normal")[-3:] == ["nx", "ny", "nz"] and mixing.fields(None) == ["shape_id", "point_id", "x", "y", "z"]
    runs = spark.createDataFrame([("me/proj/abc:last",), ("me/proj/abc",)], "p string").select(mixing.run_parts(F.col("p")).alias("r")).select("r.*")
    assert sorted(map(tuple, runs.collect()), key=str) == [("me", "proj", "abc", "last"), ("me", "proj", "abc", None)]
    mixed = mixing.mix_sources(spark.createDataFrame([("a", 1)], "source string, item long"), {})
    with pytest.raises(ValueError):
        mixing.mix_sources(mixed, {})
    points = cloud(spark, [("a", 0, (0, 0, 0))])
    with pytest.raises(ValueError):
        sdf.checked(points.drop("x"), points)
    with pytest.raises(ValueError):
        sdf.checked(points, points.withColumn("nx", F.lit("1")))
    assert spark.range(1).select(vec.fmod(F.lit(-5.5), F.lit(2.0)).alias("v")).first().v == -1.5
    assert metrics.measure(points, ["point_stats"])["point_stats"].count() == 1
    assert [r.item for r in mixing.ordered(spark.createDataFrame([("b",), ("a",)], "item string"), shuffled=False).orderBy("idx").collect()] == ["a", "b"]


def test_places_that_very_many_share(spark):
    rows = [("a", i, (0.5, 0.5, 0.5)) for i in range(300)] + [("a", 300 + i, (i / 40, 0.2, 0.1)) for i in range(40)]
    points = cloud(spark, rows)
    q, r = knn.as_queries(points), knn.as_refs(points)
    assert knn._apart(r, 5).count() == 45
    pick = lambda df: sorted(map(tuple, df.select("query_id", "rank", "ref_id").collect()))
    assert pick(knn.grid(q, r, 5, 0.1)) == pick(knn.direct(q, r, 5))
    near = {x.query_id: x.hits for x in knn.radius(q, r, 0.3, 4).select("query_id", "hits").distinct().collect()}
    assert near == {i: sum(math.dist(p, o) < 0.3 for _, _, o in rows) for _, i, p in rows}
    assert {x.query_id: x.hits for x in knn.radius_count(q, r, 0.3, 10**6).collect()} == near


def test_existing_configurations_load(spark):
    chain = [
        {"name": "FixedBBoxCrop", "args": {"bbox_min": [-2, -2, -2], "bbox_max": [2, 2, 2]}}, {"name": "SubsamplePointcloud", "args": {"N": 5}}, {"name": "UniformDensityFixedSampleScale", "args": {"voxel_size": 0.1, "min_density": 1.0, "max_density": 5.0}},
        {"name": "UniformDensityFixedScaleSample", "args": {"voxel_size": 0.1, "min_density": 1.0, "max_density": 5.0}}, {"name": "PointcloudOutliers", "args": {"ratio": 0.0, "spatial_ratio": 1.0}},
    ]
    points = scatter(spark, 20, 3)
    assert compose(chain)(points).columns == points.columns and 0 < compose(chain[:2])(points).count() <= 10


def layouts(n: int = 400):
    """Clouds of one size whose density differs: a cube, one with a far point, a plane, two clumps far apart, a line of halving steps, and many points at few places."""
    rng = np.random.default_rng(4)
    cube = rng.random((n, 3))
    out = {"cube": cube, "far": np.r_[cube, [[1e9, -1e9, 1e9]]], "plane": np.c_[cube[:, :2], np.zeros(n)], "apart": np.r_[cube[: n // 2], cube[n // 2 :] * 1e-3 + 1e4]}
    out["halves"] = np.stack([2.0 ** -np.arange(24)] * 3, axis=1)
    out["places"] = np.floor(cube * 3)
    return [(shape, i, *map(float, p)) for shape, x in out.items() for i, p in enumerate(x)]


@pytest.mark.parametrize("metric", ["l2", "l1"])
def test_neighbours_follow_the_density(spark, metric):
    """The same as comparing all pairs, wherever the points are, with as many pairs a query as in a cube."""
    points = spark.createDataFrame(layouts(), "shape_id string, point_id long, x double, y double, z double")
    q, r = knn.as_queries(points.where("point_id % 3 > 0")), knn.as_refs(points)
    pick = lambda df: {tuple(x) for x in df.select("shape_id", "query_id", "rank", "ref_id", "d2").collect()}
    pairs = knn.checkpointed(knn.candidates(q, r, 5, metric))
    assert pick(knn._nearest(pairs, 5)) == pick(knn.direct(q, r, 5, metric))
    counts = {x.shape_id: x.n for x in pairs.groupBy("shape_id", "query_id").count().groupBy("shape_id").agg({"count": "avg"}).withColumnRenamed("avg(count)", "n").collect()}
    assert all(counts[s] <= 1.5 * counts["cube"] for s in ("far", "plane", "apart")) and counts["halves"] <= 60


@pytest.mark.parametrize("metric", ["l2", "l1"])
def test_blocks_give_the_nearest(spark, monkeypatch, metric):
    """The same as comparing all pairs, though only queries that need several blocks meet again, and one of those at a place is asked."""
    points = spark.createDataFrame(layouts(), "shape_id string, point_id long, x double, y double, z double")
    q, r = knn.as_queries(points.where("point_id % 3 > 0")), knn.as_refs(points.where("shape_id <> 'plane' or point_id < 3"))
    q = q.unionByName(q.where("shape_id = 'cube'").withColumn("query_id", F.col("query_id") + 10**6))
    pick = lambda df: {tuple(x) for x in df.select("shape_id", "query_id", "rank", "ref_id", "d2").collect()}
    whole, asked = blocks.nearest, []
    monkeypatch.setattr(blocks, "nearest", lambda queries, *more: asked.append(queries.groupBy("shape_id", "qx", "qy", "qz").count().agg({"count": "max"}).first()[0]) or whole(queries, *more))
    monkeypatch.setattr(blocks, "BLOCK", 40)
    monkeypatch.setattr(blocks, "ASKED", 30)
    near = pick(knn.direct(q, r, 5, metric))
    assert pick(knn.adaptive(q, r, 5, metric)) == near
    assert pick(knn.adaptive(q, r, 5, metric, 0.01).where("d2 < 0.01")) == {x for x in near if x[4] < 0.01}
    assert asked == [1, 1]


@pytest.mark.parametrize("metric", ["l2", "l1"])
def test_arrays_of_points_give_the_nearest(metric):
    draw = np.random.default_rng(3)
    for n, m, k in ((1, 1, 3), (90, 5, 8), (150, 260, 8), (300, 300, 1), (40, 300, 20)):
        for q, r in ((draw.random((n, 3)), draw.random((m, 3))), (np.floor(draw.random((n, 3)) * 4), np.floor(draw.random((m, 3)) * 4)), (draw.random((n, 3)) * [1, 0, 1e200], draw.random((m, 3)))):
            numbers, bound = draw.permutation(m), np.where(draw.random(n) < 0.5, np.inf, 0.05)
            near = []
            with np.errstate(over="ignore"):
                for i in range(n):
                    d = arrays.distances([q[i, j] - r[:, j] for j in range(3)], metric)
                    order = np.lexsort((numbers, d))[:k]
                    near += [(i, numbers[j], d[j]) for j in order if d[j] <= bound[i]]
            assert list(zip(*arrays.nearest(q, r, numbers, k, metric, bound)[:3], strict=True)) == near


@pytest.mark.parametrize("metric", ["l2", "l1"])
def test_a_cloud_is_moved_once_for_both_sides(spark, monkeypatch, metric):
    """The same as comparing all pairs, also where more than a block's points are at one place; only queries near the sides of blocks are written out."""
    rows = [*layouts(), *(("crowd", i, *((0.5, 0.5, 0.5) if i < 150 else (i / 300, 0.4, -i / 900))) for i in range(300)), ("few", 1, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "shape_id string, point_id long, x double, y double, z double").repartition(3)
    monkeypatch.setattr(blocks, "BLOCK", 100)
    monkeypatch.setattr(blocks, "ASKED", 30)
    monkeypatch.setattr(knn, "DIRECT_PAIRS", 0)
    kept, written = blocks.stored, []
    monkeypatch.setattr(blocks, "stored", lambda df: written.append(kept(df)) or written[-1])
    found = knn.among(points, 5, metric)
    assert found.columns == ["shape_id", "query_id", "ref_id", "d2", "rank"]
    near = knn.direct(knn.as_queries(points), knn.as_refs(points), 5, metric).select(*found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, near.collect()))
    asks = next(df for df in written if "_bound" in df.columns).where("shape_id = 'crowd' and _path is not null")
    assert 0 < asks.select("query_id").distinct().count() < 100


@pytest.mark.parametrize("size", [0.3, 1e-4])
def test_crowded_cells_are_left_to_blocks(spark, monkeypatch, size):
    q, r = scatter(spark, 40, 1), scatter(spark, 60, 2)
    monkeypatch.setattr(knn, "DIRECT_PAIRS", 0)
    monkeypatch.setattr(knn, "AROUND", 4)
    whole, asked = knn.adaptive, []
    monkeypatch.setattr(knn, "adaptive", lambda queries, *more: asked.append(queries.count()) or whole(queries, *more))
    assert {tuple(x) for x in knn.grid(knn.as_queries(q), knn.as_refs(r), 5, size).select("shape_id", "query_id", "ref_id").collect()} == brute(q, r, 5)
    assert len(asked) == 1


def test_very_many_small_shapes_are_not_compared_directly(spark, monkeypatch):
    q = scatter(spark, 20, 6, shapes=[f"s{i}" for i in range(30)])
    monkeypatch.setattr(knn, "ALL_PAIRS", 30 * 400 - 1)
    monkeypatch.setattr(knn, "direct", None)
    assert {tuple(x) for x in knn.knn(knn.as_queries(q), knn.as_refs(q), 3).select("shape_id", "query_id", "ref_id").collect()} == brute(q, q, 3)


def test_points_without_a_place_have_no_neighbours(spark, monkeypatch):
    rows = [("a", i, float(i), 0.0, 0.0) for i in range(30)] + [("a", 40, float("nan"), 0.0, 0.0), ("a", 41, None, 0.0, 0.0), ("a", 42, float("inf"), 0.0, 0.0), ("b", 1, float("nan"), 1.0, 1.0)]
    points = spark.createDataFrame(rows, "shape_id string, point_id long, x double, y double, z double")
    for most in (10**6, 0):
        monkeypatch.setattr(knn, "DIRECT_PAIRS", most)
        found = knn.knn(knn.as_queries(points), knn.as_refs(points), 3).collect()
        assert len(found) == 90 and max(r.query_id for r in found) == max(r.ref_id for r in found) == 29


def test_hits_are_counted_by_whole_nodes(spark, monkeypatch):
    """The same hits as all pairs give, by both ways; comparisons a hit fall as the cloud gets denser."""
    rows = [x for x in layouts(300) if x[0] in ("cube", "far", "plane", "places")] + [("cube", 1000, float("nan"), 0.0, 0.0)]
    points = spark.createDataFrame(rows, "shape_id string, point_id long, x double, y double, z double")
    q, r = knn.as_queries(points.where("point_id % 3 > 0")), knn.as_refs(points)
    pairs = knn.direct(knn.finite(q, "q"), knn.finite(r, "r"), 10**6).where("d2 < 0.16")
    true = {(x.shape_id, x.query_id): x.n for x in pairs.groupBy("shape_id", "query_id").agg(F.count("*").alias("n")).collect()}
    asked = {(x.shape_id, x.query_id) for x in q.collect()}
    for most in (10**6, 0):
        monkeypatch.setattr(knn, "DIRECT_PAIRS", most)
        for top in (25, 10**6):
            assert {(x.shape_id, x.query_id): x.hits for x in knn.radius_count(q, r, 0.4, top).collect()} == {k: min(true.get(k, 0), top) for k in asked}
        found = knn.radius(q, r, 0.4, 3).collect()
        assert {(x.shape_id, x.query_id): x.hits for x in found} == true
        assert {(x.shape_id, x.query_id, x["rank"], x.ref_id) for x in found} == {(x.shape_id, x.query_id, x["rank"], x.ref_id) for x in pairs.where("rank <= 3").collect()}
    shares, gen = [], np.random.default_rng(3)
    for n in (500, 4000):
        dense = spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(gen.random((n, 3)))], "shape_id string, point_id long, x double, y double, z double")
        sure, looked = knn.within(knn.as_queries(dense.where("point_id < 200")), knn.as_refs(dense), 0.4)
        hits = sum(x.hits for x in knn._hits(sure, looked, 0.4).collect())
        shares.append(looked.count() / hits)
    assert shares[1] < 0.75 * shares[0]


def test_more_points_take_no_more_rounds(spark, monkeypatch):
    """How often the points of a scene are written out follows from the queries, and no more spheres than CROSSED are compared with a point."""
    written, real, gen = [], knn.checkpointed, np.random.default_rng(5)
    monkeypatch.setattr(knn, "checkpointed", lambda df: written.append(1) or real(df))
    rounds = []
    for n in (2000, 30_000):
        points = gen.random((n, 3))
        dense = spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(points)], "shape_id string, point_id long, x double, y double, z double")
        written.clear()
        sure, looked = knn.within(knn.as_queries(dense.where("point_id < 50")), knn.as_refs(dense), 0.3)
        rounds.append(len(written))
        hits = {x.query_id: x.hits for x in knn._hits(sure, looked, 0.3).collect()}
        assert hits == {i: int((((points[i] - points) ** 2).sum(axis=1) < 0.09).sum()) for i in range(50)}
        assert looked.count() <= knn.CROSSED * n
    assert rounds[0] == rounds[1]


def test_normals_far_from_the_origin(spark):
    """A thin patch at coordinates as map grids have them gives the normals that it has at the origin."""
    rng = np.random.default_rng(6)
    x = np.c_[rng.random((150, 2)), 0.01 * rng.random(150)]
    frame = lambda shift: spark.createDataFrame([("a", i, *map(float, p + shift)) for i, p in enumerate(x)], "shape_id string, point_id long, x double, y double, z double")
    near, far = ({r.point_id: np.array([r.nx, r.ny, r.nz]) for r in normals.estimate(frame(s), 16).collect()} for s in (0.0, 4e6))
    assert len(near) == 150 and min(abs(near[i] @ far[i]) for i in near) > 1 - 1e-9


def test_each_shape_on_its_own_lattice(spark):
    """Classified and cropped as one shape after the other with its own lattice; a shape without one is outside."""
    own = {"a": volume.Lattice((0, 0, 0), (1, 1, 1), (3, 3, 3)), "b": volume.Lattice((-1, -1, -1), (2, 1, 1), (7, 5, 4))}
    rows = [("a", *map(float, (*v.low, *v.high)), *v.n) if s == "a" else ("b", *map(float, (*v.low, *v.high)), *v.n) for s, v in own.items()]
    lattices = spark.createDataFrame(rows, "shape_id string, " + ", ".join(f"{c} {'int' if c.startswith('cells') else 'double'}" for c in volume.LATTICE))
    rng = random.Random(3)
    cells = spark.createDataFrame([(s, i, j, k, rng.random() - 0.5) for s, v in own.items() for i in range(v.n[0]) for j in range(v.n[1]) for k in range(v.n[2]) if rng.random() < 0.7], "shape_id string, i int, j int, k int, val double")
    asked = spark.createDataFrame([(s, i, *(rng.uniform(-1.5, 2.5) for _ in "xyz")) for s in "abc" for i in range(80)], "shape_id string, point_id long, x double, y double, z double")
    found = {(r.shape_id, r.point_id): r.kind for r in volume.classify(asked, cells, lattices, 0.1).collect()}
    small, left = volume.crop_each(cells, lattices, (0.4, 0.1, 0.6), (0.6, 0.2, 0.9))
    sizes = {r.shape_id: r for r in left.collect()}
    for s, v in own.items():
        one = lambda df, s=s: df.where(F.col("shape_id") == s)
        assert {r.point_id: r.kind for r in volume.classify(one(asked), one(cells), v, 0.1).collect()} == {i: k for (g, i), k in found.items() if g == s}
        plain, lattice = volume.crop(one(cells), v, (0.4, 0.1, 0.6), (0.6, 0.2, 0.9))
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, one(small).collect()))
        assert [sizes[s][c] for c in volume.LATTICE] == [*lattice.low, *lattice.high, *lattice.n]
    assert {k for (g, _), k in found.items() if g == "c"} == {2}


def test_records_move_together(spark):
    """All roles get what is drawn from the input, whatever their own bounds; boxes are carried to true points; geometry isn't turned."""
    from cumulo.plans import records

    one, other = scatter(spark, 60, 8), affine.scale_fixed(scatter(spark, 80, 9), 3.0)
    lattices = spark.createDataFrame([(s, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 5, 5, 5) for s in "ab"], "shape_id string, " + ", ".join(f"{c} {'int' if c.startswith('cells') else 'double'}" for c in volume.LATTICE))
    cells = spark.createDataFrame([(s, i, i, i, 0.5) for s in "ab" for i in range(5)], "shape_id string, i int, j int, k int, val double")
    key = lambda df: {(r.shape_id, r.point_id): tuple(round(v, 9) for v in (r.x, r.y, r.sz)) for r in df.collect()}
    scaled = records.compose([{"name": "BoundScale", "args": {"min_a": 1.0, "max_a": 2.0}}, {"name": "PointcloudNoise", "args": {"stddev": 0.0}}])(records.Record(one, gt=other, occ=one, volume=cells, lattices=lattices))
    assert key(scaled.gt) == key(affine.bound_scale(other, 1.0, 2.0, frame=one)) and key(scaled.input) == key(affine.bound_scale(one, 1.0, 2.0)) == key(scaled.occ)
    box = scaled.lattices.where("shape_id = 'a'").first()
    wide = crop.bounds(one).where("shape_id = 'a'").first()
    assert box.max_x - box.min_x == pytest.approx(2 / max(wide.max_x - wide.min_x, wide.max_y - wide.min_y, wide.max_z - wide.min_z)) and box.cells_x == 5
    cut = records.compose([{"name": "BBoxCrop", "args": {"min_l": 0.4, "max_l": 0.6, "low_ratio": 0.9, "seed": 2}}])(records.Record(one, gt=one, occ=other))
    assert key(cut.input) == key(crop.crop_random(one, 0.4, 0.6, 0.9, 2)) == key(cut.gt) and 0 < len(key(cut.input)) < 120 and cut.occ is other
    small = records.crop_box(records.Record(one, geometry=other, volume=cells, lattices=lattices), (0.3, 0.3, 0.3), (0.6, 0.6, 0.6))
    assert small.lattices.first().cells_x == 3 and small.volume.count() == 6 and key(small.geometry) == key(crop.crop_box(other, (0.3,) * 3, (0.6,) * 3))
    for wrong in (lambda: records.rotate_axis(records.Record(one, geometry=other), "z", 0, 9), lambda: records.crop_box(records.Record(one, gt=other), (0,) * 3, (1,) * 3), lambda: records.Record(one, volume=cells), lambda: records.compose([{"name": "None"}])):
        with pytest.raises(ValueError):
            wrong()


def test_boxes_of_any_size(spark):
    """Sides from 1 to 10^4, flat, far, empty and unlimited ones: brute force's points, and few cells a box."""
    import numpy as np

    rng = np.random.default_rng(5)
    at = rng.random((400, 3)) * 10_000
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)] + [(400, math.nan, 1.0, 1.0), (401, None, 1.0, 1.0)], "point_id long, x double, y double, z double")
    boxes = []
    for i in range(40):
        half = np.array([10.0 ** (i % 5)] * 3) / 2
        middle = at[i] + half * 0.5
        if i % 4 == 3:
            half[i % 3] = 5000
        boxes.append((i, *map(float, middle - half), *map(float, middle + half)))
    inf = math.inf
    boxes += [(40, -inf, -inf, -inf, inf, inf, inf), (41, 5.0, 0.0, 0.0, 5.0, 1e4, 1e4), (42, 9.0, 0.0, 0.0, 1.0, 1e4, 1e4), (43, math.nan, 0.0, 0.0, 1e4, 1e4, 1e4), (44, None, 0.0, 0.0, 1e4, 1e4, 1e4), (45, 0.0, 0.0, 0.0, math.nan, 1e4, 1e4), (46, 5e3, -inf, 0.0, inf, inf, inf), (47, 1e17, 0.0, 0.0, 1e17 + 64, 1.0, 1.0), (0, 0.0, 0.0, 0.0, 1e4, 1e4, 1e4)]
    table = spark.createDataFrame(boxes, "box_id int, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    want = sorted((b[0], i) for b in boxes if None not in b for i, p in enumerate(at) if all(b[1 + k] < p[k] < b[4 + k] for k in range(3)))
    found = crop.crop_boxes(points, table)
    assert sorted((r.box_id, r.point_id) for r in found.collect()) == want and found.columns == ["box_id", "point_id", "x", "y", "z"]
    assert crop.crop_boxes(points, table.limit(0)).count() == 0 and crop.crop_boxes(points.limit(0), table).count() == 0
    far = points.selectExpr("point_id", "x + 1e17 x", "y", "z")
    assert crop.crop_boxes(far, table.where("box_id = 47")).count() == 0


def test_draws_by_read(spark):
    """An item's draw changes with each epoch that reads it, and with nothing else; in validation it doesn't."""
    items = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "source string, item int")
    rows = mixing.mix_epochs(items, {"a": 0.6}, range(4)).collect()
    seen = {}
    for r in sorted(rows, key=lambda r: r.epoch):
        assert r.reads == seen.get((r.source, r.item), 0)
        seen[r.source, r.item] = r.reads + 1
    assert len(rows) == 16 and len({r.draw for r in rows}) == 16 and seen["b", 9] == 4
    again = mixing.mix_epochs(items, {"a": 0.6}, [3]).collect()
    assert {(r.item, r.draw) for r in again} == {(r.item, r.draw) for r in rows if r.epoch == 3}
    assert {r.draw for r in mixing.mix_epochs(items, {}, range(2), 7, validation=True).collect()} == {"7"}
    assert sorted(map(tuple, mixing.mix_epoch(items, {"a": 0.6}, 3).collect())) == sorted((r.idx, r.source, r.item) for r in again)


def test_chunks_give_what_the_whole_scene_gives(spark):
    """Normals and spacing by overlapping chunks are the whole scene's wherever they say so, and rows are neither lost nor doubled."""
    gen = np.random.default_rng(8)
    rows = [("a#1", i, *map(float, p)) for i, p in enumerate(np.r_[gen.random((300, 3)) * 2 - 1, np.floor(gen.random((40, 3)) * 4) / 2 - 1])]
    rows += [("b", 1, 5.0, 5.0, 5.0), ("b", 2, float("nan"), 0.0, 0.0)]
    points = spark.createDataFrame(rows, "shape_id string, point_id long, x double, y double, z double").withColumns({c: F.lit(v) for c, v in (("nx", 0.0), ("ny", 0.0), ("nz", 1.0), ("sx", 0.0), ("sy", 0.0), ("sz", 9.0))})
    told = {(r.shape_id, r.point_id): r for r in chunks.neighbourhoods(points, 8, 0.5, 0.4).collect()}
    assert set(told) == {r[:2] for r in rows[:-1]} and len(told) == len(rows) - 1
    x = np.array([r[2:] for r in rows[:340]])
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), axis=1)[:, :8]
    low = np.floor(x / 0.5) * 0.5
    room = np.minimum(x - (low - 0.4), low + 0.9 - x).min(axis=1)
    for i in range(340):
        row = told["a#1", i]
        assert row.whole == (d[i, 7] < room[i]) and (not row.whole or abs(row.spacing - d[i].mean()) < 1e-12)
    assert 40 < sum(r.whole for r in told.values()) < 341 and not told["b", 1].whole
    pick = lambda df: {(r.shape_id, r.point_id): np.array([r.nx, r.ny, r.nz]) for r in df.collect()}
    whole = pick(normals.oriented(points.where("not isnan(x)"), 8))
    parts = chunks.oriented_by_chunks(points, 0.5, 0.4, 8)
    sure = pick(parts.where("whole"))
    assert len(sure) > 40 and all(np.allclose(v, whole[k]) for k, v in sure.items())
    assert parts.columns == [*points.columns, "whole"] or set(parts.columns) == {*points.columns, "whole"}
    # A function that hands on neither in_core nor all of its rows, with a halo wider than a core.
    kept = chunks.by_chunks(points, lambda c: c.where("point_id % 2 = 0").select("shape_id", "point_id", (F.col("x") * 2).alias("twice")), 0.3, 0.5)
    assert sorted(map(tuple, kept.collect())) == sorted((s, i, 2 * v) for s, i, v, *_ in rows[:-1] if i % 2 == 0)
    assert chunks.by_chunks(points.where("false"), lambda c: c, 1.0, 0.0).count() == 0
    for size, halo in ((0.0, 1.0), (1.0, -1.0)):
        with pytest.raises(ValueError):
            chunks.split(points, size, halo)


def test_parts_of_names_are_worked_out_once(spark):
    made = spark.createDataFrame([(["a_b.c_d=True", "x.y.z=1=2", "ab.cd=false", "e=", "x.y.z=7"],), ([],)], "told array<string>").select(mixing.run_name(F.col("told")).alias("name"))
    assert [r.name for r in made.collect()] == ["a.c0-ab.cd1-e-xy.z7", ""]
    assert made._jdf.queryExecution().analyzed().toString().count("split(") <= 4
