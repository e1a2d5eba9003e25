"""Files written and read back."""

import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from cumulo.sources import files, frames, views
from cumulo.streaming.metric_stream import read_log, windowed_means
from datadir import DATA
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def test_npz(spark, tmp_path):
    x, n = np.random.default_rng(1).random((2, 20, 3)).astype(np.float32)
    np.savez(tmp_path / "chair.npz", points=x, normals=n)
    rows = files.read_points(spark, "npz", [f"file://{tmp_path}/chair.npz"]).orderBy("point_id").toPandas()
    assert (rows.shape_id == "chair").all() and np.allclose(rows[["x", "y", "z"]], x) and np.allclose(rows[["nx", "ny", "nz"]], n) and rows.sx.isna().all()
    assert files.read_points(spark, "npz", [f"file://{tmp_path}/chair.npz"], columns=["shape_id", "x"]).columns == ["shape_id", "x"]


def test_ply_round_trip(spark, tmp_path):
    cloud = views.small_cloud(spark, DATA).where("point_id < 100")
    files.write_ply(cloud, f"file://{tmp_path}/out")
    paths = [f"file://{p}" for p in (tmp_path / "out").glob("*.ply")]
    back = files.read_points(spark, "ply", paths)
    total = lambda df: df.selectExpr("count(*)", "round(sum(x), 9)", "round(sum(sz), 9)", "round(sum(b), 9)").first()
    assert len(paths) == cloud.select("shape_id").distinct().count() and total(back) == total(cloud)


def test_ply_kinds():
    text = b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty uchar red\nelement face 0\nproperty list uchar int vertex_indices\nend_header\n1.5 255\n2 0\n"
    out = files.ply_columns(text, {"x", "r"})
    assert out["x"].tolist() == [1.5, 2] and out["r"].tolist() == [1, 0]
    with_faces = files.ply_bytes({"x": np.arange(3.0)}, np.array([[0, 1, 2]]))
    assert files.ply_columns(with_faces, {"x"})["x"].tolist() == [0, 1, 2]


def test_las():
    head = bytearray(227)
    head[:4] = b"LASF"
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<HI", head, 105, 20, 2)
    struct.pack_into("<6d", head, 131, 0.5, 0.5, 0.5, 10, 20, 30)
    body = b"".join(struct.pack("<3i", *p) + bytes(8) for p in ((2, 4, 6), (-2, 0, 1)))
    out = files.las_columns(bytes(head) + body, set("xyz"))
    assert out["x"].tolist() == [11, 9] and out["z"].tolist() == [33, 30.5]
    with pytest.raises(ValueError):
        files.las_columns(b"nope", {"x"})


def test_lists(spark, tmp_path):
    for g in ("a", "b"):
        (tmp_path / g).mkdir()
        (tmp_path / g / "train.lst").write_text(f"{g}1\n\n{g}2\n\n")
    assert sorted(tuple(r) for r in files.read_manifest(spark, str(tmp_path), "train").collect()) == [("a", "a1"), ("a", "a2"), ("b", "b1"), ("b", "b2")]
    (tmp_path / "pairs.txt").write_text("in/x.ply gt/x.ply\n\nin/y.ply  gt/y.ply\n")
    assert {tuple(r) for r in files.read_pairs(spark, str(tmp_path / "pairs.txt")).collect()} == {("x", "in/x.ply", "gt/x.ply"), ("y", "in/y.ply", "gt/y.ply")}


def test_occupancy(spark):
    points = files.dummy_occupancy(spark, 12).drop("occ")
    assert [r.occ for r in files.occupancy_samples(spark, points, b"\x80\x10").orderBy("point_id").collect()] == [True, *[False] * 10, True]


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:02:00", "a", 3.0), ("2024-01-01 02:00:00", "a", 9.0)]
    spark.createDataFrame(rows, "ts string, name string, value double").selectExpr("cast(ts as timestamp_ntz) ts", "name", "value").write.parquet(str(tmp_path / "log"))
    query = windowed_means(read_log(spark, str(tmp_path / "log"))).writeStream.outputMode("append").format("memory").queryName("means").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.n, r["mean"]) for r in spark.table("means").collect()] == [(2, 2.0)]


def test_shared_folders(spark, monkeypatch):
    from types import SimpleNamespace

    from cumulo.sources import storage

    assert storage.shared_dir(spark, "x") != storage.shared_dir(spark, "x")
    conf = SimpleNamespace(get=lambda key, default: default)
    cluster = SimpleNamespace(master="spark://host:7077", getConf=lambda: conf, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
    with pytest.raises(ValueError):
        storage.checkpoint_base(SimpleNamespace(sparkContext=cluster))
    cluster.master = "local[2]"
    assert storage.checkpoint_base(SimpleNamespace(sparkContext=cluster)) == storage.LOCAL_BASE
    cluster.getConf = lambda: SimpleNamespace(get=lambda key, default: "s3a://bucket/work")
    cluster.master = "yarn"
    assert storage.checkpoint_base(SimpleNamespace(sparkContext=cluster)) == "s3a://bucket/work"


def test_uris_of_hadoop_are_taken():
    from cumulo.sources import storage

    assert storage.arrow_uri("s3a://bucket/a/b") == "s3://bucket/a/b" and storage.arrow_uri("dbfs:/x/y") == "file:///dbfs/x/y"
    assert storage.arrow_uri("file:/tmp/x") == "file:///tmp/x" and storage.arrow_uri("/tmp/x") == "/tmp/x" and storage.arrow_uri("hdfs://n/x") == "hdfs://n/x"
    assert storage.opened("file:/tmp/x")[1] == "/tmp/x"


def test_obj_meshes(spark, tmp_path):
    (tmp_path / "box.obj").write_text("# a square and a triangle\nv 0 0 0\nv 1 0 0\nvn 0 0 1\nv 1 1 0\nv 0 1 0\nf 1/1/1 2//1 3 4\nf -4 -3 -1\n")
    rows = files.read_meshes(spark, [f"file://{tmp_path}/box.obj"]).orderBy("face_id").collect()
    assert [(r.shape_id, r.face_id, r.ax, r.ay, r.bx, r.by, r.cx, r.cy) for r in rows] == [("box", 0, 0, 0, 1, 0, 1, 1), ("box", 1, 0, 0, 1, 1, 0, 1), ("box", 2, 0, 0, 1, 0, 0, 1)]
    (tmp_path / "none.obj").write_text("")
    assert files.read_meshes(spark, [f"file://{tmp_path}/none.obj"]).count() == 0


def test_geometry_with_volume(spark, tmp_path):
    grid = np.array([[[1.0, np.nan]], [[-2.0, 3.0]]])
    with open(tmp_path / "g.npz", "wb") as f:
        np.savez_compressed(f, xyz=np.zeros((2, 3)), normal=np.ones((2, 3)), volume=grid, volume_min=np.array([0.0, 0, 0]), volume_max=np.array([1.0, 2, 3]))
    path = [f"file://{tmp_path}/g.npz"]
    cells = files.read_volumes(spark, path)
    assert sorted((r.i, r.j, r.k, r.val, r.max_y) for r in cells.collect()) == [(0, 0, 0, 1.0, 2.0), (1, 0, 0, -2.0, 2.0), (1, 0, 1, 3.0, 2.0)]
    points = files.read_points(spark, "npz", path)
    files.write_npz(points, f"file://{tmp_path}/out", cells)
    back = [f"file://{tmp_path}/out/g.npz"]
    assert sorted(map(tuple, files.read_volumes(spark, back).collect())) == sorted(map(tuple, cells.collect()))
    assert files.read_points(spark, "npz", back).select("x", "nx").collect() == points.select("x", "nx").collect()


def test_side_colours_and_names(spark, tmp_path):
    for model in ("a", "b"):
        (tmp_path / model).mkdir()
        np.savez(tmp_path / model / "pointcloud.npz", points=np.full((2, 3), ord(model)), normals=np.zeros((2, 3)))
        np.savez(tmp_path / model / "color.npz", rgb=np.full((2, 3), ord(model) / 200))
    paths = lambda name: [f"file://{tmp_path}/{m}/{name}.npz" for m in "ab"]
    names = ["cat/a", "cat/b"]
    points, colours = files.read_points(spark, "npz", paths("pointcloud"), names=names), files.read_points(spark, "npz", paths("color"), columns=["shape_id", "point_id", "r", "g", "b"], names=names)
    rows = files.with_colours(points, colours).collect()
    assert len(rows) == 4 and all(r.r == r.x / 200 and r.shape_id == f"cat/{chr(int(r.x))}" for r in rows)


def test_regions_and_folders(tmp_path):
    for name in ("s1/r2", "s1/r1", "s0/r9", "s2/r0"):
        (tmp_path / name).mkdir(parents=True)
    assert files.list_regions(f"file://{tmp_path}", ["s1", "s0", "none"]) == [("s1", "r1"), ("s1", "r2"), ("s0", "r9")]
    assert files.record_folder("s3://b/x/", "set", "run") == "s3://b/x/set/run"


def test_occupancy_by_columns(spark):
    packed = bytes([0b10100000, 0b00010000])
    points = spark.range(14).selectExpr("id as point_id", "cast(id as double) as x")
    rows = files.occupancy_samples(spark, points, packed).orderBy("point_id").collect()
    assert [r.point_id for r in rows if r.occ] == [0, 2, 11] and len(rows) == 14


def test_las_of_version_1_4(spark, tmp_path):
    """The 64-bit count of records is read; the older one is 0 in such files."""
    head = bytearray(375)
    head[:4], head[24], head[25], head[104] = b"LASF", 1, 4, 6
    struct.pack_into("<I", head, 96, 375)
    struct.pack_into("<HI", head, 105, 30, 0)
    struct.pack_into("<6d", head, 131, 0.5, 0.5, 0.5, 10, 20, 30)
    struct.pack_into("<Q", head, 247, 5)
    body = b"".join(struct.pack("<3i", 2 * i, i, -i) + bytes(18) for i in range(5))
    (tmp_path / "new.las").write_bytes(bytes(head) + body)
    rows = files.read_points(spark, "las", [f"file://{tmp_path}/new.las"]).orderBy("point_id").collect()
    assert [(r.x, r.y, r.z) for r in rows] == [(10 + i, 20 + i / 2, 30 - i / 2) for i in range(5)]
    with pytest.raises(ValueError, match="ends early"):
        files.las_columns(bytes(head) + body[:-1], {"x"})
    head[104] = 0x86
    with pytest.raises(ValueError, match="compressed"):
        files.las_columns(bytes(head) + body, {"x"})


def test_lattices_survive_unknown_cells(spark, tmp_path):
    """Of a 4 x 4 x 4 volume with two known cells, and of one without any."""
    lattices = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 3.0, 3.0, 3.0, 4, 4, 4), ("b", -1.0, 0.0, 0.0, 1.0, 1.0, 1.0, 2, 3, 5)], files.LATTICE_SCHEMA)
    cells = spark.createDataFrame([("a", 1, 1, 0, 0.5), ("a", 1, 0, 0, -0.5)], "shape_id string, i int, j int, k int, val double")
    points = spark.createDataFrame([("a", 0, 1.0, 2.0, 3.0), ("c", 0, 1.0, 2.0, 3.0)], "shape_id string, point_id long, x double, y double, z double")
    files.write_npz(points, f"file://{tmp_path}/out", cells, lattices)
    with np.load(tmp_path / "out" / "a.npz") as a, np.load(tmp_path / "out" / "b.npz") as b, np.load(tmp_path / "out" / "c.npz") as c:
        assert a["volume"].shape == (4, 4, 4) and np.isfinite(a["volume"]).sum() == 2 and a["volume"][1, 1, 0] == 0.5 and a["xyz"].tolist() == [[1, 2, 3]]
        assert b["volume"].shape == (2, 3, 5) and np.isnan(b["volume"]).all() and b["volume_min"].tolist() == [-1, 0, 0] and "volume" not in c
    paths = [f"file://{tmp_path}/out/{n}.npz" for n in "abc"]
    assert sorted(map(tuple, files.read_lattices(spark, paths).collect())) == sorted(map(tuple, lattices.collect()))
    back = files.read_volumes(spark, paths[:1])
    assert sorted((r.i, r.j, r.k, r.val, r.cells_x, r.max_x) for r in back.collect()) == [(1, 0, 0, -0.5, 4, 3.0), (1, 1, 0, 0.5, 4, 3.0)]
    files.write_npz(points, f"file://{tmp_path}/again", back)
    with np.load(tmp_path / "again" / "a.npz") as a:
        assert a["volume"].shape == (4, 4, 4)
    wrong = lattices.withColumn("cells_x", lattices.cells_x - 3).where("shape_id = 'a'")
    with pytest.raises(Exception, match="don't agree"):
        files.write_npz(points, f"file://{tmp_path}/wrong", cells, wrong)


def las_file(n: int) -> bytes:
    head = bytearray(375)
    head[:4], head[24], head[25], head[104] = b"LASF", 1, 4, 6
    struct.pack_into("<I", head, 96, 375)
    struct.pack_into("<HI", head, 105, 30, 0)
    struct.pack_into("<6d", head, 131, 0.5, 0.5, 0.5, 10, 20, 30)
    struct.pack_into("<Q", head, 247, n)
    body = np.zeros(n, np.dtype([("p", "<i4", (3,)), ("rest", "V18")]))
    body["p"] = np.arange(n)[:, None]
    return bytes(head) + body.tobytes()


def test_large_files_are_read_by_ranges(spark, tmp_path):
    """Of bytes of records; numbers go on from range to range, and a header of any length is no record."""
    x = np.arange(1000.0)
    ply = files.ply_bytes({"x": x, "y": -x, "z": x / 2}).replace(b"format", b"comment " + b"-" * 100_000 + b"\nformat", 1)
    (tmp_path / "a.ply").write_bytes(ply)
    (tmp_path / "b.ply").write_bytes(files.ply_bytes({"x": x[:3], "y": x[:3], "z": x[:3]}))
    (tmp_path / "c.las").write_bytes(las_file(1000))
    rows = files.read_points(spark, "ply", [f"file://{tmp_path}/{n}.ply" for n in "ab"], columns=["shape_id", "point_id", "x", "z"], split_bytes=2400)
    assert rows.rdd.getNumPartitions() == 11
    assert sorted((r.shape_id, r.point_id, r.x) for r in rows.collect()) == sorted([("a", i, float(i)) for i in range(1000)] + [("b", i, float(i)) for i in range(3)])
    rows = files.read_points(spark, "las", [f"file://{tmp_path}/c.las"], split_bytes=3000)
    assert rows.rdd.getNumPartitions() == 10 and sorted((r.point_id, r.x) for r in rows.collect()) == [(i, 10 + i / 2) for i in range(1000)]
    (tmp_path / "a.ply").write_bytes(ply[:-1])
    with pytest.raises(Exception, match="ends early"):
        files.read_points(spark, "ply", [f"file://{tmp_path}/a.ply"], split_bytes=2400).count()


def test_batches_hold_a_bounded_number_of_records(tmp_path, monkeypatch):
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    monkeypatch.setattr(files, "BATCH", 100)
    (tmp_path / "c.las").write_bytes(las_file(1050))
    schema = StructType([StructField("point_id", LongType()), StructField("x", DoubleType())])
    reader = files._Reader(schema, {"paths": f"file://{tmp_path}/c.las"}, files.las_columns, files.las_layout)
    (part,) = reader.partitions()
    batches = list(reader.read(part))
    assert [b.num_rows for b in batches] == [100] * 10 + [50] and [b.column(0)[0].as_py() for b in batches] == list(range(0, 1050, 100))


def test_files_that_cannot_be_read_are_replaced(spark, tmp_path):
    """A cut-off file and a missing one among ten: the missing one always, the other where that is wanted."""
    for i in range(9):
        data = files.ply_bytes({a: np.full(40, float(i)) for a in "xyz"})
        (tmp_path / f"f{i}.ply").write_bytes(data[:-1] if i == 4 else data)
    paths = [f"file://{tmp_path}/f{i}.ply" for i in range(10)]
    with pytest.raises(Exception, match="ends early"):
        files.fetch(spark, "ply", paths).count()
    for split in (files.SPLIT_BYTES, 240):
        rows = files.fetch(spark, "ply", paths, skip_on_error=True, split_bytes=split).groupBy("shape_id", "read").agg({"*": "count", "x": "avg"}).collect()
        assert sorted(r.shape_id for r in rows) == [f"f{i}" for i in range(10)] and all(r["count(1)"] == 40 and r["avg(x)"] == int(r.read[1:]) for r in rows)
        assert all((r.read == r.shape_id) == (r.shape_id not in ("f4", "f9")) and r.read not in ("f4", "f9") for r in rows)
    whole = [p for p in paths if "f4" not in p]
    assert files.fetch(spark, "ply", whole).select("shape_id").distinct().count() == 9
    assert files.fetch(spark, "ply", whole, seed=1).where("shape_id <> read").select("read").distinct().count() == 1
    assert files.fetch(spark, "ply", [paths[9]]).count() == 0
    told = {r.shape_id: (r.n, r.error) for r in files.statuses(spark, "ply", paths, skip_on_error=True).collect()}
    assert told["f0"] == (40, None) and "ends early" in told["f4"][1] and told["f9"][1].startswith("FileNotFoundError")
    (tmp_path / "bad.npz").write_bytes(b"PK nothing")
    np.savez(tmp_path / "good.npz", points=np.ones((5, 3)))
    npz = [f"file://{tmp_path}/{n}.npz" for n in ("bad", "good")]
    assert {(r.shape_id, r.read) for r in files.fetch(spark, "npz", npz, skip_on_error=True).collect()} == {("bad", "good"), ("good", "good")}
    with pytest.raises(Exception):
        files.fetch(spark, "npz", npz).count()


def test_sinks_commit_or_leave_nothing(spark, tmp_path):
    cloud = spark.range(40).selectExpr("cast(id % 4 as string) shape_id", "id point_id", "cast(id as double) x", "0.0D y", "0.0D z")
    broken = cloud.selectExpr("shape_id", "point_id", "x", "y", "if(point_id = 39, cast(raise_error('stop') as double), z) z")
    out = tmp_path / "out"
    with pytest.raises(Exception, match="stop"):
        files.write_ply(broken, f"file://{out}")
    assert not [p for p in out.rglob("*") if p.is_file()]
    files.write_ply(cloud, f"file://{out}")
    assert sorted(p.name for p in out.rglob("*.ply")) == ["0.ply", "1.ply", "2.ply", "3.ply"] and not list((out / "_attempts").iterdir())
    with pytest.raises(Exception, match="several tasks"):
        cloud.where("shape_id = '0'").repartition(3).write.format("points_ply").mode("append").save(f"file://{tmp_path}/twice")
    assert not list((tmp_path / "twice").rglob("*.ply"))


def test_attempts_that_fail_midway(tmp_path):
    """What an attempt has written counts only if its message is committed; others' files go."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("shape_id string, x double")
    writer = files._Writer(schema, {"path": f"file://{tmp_path}"}, "ply")
    batch = lambda shape, n: pa.RecordBatch.from_pydict({"shape_id": [shape] * n, "x": [1.0] * n})

    def dies():
        yield batch("a", 3)
        yield batch("b", 3)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    assert len(list(tmp_path.rglob("a.ply"))) == 1 and not (tmp_path / "a.ply").exists()
    writer.write(iter([batch("a", 9)]))
    good = writer.write(iter([batch("a", 3), batch("b", 4)]))
    writer.commit([good, None])
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.ply")) == ["a.ply", "b.ply"]
    assert len(files.ply_columns((tmp_path / "a.ply").read_bytes(), {"x"})["x"]) == 3


def test_meshes_and_artifacts_round_trip(spark, tmp_path):
    corners = [("a", 0, *map(float, (0, 0, 0, 1, 0, 0, 0, 1, 0))), ("a", 1, *map(float, (1, 0, 0, 1, 1, 0, 0, 1, 0))), ("b", 0, *map(float, range(9)))]
    triangles = spark.createDataFrame(corners, files.MESH_SCHEMA)
    files.write_meshes(triangles, f"file://{tmp_path}/mesh")
    assert sorted(map(tuple, files.read_meshes(spark, files.list_files(f"file://{tmp_path}/mesh", ".ply"), kind="ply").collect())) == corners
    assert b"element vertex 4" in (tmp_path / "mesh" / "a.ply").read_bytes()
    files.write_artifacts(triangles.selectExpr("concat('mesh ', shape_id) key", "12 batch_idx", "* except (shape_id)"), f"file://{tmp_path}/all", "mesh")
    arrays = spark.range(3).selectExpr("'grid' key", "id batch_idx", "id point_id", "cast(id as double) u", "-1.0D v")
    files.write_artifacts(arrays, f"file://{tmp_path}/all", "array")
    assert [p.removeprefix(f"file://{tmp_path}/all/") for p in files.list_files(f"file://{tmp_path}/all", "", nested=True) if "." in p.rpartition("/")[2]] == ["grid/000000.npy", "grid/000001.npy", "grid/000002.npy", "mesh~20a/000012.ply", "mesh~20b/000012.ply"]
    assert np.load(tmp_path / "all" / "grid" / "000002.npy").tolist() == [[2, -1]]
    quad = files.ply_bytes({a: np.arange(4.0) for a in "xyz"}) .replace(b"end_header", b"element face 2\nproperty list uchar int vertex_indices\nend_header")
    quad += struct.pack("<B4i", 4, 0, 1, 2, 3) + struct.pack("<B3i", 3, 3, 2, 1)
    out = files.ply_mesh_columns(quad, {"ax", "bx", "cx"})
    assert list(zip(out["ax"], out["bx"], out["cx"])) == [(0, 1, 2), (0, 2, 3), (3, 2, 1)]
    assert len(files.ply_mesh_columns(files.ply_bytes({a: np.arange(4.0) for a in "xyz"}), {"ax"})["ax"]) == 0


def test_a_frame_that_grows(spark, tmp_path):
    """Appended runs with other metrics: one header that only grows at its end, later runs over earlier ones, unfinished runs left out."""
    folder = f"file://{tmp_path}/frame"
    log = lambda rows: spark.createDataFrame(rows, "step long, name string, value double")
    assert frames.header(spark, folder) == []
    with pytest.raises(ValueError):
        frames.read_frame(spark, folder)
    assert frames.append_run(log([(1, "Loss", 1.0), (1, "b.c", 2.0), (2, "Loss", 3.0), (2, "Loss", 5.0), (2, None, 7.0)]), folder) == ["step", "Loss", "b.c"]
    assert frames.append_run(log([(2, "a", 6.0), (3, "a", 7.0)]), folder) == ["step", "Loss", "b.c", "a"]
    broken = tmp_path / "frame" / "run=000002"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"cut")
    assert frames.append_run(log([(3, "Loss", 8.0), (4, "d e", 9.0)]), folder) == ["step", "Loss", "b.c", "a", "d e"] == frames.header(spark, folder)
    assert (tmp_path / "frame" / "run=000003").exists()
    rows = frames.read_frame(spark, folder)
    assert rows.columns == ["step", "Loss", "b.c", "a", "d e"]
    assert sorted(map(tuple, rows.collect())) == [(1, 1.0, 2.0, None, None), (2, None, None, 6.0, None), (3, 8.0, None, None, None), (4, None, None, None, 9.0)]
    assert frames.append_run(log([]), folder) == ["step", "Loss", "b.c", "a", "d e"] and frames.read_frame(spark, folder).count() == 4
    with pytest.raises(ValueError):
        frames.append_run(log([(1, "step", 1.0)]), folder)
    with pytest.raises(ValueError):
        frames.append_run(log([(1, "Loss", 1.0)]).withColumn("step", F.col("step").cast("string")), folder)


def test_npz_files_are_written_and_opened_by_parts(spark, tmp_path):
    """A writer holds a batch of a shape's points, and a volume is read without the points beside it."""
    schema = StructType.fromDDL("shape_id string, x double, y double, z double, i int, j int, k int, val double, " + files.LATTICE_SCHEMA.removeprefix("shape_id string, "))
    n, lattice = 40_000, {"min_x": 0.0, "min_y": 0.0, "min_z": 0.0, "max_x": 1.0, "max_y": 1.0, "max_z": 1.0, "cells_x": 2, "cells_y": 3, "cells_z": 4}

    def batches():
        gen = np.random.default_rng(3)
        for _ in range(50):
            columns = {"shape_id": pa.array(["a"] * n), **{c: pa.array(gen.random(n)) for c in "xyz"}}
            yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, pa.int32() if f.dataType.typeName() == "integer" else pa.float64())) for f in schema], names=schema.fieldNames())
        cell = {"shape_id": "a", "i": 1, "j": 2, "k": 3, "val": 0.5, **lattice}
        yield pa.RecordBatch.from_pylist([{c: cell.get(c) for c in schema.fieldNames()}], pa.schema([(f.name, pa.string() if f.name == "shape_id" else pa.int32() if f.dataType.typeName() == "integer" else pa.float64()) for f in schema]))

    writer = files._Writer(schema, {"path": str(tmp_path)}, "npz")
    tracemalloc.start()
    writer.commit([writer.write(batches())])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 25e6
    with np.load(tmp_path / "a.npz") as file:
        assert file["xyz"].shape == (50 * n, 3) and np.array_equal(file["xyz"][:n, 0], np.random.default_rng(3).random(n)) and file["volume"][1, 2, 3] == 0.5 and np.isnan(file["volume"]).sum() == 23
    for decode, schema_ in ((files.volume_columns, files.VOLUME_SCHEMA), (files.lattice_columns, files.LATTICE_SCHEMA)):
        reader = files._Reader(StructType.fromDDL(schema_), {"paths": str(tmp_path / "a.npz")}, decode)
        tracemalloc.start()
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(rows) == 1 and rows[0]["cells_z"] == 4 and most < 5e6


def test_very_many_small_ranges_are_joined(spark, tmp_path):
    """Tasks of a scan don't grow with files that are small altogether, whatever split_bytes; numbers stay those in the file."""
    x = np.arange(10_000.0)
    (tmp_path / "a.ply").write_bytes(files.ply_bytes({"x": x, "y": -x, "z": x / 2}))
    rows = files.read_points(spark, "ply", [f"file://{tmp_path}/a.ply"], columns=["shape_id", "point_id", "x"], split_bytes=24)
    assert rows.rdd.getNumPartitions() <= 300
    assert sorted((r.point_id, r.x) for r in rows.collect()) == [(i, float(i)) for i in range(10_000)]
