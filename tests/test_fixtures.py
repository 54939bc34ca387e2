"""Small tables with values worked out by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from episodica.functions import linalg as L
from episodica.operators import gaussians as GS
from episodica.operators import geometry as G
from episodica.operators import keys as K
from episodica.operators import latents as E
from episodica.operators import metrics as M
from episodica.operators import sampling as S
from episodica.operators import windows as W
from episodica.sources import episodes as SRC


def test_episode_order(spark):
    df = spark.createDataFrame([("demo10",), ("demo2",), ("demoX",), ("demo1",)], "episode string")
    assert [r[0] for r in df.orderBy(*K.episode_order(df)).collect()] == ["demo1", "demo2", "demo10", "demoX"]
    assert [r[0] for r in df.orderBy(*K.episode_order(df, order="lexical")).collect()] == ["demo1", "demo10", "demo2", "demoX"]


def test_far_partner_has_the_whole_set(spark):
    want = {0: {3, 4, 5}, 1: {4, 5}, 2: {5}, 3: {0}, 4: {0, 1}, 5: {0, 1, 2}}
    df = spark.range(6).select(F.col("id").alias("t"), F.lit(6).cast("long").alias("len")).crossJoin(spark.range(60).select(F.col("id").alias("episode")))
    got = {t: set() for t in want}
    for r in S.far_partner(df, 3, 1, ["episode"]).collect():
        got[r["t"]].add(r["partner"])
    assert got == want


def test_splits(spark):
    for n, val in ((50, 2), (30, 2), (1, 0)):
        df = spark.range(n).select(F.concat(F.lit("demo"), "id").alias("episode"))
        assert S.split_first(df, 0.05, 42).filter("split = 'val'").count() == val
    one = spark.createDataFrame([("demo1",)], "episode string")
    assert sorted(r["split"] for r in S.split_by_ratio(one, 0.9, 1).collect()) == ["train", "val"]
    assert [r["split"] for r in S.split_by_ratio(one, 0.9, 1, single="train_only").collect()] == ["train"]


def test_allocation(spark):
    views = spark.range(6).select(F.lit("e").alias("episode"), F.col("id").alias("cam_idx"))
    got = {r["cam_idx"]: r["count"] for r in S.allocate(views, 8).groupBy("cam_idx").count().collect()}
    assert got == {0: 2, 1: 2, 2: 1, 3: 1, 4: 1, 5: 1}


def test_windows(spark):
    df = spark.range(3).select(F.lit("e").alias("episode"), F.col("id").alias("t"), F.col("id").alias("v"))
    got = {r["t"]: r["actions"] for r in W.padded_windows(df, 4, 2, "v").collect()}
    assert got == {0: [0, 0, 1, 2], 1: [0, 1, 2, 2], 2: [1, 2, 2, 2]}
    with pytest.raises(ValueError):
        W.padded_windows(df, 1, 2, "v")
    seven = spark.range(7).select(F.lit("e").alias("episode"), F.col("id").alias("t"), F.col("id").alias("v"))
    assert sorted(r["start"] for r in W.strided_windows(seven, 3, 3, "v").collect()) == [0, 3]
    assert W.strided_windows(df.filter("t < 2"), 3, 3, "v").count() == 0


def test_nstep(spark):
    rows = [(0, 0, i, float(i + 1), i == 3) for i in range(4)]
    df = spark.createDataFrame(rows, "actor int, episode int, step int, reward double, done boolean")
    got = {r["step"]: (round(r["n_return"], 9), round(r["n_discount"], 9)) for r in W.nstep_return(df, 2, 0.9).collect()}
    assert got == {0: (2.8, 0.81), 1: (4.7, 0.81), 2: (6.6, 0.0)}
    one = {r["step"]: r["n_return"] for r in W.nstep_return(df, 1, 0.9).collect()}
    assert one == {i: i + 1.0 for i in range(4)}


def test_statistics(spark):
    df = spark.createDataFrame([([1.0],), ([2.0],), ([4.0],)], "v array<double>")
    assert M.normalizer_stats(df, "v", 1).first()["std"][0] == pytest.approx(1.5275252)
    assert M.normalizer_stats(df.limit(1), "v", 1).first()["std"][0] is None
    errors = spark.createDataFrame([("a", 0.01)], "view string, mse double")
    assert M.psnr_by_view(errors).first()["psnr"] == pytest.approx(19.9999957, abs=1e-6)


def vectors(spark):
    v = [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 0.0]]
    return spark.createDataFrame([(0, i // 2, i % 2, x, x) for i, x in enumerate(v)], "batch_id long, state_id long, view_id long, z_inv array<double>, z_dep array<double>")


def test_contrasts(spark):
    df = vectors(spark)
    assert E.consistency(df, "z_inv", 2, "state_id").first()["value"] == pytest.approx(0.25)
    assert E.consistency(df, "z_inv", 2, "view_id").first()["value"] == pytest.approx(0.25)
    got = E.view_state_contrast(df, 0.5).first()
    assert got["inv"] == pytest.approx(1.3436208) and got["dep"] == pytest.approx(1.3436208)
    keys = spark.createDataFrame([(0, i, x) for i, x in enumerate([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 0.0]])], "batch_id long, state_id long, vec array<double>")
    assert E.infonce(keys, keys, 0.5).first()["loss"] == pytest.approx(0.9422403)
    lonely = df.filter("state_id = 0 AND view_id = 0")
    assert E.view_state_contrast(lonely, 0.5).first()["inv"] == 0.0


def test_code_usage(spark):
    codes = spark.createDataFrame([(0,), (0,), (0,), (1,)], "code int")
    got = E.code_usage(codes, spark.range(4).select(F.col("id").cast("int").alias("code"))).first()
    assert (got["used"], got["dead"]) == (0.5, 3) and got["perplexity"] == pytest.approx(1.7547654)


def test_triplet(spark):
    df = spark.createDataFrame([("b", 0, [0.0, 0.0], [0.0, 0.5]), ("b", 1, [1.0, 1.0], [1.0, 0.0])], "batch_id string, k int, a array<double>, p array<double>")
    rolled = S.rolled_negative(df, key="k").join(df.select(F.col("k").alias("negative"), F.col("a").alias("n")), "negative")
    for margin, want in ((1.5, 0.25), (0.2, 0.0)):
        assert E.triplet_hinge(rolled, margin, "a", "p", "n", ["batch_id"]).first()["loss"] == pytest.approx(want)


def test_nearest_rotation(spark):
    pose = [1.0, 0.1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    bad = [float("nan")] + pose[1:]
    df = spark.createDataFrame([(1, pose), (2, bad), (3, [0.0] * 16), (4, None), (5, pose[:12])], "id int, pose array<double>")
    got = G.clean_poses(df).collect()
    assert [r["id"] for r in got] == [1]
    assert [round(x, 6) for x in got[0]["pose"][:3]] == [0.998752, 0.049938, 0.0]
    reasons = {r["id"]: r["r"] for r in df.select("id", G.pose_reason("pose").alias("r")).collect()}
    assert reasons == {1: None, 2: "not_finite", 3: "zero_rotation", 4: "bad_shape", 5: "bad_shape"}


def test_intrinsics(spark):
    df = spark.createDataFrame([([800.0, 0.0, 640.0, 0.0, 800.0, 360.0, 0.0, 0.0, 1.0],)], "k array<double>")
    got = df.select(G.scale_intrinsics("k", (1280, 720), (128, 128)).alias("k")).first()["k"]
    assert [round(got[i], 4) for i in (0, 4, 2, 5)] == [80.0, 142.2222, 64.0, 64.0]


def test_rig(spark):
    df = spark.createDataFrame([(2.0, -45.0, 0.0, [0.0, 0.6, 0.0], [0.0, 0.0, 1.0], 45.0), (1.0, 0.0, 90.0, [0.0, 0.0, 0.0], [0.0, 0.0, 1.0], 45.0)], "r double, theta double, phi double, look_at array<double>, up array<double>, fovy double")
    rig = G.to_opencv(G.rig_table(df, 128, 128)).orderBy(F.desc("r")).collect()
    assert round(rig[0]["K"][0], 5) == 154.50967 and rig[0]["K"][2] == 63.5
    for r in rig:
        m = r["w2c"]
        for i in range(3):
            for j in range(3):
                assert sum(m[i * 4 + k] * m[j * 4 + k] for k in range(3)) == pytest.approx(float(i == j), abs=1e-9)
        ahead = [sum(m[i * 4 + k] * r["look_at"][k] for k in range(3)) + m[i * 4 + 3] for i in range(3)]
        assert ahead == pytest.approx([0.0, 0.0, r["r"]], abs=1e-9)


def test_inverse_of_the_inverse(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.5, 0.5],)], "q array<double>").select(G.quat_to_matrix("q").alias("m"))
    flat = df.select(F.array(*[x for i in range(3) for x in (*[F.col("m")[i * 3 + j] for j in range(3)], F.lit(float(i)))], *map(F.lit, (0.0, 0.0, 0.0, 1.0))).alias("p"))
    row = flat.select("p", L.rigid_inverse(L.rigid_inverse("p")).alias("twice"), L.matmul("p", L.rigid_inverse("p"), 4).alias("one")).first()
    assert row["twice"] == pytest.approx(row["p"]) and row["one"] == pytest.approx([float(i % 5 == 0) for i in range(16)])


def test_depths(spark):
    df = spark.createDataFrame([(0, g, x, [0.0, 0.0, 0.0], 0.0, 0.0, 1.0) for g, x in enumerate([0.0, 0.0, -1.0])], "p int, g int, depth double, offset array<double>, x double, y double, z double")
    got = [round(r["z_depth"], 7) for r in GS.backproject(df, 0.1, 2.0, ["p"]).orderBy("g").collect()]
    assert got == [1.05, 1.4890113, 1.6143709]


def test_vertices(spark):
    df = spark.createDataFrame([([0.0] * 3, 0.9, [0.02] * 3, [1.0, 0.0, 0.0, 0.0], [0.0] * 3)], "xyz array<double>, opacity double, scale array<double>, rotation array<double>, dc array<double>")
    got = GS.vertex_properties(df).first()
    assert got["opacity"] == pytest.approx(2.1972246) and got["scale_0"] == pytest.approx(-3.912023)


def test_calibrations(spark, tmp_path):
    import json

    eye = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1.0]]
    moved = [[1.0, 0, 0, 0.2], *eye[1:]]
    cam = lambda pose=eye, focal=700.0, pp=(320.0, 180.0): {"pose": pose, "focal": focal, "principal_point": list(pp)}
    entry = lambda left=None, right=None, q=5, path="a/b/c/d": {"left_cam": left or cam(), "right_cam": cam(moved) if right is None else right or None, "relative_path": path, "quality_metric": q}
    far = [[1.0, 0, 0, 5.1], *eye[1:]]
    cases = {
        "ok": (entry(), None), "missing": (entry(right={}), "missing_camera"), "shape": (entry(left=cam(eye[:3])), "bad_shape"), "zero": (entry(left=cam([[0.0] * 4] * 4)), "zero_rotation"),
        "focal": (entry(left=cam(focal=0.0)), "bad_focal"), "nofocal": (entry(left=cam(focal=None)), "missing_intrinsics"), "near": (entry(right=cam()), "bad_baseline"), "far": (entry(right=cam(far)), "bad_baseline"), "low": (entry(q=1), "low_quality"),
    }
    path = tmp_path / "calibrations.json"
    path.write_text(json.dumps({k: v for k, (v, _) in cases.items()}))
    rows = SRC.read_calibrations(spark, str(path))
    got = {r["episode_id"]: r for r in G.clean_calibrations(rows, 3).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {k: r for k, (_, r) in cases.items()}
    assert got["ok"]["K_left"][:3] == [700.0, 0.0, 320.0] and got["ok"]["T_left_to_right"][3] == pytest.approx(-0.2)


def test_files(spark, tmp_path):
    for episode, camera, name in (("e1", "cam_left", "00007.png"), ("e1", "cam_left", "t_000012.png"), ("e2", "x", "note.txt")):
        (tmp_path / episode / camera).mkdir(parents=True, exist_ok=True)
        (tmp_path / episode / camera / name).write_bytes(b"abc")
    (tmp_path / "e1" / "metadata.json").write_text('{"num_frames": 2}')
    got = sorted((r["episode"], r["camera"], r["t"], r["length"]) for r in SRC.frame_manifest(spark, str(tmp_path)).collect())
    assert got == [("e1", "cam_left", 7, 3), ("e1", "cam_left", 12, 3)]
    assert [(r["episode"], r["num_frames"]) for r in SRC.read_episode_metadata(spark, str(tmp_path)).collect()] == [("e1", 2)]


def test_appending(spark, tmp_path):
    path = str(tmp_path / "episodes")
    new = spark.createDataFrame([(1,), (2,)], "k int")
    SRC.append_episodes(new, path, ["k"])
    SRC.append_episodes(new, path, ["k"])
    assert sorted(r["episode"] for r in spark.read.parquet(path).collect()) == ["demo1", "demo2", "demo3", "demo4"]
    frames = spark.createDataFrame([("e", "c", t, bytearray(b"x"), None, None) for t in range(3)], "episode string, camera string, t long, rgb binary, seg binary, seg_type binary")
    assert SRC.export_frames(frames, str(tmp_path / "out"), max_frames=2, seg=True) == 2


def test_bad_input_raises(spark):
    with pytest.raises(ValueError):
        W.token_grid(spark.range(3).withColumnRenamed("id", "token"), 10)
    with pytest.raises(ValueError):
        K.parse_view_groups(spark.range(1).select(F.lit("a").alias("camera")), "a,b;a")
    with pytest.raises(ValueError):
        S.camera_per_batch(spark.range(1).withColumnRenamed("id", "batch_id"), 2, "other", 1)
    assert math.isclose(GS.SH0, 0.5 / math.sqrt(math.pi))


def test_plans(spark):
    import contextlib
    import io

    import __spark_entry__ as entry

    def plan(df):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain("formatted")
        return out.getvalue()

    text = plan(entry.entry(spark))
    assert text.count("Exchange hashpartitioning") + text.count("Exchange\n") <= 4 and "CartesianProduct" not in text
    frames = entry.queries()["p8_source_targets"](spark, "/root/testdata/sf0.001")
    assert "ReadSchema: struct<vec_id:bigint>" in plan(frames)


def test_dataset_and_vertices(spark, tmp_path):
    root = tmp_path / "data"
    for name in SRC.TABLES:
        spark.createDataFrame([("demo1", 0), ("demo2", 1)], "episode string, t long").write.parquet(str(root / name))
    data = SRC.read_episodes(spark, str(root))
    assert data.total == 2 and data.frames.count() == 2
    rows = spark.createDataFrame([("e", "c", 0, 1.0), ("e", "c", 0, 2.0), ("e", "d", 0, 3.0)], "episode string, camera string, t long, x float")
    got = {r["camera"]: r["n_vertices"] for r in SRC.write_vertices(rows, str(tmp_path / "v"), ["episode", "camera", "t"]).collect()}
    assert got == {"c": 2, "d": 1}


def test_layout_strict(spark):
    episodes = spark.createDataFrame([("demo1", ["a"]), ("demo2", None)], "episode string, camera_names array<string>")
    cameras = spark.createDataFrame([("demo1", "a")], "episode string, camera string")
    streams = spark.createDataFrame([("demo1", "a_rgb"), ("demo9", "a_rgb")], "episode string, stream string")
    got = sorted((r["episode"], r["problem"]) for r in SRC.validate_layout(episodes, cameras, streams, ["a"]).collect())
    assert got == [("demo2", "no_camera_names"), ("demo9", "unknown_episode")]
    with pytest.raises(ValueError):
        SRC.validate_layout(episodes, cameras, streams, ["a"], strict=True)


def test_global_rank(spark):
    from episodica.functions.hashing import hash_key
    from episodica.operators.ranks import global_rank

    df = spark.range(1000).withColumn("h", hash_key(3, "id"))
    got = [(r["rank"], r["h"]) for r in global_rank(df, "h", "id").collect()]
    assert [h for _, h in sorted(got)] == sorted(h for _, h in got) and sorted(r for r, _ in got) == list(range(1000))
    assert global_rank(df.limit(0), "h", "id").count() == 0


def test_newest_rows_stay(spark, tmp_path):
    from episodica.streaming.replay import keep_newest

    path = str(tmp_path / "newest")
    for a, b in ((0, 10), (10, 25)):
        keep_newest(spark.range(a, b).withColumnRenamed("id", "transition_id"), path, 7)
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == list(range(18, 25))


def test_sixd_gives_columns(spark):
    df = spark.createDataFrame([([0.0, 1.0, 0.0, -1.0, 0.0, 0.0],), ([1.0, 2.0, 2.0, 0.0, 3.0, 0.0],)], "v array<double>")
    first, second = (r[0] for r in df.select(G.sixd_to_matrix("v")).collect())
    assert first == pytest.approx([0, -1, 0, 1, 0, 0, 0, 0, 1])
    a, b, c = (second[i::3] for i in range(3))
    assert a == pytest.approx([1 / 3, 2 / 3, 2 / 3]) and sum(x * y for x, y in zip(a, b)) == pytest.approx(0)
    assert c == pytest.approx([a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]])
    assert df.select(G.sixd_to_matrix("v", added=True)).first()[0] == pytest.approx([0, -1, 0, 1, 0, 0, 0, 0, 1], abs=1e-7)
    assert df.select(G.sixd_to_matrix("v", transposed=True)).first()[0] == pytest.approx([0, 1, 0, -1, 0, 0, 0, 0, 1])


def test_broken_offsets_stay_on_their_ray(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(0, 0, 0.0, [nan, inf, 9.0], 0.0, 0.0, 1.0), (1, 0, 2.0, [-inf, 0.5, -9.0], 0.0, 0.0, 1.0)], "p int, g int, depth double, offset array<double>, x double, y double, z double")
    got = [r["xyz_cam"] for r in GS.backproject(df, 0.1, 2.0, ["p"]).orderBy("p").collect()]
    assert got[0] == pytest.approx([0.0, 0.0, 1.05 + 3]) and got[1][:2] == pytest.approx([0.0, 0.5])
    scaled = GS.backproject(df, 0.1, 2.0, ["p"], depth_scale=0.0, depth_bias=0.0, xyz_scale=2.0, xyz_bias=1.0).orderBy("p").collect()
    assert scaled[1]["z_depth"] == pytest.approx(1.05) and scaled[1]["xyz_cam"][1] == pytest.approx(2.0)


def test_strict_modes(spark):
    from episodica.operators import gaussians as GA
    from episodica.operators import windows as W

    lists = spark.createDataFrame([("demo1", ["a", "b"]), ("demo2", ["a"])], "episode string, camera_names array<string>")
    assert K.select_views(lists, None, ["a"], strict=True).count() == 2
    with pytest.raises(ValueError, match="missing"):
        K.select_views(lists, None, ["a", "b"], strict=True)
    cameras = lists.select("episode", F.posexplode("camera_names").alias("cam_idx", "camera"))
    assert K.parse_view_groups(cameras, "a;b", strict=True).count() == 3 and K.parse_view_groups(cameras, "", strict=True).select("group").distinct().count() == 2
    with pytest.raises(ValueError, match="unknown"):
        K.parse_view_groups(cameras, "a;z", strict=True)
    short = spark.createDataFrame([("demo1", 0)], "episode string, n long")
    for call in (lambda: K.sample_index(short, "n", strict=True), lambda: K.common_length(short, strict=True), lambda: W.strided_windows(short.withColumnRenamed("n", "t"), 3, 1, "t", strict=True)):
        with pytest.raises(ValueError, match="no "):
            call()
    dots = spark.createDataFrame([(0, 0, 0.1)], "e int, i int, opacity double")
    with pytest.raises(ValueError, match="no "):
        GA.filter_gaussians(dots, 0.5, 3, ["e"], "i", strict=True)


def test_stored_episodes_are_replaced(spark, tmp_path):
    path = str(tmp_path / "stored")
    rows = spark.range(200).select(F.concat(F.lit("demo"), (F.col("id") % 40).cast("string")).alias("episode"), F.col("id").alias("v"))
    SRC.store_episodes(rows, path, buckets=8)
    new = spark.createDataFrame([("demo3", -1), ("demo99", -2)], "episode string, v long")
    for _ in range(2):
        SRC.replace_stored(new, path, buckets=8)
    got = sorted((r["episode"], r["v"]) for r in spark.read.parquet(path).select("episode", "v").collect())
    assert got == sorted([(f"demo{i % 40}", i) for i in range(200) if i % 40 != 3] + [("demo3", -1), ("demo99", -2)])


def test_transitions_are_added_behind(spark):
    from episodica.operators import windows as W

    rows = [(i % 2, i, i, i % 5 == 0) for i in range(30)]
    log = spark.createDataFrame(rows, "actor long, ts long, event_id long, done boolean")
    whole = W.assign_ids(log)
    for cut in (1, 7, 16):
        old, new = log.filter(f"event_id < {cut}"), log.filter(f"event_id >= {cut}")
        last = W.assign_ids(old).groupBy("actor").agg(F.max_by(F.struct("transition_id", "episode", "step", "done"), "transition_id").alias("l")).select("actor", "l.*")
        got = SRC.add_transitions(new, last)
        names = ["actor", "event_id", "transition_id", "episode", "step", "state_id"]
        assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, whole.filter(f"event_id >= {cut}").select(names).collect()))
    assert SRC.episode_states(whole).count() == 30 + 6


def test_ordered_ranks(spark):
    from episodica.operators.ranks import ordered_rank

    rows = [(None if i % 7 == 0 else (i * 37) % 50, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, i long").repartition(5)
    for buckets in (1, 4, 256):
        got = {r["i"]: r["rank"] for r in ordered_rank(df, "k", "i", buckets=buckets).collect()}
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        assert got == {i: n for n, (_, i) in enumerate(order)}
    assert ordered_rank(df.limit(0), "k", "i").count() == 0


def test_mixed_infonce_is_the_mean_of_both(spark):
    rows = spark.createDataFrame([(0, i, [1.0, float(i)], [float(i), 1.0], [[0.0, 1.0], [1.0, 1.0]]) for i in range(4)], "batch_id int, state_id int, q array<double>, p array<double>, n array<array<double>>")
    keys = lambda c: rows.select("batch_id", "state_id", F.col(c).alias("vec"))
    full, paired = E.infonce(keys("q"), keys("p"), 0.2).first()["loss"], E.infonce_paired(rows, 0.2, "q", "p", "n", ["batch_id"]).first()["loss"]
    assert E.infonce_mixed(rows, 0.2, "q", "p", "n").first()["loss"] == pytest.approx((full + paired) / 2)


def test_codes_by_bytes_and_ties(spark):
    book = spark.createDataFrame([(3, [0.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 2.0])], "code int, code_vec array<double>")
    rows = spark.createDataFrame([(0, [1.0, 1.0]), (1, [0.1, 0.0]), (2, None), (3, [0.0, 3.0])], "i int, vec array<double>")
    got = {r["i"]: (r["code"], r["error"]) for r in E.assign_codes(rows, book).collect()}
    assert got == {0: (1, 1.0), 1: (3, pytest.approx(0.005)), 2: (None, None), 3: (2, 0.5)}
    with pytest.raises(ValueError, match="bytes"):
        E.assign_codes(rows, book, max_bytes=10)


def test_points_in_each_camera(spark):
    turned = [0.0, -1.0, 0.0, 5.0, 1.0, 0.0, 0.0, 6.0, 0.0, 0.0, 1.0, 7.0, 0.0, 0.0, 0.0, 1.0]
    plain = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    points = spark.createDataFrame([(0, 9, [1.0, 2.0, 3.0]), (1, 9, [1.0, 1.0, 1.0])], "e int, g int, xyz array<double>")
    cameras = spark.createDataFrame([(0, 0, plain), (0, 1, turned)], "e int, cam int, w2c array<double>")
    got = {r["cam"]: r["xyz_cam"] for r in GS.project_cloud(points, cameras, ["e"]).collect()}
    assert got == {0: [1.0, 2.0, 3.0], 1: [3.0, 7.0, 10.0]}


def test_swapped_halves(spark):
    rows = spark.createDataFrame([("e", c, t, [float(10 * c + t)], [float(100 * c + t)]) for c in range(2) for t in range(3)], "episode string, camera int, t int, z_inv array<double>, z_dep array<double>")
    got = {(r["inv_camera"], r["inv_t"], r["dep_camera"], r["dep_t"]): r["fused"] for r in E.swap_matrix(rows).collect()}
    assert got == {(c, t, 1 - c, 1 if t == 0 else 0): [10.0 * c + t, 100.0 * (1 - c) + (1 if t == 0 else 0)] for c in range(2) for t in range(3)}
