"""Queries of cameras and point clouds, with their SQL. Poses and channels are slices of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.functions import linalg as L
from episodica.operators import gaussians as S
from episodica.operators import geometry as G
from episodica.operators import joins as J
from episodica.operators import metrics as M
from episodica.plans import tables as T


def poses(spark: SparkSession, sf: str) -> DataFrame:
    """A camera for each vector: a rotation whose rows come from elements 0..5, translation from 10..12."""
    rows = T.latents(spark, sf).select("vec_id", F.col("state_id").alias("episode"), F.col("view_id").alias("cam_idx"), "label", "vec", G.sixd_to_matrix("vec", transposed=True).alias("R"), F.slice("vec", 11, 3).alias("t"))
    flat = [x for i in range(3) for x in (*[F.col("R")[i * 3 + j] for j in range(3)], F.col("t")[i])]
    k = F.array(F.lit(100.0), F.lit(0.0), F.lit(32.0), F.lit(0.0), F.lit(110.0), F.lit(24.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return rows.withColumn("world_T_cam", F.array(*flat, *map(F.lit, (0.0, 0.0, 0.0, 1.0)))).withColumn("K", k)


_DOT = lambda a, b: " + ".join(f"{a}{i} * {b}{i}" for i in range(3))
POSES = f"""{T.LATENTS}, g0 AS (SELECT vec_id, state_id AS episode, view_id AS cam_idx, label, vec, vec[1] AS a0, vec[2] AS a1, vec[3] AS a2, vec[4] AS b0, vec[5] AS b1, vec[6] AS b2, vec[11] AS t0, vec[12] AS t1, vec[13] AS t2 FROM latents),
g1 AS (SELECT *, a0 / sqrt({_DOT('a', 'a')}) AS x0, a1 / sqrt({_DOT('a', 'a')}) AS x1, a2 / sqrt({_DOT('a', 'a')}) AS x2 FROM g0),
g2 AS (SELECT *, {', '.join(f"b{i} - ({_DOT('x', 'b')}) * x{i} AS c{i}" for i in range(3))} FROM g1),
g3 AS (SELECT *, {', '.join(f"c{i} / sqrt({_DOT('c', 'c')}) AS y{i}" for i in range(3))} FROM g2),
poses AS (SELECT *, x1 * y2 - x2 * y1 AS z0, x2 * y0 - x0 * y2 AS z1, x0 * y1 - x1 * y0 AS z2 FROM g3)"""
#: Rows of the rotation are x, y, z; the inverse's translation is -R^T t.
_BACK = [f"-(x{i} * t0 + y{i} * t1 + z{i} * t2)" for i in range(3)]


def _cells(column: str, n: int, digits: int = 8) -> list:
    return [F.round(F.col(column)[i], digits).alias(f"m{i}") for i in range(n)]


def g1(spark: SparkSession, sf: str) -> DataFrame:
    return G.to_opencv(poses(spark, sf)).select("vec_id", *_cells("w2c", 12), F.round(F.col("c2w")[1], 8).alias("c1"), F.round(F.col("c2w")[3], 8).alias("c3"))


def g4(spark: SparkSession, sf: str) -> DataFrame:
    pairs = J.relative_pose(G.to_opencv(poses(spark, sf)))
    return G.check_dataset_poses(pairs, ["T_ij"], low=0.1, high=0.3).select("episode", "cam_i", "cam_j")


def j4(spark: SparkSession, sf: str) -> DataFrame:
    found = J.relative_pose(G.to_opencv(poses(spark, sf)))
    return found.select("episode", "cam_i", "cam_j", F.round(F.col("T_ij")[0], 8).alias("r00"), F.round(F.col("T_ij")[3], 8).alias("t0"), F.round(F.col("T_ij")[11], 8).alias("t2"))


def g5(spark: SparkSession, sf: str) -> DataFrame:
    k = G.scale_intrinsics(G.scale_intrinsics(F.transform("vec", lambda x: x * 1000), (1280, 720), (320, 180)), (320, 180), (128, 128))
    return T.latents(spark, sf).withColumn("k", k).select("vec_id", *_cells("k", 9))


def g6(spark: SparkSession, sf: str) -> DataFrame:
    s = T.read(spark, sf, "part").select("p_partkey", (F.col("p_size") / 10 + 0.5).alias("r"), (F.col("p_partkey") % 360).cast("double").alias("theta"), (F.col("p_partkey") % 80 - 40).cast("double").alias("phi"), F.array(F.lit(0.0), F.lit(0.6), F.lit(0.0)).alias("look_at"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("up"), F.lit(45.0).alias("fovy"))
    found = G.rig_table(s, 128, 128)
    m = F.col("world_T_cam")
    return found.select("p_partkey", *[(F.round(F.col("position")[i], 8) + 0.0).alias(f"p{i}") for i in range(3)], (F.round(m[0], 8) + 0.0).alias("x0"), (F.round(m[4], 8) + 0.0).alias("x1"), (F.round(m[9], 8) + 0.0).alias("y2"), (F.round(m[10], 8) + 0.0).alias("z2"), F.round(F.col("K")[0], 6).alias("f"), F.col("K")[2].alias("c"))


def g7(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.latents(spark, sf).select("vec_id", F.slice("vec", 1, 3).alias("position"), F.slice("vec", 4, 3).alias("look_at"))
    return G.orbit_params(rows).select("vec_id", *[F.round(c, 6).alias(c) for c in ("distance", "azimuth", "elevation")])


def g8(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.latents(spark, sf).select("vec_id", G.quat_to_matrix(F.slice("vec", 1, 4)).alias("m"), G.sixd_to_matrix("vec").alias("sixd"), F.slice("vec", 1, 4).alias("q"), F.slice("vec", 5, 4).alias("p"))
    found = rows.withColumns({"a": G.matrix_to_axis_angle("m"), "back": G.matrix_to_quat("m"), "prod": G.quat_product("q", "p")})
    sign = F.signum(L.dot("back", "q"))
    return found.select("vec_id", *_cells("m", 9), *[F.round(F.col("sixd")[i], 8).alias(f"d{i}") for i in range(9)], F.round(sign * F.col("back")[2] * L.norm("q"), 6).alias("q2"), F.round(F.col("prod")[1], 8).alias("prod1"), F.round(L.norm("a"), 6).alias("angle"))


def g9(spark: SparkSession, sf: str) -> DataFrame:
    return G.rays(poses(spark, sf).select("vec_id", "K"), 8, 6).select("vec_id", "pixel", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"), "z")


def clouds(spark: SparkSession, sf: str) -> DataFrame:
    """Two Gaussians for each vector, which stands for one pixel's channels."""
    cams = G.to_opencv(poses(spark, sf)).select("vec_id", "episode", "cam_idx", F.slice("vec", 1, 30).alias("ch"), "c2w", F.lit(0.1).alias("x"), F.lit(-0.2).alias("y"), F.lit(1.0).alias("z"))
    return S.backproject(S.split_channels(cams, 2), 0.1, 2.0, ["vec_id"])


#: Channels: 2 depths, 6 offsets, 2 opacities, 6 scales, 8 rotations, 6 colours.
CLOUDS = f"""{POSES}, c0 AS (SELECT *, unnest(range(2)) AS g FROM poses),
c1 AS (SELECT *, vec[1] AS base, CASE WHEN g = 0 THEN vec[1] ELSE vec[1] + exp(least(greatest(vec[2], -10), 10)) END AS stack, vec[9 + g] AS op FROM c0),
clouds AS (SELECT *, 1.9::DOUBLE / (1 + exp(-stack)) + 0.1::DOUBLE AS z_depth, 1 / (1 + exp(-op)) AS opacity FROM c1),
placed AS (SELECT *, 0.1::DOUBLE * z_depth + vec[3 + 3 * g] AS cx, -0.2::DOUBLE * z_depth + vec[4 + 3 * g] AS cy, z_depth + vec[5 + 3 * g] AS cz FROM clouds)"""


def g10(spark: SparkSession, sf: str) -> DataFrame:
    cams = T.latents(spark, sf).select("vec_id", F.slice("vec", 1, 48).alias("ch"))
    found = S.split_channels(cams, 2, 1)
    return found.select("vec_id", "g", "depth", F.col("offset")[2].alias("o2"), "opacity", F.col("scale")[0].alias("s0"), F.col("rotation")[3].alias("r3"), F.col("dc")[1].alias("d1"), F.col("rest")[8].alias("x8"))


def g11(spark: SparkSession, sf: str) -> DataFrame:
    return clouds(spark, sf).select("vec_id", "g", F.round("z_depth", 8).alias("depth"), *[F.round(F.col("xyz_cam")[i], 8).alias(f"x{i}") for i in range(3)])


def g12(spark: SparkSession, sf: str) -> DataFrame:
    return S.activate(clouds(spark, sf)).select("vec_id", "g", F.round("opacity", 8).alias("opacity"), F.round(F.col("scale")[1], 8).alias("s1"), F.round(F.col("rotation")[0], 8).alias("r0"))


def g13(spark: SparkSession, sf: str) -> DataFrame:
    found = S.to_world(S.activate(clouds(spark, sf)))
    return found.select("vec_id", "g", *[F.round(F.col("xyz")[i], 8).alias(f"x{i}") for i in range(3)], F.round(L.norm("rotation"), 6).alias("length"))


def g14(spark: SparkSession, sf: str) -> DataFrame:
    return S.filter_gaussians(S.activate(clouds(spark, sf)).withColumn("idx", F.col("vec_id") * 2 + F.col("g")), 0.48, 4, ["episode"], "idx").select("episode", "idx")


def g15(spark: SparkSession, sf: str) -> DataFrame:
    found = S.vertex_properties(S.to_world(S.activate(clouds(spark, sf))), "logit", "rgb").select("vec_id", "g", "opacity", "scale_1", "f_dc_2", "nx")
    return found.select("vec_id", "g", *[(F.round(F.col(c).cast("double"), 3) + 0.0).alias(c) for c in ("opacity", "scale_1", "f_dc_2")], F.col("nx").cast("double").alias("nx"))


def g16(spark: SparkSession, sf: str) -> DataFrame:
    world = S.to_world(S.activate(clouds(spark, sf))).select("episode", "vec_id", "xyz", F.lit(0).cast("long").alias("source"))
    cams = G.to_opencv(poses(spark, sf)).select("episode", "cam_idx", "w2c", "K")
    found = S.frustum_stats(world, cams, ["episode"], 64, 48)
    return found.select("part", F.round("penalty", 5).alias("penalty"), F.round("outside", 6).alias("outside"), F.round("invalid", 6).alias("invalid"), F.round("nonfinite", 6).alias("nonfinite"), "n")


def a10(spark: SparkSession, sf: str) -> DataFrame:
    p = poses(spark, sf)
    a = p.select("episode", "cam_idx", "label", F.col("R").alias("ra"), F.col("t").alias("ta"))
    b = p.select("episode", (F.col("cam_idx") - 1).alias("cam_idx"), F.col("R").alias("rb"), F.col("t").alias("tb"))
    found = M.pose_error(a.join(b, ["episode", "cam_idx"]), ["cam_idx"], "ra", "rb", "ta", "tb")
    return found.select("cam_idx", F.round("rotation_deg", 5).alias("rotation_deg"), F.round("translation", 8).alias("translation"))


def a11(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.latents(spark, sf).select("label", F.slice("vec", 1, 9).alias("a"), F.slice("vec", 11, 9).alias("b"))
    found = M.intrinsics_error(rows, ["label"], "a", "b")
    return found.select("label", *[F.round(c, 8).alias(c) for c in ("fx", "fy", "cx", "cy")])


def j10(spark: SparkSession, sf: str) -> DataFrame:
    world = S.to_world(S.activate(clouds(spark, sf))).select("episode", "vec_id", "g", "xyz")
    seen = S.project_cloud(world, G.to_opencv(poses(spark, sf)).select("episode", "cam_idx", "w2c"), ["episode"])
    return seen.select("vec_id", "g", "cam_idx", F.round(F.col("xyz_cam")[2], 7).alias("z"))


def g2(spark: SparkSession, sf: str) -> DataFrame:
    """Proper rotations come back unchanged; poses with an element that isn't finite, and null ones, go."""
    bad = F.when(F.col("vec_id") % 7 == 0, F.lit(None)).when(F.col("vec_id") % 7 == 1, F.transform("world_T_cam", lambda x: F.when(x == 1.0, float("inf")).otherwise(x))).otherwise(F.col("world_T_cam"))
    found = G.clean_poses(poses(spark, sf).select("vec_id", bad.alias("pose")))
    return found.select("vec_id", *[F.round(F.col("pose")[i], 6).alias(f"m{i}") for i in range(12)])


def g3(spark: SparkSession, sf: str) -> DataFrame:
    """The first two cameras of a state as a stereo pair; faults by the state's number."""
    p = poses(spark, sf).filter("cam_idx < 2")
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("world_T_cam", i * 4 + 1, 4))
    cam = F.struct(rows.alias("pose"), F.when((F.col("episode") % 11 == 3) & (F.col("cam_idx") == 1), 0.0).otherwise(700.0).alias("focal"), F.array(F.lit(320.0), F.when(F.col("episode") % 11 == 4, float("nan")).otherwise(180.0)).alias("principal_point"))
    sides = p.groupBy("episode").agg(F.max(F.when(F.col("cam_idx") == 0, cam)).alias("left_cam"), F.max(F.when((F.col("cam_idx") == 1) & (F.col("episode") % 11 != 2), cam)).alias("right_cam"))
    ready = sides.withColumns({"relative_path": F.col("episode").cast("string"), "quality_metric": (F.col("episode") % 11).cast("int")})
    found = G.clean_calibrations(ready, 1)
    return found.select("episode", "reason", F.col("K_left")[2].alias("cx"), F.round(F.col("T_left_to_right")[3], 6).alias("t0"))


QUERIES = {
    "g2_clean_poses": g2, "g3_clean_calibrations": g3, "g1_to_opencv": g1, "g4_check_poses": g4,
    "g5_scale_intrinsics": g5, "g6_rig_table": g6, "g7_orbit_params": g7, "g8_convert_rotation": g8, "g9_rays": g9,
    "g10_split_channels": g10, "g11_backproject": g11, "g12_activate": g12,
    "g13_to_world": g13, "g14_filter_gaussians": g14, "g15_vertex_properties": g15, "g16_frustum_stats": g16,
    "a10_pose_error": a10, "a11_intrinsics_error": a11, "j4_relative_pose": j4, "j10_project_cloud": j10,
}

# In the flipped frame: rows of w2c are x^T, -y^T, -z^T columns of the stored rotation.
_W2C = [(f"{s}x{i}", f"{s}y{i}", f"{s}z{i}", f"{s}({_BACK[i]})") for i, s in ((0, ""), (1, "-"), (2, "-"))]
_CAMS = f"""cams AS (SELECT episode, cam_idx, {', '.join(f'{cell} AS w{i}{j}' for i, row in enumerate(_W2C) for j, cell in enumerate(row))}, t0,
t1, t2, {', '.join(f'{s}{n}{i} AS c{k}{i}' for k, n in enumerate('xyz') for i, s in ((0, ''), (1, '-'), (2, '-')))}
FROM poses)"""
# c2w: rows x, y, z with columns 1 and 2 turned; translation t.
_REL = f"""rel AS (SELECT a.episode, a.cam_idx AS cam_i, b.cam_idx AS cam_j, {', '.join(f'b.w{i}0 * a.c0{j} + b.w{i}1 * a.c1{j} + b.w{i}2 * a.c2{j} AS r{i}{j}' for i in range(3) for j in range(3))},
{', '.join(f'b.w{i}0 * a.t0 + b.w{i}1 * a.t1 + b.w{i}2 * a.t2 + b.w{i}3 AS d{i}' for i in range(3))}
FROM cams a JOIN cams b ON a.episode = b.episode AND a.cam_idx <> b.cam_idx)"""
_WORLD = f"""{CLOUDS}, {_CAMS},
world AS (SELECT p.episode, p.vec_id, p.g, {', '.join(f'c.c{i}0 * p.cx + c.c{i}1 * p.cy + c.c{i}2 * p.cz + c.t{i} AS wx{i}' for i in range(3))}
FROM placed p JOIN cams c ON p.episode = c.episode AND p.cam_idx = c.cam_idx)"""
_QN = "sqrt(vec[1] * vec[1] + vec[2] * vec[2] + vec[3] * vec[3] + vec[4] * vec[4])"
_SEEN = f"""{_WORLD},
seen AS (SELECT c.cam_idx, w.vec_id, w.g, {', '.join(f'c.w{i}0 * wx0 + c.w{i}1 * wx1 + c.w{i}2 * wx2 + c.w{i}3 AS s{i}' for i in range(3))}
FROM world w JOIN cams c ON w.episode = c.episode)"""

_STORED = [c for i in range(3) for c in (*[f"{'xyz'[i]}{j}" for j in range(3)], f"t{i}")]
# From the left camera to the right one, with stored poses: the rotation's rows are x, y, z.
_STEREO = " + ".join(f"r.{'xyz'[i]}0 * (l.t{i} - r.t{i})" for i in range(3))
_LENGTH = "sqrt((l.t0 - r.t0) ** 2 + (l.t1 - r.t1) ** 2 + (l.t2 - r.t2) ** 2)"
ORACLE_SQL = {
    "g2_clean_poses": f"""WITH {POSES} SELECT vec_id, {', '.join(f'round({c}, 6) AS m{i}' for i, c in enumerate(_STORED))}
FROM poses WHERE vec_id % 7 > 1""",
    "g3_clean_calibrations": f"""WITH {POSES}, s AS (SELECT l.episode, CASE l.episode % 11 WHEN 2 THEN 'missing_camera' WHEN 3 THEN 'bad_focal' WHEN 4 THEN 'bad_centre' END AS early, {_LENGTH} AS length, {_STEREO} AS t0 FROM poses l JOIN poses r ON l.episode = r.episode AND l.cam_idx = 0 AND r.cam_idx = 1),
v AS (SELECT episode, t0, coalesce(early, CASE WHEN length < 1e-4::DOUBLE OR length > 5 THEN 'bad_baseline' WHEN episode % 11 < 1 THEN 'low_quality' END) AS reason FROM s) SELECT episode, reason, CASE WHEN reason IS NULL THEN 320.0::DOUBLE END AS cx, CASE WHEN reason IS NULL THEN round(t0, 6) END AS t0 FROM v""",
    "g1_to_opencv": f"""WITH {POSES} SELECT vec_id, {', '.join(f'round({cell}, 8) AS m{i * 4 + j}' for i, row in enumerate(_W2C) for j, cell in enumerate(row))},
round(-x1, 8) AS c1, round(t0, 8) AS c3 FROM poses""",
    "g4_check_poses": f"""WITH {POSES}, {_CAMS}, {_REL} SELECT episode, cam_i, cam_j
FROM rel WHERE sqrt(d0 * d0 + d1 * d1 + d2 * d2) BETWEEN 0.1::DOUBLE AND 0.3::DOUBLE""",
    "j4_relative_pose": f"""WITH {POSES}, {_CAMS}, {_REL} SELECT episode, cam_i, cam_j, round(r00, 8) AS r00, round(d0, 8) AS t0, round(d2, 8) AS t2
FROM rel""",
    "g5_scale_intrinsics": f"""WITH {T.LATENTS} SELECT vec_id, {', '.join(f'round(vec[{i + 1}] * 1000 * {(128 / 1280) if i < 3 else (128 / 720) if i < 6 else 1.0}::DOUBLE, 8) AS m{i}' for i in range(9))}
FROM latents""",
    "g6_rig_table": """WITH s AS (SELECT p_partkey, p_size / 10.0::DOUBLE + 0.5::DOUBLE AS r, radians(p_partkey % 360) AS th, radians(p_partkey % 80 - 40) AS ph
FROM part) SELECT p_partkey, round(r * cos(ph) * cos(th), 8) + 0.0::DOUBLE AS p0, round(0.6::DOUBLE + r * cos(ph) * sin(th), 8) + 0.0::DOUBLE AS p1,
round(r * sin(ph), 8) + 0.0::DOUBLE AS p2, round(-sin(th), 8) + 0.0::DOUBLE AS x0, round(cos(th), 8) + 0.0::DOUBLE AS x1, round(cos(ph),
8) + 0.0::DOUBLE AS y2, round(sin(ph), 8) + 0.0::DOUBLE AS z2, round(64 / tan(radians(22.5::DOUBLE)), 6) AS f, 63.5::DOUBLE AS c
FROM s""",
    "g7_orbit_params": f"""WITH {T.LATENTS},
d AS (SELECT vec_id, vec[1] - vec[4] AS x, vec[2] - vec[5] AS y, vec[3] - vec[6] AS z
FROM latents) SELECT vec_id, round(sqrt(x * x + y * y + z * z), 6) AS distance, round(degrees(atan2(y, x)), 6) AS azimuth, round(degrees(atan2(z,
sqrt(x * x + y * y))), 6) AS elevation FROM d""",
    "g8_convert_rotation": f"WITH {POSES}, q AS (SELECT vec_id, vec, vec[1] / {_QN} AS w, vec[2] / {_QN} AS x, vec[3] / {_QN} AS y, vec[4] / {_QN} AS z FROM latents) SELECT q.vec_id, round(1 - 2 * (q.y * q.y + q.z * q.z), 8) AS m0, round(2 * (x * y - w * z), 8) AS m1, round(2 * (x * z + w * y), 8) AS m2, round(2 * (x * y + w * z), 8) AS m3, round(1 - 2 * (x * x + z * z), 8) AS m4, round(2 * (y * z - w * x), 8) AS m5, round(2 * (x * z - w * y), 8) AS m6, round(2 * (y * z + w * x), 8) AS m7, round(1 - 2 * (x * x + y * y), 8) AS m8, round(vec[3], 6) AS q2, round(vec[1] * vec[6] + vec[2] * vec[5] + vec[3] * vec[8] - vec[4] * vec[7], 8) AS prod1, round(2 * acos(least(abs(w), 1)), 6) AS angle, {', '.join(f'round(p.{"xyz"[i % 3]}{i // 3}, 8) AS d{i}' for i in range(9))} FROM q JOIN (SELECT vec_id, x0, x1, x2, y0, y1, y2, z0, z1, z2 FROM poses) p USING (vec_id)",
    "g9_rays": f"""WITH {T.LATENTS},
p AS (SELECT vec_id, unnest(range(48))::INT AS pixel FROM latents) SELECT vec_id, pixel, round((pixel % 8 + 0.5::DOUBLE - 32) / 100,
8) AS x, round((pixel // 8 + 0.5::DOUBLE - 24) / 110, 8) AS y, 1.0::DOUBLE AS z
FROM p""",
    "g10_split_channels": f"""WITH {T.LATENTS},
p AS (SELECT vec_id, vec, unnest(range(2))::INT AS g FROM latents) SELECT vec_id, g, vec[1 + g] AS depth, vec[5 + 3 * g] AS o2, vec[9 + g] AS opacity,
vec[11 + 3 * g] AS s0, vec[20 + 4 * g] AS r3, vec[26 + 3 * g] AS d1, vec[39 + 9 * g] AS x8
FROM p""",
    "g11_backproject": f"""WITH {CLOUDS} SELECT vec_id, g::INT AS g, round(z_depth, 8) AS depth, round(cx, 8) AS x0, round(cy, 8) AS x1, round(cz, 8) AS x2
FROM placed""",
    "g12_activate": f"""WITH {CLOUDS} SELECT vec_id, g::INT AS g, round(opacity, 8) AS opacity, round(exp(vec[12 + 3 * g]), 8) AS s1, round(vec[17 + 4 * g] / sqrt(vec[17 + 4 * g] * vec[17 + 4 * g] + vec[18 + 4 * g] * vec[18 + 4 * g] + vec[19 + 4 * g] * vec[19 + 4 * g] + vec[20 + 4 * g] * vec[20 + 4 * g]),
8) AS r0 FROM clouds""",
    "g13_to_world": f"""WITH {_WORLD} SELECT vec_id, g::INT AS g, round(wx0, 8) AS x0, round(wx1, 8) AS x1, round(wx2, 8) AS x2, 1.0::DOUBLE AS length
FROM world""",
    "g14_filter_gaussians": f"""WITH {CLOUDS},
i AS (SELECT episode, vec_id * 2 + g AS idx, opacity FROM clouds WHERE opacity >= 0.48::DOUBLE) SELECT episode, idx
FROM i QUALIFY row_number() OVER (PARTITION BY episode ORDER BY opacity DESC, idx) <= 4""",
    "g15_vertex_properties": f"""WITH {CLOUDS} SELECT vec_id, g::INT AS g, round(op::FLOAT::DOUBLE, 3) + 0.0::DOUBLE AS opacity, round(vec[12 + 3 * g]::FLOAT::DOUBLE,
3) + 0.0::DOUBLE AS scale_1, round(least(greatest(vec[27 + 3 * g] * {S.SH0}::DOUBLE + 0.5::DOUBLE, 0), 1)::FLOAT::DOUBLE, 3) + 0.0::DOUBLE AS f_dc_2,
0.0::DOUBLE AS nx FROM clouds""",
    "g16_frustum_stats": f"""WITH {_SEEN},
uv AS (SELECT CASE WHEN cam_idx = 0 THEN 'source' ELSE 'target' END AS part, s2, (100 * s0 / greatest(s2, 1e-6::DOUBLE) + 32) / 64 AS u,
(110 * s1 / greatest(s2, 1e-6::DOUBLE) + 24) / 48 AS v FROM seen),
gap AS (SELECT part, s2, least(greatest(-u, 0) + greatest(u - 1, 0) + greatest(-v, 0) + greatest(v - 1, 0), 100) AS gap
FROM uv) SELECT coalesce(part, 'all') AS part, round(avg(gap), 5) AS penalty, round(avg(CASE WHEN gap > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),
6) AS outside, round(avg(CASE WHEN s2 <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS invalid, 0.0::DOUBLE AS nonfinite, count(*) AS n
FROM gap GROUP BY ROLLUP (part)""",
    "a10_pose_error": f"""WITH {POSES},
e AS (SELECT a.cam_idx, degrees(acos(greatest(least((a.x0 * b.x0 + a.x1 * b.x1 + a.x2 * b.x2 + a.y0 * b.y0 + a.y1 * b.y1 + a.y2 * b.y2 + a.z0 * b.z0 + a.z1 * b.z1 + a.z2 * b.z2 - 1) / 2,
1), -1))) AS r, sqrt((a.t0 - b.t0) * (a.t0 - b.t0) + (a.t1 - b.t1) * (a.t1 - b.t1) + (a.t2 - b.t2) * (a.t2 - b.t2)) AS t
FROM poses a JOIN poses b ON a.episode = b.episode AND b.cam_idx = a.cam_idx + 1) SELECT cam_idx, round(avg(r), 5) AS rotation_deg,
round(avg(t), 8) AS translation FROM e GROUP BY 1""",
    "a11_intrinsics_error": f"""WITH {T.LATENTS} SELECT label, round(avg(abs(vec[1] - vec[11])), 8) AS fx, round(avg(abs(vec[5] - vec[15])), 8) AS fy, round(avg(abs(vec[3] - vec[13])),
8) AS cx, round(avg(abs(vec[6] - vec[16])), 8) AS cy
FROM latents GROUP BY 1""",
    "j10_project_cloud": f"WITH {_SEEN} SELECT vec_id, g::INT AS g, cam_idx, round(s2, 7) AS z FROM seen",
}
