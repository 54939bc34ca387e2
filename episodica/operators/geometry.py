"""Camera tables: poses, intrinsics, rigs, rotations and rays. Matrices are row-major arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions import linalg as L


def to_opencv(cameras: DataFrame, pose: str = "world_T_cam") -> DataFrame:
    """``cameras`` with w2c and c2w: stored poses are camera to world with y up and z back; here y is down and z forward."""
    inverse = L.rigid_inverse(pose)
    cut = cameras.withColumn("__inv", inverse)
    sign = [1.0] * 4 + [-1.0] * 8 + [1.0] * 4
    w2c = F.array(*[F.col("__inv")[i] * sign[i] for i in range(16)])
    return cut.withColumn("w2c", w2c).withColumn("c2w", L.rigid_inverse("w2c")).drop("__inv")


def project_rotations(poses: DataFrame, pose: str = "pose") -> DataFrame:
    """``poses`` with each 4 x 4 pose's rotation replaced by the nearest proper one (by singular values, in vectorised batches)."""
    import numpy as np
    import pyarrow as pa

    at = poses.columns.index(pose)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = np.array(batch.column(at).to_pylist(), np.float64).reshape(-1, 4, 4)
                u, _, v = np.linalg.svd(m[:, :3, :3])
                sign = np.ones((len(m), 3))
                sign[:, 2] = np.sign(np.linalg.det(u @ v))
                m[:, :3, :3] = (u * sign[:, None, :]) @ v
                flat = pa.array(m.reshape(len(m), 16).tolist(), pa.list_(pa.float64()))
                batch = pa.RecordBatch.from_arrays([flat if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)
            yield batch

    ready = poses.withColumn(pose, F.col(pose).cast("array<double>"))
    return ready.mapInArrow(run, ready.schema)


def pose_reason(pose: str | Column) -> Column:
    """Why a pose can't be used: its shape, a number that isn't finite, a rotation near zero; null if it can."""

    def reason(p: Column) -> Column:
        rotation = [p[i * 4 + j] for i in range(3) for j in range(3)]
        length = F.sqrt(sum((x * x for x in rotation[1:]), rotation[0] * rotation[0]))
        return F.when(p.isNull() | (F.size(p) != 16), "bad_shape").when(F.exists(p, lambda x: ~L.finite(x)), "not_finite").when(length < 0.1, "zero_rotation")

    # as a function of one value, so that a long expression for the pose is there once
    return F.transform(F.array(F.col(pose) if isinstance(pose, str) else pose), reason)[0]


def clean_poses(poses: DataFrame, pose: str = "pose") -> DataFrame:
    """The usable poses, with rotations made proper."""
    return project_rotations(poses.filter(pose_reason(pose).isNull()), pose)


def intrinsics(focal: Column, centre: Column) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(focal, zero, centre[0], zero, focal, centre[1], zero, zero, one)


def clean_calibrations(rows: DataFrame, min_quality: int | None = None) -> DataFrame:
    """``rows`` (left_cam and right_cam with pose, focal, principal_point; relative_path, quality_metric) with ``reason``.

    A null reason means K_left, K_right and T_left_to_right are there. Reasons, the first that holds: missing_camera,
    bad_shape, not_finite, zero_rotation, missing_intrinsics, bad_focal, bad_centre, bad_baseline, low_quality. Rejected rows stay, for a ledger.
    """
    flat = rows
    for side in ("left", "right"):
        flat = flat.withColumn(f"__{side}", F.flatten(F.col(f"{side}_cam.pose")).cast("array<double>"))
    reason = F.when(F.col("left_cam").isNull() | F.col("right_cam").isNull(), "missing_camera")
    reason = F.coalesce(reason, pose_reason("__left"), pose_reason("__right"))
    for test, name in (
        (lambda c: c["focal"].isNull() | c["principal_point"].isNull(), "missing_intrinsics"),
        (lambda c: ~L.finite(c["focal"]) | (c["focal"] <= 0), "bad_focal"),
        (lambda c: F.exists(c["principal_point"], lambda x: ~L.finite(x)), "bad_centre"),
    ):
        reason = F.coalesce(reason, F.when(test(F.col("left_cam")) | test(F.col("right_cam")), name))
    flat = flat.withColumn("__first", reason)
    good, bad = flat.filter("__first IS NULL"), flat.filter("__first IS NOT NULL")
    good = project_rotations(project_rotations(good, "__left"), "__right")
    good = good.withColumn("T_left_to_right", L.matmul(L.rigid_inverse("__right"), F.col("__left"), 4))
    length = F.sqrt(sum((F.col("T_left_to_right")[i] ** 2 for i in (7, 11)), F.col("T_left_to_right")[3] ** 2))
    late = F.when(~length.between(1e-4, 5.0), "bad_baseline")
    if min_quality is not None:
        late = F.coalesce(late, F.when(F.coalesce("quality_metric", F.lit(0)) < min_quality, "low_quality"))
    good = good.withColumn("__first", late)
    matrices = "array<double>"
    bad = bad.withColumn("T_left_to_right", F.lit(None).cast(matrices))
    both = good.unionByName(bad)
    ok = F.col("__first").isNull()
    return both.select(
        *rows.columns,
        F.col("__first").alias("reason"),
        *[F.when(ok, intrinsics(F.col(f"{s}_cam.focal").cast("double"), F.col(f"{s}_cam.principal_point").cast(matrices))).alias(f"K_{s}") for s in ("left", "right")],
        F.when(ok, F.col("T_left_to_right")).alias("T_left_to_right"),
    )


def check_dataset_poses(pairs: DataFrame, matrices: Sequence[str], relative: str = "T_ij", low: float = 1e-4, high: float = 10.0) -> DataFrame:
    """``pairs`` whose matrices are finite and whose baseline lies within [low, high]."""
    t = F.col(relative)
    length = F.sqrt(t[3] * t[3] + t[7] * t[7] + t[11] * t[11])
    fine = length.between(low, high)
    for m in matrices:
        fine = fine & F.forall(m, L.finite)
    return pairs.filter(fine)


def scale_intrinsics(k: str | Column, size: tuple[int, int], to: tuple[int, int]) -> Column:
    """Row-major 3 x 3 intrinsics for an image of another (width, height)."""
    m = F.col(k) if isinstance(k, str) else k
    x, y = to[0] / size[0], to[1] / size[1]
    return F.array(*[m[i] * (x if i < 3 else y if i < 6 else 1.0) for i in range(9)])


def _cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)]


def _normal(a: Sequence[Column]) -> list[Column]:
    length = F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])
    return [x / length for x in a]


def rig_table(rig: DataFrame, width: int, height: int) -> DataFrame:
    """``rig`` (r, theta, phi in degrees; look_at, up arrays; fovy) with position, world_T_cam (looking along -z) and K.

    theta turns around the vertical axis, phi lifts. Where the view is along ``up``, another axis stands in for it.
    """
    theta, phi = F.radians("theta"), F.radians("phi")
    direction = [F.cos(phi) * F.cos(theta), F.cos(phi) * F.sin(theta), F.sin(phi)]
    placed = rig.withColumn("position", F.array(*[F.col("look_at")[i] + F.col("r") * direction[i] for i in range(3)]))
    back = _normal([F.col("position")[i] - F.col("look_at")[i] for i in range(3)])
    placed = placed.withColumn("__z", F.array(*back))
    z, up = [F.col("__z")[i] for i in range(3)], [F.col("up")[i] for i in range(3)]
    along = F.abs(z[0] * up[0] + z[1] * up[1] + z[2] * up[2]) / F.sqrt(up[0] ** 2 + up[1] ** 2 + up[2] ** 2) > 1 - 1e-6
    other = F.when(F.abs(z[0]) < 0.9, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    placed = placed.withColumn("__up", F.when(along, other).otherwise(F.col("up")))
    placed = placed.withColumn("__x", F.array(*_normal(_cross([F.col("__up")[i] for i in range(3)], z))))
    x = [F.col("__x")[i] for i in range(3)]
    y = _cross(z, x)
    rows = [v for i in range(3) for v in (x[i], y[i], z[i], F.col("position")[i])]
    focal = height / 2 / F.tan(F.radians("fovy") / 2)
    return placed.withColumn("world_T_cam", F.array(*rows, *map(F.lit, (0.0, 0.0, 0.0, 1.0)))).withColumn("K", intrinsics(focal, F.array(F.lit((width - 1) / 2), F.lit((height - 1) / 2)))).drop("__z", "__up", "__x")


def orbit_params(df: DataFrame, position: str = "position", look_at: str = "look_at") -> DataFrame:
    """``df`` with distance, azimuth and elevation (degrees) of the position around the point looked at."""
    d = [F.col(position)[i] - F.col(look_at)[i] for i in range(3)]
    flat = F.sqrt(d[0] * d[0] + d[1] * d[1])
    return df.withColumns({"distance": F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), "azimuth": F.degrees(F.atan2(d[1], d[0])), "elevation": F.degrees(F.atan2(d[2], flat))})


def quat_to_matrix(q: str | Column) -> Column:
    """wxyz to a row-major rotation; the quaternion is normalised first."""
    c = F.col(q) if isinstance(q, str) else q
    n = F.sqrt(c[0] * c[0] + c[1] * c[1] + c[2] * c[2] + c[3] * c[3])
    w, x, y, z = (c[i] / n for i in range(4))
    return F.array(1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y))


def matrix_to_quat(m: str | Column) -> Column:
    """wxyz of a rotation, from its largest component (the first of equals)."""
    r = [(F.col(m) if isinstance(m, str) else m)[i] for i in range(9)]
    squares = F.array(1 + r[0] + r[4] + r[8], 1 + r[0] - r[4] - r[8], 1 - r[0] + r[4] - r[8], 1 - r[0] - r[4] + r[8])
    best = F.array_position(squares, F.array_max(squares))
    size = F.sqrt(F.greatest(F.array_max(squares), F.lit(1e-12)))
    a, b, c = r[7] - r[5], r[2] - r[6], r[3] - r[1]
    d, e, f = r[1] + r[3], r[2] + r[6], r[5] + r[7]
    rows = [(size * size, a, b, c), (a, size * size, d, e), (b, d, size * size, f), (c, e, f, size * size)]
    found = F.array(*[x / (2 * size) for x in rows[3]])
    for i in (2, 1, 0):
        found = F.when(best == i + 1, F.array(*[x / (2 * size) for x in rows[i]])).otherwise(found)
    return found


def sixd_to_matrix(v: str | Column, eps: float = 1e-8, added: bool = False, transposed: bool = False) -> Column:
    """Two columns of a rotation, made orthonormal (Gram-Schmidt), and their cross product, as the columns of a row-major matrix.

    A length is ``eps`` at least; or, if ``added``, ``eps`` is added to it, and the third column is divided by its own length, too.
    ``transposed`` gives the inverse rotation, whose rows they are.
    """
    length = lambda u: F.sqrt(u[0] ** 2 + u[1] ** 2 + u[2] ** 2)
    divisor = lambda u: length(u) + eps if added else F.greatest(length(u), F.lit(eps))
    c = F.col(v) if isinstance(v, str) else v
    a, b = [c[i] for i in range(3)], [c[i] for i in range(3, 6)]
    x = [u / divisor(a) for u in a]
    along = x[0] * b[0] + x[1] * b[1] + x[2] * b[2]
    y = [b[i] - along * x[i] for i in range(3)]
    y = [u / divisor(y) for u in y]
    z = _cross(x, y)
    z = [u / divisor(z) for u in z] if added else z
    return F.array(*x, *y, *z) if transposed else F.array(*[u[i] for i in range(3) for u in (x, y, z)])


def matrix_to_axis_angle(m: str | Column) -> Column:
    """Axis times angle; zero below 1e-8 radians."""
    r = F.col(m) if isinstance(m, str) else m
    angle = F.acos(F.greatest(F.least((r[0] + r[4] + r[8] - 1) / 2, F.lit(1.0)), F.lit(-1.0)))
    factor = F.when(angle < 1e-8, 0.0).otherwise(angle / F.nullif(2 * F.sin(angle), F.lit(0.0)))
    return F.array((r[7] - r[5]) * factor, (r[2] - r[6]) * factor, (r[3] - r[1]) * factor)


def quat_product(a: str | Column, b: str | Column) -> Column:
    p, q = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.array(
        p[0] * q[0] - p[1] * q[1] - p[2] * q[2] - p[3] * q[3], p[0] * q[1] + p[1] * q[0] + p[2] * q[3] - p[3] * q[2], p[0] * q[2] - p[1] * q[3] + p[2] * q[0] + p[3] * q[1], p[0] * q[3] + p[1] * q[2] - p[2] * q[1] + p[3] * q[0]
    )


def xyzw_to_wxyz(q: str | Column) -> Column:
    c = F.col(q) if isinstance(q, str) else q
    return F.array(c[3], c[0], c[1], c[2])


def rays(cameras: DataFrame, width: int, height: int, k: str = "K", flip: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """``cameras`` with a row for each pixel: u, v and the direction x, y, z in the camera's frame."""
    pixels = cameras.withColumn("pixel", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))))
    u, v = F.col("pixel") % width, F.floor(F.col("pixel") / width)
    m = F.col(k)
    return pixels.withColumns({"x": ((u + 0.5 - m[2]) / m[0]) * flip[0], "y": ((v + 0.5 - m[5]) / m[4]) * flip[1], "z": F.lit(flip[2])})


