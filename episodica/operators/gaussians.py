"""Point clouds of 3D Gaussians as tables: from decoder channels to exported vertices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.functions import linalg as L
from episodica.functions.checks import not_empty
from episodica.operators import geometry as G

#: The factor of the first spherical harmonic.
SH0 = 0.28209479177387814


def split_channels(pixels: DataFrame, k: int, sh_degree: int = 0, channels: str = "ch") -> DataFrame:
    """``pixels`` with a row for each of a pixel's k Gaussians (g): depth, offset, opacity, scale, rotation, dc, rest."""
    rest = 3 * ((sh_degree + 1) ** 2 - 1)
    sizes = (("depth", 1), ("offset", 3), ("opacity", 1), ("scale", 3), ("rotation", 4), ("dc", 3), ("rest", rest))
    rows = pixels.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    found, begin = {}, 0
    for name, n in sizes:
        part = F.slice(channels, F.col("g") * n + (begin + 1), n) if n else F.array().cast("array<double>")
        found[name] = part[0] if n == 1 else part
        begin += k * n
    return rows.withColumns(found).drop(channels)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _clamp(x: Column, low: float, high: float) -> Column:
    """Within [low, high]; not-a-number stays."""
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def backproject(
    gaussians: DataFrame, znear: float, zfar: float, by: Sequence[str], ray: Sequence[str] = ("x", "y", "z"), depth_scale: float = 1.0, depth_bias: float = 0.0, xyz_scale: float = 1.0, xyz_bias: float = 0.0
) -> DataFrame:
    """``gaussians`` with z (ascending along a pixel's ray by construction) and xyz_cam = ray z + offset within [-3, 3].

    Logits are scaled and moved first. The first one is the base; each further one adds exp of itself (within [-10, 10]). Offsets are
    scaled and moved as well; one that isn't finite becomes 0, so that a broken pixel stays on its ray.
    """
    logit = F.col("depth") * depth_scale + depth_bias
    step = F.when(F.col("g") == 0, logit).otherwise(F.exp(_clamp(logit, -10, 10)))
    stack = F.sum(step).over(Window.partitionBy(*by).orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = gaussians.withColumn("z_depth", _sigmoid(stack) * (zfar - znear) + znear)
    moved = [F.col("offset")[i] * xyz_scale + xyz_bias for i in range(3)]
    offset = [_clamp(F.when(L.finite(x), x).otherwise(0.0), -3, 3) for x in moved]
    return found.withColumn("xyz_cam", F.array(*[F.col(c) * F.col("z_depth") + offset[i] for i, c in enumerate(ray)]))


def _real(x: Column, instead: float) -> Column:
    return F.when(F.isnan(x), F.lit(instead)).otherwise(x)


def activate(gaussians: DataFrame) -> DataFrame:
    """Opacity by the sigmoid (within +-20), scales by exp (within [-10, 4]), unit rotations; not-a-number becomes 0."""
    length = F.greatest(L.norm("rotation"), F.lit(1e-8))
    return gaussians.withColumns({
        "opacity": _sigmoid(_clamp(_real(F.col("opacity"), 0.0), -20, 20)),
        "scale": F.transform("scale", lambda x: F.exp(_clamp(_real(x, 0.0), -10, 4))),
        "rotation": F.transform("rotation", lambda x: _real(x / length, 0.0)),
    })


def to_world(gaussians: DataFrame, c2w: str = "c2w", xyz: str = "xyz_cam", rotation: str = "rotation") -> DataFrame:
    """``gaussians`` with xyz and rotation in the world's frame, by each row's camera."""
    m = F.col(c2w)
    r = F.array(*[m[i * 4 + j] for i in range(3) for j in range(3)])
    moved = gaussians.withColumn("__r", r)
    place = F.array(*[sum((F.col("__r")[i * 3 + j] * F.col(xyz)[j] for j in (1, 2)), F.col("__r")[i * 3] * F.col(xyz)[0]) + m[i * 4 + 3] for i in range(3)])
    moved = moved.withColumn("__q", G.matrix_to_quat("__r")).withColumn("xyz", place)
    return moved.withColumn(rotation, G.quat_product("__q", rotation)).drop("__r", "__q")


def rotate_sh1(coefficients: str, rotation: str) -> Column:
    """Degree-1 coefficients (y, z, x order) of one channel under a rotation."""
    c, r = F.col(coefficients), F.col(rotation)
    v = [c[2], c[0], c[1]]
    turned = [sum((r[i * 3 + j] * v[j] for j in (1, 2)), r[i * 3] * v[0]) for i in range(3)]
    return F.array(turned[1], turned[2], turned[0])


def filter_gaussians(gaussians: DataFrame, threshold: float, top_k: int, by: Sequence[str], index: str, visible: str | None = None, strict: bool = False) -> DataFrame:
    """Those at the opacity or above and visible, at most the top_k of the highest opacity (ties by index) of each export. ``strict``: none at all is an error."""
    kept = gaussians.filter(F.col("opacity") >= threshold)
    kept = kept if visible is None else kept.filter(visible)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("opacity"), index))
    found = kept.withColumn("__place", place).filter(F.col("__place") <= top_k).drop("__place")
    return not_empty(found, f"Gaussian of opacity {threshold}") if strict else found


def vertex_properties(gaussians: DataFrame, store: str = "logit", colour: str = "sh") -> DataFrame:
    """Flat float columns: x y z, normals, f_dc, f_rest, opacity, scales, rotations.

    ``store``: 'logit' keeps opacity as logit and scales as logs, 'activated' as they are. ``colour``: 'sh' keeps the
    coefficients, 'rgb' turns them to colours, 'rgb_to_sh' turns colours to coefficients.
    """
    p = _clamp(F.col("opacity"), 1e-6, 1 - 1e-6)
    opacity = F.log(p / (1 - p)) if store == "logit" else F.col("opacity")
    scale = [F.log(F.greatest(F.col("scale")[i], F.lit(1e-8))) if store == "logit" else F.col("scale")[i] for i in range(3)]
    dc = [F.col("dc")[i] for i in range(3)]
    if colour == "rgb":
        dc = [_clamp(x * SH0 + 0.5, 0, 1) for x in dc]
    elif colour == "rgb_to_sh":
        dc = [(x - 0.5) / SH0 for x in dc]
    out = {n: F.col("xyz")[i] for i, n in enumerate("xyz")} | {f"n{n}": F.lit(0.0) for n in "xyz"}
    out |= {f"f_dc_{i}": x for i, x in enumerate(dc)} | {"opacity": opacity} | {f"scale_{i}": x for i, x in enumerate(scale)} | {f"rot_{i}": F.col("rotation")[i] for i in range(4)}
    keep = [c for c in gaussians.columns if c not in out and c not in ("xyz", "xyz_cam", "opacity", "scale", "rotation", "dc", "rest", "offset", "depth")]
    return gaussians.select(*keep, *[_real(x.cast("double"), 0.0).cast("float").alias(n) for n, x in out.items()])


def project_cloud(gaussians: DataFrame, cameras: DataFrame, by: Sequence[str], xyz: str = "xyz", w2c: str = "w2c") -> DataFrame:
    """``gaussians`` with the columns of each camera of their state (joined by ``by``) and ``xyz_cam``, the point in that camera's frame."""
    met = gaussians.join(cameras, list(by))
    w, x = F.col(w2c), F.col(xyz)
    return met.withColumn("xyz_cam", F.array(*[w[i * 4] * x[0] + w[i * 4 + 1] * x[1] + w[i * 4 + 2] * x[2] + w[i * 4 + 3] for i in range(3)]))


def frustum_stats(gaussians: DataFrame, cameras: DataFrame, by: Sequence[str], width: int, height: int, source: str = "source", camera: str = "cam_idx") -> DataFrame:
    """(part, penalty, outside, invalid, nonfinite, n) for part all, source and target: Gaussians in each camera of their state.

    The penalty is how far outside the image the projection lies, in image sizes, at most 100.
    """
    k = F.col("K")
    seen = project_cloud(gaussians, cameras, by)
    seen = seen.withColumns({f"__{axis}": F.col("xyz_cam")[i] for i, axis in enumerate("xyz")})
    z = F.greatest("__z", F.lit(1e-6))
    u, v = (k[0] * F.col("__x") / z + k[2]) / width, (k[4] * F.col("__y") / z + k[5]) / height
    seen = seen.withColumns({"__u": u, "__v": v})
    finite = L.finite(F.col("__u")) & L.finite(F.col("__v")) & L.finite(F.col("__z"))
    gap = lambda c: F.greatest(-F.col(c), F.lit(0.0)) + F.greatest(F.col(c) - 1, F.lit(0.0))
    seen = seen.withColumns({"__bad": ~finite, "__behind": F.coalesce(F.col("__z") <= 0, F.lit(True)), "__gap": F.when(finite, F.least(gap("__u") + gap("__v"), F.lit(100.0))).otherwise(100.0)})
    part = F.when(F.col(camera) == F.col(source), "source").otherwise("target")
    how_many = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    names = ("penalty", "outside", "invalid", "nonfinite")
    sums = dict(zip(names, (F.sum("__gap"), how_many(F.col("__gap") > 0), how_many(F.col("__behind")), how_many(F.col("__bad"))), strict=True))
    parts = seen.groupBy(part.alias("part")).agg(*[x.alias(c) for c, x in sums.items()], F.count(F.lit(1)).alias("n"))  # two rows, which make the third
    both = parts.withColumn("part", F.explode(F.array("part", F.lit("all")))).groupBy("part").agg(*[F.sum(c).alias(c) for c in (*names, "n")])
    return both.select("part", *[(F.col(c) / F.col("n")).alias(c) for c in names], "n")
