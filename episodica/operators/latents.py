"""Scores of embedding tables: contrasts and consistency inside stated batches, and codebooks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from episodica.functions import linalg as L
from episodica.operators.codebooks import assign_in_blocks, fit_live_codebook, matrix, nearest  # noqa: F401
from episodica.operators.metrics import array_moments
from episodica.operators.tiles import TILE, Mask, tiled_sums


def infonce(q: DataFrame, k: DataFrame, tau: float, batch: str = "batch_id", row: str = "state_id", vec: str = "vec") -> DataFrame:
    """(batch, loss): mean cross-entropy of each query's own key among the batch's keys, from sums over tiles."""
    take = lambda df: df.select(batch, row, F.col(vec).alias("vec"))
    masks = {"own": ("vec", lambda a, b: a[row] == b[row]), "all": ("vec", lambda a, b: np.ones((1, 1), bool))}
    each = tiled_sums(take(q), take(k), masks, _positive(tau), batch, row, [row])
    return each.groupBy(batch).agg(F.avg(F.col("all_lse") - F.col("own_top")).alias("loss"))


def infonce_mixed(rows: DataFrame, tau: float, q: str, positive: str, negatives: str, batch: str = "batch_id", row: str = "state_id") -> DataFrame:
    """(batch, loss): the mean of :func:`infonce` over the batch's keys and :func:`infonce_paired` over explicit negatives."""
    keys = lambda c: rows.select(batch, row, F.col(c).alias("vec"))
    full = infonce(keys(q), keys(positive), tau, batch, row).withColumnRenamed("loss", "__full")
    paired = infonce_paired(rows, tau, q, positive, negatives, [batch]).withColumnRenamed("loss", "__paired")
    return full.join(paired, batch).select(batch, (0.5 * (F.col("__full") + F.col("__paired"))).alias("loss"))


def _positive(tau: float) -> float:
    if not tau > 0:
        raise ValueError(f"tau {tau} isn't over 0")
    return tau


def infonce_paired(rows: DataFrame, tau: float, q: str, positive: str, negatives: str, by: Sequence[str]) -> DataFrame:
    """(by, loss): a query's positive against its own explicit negatives."""
    own = L.dot(L.clean_unit(q), L.clean_unit(positive)) / tau
    others = F.transform(negatives, lambda n: L.dot(L.clean_unit(q), L.clean_unit(n)) / tau)
    top = F.greatest(own, F.array_max(others))
    total = F.aggregate(others, F.exp(own - top), lambda s, x: s + F.exp(x - top))
    return rows.groupBy(*by).agg(F.avg(top + F.log(total) - own).alias("loss"))


def _nce_loss(name: str, rest: str) -> Column:
    """Of a query: -(log of positives - log of all); null without a positive."""
    return F.col(f"{rest}_lse") - F.col(f"{name}_lse")


def multi_positive_nce(vectors: DataFrame, positive: Mask, negative: Mask, tau: float, vec: str = "vec", by: str = "batch_id", labels: Sequence[str] = ("state_id", "view_id"), tile: int = TILE) -> DataFrame:
    """(by, loss, n_queries): -(lse over positives - lse over positives and negatives), the mean of the queries that have a positive; 0 if none has.

    Similarities are of unit vectors over ``tau``, summed tile by tile; the masks say which keys are which, from both sides' ``labels``.
    """
    rows = vectors.select(by, *labels, F.struct(*labels).alias("row"), vec)
    masks = {"pos": (vec, positive), "all": (vec, lambda a, b: positive(a, b) | negative(a, b))}
    loss = _nce_loss("pos", "all")
    each = tiled_sums(rows, rows, masks, _positive(tau), by, labels=labels, tile=tile)
    return each.groupBy(by).agg(F.coalesce(F.avg(loss), F.lit(0.0)).alias("loss"), F.count(loss).alias("n_queries"))


def view_state_contrast(vectors: DataFrame, tau: float, inv: str = "z_inv", dep: str = "z_dep", tile: int = TILE) -> DataFrame:
    """(batch_id, inv, dep): invariant halves attract other views of a state, dependent ones the same view of other states.

    Both are summed over the same tiles of a batch.
    """
    labels = ["state_id", "view_id"]
    state, view = (lambda a, b, c=c: a[c] == b[c] for c in labels)
    masks = {
        "ip": (inv, lambda a, b: state(a, b) & (a["view_id"] != b["view_id"])),
        "ia": (inv, lambda a, b: (state(a, b) & (a["view_id"] != b["view_id"])) | (a["state_id"] != b["state_id"])),
        "dp": (dep, lambda a, b: view(a, b) & (a["state_id"] != b["state_id"])),
        "da": (dep, lambda a, b: (view(a, b) & (a["state_id"] != b["state_id"])) | (a["view_id"] != b["view_id"])),
    }
    rows = vectors.select("batch_id", *labels, F.struct(*labels).alias("row"), inv, dep)
    each = tiled_sums(rows, rows, masks, _positive(tau), labels=labels, tile=tile)
    mean = lambda p: F.coalesce(F.avg(_nce_loss(f"{p}p", f"{p}a")), F.lit(0.0))
    return each.groupBy("batch_id").agg(mean("i").alias("inv"), mean("d").alias("dep"))


def consistency(vectors: DataFrame, vec: str, dims: int, group: str, batch: str = "batch_id") -> DataFrame:
    """(batch, value): the mean absolute difference of unit vectors from their group's mean."""
    v = vectors.select(batch, group, L.clean_unit(vec).alias("__v"))
    mean = array_moments(v, "__v", [batch, group]).select(batch, group, F.col("mean").alias("__m"))
    gap = F.aggregate(F.zip_with("__v", "__m", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / dims
    return v.join(mean, [batch, group]).groupBy(batch).agg(F.avg(gap).alias("value"))


def ratio_contrast(vectors: DataFrame, positive: Mask, negative: Mask, tau: float = 1.0, eps: float = 1e-8, least: float | None = None, vec: str = "vec", by: str = "batch_id", labels: Sequence[str] = ("state_id", "view_id"), tile: int = TILE) -> DataFrame:
    """(by, loss): -log(max(sum of positives, eps) / max(sum of all, eps)) of exp similarities, the mean of all queries; summed tile by tile."""
    rows = vectors.select(by, *labels, F.struct(*labels).alias("row"), vec)
    each = tiled_sums(rows, rows, {"p": (vec, positive), "n": (vec, negative)}, tau, by, labels=labels, least=least, tile=tile)
    p, n = (F.coalesce(F.exp(f"{x}_lse"), F.lit(0.0)) for x in "pn")
    return each.groupBy(by).agg(F.avg(-F.log(F.greatest(p, F.lit(eps)) / F.greatest(p + n, F.lit(eps)))).alias("loss"))


def triplet_hinge(rows: DataFrame, margin: float, anchor: str, positive: str, negative: str, by: Sequence[str]) -> DataFrame:
    gap = F.lit(margin) + L.squared_distance(anchor, positive) - L.squared_distance(anchor, negative)
    return rows.groupBy(*by).agg(F.avg(F.greatest(F.lit(0.0), gap)).alias("loss"))


def assign_codes(vectors: DataFrame, codebook: DataFrame, vec: str = "vec", code: str = "code", code_vec: str = "code_vec", beta: float = 1.0, max_bytes: int = 256_000_000, key: Sequence[str] | None = None) -> DataFrame:
    """``vectors`` with the nearest code (the smallest of equals) and its error: ``beta`` times the mean squared difference.

    A codebook of at most ``max_bytes`` of doubles goes to the tasks. A larger one is taken in blocks (:func:`codebooks.assign_in_blocks`), for
    which ``key`` names the columns that tell the vectors' rows apart. Either way the codes are the same. A null vector has neither.
    """
    import pyarrow as pa

    kind = codebook.schema[code].dataType
    size = codebook.agg(F.sum(F.size(code_vec).cast("long") * 8)).first()[0] or 0
    if size > max_bytes:
        if not key:
            raise ValueError(f"{size} bytes of codes are more than {max_bytes}; name the vectors' key to take them in blocks")
        found = assign_in_blocks(vectors, codebook, key, vec, code, code_vec)
        found = found.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("code").alias(code), "distance")
        met = vectors.join(found, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key], "left").drop(*[f"__{k}" for k in key])
        return met.withColumn("error", F.when(F.col(vec).isNotNull(), F.col("distance") / F.size(vec) * beta)).withColumn(code, F.when(F.col(vec).isNotNull(), F.col(code))).drop("distance")
    rows = codebook.filter(F.col(code_vec).isNotNull()).orderBy(code).select(code, F.col(code_vec).cast("array<double>")).collect()
    names, book = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    at = vectors.columns.index(vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            valid = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)) if names else np.empty(0, np.int64)
            found, error = [None] * batch.num_rows, [None] * batch.num_rows
            if len(valid):
                v = matrix(column.take(pa.array(valid)))
                best, distance = nearest(v, book)
                for r, c, d in zip(valid.tolist(), best.tolist(), (distance / v.shape[1] * beta).tolist(), strict=True):
                    found[r], error[r] = names[c], d
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.from_numpy_dtype(np.int64) if kind.typeName() == "bigint" else pa.int32() if kind.typeName() == "integer" else pa.string()), pa.array(error, pa.float64())], names=[*batch.schema.names, code, "error"])

    schema = StructType([*vectors.schema.fields, StructField(code, kind), StructField("error", DoubleType())])
    return vectors.mapInArrow(run, schema)


def fit_codebook(vectors: DataFrame, k: int, vec: str = "vec", iterations: int = 10, seed: int = 0) -> DataFrame:
    """(code, code_vec) by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="features").fit(vectors.select(array_to_vector(F.col(vec)).alias("features")))
    return vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "code int, code_vec array<double>")


def code_usage(codes: DataFrame, codebook: DataFrame, code: str = "code") -> DataFrame:
    """One row: n_codes, used share, perplexity exp(-sum p ln p), dead (codes with fewer than 2)."""
    counts = codebook.select(code).join(codes.groupBy(code).agg(F.count(F.lit(1)).alias("n")), code, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return counts.join(F.broadcast(total)).agg(  # one row
        F.count(F.lit(1)).alias("n_codes"), F.avg(F.when(F.col("n") > 0, 1.0).otherwise(0.0)).alias("used"), F.exp(-F.sum(F.when(F.col("n") > 0, p * F.log(p)).otherwise(0.0))).alias("perplexity"), F.sum(F.when(F.col("n") < 2, 1).otherwise(0)).alias("dead")
    )


def fsq_codes(vectors: DataFrame, levels: Sequence[int], vec: str = "vec") -> DataFrame:
    """``vectors`` with digits (each dimension bounded by tanh and rounded to one of its levels) and their mixed-radix index."""
    digits, index, basis = [], F.lit(0).cast("long"), 1
    for d, n in enumerate(levels):
        half = (n - 1) / 2
        shift = 0.0 if n % 2 else 0.5
        x = F.tanh(F.col(vec)[d]) * half
        digit = (F.floor(x + half + 0.5) if n % 2 else F.least(F.floor(x + half + shift), F.lit(n - 1))).cast("long")
        digits.append(digit)
        index = index + digit * basis
        basis *= n
    return vectors.withColumns({"digits": F.array(*digits), "index": index})


def gaussian_kl(rows: DataFrame, mean: str, log_std: str, by: Sequence[str]) -> DataFrame:
    """(by, kl): the mean of -(1 + ln s^2 - m^2 - s^2) / 2 over elements, ln s within [-20, 2]."""
    terms = F.zip_with(mean, F.transform(log_std, lambda s: F.least(F.greatest(s, F.lit(-20.0)), F.lit(2.0))), lambda m, s: -0.5 * (1 + 2 * s - m * m - F.exp(2 * s)))
    return rows.groupBy(*by).agg(F.avg(F.aggregate(terms, F.lit(0.0), lambda t, x: t + x) / F.size(mean)).alias("kl"))


def embed_2d(rows: DataFrame, vec: str) -> DataFrame:
    """``rows`` with x and y: the first two principal components of their cleaned unit vectors.

    A component's sign is free; each is turned so that its largest loading is positive, and repeated fits give the same plane.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = rows.withColumn("__f", array_to_vector(L.clean_unit(vec)))
    model = PCA(k=2, inputCol="__f", outputCol="__p").fit(ready)
    signs = [1.0 if max(c) >= -min(c) else -1.0 for c in model.pc.toArray().T.tolist()]  # as many numbers as a vector has, twice
    found = model.transform(ready).withColumn("__p", vector_to_array("__p"))
    return found.withColumns({"x": F.col("__p")[0] * signs[0], "y": F.col("__p")[1] * signs[1]}).drop("__f", "__p")


def fuse(inv: str, dep: str, mode: str = "cat") -> Column:
    if mode not in ("cat", "plus"):
        raise ValueError(f"unknown mode {mode!r}")
    return F.concat(inv, dep) if mode == "cat" else F.zip_with(inv, dep, lambda a, b: a + b)


def swap_matrix(rows: DataFrame, inv: str = "z_inv", dep: str = "z_dep", by: Sequence[str] = ("episode",), t: str = "t", camera: str = "camera", mode: str = "cat") -> DataFrame:
    """(by, inv_camera, inv_t, dep_camera, dep_t, fused): the invariant half of each frame with the dependent half of every other camera's frame that
    :func:`sampling.swap_pairs` pairs it with, fused by ``mode``."""
    from episodica.operators.sampling import swap_pairs

    half = lambda name, vec: rows.select(*by, F.col(camera).alias(f"{name}_camera"), F.col(t).alias(f"{name}_t"), F.col(vec).alias(f"__{name}"))
    met = swap_pairs(rows, by, t, camera)
    for name, vec in (("inv", inv), ("dep", dep)):
        met = met.join(half(name, vec), [*by, f"{name}_camera", f"{name}_t"])
    return met.select(*by, "inv_camera", "inv_t", "dep_camera", "dep_t", fuse("__inv", "__dep", mode).alias("fused"))
