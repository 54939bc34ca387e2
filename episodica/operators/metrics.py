"""Aggregations and metrics over episodes, batches and runs."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from episodica.functions import linalg as L


def normalizer_stats(rows: DataFrame, vector: str, dims: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, mean, std): of each dimension, the sample deviation at least 1e-6; null for a single row."""
    means = [F.avg(F.col(vector)[i]) for i in range(dims)]
    stds = [F.when(F.count(F.col(vector)[i]) >= 2, F.greatest(F.stddev_samp(F.col(vector)[i]), F.lit(1e-6))) for i in range(dims)]
    return rows.groupBy(*by).agg(F.array(*means).alias("mean"), F.array(*stds).alias("std"))


#: Groups whose moments a task holds before it sends them on.
HELD_GROUPS = 1_000


def array_moments(rows: DataFrame, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean, m2): of each group's vectors, whatever their width: the count, the means, and the sums of squared differences from them.

    Tasks keep (n, mean, m2) of each group as arrays, a batch at a time, and send a row for each; a group's rows are merged by the differences of their
    means (Chan et al., "Updating Formulae and a Pairwise Algorithm for Computing Sample Variances"), so nothing is lost on large values with small
    deviations, and no expression grows with the width. A hot group is a few rows from each task. Null vectors are ignored; elements that are
    null or not a number make their dimension not a number; groups of unlike widths are an error.
    """
    import numpy as np
    import pyarrow as pa

    keys = [rows.schema[b] for b in by]
    state = StructType([*keys, *StructType.fromDDL("n long, mean array<double>, m2 array<double>").fields])
    n_keys = len(by)

    def merged(a: tuple, b: tuple) -> tuple:
        if a[1].shape != b[1].shape:
            raise ValueError(f"vectors of {a[1].size} and {b[1].size} elements in one group")
        n = a[0] + b[0]
        gap = b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + gap * gap * (a[0] * b[0] / n)

    def out(held: dict) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in held], to_arrow_type(f.dataType)) for i, f in enumerate(keys)]
        columns.append(pa.array([x[0] for x in held.values()], pa.int64()))
        columns += [pa.array([x[i] for x in held.values()], pa.list_(pa.float64())) for i in (1, 2)]
        return pa.RecordBatch.from_arrays(columns, names=state.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        for batch in batches:
            places: dict[tuple, list[int]] = {}
            groups = zip(*[c.to_pylist() for c in batch.columns[:n_keys]], strict=True) if n_keys else [()] * batch.num_rows
            for i, key in enumerate(groups):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                column = batch.column(n_keys).take(pa.array(at))
                v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if v.size % len(at) or len({len(x) for x in column}) > 1:
                    raise ValueError("vectors of unlike widths in one group")
                v = v.reshape(len(at), -1)
                mean = v.mean(axis=0)
                mine = (len(at), mean, ((v - mean) ** 2).sum(axis=0))
                held[key] = merged(held[key], mine) if key in held else mine
            if len(held) > HELD_GROUPS:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    def merge(table: pa.Table) -> pa.Table:
        total = None
        for n, mean, m2 in zip(*[table[c].to_pylist() for c in ("n", "mean", "m2")], strict=True):
            mine = (n, np.array(mean, np.float64), np.array(m2, np.float64))
            total = mine if total is None else merged(total, mine)
        return pa.table([*[table[f.name].slice(0, 1) for f in keys], pa.array([total[0]]), *[pa.array([x.tolist()], pa.list_(pa.float64())) for x in total[1:]]], names=state.names)

    parts = rows.filter(F.col(vector).isNotNull()).select(*by, F.col(vector).cast("array<double>").alias("__v")).mapInArrow(run, state)
    return parts.groupBy(*by).applyInArrow(merge, state)


def moment_stats(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, mean, std) of :func:`array_moments`: the sample deviation, at least 1e-6; nulls for a single row."""
    std = F.transform("m2", lambda x: F.when(F.col("n") >= 2, F.greatest(F.sqrt(x / (F.col("n") - 1)), F.lit(1e-6))))
    return moments.select(*by, "mean", std.alias("std"))


def normalize(rows: DataFrame, stats: DataFrame, vector: str, by: Sequence[str] = (), back: bool = False) -> DataFrame:
    """``rows`` with the vector normalised by its group's statistics, or turned back."""
    joined = rows.join(stats, list(by)) if by else rows.join(F.broadcast(stats))  # one row
    pairs = F.arrays_zip("mean", "std")
    turned = F.zip_with(vector, pairs, (lambda x, p: x * p["std"] + p["mean"]) if back else (lambda x, p: (x - p["mean"]) / p["std"]))
    return joined.withColumn(vector, turned).drop("mean", "std")


def episode_return(steps: DataFrame, by: Sequence[str] = ("actor", "episode")) -> DataFrame:
    return steps.groupBy(*by).agg(F.sum("reward").alias("ret"), F.max(F.col("success").cast("int")).alias("success"))


def eval_by_view(episodes: DataFrame, view: str = "view") -> DataFrame:
    """(view, mean_return, mean_success) and, with a null view, the mean of the views' means."""
    each = episodes.groupBy(view).agg(F.avg("ret").alias("mean_return"), F.avg("success").alias("mean_success"))
    macro = each.agg(F.avg("mean_return").alias("mean_return"), F.avg("mean_success").alias("mean_success"))
    return each.unionByName(macro.withColumn(view, F.lit(None).cast(each.schema[view].dataType)))


def validation_means(metrics: DataFrame, name: str = "name", value: str = "value", percent: Sequence[str] = ()) -> DataFrame:
    """(name, mean) over batches; ratios in per cent."""
    factor = F.when(F.col(name).isin(*percent), 100.0).otherwise(1.0) if percent else F.lit(1.0)
    return metrics.groupBy(name).agg((F.avg(value) * F.first(factor)).alias("mean"))


def reject_ledger(rows: DataFrame, rules: Sequence[tuple[str, Column]], by: Sequence[str] = ()) -> DataFrame:
    """(by, reason, n) with totals (reason 'total'): the first rule that a row breaks, 'ok' if none."""
    reason = F.lit("ok")
    for name, broken in reversed(rules):
        reason = F.when(broken, name).otherwise(reason)
    counted = rows.withColumn("reason", reason).rollup(*by, "reason").agg(F.count(F.lit(1)).alias("n"), F.grouping("reason").alias("__all"), *[F.grouping(c).alias(f"__{c}") for c in by])
    own = counted
    for c in by:
        own = own.filter(F.col(f"__{c}") == 0)
    return own.withColumn("reason", F.when(F.col("__all") == 1, "total").otherwise(F.col("reason"))).select(*by, "reason", "n")


def nonfinite_guard(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` with bad (the names of the terms that aren't finite) and skipped."""
    bad = F.filter(F.array(*[F.when(~L.finite(F.col(c).cast("double")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return rows.withColumn("bad", bad).withColumn("skipped", F.size("bad") > 0)


def reconstruction_error(pairs: DataFrame, predicted: str, target: str, by: Sequence[str]) -> DataFrame:
    """(by, mse, mae): means over pairs of the mean error of their elements."""
    n = F.size(target)
    squared = L.squared_distance(predicted, target) / n
    absolute = F.aggregate(F.zip_with(predicted, target, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / n
    return pairs.groupBy(*by).agg(F.avg(squared).alias("mse"), F.avg(absolute).alias("mae"))


def psnr_by_view(errors: DataFrame, view: str = "view", mse: str = "mse") -> DataFrame:
    return errors.groupBy(view).agg(F.avg(-10 * F.log10(F.col(mse) + 1e-8)).alias("psnr"))


def rotation_angle(a: str, b: str) -> Column:
    """Degrees between two rotations (9 numbers each)."""
    trace = L.dot(a, b)
    return F.degrees(F.acos(F.greatest(F.least((trace - 1) / 2, F.lit(1.0)), F.lit(-1.0))))


def pose_error(poses: DataFrame, by: Sequence[str], r_a: str, r_b: str, t_a: str, t_b: str) -> DataFrame:
    return poses.groupBy(*by).agg(F.avg(rotation_angle(r_a, r_b)).alias("rotation_deg"), F.avg(F.sqrt(L.squared_distance(t_a, t_b))).alias("translation"))


def intrinsics_error(rows: DataFrame, by: Sequence[str], predicted: str, target: str) -> DataFrame:
    """Mean absolute errors of fx, fy, cx, cy in row-major 3 x 3 matrices."""
    return rows.groupBy(*by).agg(*[F.avg(F.abs(F.col(predicted)[i] - F.col(target)[i])).alias(n) for n, i in (("fx", 0), ("fy", 4), ("cx", 2), ("cy", 5))])


def weighted_total(rows: DataFrame, weights: Mapping[str, float], name: str = "total") -> DataFrame:
    """``rows`` with the weighted sum of loss columns."""
    return rows.withColumn(name, sum((F.col(c) * F.lit(float(w)) for c, w in weights.items()), F.lit(0.0)))


def catalog_counts(steps: DataFrame, key: str = "episode") -> DataFrame:
    """(key, num_samples) and, with a null key, the total."""
    return steps.rollup(key).agg(F.count(F.lit(1)).alias("num_samples"))


def metric_downsample(metrics: DataFrame, k: int, step: str = "step", event: str = "event") -> DataFrame:
    """Every k-th step, and all event rows."""
    return metrics.filter((F.col(step) % k == 0) | F.col(event))


def axis_limits(points: DataFrame, by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """The points' box, wider by 8 per cent of each range (1e-6 at least) on either side."""
    limits = points.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("min", F.min), ("max", F.max))])
    for c in (x, y):
        pad = F.greatest(F.lit(1e-6), (F.col(f"max_{c}") - F.col(f"min_{c}")) * 0.08)
        limits = limits.withColumns({f"min_{c}": F.col(f"min_{c}") - pad, f"max_{c}": F.col(f"max_{c}") + pad})
    return limits


def variant_columns(rows: DataFrame, by: Sequence[str], variants: Sequence[str], variant: str = "variant", value: str = "value") -> DataFrame:
    """One row for each ``by``, one column for each variant's mean."""
    return rows.groupBy(*by).pivot(variant, list(variants)).agg(F.avg(value))


def metrics_long(wide: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(keys), list(values), "name", "value")


def metrics_wide(long: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    return long.groupBy(*keys).pivot("name", list(names)).agg(F.first("value"))
