"""Contrasts inside batches in tiles: blocks of queries against blocks of keys, one matrix product each, and no row for a pair."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

Labels = dict[str, np.ndarray]
#: Which pairs count, from the queries' labels (a column each) and the keys' (a row each): a boolean matrix.
Mask = Callable[[Labels, Labels], np.ndarray]
#: Queries and keys of a tile, about: 32 MB of similarities.
TILE = 2048
#: Queries whose similarities are masked at once.
STRIP = 256


def unit_rows(column: pa.ChunkedArray | pa.Array, least: float = 1e-6) -> np.ndarray:
    """Vectors as rows of a matrix: elements that are null, not a number or infinite become 0; divided by their length, or by ``least`` if that is more."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    found = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    found = np.where(np.isfinite(found), found, 0.0)
    return found / np.maximum(np.sqrt((found * found).sum(axis=1, keepdims=True)), least)


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that compare as the values of two columns do; a null equals none."""
    both = [*a.to_pylist(), *b.to_pylist()]
    held = [x for x in both if x is not None]
    place = {x: i for i, x in enumerate(sorted(set(held)))}
    found = np.array([np.nan if x is None else place[x] for x in both], np.float64)
    return found[: len(a)], found[len(a) :]


def _sums(similarity: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: the largest masked value (null as nan), the sum of exponentials of the others' differences from it, and how many there are."""
    n = mask.sum(axis=1)
    masked = np.where(mask, similarity, -np.inf)
    top = masked.max(axis=1, initial=-np.inf)
    with np.errstate(invalid="ignore"):
        total = np.where(n > 0, np.exp(masked - np.where(n > 0, top, 0.0)[:, None]).sum(axis=1), 0.0)
    return np.where(n > 0, top, np.nan), total, n


def tiled_sums(queries: DataFrame, keys: DataFrame, masks: Mapping[str, tuple[str, Mask]], tau: float = 1.0, by: str = "batch_id", row: str = "row", labels: Sequence[str] = (), least: float | None = None, tile: int = TILE) -> DataFrame:
    """(by, row, <name>_top, <name>_lse, <name>_n) of each query: over the keys of its batch that the mask ``name`` admits, the largest similarity, the
    logarithm of the sum of exponentials, and how many; nulls and 0 where none is.

    ``masks``: a name to the vectors' column and the mask over ``labels``. Similarities are products of unit vectors over ``tau``, at least ``least``.
    A batch's queries and keys are dealt into blocks of about ``tile`` rows by their hash; each pair of blocks is one group of a cogroup, whose task
    multiplies them and keeps three numbers a query. Those of a query's tiles are merged by their largest. A batch of n rows moves n vectors n / ``tile``
    times, and a task holds one tile whatever the batch. Rows without a batch or with a null vector go; rows of one id are one query.
    """
    names, vectors = list(masks), sorted({v for v, _ in masks.values()})
    count = lambda df, n: df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(n))
    sizes = count(queries, "__q").join(count(keys, "__k"), by)
    whole = lambda df: df.filter(" AND ".join(f"{v} IS NOT NULL" for v in vectors)).join(sizes, by)
    own = lambda n: F.pmod(F.xxhash64(row, *labels), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    carried = list(dict.fromkeys([by, row, *labels, *vectors]))
    left = whole(queries).select(*carried, own("__q").alias("__qb"), each("__k").alias("__kb"))
    right = whole(keys).select(*carried, own("__k").alias("__kb"), each("__q").alias("__qb")).select(*[F.col(c).alias(f"k_{c}") for c in [*carried, "__kb", "__qb"]])
    fields = [queries.schema[by], queries.schema[row]]
    for name in names:
        fields += [StructField(f"{name}_top", DoubleType()), StructField(f"{name}_sum", DoubleType()), StructField(f"{name}_n", LongType())]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.rename_columns([c.removeprefix("k_") for c in b.column_names])
        n = a.num_rows if b.num_rows else 0
        found = [(np.full(n, np.nan), np.zeros(n), np.zeros(n, np.int64)) for _ in names]
        if n:
            codes = {c: _codes(a[c], b[c]) for c in labels}
            units = {v: (unit_rows(a[v]), unit_rows(b[v]).T) for v in vectors}
            over = {c: k[None, :] for c, (_, k) in codes.items()}
            for i in range(0, n, STRIP):
                part = slice(i, i + STRIP)
                strip = {c: q[part, None] for c, (q, _) in codes.items()}
                product = {v: q[part] @ k / tau for v, (q, k) in units.items()}
                for m, (v, mask) in enumerate(masks.values()):
                    similarity = product[v] if least is None else np.maximum(product[v], least)
                    for held, new in zip(found[m], _sums(similarity, np.broadcast_to(mask(strip, over), similarity.shape)), strict=True):
                        held[part] = new
        columns = [a[by].slice(0, n), a[row].slice(0, n)]
        for top, total, size in found:
            columns += [pa.array(top, pa.float64(), from_pandas=True), pa.array(total), pa.array(size)]
        return pa.table(columns, names=[f.name for f in fields])

    group = [by, "__qb", "__kb"]
    parts = left.groupBy(*group).cogroup(right.groupBy(*[f"k_{c}" for c in group])).applyInArrow(run, StructType(fields))
    merged = parts.groupBy(by, row).agg(*[f for x in names for f in (F.max(f"{x}_top").alias(f"{x}_top"), F.collect_list(F.when(F.col(f"{x}_n") > 0, F.struct(f"{x}_top", f"{x}_sum"))).alias(f"{x}_parts"), F.sum(f"{x}_n").alias(f"{x}_n"))])

    def lse(x: str) -> Column:
        top = F.col(f"{x}_top")
        return top + F.log(F.aggregate(f"{x}_parts", F.lit(0.0), lambda s, p: s + p[f"{x}_sum"] * F.exp(p[f"{x}_top"] - top)))

    return merged.select(by, row, *[c for x in names for c in (f"{x}_top", lse(x).alias(f"{x}_lse"), f"{x}_n")])
