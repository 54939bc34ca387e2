"""Codebooks: the nearest code of each vector, whatever the codebook's size, and fits without dead codes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: Products that are held at once: vectors times codes.
PRODUCTS = 2_000_000


def matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length, none null, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``book``, squared distance) of the nearest to each row of ``v``, the first of equals. Where several are nearest by their products, exact distances decide."""
    found, error = np.empty(len(v), np.int64), np.empty(len(v))
    step = max(1, PRODUCTS // max(1, len(book)))
    lengths = (book * book).sum(axis=1)
    for i in range(0, len(v), step):
        part = v[i : i + step]
        squares = (part * part).sum(axis=1)[:, None] + lengths
        rough = squares - 2 * part @ book.T
        row, candidate = np.nonzero(rough <= rough.min(axis=1)[:, None] + 1e-9 * (1 + squares))
        exact = ((part[row] - book[candidate]) ** 2).sum(axis=1)
        order = np.lexsort((candidate, exact, row))
        first = order[np.r_[True, np.diff(row[order]) > 0]]
        found[i : i + step], error[i : i + step] = candidate[first], exact[first]
    return found, error


def _valid(column: pa.Array) -> np.ndarray:
    return np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))


def assign_in_blocks(vectors: DataFrame, codebook: DataFrame, key: Sequence[str], vec: str = "vec", code: str = "code", code_vec: str = "code_vec", pivots: int = 256, block_bytes: int = 32_000_000, share: int = 500_000) -> DataFrame:
    """(key, code, distance): the nearest code of each vector and its squared distance, for a codebook that no task can hold.

    Some codes are pivots, those of least hash. Each code goes to the block of its nearest pivot, whose radius is the farthest code's distance; a large block
    is cut into parts of ``block_bytes``. By the triangle inequality no code of a block is nearer to a vector than the pivot's distance less the radius, and
    the nearest pivot is a code itself: so a vector is sent to those blocks only whose bound isn't beyond its nearest pivot. A task reads a part's
    codes, then the vectors sent there batch by batch; a part that very many vectors are sent to is copied, a copy for ``share`` of them. A
    vector's code is the least of its parts' by distance, then code. ``key`` names a vector's row; rows of one key are one vector. Null vectors and codes
    have no part in it; an empty codebook gives no row.
    """
    codes = codebook.filter(F.col(code_vec).isNotNull()).select(F.col(code).alias("code"), F.col(code_vec).cast("array<double>").alias("vec"))
    rows = codes.orderBy(F.xxhash64("vec"), "code").limit(pivots).collect()
    asked = vectors.filter(F.col(vec).isNotNull()).select(*key, F.col(vec).cast("array<double>").alias("vec"))
    if not rows:
        return asked.limit(0).select(*key).join(codes.limit(0).select("code", F.lit(0.0).alias("distance")))
    pivot = np.array([r["vec"] for r in rows], np.float64)
    kind = codes.schema["code"].dataType

    def block_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, distance = nearest(matrix(batch.column(1)), pivot) if batch.num_rows else (np.empty(0, np.int64), np.empty(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block.astype(np.int32)), pa.array(np.sqrt(distance))], names=["code", "vec", "block", "distance"])

    dealt = codes.mapInArrow(block_of, StructType([*codes.schema.fields, StructField("block", IntegerType()), StructField("distance", DoubleType())]))
    sums = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()  # as many as pivots
    radius, parts = np.full(len(pivot), -np.inf), np.zeros(len(pivot), np.int64)
    per_part = max(1, block_bytes // (8 * pivot.shape[1]))
    for r in sums:
        radius[r["block"]], parts[r["block"]] = r["radius"], -(-r["n"] // per_part)

    def blocks_for(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, block) of each block that may hold a vector's nearest code."""
        squares = (v * v).sum(axis=1)[:, None] + (pivot * pivot).sum(axis=1)
        distance = np.sqrt(np.maximum(squares - 2 * v @ pivot.T, 0))
        slack = 1e-6 * (1 + np.sqrt(squares))
        return np.nonzero(distance - radius - slack <= (distance + slack).min(axis=1)[:, None])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pivot), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(blocks_for(matrix(batch.column(0)))[1], minlength=len(pivot))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["block", "n"])

    copies = np.ones(len(pivot), np.int64)
    for r in asked.select("vec").mapInArrow(count, "block int, n long").groupBy("block").agg(F.sum("n").alias("n")).collect():
        copies[r["block"]] = max(1, -(-r["n"] // share))
    n_key = len(key)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, block = blocks_for(matrix(batch.column(n_key)))
            salt = batch.column(n_key + 1).to_numpy()[row] % copies[block]
            times = parts[block]
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            taken = batch.take(pa.array(np.repeat(row, times)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block, times).astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.repeat(salt, times).astype(np.int32)), *taken.columns[: n_key + 1]], names=["block", "part", "copy", *key, "vec"])

    keys = [asked.schema[k] for k in key]
    place = [StructField(x, IntegerType()) for x in ("block", "part", "copy")]
    sent = asked.withColumn("__salt", F.pmod(F.xxhash64(*key), F.lit(1 << 30))).mapInArrow(send, StructType([*place, *keys, asked.schema["vec"]]))
    sent = sent.select("block", "part", "copy", F.lit(1).alias("kind"), *key, F.lit(None).cast(kind).alias("code"), "vec")
    sizes = codebook.sparkSession.createDataFrame([(b, int(parts[b]), int(copies[b])) for b in range(len(pivot))], "block int, parts int, copies int")
    there = dealt.join(F.broadcast(sizes), "block")  # as many rows as pivots
    there = there.select("block", F.pmod(F.xxhash64("code", "vec"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in keys], "code", "vec")
    stream = there.unionByName(sent).repartition("block", "part", "copy").sortWithinPartitions("block", "part", "copy", "kind", "code")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, names_, book = None, [], None, None
        for batch in batches:
            at = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            cuts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1)]) if len(at) else []
            for i, j in zip(cuts, [*cuts[1:], len(at)], strict=True):
                piece = batch.slice(i, j - i)
                if now != tuple(at[i, :3]):
                    now, held, book = tuple(at[i, :3]), [], None
                if at[i, 3] == 0:
                    held.append((piece.column(4 + n_key), matrix(piece.column(5 + n_key))))
                    continue
                if book is None and held:
                    names_, book = pa.chunked_array([x for x, _ in held]), np.concatenate([x for _, x in held])
                if held:
                    best, distance = nearest(matrix(piece.column(5 + n_key)), book)
                    yield pa.RecordBatch.from_arrays([*piece.columns[4 : 4 + n_key], names_.take(pa.array(best)).combine_chunks(), pa.array(distance)], names=[*key, "code", "distance"])

    near = stream.mapInArrow(walk, StructType([*keys, codes.schema["code"], StructField("distance", DoubleType())]))
    best = near.groupBy(*key).agg(F.min(F.struct("distance", "code")).alias("best"))
    return best.select(*key, F.col("best.code").alias("code"), F.col("best.distance").alias("distance"))



def _sums(vectors: DataFrame, centers: np.ndarray, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors each centre is nearest to, and their sums. A task sends a row for each of its centres; a centre's rows are added up in one group."""
    d = centers.shape[1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centers), np.int64), np.zeros_like(centers)
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(0))
                near = nearest(v, centers)[0]
                n += np.bincount(near, minlength=len(centers))
                np.add.at(total, near, v)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held]), pa.array(list(total[held]), pa.list_(pa.float64()))], names=["code", "n", "total"])

    def add(table: pa.Table) -> pa.Table:
        total = matrix(table["total"].combine_chunks()).sum(axis=0)
        return pa.table([table["code"].slice(0, 1), pa.array([sum(table["n"].to_pylist())], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["code", "n", "total"])

    schema = "code int, n long, total array<double>"
    n, total = np.zeros(len(centers), np.int64), np.zeros((len(centers), d))
    for r in vectors.select(F.col(vec).cast("array<double>").alias("v")).mapInArrow(count, schema).groupBy("code").applyInArrow(add, schema).collect():  # a row a centre
        n[r["code"]], total[r["code"]] = r["n"], r["total"]
    return n, total


def _far_vectors(vectors: DataFrame, centers: np.ndarray, n: int, vec: str, seed: int) -> list[list[float]]:
    """Up to ``n`` different vectors far from the centres and from each other: of several times as many, drawn without replacement with their squared distance
    to the nearest centre as weight, the farthest from all centres and those chosen before, one by one.

    A vector's hash gives it a number u; those with the least -ln(u) / weight are a weighted draw (Efraimidis and Spirakis), which needs no total. Copies have one
    hash, so several are asked for.
    """

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = nearest(matrix(batch.column(0)), centers)[1] if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight)], names=["v", "u", "weight"])

    u = (F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
    weighed = vectors.select(F.col(vec).cast("array<double>").alias("v")).withColumn("u", u).mapInArrow(weigh, "v array<double>, u double, weight double").filter("weight > 0")
    rows = weighed.orderBy(-F.log("u") / F.col("weight"), "v").limit(max(4 * n, min(32 * n, 10_000))).collect()
    drawn = np.array([*dict.fromkeys(tuple(r["v"]) for r in rows)], np.float64).reshape(-1, centers.shape[1])
    gap = nearest(drawn, centers)[1]
    chosen: list[list[float]] = []
    while len(chosen) < min(n, len(drawn)):
        best = int(gap.argmax())
        chosen.append(drawn[best].tolist())
        gap = np.minimum(gap, ((drawn - drawn[best]) ** 2).sum(axis=1))
    return chosen


def fit_live_codebook(vectors: DataFrame, start: Sequence[Sequence[float]], vec: str = "vec", iterations: int = 10, rounds: int = 20, least: int = 2, seed: int = 0) -> DataFrame:
    """(code, code_vec, n) by k-means from the codes ``start``, without dead codes: those that fewer than ``least`` vectors are nearest to.

    Each round moves the codes to their vectors' means, ``iterations`` times or until they stay; then each dead code is put on a vector far from all codes,
    drawn by its squared distance, and the next round goes on from there. It ends when no code is dead, when no vector is off its code, or
    after ``rounds``; a code that is dead then keeps its place. ``n`` is how many vectors a code is nearest to. The codes, as many as in ``start``, are
    held by the driver and each task; vectors never are. Null vectors are ignored; a code that no vector is near stays where it is.
    """
    ready = vectors.filter(F.col(vec).isNotNull()).select(vec)
    centers = np.array(start, np.float64)
    for turn in range(rounds):
        for _ in range(iterations):
            n, total = _sums(ready, centers, vec)
            moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers)
            still = np.allclose(moved, centers, rtol=1e-12, atol=1e-12)
            centers = moved
            if still:
                break
        n, _ = _sums(ready, centers, vec)
        dead = np.flatnonzero(n < least)
        if not len(dead) or turn + 1 == rounds:
            break
        live = centers[n >= least] if len(dead) < len(centers) else centers
        far = _far_vectors(ready, live, len(dead), vec, seed + turn)
        if not far:
            break
        centers[dead[: len(far)]] = far
    rows = [(i, c.tolist(), int(k)) for i, (c, k) in enumerate(zip(centers, n, strict=True))]
    return vectors.sparkSession.createDataFrame(rows, "code int, code_vec array<double>, n long")
