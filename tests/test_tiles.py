"""Tiled contrasts against all pairs by hand, whatever the tiles, and a batch of twenty thousand vectors."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from episodica.operators import latents as E
from episodica.operators import tiles as TL

SCHEMA = "batch_id long, state_id long, view_id long, z_inv array<double>, z_dep array<double>, k_tau int"


def made(n=90, seed=2):
    r = random.Random(seed)
    v = lambda: [r.gauss(0, 1) if r.random() < 0.97 else r.choice([float("nan"), float("inf")]) for _ in range(6)]
    rows = [(r.choice([0, 0, 0, 1]), i // 3, i % 3, v(), v(), 1) for i in range(n)]
    return [*rows, (0, 900, 0, None, v(), 1), (None, 1, 1, v(), v(), 1), (7, 1, 1, v(), v(), 1)]


def unit(v):
    x = np.array([e if math.isfinite(e) else 0.0 for e in v])
    return x / max(1e-6, math.sqrt(float(x @ x)))


def by_hand(rows, vec, positive, negative, tau):
    out = {}
    for batch in {r[0] for r in rows} - {None}:
        mine = [(r, unit(r[vec])) for r in rows if r[0] == batch and r[vec] is not None]
        losses = []
        for a, x in mine:
            sims = [(b, float(x @ y) / tau) for b, y in mine]
            pos = [s for b, s in sims if positive(a, b)]
            rest = [s for b, s in sims if positive(a, b) or negative(a, b)]
            if pos:
                losses.append(np.logaddexp.reduce(rest) - np.logaddexp.reduce(pos))
        out[batch] = (float(np.mean(losses)) if losses else 0.0, len(losses))
    return out


@pytest.mark.parametrize("tile,tau", [(2048, 0.5), (7, 0.5), (1, 0.1), (11, 0.0005)])
def test_tiles_give_what_all_pairs_give(spark, tile, tau):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    later = lambda a, b: (a["state_id"] == b["state_id"]) & (a["view_id"] < b["view_id"])
    got = E.multi_positive_nce(df, later, lambda a, b: a["state_id"] != b["state_id"], tau, vec="z_inv", tile=tile).collect()
    want = by_hand(rows, 3, lambda a, b: a[1] == b[1] and a[2] < b[2], lambda a, b: a[1] != b[1], tau)
    assert {r["batch_id"]: (pytest.approx(r["loss"], rel=1e-9, abs=1e-9), r["n_queries"]) for r in got} == want


@pytest.mark.parametrize("tile", [2048, 5])
def test_both_halves_and_ratios(spark, tile):
    rows = [r for r in made() if r[3] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    inv = by_hand(rows, 3, lambda a, b: a[1] == b[1] and a[2] != b[2], lambda a, b: a[1] != b[1], 0.5)
    dep = by_hand(rows, 4, lambda a, b: a[2] == b[2] and a[1] != b[1], lambda a, b: a[2] != b[2], 0.5)
    got = {r["batch_id"]: (r["inv"], r["dep"]) for r in E.view_state_contrast(df, 0.5, tile=tile).collect()}
    assert got == {b: (pytest.approx(inv[b][0]), pytest.approx(dep[b][0])) for b in inv}
    same = lambda a, b: (a["state_id"] == b["state_id"]) & (a["view_id"] != b["view_id"])
    ratio = {r["batch_id"]: r["loss"] for r in E.ratio_contrast(df, same, lambda a, b: a["state_id"] != b["state_id"], least=0.1, vec="z_inv", tile=tile).collect()}
    for batch in (0, 1):
        mine = [(r, unit(r[3])) for r in rows if r[0] == batch]
        each = []
        for a, x in mine:
            e = [(b, math.exp(max(0.1, float(x @ y)))) for b, y in mine]
            p, n = sum(s for b, s in e if a[1] == b[1] and a[2] != b[2]), sum(s for b, s in e if a[1] != b[1])
            each.append(-math.log(max(p, 1e-8) / max(p + n, 1e-8)))
        assert ratio[batch] == pytest.approx(np.mean(each))
    with pytest.raises(ValueError, match="tau"):
        E.view_state_contrast(df, 0.0)


def test_a_large_batch_by_tiles(spark):
    """Twenty thousand vectors of one batch: 400 million pairs, and no row for any of them."""
    n, d = 20_000, 16
    rows = spark.range(n).select(F.expr(f"id div {n}").alias("batch_id"), F.col("id").alias("row"), F.transform(F.sequence(F.lit(1), F.lit(d)), lambda i: F.sin(F.col("id") * i + i * i)).alias("vec"))
    every = lambda a, b: np.ones((1, 1), bool)
    each = TL.tiled_sums(rows, rows, {"all": ("vec", every)}, 0.5)
    got = {r["row"]: (r["all_lse"], r["all_n"]) for r in each.filter("row % 997 = 0").collect()}
    v = TL.unit_rows(pa.array(rows.orderBy("row").toPandas()["vec"].tolist()))
    for i, (lse, size) in got.items():
        assert size == n and lse == pytest.approx(np.logaddexp.reduce(v @ v[i] / 0.5), rel=1e-12)
    plan = each._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
