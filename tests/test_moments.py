"""Moments of arrays: wide, large, hot and odd."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import metrics as M


def test_wide_vectors_near_a_hundred_million(spark):
    """4,096 dimensions whose deviations are a billionth of their values."""
    d, n = 4096, 60
    base = np.random.default_rng(1).normal(size=(n, d))
    rows = spark.createDataFrame([(i % 2, (1e8 + x).tolist()) for i, x in enumerate(base)], "g int, v array<double>").repartition(7)
    got = M.moment_stats(M.array_moments(rows, "v", ["g"]), ["g"]).collect()
    for r in got:
        exact = (1e8 + base)[r["g"] :: 2]
        assert np.allclose(r["std"], (exact - exact.mean(axis=0)).std(axis=0, ddof=1), rtol=1e-6)
        assert np.allclose(r["mean"], exact.mean(axis=0), rtol=1e-15)
    assert len(got) == 2


def test_the_same_as_an_expression_for_each_dimension(spark, monkeypatch):
    monkeypatch.setattr(M, "HELD_GROUPS", 2)
    rows = spark.range(500).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 13)).alias("g"), (F.col("id") % 2).alias("h"), F.array(*[F.sin(F.col("id") * k) for k in range(1, 5)]).alias("v")).repartition(6)
    order = lambda df: sorted((tuple(r[c] for c in ("g", "h") if c in df.columns), r["mean"], r["std"]) for r in df.collect())
    for by in (["g"], ["g", "h"], []):
        a, b = order(M.normalizer_stats(rows, "v", 4, by)), order(M.moment_stats(M.array_moments(rows, "v", by), by))
        assert [x[0] for x in a] == [x[0] for x in b]
        for x, y in zip(a, b, strict=True):
            assert x[1] == pytest.approx(y[1], abs=1e-12) and x[2] == pytest.approx(y[2], abs=1e-12)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(None, [1.0]), (None, [3.0]), (1, [5.0]), (2, None)], "g int, v array<double>")
    got = {r["g"]: (r["n"], r["mean"]) for r in M.array_moments(rows, "v", ["g"]).collect()}
    assert got == {None: (2, [2.0]), 1: (1, [5.0])}
    assert {r["g"]: r["std"] for r in M.moment_stats(M.array_moments(rows, "v", ["g"]), ["g"]).collect()}[1] == [None]
    assert M.array_moments(rows.filter("false"), "v", ["g"]).collect() == M.array_moments(rows.filter("false"), "v").collect() == []
    unlike = spark.createDataFrame([(1, [5.0]), (1, [5.0, 6.0])], "g int, v array<double>")
    with pytest.raises(Exception, match="unlike|elements in one group"):
        M.array_moments(unlike, "v", ["g"]).collect()
