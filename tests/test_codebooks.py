"""Codebooks in blocks against brute force, and fits whose codes are all alive."""

from __future__ import annotations

import random

import numpy as np
import pytest

from episodica.operators import codebooks as CB
from episodica.operators import latents as E

VECTORS = "i long, g string, vec array<double>, block int, copy string"


def brute(vectors, codes):
    out = {}
    book = [(c, np.array(v)) for c, v in codes if v is not None]
    for i, g, v, *_ in vectors:
        if v is None or not book:
            out[i, g] = (None, None)
        else:
            d, c = min((float(((np.array(v) - w) ** 2).sum()), c) for c, w in book)
            out[i, g] = (c, d)
    return out


def made(seed, n=300, k=120, d=4, groups=9):
    """Codes and vectors in groups of very different widths; repeated codes; vectors that are codes; nulls."""
    r = random.Random(seed)
    middles = [([r.uniform(-50, 50) for _ in range(d)], r.choice([0.0, 0.1, 3.0, 40.0])) for _ in range(groups)]
    point = lambda: [m + w * r.gauss(0, 1) for m, w in [r.choice(middles)] for m in m]
    codes = [(f"c{i:03}", point()) for i in range(k)]
    codes += [("a_copy", codes[5][1]), ("z_copy", codes[5][1]), ("none", None)]
    vectors = [(i, r.choice(["x", None]), r.choice(codes)[1] if r.random() < 0.2 else point(), 1, "y") for i in range(n)]
    return [*vectors, (n, "x", None, 1, "y"), (None, "x", point(), 1, "y")], codes


@pytest.mark.parametrize("seed,pivots,block_bytes,share", [(1, 256, 32_000_000, 500_000), (2, 5, 400, 50), (3, 1, 64, 7), (4, 40, 32, 1000)])
def test_blocks_give_the_nearest_code(spark, seed, pivots, block_bytes, share):
    vectors, codes = made(seed)
    df, book = spark.createDataFrame(vectors, VECTORS).repartition(3), spark.createDataFrame(codes, "code string, code_vec array<double>")
    got = {(r["i"], r["g"]): (r["code"], r["distance"]) for r in CB.assign_in_blocks(df, book, ["i", "g"], pivots=pivots, block_bytes=block_bytes, share=share).collect()}
    want = {k: v for k, v in brute(vectors, codes).items() if v[0] is not None}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(v[1] == pytest.approx(want[k][1], abs=1e-9) for k, v in got.items())


def test_a_book_beyond_the_limit_gives_the_same_rows(spark):
    vectors, codes = made(6)
    df, book = spark.createDataFrame(vectors, VECTORS), spark.createDataFrame(codes, "code string, code_vec array<double>")
    rows = lambda x: sorted((tuple(round(e, 9) if isinstance(e, float) else e for e in (r["i"], r["g"], r["code"], r["error"])) for r in x.collect()), key=repr)
    small, large = E.assign_codes(df, book, beta=0.25), E.assign_codes(df, book, beta=0.25, max_bytes=100, key=["i", "g"])
    assert rows(small) == rows(large) and small.columns == large.columns
    with pytest.raises(ValueError, match="key"):
        E.assign_codes(df, book, max_bytes=100)
    assert {r["code"] for r in E.assign_codes(df, book.limit(0), max_bytes=-1, key=["i", "g"]).collect()} == {None}


def test_groups_far_apart(spark):
    codes = [(i, [1000.0 * (i % 10), float(i % 7)]) for i in range(200)]
    vectors = [(i, "x", [1000.0 * (i % 10) + 0.3, 0.2], 1, "y") for i in range(100)]
    found = CB.assign_in_blocks(spark.createDataFrame(vectors, VECTORS), spark.createDataFrame(codes, "code long, code_vec array<double>"), ["i"], pivots=60)
    assert {r["i"]: r["code"] for r in found.collect()} == {k[0]: v[0] for k, v in brute(vectors, codes).items()}


def grouped(spark, k=6, each=40):
    r = random.Random(5)
    rows = [([100.0 * (g % 3) + r.uniform(-1, 1), 100.0 * (g // 3) + r.uniform(-1, 1)],) for g in range(k) for _ in range(each)]
    r.shuffle(rows)
    return spark.createDataFrame([*rows, (None,)], "vec array<double>").repartition(3)


def test_no_code_is_dead_after_a_bad_start(spark):
    """All codes start in one corner, so that most are dead; each group ends with one."""
    rows = grouped(spark)
    start = [[-500.0 - i, -500.0] for i in range(6)]
    plain = CB.fit_live_codebook(rows, start, rounds=1).collect()
    assert sum(r["n"] < 2 for r in plain) >= 4
    fitted = CB.fit_live_codebook(rows, start)
    assert sorted((round(r["code_vec"][0] / 100), round(r["code_vec"][1] / 100), r["n"]) for r in fitted.collect()) == sorted((g % 3, g // 3, 40) for g in range(6))
    usage = E.code_usage(E.assign_codes(rows, fitted), fitted).first()
    assert usage["dead"] == 0 and usage["used"] == 1.0
    again = CB.fit_live_codebook(rows.repartition(5), start)
    assert np.allclose(*[sorted(r["code_vec"] for r in x.collect()) for x in (fitted, again)])


def test_more_codes_than_vectors_and_none(spark):
    few = spark.createDataFrame([([1.0],), ([1.0],), ([9.0],)], "vec array<double>")
    got = CB.fit_live_codebook(few, [[0.0], [0.5], [0.7], [-4.0]]).collect()
    assert len(got) == 4 and sum(r["n"] for r in got) == 3 and {1.0, 9.0} <= {r["code_vec"][0] for r in got}
    assert [r["n"] for r in CB.fit_live_codebook(few.limit(0), [[0.0], [1.0]]).collect()] == [0, 0]
