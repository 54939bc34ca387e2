"""The plane that embeddings are projected to is fitted on, and shown for, the whole table."""

from __future__ import annotations

from episodica.plans import metric_queries as M
from episodica.plans import tables as T

DATA = "/root/testdata/sf0.001"


def test_every_vector_is_embedded(spark):
    rows = M.l13(spark, DATA).collect()
    latents = T.latents(spark, DATA)
    assert len(rows) == latents.count()
    assert {r["batch_id"] for r in rows} == {r[0] for r in latents.select("batch_id").distinct().collect()}


def test_signs_and_centres(spark):
    from episodica.operators import joins as J
    from episodica.operators import latents as E

    points = [(i, [0.1 * (i % 2), 5.0 * (i % 3), -0.1 * (i % 2)]) for i in range(30)]
    rows = spark.createDataFrame(points, "i int, vec array<double>")
    codes = sorted(r["code_vec"] for r in E.fit_codebook(rows, 3).collect())
    assert [[round(x, 6) for x in c] for c in sorted(codes, key=lambda c: c[1])] == [[0.05, y, -0.05] for y in (0.0, 5.0, 10.0)]
    first, again = (E.embed_2d(x, "vec").orderBy("i").collect() for x in (rows, rows.repartition(7)))
    assert all(abs(a["x"] - b["x"]) < 1e-9 for a, b in zip(first, again, strict=True))
    assert all(r["x"] > 0 for r in first if r["i"] % 3)  # the largest loading, the second dimension's, is positive

    done = spark.createDataFrame([(1,), (1,), (None,)], "i int")
    found, todo = J.already_computed(spark.createDataFrame([(1,), (2,), (None,)], "i int"), done, ["i"])
    assert [r[0] for r in found.collect()] == [1] and {r[0] for r in todo.collect()} == {2, None}
