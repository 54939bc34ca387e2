"""The segmented scan and the dealt windows against the windows that take an actor whole, and their plans."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from episodica.operators import windows as W


def log(spark, n=600, seed=4, ends=0.1):
    """One actor has nine tenths of the rows; ties in time, rows out of order, null actors, ends and times, and a clashing column."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        actor = None if r.random() < 0.02 else 0 if r.random() < 0.9 else r.randint(1, 3)
        seconds = None if r.random() < 0.01 else r.randint(-50, 900)
        rows.append((actor, seconds, i, float(r.randint(0, 9)), None if r.random() < 0.02 else r.random() < ends, i))
    made = spark.createDataFrame(rows, "actor long, s long, event_id long, reward double, done boolean, block_of long")
    return made.select("actor", F.timestamp_seconds("s").alias("ts"), "event_id", "reward", "done", "block_of")


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("span,ends", [(1, 0.1), (60, 0.1), (60, 0.0), (60, 1.0), (10**6, 0.3), (0.5, 0.02)])
def test_the_same_ids_whatever_the_span(spark, span, ends):
    made = log(spark, ends=ends).repartition(5)
    assert rows_of(W.assign_ids(made, span=span)) == rows_of(W.assign_ids(made))


def test_numbers_as_time_and_no_rows(spark):
    made = log(spark).withColumn("ts", F.unix_seconds("ts"))
    assert rows_of(W.assign_ids(made, span=100)) == rows_of(W.assign_ids(made))
    assert W.assign_ids(made.filter("false"), span=100).collect() == []


@pytest.mark.parametrize("block,ends", [(3, 0.1), (7, 0.3), (64, 0.0), (1000, 0.1)])
def test_windows_over_blocks(spark, block, ends):
    steps = W.assign_ids(log(spark, ends=ends).filter("actor IS NOT NULL")).cache()
    dealt = W.deal(steps, 2, 2, block=block)
    assert rows_of(W.undeal(dealt)) == rows_of(steps)
    for name, run in {
        "stack": lambda s: W.frame_stack(s, 3, "event_id"),
        "nstep": lambda s: W.nstep_return(s, 3, 0.9),
        "valid": lambda s: W.valid_start(s, 3, 40),
        "all ahead": lambda s: W.valid_start(s, 3),
    }.items():
        assert rows_of(W.undeal(run(dealt))) == rows_of(run(steps)), name
    both = W.nstep_return(W.frame_stack(dealt, 3, "event_id"), 3, 0.9)
    assert rows_of(W.undeal(both)) == rows_of(W.nstep_return(W.frame_stack(steps, 3, "event_id"), 3, 0.9))
    with pytest.raises(ValueError, match="too short"):
        W.deal(steps, 3, 2, block=3)



def test_rolling_means_in_blocks(spark):
    r = random.Random(6)
    rows = [("hot" if r.random() < 0.8 else r.choice(["a", None]), i * r.randint(1, 2), i, r.uniform(0, 9) if i % 11 else None, 1) for i in range(500)]
    df = spark.createDataFrame(rows, "name string, step long, i long, value double, episode int").repartition(4)
    for size, block in ((5, 7), (3, 100), (1, 2)):
        plain = W.rolling_mean(df, size, ["value", "i"], ["name"], ["step", "i"])
        parts = W.rolling_mean(df, size, ["value", "i"], ["name"], ["step", "i"], span=40, block=block)
        assert parts.columns == plain.columns
        near = lambda x: sorted(((tuple(round(v, 9) if isinstance(v, float) else v for v in row)) for row in x.collect()), key=repr)
        assert near(parts) == near(plain)


def test_a_hot_actor_is_spread_and_the_rows_go_over_once(spark, tmp_path):
    made = log(spark, n=4000).withColumn("frame", F.repeat(F.lit("x"), 50))
    path = str(tmp_path / "log")
    made.write.parquet(path)
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = W.assign_ids(spark.read.parquet(path), span=20)
        plan = found._jdf.queryExecution().executedPlan().toString()
        wide = [x for x in re.split(r"\n", plan) if "Exchange hashpartitioning(__at" in x]
        assert len(wide) == 3, plan  # the rows, four narrow columns of them for the sums, and the sums
        assert len([x for x in plan.split("\n") if "FileScan" in x and "frame" in x]) == 1
        sizes = [r["n"] for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < 0.5 * sum(sizes)
        dealt = W.nstep_return(W.deal(found, 0, 2, block=100), 3, 0.9)
        sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])


def test_draws_with_replacement(spark):
    import hashlib

    from episodica.operators import sampling as S

    digest = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    for n_rows in (1, 7, 5000):
        rows = [(i, i % 3, i % 4 != 1) for i in range(n_rows)]
        valid = spark.createDataFrame(rows, "i long, g long, valid boolean").repartition(3)
        order = sorted((r for r in rows if r[2]), key=lambda r: (digest(5, r[0], r[1]), r[:2]))
        for first, n in ((0, 400), (10**6, 300)):
            got = sorted((r["draw"], r["i"]) for r in S.draw_starts(valid, n, 5, ["i", "g"], first).collect())
            assert got == [(d, order[int(digest(5, d)[:12], 16) % len(order)][0]) for d in range(first, first + n)]
    none = spark.createDataFrame([(1, 1, False)], "i long, g long, valid boolean")
    assert S.draw_starts(none, 10, 5, ["i"]).collect() == []
    plan = S.draw_starts(valid, 400, 5, ["i", "g"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SinglePartition" not in plan
