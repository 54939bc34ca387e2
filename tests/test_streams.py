"""Streams over several files, with a restart in the middle, against their batch counterparts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from episodica.operators import windows as W
from episodica.streaming import replay as R

SCHEMA = "actor long, ts timestamp, event_id long, reward double, done boolean, success boolean"


def log(spark, n=240):
    """Three actors; episodes of about seven steps, so that many cross the files' ends."""
    r = random.Random(4)
    rows = [(i % 3, 1_600_000_000 + 10 * i, i, float(r.randint(0, 9)), r.random() < 0.14, r.random() < 0.3) for i in range(n)]
    return spark.createDataFrame(rows, "actor long, s long, event_id long, reward double, done boolean, success boolean").select("actor", F.timestamp_seconds("s").alias("ts"), "event_id", "reward", "done", "success")


def run(spark, made, folder, stream_of, cuts=(50, 90, 170, 240)):
    """The files come one by one; the query starts anew for each, from its checkpoint, and takes one file a trigger."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", R.STATE_STORE)
    begin = 0
    for end in cuts:
        made.filter(f"event_id >= {begin} AND event_id < {end}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        begin = end
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        query = stream_of(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
        query.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(f"{folder}/out")


def rows_of(df, *columns):
    return sorted(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def test_numbers_go_on_over_files_and_restarts(spark, tmp_path):
    made = log(spark)
    got = run(spark, made, tmp_path, R.ingest_transitions)
    names = ("actor", "event_id", "transition_id", "episode", "step", "state_id")
    assert rows_of(got, *names) == rows_of(W.assign_ids(made), *names)


def last_of(steps):
    return steps.groupBy("actor").agg(F.max_by(F.struct("transition_id", "episode", "step", "done"), "transition_id").alias("l")).select("actor", "l.*")


NAMES = ("actor", "event_id", "transition_id", "episode", "step", "state_id")


def test_numbers_follow_the_batch_tables(spark, tmp_path):
    """The first part is a table, the rest a stream of three files: together they are one batch."""
    made = log(spark)
    last = last_of(W.assign_ids(made.filter("event_id < 60")))
    got = run(spark, made.filter("event_id >= 60"), tmp_path, lambda s: R.ingest_transitions(s, last))
    assert rows_of(got, *NAMES) == rows_of(W.assign_ids(made).filter("event_id >= 60"), *NAMES)


def test_batches_of_a_hot_actor_go_on(spark, tmp_path):
    """Nine tenths of the rows are one actor's; a batch is tried again, one is empty, and the first follows a table."""
    made = log(spark).withColumn("actor", F.when(F.col("event_id") % 10 < 9, 0).otherwise(F.col("actor")).cast("long"))
    last = last_of(W.assign_ids(made.filter("event_id < 40")))
    cuts = [40, 90, 90, 170, 240]
    for again in (False, True):
        for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
            for _ in range(1 + again):
                R.ingest_batch(made.filter(f"event_id >= {a} AND event_id < {b}"), number, str(tmp_path / f"{again}"), last, span=200)
        got = R.read_ingested(spark, str(tmp_path / f"{again}"))
        assert rows_of(got, *NAMES) == rows_of(W.assign_ids(made).filter("event_id >= 40"), *NAMES)
    assert len(list((tmp_path / "True" / "last").iterdir())) == 2


def test_idle_actors_of_batches_are_let_go(spark, tmp_path):
    rows = [(1, 0, 1), (2, 0, 2), (1, 100, 3), (1, 200, 4), (2, 210, 5)]
    made = spark.createDataFrame(rows, "actor long, s long, event_id long").select("actor", F.timestamp_seconds("s").alias("ts"), "event_id", F.lit(1.0).alias("reward"), F.lit(False).alias("done"), F.lit(False).alias("success"))
    for number, (a, b) in enumerate([(1, 3), (3, 4), (4, 6)]):
        R.ingest_batch(made.filter(f"event_id >= {a} AND event_id < {b}"), number, str(tmp_path), idle=50.0)
    got = {r["event_id"]: r["transition_id"] for r in R.read_ingested(spark, str(tmp_path)).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 2, 5: 0}  # actor 2 was let go when 1 acted at 100


def test_nstep_windows_cross_files(spark, tmp_path):
    made = log(spark)
    got = run(spark, made, tmp_path, lambda s: R.stream_nstep(s, 3, 0.9))
    want = W.nstep_return(W.assign_ids(made), 3, 0.9)
    names = ("actor", "event_id", "n_return", "n_discount")
    assert rows_of(got, *names) == rows_of(want, *names)


def test_rolling_episodes_cross_files(spark, tmp_path):
    made = log(spark)
    got = run(spark, made, tmp_path, lambda s: R.stream_rolling(s, 3))
    ended = W.assign_ids(made).groupBy("actor", "episode").agg(F.sum("reward").alias("ret"), F.max(F.col("success").cast("double")).alias("s"), F.max("done").alias("done")).filter("done")
    want = W.rolling_mean(ended, 3, ["ret", "s"], ["actor"], ["episode"])
    assert rows_of(got, "actor", "episode", "rolling_return", "rolling_success") == rows_of(want, "actor", "episode", "rolling_ret", "rolling_s")


def test_derived_rows_of_a_hot_actor_go_on(spark, tmp_path):
    """Nine tenths of the rows are one actor's, one actor is null; windows cross batches, blocks and empty batches; each batch is tried twice."""
    made = log(spark).withColumn("actor", F.when(F.col("event_id") % 10 < 9, 0).when(F.col("actor") > 0, F.col("actor")).cast("long"))
    steps = W.assign_ids(made).persist()
    for number, (a, b) in enumerate([(0, 50), (50, 51), (51, 51), (51, 170), (170, 240)]):
        for _ in range(2):
            part = steps.filter(f"event_id >= {a} AND event_id < {b}")
            R.nstep_batch(part, number, str(tmp_path / "n"), 4, 0.9, block=16)
            R.rolling_batch(part, number, str(tmp_path / "r"), 3, span=4)
    names = ("actor", "event_id", "n_return", "n_discount")
    key = lambda r: tuple((x is not None, x) for x in r)
    plain = lambda df, *c: sorted((tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.select(*c).collect()), key=key)
    assert plain(R.read_derived(spark, str(tmp_path / "n")), *names) == plain(W.nstep_return(steps, 4, 0.9), *names)
    ended = steps.groupBy("actor", "episode").agg(F.sum("reward").alias("ret"), F.max(F.col("success").cast("double")).alias("s"), F.max("done").alias("done")).filter("done")
    want = W.rolling_mean(ended, 3, ["ret", "s"], ["actor"], ["episode"])
    assert plain(R.read_derived(spark, str(tmp_path / "r")), "actor", "episode", "rolling_return", "rolling_success") == plain(want, "actor", "episode", "rolling_ret", "rolling_s")
    for name, most in (("n", 9), ("r", 9)):  # three actors, n - 1 transitions or size - 1 ended episodes and an open one of each
        held = sorted((tmp_path / name / "held").iterdir())
        assert len(held) == 2 and spark.read.parquet(str(held[-1])).count() <= most


def test_what_is_held_of_idle_actors_goes(spark, tmp_path):
    rows = [(1, 0, 1), (2, 0, 2), (1, 100, 3), (1, 200, 4), (2, 210, 5), (2, 220, 6)]
    made = spark.createDataFrame(rows, "actor long, s long, event_id long").select("actor", F.timestamp_seconds("s").alias("ts"), "event_id", F.lit(1.0).alias("reward"), F.lit(False).alias("done"), F.lit(False).alias("success"))
    out = str(tmp_path / "in")
    for number, (a, b) in enumerate([(1, 3), (3, 4), (4, 7)]):
        R.ingest_batch(made.filter(f"event_id >= {a} AND event_id < {b}"), number, out, idle=50.0)
        R.nstep_batch(spark.read.parquet(f"{out}/steps/batch={number}"), number, str(tmp_path / "n"), 2, 1.0)
    got = rows_of(R.read_derived(spark, str(tmp_path / "n")), "actor", "event_id", "n_return")
    assert got == [(1, 1, 2.0), (1, 3, 2.0), (2, 5, 2.0)]  # actor 2 began anew at 210: its first row has no second


def test_retention_is_idempotent_and_bounded(spark, tmp_path):
    path = str(tmp_path / "newest")
    part = lambda a, b: spark.range(a, b).withColumnRenamed("id", "transition_id")
    for number, (a, b) in enumerate([(0, 10), (10, 25), (10, 25), (25, 60)]):
        R.retain_newest(part(a, b), min(number, 1) if number < 3 else 2, path, 12)
        assert sorted(r[0] for r in R.read_newest(spark, path, 12).collect()) == list(range(max(0, b - 12), b))
    R.retain_newest(part(25, 60), 2, path, 12)  # tried again
    assert sorted(r[0] for r in R.read_newest(spark, path, 12).collect()) == list(range(48, 60))
    assert len(list((tmp_path / "newest").glob("id_range=*"))) <= 5
    R.retain_newest(part(0, 0), 3, path, 12)
    assert R.read_newest(spark, path, 12).count() == 12


def test_retention_writes_only_what_it_keeps(spark, tmp_path):
    """Rows that the newest ids of the batch or of the table push out reach no folder, whatever their number; rows without an id are never kept."""
    path = str(tmp_path / "newest")
    part = lambda a, b: spark.range(a, b).withColumnRenamed("id", "transition_id")
    folders = lambda: len(list((tmp_path / "newest").glob("id_range=*/batch=*")))
    rows = lambda: sorted(r[0] for r in R.read_newest(spark, path, 12).collect())
    R.retain_newest(part(1000, 1100), 0, path, 12)
    for number in (1, 1, 2):  # older rows, tried again, and more of them
        R.retain_newest(part(0, 300 * number), number, path, 12)
        assert rows() == list(range(1088, 1100)) and folders() <= 5
    R.retain_newest(part(500, 1092), 3, path, 12)  # late, but some of them are among the newest
    assert rows() == sorted([*range(1088, 1100), *range(1088, 1092)])
    mixed = part(1100, 1110).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS transition_id"))
    R.retain_newest(mixed, 4, path, 12)
    assert rows() == list(range(1098, 1110)) and not list((tmp_path / "newest").glob("id_range=__*"))


def test_a_small_table_outlives_a_run_that_breaks_off(spark, tmp_path):
    path, part = tmp_path / "small", lambda a, b: spark.range(a, b).withColumnRenamed("id", "transition_id")
    R.keep_newest(part(0, 10), str(path), 7)
    path.rename(tmp_path / "small-before")  # as if the run ended between two names
    R.keep_newest(part(10, 12), str(path), 7)
    assert sorted(r[0] for r in spark.read.parquet(str(path)).collect()) == list(range(5, 12))
    assert not (tmp_path / "small-before").exists() and not (tmp_path / "small-next").exists()


def test_files_stay_few_over_a_hundred_batches(spark, tmp_path):
    path = str(tmp_path / "newest")
    part = lambda a, b: spark.range(a, b, numPartitions=1).withColumnRenamed("id", "transition_id")
    rows = lambda: sorted(r[0] for r in R.read_newest(spark, path, 300).collect())
    merged, before = 0, None
    for number in range(100):
        R.retain_newest(part(4 * number, 4 * number + 4), number, path, 300, width=100)
        if number % 10 == 9:
            before = R._folders(spark, path, R._manifest(spark, path)[1])
            merged += R.compact(spark, path, least=5)
            assert spark.read.parquet(*[x for _, x in before]).count() == spark.read.parquet(*[x for _, x in R._folders(spark, path, R._manifest(spark, path)[1])]).count()
        if number % 25 == 0:
            assert rows() == list(range(max(0, 4 * number + 4 - 300), 4 * number + 4))
    assert merged >= 8 and rows() == list(range(100, 400))
    R.retain_newest(part(396, 400), 99, path, 300, width=100)  # the newest batch again, after a run of compact
    assert rows() == list(range(100, 400))
    folders = {}
    for (name, _), folder in R._folders(spark, path, R._manifest(spark, path)[1]):
        folders[name] = folders.get(name, 0) + 1
    assert max(folders.values()) <= 11 and len(list((tmp_path / "newest").rglob("*.parquet"))) < 60
    (tmp_path / "newest" / "_compact" / "broken").mkdir()  # a run that broke off before its manifest
    assert rows() == list(range(100, 400)) and R.compact(spark, path, least=50) == 0


def test_metric_sinks(spark):
    rows = spark.createDataFrame([(0, 1.0), (5, 2.0), (10, float("nan")), (20, 3.0)], "step long, value double")
    full, thin = R.metric_sinks(rows, 10)
    assert full.count() == 4 and sorted(r["step"] for r in thin.collect()) == [0, 20]


def test_a_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from episodica.plans.stream_queries import shared

    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

    class Session:
        conf, sparkContext = spark.conf, Context

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() and not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            shared(Session, "x")
