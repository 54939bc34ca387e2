"""Bucketed datasets by their plans, and large JSON maps by byte ranges."""

from __future__ import annotations

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from episodica.plans import source_queries as Q
from episodica.sources import episodes as S
from episodica.sources import jsonmap as JM
from episodica.sources import layout as LY
from episodica.sources.episodes import Dataset


def dataset(spark, n=200):
    key = F.concat(F.lit("demo"), F.col("id"))
    episodes = spark.range(n).select(key.alias("episode"), (F.col("id") % 5).alias("num_samples"))
    cameras = spark.range(2 * n).select(F.concat(F.lit("demo"), F.expr("id div 2")).alias("episode"), F.concat(F.lit("cam"), F.col("id") % 2).alias("camera"))
    steps = spark.range(5 * n).select(F.concat(F.lit("demo"), F.expr("id div 5")).alias("episode"), (F.col("id") % 5).alias("t"))
    return Dataset(episodes, cameras, steps, steps.withColumn("rgb", F.lit(b"x")))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_by_episode_need_no_exchange(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    name = "d" + uuid.uuid4().hex
    try:
        data = LY.store_dataset(dataset(spark), str(tmp_path), name, buckets=8)
        views = data.cameras.groupBy("episode").agg(F.count("*").alias("n_cameras"))
        rows = data.frames.groupBy("episode").agg(F.count("*").alias("n_frames"))
        met = data.episodes.join(views, "episode").join(rows, "episode").join(data.steps, "episode")
        assert "Exchange" not in plan_of(met) and met.count() == 1000
        for table in ("episodes", "frames"):
            assert len(list((tmp_path / table).glob("*.parquet"))) == 8
        spark.sql(f"DROP TABLE {name}_frames")  # another session, which knows the files alone
        again = LY.open_dataset(spark, str(tmp_path), name, buckets=8)
        assert "Exchange" not in plan_of(again.episodes.join(again.frames, "episode"))
        assert again.frames.count() == 1000 and again.total == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_capped_episodes_prune_buckets(spark, tmp_path, monkeypatch):
    name = "d" + uuid.uuid4().hex
    data = LY.store_dataset(dataset(spark), str(tmp_path), name, buckets=32)
    few = LY.first_of(data, 3)
    assert sorted(r[0] for r in few.episodes.select("episode").collect()) == ["demo0", "demo1", "demo2"]
    assert few.frames.count() == 15 and few.cameras.count() == 6
    plan = plan_of(few.frames.groupBy("episode").count())
    assert "SelectedBucketsCount: 3 out of 32" in plan or "SelectedBucketsCount: 2 out of 32" in plan, plan
    assert "In(episode, [demo0,demo1,demo2])" in plan
    monkeypatch.setattr(LY, "NAMED", 2)
    assert sorted(r[0] for r in LY.first_of(data, 3).episodes.select("episode").collect()) == ["demo0", "demo1", "demo2"]
    with pytest.raises(ValueError, match="more than 2"):
        LY.only(data, ["a", "b", "c"])
    assert LY.first_of(data, 10**6).steps.count() == 1000


def entries(n, seed=1):
    r = random.Random(seed)
    text = lambda: "".join(r.choice('ab{}[]":,\\\n é日') for _ in range(r.randint(0, 12)))
    return [(f"{text()}{i}" if i % 3 else f"k{i // 9}", {"name": text(), "inner": {"x": i, "s": text()}, "list": [{"y": r.random()} for _ in range(i % 4)]}) for i in range(n)]


DDL = "struct<name:string,inner:struct<x:long,s:string>,list:array<struct<y:double>>>"


@pytest.mark.parametrize("indent,size", [(None, 40), (2, 64), (None, 100_000), (1, 700)])
def test_a_map_in_byte_ranges(spark, tmp_path, indent, size):
    """Ranges of a few bytes: entries, strings and escapes lie across their ends."""
    files = {}
    for f in range(2):
        rows = entries(60, seed=f)
        body = (",\n " if indent else ",").join(f"{json.dumps(k, ensure_ascii=f == 0)}: {json.dumps(v, indent=indent, ensure_ascii=f == 0)}" for k, v in rows)
        (tmp_path / f"{f}.json").write_text("\n {" + body + "}" + "\n" * f)
        want, place = {}, {}
        for i, (k, v) in enumerate(rows):
            place.setdefault(k, i)
            want[k] = v
        files[f] = {(place[k], k, json.dumps(v, sort_keys=True)) for k, v in want.items()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        found = JM.read_json_map(spark, str(tmp_path), DDL).collect()
        tasks = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert size > 1000 or tasks > 10
    for f, want in files.items():
        got = {(r["position"], r["key"], json.dumps(r["value"].asDict(recursive=True), sort_keys=True)) for r in found if r["path"].endswith(f"{f}.json")}
        assert got == want


def test_empty_maps(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.json").write_text("")
    (tmp_path / "c.json").write_text(' {"a": {"name": "}"} }\n')
    got = JM.read_json_map(spark, str(tmp_path), DDL).collect()
    assert [(r["position"], r["key"], r["value"]["name"]) for r in got] == [(0, "a", "}")]


def test_metadata_of_many_folders_takes_few_tasks(spark, tmp_path):
    """Rows and types are those of Spark's own reader, also of lists, broken, empty and UTF-16 files; the files are listed and read by few tasks."""
    odd = {"list": b'[{"n": 1}, {"n": 2.5}]', "broken": b'{"n": ', "bytes": b'{"n": "\xff"}', "empty": b"", "wide": '{"s": "\u00e9", "only": null}'.encode("utf-16"), "mark": b'\xef\xbb\xbf{"n": 3}', "_hidden": b'{"n":\n 4}'}
    texts = odd | {f"e{i}": json.dumps({"n": i, "inner": {"t": [i]}}, indent=1).encode() for i in range(60)}
    for folder, content in texts.items():
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "metadata.json").write_bytes(content)
    (tmp_path / "metadata.json").write_text('{"n": 5}')  # in no folder
    (tmp_path / "e0" / "deeper").mkdir()
    (tmp_path / "e0" / "deeper" / "metadata.json").write_text('{"n": 6}')
    sc = spark.sparkContext
    sc.setJobGroup("metadata", "metadata")
    found = S.read_episode_metadata(spark, str(tmp_path))
    got = found.collect()
    sc.setLocalProperty("spark.jobGroup.id", None)
    status = sc.statusTracker()
    tasks = [status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup("metadata") for s in status.getJobInfo(j).stageIds]
    want = spark.read.option("multiLine", True).json(f"{tmp_path}/*/metadata.json")
    assert found.drop("episode").schema == want.schema
    plain = lambda rows: sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in rows)
    assert plain(got) == plain(want.withColumn("episode", F.element_at(F.split("_metadata.file_path", "/"), -2)).collect())
    assert max(tasks) <= 4 * sc.defaultParallelism < 60, tasks


def test_the_metadata_query_writes_its_folders_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "shared", lambda spark, name: str(tmp_path / name))
    customers = spark.range(3000).select(F.col("id").alias("c_custkey"), F.format_string("c%05d", "id").alias("c_name"))
    customers.write.parquet(str(tmp_path / "customer.parquet"))
    got = {tuple(r[x] for x in ("episode", "num_frames", "task")) for r in Q.s6(spark, str(tmp_path)).collect()}
    assert got == {(f"demo{i}", 100, f"c{100 * i + 99:05d}") for i in range(30)}
    files = list((tmp_path / "metadata").glob("folder=*/*.json"))
    assert len(files) == 30 and len({f.name[:10] for f in files}) > 3
