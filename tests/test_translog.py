"""The append log: commits, retries, writers at once, and a streaming source with positions, restarts and admission."""

from __future__ import annotations

import shutil
import threading
import time

import pytest
from pyspark.sql import functions as F

from episodica.sources import translog as L


def part(spark, a, b, n=2):
    at = F.timestamp_micros(F.col("id") * 1_000_001)
    return spark.range(a, b, numPartitions=n).select("id", at.alias("ts"), F.when(F.col("id") % 3 > 0, F.col("id") / 2).alias("reward"), F.array(F.col("id").cast("float")).alias("obs"))


def drain(stream, folder, name="out", **trigger):
    query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-log").trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    return query


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_a_restart_reads_no_row_twice(spark, tmp_path):
    path = str(tmp_path / "log")
    made = []
    for a, b in [(0, 50), (50, 51), (51, 51), (51, 300)]:
        assert L.append_log(part(spark, a, b), path) == b
        made.append(b)
        drain(L.stream_log(spark, path, rowsPerTask=40), tmp_path)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert ids(got) == list(range(300)) and ids(L.read_log(spark, path)) == list(range(300))
    assert got.filter("id <> log_position").count() == 0  # spark.range's files are in its order
    want = part(spark, 0, 300)
    assert got.select(want.columns).exceptAll(want).count() == 0


def test_admission_and_a_stop_in_the_middle(spark, tmp_path):
    path = str(tmp_path / "log")
    L.append_log(part(spark, 0, 100, 3), path)
    L.append_log(part(spark, 100, 170, 1), path)
    sizes = []

    def put(batch, number):
        sizes.append(batch.count())
        batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={number}"))

    def start():
        stream = L.stream_log(spark, path, maxRowsPerTrigger=32, rowsPerTask=10)
        return stream.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()

    query = start()
    until = time.time() + 90
    while len(sizes) < 2 and time.time() < until:
        time.sleep(0.05)
    query.stop()  # wherever it is; the batch it was in is taken again
    assert len(sizes) >= 2
    query = start()
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert ids(got) == list(range(170)) and max(sizes) == 32


def test_a_batch_that_is_committed_to_the_offsets_alone_is_read_again(spark, tmp_path):
    path = str(tmp_path / "log")
    L.append_log(part(spark, 0, 40), path)
    drain(L.stream_log(spark, path), tmp_path)
    L.append_log(part(spark, 40, 60), path)
    drain(L.stream_log(spark, path), tmp_path)
    (tmp_path / "out-log" / "commits" / "1").unlink()  # as if the driver was lost before the batch was done
    (tmp_path / "out-log" / "commits" / ".1.crc").unlink(missing_ok=True)
    L.append_log(part(spark, 60, 75), path)
    for end in (60, 70, 75, 75):  # the batch again, then a step of ten a run
        drain(L.stream_log(spark, path, maxRowsPerTrigger=10), tmp_path)
        assert ids(spark.read.parquet(str(tmp_path / "out"))) == list(range(end))


def test_starting_positions_and_fewer_columns(spark, tmp_path):
    path = str(tmp_path / "log")
    L.append_log(part(spark, 0, 30, 1), path)
    L.append_log(part(spark, 30, 45, 1), path)
    for first, want in (("earliest", range(45)), ("latest", []), (17, range(17, 45))):
        drain(L.stream_log(spark, path, schema="id long", startingPosition=first), tmp_path, f"from-{first}")
        got = spark.read.schema("id long").parquet(str(tmp_path / f"from-{first}"))
        assert ids(got) == list(want)


def test_an_append_that_is_tried_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    for number, (a, b) in [(0, (0, 10)), (0, (0, 10)), (1, (10, 12)), (1, (10, 12)), (0, (0, 10))]:
        L.append_log(part(spark, a, b), path, "collector", number)
    L.append_log(part(spark, 12, 20), path, "other", 0)
    assert ids(L.read_log(spark, path)) == list(range(20))
    (tmp_path / "log" / "data" / "broken").mkdir()  # a run that broke off before its commit
    shutil.copy(next((tmp_path / "log" / "data").rglob("*.parquet")), tmp_path / "log" / "data" / "broken" / "part-0.parquet")
    assert ids(L.read_log(spark, path)) == list(range(20))


def test_writers_at_once_both_commit(spark, tmp_path):
    path = str(tmp_path / "log")
    failed = []

    def write(k):
        try:
            for i in range(4):
                L.append_log(part(spark, 100 * k + 10 * i, 100 * k + 10 * i + 10, 1), path, f"w{k}", i)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    assert ids(L.read_log(spark, path)) == [100 * k + i for k in range(3) for i in range(40)]
    commits = [L._Commits(path).load(n) for n in L._Commits(path).numbers()]
    assert [c["start"] for c in commits] == list(range(0, 120, 10)) and commits[-1]["writers"] == {"w0": 3, "w1": 3, "w2": 3}


def test_a_file_that_is_there_is_not_written_over(spark, tmp_path):
    (tmp_path / "c").mkdir()
    assert L.put_new(spark, "a", str(tmp_path / "c" / "v1")) and not L.put_new(spark, "b", str(tmp_path / "c" / "v1"))
    assert (tmp_path / "c" / "v1").read_text() == "a" and not list((tmp_path / "c").glob("_staged*"))


def test_dropped_rows_are_an_error_for_who_needs_them(spark, tmp_path):
    path = str(tmp_path / "log")
    for a in range(0, 40, 10):
        L.append_log(part(spark, a, a + 10), path)
    drain(L.stream_log(spark, path, startingPosition=35), tmp_path, "late")
    assert L.drop_before(spark, path, 25) == 20
    assert len(list((tmp_path / "log" / "data").iterdir())) == 2 and ids(L.read_log(spark, path)) == list(range(20, 40))
    drain(L.stream_log(spark, path), tmp_path, "new")
    assert ids(spark.read.parquet(str(tmp_path / "new"))) == list(range(20, 40))
    with pytest.raises(Exception, match="have been dropped"):
        drain(L.stream_log(spark, path, startingPosition=5), tmp_path, "old")
    assert L.drop_before(spark, path, 1000) == 30 and L.append_log(part(spark, 40, 50), path) == 50


def test_other_schemas_and_absent_logs_are_errors(spark, tmp_path):
    path = str(tmp_path / "log")
    L.append_log(part(spark, 0, 0), path)
    assert L.read_log(spark, path).count() == 0
    with pytest.raises(ValueError, match="another schema"):
        L.append_log(spark.range(3), path)
    with pytest.raises(ValueError, match="own column"):
        L.append_log(spark.range(3).withColumnRenamed("id", "log_position"), str(tmp_path / "b"))
    with pytest.raises(ValueError, match="no log"):
        L.read_log(spark, str(tmp_path / "none"))
