"""Streams of transitions, episodes and metrics. Each gives what its batch counterpart gives on the whole log."""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from episodica.operators.windows import BLOCK, SPAN, deal, nstep_return, rolling_mean, undeal
from episodica.sources.episodes import add_transitions
from episodica.sources.translog import put_new

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of a micro-batch by time, as columns."""
    return pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable", ignore_index=True)


class _Numbering(StatefulProcessor):
    """The next ids of one actor. Rows of a micro-batch are numbered by time; a later batch's follow."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "transition_id long, episode long, step long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[-1]
        done = bool(row["done"])
        self.next.update((int(row["transition_id"]) + 1, int(row["episode"]) + done, 0 if done else int(row["step"]) + 1))

    def handleInputRows(self, key, rows, timerValues):
        t, episode, step = self.next.get() if self.next.exists() else (0, 0, 0)
        found = _ordered(rows)
        done, at = found["done"].to_numpy(bool), np.arange(len(found))
        ended = np.r_[0, np.cumsum(done)[:-1]]  # episodes that ended before
        begin = np.maximum.accumulate(np.where(np.r_[True, done[:-1]], at, 0))
        found["transition_id"], found["episode"] = t + at, episode + ended
        found["step"] = at - begin + np.where(ended == 0, step, 0)
        found["state_id"] = found["transition_id"] + found["episode"]
        self.next.update((int(t + len(found)), int(episode + done.sum()), 0 if done[-1] else int(found["step"].iloc[-1]) + 1))
        yield found.assign(actor=key[0])[["actor", "ts", "event_id", "reward", "done", "success", "transition_id", "episode", "step", "state_id"]]

    def close(self) -> None:
        pass


_LOG = "actor long, ts timestamp, event_id long, reward double, done boolean, success boolean"


def ingest_transitions(log: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """A stream of (actor, ts, event_id, reward, done, success) with transition_id, episode, step and state_id. State: three numbers an actor.

    Numbers follow those of ``last`` (each actor's last transition, as :func:`sources.episodes.add_transitions` takes it), which is read with the first
    micro-batch. A task holds an actor's rows of one micro-batch: where one actor may have most of them, :func:`ingest_batch` spreads them, and lets
    idle actors go.
    """
    schema = f"{_LOG}, transition_id long, episode long, step long, state_id long"
    first = None if last is None else last.select("actor", "transition_id", "episode", "step", "done").groupBy("actor")
    return log.groupBy("actor").transformWithStateInPandas(_Numbering(), schema, "Append", "None", initialState=first)


def ingest_batch(batch: DataFrame, number: int, path: str, last: DataFrame | None = None, idle: float | None = None, span: float = SPAN) -> None:
    """For foreachBatch: numbers micro-batch ``number`` behind all before it, whatever share of it one actor has; :func:`read_ingested` reads the rows.

    The rows are numbered by the segmented scan of :func:`windows.assign_ids`, so windows spill and an actor is as many tasks as it has stretches of
    ``span`` seconds. What goes on is a row an actor, its last transition, written with each batch; the first batch takes it from ``last``. Actors
    whose last transition is over ``idle`` seconds before the newest of all are let go, and begin at 0 when they come again. A batch that is
    tried again reads what the one before it left and overwrites its own folders, so nothing is numbered twice. Micro-batches are in the order of
    time, as the log is.
    """
    spark = batch.sparkSession
    earlier = sorted(int(x[6:]) for x in _listed(spark, f"{path}/last") if x.startswith("batch=") and int(x[6:]) < number)
    names = ["actor", "transition_id", "episode", "step", "done", "ts"]
    held = spark.read.parquet(f"{path}/last/batch={earlier[-1]}") if earlier else last
    if held is not None:
        held = held.select(*[F.col(c) if c in held.columns else F.lit(None).cast("timestamp").alias(c) for c in names])
    add_transitions(batch, held, span=span).write.mode("overwrite").parquet(f"{path}/steps/batch={number}")
    new = spark.read.parquet(f"{path}/steps/batch={number}").select(names)
    both = new if held is None else held.unionByName(new)
    newest = both.groupBy("actor").agg(F.max_by(F.struct(*names[1:]), "transition_id").alias("l")).select("actor", "l.*")
    if idle is not None:
        end = newest.agg(F.max("ts")).first()[0]
        newest = newest.filter(F.col("ts").isNull() | (F.unix_micros("ts") >= F.unix_micros(F.lit(end)) - int(idle * 1e6)))
    newest.write.mode("overwrite").parquet(f"{path}/last/batch={number}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in earlier[:-1]:  # the one before is needed if this batch is tried again
        fs.delete(hadoop.Path(f"{path}/last/batch={old}"), True)


def read_ingested(spark: SparkSession, path: str) -> DataFrame:
    """The rows that :func:`ingest_batch` numbered, of all its batches."""
    return spark.read.parquet(f"{path}/steps").drop("batch")


class _NStep(StatefulProcessor):
    """The last n - 1 transitions of an actor's open episode."""

    def __init__(self, n: int, gamma: float) -> None:
        self.n, self.gamma = n, gamma

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "event_id long, reward double, done boolean")

    def handleInputRows(self, key, rows, timerValues):
        held = [tuple(x) for x in self.open.get()]
        out = []
        new = _ordered(rows)
        for event, gain, ends in zip(new["event_id"].tolist(), new["reward"].tolist(), new["done"].tolist(), strict=True):
            held.append((event, gain, bool(ends)))
            if len(held) == self.n:
                total, factor = 0.0, 1.0
                for _, reward, done in held:
                    total += factor * reward
                    factor *= 0.0 if done else self.gamma
                out.append((key[0], held[0][0], total, factor))
                held = held[1:]
            if ends:
                held = []
        self.open.put(held) if held else self.open.clear()
        yield pd.DataFrame(out, columns=["actor", "event_id", "n_return", "n_discount"])

    def close(self) -> None:
        pass


def stream_nstep(log: DataFrame, n: int, gamma: float) -> DataFrame:
    """(actor, event_id, n_return, n_discount) of each start, when its n-th transition arrives; an episode's end cuts windows."""
    return log.groupBy("actor").transformWithStateInPandas(_NStep(n, gamma), "actor long, event_id long, n_return double, n_discount double", "Append", "None")


class _Rolling(StatefulProcessor):
    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "ret double, success double")
        self.now = handle.getValueState("now", "ret double, success double, episode long")

    def handleInputRows(self, key, rows, timerValues):
        last = [tuple(x) for x in self.last.get()]
        ret, success, episode = self.now.get() if self.now.exists() else (0.0, 0.0, 0)
        out = []
        new = _ordered(rows)
        for gain, won, ends in zip(new["reward"].tolist(), new["success"].tolist(), new["done"].tolist(), strict=True):
            ret, success = ret + gain, max(success, float(won))
            if ends:
                last = [*last, (ret, success)][-self.size :]
                out.append((key[0], episode, sum(x[0] for x in last) / len(last), sum(x[1] for x in last) / len(last)))
                ret, success, episode = 0.0, 0.0, episode + 1
        if last:
            self.last.put(last)
        self.now.update((ret, success, episode))
        yield pd.DataFrame(out, columns=["actor", "episode", "rolling_return", "rolling_success"])

    def close(self) -> None:
        pass


def stream_rolling(log: DataFrame, size: int) -> DataFrame:
    """(actor, episode, rolling_return, rolling_success) at each episode's end: means of the actor's last ``size`` episodes."""
    return log.groupBy("actor").transformWithStateInPandas(_Rolling(size), "actor long, episode long, rolling_return double, rolling_success double", "Append", "None")


def _held(steps: DataFrame, number: int, path: str) -> tuple[DataFrame | None, list[int]]:
    """What the micro-batch before ``number`` left at ``path``, without actors that begin anew in ``steps``; and the batches that left something."""
    spark = steps.sparkSession
    earlier = sorted(int(x[6:]) for x in _listed(spark, path) if x.startswith("batch=") and int(x[6:]) < number)
    if not earlier:
        return None, earlier
    anew = steps.filter("transition_id = 0").select(F.col("actor").alias("__anew")).distinct()
    held = spark.read.parquet(f"{path}/batch={earlier[-1]}")
    return held.join(anew, F.col("actor").eqNullSafe(F.col("__anew")), "left_anti"), earlier


def _hold(rows: DataFrame, number: int, path: str, earlier: list[int], idle: float | None) -> None:
    """Leaves ``rows`` (with ts) for the next micro-batch, without actors idle for over ``idle`` seconds. What the one before left stays for a retry."""
    spark = rows.sparkSession
    if idle is not None:
        end = rows.agg(F.max("ts")).first()[0]
        rows = rows.filter(F.col("ts").isNull() | (F.unix_micros("ts") >= F.unix_micros(F.lit(end)) - int(idle * 1e6)))
    rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in earlier[:-1]:
        fs.delete(hadoop.Path(f"{path}/batch={old}"), True)


def nstep_batch(steps: DataFrame, number: int, path: str, n: int, gamma: float, idle: float | None = None, block: int = BLOCK) -> None:
    """For foreachBatch: the rows of :func:`stream_nstep` for micro-batch ``number``, whatever share of it one actor has; :func:`read_derived` reads them.

    ``steps`` are the batch's numbered transitions, as :func:`ingest_batch` leaves them. What goes on is each open episode's last n - 1
    transitions, so a start waits for its n-th. An actor's rows are dealt into blocks of ``block`` with halos. A batch that is tried again gives the
    same rows in the same folder. An actor whose numbers begin at 0 again, as after it was let go for being ``idle``, has nothing left from before.
    """
    names = ["actor", "ts", "event_id", "reward", "done", "transition_id", "episode", "step"]
    held, earlier = _held(steps, number, f"{path}/held")
    both = steps.select(names) if held is None else held.select(names).unionByName(steps.select(names))
    found = undeal(nstep_return(deal(both, 0, n - 1, max(block, n)), n, gamma))
    found.select("actor", "event_id", "n_return", "n_discount").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
    newest = both.groupBy(F.col("actor").alias("__actor")).agg(F.max("transition_id").alias("__t"), F.max_by(F.struct("episode", "done"), "transition_id").alias("__l"))
    open_ = both.join(newest, F.col("actor").eqNullSafe(F.col("__actor")))
    kept = open_.filter(~F.col("__l.done") & (F.col("episode") == F.col("__l.episode")) & (F.col("transition_id") > F.col("__t") - (n - 1)))
    _hold(kept.select(names), number, f"{path}/held", earlier, idle)


def rolling_batch(steps: DataFrame, number: int, path: str, size: int, idle: float | None = None, span: float = BLOCK) -> None:
    """For foreachBatch: the rows of :func:`stream_rolling` for micro-batch ``number`` of numbered ``steps``; :func:`read_derived` reads them.

    Episodes are summed by an aggregation, which takes part sums in the scan's tasks, so neither an actor nor an episode is one task; means go over
    stretches of ``span`` episodes (see :func:`windows.rolling_mean`). What goes on is each actor's open episode, as one row, and its last ``size`` - 1
    that ended. Retries and actors that begin anew are as for :func:`nstep_batch`.
    """
    part = steps.select("actor", "episode", F.col("reward").alias("ret"), F.col("success").cast("double").alias("success"), "done", "ts", F.lit(True).alias("new"))
    held, earlier = _held(steps, number, f"{path}/held")
    both = part if held is None else held.select(part.columns).unionByName(part)
    whole = both.groupBy("actor", "episode").agg(F.sum("ret").alias("ret"), F.max("success").alias("success"), F.max("done").alias("done"), F.max("ts").alias("ts"), F.max("new").alias("new"))
    ended = rolling_mean(whole.filter("done"), size, ["ret", "success"], ["actor"], ["episode"], span)
    found = ended.filter("new").select("actor", "episode", F.col("rolling_ret").alias("rolling_return"), "rolling_success")
    found.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
    newest = whole.groupBy(F.col("actor").alias("__actor")).agg(F.max(F.when(F.col("done"), F.col("episode"))).alias("__e"))
    kept = whole.join(newest, F.col("actor").eqNullSafe(F.col("__actor"))).filter(~F.col("done") | (F.col("episode") > F.col("__e") - (size - 1)))
    _hold(kept.withColumn("new", F.lit(False)).select(part.columns), number, f"{path}/held", earlier, idle)


def read_derived(spark: SparkSession, path: str) -> DataFrame:
    """The rows that :func:`nstep_batch` or :func:`rolling_batch` wrote, of all micro-batches."""
    return spark.read.parquet(f"{path}/rows").drop("batch")


def stream_eval(episodes: DataFrame, view: str = "view") -> DataFrame:
    """Running means by view, for update mode."""
    return episodes.groupBy(view).agg(F.avg("ret").alias("mean_return"), F.avg("success").alias("mean_success"))


def metric_guard(metrics: DataFrame, value: str = "value") -> DataFrame:
    """A metric stream with skipped: whether the value isn't finite. Stateless."""
    return metrics.withColumn("skipped", F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(True)))


def stream_catalog(steps: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """(window, episode, num_samples): rows by day, each (episode, t) once, as appends may come again."""
    once = steps.withWatermark("ts", late).dropDuplicatesWithinWatermark(["episode", "t"])
    return once.groupBy(F.window("ts", window), "episode").agg(F.count(F.lit(1)).alias("num_samples"))


def keep_newest(batch: DataFrame, path: str, max_size: int, id_col: str = "transition_id") -> None:
    """For foreachBatch: the table at ``path`` with the batch, without what the newest ``max_size`` ids push out. Written beside as a whole: for small
    tables. The table before stays as ``<path>-before`` until the new one has its name, and is taken up again by the next call if a run broke off between.
    A large table, or batches that may be tried again, are for :func:`retain_newest`."""
    spark = batch.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    current, staged, before = (hadoop.Path(f"{path}{x}") for x in ("", "-next", "-before"))
    fs = current.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(current) and fs.exists(before):
        fs.rename(before, current)
    whole = batch if not fs.exists(current) else spark.read.parquet(path).unionByName(batch)
    newest = whole.agg(F.max(id_col)).first()[0]
    if newest is None:
        return
    whole.filter(F.col(id_col) > newest - max_size).write.mode("overwrite").parquet(staged.toString())
    fs.delete(before, True)
    if fs.exists(current):
        fs.rename(current, before)
    fs.rename(staged, current)
    fs.delete(before, True)


def retain_newest(batch: DataFrame, number: int, path: str, max_size: int, id_col: str = "transition_id", width: int | None = None) -> None:
    """For foreachBatch: adds micro-batch ``number`` to the table at ``path``, and drops what the newest ``max_size`` ids push out.

    The table is dealt to folders by range of ids (``width`` ids each) and by batch. Of a batch, only rows among the newest ``max_size`` ids of it
    and the table are written, so what a call writes and deletes depends on ``max_size`` and not on the batch. A batch that is tried again overwrites its own
    folders only, so nothing is there twice; nothing else is written again; ranges that lie wholly before the newest ids are deleted, each after
    the batch is in place. :func:`read_newest` leaves out what is left of the oldest range.
    """
    spark, width = batch.sparkSession, width or max(1, max_size // 4)
    newest = _newest_id(batch, path, id_col)
    kept = batch if newest is None else batch.filter(F.col(id_col) > newest - max_size)
    placed = kept.withColumns({"id_range": F.floor(F.col(id_col) / width).cast("long"), "batch": F.lit(number).cast("long")})
    placed.repartition("id_range").write.option("partitionOverwriteMode", "dynamic").partitionBy("id_range", "batch").mode("overwrite").parquet(path)
    if newest is None:
        return
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for name in _listed(spark, path):
        if _range(name) is not None and (_range(name) + 1) * width <= newest - max_size + 1:
            fs.delete(hadoop.Path(f"{path}/{name}"), True)


def _range(name: str) -> int | None:
    """The number of a folder of ids; null for other folders, and for that of rows without an id."""
    number = name.removeprefix("id_range=")
    return int(number) if number != name and number.lstrip("-").isdigit() else None


def _newest_id(batch: DataFrame, path: str, id_col: str) -> int | None:
    """The largest id of the batch and of the table that :func:`retain_newest` keeps, of which only the last range is read."""
    newest = batch.agg(F.max(id_col)).first()[0]
    spark = batch.sparkSession
    there = [(_range(name), x) for (name, _), x in _folders(spark, path, _manifest(spark, path)[1]) if _range(name) is not None]
    if not there:
        return newest
    last = max(there)[0]
    stored = spark.read.parquet(*[x for number, x in there if number == last]).agg(F.max(id_col)).first()[0]
    return stored if newest is None else max(newest, stored)


def read_newest(spark: SparkSession, path: str, max_size: int, id_col: str = "transition_id") -> DataFrame:
    """The rows with the newest ``max_size`` ids of the table that :func:`retain_newest` keeps, and :func:`compact` may have merged."""
    folders = [x for _, x in _folders(spark, path, _manifest(spark, path)[1])]
    rows = spark.read.parquet(*folders)
    newest = rows.agg(F.max(id_col)).first()[0]
    return rows.filter(F.col(id_col) > (newest or 0) - max_size)


def _listed(spark: SparkSession, path: str) -> list[str]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(target)] if fs.exists(target) else []


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, dict]]:
    """The newest manifest's number and ranges: each range's merged folder, and the last batch merged there. Number -1 without one."""
    numbers = [int(x[1:-5]) for x in _listed(spark, f"{path}/_manifest") if x.startswith("v") and x.endswith(".json")]
    if not numbers:
        return -1, {}
    text = spark.read.text(f"{path}/_manifest/v{max(numbers):012}.json", wholetext=True).first()[0]
    return max(numbers), json.loads(text)


def _folders(spark: SparkSession, path: str, ranges: dict[str, dict]) -> list[tuple[tuple[str, int], str]]:
    """((range, batch), folder) of what is to be read: a range's merged folder, as batch -1, and batches after the last that was merged."""
    found = []
    for name in _listed(spark, path):
        if name.startswith("id_range="):
            merged = ranges.get(name, {"upto": -1})
            if "folder" in merged:
                found.append(((name, -1), f"{path}/{merged['folder']}"))
            batches = [int(x[6:]) for x in _listed(spark, f"{path}/{name}") if x.startswith("batch=")]
            found += [((name, b), f"{path}/{name}/batch={b}") for b in batches if b > merged["upto"]]
    return found


def compact(spark: SparkSession, path: str, least: int = 8, file_bytes: int = 256_000_000) -> int:
    """Merges the folders of each range of :func:`retain_newest` that has ``least`` of them or more; returns how many ranges it merged.

    Merged rows are written to a folder of their own, by one job; then a manifest that names it is put in place by a rename, which either is there or
    not, so a reader sees all rows once before and after, and a run that breaks off leaves nothing that is read. The newest batch is left alone, as it
    may be tried again. What a manifest replaces is deleted by the next run that merges, so that whoever reads by the manifest before can finish. Two runs
    at once: the second rename fails, and its folder is never read. Ranges that :func:`retain_newest` dropped leave the manifest.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    number, ranges = _manifest(spark, path)
    there = _folders(spark, path, ranges)
    newest = max((b for (_, b), _ in there), default=-1)
    ready: dict[str, list[tuple[int, str]]] = {}
    for (name, b), folder in there:
        if b < newest:
            ready.setdefault(name, []).append((b, folder))
    ready = {name: x for name, x in ready.items() if len(x) >= least}
    if not ready:
        return 0
    size = sum(fs.getContentSummary(hadoop.Path(f)).getLength() for x in ready.values() for _, f in x)
    parts = [spark.read.parquet(*[f for _, f in x]).withColumn("id_range", F.lit(int(name[9:]))) for name, x in ready.items()]
    whole = functools.reduce(DataFrame.unionByName, parts)
    target = f"_compact/{uuid.uuid4().hex}"
    whole.repartition(max(1, -(-size // file_bytes)), "id_range").write.partitionBy("id_range").parquet(f"{path}/{target}")
    live = {name for (name, _), _ in there}
    after = {name: x for name, x in ranges.items() if name in live}
    after |= {name: {"folder": f"{target}/{name}", "upto": max(max(b for b, _ in x), ranges.get(name, {"upto": -1})["upto"])} for name, x in ready.items()}
    if not put_new(spark, json.dumps(after), f"{path}/_manifest/v{number + 1:012}.json"):
        raise RuntimeError(f"another run has written manifest {number + 1}")
    kept = {x["folder"].split("/")[1] for m in (ranges, after) for x in m.values()}
    for name in _listed(spark, f"{path}/_compact"):
        if name not in kept:
            fs.delete(hadoop.Path(f"{path}/_compact/{name}"), True)
    for name, x in ranges.items():  # what the manifest before had replaced
        for b in _listed(spark, f"{path}/{name}"):
            if b.startswith("batch=") and int(b[6:]) <= x["upto"]:
                fs.delete(hadoop.Path(f"{path}/{name}/{b}"), True)
    return len(ready)


def metric_sinks(metrics: DataFrame, every: int, value: str = "value", step: str = "step") -> tuple[DataFrame, DataFrame]:
    """Of a guarded metric stream, the rows for the full log, and those for a thinned one: finite values, at each step that ``every`` divides."""
    guarded = metric_guard(metrics, value)
    return guarded, guarded.filter(~F.col("skipped") & (F.col(step) % every == 0))
