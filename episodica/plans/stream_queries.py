"""Streaming queries over the event log, run to the end of what is there; their SQL is that of the batch counterpart."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.plans import tables as T
from episodica.plans.window_queries import ORACLE_SQL as WINDOWS
from episodica.streaming import replay as R


def shared(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, as the session names it."""
    jsc = spark.sparkContext._jsc.sc()
    base = spark.conf.get("spark.checkpoint.dir", None) or (jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-stream-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of files."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.select(F.col("user_id").alias("actor"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("reward"), (F.col("event_type") == "error").alias("done"), (F.col("event_type") == "purchase").alias("success"))


def drained(spark: SparkSession, stream: DataFrame, name: str, stateful: bool = True) -> DataFrame:
    """The stream's rows after it has read all there is, from a Parquet sink."""
    out = shared(spark, name)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    if stateful:
        spark.conf.set(setting, R.STATE_STORE)
    try:
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    return spark.read.schema(stream.schema).parquet(out)


def t1(spark: SparkSession, sf: str) -> DataFrame:
    return drained(spark, R.ingest_transitions(events(spark, sf)), "ingest").select("actor", "event_id", "transition_id", "state_id", "episode", "step")


def by_thirds(spark: SparkSession, sf: str, out: str, then: Callable[[DataFrame, int], None] | None = None) -> None:
    """The log in three parts of time, each a micro-batch of a query that starts anew from its checkpoint: numbered to ``out``, and handed on."""
    source = shared(spark, "log")
    log = T.log(spark, sf)

    def put(batch: DataFrame, number: int) -> None:
        R.ingest_batch(batch, number, out)
        if then is not None:
            then(spark.read.parquet(f"{out}/steps/batch={number}"), number)

    cuts = log.select(F.unix_micros("ts").cast("double").alias("x")).approxQuantile("x", [1 / 3, 2 / 3], 0.01)
    for low, high in zip([float("-inf"), *cuts], [*cuts, float("inf")], strict=True):
        at = F.unix_micros("ts").cast("double")
        log.filter((at >= low) & (at < high)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(log.schema).parquet(source)
        query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start()
        query.awaitTermination()


def t1b(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers that go on over three micro-batches and restarts."""
    out = shared(spark, "ingested")
    by_thirds(spark, sf, out)
    return R.read_ingested(spark, out).select("actor", "event_id", "transition_id", "state_id", "episode", "step")


def t2b(spark: SparkSession, sf: str) -> DataFrame:
    """n-step returns over three micro-batches, in blocks, so that no actor is one task."""
    out, to = shared(spark, "ingested"), shared(spark, "nstep")
    by_thirds(spark, sf, out, lambda steps, number: R.nstep_batch(steps, number, to, 3, 0.99))
    return R.read_derived(spark, to).select("actor", "event_id", F.round("n_return", 8).alias("n_return"), F.round("n_discount", 8).alias("n_discount"))


def t3b(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling episode means over three micro-batches."""
    out, to = shared(spark, "ingested"), shared(spark, "rolling")
    by_thirds(spark, sf, out, lambda steps, number: R.rolling_batch(steps, number, to, 3))
    return R.read_derived(spark, to).select("actor", "episode", F.round("rolling_return", 6).alias("rolling_return"), F.round("rolling_success", 6).alias("rolling_success"))


def t2(spark: SparkSession, sf: str) -> DataFrame:
    found = drained(spark, R.stream_nstep(events(spark, sf), 3, 0.99), "nstep")
    return found.select("actor", "event_id", F.round("n_return", 8).alias("n_return"), F.round("n_discount", 8).alias("n_discount"))


def t3(spark: SparkSession, sf: str) -> DataFrame:
    found = drained(spark, R.stream_rolling(events(spark, sf), 3), "rolling")
    return found.select("actor", "episode", F.round("rolling_return", 6).alias("rolling_return"), F.round("rolling_success", 6).alias("rolling_success"))


def t4(spark: SparkSession, sf: str) -> DataFrame:
    """Means by view, each micro-batch's update written over the ones before."""
    out = shared(spark, "eval")
    rows = events(spark, sf).select((F.col("actor") % 6).alias("view"), F.col("reward").alias("ret"), F.col("success").cast("int").alias("success"))
    updates = R.stream_eval(rows)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("number", F.lit(number).cast("long")).write.mode("append").parquet(out)

    query = updates.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start()
    query.awaitTermination()
    newest = spark.read.parquet(out).groupBy("view").agg(F.max_by(F.struct("mean_return", "mean_success"), "number").alias("m"))
    return newest.select("view", F.round("m.mean_return", 6).alias("mean_return"), F.round("m.mean_success", 8).alias("mean_success"))


def t5(spark: SparkSession, sf: str) -> DataFrame:
    out = shared(spark, "newest")
    rows = events(spark, sf).select(F.col("event_id").alias("transition_id"), "actor")
    query = rows.writeStream.foreachBatch(lambda batch, number: R.retain_newest(batch, number, out, 500)).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start()
    query.awaitTermination()
    return R.read_newest(spark, out, 500)


def t5b(spark: SparkSession, sf: str) -> DataFrame:
    """The retained table after three micro-batches, and a run of compact after each."""
    source, out = shared(spark, "log"), shared(spark, "compacted")
    log = T.log(spark, sf).select(F.col("event_id").alias("transition_id"), "actor")
    top = log.agg(F.max("transition_id")).first()[0] or 0
    for i in range(3):
        log.filter(F.floor(F.col("transition_id") * 3 / (top + 1)) == i).write.mode("append").parquet(source)
        stream = spark.readStream.schema(log.schema).parquet(source)
        query = stream.writeStream.foreachBatch(lambda batch, number: R.retain_newest(batch, number, out, 500, width=max(500, top // 2))).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start()
        query.awaitTermination()
        R.compact(spark, out, least=2)
    return R.read_newest(spark, out, 500)


def t6(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("event_id", F.when(F.col("done"), float("nan")).otherwise(F.col("reward")).alias("value"))
    return drained(spark, R.metric_guard(rows), "guard", stateful=False).groupBy("skipped").agg(F.count(F.lit(1)).alias("n"))


def t7(spark: SparkSession, sf: str) -> DataFrame:
    """Closed days only: a day's count comes out when the watermark has passed its end."""
    rows = events(spark, sf).select(F.col("actor").alias("episode"), F.col("event_id").alias("t"), "ts")
    found = drained(spark, R.stream_catalog(rows, "1 hour"), "catalog")
    return found.select(F.col("window.start").cast("date").cast("string").alias("day"), "episode", "num_samples")


QUERIES = {"t1_ingest_transitions": t1, "t1b_ingest_batches": t1b, "t5b_compacted_retention": t5b, "t2_stream_nstep": t2, "t2b_nstep_batches": t2b, "t3b_rolling_batches": t3b, "t3_stream_rolling": t3, "t4_stream_eval": t4, "t5_retention": t5, "t6_metric_guard": t6, "t7_stream_catalog": t7}
ORACLE_SQL = {
    "t1_ingest_transitions": WINDOWS["w6_assign_ids"],
    "t2_stream_nstep": WINDOWS["w4_nstep_return"].replace("SELECT actor, episode, step, step + 3 AS next_step,", "SELECT actor, event_id,").replace("SELECT actor, episode, step, next_step,", "SELECT actor, event_id,"),
    "t3_stream_rolling": WINDOWS["w9_rolling_episode_stats"],
    "t4_stream_eval": f"""WITH {T.LOG} SELECT actor % 6 AS view, round(avg(reward), 6) AS mean_return, round(avg(success::INT), 8) AS mean_success
FROM log GROUP BY 1""",
    "t5_retention": f"WITH {T.LOG} SELECT event_id AS transition_id, actor FROM log WHERE event_id > (SELECT max(event_id) FROM log) - 500",
    "t6_metric_guard": f"WITH {T.LOG} SELECT done AS skipped, count(*) AS n FROM log GROUP BY 1",
    "t7_stream_catalog": f"""WITH {T.LOG} SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, actor AS episode, count(*) AS num_samples
FROM log WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR
FROM log) GROUP BY 1, 2""",
}
ORACLE_SQL |= {"t2b_nstep_batches": ORACLE_SQL["t2_stream_nstep"], "t3b_rolling_batches": ORACLE_SQL["t3_stream_rolling"], "t1b_ingest_batches": ORACLE_SQL["t1_ingest_transitions"], "t5b_compacted_retention": ORACLE_SQL["t5_retention"]}
