"""Episodic tables as seen through the driver's tables: the same shapes, other values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions in the order they were written: an actor's events; an error ends an episode."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("actor"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("reward"), (F.col("event_type") == "error").alias("done"), (F.col("event_type") == "purchase").alias("success"))


LOG = """log AS (SELECT user_id AS actor, ts, event_id, value AS reward, event_type = 'error' AS done, event_type = 'purchase' AS success
FROM events)"""


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short contiguous episodes: a conversation's turns."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("episode"), F.col("turn").alias("t"), F.length("text").cast("double").alias("value"), (F.col("role") == "user").alias("flag"))


TALK = "talk AS (SELECT conv_id AS episode, turn AS t, length(text)::DOUBLE AS value, role = 'user' AS flag FROM conversations)"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode keys with attributes: orders."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("demo"), F.col("o_orderkey").cast("string")).alias("episode"), F.col("o_orderpriority").alias("env_name"), (F.col("o_custkey") % 7).alias("num_samples"), F.col("o_orderkey").alias("k"))


CATALOGUE = """catalogue AS (SELECT 'demo' || o_orderkey AS episode, o_orderpriority AS env_name, o_custkey % 7 AS num_samples, o_orderkey AS k
FROM orders)"""


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of an episode with their lengths: line items, numbered by all their columns."""
    x = read(spark, sf_dir, "lineitem")
    return x.select(F.concat(F.lit("demo"), F.col("l_orderkey").cast("string")).alias("episode"), F.concat(F.lit("cam"), F.col("l_linenumber").cast("string"), F.lit("_rgb")).alias("stream"), F.col("l_quantity").cast("long").alias("n"))


STREAMS = """streams AS (SELECT 'demo' || l_orderkey AS episode, 'cam' || l_linenumber || '_rgb' AS stream, l_quantity::BIGINT AS n
FROM lineitem)"""


def latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by batch, state and view; the first half is view-invariant, the second view-dependent."""
    e = read(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    return e.select(
        F.floor(F.col("vec_id") / 50).alias("batch_id"), F.floor(F.col("vec_id") / 5).alias("state_id"), (F.col("vec_id") % 5).alias("view_id"), "vec_id", "label", v.alias("vec"), F.slice(v, 1, 32).alias("z_inv"), F.slice(v, 33, 32).alias("z_dep")
    )


LATENTS = """latents AS (SELECT vec_id // 50 AS batch_id, vec_id // 5 AS state_id, vec_id % 5 AS view_id, vec_id, label, embedding::DOUBLE[] AS vec,
(embedding::DOUBLE[])[1:32] AS z_inv, (embedding::DOUBLE[])[33:64] AS z_dep FROM embeddings)"""
