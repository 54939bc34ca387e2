"""Queries of the sequence windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodica.operators import windows as W
from episodica.plans import tables as T

IDS = f"""{T.LOG}, numbered AS (
  SELECT *, row_number() OVER w - 1 AS transition_id, coalesce(sum(done::INT) OVER (PARTITION BY actor ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS episode
  FROM log WINDOW w AS (PARTITION BY actor ORDER BY ts, event_id)
), ids AS (
  SELECT *, transition_id - min(transition_id) OVER (PARTITION BY actor, episode) AS step, transition_id + episode AS state_id FROM numbered
)"""


def ids(spark: SparkSession, sf: str) -> DataFrame:
    return W.assign_ids(T.log(spark, sf))


def dealt(spark: SparkSession, sf: str, before: int, after: int) -> DataFrame:
    """Steps numbered by a segmented scan and dealt into blocks, so that no actor is one task."""
    return W.deal(W.assign_ids(T.log(spark, sf), span=W.SPAN), before, after)


def w1(spark: SparkSession, sf: str) -> DataFrame:
    found = W.padded_windows(T.talk(spark, sf), 4, 2, "value")
    return found.select("episode", "t", *[F.col("obs")[i].alias(f"obs_{i}") for i in range(2)], *[F.col("actions")[i].alias(f"action_{i}") for i in range(4)])


def w2(spark: SparkSession, sf: str) -> DataFrame:
    found = W.strided_windows(T.talk(spark, sf), 3, 2, "value")
    return found.select("episode", "start", *[F.col("values")[i].alias(f"v{i}") for i in range(3)])


def w3(spark: SparkSession, sf: str) -> DataFrame:
    found = W.undeal(W.frame_stack(dealt(spark, sf, 2, 0), 3, "event_id"))
    return found.select("actor", "episode", "step", *[F.col("stack")[i].alias(f"s{i}") for i in range(3)])


def w4(spark: SparkSession, sf: str) -> DataFrame:
    return W.undeal(W.nstep_return(dealt(spark, sf, 0, 2), 3, 0.99)).select("actor", "episode", "step", "next_step", F.round("n_return", 8).alias("n_return"), F.round("n_discount", 8).alias("n_discount"))


def w5(spark: SparkSession, sf: str) -> DataFrame:
    return W.undeal(W.valid_start(dealt(spark, sf, 0, 2), 3, 40)).select("actor", "episode", "step", "valid")


def w6(spark: SparkSession, sf: str) -> DataFrame:
    return W.assign_ids(T.log(spark, sf), span=W.SPAN).select("actor", "event_id", "transition_id", "state_id", "episode", "step")


def w7(spark: SparkSession, sf: str) -> DataFrame:
    return W.retain_latest(ids(spark, sf), 20).select("actor", "transition_id", "event_id")


def w8(spark: SparkSession, sf: str) -> DataFrame:
    found = W.action_slice(W.padded_windows(T.talk(spark, sf), 4, 2, "value"), 2, 2)
    return found.select("episode", "t", F.col("executed")[0].alias("a0"), F.col("executed")[1].alias("a1"))


def ended(spark: SparkSession, sf: str) -> DataFrame:
    return ids(spark, sf).groupBy("actor", "episode").agg(F.sum("reward").alias("ret"), F.max(F.col("success").cast("int")).alias("success"), F.max("done").alias("over")).filter("over")


def w9(spark: SparkSession, sf: str) -> DataFrame:
    found = W.rolling_mean(ended(spark, sf), 3, ["ret", "success"], ["actor"], ["episode"])
    return found.select("actor", "episode", F.round("rolling_ret", 6).alias("rolling_return"), F.round("rolling_success", 6).alias("rolling_success"))


def w10(spark: SparkSession, sf: str) -> DataFrame:
    rows = ids(spark, sf).select(F.col("actor").alias("name"), F.col("transition_id").alias("step"), F.col("reward").alias("value"))
    return W.rolling_metric(rows, 5, span=1000).select("name", "step", F.round("rolling_value", 6).alias("mean"))


def w11(spark: SparkSession, sf: str) -> DataFrame:
    found = W.action_repeat(ids(spark, sf), 2, limit=50)
    return found.select("actor", "episode", "t", F.round("reward", 6).alias("reward"), "success", "done", "last_step", "last_reward")


def w12(spark: SparkSession, sf: str) -> DataFrame:
    rows = ids(spark, sf).select("actor", F.col("transition_id").alias("t"), F.col("event_id").alias("obs"), (F.col("event_id") + F.when(F.col("done"), 1).otherwise(0)).alias("x"))
    following = F.lead("x").over(Window.partitionBy("actor").orderBy("t"))
    return W.align_transitions(rows.withColumn("next_obs", following), ["actor"]).select("actor", "t", "aligned")


def w13(spark: SparkSession, sf: str) -> DataFrame:
    rows = ids(spark, sf).withColumn("step", F.col("transition_id"))
    return W.truncate(rows, 30).select("actor", "step", "event_id")


def w14(spark: SparkSession, sf: str) -> DataFrame:
    tokens = T.latents(spark, sf).select("vec_id", W.positions("vec", "token", "x"))
    return W.token_grid(tokens, 64).select("vec_id", "row", "col", "x")


_PAD = ", ".join(f"CASE WHEN pos + {k - 1} < 1 THEN first_value(value) OVER f WHEN pos + {k - 1} > n THEN last_value(value) OVER f ELSE {'lag(value, 1)' if k == 0 else f'lead(value, {k - 1})'} OVER o END AS action_{k}" for k in range(4))
_PADDED = f"""{T.TALK}, numbered AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY t) AS pos, count(*) OVER (PARTITION BY episode) AS n FROM talk),
padded AS (SELECT episode, t, {_PAD} FROM numbered WINDOW o AS (PARTITION BY episode ORDER BY t), f AS (PARTITION BY episode ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
_ENDED = f"""{IDS},
ended AS (SELECT actor, episode, sum(reward) AS ret, max(success::INT) AS success
FROM ids GROUP BY 1, 2 HAVING bool_or(done))"""
_R = ["reward", *(f"lead(reward, {k}) OVER e" for k in (1, 2))]
_D = [f"(CASE WHEN {'done' if not k else f'lead(done, {k}) OVER e'} THEN 0.0::DOUBLE ELSE 0.99::DOUBLE END)" for k in range(3)]

QUERIES = {f"w{i}_{name}": f for i, name, f in (
    (1, "padded_windows", w1), (2, "strided_windows", w2), (3, "frame_stack", w3), (4, "nstep_return", w4), (5, "valid_start", w5), (6, "assign_ids", w6), (7, "retain_latest", w7), (8, "action_slice", w8),
    (9, "rolling_episode_stats", w9), (10, "rolling_metric", w10), (11, "action_repeat", w11), (12, "align_transitions", w12), (13, "truncate", w13), (14, "token_grid", w14),
)}

ORACLE_SQL = {
    "w1_padded_windows": f"""WITH {_PADDED} SELECT episode, t, action_0 AS obs_0, action_1 AS obs_1, action_0, action_1, action_2, action_3
FROM padded""",
    "w2_strided_windows": f"""WITH {T.TALK},
x AS (SELECT episode, row_number() OVER w - 1 AS start, value AS v0, lead(value, 1) OVER w AS v1, lead(value, 2) OVER w AS v2, count(*) OVER (PARTITION BY episode) AS n
FROM talk WINDOW w AS (PARTITION BY episode ORDER BY t)) SELECT episode, start, v0, v1, v2
FROM x WHERE start % 2 = 0 AND start + 3 <= n""",
    "w3_frame_stack": f"""WITH {IDS} SELECT actor, episode, step, CASE WHEN step >= 2 THEN lag(event_id, 2) OVER e ELSE first_value(event_id) OVER e END AS s0,
CASE WHEN step >= 1 THEN lag(event_id, 1) OVER e ELSE first_value(event_id) OVER e END AS s1, event_id AS s2
FROM ids WINDOW e AS (PARTITION BY actor, episode ORDER BY step)""",
    "w4_nstep_return": f"""WITH {IDS},
x AS (SELECT actor, episode, step, step + 3 AS next_step, {_R[0]} + {_D[0]} * {_R[1]} + {_D[0]} * {_D[1]} * {_R[2]} AS r, {_D[0]} * {_D[1]} * {_D[2]} AS d,
lead(step, 2) OVER e AS last FROM ids WINDOW e AS (PARTITION BY actor, episode ORDER BY step)) SELECT actor, episode, step, next_step,
round(r, 8) AS n_return, round(d, 8) AS n_discount
FROM x WHERE last IS NOT NULL""",
    "w5_valid_start": f"""WITH {IDS} SELECT actor, episode, step, count(*) OVER (PARTITION BY actor, episode ORDER BY step ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3 AND transition_id >= max(transition_id) OVER (PARTITION BY actor) - 39 AS valid
FROM ids""",
    "w6_assign_ids": f"WITH {IDS} SELECT actor, event_id, transition_id, state_id, episode, step FROM ids",
    "w7_retain_latest": f"""WITH {IDS} SELECT actor, transition_id, event_id
FROM ids QUALIFY transition_id > max(transition_id) OVER (PARTITION BY actor) - 20""",
    "w8_action_slice": f"WITH {_PADDED} SELECT episode, t, action_1 AS a0, action_2 AS a1 FROM padded",
    "w9_rolling_episode_stats": f"""WITH {_ENDED} SELECT actor, episode, round(avg(ret) OVER w, 6) AS rolling_return, round(avg(success) OVER w, 6) AS rolling_success
FROM ended WINDOW w AS (PARTITION BY actor ORDER BY episode ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "w10_rolling_metric": f"""WITH {IDS} SELECT name, step, round(mean, 6) AS mean
FROM (SELECT actor AS name, transition_id AS step, avg(reward) OVER (PARTITION BY actor ORDER BY transition_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean
FROM ids) WHERE step % 5 = 0""",
    "w11_action_repeat": f"""WITH {IDS} SELECT actor, episode, step // 2 AS t, round(sum(reward), 6) AS reward, bool_or(success) AS success, bool_or(done) AS done,
max(step) AS last_step, arg_max(reward, step) AS last_reward
FROM ids WHERE step < 50 GROUP BY 1, 2, 3""",
    "w12_align_transitions": f"""WITH {IDS} SELECT actor, transition_id AS t, coalesce(NOT lead(done) OVER (PARTITION BY actor ORDER BY transition_id), true) AS aligned
FROM ids""",
    "w13_truncate": f"""WITH {IDS},
x AS (SELECT actor, transition_id AS step, event_id, min(CASE WHEN done OR success THEN transition_id END) OVER (PARTITION BY actor) AS stop
FROM ids) SELECT actor, step, event_id FROM x
WHERE step < 30 AND (stop IS NULL OR step <= stop)""",
    "w14_token_grid": f"WITH {T.LATENTS}, x AS (SELECT vec_id, unnest(range(64)) AS token, unnest(vec) AS x FROM latents) SELECT vec_id, token // 8 AS \"row\", token % 8 AS col, x FROM x",
}
