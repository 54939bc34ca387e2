"""The flagship query: what a learner reads from a replay log, rolled up by actor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.operators import windows as W
from episodica.plans import tables as T
from episodica.plans.window_queries import IDS


def replay_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Starts with three transitions ahead: their stacks and discounted returns, summed up by actor.

    All window functions share the partitioning by actor, so the plan has one exchange of the log.
    """
    steps = W.frame_stack(W.assign_ids(T.log(spark, sf)), 3, "event_id")
    starts = W.nstep_return(steps, 3, 0.99)
    newest = starts.withColumn("span", F.col("stack")[2] - F.col("stack")[0])
    return newest.groupBy("actor").agg(
        F.count(F.lit(1)).alias("starts"), F.countDistinct("episode").alias("episodes"), F.sum("span").alias("stack_span"), F.round(F.sum("n_return"), 8).alias("sum_return"), F.sum(F.when(F.col("n_discount") == 0, 1).otherwise(0)).alias("terminal")
    )


_D = [f"(CASE WHEN {'done' if not k else f'lead(done, {k}) OVER e'} THEN 0.0::DOUBLE ELSE 0.99::DOUBLE END)" for k in range(3)]

QUERIES = {"flagship_replay_summary": replay_summary}
ORACLE_SQL = {
    "flagship_replay_summary": f"""WITH {IDS}, x AS (
  SELECT actor, episode, event_id - CASE WHEN step >= 2 THEN lag(event_id, 2) OVER e ELSE first_value(event_id) OVER e END AS span,
    reward + {_D[0]} * lead(reward, 1) OVER e + {_D[0]} * {_D[1]} * lead(reward, 2) OVER e AS r, {_D[0]} * {_D[1]} * {_D[2]} AS d, lead(step, 2) OVER e AS last
  FROM ids WINDOW e AS (PARTITION BY actor, episode ORDER BY step)
) SELECT actor, count(*) AS starts, count(DISTINCT episode) AS episodes, sum(span)::BIGINT AS stack_span, round(sum(r), 8) AS sum_return, sum(CASE WHEN d = 0 THEN 1 ELSE 0 END)::BIGINT AS terminal FROM x WHERE last IS NOT NULL GROUP BY actor"""
}
