"""Queries of splits, batches, pairs and draws, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.operators import sampling as S
from episodica.operators import windows as W
from episodica.plans import tables as T
from episodica.plans.window_queries import IDS, dealt, ids


def _h(seed: int, *key: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'({k})::VARCHAR' for k in key)}))"


def _i(seed: int, *key: str) -> str:
    return f"('0x' || substr({_h(seed, *key)}, 1, 12))::BIGINT"


def states(spark: SparkSession, sf: str) -> DataFrame:
    return T.latents(spark, sf).select("batch_id", "state_id").distinct()


STATES = f"{T.LATENTS}, states AS (SELECT DISTINCT batch_id, state_id FROM latents)"


def p1(spark: SparkSession, sf: str) -> DataFrame:
    return S.split_by_ratio(T.catalogue(spark, sf), 0.9, 42)


def p1b(spark: SparkSession, sf: str) -> DataFrame:
    return S.split_by_ratio(T.catalogue(spark, sf).filter("k = 7"), 0.9, 42, single="train_only").unionByName(S.split_by_ratio(T.catalogue(spark, sf), 0.37, 1, single="train_only"))


def p2(spark: SparkSession, sf: str) -> DataFrame:
    return S.split_first(T.catalogue(spark, sf), 0.05, 42)


def windows(spark: SparkSession, sf: str) -> DataFrame:
    return W.strided_windows(T.talk(spark, sf), 2, 1, "value").select(F.concat_ws(":", "episode", "start").alias("episode"))


def p3(spark: SparkSession, sf: str) -> DataFrame:
    return S.split_by_ratio(windows(spark, sf), 0.96, 3)


def p4(spark: SparkSession, sf: str) -> DataFrame:
    return S.make_batches(T.catalogue(spark, sf).select("episode"), 64, 5, ["episode"])


def p5(spark: SparkSession, sf: str) -> DataFrame:
    found = S.camera_per_batch(S.make_batches(T.catalogue(spark, sf).select("episode"), 64, 5, ["episode"], drop_last=False), 6, "random", 9)
    fixed = S.camera_per_batch(found.withColumnRenamed("camera", "drawn"), 6, "fixed", 9)
    return fixed.groupBy("batch_id", "drawn", "camera").agg(F.count(F.lit(1)).alias("n"))


def p6(spark: SparkSession, sf: str) -> DataFrame:
    talk = T.talk(spark, sf)
    rows = talk.join(talk.groupBy("episode").agg(F.count(F.lit(1)).alias("len")), "episode")
    return S.far_partner(rows, 3, 11, ["episode"]).select("episode", "t", "partner")


def p7(spark: SparkSession, sf: str) -> DataFrame:
    return S.orient_pair(T.catalogue(spark, sf).select("episode", F.lit("left").alias("l"), F.lit("right").alias("r")), 13, ["episode"], "l", "r").select("episode", "view_i", "view_j")


def p8(spark: SparkSession, sf: str) -> DataFrame:
    return S.source_targets(states(spark, sf), 5, 17)


def p9(spark: SparkSession, sf: str) -> DataFrame:
    return S.other_view(states(spark, sf).withColumn("source", F.col("state_id") % 5), 5, 17).select("state_id", "source", "other")


def p10(spark: SparkSession, sf: str) -> DataFrame:
    return S.non_identity_permutation(states(spark, sf), 19)


def p11(spark: SparkSession, sf: str) -> DataFrame:
    return S.recombine(states(spark, sf), 5, 19)


def p12(spark: SparkSession, sf: str) -> DataFrame:
    return S.rolled_negative(states(spark, sf))


def p13(spark: SparkSession, sf: str) -> DataFrame:
    return S.primary_reference_views(states(spark, sf), 6, 23)


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return T.latents(spark, sf).select("state_id", F.posexplode("vec").alias("pixel", "x")).select("state_id", "pixel").distinct()


def p14(spark: SparkSession, sf: str) -> DataFrame:
    return S.sample_rays(pixels(spark, sf), 7, 29, 8, precrop=True)


def p15(spark: SparkSession, sf: str) -> DataFrame:
    frames = T.latents(spark, sf).select(F.col("batch_id").alias("episode"), (F.col("state_id") % 10).alias("t"), F.col("view_id").alias("camera"))
    return S.swap_pairs(frames)


def p16(spark: SparkSession, sf: str) -> DataFrame:
    views = T.streams(spark, sf).select("episode", F.col("stream").alias("cam_idx")).distinct()
    return S.allocate(views, 5)


def p17(spark: SparkSession, sf: str) -> DataFrame:
    return S.sample_starts(W.valid_start(ids(spark, sf), 3), 256, 31, ["actor", "transition_id"]).select("actor", "transition_id")


def p17b(spark: SparkSession, sf: str) -> DataFrame:
    """As many draws as there are line items, several times the starts."""
    n = T.read(spark, sf, "lineitem").count()
    return S.draw_starts(W.undeal(W.valid_start(dealt(spark, sf, 0, 2), 3)), n, 31, ["actor", "transition_id"]).select("draw", "actor", "transition_id")


def p18(spark: SparkSession, sf: str) -> DataFrame:
    return S.limit_batches(T.latents(spark, sf), 3).select("batch_id", "vec_id")


_RANKED = f"""{T.CATALOGUE},
r AS (SELECT episode, row_number() OVER (ORDER BY {{h}}, episode) - 1 AS rank, count(*) OVER () AS n
FROM catalogue)"""
_PERM = f"""{STATES}, r AS (SELECT batch_id, state_id, row_number() OVER (PARTITION BY batch_id ORDER BY state_id) - 1 AS own, row_number() OVER (PARTITION BY batch_id ORDER BY {_h(19, 'batch_id', 'state_id')}, state_id) - 1 AS drawn, count(*) OVER (PARTITION BY batch_id) AS n FROM states),
m AS (SELECT *, CASE WHEN bool_and(own = drawn) OVER (PARTITION BY batch_id) THEN (drawn + 1) % n ELSE drawn END AS target FROM r),
perm AS (SELECT m.batch_id, m.state_id, o.state_id AS mapped FROM m JOIN r o ON m.batch_id = o.batch_id AND m.target = o.own)"""


def _split(seed: int, n_train: str, source: str = "catalogue") -> str:
    return f"SELECT episode, CASE WHEN rank < {n_train} THEN 'train' ELSE 'val' END AS split FROM (SELECT episode, row_number() OVER (ORDER BY {_h(seed, 'episode')}, episode) - 1 AS rank, count(*) OVER () AS n FROM {source})"


QUERIES = {
    "p1_split_by_ratio": p1, "p1b_split_single": p1b, "p2_split_first": p2, "p3_split_windows": p3,
    "p4_make_batches": p4, "p5_camera_per_batch": p5, "p6_far_partner": p6, "p7_orient_pair": p7,
    "p8_source_targets": p8,
    "p9_other_view": p9, "p10_permutation": p10, "p11_recombine": p11, "p12_rolled_negative": p12,
    "p13_primary_reference": p13, "p14_sample_rays": p14, "p15_swap_pairs": p15, "p16_allocate": p16,
    "p17_sample_starts": p17, "p17b_draw_starts": p17b, "p18_limit_batches": p18,
}

_N = "greatest(1, least(greatest(1, floor(n * {r}::DOUBLE)), n - 1))"
_PAIR = f"""WITH {T.TALK},
x AS (SELECT episode, t, count(*) OVER (PARTITION BY episode) AS len, {_i(11, 'episode', 't')} AS h
FROM talk),
y AS (SELECT *, greatest(0, t - 2) AS below, greatest(0, len - t - 3) AS above FROM x)"""
ORACLE_SQL = {
    "p1_split_by_ratio": f"WITH {T.CATALOGUE} {_split(42, _N.format(r=0.9))}",
    "p1b_split_single": f"""WITH {T.CATALOGUE} SELECT episode, 'train' AS split
FROM catalogue WHERE k = 7 UNION ALL {_split(1, _N.format(r=0.37))}""",
    "p2_split_first": f"""WITH {T.CATALOGUE} SELECT episode, CASE WHEN rank < least(greatest(1, round_even(n * 0.05::DOUBLE, 0)), n - 1) THEN 'val' ELSE 'train' END AS split
FROM (SELECT episode, row_number() OVER (ORDER BY {_h(42, 'episode')}, episode) - 1 AS rank, count(*) OVER () AS n
FROM catalogue)""",
    "p3_split_windows": f"""WITH {T.TALK},
w AS (SELECT episode || ':' || (row_number() OVER (PARTITION BY episode ORDER BY t) - 1) AS episode, lead(t) OVER (PARTITION BY episode ORDER BY t) AS following
FROM talk),
v AS (SELECT episode FROM w WHERE following IS NOT NULL) {_split(3, _N.format(r=0.96), 'v')}""",
    "p4_make_batches": f"""WITH {_RANKED.format(h=_h(5, 'episode'))} SELECT episode, rank // 64 AS batch_id, rank % 64 AS slot
FROM r WHERE rank // 64 < n // 64""",
    "p5_camera_per_batch": f"""WITH {_RANKED.format(h=_h(5, 'episode'))},
b AS (SELECT rank // 64 AS batch_id FROM r) SELECT batch_id, {_i(9, 'batch_id')} % 6 AS drawn, batch_id % 6 AS camera, count(*) AS n
FROM b GROUP BY 1""",
    "p6_far_partner": f"""{_PAIR} SELECT episode, t, CASE WHEN below + above > 0 THEN CASE WHEN h % (below + above) < below THEN h % (below + above) ELSE h % (below + above) - below + t + 3 END WHEN len > 1 THEN CASE WHEN h % (len - 1) < t THEN h % (len - 1) ELSE h % (len - 1) + 1 END ELSE t END::BIGINT AS partner
FROM y""",
    "p7_orient_pair": f"""WITH {T.CATALOGUE} SELECT episode, CASE WHEN {_i(13, 'episode')} % 2 = 0 THEN 'left' ELSE 'right' END AS view_i, CASE WHEN {_i(13, 'episode')} % 2 = 0 THEN 'right' ELSE 'left' END AS view_j
FROM catalogue""",
    "p8_source_targets": f"""WITH {STATES},
s AS (SELECT state_id, {_i(17, 'state_id')} % 5 AS source FROM states),
t AS (SELECT state_id, source, unnest(range(5)) AS target FROM s) SELECT *
FROM t WHERE target <> source""",
    "p9_other_view": f"""WITH {STATES} SELECT state_id, state_id % 5 AS source, (state_id % 5 + 1 + {_i(17, 'state_id', chr(39) + 'other' + chr(39))} % 4) % 5 AS other
FROM states""",
    "p10_permutation": f"WITH {_PERM} SELECT * FROM perm",
    "p11_recombine": f"""WITH {_PERM}, s AS (SELECT batch_id, state_id, {_i(19, 'state_id')} % 5 AS source FROM states),
x AS (SELECT v.variant, p.batch_id, p.state_id, CASE WHEN v.variant IN ('shuffle_inv', 'shuffle_both') THEN p.mapped ELSE p.state_id END AS inv_state, CASE WHEN v.variant IN ('shuffle_dep', 'shuffle_both') THEN p.mapped ELSE p.state_id END AS dep_state FROM perm p, (VALUES ('self'), ('shuffle_inv'), ('shuffle_dep'), ('shuffle_both')) v(variant)),
y AS (SELECT x.*, s.source, unnest(range(5)) AS target FROM x JOIN s ON x.dep_state = s.state_id AND x.batch_id = s.batch_id) SELECT * FROM y WHERE target <> source""",
    "p12_rolled_negative": f"""WITH {STATES} SELECT batch_id, state_id, coalesce(lag(state_id) OVER w, max(state_id) OVER (PARTITION BY batch_id)) AS negative
FROM states WINDOW w AS (PARTITION BY batch_id ORDER BY state_id)""",
    "p13_primary_reference": f"""WITH {STATES},
v AS (SELECT batch_id, unnest(range(6))::INT AS view FROM (SELECT DISTINCT batch_id
FROM states)),
r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY {_h(23, 'batch_id', 'view')}, view) AS place
FROM v) SELECT batch_id, view, CASE WHEN place = 1 THEN 'primary' WHEN place <= 3 THEN 'reference' ELSE 'rest' END AS role
FROM r""",
    "p14_sample_rays": f"""WITH {STATES},
p AS (SELECT state_id, unnest(range(64))::INT AS pixel FROM (SELECT DISTINCT state_id
FROM states)),
c AS (SELECT state_id, pixel, row_number() OVER (PARTITION BY state_id ORDER BY pixel) - 1 AS pos, count(*) OVER (PARTITION BY state_id) AS n
FROM p WHERE pixel // 8 BETWEEN 2 AND 5 AND pixel % 8 BETWEEN 2 AND 5),
d AS (SELECT state_id, n, unnest(range(7))::INT AS draw FROM (SELECT DISTINCT state_id, n
FROM c)) SELECT d.state_id, d.draw, c.pixel
FROM d JOIN c ON d.state_id = c.state_id AND c.pos = {_i(29, 'd.state_id', 'd.draw')} % d.n""",
    "p15_swap_pairs": f"""WITH {T.LATENTS},
f AS (SELECT batch_id AS episode, state_id % 10 AS t, view_id AS camera FROM latents) SELECT a.episode, a.camera AS inv_camera, a.t AS inv_t,
b.camera AS dep_camera, b.t AS dep_t FROM f a
JOIN f b ON a.episode = b.episode AND b.t = CASE WHEN a.t = 0 THEN 1 ELSE 0 END AND a.camera <> b.camera""",
    "p16_allocate": f"""WITH {T.STREAMS},
v AS (SELECT DISTINCT episode, stream AS cam_idx FROM streams),
s AS (SELECT *, 5 // count(*) OVER (PARTITION BY episode) + CASE WHEN row_number() OVER (PARTITION BY episode ORDER BY cam_idx) - 1 < 5 % count(*) OVER (PARTITION BY episode) THEN 1 ELSE 0 END AS share
FROM v) SELECT episode, cam_idx, unnest(range(share)) AS run
FROM s""",
    "p17_sample_starts": f"""WITH {IDS},
v AS (SELECT actor, transition_id, count(*) OVER (PARTITION BY actor, episode ORDER BY step ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3 AS valid
FROM ids) SELECT actor, transition_id FROM v
WHERE valid ORDER BY {_h(31, 'actor', 'transition_id')}, actor, transition_id LIMIT 256""",
    "p17b_draw_starts": f"""WITH {IDS},
v AS (SELECT actor, transition_id, count(*) OVER (PARTITION BY actor, episode ORDER BY step ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3 AS valid
FROM ids),
r AS (SELECT actor, transition_id, row_number() OVER (ORDER BY {_h(31, 'actor', 'transition_id')}, actor, transition_id) - 1 AS place FROM v WHERE valid),
d AS (SELECT draw, {_i(31, 'draw')} % (SELECT count(*) FROM r) AS place FROM range((SELECT count(*) FROM lineitem)) AS t(draw))
SELECT draw, actor, transition_id FROM d JOIN r USING (place)""",
    "p18_limit_batches": f"WITH {T.LATENTS} SELECT batch_id, vec_id FROM latents WHERE batch_id < 3",
}
