"""Queries of keys, projections and joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.operators import joins as J
from episodica.operators import keys as K
from episodica.plans import tables as T

_NUMBER = "try_cast(replace(episode, 'demo', '') AS BIGINT)"


def lists(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes with their cameras in the order of their names: line items' numbers."""
    s = T.streams(spark, sf).select("episode", F.regexp_replace("stream", "_rgb$", "").alias("camera"), "stream").distinct()
    return s.groupBy("episode").agg(F.array_sort(F.collect_set("camera")).alias("camera_names"), F.array_sort(F.collect_set("stream")).alias("stream_names"))


LISTS = f"""{T.STREAMS},
lists AS (SELECT episode, list_sort(list(DISTINCT replace(stream, '_rgb', ''))) AS camera_names
FROM streams GROUP BY 1)"""


def _joined(column: str) -> Column:
    return F.array_join(column, ",")


def e1(spark: SparkSession, sf: str) -> DataFrame:
    return K.episode_position(T.catalogue(spark, sf), by=["env_name"]).select("episode", "place")


def e1b(spark: SparkSession, sf: str) -> DataFrame:
    return K.episode_position(T.catalogue(spark, sf), order="lexical", by=["env_name"]).select("episode", "place")


def e2(spark: SparkSession, sf: str) -> DataFrame:
    return K.first_episodes(T.catalogue(spark, sf), 50).select("episode", "env_name")


def e3(spark: SparkSession, sf: str) -> DataFrame:
    found = K.select_views(lists(spark, sf), 2, ["cam5", "cam2", "cam1"])
    return found.select("episode", _joined("views").alias("views"), _joined("missing").alias("missing"))


def e3b(spark: SparkSession, sf: str) -> DataFrame:
    found = K.select_views(lists(spark, sf), None, ["cam5", "cam2", "cam1"], dataset_order=True)
    return found.select("episode", _joined("views").alias("views"))


def e4(spark: SparkSession, sf: str) -> DataFrame:
    attr = F.when(F.col("episode").endswith("7"), F.to_json(F.reverse("camera_names")))
    return K.infer_views(lists(spark, sf).withColumn("camera_attr", attr)).select("episode", _joined("views").alias("views"))


def e5(spark: SparkSession, sf: str) -> DataFrame:
    return K.sample_index(T.catalogue(spark, sf), "num_samples", 4)


def e6(spark: SparkSession, sf: str) -> DataFrame:
    return K.common_length(T.streams(spark, sf).withColumn("n", F.col("n") - 2))


def e7(spark: SparkSession, sf: str) -> DataFrame:
    return K.drop_short(T.catalogue(spark, sf), "num_samples").select("episode", "num_samples")


def e8(spark: SparkSession, sf: str) -> DataFrame:
    steps = K.sample_index(T.catalogue(spark, sf), "num_samples")
    return K.select_timesteps(steps, "4,0:5:2,4", 7).select("episode", "t", "position")


def e9(spark: SparkSession, sf: str) -> DataFrame:
    frames = T.latents(spark, sf).select(F.col("batch_id").alias("episode"), F.col("state_id").alias("t"), F.concat(F.lit("cam"), F.col("view_id").cast("string")).alias("camera"), F.col("vec")[0].alias("x"))
    cameras = frames.select("episode", "camera").distinct().withColumn("cam_idx", 4 - F.substring("camera", 4, 1).cast("int"))
    found = K.assemble_views(frames, cameras, 5)
    return found.select("episode", "t", F.array_join(F.transform("views", lambda v: v["camera"]), ",").alias("cameras"), F.col("views")[0]["x"].alias("x_first"))


def e10(spark: SparkSession, sf: str) -> DataFrame:
    return K.project_vector(T.latents(spark, sf), "vec", [0, 1, 2, 3]).select("vec_id", *[F.col("proprio")[i].alias(f"p{i}") for i in range(4)])


def e11(spark: SparkSession, sf: str) -> DataFrame:
    pixel = F.col("l_quantity")
    modes = {m: K.scale_pixels(pixel, m) for m in ("signed", "unit", "centred")}
    found = T.read(spark, sf, "lineitem").select(pixel.alias("pixel"), *[F.round(x, 8).alias(m) for m, x in modes.items()], K.scale_pixels(modes["signed"] * 9, "to_bytes").alias("clamped"), F.round(K.standardise(pixel, 0.485, 0.229), 8).alias("standard"))
    return found.distinct()


def e12(spark: SparkSession, sf: str) -> DataFrame:
    nested = T.latents(spark, sf).withColumn("obs_env", F.struct(F.slice("vec", 1, 2).alias("obs")))
    found = K.resolve_field(K.resolve_field(nested, "obs_env/obs", "a"), "obs_env/other", "b")
    return found.select("vec_id", F.col("a")[1].alias("a1"), F.size("b").alias("b_size"))


def e13(spark: SparkSession, sf: str) -> DataFrame:
    tokens = T.latents(spark, sf).withColumn("tokens", F.array("z_inv", "z_dep"))
    found = K.collapse_features(K.collapse_features(tokens, "tokens", "mean", "m"), "tokens", "flatten", "f")
    return found.select("vec_id", F.round(F.col("m")[3], 8).alias("m3"), F.col("f")[40].alias("f40"), F.size("f").alias("n"))


def e14(spark: SparkSession, sf: str) -> DataFrame:
    found = K.state_vector(T.latents(spark, sf), "z_dep", "z_inv")
    return found.select("vec_id", F.size("state").alias("n"), F.col("state")[0].alias("s0"), F.col("state")[32].alias("s32"))


def e15(spark: SparkSession, sf: str) -> DataFrame:
    return T.read(spark, sf, "pages").select("page_id", K.safe_key("url").alias("key"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    o = T.read(spark, sf, "orders")
    name = F.concat(F.lit("runs/"), F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]+", "_")), F.lit("_seed"), (F.col("o_custkey") % 3).cast("string"), F.lit("/ckpt_step_"), (F.col("o_orderkey") * 500).cast("string"), F.lit(".pt"))
    return o.select("o_orderkey", name.alias("path"))


RUNS = """runs AS (SELECT o_orderkey, 'runs/' || lower(regexp_replace(o_orderpriority, '[^A-Za-z]+', '_', 'g')) || '_seed' || (o_custkey % 3) || '/ckpt_step_' || (o_orderkey * 500) || '.pt' AS path
FROM orders)"""


def e16(spark: SparkSession, sf: str) -> DataFrame:
    return K.run_catalog(runs(spark, sf)).select("o_orderkey", "step", "run", "short", _joined("tags").alias("tags"))


def e16b(spark: SparkSession, sf: str) -> DataFrame:
    return K.latest_checkpoint(K.run_catalog(runs(spark, sf)))


def e17(spark: SparkSession, sf: str) -> DataFrame:
    cameras = lists(spark, sf).select("episode", F.posexplode("camera_names").alias("cam_idx", "camera"))
    return K.parse_view_groups(cameras, "cam3,cam1;cam6").select("episode", "camera", "group")


def j1(spark: SparkSession, sf: str) -> DataFrame:
    pages = T.read(spark, sf, "pages").select("page_id", F.concat(F.lit("/"), F.regexp_replace("url", "[?#].*$", ""), F.lit("/traj.h5")).alias("file_path"))
    calibrations = pages.select(J.calibration_key("file_path", 3).alias("relative_path"), F.col("page_id").alias("calibration")).filter("calibration % 3 = 0 AND relative_path IS NOT NULL")
    return J.join_calibration(pages, calibrations, parts=3).select("page_id", "relative_path", "calibration")


def j2(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.read(spark, sf, "documents").select(F.col("source").alias("relative_path"), F.col("doc_id").alias("position"), "lang")
    return J.dedupe_calibration(rows)


def j3(spark: SparkSession, sf: str) -> DataFrame:
    episodes = T.catalogue(spark, sf)
    return J.resume_anti(episodes.select("episode", "k"), episodes.filter("k % 4 = 0"), 100, ["k"])


def j5(spark: SparkSession, sf: str) -> DataFrame:
    cameras = T.streams(spark, sf).groupBy("episode", F.regexp_replace("stream", "_rgb$", "").alias("camera")).agg(F.sum("n").alias("frames"))
    return J.attach_cameras(lists(spark, sf), cameras)


def j6(spark: SparkSession, sf: str) -> DataFrame:
    states = T.latents(spark, sf).select("state_id", "view_id", F.col("vec")[0].alias("x"))
    picks = states.select("state_id").distinct().select("state_id", F.posexplode(F.array(F.lit(4), F.lit(0), F.lit(4)).cast("array<bigint>")).alias("slot", "view_id"))
    return J.gather_views(states, picks).select("state_id", "slot", "view_id", "x")


def j7(spark: SparkSession, sf: str) -> DataFrame:
    s = T.streams(spark, sf).select("episode", "stream").distinct()
    return J.already_computed(s, s.filter("stream IN ('cam1_rgb', 'cam2_rgb')"), ["episode", "stream"])[1]


def j8(spark: SparkSession, sf: str) -> DataFrame:
    found = J.pair_similarity(T.latents(spark, sf), "batch_id", "vec_id", "vec", 0.5)
    return found.groupBy("batch_id", "q").agg(F.round(F.max(F.when(F.col("q") != F.col("k"), F.col("sim"))), 8).alias("best"), F.round(F.sum("sim"), 8).alias("total"))


_PATHS = """p AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '[?#].*$', ''), '/'), lambda x: x <> '') AS f
FROM pages),
keyed AS (SELECT page_id, CASE WHEN len(f) >= 3 THEN array_to_string(f[-3:], '/') END AS relative_path
FROM p)"""

QUERIES = {
    "e1_episode_order": e1, "e1b_lexical_order": e1b, "e2_first_episodes": e2, "e3_select_views": e3,
    "e3b_dataset_order_views": e3b, "e4_infer_views": e4, "e5_sample_index": e5, "e6_common_length": e6,
    "e7_drop_short": e7,
    "e8_select_timesteps": e8, "e9_assemble_views": e9, "e10_project_vector": e10, "e11_scale_pixels": e11,
    "e12_resolve_field": e12, "e13_collapse_features": e13, "e14_state_vector": e14, "e15_safe_key": e15,
    "e16_run_catalog": e16, "e16b_latest_checkpoint": e16b, "e17_view_groups": e17,
    "j1_join_calibration": j1, "j2_dedupe_calibration": j2, "j3_resume_anti": j3, "j5_attach_cameras": j5,
    "j6_gather_views": j6, "j7_already_computed": j7, "j8_pair_similarity": j8,
}

ORACLE_SQL = {
    "e1_episode_order": f"""WITH {T.CATALOGUE} SELECT episode, row_number() OVER (PARTITION BY env_name ORDER BY {_NUMBER} NULLS LAST, episode) - 1 AS place
FROM catalogue""",
    "e1b_lexical_order": f"""WITH {T.CATALOGUE} SELECT episode, row_number() OVER (PARTITION BY env_name ORDER BY episode) - 1 AS place
FROM catalogue WHERE lower(episode) LIKE 'demo%'""",
    "e2_first_episodes": f"WITH {T.CATALOGUE} SELECT episode, env_name FROM catalogue ORDER BY {_NUMBER} NULLS LAST, episode LIMIT 50",
    "e3_select_views": f"""WITH {LISTS} SELECT episode, array_to_string(list_filter(['cam5', 'cam2', 'cam1'], lambda x: list_contains(camera_names, x))[1:2], ',') AS views,
array_to_string(list_filter(['cam5', 'cam2', 'cam1'], lambda x: NOT list_contains(camera_names, x)), ',') AS missing
FROM lists""",
    "e3b_dataset_order_views": f"""WITH {LISTS} SELECT episode, array_to_string(list_filter(camera_names, lambda x: list_contains(['cam5', 'cam2', 'cam1'], x)), ',') AS views
FROM lists""",
    "e4_infer_views": f"""WITH {LISTS} SELECT episode, array_to_string(CASE WHEN episode LIKE '%7' THEN list_reverse(camera_names) ELSE camera_names END, ',') AS views
FROM lists""",
    "e5_sample_index": f"WITH {T.CATALOGUE} SELECT episode, unnest(range(least(num_samples, 4))) AS t FROM catalogue",
    "e6_common_length": f"""WITH {T.STREAMS} SELECT episode, min(n - 2) AS common, count(*) AS n_streams
FROM streams GROUP BY 1 HAVING min(n - 2) > 0""",
    "e7_drop_short": f"WITH {T.CATALOGUE} SELECT episode, num_samples FROM catalogue WHERE num_samples >= 2",
    "e8_select_timesteps": f"""WITH {T.CATALOGUE},
s AS (SELECT episode, unnest(range(num_samples)) AS t FROM catalogue) SELECT episode, t, CASE t WHEN 4 THEN 0 WHEN 0 THEN 1 ELSE 2 END::BIGINT AS position
FROM s WHERE t IN (0, 2, 4)""",
    "e9_assemble_views": f"""WITH {T.LATENTS} SELECT batch_id AS episode, state_id AS t, string_agg('cam' || view_id, ',' ORDER BY view_id DESC) AS cameras, arg_max(vec[1],
view_id) AS x_first FROM latents GROUP BY 1, 2 HAVING count(*) = 5""",
    "e10_project_vector": f"WITH {T.LATENTS} SELECT vec_id, vec[1] AS p0, vec[2] AS p1, vec[3] AS p2, vec[4] AS p3 FROM latents",
    "e11_scale_pixels": """SELECT DISTINCT l_quantity AS pixel, round(l_quantity / 255 * 2 - 1, 8) AS signed, round(l_quantity / 255, 8) AS unit, round(l_quantity / 255 - 0.5::DOUBLE,
8) AS centred, floor(least(greatest(((l_quantity / 255 * 2 - 1) * 9 + 1) / 2, 0), 1) * 255)::INT AS clamped, round((l_quantity / 255 - 0.485::DOUBLE) / 0.229::DOUBLE,
8) AS standard FROM lineitem""",
    "e12_resolve_field": f"WITH {T.LATENTS} SELECT vec_id, vec[2] AS a1, 0::INT AS b_size FROM latents",
    "e13_collapse_features": f"""WITH {T.LATENTS} SELECT vec_id, round((z_inv[4] + z_dep[4]) / 2, 8) AS m3, z_dep[9] AS f40, 64::INT AS n
FROM latents""",
    "e14_state_vector": f"WITH {T.LATENTS} SELECT vec_id, 64::INT AS n, z_dep[1] AS s0, z_inv[1] AS s32 FROM latents",
    "e15_safe_key": r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}_-]', '_', 'g') AS key FROM pages",
    "e16_run_catalog": f"""WITH {RUNS},
x AS (SELECT o_orderkey, o_orderkey * 500 AS step, regexp_replace(string_split(path, '/')[-2], '_seed[0-9]+', '') AS run
FROM runs) SELECT o_orderkey, step, run, CASE WHEN step >= 1000 AND step % 1000 = 0 THEN (step // 1000) || 'k' ELSE step::VARCHAR END AS short,
(SELECT string_agg(DISTINCT_TAG, ',' ORDER BY i) FROM (SELECT tag AS DISTINCT_TAG, min(i) AS i
FROM (SELECT unnest(string_split(run, '_')) AS tag, generate_subscripts(string_split(run, '_'), 1) AS i)
GROUP BY tag)) AS tags FROM x""",
    "e16b_latest_checkpoint": f"""WITH {RUNS} SELECT regexp_replace(string_split(path, '/')[-2], '_seed[0-9]+', '') AS run, max(path) AS latest
FROM runs GROUP BY 1""",
    "e17_view_groups": f"WITH {LISTS}, c AS (SELECT episode, unnest(camera_names) AS camera FROM lists), k AS (SELECT *, CASE WHEN camera IN ('cam3', 'cam1') THEN 0 WHEN camera = 'cam6' THEN 1 END AS known FROM c) SELECT episode, camera, coalesce(known, 1 + row_number() OVER (PARTITION BY episode, known IS NULL ORDER BY camera))::BIGINT AS \"group\" FROM k",
    "j1_join_calibration": f"""WITH {_PATHS} SELECT a.page_id, a.relative_path, b.page_id AS calibration
FROM keyed a JOIN keyed b ON a.relative_path = b.relative_path
WHERE b.page_id % 3 = 0""",
    "j2_dedupe_calibration": """SELECT source AS relative_path, max(doc_id) AS position, arg_max(lang, doc_id) AS lang
FROM documents WHERE source <> '' GROUP BY 1""",
    "j3_resume_anti": f"""WITH {T.CATALOGUE},
f AS (SELECT episode, k FROM catalogue ORDER BY k LIMIT 100) SELECT episode, k
FROM f WHERE k % 4 <> 0""",
    "j5_attach_cameras": f"""WITH {LISTS},
c AS (SELECT episode, replace(stream, '_rgb', '') AS camera, sum(n)::BIGINT AS frames
FROM streams GROUP BY 1, 2) SELECT l.episode, list_position(l.camera_names, c.camera)::INT - 1 AS cam_pos, c.camera, c.frames
FROM lists l JOIN c USING (episode)""",
    "j6_gather_views": f"""WITH {T.LATENTS},
p AS (SELECT * FROM (VALUES (0, 4::BIGINT), (1, 0), (2, 4)) v(slot, view_id)) SELECT state_id, slot, view_id, vec[1] AS x
FROM latents JOIN p USING (view_id)""",
    "j7_already_computed": f"WITH {T.STREAMS} SELECT DISTINCT episode, stream FROM streams WHERE stream NOT IN ('cam1_rgb', 'cam2_rgb')",
    "j8_pair_similarity": f"""WITH {T.LATENTS},
s AS (SELECT a.batch_id, a.vec_id AS q, b.vec_id AS k, list_dot_product(a.vec, b.vec) / 0.5::DOUBLE AS sim
FROM latents a JOIN latents b USING (batch_id)) SELECT batch_id, q, round(max(CASE WHEN q <> k THEN sim END), 8) AS best, round(sum(sim),
8) AS total FROM s GROUP BY 1, 2""",
}
