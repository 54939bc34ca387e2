"""Queries of sources and sinks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.operators import gaussians as G
from episodica.plans import tables as T
from episodica.plans.camera_queries import clouds
from episodica.plans.key_queries import LISTS, lists
from episodica.plans.window_queries import IDS
from episodica.plans.stream_queries import shared
from episodica.sources import episodes as S
from episodica.sources import jsonmap as JM
from episodica.sources import layout as LY
from episodica.sources import translog as L
from episodica.streaming import replay as R


def s2(spark: SparkSession, sf: str) -> DataFrame:
    new = T.read(spark, sf, "supplier").select("s_suppkey")
    return S.next_keys(new, T.catalogue(spark, sf), ["s_suppkey"])


def s3(spark: SparkSession, sf: str) -> DataFrame:
    old = T.catalogue(spark, sf).select("episode", "num_samples")
    new = T.catalogue(spark, sf).filter("k % 5 = 0").select("episode", F.lit(-1).cast("long").alias("num_samples"))
    return S.replace_episodes(old, new)


def s4(spark: SparkSession, sf: str) -> DataFrame:
    episodes = T.catalogue(spark, sf).join(lists(spark, sf), "episode", "left").filter("k % 9 <> 0").select("episode", "camera_names")
    streams = T.streams(spark, sf).filter("NOT (stream = 'cam2_rgb' AND n > 45)").select("episode", "stream")
    cameras = T.streams(spark, sf).filter("n > 3").select("episode", F.regexp_replace("stream", "_rgb$", "").alias("camera"))
    return S.validate_layout(episodes, cameras, streams, ["cam1", "cam2"])


def calibration_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrations of customers as JSON maps of a hundred entries: (file, value)."""
    row = lambda x: F.array(*[F.lit(1.0) if i == x else F.lit(0.0) for i in range(4)])
    camera = lambda focal: F.struct(F.array(*[row(i) for i in range(4)]).alias("pose"), focal.alias("focal"), F.array(F.lit(320.0), F.col("c_acctbal")).alias("principal_point"))
    path = F.concat_ws("/", F.lit("lab"), "c_mktsegment", "c_name")
    key = F.col("c_custkey")
    left, right = camera(key * 0.5), camera(key * 0.5 + 1)
    entry = F.struct(left.alias("left_cam"), right.alias("right_cam"), path.alias("relative_path"), F.col("c_nationkey").alias("quality_metric"))
    maps = T.read(spark, sf, "customer").groupBy(F.floor(key / 100).alias("file")).agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), entry.alias("v")))).alias("e"))
    named = F.transform("e", lambda x: F.struct(F.concat(F.lit("demo"), x["k"].cast("string")), x["v"]))
    return maps.select("file", F.to_json(F.map_from_entries(named)).alias("value"))


def s5(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrations of customers, written as JSON maps of a hundred entries, and read back."""
    root = shared(spark, "calibrations")
    calibration_maps(spark, sf).write.partitionBy("file").text(root)
    found = S.read_calibrations(spark, root)
    return found.select("position", "episode_id", F.col("left_cam.focal").alias("left_focal"), F.col("right_cam.principal_point")[1].alias("right_y"), F.col("left_cam.pose")[2][2].alias("z"), "relative_path", "quality_metric")


def s5b(spark: SparkSession, sf: str) -> DataFrame:
    """The calibrations of s5, each file read by byte ranges and its entries parsed one by one."""
    root = shared(spark, "calibration-maps")
    calibration_maps(spark, sf).write.partitionBy("file").text(root)
    found = JM.read_json_map(spark, root, S.CALIBRATION.removeprefix("map<string,").removesuffix(">"), ("episode_id", "c")).select(F.col("position").cast("int").alias("position"), "episode_id", "c.*")
    return found.select("position", "episode_id", F.col("left_cam.focal").alias("left_focal"), F.col("right_cam.principal_point")[1].alias("right_y"), F.col("left_cam.pose")[2][2].alias("z"), "relative_path", "quality_metric")


def s6(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of metadata for each hundred customers, written as JSON and read back with the folder's name."""
    root = shared(spark, "metadata")
    c = T.read(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 100).alias("folder"))
    rows = c.agg(F.count(F.lit(1)).alias("num_frames"), F.max("c_name").alias("task"))
    spread = rows.repartition(4 * spark.sparkContext.defaultParallelism)  # few bytes, which AQE would leave to one task, but a file each
    spread.write.partitionBy("folder").json(root)
    found = S.read_episode_metadata(spark, root, "*.json")
    return found.select(F.regexp_replace("episode", "folder=", "demo").alias("episode"), "num_frames", "task")


def s7(spark: SparkSession, sf: str) -> DataFrame:
    name = F.format_string("runs/%s/cam%d/%s%06d.png", F.concat(F.lit("ep"), F.col("conv_id").cast("string")), F.col("turn") % 2, F.when(F.col("turn") % 3 == 0, "t_").otherwise(""), F.col("turn"))
    return T.read(spark, sf, "conversations").select(S.parse_frame_path(name).alias("f")).select("f.*")


def s8(spark: SparkSession, sf: str) -> DataFrame:
    steps = F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n"))))
    nested = T.read(spark, sf, "conversations").groupBy(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("file_path")).agg(steps.alias("steps"))
    return S.explode_nested(nested)


def frames(spark: SparkSession, sf: str) -> DataFrame:
    c = T.read(spark, sf, "conversations")
    return c.select(F.concat(F.lit("demo"), F.col("conv_id").cast("string")).alias("episode"), F.col("turn").alias("t"), F.col("role").alias("camera"), F.col("turn").alias("cam_idx"), F.length("text").alias("height"), F.octet_length("text").alias("width"), F.encode("text", "UTF-8").alias("rgb"), F.when(F.col("turn") % 2 == 0, F.encode("role", "UTF-8")).alias("seg"), F.lit(None).cast("binary").alias("seg_type"))


def s9(spark: SparkSession, sf: str) -> DataFrame:
    return S.export_keys(frames(spark, sf), ["user", "assistant"], 4, seg=True).select("blob_key", "kind", F.octet_length("blob").alias("n"))


def s11(spark: SparkSession, sf: str) -> DataFrame:
    """Features by a stand-in for a model, the share of spaces and the length of each blob."""
    f = frames(spark, sf)
    done = f.filter("camera = 'user' AND episode < 'demo2'").select("episode", "camera", F.lit("m").alias("model"))
    found = S.backfill_features(f, done, "m", lambda blobs: [[b.count(b" ") / max(1, len(b)), float(len(b))] for b in blobs], (1, 1))
    return found.select("episode", "t", "camera", "grid_h", F.col("feature")[1].cast("double").alias("length"))


def s12(spark: SparkSession, sf: str) -> DataFrame:
    """The states of the log: one for each transition, and the terminal one that follows an end."""
    return S.episode_states(S.add_transitions(T.log(spark, sf)))


def s12b(spark: SparkSession, sf: str) -> DataFrame:
    """The log appended in three parts of time and read as a stream by its positions; each part is a micro-batch of a query that starts anew."""
    path, out = shared(spark, "translog"), shared(spark, "ingested")
    log = T.log(spark, sf)
    at = F.unix_micros("ts").cast("double")
    cuts = log.select(at.alias("x")).approxQuantile("x", [1 / 3, 2 / 3], 0.01)
    for i, (low, high) in enumerate(zip([float("-inf"), *cuts], [*cuts, float("inf")], strict=True)):
        L.append_log(log.filter((at >= low) & (at < high)), path, "collector", i)
        stream = L.stream_log(spark, path).drop(L.POSITION)
        query = stream.writeStream.foreachBatch(lambda batch, number: R.ingest_batch(batch, number, out)).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start()
        query.awaitTermination()
    return S.episode_states(R.read_ingested(spark, out))


def s13(spark: SparkSession, sf: str) -> DataFrame:
    return S.image_size(frames(spark, sf))


def s1(spark: SparkSession, sf: str) -> DataFrame:
    """The four tables written, read back as a dataset, and counted by episode; the frames' blobs stay unread."""
    root = shared(spark, "dataset")
    f = frames(spark, sf)
    tables = {"episodes": f.groupBy("episode").agg(F.count(F.lit(1)).alias("num_samples")), "cameras": f.select("episode", "camera").distinct(), "steps": f.select("episode", "t"), "frames": f}
    for name, table in tables.items():
        table.write.parquet(f"{root}/{name}")
    data = S.read_episodes(spark, root)
    views = data.cameras.groupBy("episode").agg(F.count(F.lit(1)).alias("n_cameras"))
    sizes = data.frames.groupBy("episode").agg(F.sum("width").cast("long").alias("n_bytes"))
    return data.episodes.join(views, "episode").join(sizes, "episode")


def s1b(spark: SparkSession, sf: str) -> DataFrame:
    """The tables of s1 bucketed by episode, so that their joins and sums exchange nothing."""
    f = frames(spark, sf)
    tables = S.Dataset(f.groupBy("episode").agg(F.count(F.lit(1)).alias("num_samples")), f.select("episode", "camera").distinct(), f.select("episode", "t"), f)
    root = shared(spark, "bucketed")
    data = LY.store_dataset(tables, root, root.rsplit("/", 1)[-1].replace("-", "_"), buckets=16)
    views = data.cameras.groupBy("episode").agg(F.count(F.lit(1)).alias("n_cameras"))
    sizes = data.frames.groupBy("episode").agg(F.sum("width").cast("long").alias("n_bytes"))
    return data.episodes.join(views, "episode").join(sizes, "episode")


def s10(spark: SparkSession, sf: str) -> DataFrame:
    vertices = G.vertex_properties(G.to_world(G.activate(clouds(spark, sf))).withColumn("t", F.lit(0))).select("episode", "cam_idx", "t", "x", "opacity", "rot_0")
    return S.write_vertices(vertices, shared(spark, "vertices"), ["episode", "cam_idx", "t"])


QUERIES = {"s1_read_episodes": s1, "s1b_bucketed_dataset": s1b, "s5b_json_map_ranges": s5b, "s10_write_vertices": s10, "s2_append_keys": s2, "s3_replace_episode": s3, "s4_validate_layout": s4, "s5_read_calibrations": s5, "s6_episode_metadata": s6, "s7_frame_paths": s7, "s8_explode_nested": s8, "s9_export_keys": s9, "s11_backfill_features": s11, "s12_transition_states": s12, "s12b_log_source": s12b, "s13_image_size": s13}

_F = """frames AS (SELECT 'demo' || conv_id AS episode, turn AS t, role AS camera, length(text)::INT AS height, strlen(text)::INT AS width
FROM conversations)"""
ORACLE_SQL = {
    "s1_read_episodes": """SELECT 'demo' || conv_id AS episode, count(*) AS num_samples, count(DISTINCT role) AS n_cameras, sum(strlen(text))::BIGINT AS n_bytes
FROM conversations GROUP BY 1""",
    "s10_write_vertices": """SELECT vec_id // 5 AS episode, vec_id % 5 AS cam_idx, 0::INT AS t, count(*) * 2 AS n_vertices
FROM embeddings GROUP BY 1, 2""",
    "s2_append_keys": f"""WITH {T.CATALOGUE} SELECT s_suppkey, 'demo' || (row_number() OVER (ORDER BY s_suppkey) + (SELECT max(k)
FROM catalogue)) AS episode FROM supplier""",
    "s3_replace_episode": f"""WITH {T.CATALOGUE} SELECT episode, CASE WHEN k % 5 = 0 THEN -1 ELSE num_samples END AS num_samples
FROM catalogue""",
    "s4_validate_layout": f"""WITH {LISTS}, {T.CATALOGUE}, e AS (SELECT c.episode, l.camera_names FROM catalogue c LEFT JOIN lists l USING (episode) WHERE k % 9 <> 0), v AS (SELECT episode, camera_names, unnest(['cam1', 'cam2']) AS view FROM e WHERE len(camera_names) > 0),
p AS (SELECT episode, view FROM v WHERE list_contains(camera_names, view)), st AS (SELECT * FROM streams WHERE NOT (stream = 'cam2_rgb' AND n > 45))
SELECT episode, 'no_camera_names' AS problem, NULL::VARCHAR AS view FROM e WHERE camera_names IS NULL OR len(camera_names) = 0 UNION ALL SELECT episode, 'view_absent', view FROM v WHERE NOT list_contains(camera_names, view)
UNION ALL SELECT episode, 'stream_missing', view FROM p WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.episode = p.episode AND st.stream = p.view || '_rgb')
UNION ALL SELECT episode, 'parameters_missing', view FROM p WHERE NOT EXISTS (SELECT 1 FROM streams s WHERE s.episode = p.episode AND s.stream = p.view || '_rgb' AND s.n > 3)
UNION ALL SELECT DISTINCT episode, 'unknown_episode', NULL FROM st WHERE episode NOT IN (SELECT episode FROM e)""",
    "s5_read_calibrations": """SELECT row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey)::INT - 1::INT AS position, 'demo' || c_custkey AS episode_id,
c_custkey * 0.5::DOUBLE AS left_focal, c_acctbal AS right_y, 1.0::DOUBLE AS z, 'lab/' || c_mktsegment || '/' || c_name AS relative_path, c_nationkey AS quality_metric FROM customer""",
    "s6_episode_metadata": """SELECT 'demo' || c_custkey // 100 AS episode, count(*) AS num_frames, max(c_name) AS task
FROM customer GROUP BY 1""",
    "s7_frame_paths": "SELECT 'ep' || conv_id AS episode, 'cam' || (turn % 2) AS camera, turn AS t FROM conversations",
    "s8_explode_nested": """SELECT 'conv/' || conv_id AS file_path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame_idx, turn, length(text) AS n
FROM conversations""",
    "s9_export_keys": f"""WITH {_F},
k AS (SELECT *, '' AS kind, width AS n FROM frames UNION ALL SELECT *, '_seg', strlen(camera)::INT
FROM frames WHERE t % 2 = 0) SELECT episode || '/' || camera || kind || '/t_' || lpad(t::VARCHAR, 6, '0') AS blob_key, kind, n
FROM k WHERE camera IN ('user', 'assistant') AND t < 4""",
    "s11_backfill_features": f"""WITH {_F} SELECT episode, t, camera, 1::INT AS grid_h, width::DOUBLE AS length
FROM frames WHERE NOT (camera = 'user' AND episode < 'demo2')""",
    "s12_transition_states": f"""WITH {IDS} SELECT actor, state_id, episode, step, true AS has_transition
FROM ids UNION ALL SELECT actor, state_id + 1, episode, step + 1, false
FROM ids WHERE done""",
    "s13_image_size": f"WITH {_F} SELECT episode, arg_min(height, t) AS height, arg_min(width, t) AS width FROM frames GROUP BY 1",
}
ORACLE_SQL |= {"s12b_log_source": ORACLE_SQL["s12_transition_states"], "s1b_bucketed_dataset": ORACLE_SQL["s1_read_episodes"], "s5b_json_map_ranges": ORACLE_SQL["s5_read_calibrations"]}
