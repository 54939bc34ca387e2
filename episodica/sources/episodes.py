"""Reading, appending, checking and exporting episode tables kept as Parquet."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from episodica.operators.ranks import ordered_rank
from episodica.operators.windows import assign_ids

TABLES = ("episodes", "cameras", "steps", "frames")


@dataclass(frozen=True)
class Dataset:
    """The four tables of a dataset. Frames are apart, so that nothing else reads their blobs."""

    episodes: DataFrame
    cameras: DataFrame
    steps: DataFrame
    frames: DataFrame

    @property
    def total(self) -> int:
        return self.episodes.count()


def read_episodes(spark: SparkSession, root: str) -> Dataset:
    return Dataset(*(spark.read.parquet(f"{root}/{name}") for name in TABLES))


def next_keys(new: DataFrame, existing: DataFrame | None, order: Sequence[str], key: str = "episode") -> DataFrame:
    """``new`` with keys demo<n> that follow the largest number there (from 1), in order; ranges of the order are numbered apart."""
    base = 0
    if existing is not None:
        base = existing.agg(F.max(F.expr(f"try_cast(nullif(regexp_extract({key}, '([0-9]+)$', 1), '') AS bigint)"))).first()[0] or 0
    ranked = ordered_rank(new, *order, name="__rank")
    return ranked.withColumn(key, F.concat(F.lit("demo"), (F.col("__rank") + 1 + base).cast("string"))).drop("__rank")


def append_episodes(new: DataFrame, path: str, order: Sequence[str], resume: bool = True) -> DataFrame:
    """Writes new episodes under fresh keys: after those there (resume), or instead of them. Returns what was written."""
    spark = new.sparkSession
    existing = spark.read.parquet(path) if resume and _there(spark, path) else None
    keyed = next_keys(new, existing, order)
    keyed.write.mode("append" if resume else "overwrite").parquet(path)
    return keyed


def _there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def replace_episodes(existing: DataFrame, new: DataFrame, key: Sequence[str] = ("episode",)) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those with their keys."""
    return existing.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


#: Folders that a stored table's episodes are dealt to: what is rewritten when one is replaced.
BUCKETS = 64


def _bucket(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def store_episodes(df: DataFrame, path: str, key: Sequence[str] = ("episode",), buckets: int = BUCKETS) -> None:
    """Writes ``df`` by buckets of its key, so that :func:`replace_stored` rewrites few of them."""
    df.withColumn("bucket", _bucket(key, buckets)).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)


def replace_stored(new: DataFrame, path: str, key: Sequence[str] = ("episode",), buckets: int = BUCKETS) -> None:
    """Replaces, in the table that :func:`store_episodes` wrote, the rows with the keys of ``new``; episodes that aren't there are added.

    Only the buckets of those keys are read and written again; Spark puts them in place when the whole write is done.
    """
    spark = new.sparkSession
    marked = new.withColumn("bucket", _bucket(key, buckets))
    touched = [r[0] for r in marked.select("bucket").distinct().collect()]  # at most ``buckets``
    stored = spark.read.parquet(path)
    old = stored.filter(F.col("bucket").isin(touched)).select(marked.columns)
    whole = replace_episodes(old, marked, key)
    whole.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").partitionBy("bucket").mode("overwrite").parquet(path)


def add_transitions(new: DataFrame, last: DataFrame | None = None, actor: str = "actor", order: Sequence[str] = ("ts", "event_id"), done: str = "done", span: float | None = None) -> DataFrame:
    """``new`` transitions with transition_id, episode, step and state_id, which follow those in ``last`` (actor, transition_id, episode,
    step, done: each actor's last transition; null or absent: none yet). A state stands before each transition, one more after an end. With a ``span``
    (see :func:`assign_ids`) no actor is one task."""
    steps = assign_ids(new, actor, order, done, span)
    if last is None:
        return steps
    ended = F.col(done).cast("long")
    before = last.select(F.col(actor), (F.col("transition_id") + 1).alias("__t"), (F.col("episode") + ended).alias("__e"), F.when(F.col(done), 0).otherwise(F.col("step") + 1).alias("__s"))
    joined = steps.join(before, actor, "left")
    plus = lambda c, x: F.col(c) + F.coalesce(x, F.lit(0))
    step = F.when(F.col("episode") == 0, plus("step", F.col("__s"))).otherwise(F.col("step"))
    moved = joined.withColumns({"transition_id": plus("transition_id", F.col("__t")), "state_id": plus("state_id", F.col("__t") + F.col("__e")), "episode": plus("episode", F.col("__e")), "step": step})
    return moved.select(steps.columns)


def episode_states(steps: DataFrame, actor: str = "actor", done: str = "done") -> DataFrame:
    """(actor, state_id, episode, step, has_transition): the state before each transition, and the terminal one after an end."""
    rows = [F.struct(F.col("state_id"), F.col("step"), F.lit(True).alias("has_transition")), F.struct((F.col("state_id") + 1).alias("state_id"), (F.col("step") + 1).alias("step"), F.lit(False).alias("has_transition"))]
    both = F.when(F.col(done), F.array(*rows)).otherwise(F.array(rows[0]))
    return steps.select(actor, "episode", F.explode(both).alias("s")).select(actor, "s.state_id", "episode", "s.step", "s.has_transition")


def validate_layout(episodes: DataFrame, cameras: DataFrame, streams: DataFrame, views: Sequence[str], strict: bool = False) -> DataFrame:
    """(episode, problem, view): no_camera_names, view_absent, stream_missing, parameters_missing, unknown_episode. ``strict`` raises if any.

    Each table is read once; its facts meet in one aggregation by episode, whose lists are no longer than an episode's cameras.
    """
    names, nothing = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    facts = episodes.select("episode", F.lit(True).alias("listed"), F.col("camera_names").alias("names"), nothing.alias("rgb"), nothing.alias("camera"), F.lit(False).alias("stream"))
    view = F.when(F.col("stream").endswith("_rgb"), F.regexp_replace("stream", "_rgb$", ""))
    facts = facts.unionByName(streams.select("episode", F.lit(False).alias("listed"), names.alias("names"), view.alias("rgb"), nothing.alias("camera"), F.lit(True).alias("stream")))
    facts = facts.unionByName(cameras.select("episode", F.lit(False).alias("listed"), names.alias("names"), nothing.alias("rgb"), "camera", F.lit(False).alias("stream")))
    by = facts.groupBy("episode").agg(F.max("listed").alias("listed"), F.first("names", ignorenulls=True).alias("names"), F.collect_set("rgb").alias("rgb"), F.collect_set("camera").alias("cameras"), F.max("stream").alias("stream"))
    problem = lambda name, test, view=None: F.when(test, F.struct(F.lit(name).alias("problem"), F.lit(view).cast("string").alias("view")))
    some = F.col("listed") & (F.coalesce(F.size("names"), F.lit(0)) > 0)
    found = [problem("no_camera_names", F.col("listed") & ~some), problem("unknown_episode", ~F.col("listed") & F.col("stream"))]
    for v in views:
        has = F.array_contains("names", v)
        found += [problem("view_absent", some & ~has, v), problem("stream_missing", some & has & ~F.array_contains("rgb", v), v), problem("parameters_missing", some & has & ~F.array_contains("cameras", v), v)]
    problems = by.select("episode", F.explode(F.array_compact(F.array(*found))).alias("p")).select("episode", "p.problem", "p.view")
    if strict and (bad := problems.first()):
        raise ValueError(f"{bad['episode']}: {bad['problem']} {bad['view'] or ''}")
    return problems


CALIBRATION = "map<string,struct<left_cam:struct<pose:array<array<double>>,focal:double,principal_point:array<double>>,right_cam:struct<pose:array<array<double>>,focal:double,principal_point:array<double>>,relative_path:string,quality_metric:int>>"


def read_calibrations(spark: SparkSession, path: str) -> DataFrame:
    """One row for each entry of the JSON map, with its position in it."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", CALIBRATION).alias("m"))
    return raw.select(F.posexplode("m").alias("position", "episode_id", "c")).select("position", "episode_id", "c.*")


def read_episode_metadata(spark: SparkSession, root: str, name: str = "metadata.json") -> DataFrame:
    """The metadata of each folder that has a file called ``name`` (a pattern), with the folder's name as episode.

    The columns are inferred from all files in tasks that read many of them each; left to Spark's reader of multi-line files, the driver would look at each file in turn.
    """

    def text(row: Row) -> str:  # in whichever of JSON's encodings it is; for other bytes a character that is no JSON
        try:
            return row["content"].decode(json.detect_encoding(row["content"]))
        except UnicodeDecodeError:
            return "\ufffd"

    path = f"{root}/*/{name}"
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    spark.conf.set(setting, min(int(before), 4 * spark.sparkContext.defaultParallelism))  # files are listed in as many tasks, not one each
    try:
        content = spark.read.format("binaryFile").load(path).select("content")
        schema = spark.read.json(content.rdd.map(text)).schema
        found = spark.read.schema(schema).option("multiLine", True).json(path)
    finally:
        spark.conf.set(setting, before)
    return found.withColumn("episode", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def parse_frame_path(path: str | Column) -> Column:
    """(episode, camera, t) of <episode>/<camera>/00012.png and <episode>/<camera>/t_000012.png."""
    pattern = r"([^/]+)/([^/]+)/(?:t_)?([0-9]+)\.png$"
    part = lambda i: F.regexp_extract(path, pattern, i)
    return F.struct(part(1).alias("episode"), part(2).alias("camera"), F.nullif(part(3), F.lit("")).cast("long").alias("t"))


def frame_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(episode, camera, t, path, length) of the images below ``root``; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(root).select("path", "length")
    return files.withColumn("f", parse_frame_path("path")).filter("f.t IS NOT NULL").select("f.*", "path", "length")


def explode_nested(episodes: DataFrame, steps: str = "steps", key: Sequence[str] = ("file_path",)) -> DataFrame:
    """A row for each nested step, with frame_idx from 0."""
    return episodes.select(*key, F.posexplode(steps).alias("frame_idx", "step")).select(*key, F.col("frame_idx").cast("long").alias("frame_idx"), "step.*")


def export_keys(frames: DataFrame, cameras: Sequence[str] | None = None, max_frames: int | None = None, seg: bool = False) -> DataFrame:
    """(blob_key, episode, kind, blob) of the images to export: <episode>/<camera>[_seg|_seg_type]/t_<6 digits>."""
    kept = frames if cameras is None else frames.filter(F.col("camera").isin(list(cameras)))
    kept = (kept if max_frames is None else kept.filter(F.col("t") < max_frames)).filter(F.col("rgb").isNotNull())
    kinds = [("", "rgb")] + ([("_seg", "seg"), ("_seg_type", "seg_type")] if seg else [])
    blobs = kept.select("episode", "camera", "t", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("blob")) for k, c in kinds])).alias("b")).filter("b.blob IS NOT NULL")
    return blobs.select(F.format_string("%s/%s%s/t_%06d", "episode", "camera", "b.kind", "t").alias("blob_key"), "episode", F.col("b.kind").alias("kind"), F.col("b.blob").alias("blob"))


def export_frames(frames: DataFrame, path: str, **options: object) -> int:
    """Writes the exported blobs by episode; the number saved, as observed while writing."""
    seen = Observation("export")
    export_keys(frames, **options).observe(seen, F.count(F.lit(1)).alias("saved")).write.partitionBy("episode").mode("overwrite").parquet(path)
    return seen.get["saved"]


def write_vertices(vertices: DataFrame, path: str, by: Sequence[str]) -> DataFrame:
    """Writes flat vertex columns; the manifest: vertices by export."""
    vertices.write.mode("overwrite").parquet(path)
    return vertices.sparkSession.read.parquet(path).groupBy(*by).agg(F.count(F.lit(1)).alias("n_vertices"))


def backfill_features(frames: DataFrame, existing: DataFrame | None, model: str, fn: Callable[[list[bytes]], list[list[float]]], grid: tuple[int, int], key: Sequence[str] = ("episode", "t", "camera")) -> DataFrame:
    """(key, model, grid_h, grid_w, feature) of the cameras of an episode that have none of the model yet; ``fn`` computes a batch."""
    if grid[0] != grid[1]:
        raise ValueError(f"the token grid {grid} is not square")
    todo = frames if existing is None else frames.join(existing.filter(F.col("model") == model).select("episode", "camera").distinct(), ["episode", "camera"], "left_anti")
    ready = todo.select(*key, "rgb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fn(batch.column(len(key)).to_pylist()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], pa.array(found, pa.list_(pa.float32()))], names=[*key, "feature"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ready.schema.fields[: len(key)])
    return ready.mapInArrow(run, f"{schema}, feature array<float>").withColumns({"model": F.lit(model), "grid_h": F.lit(grid[0]), "grid_w": F.lit(grid[1])})


def image_size(frames: DataFrame) -> DataFrame:
    """(episode, height, width) by the first camera."""
    return frames.groupBy("episode").agg(F.min_by(F.struct("height", "width"), "cam_idx").alias("s")).select("episode", "s.height", "s.width")
