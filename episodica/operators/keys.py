"""Keys, filters and projections of episode catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.functions.checks import none_of, not_empty


def episode_number(key: str | Column) -> Column:
    """The number in keys such as demo12; null for others."""
    return F.expr(f"try_cast(regexp_replace({key}, 'demo', '') AS bigint)") if isinstance(key, str) else F.regexp_replace(key, "demo", "").try_cast("bigint")


def episode_order(df: DataFrame, key: str = "episode", order: str = "numeric") -> list[Column]:
    """Sort columns: by number, other keys last, ties by name; or 'lexical'."""
    return [F.col(key)] if order == "lexical" else [episode_number(key).asc_nulls_last(), F.col(key)]


def episode_position(df: DataFrame, key: str = "episode", order: str = "numeric", by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the 0-based place of each key within ``by``. Lexical order takes keys that begin with demo only."""
    kept = df if order == "numeric" else df.filter(F.lower(key).startswith("demo"))
    return kept.withColumn("place", (F.row_number().over(Window.partitionBy(*by).orderBy(*episode_order(df, key, order))) - 1).cast("long"))


def first_episodes(df: DataFrame, n: int, key: str = "episode", order: str = "numeric") -> DataFrame:
    """The first n keys in order: a top-n, not a full sort."""
    return df.orderBy(*episode_order(df, key, order)).limit(n)


def select_views(df: DataFrame, n: int | None = None, wanted: Sequence[str] | None = None, dataset_order: bool = False, cameras: str = "camera_names", strict: bool = False) -> DataFrame:
    """``df`` with ``views`` (the first n, or the wanted ones that it has) and ``missing`` (wanted ones that it lacks). ``strict``: a missing view is an error."""
    want = F.array(*[F.lit(x) for x in wanted or []]).cast("array<string>")
    if wanted is None:
        return df.withColumn("views", F.slice(cameras, 1, n)).withColumn("missing", want)
    found = F.filter(cameras, lambda x: F.array_contains(want, x)) if dataset_order else F.filter(want, lambda x: F.array_contains(cameras, x))
    picked = df.withColumn("views", found if n is None else F.slice(found, 1, n)).withColumn("missing", F.array_except(want, cameras))
    if strict:
        none_of(picked.filter(F.coalesce(F.size("missing"), F.lit(1)) > 0), "a view is missing")
    return picked


def infer_views(df: DataFrame, attribute: str = "camera_attr", names: str = "stream_names") -> DataFrame:
    """``df`` with ``views``: the JSON list of the attribute, else the streams that end in _rgb, sorted, without the ending."""
    listed = F.from_json(attribute, "array<string>")
    by_name = F.transform(F.array_sort(F.filter(names, lambda x: x.endswith("_rgb"))), lambda x: F.regexp_replace(x, "_rgb$", ""))
    return df.withColumn("views", F.coalesce(listed, by_name))


def sample_index(df: DataFrame, length: str, max_frames: int | None = None, key: Sequence[str] = ("episode",), strict: bool = False) -> DataFrame:
    """(key, t): one row for each step of an episode of that length, at most ``max_frames``. ``strict``: no step at all is an error."""
    n = F.col(length) if max_frames is None else F.least(F.col(length), F.lit(max_frames))
    steps = df.filter(n > 0).select(*key, F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("t"))
    return not_empty(steps, "step in any episode") if strict else steps


def common_length(streams: DataFrame, key: Sequence[str] = ("episode",), length: str = "n", strict: bool = False) -> DataFrame:
    """(key, common, n_streams) of the episodes whose shortest stream isn't empty. ``strict``: none at all is an error."""
    found = streams.groupBy(*key).agg(F.min(length).alias("common"), F.count(F.lit(1)).alias("n_streams")).filter("common > 0")
    return not_empty(found, "episode with steps in all streams") if strict else found


def drop_short(df: DataFrame, length: str, least: int = 2) -> DataFrame:
    return df.filter(F.col(length) >= least)


def parse_timesteps(spec: str, n: int) -> list[range]:
    """Ranges of "0,10,20" or "start:stop:stride"; an empty part of a slice means its end."""
    ranges = []
    for part in spec.split(","):
        if ":" in part:
            a, b, c = ([*part.split(":"), ""])[:3]
            ranges.append(range(int(a or 0), int(b or n), int(c or 1)))
        else:
            ranges.append(range(int(part), int(part) + 1))
    return ranges


def select_timesteps(df: DataFrame, spec: str, n: int, t: str = "t", max_exports: int | None = None) -> DataFrame:
    """The rows of the steps that ``spec`` names (of n in an episode), with ``position``: where it names them first."""
    spark, rows, base = df.sparkSession, [], 0
    for r in parse_timesteps(spec, n):
        if len(r):
            if r[0] < 0 or r[-1] >= n:
                raise ValueError(f"{spec!r} leaves 0..{n - 1}")
            rows.append((r[0], r[-1], r.step, base))
        base += len(r)
    ranges = spark.createDataFrame(rows, "a long, b long, s long, base long")
    named = ranges.select("base", F.posexplode(F.sequence("a", "b", "s")).alias("i", t)).groupBy(t).agg(F.min(F.col("base") + F.col("i")).alias("position"))
    if max_exports is not None:
        named = named.orderBy("position").limit(max_exports)
    return df.join(named, t)


def assemble_views(frames: DataFrame, cameras: DataFrame, n_views: int, key: Sequence[str] = ("episode", "t"), name: str = "camera", index: str = "cam_idx") -> DataFrame:
    """(key, views): the states that have all views, each a struct in the order of the cameras' index, joined by name."""
    keep = [c for c in cameras.columns if c != name]
    joined = frames.join(cameras, [c for c in (key[0], name) if c in cameras.columns])
    rest = [c for c in frames.columns if c not in key and c not in (name, *keep)]
    views = F.array_sort(F.collect_list(F.struct(index, name, *[c for c in keep if c not in key and c != index], *rest)))
    return joined.groupBy(*key).agg(views.alias("views")).filter(F.size("views") == n_views)


def project_vector(df: DataFrame, vector: str, indices: Sequence[int], name: str = "proprio") -> DataFrame:
    """``df`` with the elements at ``indices`` (from 0); one outside the vector is an error."""
    return df.withColumn(name, F.array(*[F.element_at(vector, i + 1) for i in indices]))


def resolve_field(df: DataFrame, path: str | None, name: str = "field") -> DataFrame:
    """``df`` with the column of a slash path; an empty array if there is no such path, or none is asked for."""
    empty = F.array().cast("array<double>")
    if path is None or path.strip().lower() in ("", "null", "none"):
        return df.withColumn(name, empty)
    kind = df.schema
    for part in path.strip("/").split("/"):
        found = next((f for f in getattr(kind, "fields", []) if f.name == part), None)
        if found is None:
            return df.withColumn(name, empty)
        kind = found.dataType
    return df.withColumn(name, F.col(path.strip("/").replace("/", ".")))


def collapse_features(df: DataFrame, tokens: str, mode: str = "mean", name: str = "feature") -> DataFrame:
    """``df`` with an array of token vectors flattened, or averaged over tokens."""
    if mode == "flatten":
        return df.withColumn(name, F.flatten(tokens))
    total = F.aggregate(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), F.element_at(tokens, 1), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return df.withColumn(name, F.transform(total, lambda x: x / F.size(tokens)))


def state_vector(df: DataFrame, first: str, second: str, name: str = "state") -> DataFrame:
    return df.withColumn(name, F.concat(first, second))


def safe_key(key: str | Column) -> Column:
    """Letters, digits, _ and - of any script stay; the rest becomes _."""
    return F.regexp_replace(key, r"[^\p{L}\p{N}_-]", "_")


def run_catalog(df: DataFrame, path: str = "path") -> DataFrame:
    """``df`` with what a run's path tells: step (of step_300 and the like), run (its folder without a seed), tags, and a short step."""
    step = F.expr(f"try_cast(nullif(regexp_extract({path}, '(?i)step[_-]?([0-9]+)', 1), '') AS bigint)")
    folder = F.element_at(F.split(path, "/"), -2)
    run = F.regexp_replace(folder, "_seed[0-9]+", "")
    short = F.when((step >= 1000) & (step % 1000 == 0), F.concat((step / 1000).cast("long").cast("string"), F.lit("k"))).otherwise(step.cast("string"))
    return df.withColumns({"step": step, "run": run, "short": short, "tags": F.array_distinct(F.split(run, "_"))})


def latest_checkpoint(df: DataFrame, path: str = "path", run: str = "run") -> DataFrame:
    """(run, latest): the last path by name."""
    return df.groupBy(run).agg(F.max_by(path, path).alias("latest"))


def parse_view_groups(cameras: DataFrame, spec: str, name: str = "camera", index: str = "cam_idx", by: Sequence[str] = ("episode",), strict: bool = False) -> DataFrame:
    """``cameras`` with their group of "a,b;c"; each camera that it doesn't list gets a group of its own, after those. A name given twice is
    an error; so is, if ``strict``, one that no camera has. An empty spec gives each camera its own group."""
    groups = [[x.strip() for x in g.split(",") if x.strip()] for g in spec.split(";")]
    listed = [(x, i) for i, g in enumerate([g for g in groups if g]) for x in g]
    if len({x for x, _ in listed}) < len(listed):
        raise ValueError(f"a camera is listed twice in {spec!r}")
    if strict and listed:
        named = cameras.sparkSession.createDataFrame([(x,) for x, _ in listed], f"{name} string")
        none_of(named.join(cameras.select(name).distinct(), name, "left_anti"), "an unknown camera")
    n = len([g for g in groups if g])
    known = F.create_map(*[y for x, i in listed for y in (F.lit(x), F.lit(i))])[F.col(name)] if listed else F.lit(None).cast("int")
    tagged = cameras.withColumn("__known", known)
    extra = F.row_number().over(Window.partitionBy(*by, F.col("__known").isNull()).orderBy(index)) - 1 + n
    return tagged.withColumn("group", F.coalesce("__known", extra).cast("long")).drop("__known")


def scale_pixels(column: str | Column, mode: str) -> Column:
    """Pixels 0..255 to [-1, 1] ('signed'), [0, 1] ('unit') or [-0.5, 0.5] ('centred'); 'to_bytes' turns [-1, 1] back, clamped."""
    x = F.col(column) if isinstance(column, str) else column
    if mode == "to_bytes":
        return F.floor(F.least(F.greatest((x + 1) / 2, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    scaled = x / 255.0
    return {"signed": scaled * 2 - 1, "unit": scaled, "centred": scaled - 0.5}[mode]


def standardise(column: str | Column, mean: float, std: float) -> Column:
    return ((F.col(column) if isinstance(column, str) else column) / 255.0 - mean) / std
