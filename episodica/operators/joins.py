"""Joins of episodes, calibrations, cameras and states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.functions import linalg as L


def calibration_key(path: str | Column, parts: int = 4) -> Column:
    """The last ``parts`` folders of a file's path; null if there are fewer."""
    folders = F.filter(F.split(F.regexp_replace(path, "/[^/]*$", ""), "/"), lambda x: x != "")
    return F.when(F.size(folders) >= parts, F.array_join(F.slice(folders, -parts, parts), "/"))


def join_calibration(episodes: DataFrame, calibrations: DataFrame, path: str = "file_path", key: str = "relative_path", parts: int = 4) -> DataFrame:
    """Episodes with the calibration of their path's key."""
    return episodes.withColumn(key, calibration_key(path, parts)).filter(F.col(key).isNotNull()).join(calibrations, key)


def dedupe_calibration(calibrations: DataFrame, position: str = "position", key: str = "relative_path") -> DataFrame:
    """One row for each path, the last; rows without a path go."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(position)))
    return calibrations.filter(F.col(key) != "").withColumn("__last", last).filter("__last = 1").drop("__last")


def resume_anti(matched: DataFrame, done: DataFrame, max_episodes: int | None, order: Sequence[str], key: str = "episode") -> DataFrame:
    """Matched episodes that are not done yet. Done ones count toward ``max_episodes``, so the first that many are taken first."""
    kept = matched if max_episodes is None else matched.orderBy(*order).limit(max_episodes)
    return kept.join(done.select(key), key, "left_anti")


def already_computed(rows: DataFrame, existing: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The ``rows`` whose key is in ``existing``, and those still to do (a null in the key is never found). Neither is multiplied by repeated keys."""
    keys = existing.select(*key)
    return rows.join(keys, list(key), "left_semi"), rows.join(keys, list(key), "left_anti")


def relative_pose(cameras: DataFrame, by: Sequence[str] = ("episode",), index: str = "cam_idx", w2c: str = "w2c", c2w: str = "c2w") -> DataFrame:
    """(by, cam_i, cam_j, T_ij) of every ordered pair of an episode's cameras: from i's frame to j's."""
    a = cameras.select(*by, F.col(index).alias("cam_i"), F.col(c2w).alias("__from"))
    b = cameras.select(*by, F.col(index).alias("cam_j"), F.col(w2c).alias("__to"))
    return a.join(b, list(by)).filter("cam_i <> cam_j").select(*by, "cam_i", "cam_j", L.matmul(F.col("__to"), F.col("__from"), 4).alias("T_ij"))


def attach_cameras(episodes: DataFrame, cameras: DataFrame, names: str = "camera_names", by: Sequence[str] = ("episode",)) -> DataFrame:
    """One row for each named camera of an episode, in the list's order (cam_pos), with its parameters, joined by name."""
    listed = episodes.select(*by, F.posexplode(names).alias("cam_pos", "camera"))
    return listed.join(cameras, [*by, "camera"])


def gather_views(states: DataFrame, picks: DataFrame, key: Sequence[str] = ("state_id",), view: str = "view_id") -> DataFrame:
    """The view rows that ``picks`` (key, slot, view) asks for."""
    return picks.join(states, [*key, view])


def pair_similarity(vectors: DataFrame, batch: str, row: str, vec: str, tau: float = 1.0, keep: Sequence[str] = ()) -> DataFrame:
    """(batch, q, k, sim) of all pairs of one batch: a stated batch against itself, never the whole table."""
    a = vectors.select(batch, F.col(row).alias("q"), F.col(vec).alias("__a"), *[F.col(c).alias(f"q_{c}") for c in keep])
    b = vectors.select(batch, F.col(row).alias("k"), F.col(vec).alias("__b"), *[F.col(c).alias(f"k_{c}") for c in keep])
    return a.join(b, batch).withColumn("sim", L.dot("__a", "__b") / tau).drop("__a", "__b")
