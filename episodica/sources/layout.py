"""A stored dataset whose tables meet without an exchange: bucketed by episode, sorted files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.operators.keys import episode_order
from episodica.sources.episodes import TABLES, Dataset

#: Order inside a bucket's file; a table's columns among these.
ORDER = ("episode", "camera", "t")
#: Episodes that are named in a filter, which prunes buckets and row groups; more are joined.
NAMED = 1_000


def store_dataset(data: Dataset, root: str, name: str, buckets: int = 64) -> Dataset:
    """Writes the four tables below ``root`` as catalogue tables <name>_<table>, and gives them back from there.

    Each is bucketed by episode, one sorted file a bucket, so that joins and aggregations by episode need no exchange, and row groups hold few
    episodes. Tables of that name are replaced. Null episodes have a bucket, too. ``buckets`` follows the largest table: a file of a few hundred MB each.
    """
    for table in TABLES:
        df: DataFrame = getattr(data, table)
        order = [c for c in ORDER if c in df.columns]
        df.repartition(buckets, "episode").write.mode("overwrite").bucketBy(buckets, "episode").sortBy(*order).option("path", f"{root}/{table}").saveAsTable(f"{name}_{table}")
    return open_dataset(data.episodes.sparkSession, root, name, buckets)


def open_dataset(spark: SparkSession, root: str, name: str, buckets: int = 64) -> Dataset:
    """The dataset that :func:`store_dataset` wrote. A session whose catalogue doesn't know its tables learns them, with ``buckets`` as they were written."""
    for table in TABLES:
        if not spark.catalog.tableExists(f"{name}_{table}"):
            schema = spark.read.parquet(f"{root}/{table}").schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            order = ", ".join(c for c in ORDER if c in schema.names)
            spark.sql(f"CREATE TABLE {name}_{table} ({columns}) USING PARQUET CLUSTERED BY (episode) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{root}/{table}'")
    return Dataset(*(spark.table(f"{name}_{table}") for table in TABLES))


def first_of(data: Dataset, n: int, order: str = "numeric") -> Dataset:
    """The dataset of its first ``n`` episodes. Up to NAMED of them are named in filters, so that only their buckets and row groups are read; for more,
    each table keeps their rows by a semi join inside buckets."""
    kept = data.episodes.select("episode").distinct().orderBy(*episode_order(data.episodes, "episode", order)).limit(n)
    if n > NAMED:
        return Dataset(*(t.join(kept, "episode", "left_semi") for t in (data.episodes, data.cameras, data.steps, data.frames)))
    return only(data, [r[0] for r in kept.collect()])


def only(data: Dataset, episodes: Sequence[str]) -> Dataset:
    """The dataset of the named episodes (at most NAMED)."""
    if len(episodes) > NAMED:
        raise ValueError(f"{len(episodes)} episodes are more than {NAMED} to name")
    return Dataset(*(t.filter(F.col("episode").isin([e for e in episodes if e is not None])) for t in (data.episodes, data.cameras, data.steps, data.frames)))
