"""An append log of transitions, and a streaming source that reads it by row positions.

A log is a folder of Parquet files and of numbered commits. Each commit names the files of one append with their rows, the positions they begin and
end at, the schema, and the last batch of each writer. A row's position never changes, so offsets are single numbers.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

POSITION = "log_position"
#: Rows a task reads; a larger file is read by several tasks, a row group only where its rows are asked for.
TASK_ROWS = 1_000_000


def put_new(spark: SparkSession, text: str, path: str) -> bool:
    """Writes ``text`` as the file ``path``, whole or not at all; False if there is one already."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, conf = hadoop.Path(path), spark._jsc.hadoopConfiguration()
    staged = hadoop.Path(target.getParent(), f"_staged-{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    out = fs.create(staged)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:  # a rename that doesn't overwrite, which FileSystem.rename does on some stores
        hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(staged), fs.makeQualified(target), options)
    except Exception:
        fs.delete(staged, False)
        if fs.exists(target):
            return False
        raise
    return True


class _Commits:
    """The commits of a log, as a process without a session reads them."""

    def __init__(self, path: str) -> None:
        self.store, self.root = afs.FileSystem.from_uri(re.sub("^file:/+", "/", path.rstrip("/")))

    def numbers(self) -> list[int]:
        listed = self.store.get_file_info(afs.FileSelector(f"{self.root}/_commits", allow_not_found=True))
        return sorted(int(x.base_name[1:-5]) for x in listed if re.fullmatch(r"v\d+\.json", x.base_name))

    def load(self, number: int) -> dict:
        with self.store.open_input_stream(f"{self.root}/_commits/v{number:012}.json") as f:
            return json.loads(f.read())

    def newest(self) -> dict | None:
        numbers = self.numbers()
        return self.load(numbers[-1]) if numbers else None

    def between(self, start: int, end: int) -> Iterator[dict]:
        """The commits with positions from ``start`` to ``end``, the first found by bisection. An error if some were dropped."""
        numbers = self.numbers()
        low, high = 0, len(numbers)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.load(numbers[middle])["end"] <= start else (low, middle)
        for i, number in enumerate(numbers[low:]):
            found = self.load(number)
            if i == 0 and found["start"] > start:
                raise ValueError(f"rows {start} to {found['start']} of the log have been dropped")
            if found["start"] >= end:
                return
            yield found


def append_log(new: DataFrame, path: str, writer: str | None = None, number: int | None = None) -> int:
    """Appends ``new`` as one commit; returns the position after it. Rows take positions in the order of their files.

    Files are written by one job and seen when the commit that names them is in place; what a run that broke off wrote is never read. Of two writers at
    once, the second commits behind the first. With ``writer`` and ``number`` (a micro-batch's), an append that is tried again adds nothing. An empty
    table makes the log, or an empty commit. Types are Parquet's; another schema than the log's is an error.
    """
    spark = new.sparkSession
    log = _Commits(path)
    schema = new.schema.json()
    last = log.newest()
    if last and writer is not None and last["writers"].get(writer, -1) >= number:
        return last["end"]
    if POSITION in new.columns:
        raise ValueError(f"{POSITION} is the source's own column")
    if last and [(f.name, f.dataType) for f in StructType.fromJson(json.loads(last["schema"]))] != [(f.name, f.dataType) for f in new.schema]:
        raise ValueError("the log has another schema")
    folder = f"data/{uuid.uuid4().hex}"
    new.write.parquet(f"{path}/{folder}")
    counted = spark.read.schema(new.schema).parquet(f"{path}/{folder}").groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    files = sorted((f"{folder}/{r['name']}", r["n"]) for r in counted.collect())  # a row a file
    while True:
        numbers = log.numbers()
        last = log.load(numbers[-1]) if numbers else {"end": 0, "writers": {}}
        if writer is not None and last["writers"].get(writer, -1) >= number:
            return last["end"]
        end = last["end"] + sum(n for _, n in files)
        writers = last["writers"] if writer is None else last["writers"] | {writer: number}
        commit = {"start": last["end"], "end": end, "files": files, "schema": schema, "writers": writers}
        if put_new(spark, json.dumps(commit), f"{path}/_commits/v{(numbers[-1] if numbers else -1) + 1:012}.json"):
            return end


def drop_before(spark: SparkSession, path: str, position: int) -> int:
    """Drops the appends that end at ``position`` or before it, but never the newest; returns the first position that is left."""
    log = _Commits(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = log.numbers()
    for number in numbers[:-1]:
        found = log.load(number)
        if found["end"] > position:
            return found["start"]
        fs.delete(hadoop.Path(f"{path}/_commits/v{number:012}.json"), False)  # first what names the files
        for folder in {name.rsplit("/", 1)[0] for name, _ in found["files"]}:
            fs.delete(hadoop.Path(f"{path}/{folder}"), True)
    return log.load(numbers[-1])["start"] if numbers else 0


@dataclass
class _Range(InputPartition):
    """Rows ``low`` to ``high`` of a file, of which the first of all has position ``base``."""

    file: str
    base: int
    low: int
    high: int


class _LogReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType, options: dict[str, str]) -> None:
        self.path, self.types = path, schema
        self.first = options.get("startingPosition", "earliest")
        self.most = int(options["maxRowsPerTrigger"]) if "maxRowsPerTrigger" in options else None
        self.rows = int(options.get("rowsPerTask", TASK_ROWS))
        self.at: int | None = None

    def initialOffset(self) -> dict:
        log = _Commits(self.path)
        numbers = log.numbers()
        ends = (log.load(numbers[0])["start"], log.load(numbers[-1])["end"]) if numbers else (0, 0)
        return {"position": {"earliest": ends[0], "latest": ends[1]}.get(self.first) if self.first in ("earliest", "latest") else int(self.first)}

    def latestOffset(self) -> dict:
        """The log's end, or as many rows on as a trigger may take from where the last one ended."""
        if self.at is None:
            self.at = self.initialOffset()["position"]
        last = _Commits(self.path).newest()
        end = max(last["end"] if last else 0, self.at)
        self.at = end if self.most is None else min(end, self.at + self.most)
        return {"position": self.at}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        low, high = start["position"], end["position"]
        self.at = max(self.at or 0, high)  # a query that starts anew is told its last offsets here
        found = []
        for commit in _Commits(self.path).between(low, high) if low < high else ():
            base = commit["start"]
            for name, n in commit["files"]:
                a, b = max(low, base), min(high, base + n)
                found += [_Range(name, base, i - base, min(i + self.rows, b) - base) for i in range(a, b, self.rows)]
                base += n
        return found

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        log, names = _Commits(self.path), [f.name for f in self.types if f.name != POSITION]
        target = to_arrow_schema(self.types)
        with log.store.open_input_file(f"{log.root}/{partition.file}") as f:
            file = pq.ParquetFile(f, coerce_int96_timestamp_unit="us")
            at = 0
            for group in range(file.num_row_groups):
                n = file.metadata.row_group(group).num_rows
                if at < partition.high and at + n > partition.low:
                    place = at
                    for batch in file.iter_batches(row_groups=[group], columns=names):
                        a, b = max(partition.low - place, 0), min(partition.high - place, len(batch))
                        if a < b:
                            columns = {c: batch.column(c).slice(a, b - a) for c in names}
                            columns[POSITION] = pa.array(range(partition.base + place + a, partition.base + place + b), pa.int64())
                            yield pa.RecordBatch.from_arrays([columns[t.name].cast(t.type) for t in target], schema=target)
                        place += len(batch)
                at += n


class TransitionLog(DataSource):
    """``spark.readStream.format("transition_log").load(path)``: a log's rows with their positions.

    Options: ``startingPosition`` ("earliest", "latest" or a number), ``maxRowsPerTrigger`` (none: all there is), ``rowsPerTask``. A restarted query goes
    on at its checkpoint's position; rows that have been dropped before they were read are an error. A given schema may leave columns out,
    and those aren't read. With availableNow Spark runs such a source for one micro-batch: all there is, or one step of ``maxRowsPerTrigger``. Tasks open files by pyarrow, so the log's folder is in a store that pyarrow opens.
    """

    @classmethod
    def name(cls) -> str:
        return "transition_log"

    def schema(self) -> StructType:
        last = _Commits(self.options["path"]).newest()
        if last is None:
            raise ValueError(f"there is no log at {self.options['path']}")
        return StructType([*StructType.fromJson(json.loads(last["schema"])).fields]).add(POSITION, LongType())

    def streamReader(self, schema: StructType) -> _LogReader:
        known = {"startingposition": "startingPosition", "maxrowspertrigger": "maxRowsPerTrigger", "rowspertask": "rowsPerTask"}
        return _LogReader(self.options["path"], schema, {known[k.lower()]: v for k, v in self.options.items() if k.lower() in known})


def stream_log(spark: SparkSession, path: str, schema: StructType | None = None, **options: str | int) -> DataFrame:
    """The log as a stream of :class:`TransitionLog`."""
    spark.dataSource.register(TransitionLog)
    reader = spark.readStream.format("transition_log").options(**options)
    return (reader if schema is None else reader.schema(schema)).load(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """What is committed, as a table: read by Spark's own Parquet reader, without positions."""
    log = _Commits(path)
    files, schema = [], None
    for number in log.numbers():
        commit = log.load(number)
        files += [f"{path}/{name}" for name, n in commit["files"] if n]
        schema = StructType.fromJson(json.loads(commit["schema"]))
    if schema is None:
        raise ValueError(f"there is no log at {path}")
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
