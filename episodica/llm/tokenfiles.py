"""Token ids as Parquet list columns that can be read in part (operator 9)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodica.llm.shared import fresh_path, slices, table
from episodica.llm.tokens import coder, ids_of

END_ID = 2
#: Row groups of 32 MB, pages of 64 kB or 500 rows: the column and offset indexes then lead a reader of few documents
#: to few pages. Ids are dictionary encoded (a vocabulary fits the dictionary page: 2 bytes an
#: id); the metadata columns ascend, and are delta encoded.
LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "500",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "snappy",
}


def write_tokens(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", spaced: bool = False, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", layout: dict[str, str] | None = None) -> None:
    """Writes (doc_id, start, n_tokens, ids) for every row of ``docs``, in ascending order of id within and across files.

    ``start`` counts the file's own ids; :func:`token_offsets` adds those of the files before. The
    texts are dealt by ranges of ids and encoded after that, so only texts are shuffled, once.
    Null texts have the end id alone; rows without an id come first; rows that share an id, or have none, are ordered by the hash of
    their text, copies by their place in the input, so that a frequent id is dealt to several ranges. An empty table gives files without rows. ``vocabulary``: a path, or a name that the public_tokenizers package resolves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, before = coder(vocabulary, spaced), 0
        for batch in slices(batches, "t", 6_000_000):
            ids, bounds = ids_of(words.encode(batch.column(1)), end_id)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bounds[:-1] + before), pa.array(np.diff(bounds)), lists], names=["doc_id", "start", "n_tokens", "ids"])
            before += len(ids)

    order = ("i", "h", "k")
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("k"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>").write.options(**(layout or LAYOUT)).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids"), first: int | None = None, last: int | None = None) -> DataFrame:
    """The named columns of the documents from ``first`` to ``last``; other columns, row groups and pages stay unread."""
    found = spark.read.parquet(path)
    if first is not None:
        found = found.filter(F.col("doc_id") >= first)
    if last is not None:
        found = found.filter(F.col("doc_id") <= last)
    return found.select(*columns)


def file_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(file, before: ids in the files before it): as many rows as files. Reads two metadata columns.

    Spark's writer names files by partition, and partitions of a range partitioning ascend. A part that was
    split into several files keeps their order by name.
    """
    ends = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), "n_tokens").groupBy("file").agg(F.sum("n_tokens").alias("n"))
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    before = Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def token_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files, read back; start counts all ids before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            bounds = lists.offsets.to_numpy()
            values = lists.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(crc, pa.int64()), batch.column(4)], names=["doc_id", "own", "n_tokens", "ids_crc32", "file"])

    rows = spark.read.parquet(path).select("doc_id", "start", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"))
    found = rows.mapInArrow(run, "doc_id long, own long, n_tokens long, ids_crc32 long, file string")
    return found.join(file_offsets(spark, path), "file").select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return token_offsets(spark, path)
