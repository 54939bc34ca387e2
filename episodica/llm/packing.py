"""Best-fit packing by minimum bin slack (operator 6)."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodica.llm.shared import fresh_path, slices, table
from episodica.llm.tokens import coder, ids_of

END_ID, CAPACITY = 2, 1024
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths from the multiset ``counts`` whose sum is the largest that fits ``room``; long ones are preferred.

    Subset sums as the bits of an integer: taking one more length shifts them. Each length is
    offered in binary portions of its count.
    """
    mask = (1 << room + 1) - 1
    sums, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length], room // length)
        portion = 1
        while left > 0:
            take = min(portion, left)
            steps.append((length, take, sums))
            sums = (sums | sums << take * length) & mask
            left -= take
            portion *= 2
        if sums >> room & 1:
            break
    total, found = sums.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            found += [length] * take
            total -= take * length
    return sorted(found, reverse=True)


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins) that use up the histogram: minimum bin slack.

    Each bin begins with the longest length left and gets the fullest feasible combination of the others,
    which is then removed. The same combination stays the fullest as long as its lengths
    last, so it is removed as often as they do: the work follows the number of different
    lengths, at most ``capacity``, not that of the pieces.
    """
    left = {k: n for k, n in histogram.items() if n > 0}
    bins = []
    while left:
        longest = max(left)
        left[longest] -= 1
        lengths = [longest, *fullest({k: n for k, n in left.items() if n}, capacity - longest)]
        left[longest] += 1
        need = Counter(lengths)
        times = min(left[k] // n for k, n in need.items())
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        bins.append((lengths, times))
    return bins


def _intervals(bins: list[tuple[list[int], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """For runs of ranks of a length: key (length and first rank, sorted), pieces a bin, first bin, offset in the bin."""
    used: Counter[int] = Counter()
    rows, first = [], 0
    for lengths, times in bins:
        offset = 0
        for length, k in sorted(Counter(lengths).items(), reverse=True):
            rows.append((length << 44 | used[length], k, first, offset, used[length]))
            used[length] += k * times
            offset += k * length
        first += times
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 5


def cut_pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", spaced: bool = True, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids, the end id last, in pieces of at most ``capacity``: the first one takes what is over.

    ``rank`` numbers a partition's pieces of the same length; ``part`` is the partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = coder(vocabulary, spaced), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "t", 6_000_000):
            ids, bounds = ids_of(words.encode(batch.column(1)), end_id)
            sizes = np.diff(bounds)
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            short = sizes - (n - 1) * capacity
            length = np.where(piece == 0, short[row], capacity)
            start = np.where(piece == 0, 0, short[row] + (piece - 1) * capacity)
            begin = bounds[:-1][row] + start
            crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(begin.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *map(pa.array, (start, length)), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int64)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, _PIECES)


def pack(docs: DataFrame, capacity: int = CAPACITY, **options: object) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of ``docs``.

    The pieces are written once to the shared folder. The driver sees only their histogram (at
    most ``capacity`` rows, whatever the input) and plans the bins on it, so the packing
    is the same as if one task had held every piece. A piece then finds its bin by its rank
    among those of its length: its rank in its partition, plus the counts of the partitions before.

    Null and empty texts have one piece, the end id. Repeated rows are packed each; rows without an id as well. An
    empty table gives an empty result; further columns aren't read.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "pieces")
    cut_pieces(docs, capacity=capacity, **options).write.parquet(path)
    pieces = spark.read.parquet(path)
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {x["length"]: x["n"] for x in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    keys, per_bin, first, offset, begin = _intervals(minimum_bin_slack(histogram, capacity), capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            nth = rank - begin[at]
            bin_id, slot = first[at] + nth // per_bin[at], nth % per_bin[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(bin_id), pa.array(offset[at] + slot * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
