"""SimHash near-duplicates by anchor points of a covering code (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.components import connected_components
from episodica.llm.shared import column_bytes, cut, fresh_path, slices, table

SEED, WORDS, DISTANCE = 42, 3, 3
#: Bits of a block: the length of the Hamming code whose words are the anchors.
BLOCK = 31
#: Fingerprints of an anchor's group that one task compares; those of a larger group are dealt anew, by the bytes that they share.
HOT = 4096


def _shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased words; of the whole sequence if it is shorter; none without a word."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - words + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def _majority(hashes: np.ndarray, step: int = 1 << 17) -> int:
    """The bits that are set in over half of the hashes, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), step):
        part = hashes[i : i + step].astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp: long, the fingerprint's 64 bits) for every row; null and wordless texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            fp = [_majority(_shingle_hashes(x, words, seed)) if x else 0 for x in column_bytes(batch, "t")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, fp long")


def _flips() -> list[np.ndarray]:
    """For each syndrome, the masks that lead to the code words at distance 2 or less.

    The [31, 26] Hamming code is perfect: a word is a code word itself, or one flip (of the bit
    that its syndrome names) away from exactly one; two flips lead to 15 more.
    """
    masks: list[list[int]] = [[0], *([1 << (s - 1)] for s in range(1, BLOCK + 1))]
    for i, j in combinations(range(BLOCK), 2):
        masks[(i + 1) ^ (j + 1)].append(1 << i | 1 << j)
    return [np.array(x, np.uint64) for x in masks]


def _anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchor keys: every code word within radius + 1 of either block of 31 bits."""
    flips, rows, keys = _flips(), [], []
    for b in (0, 1):
        block = (fp >> np.uint64(32 * b)) & np.uint64((1 << BLOCK) - 1)
        syndrome = np.zeros(len(fp), np.uint64)
        for i in range(BLOCK):
            syndrome ^= np.where(block >> np.uint64(i) & np.uint64(1), np.uint64(i + 1), np.uint64(0))
        for s, masks in enumerate(flips):
            at = np.flatnonzero(syndrome == s)
            rows.append(np.repeat(at, len(masks)))
            keys.append(((block[at][:, None] ^ masks) | np.uint64(b << 32)).ravel())
    return np.concatenate(rows), np.concatenate(keys)


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (each position's root, the least of its set) after the links a - b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def _join_near(label: np.ndarray, group: np.ndarray, at: np.ndarray, fp: np.ndarray, distance: int) -> np.ndarray:
    """``label`` after the links between rows ``at`` of the same group; ``group`` (of those rows) is sorted.

    Shift by shift, so that memory follows the rows and not their pairs.
    """
    ends = np.searchsorted(group, group, side="right")
    own, left = fp[at], np.arange(len(at))
    for k in range(1, len(at)):
        left = left[left + k < ends[left]]
        if not len(left):
            break
        near = left[np.bitwise_count(own[left] ^ own[left + k]) <= distance]
        if len(near):
            label = _union(label, at[near], at[near + k])
    return label


def _compare(key: np.ndarray, fp: np.ndarray, node: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(least node, node) for each other node of the components inside each key's group: as many rows as nodes, not as pairs."""
    order = np.lexsort((node, key))
    key, fp, node = key[order], fp[order], node[order]
    label = _join_near(np.arange(len(key)), key, np.arange(len(key)), fp, distance)
    other = np.flatnonzero(label != np.arange(len(label)))
    return node[label[other]], node[other]


def _shared_bytes(fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: one for each choice of 8 - ``distance`` of a fingerprint's bytes, which two linked ones have in common.

    A key mixes those bytes; keys that fall together by chance cost a comparison and link nothing.
    """
    rows, keys = [], []
    for i, chosen in enumerate(combinations(range(8), 8 - distance)):
        x = (fp & np.uint64(sum(0xFF << 8 * b for b in chosen))) ^ np.uint64(i << 56 | i)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        keys.append(x * np.uint64(0xBF58476D1CE4E5B9))
        rows.append(np.arange(len(fp)))
    return np.concatenate(rows), np.concatenate(keys)


def _classes(distinct: DataFrame) -> DataFrame:
    """(fp, c) for each of the distinct fingerprints (fp, node): the least node of its component."""

    def replicate(to):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fp, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                for i in range(0, len(fp), 50_000):
                    rows, keys = to(fp[i : i + 50_000].view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fp[i:][rows]), pa.array(node[i:][rows])], names=["anchor", "fp", "node"])

        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            key, fp, node = (np.concatenate(x) for x in zip(*parts, strict=True))
            a, b = _compare(key, fp.view(np.uint64), node, DISTANCE)
            return pa.RecordBatch.from_arrays([pa.array(b), pa.array(a)], names=["u", "v"])

        for batch in batches:  # sorted by anchor: only the group at a batch's end can go on
            part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if not len(part[0]):
                continue
            cutoff = int(np.searchsorted(part[0], part[0][-1]))
            if part[0][-1] == last:
                cutoff = 0 if part[0][0] == last else cutoff
            if cutoff:
                held.append([x[:cutoff] for x in part])
                yield out(held)
                held = []
            held.append([x[cutoff:] for x in part])
            last = part[0][-1]
        if held:
            yield out(held)

    def links(of: DataFrame, to) -> DataFrame:
        spread = of.mapInArrow(replicate(to), keyed)
        return spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "u long, v long")

    spark, keyed = distinct.sparkSession, "anchor long, fp long, node long"
    spread = distinct.mapInArrow(replicate(_anchors), keyed)
    path = fresh_path(spark, "hot-anchors")
    spread.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("anchor").write.parquet(path)
    hot = spark.read.schema("anchor long").parquet(path)
    near = spread.join(hot, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "u long, v long")
    dealt = spread.join(hot, "anchor", "left_semi").select("fp", "node").distinct()
    roots = connected_components(near.unionByName(links(dealt, _shared_bytes)))
    return distinct.join(roots, distinct.node == roots.node, "left").select("fp", F.coalesce("root", distinct.node).alias("c"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Equal fingerprints meet in one aggregation. Distinct ones are replicated to the anchors of a
    covering code: at 3 differing bits or fewer, one of two blocks of 31 bits differs in at
    most one; the anchor nearest to the one fingerprint's block (distance at most 1, the covering
    radius) is then within radius + 1 of the other's. So each fingerprint goes to at most 2 x 16 of 2 x 2^26
    anchors and no link is lost. Each anchor's group is compared inside its task, which keeps a star for
    each component found, never its pairs. Fingerprints of an anchor with over HOT of them, as one template's documents may make,
    are dealt by any five of their eight bytes instead, which two linked ones share: 56 smaller groups, no link lost.

    Null or wordless text: fingerprint zero, linked like any other. Repeated rows: each is
    returned. A null id: its fingerprint, and a null component_id; it takes no part in links. An empty table gives an
    empty result; further columns of ``docs`` are not read.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    classes = _classes(cut(fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))))
    return fps.join(classes, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeated: bool = True) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: that of the least id (null: the largest), and of rows that share it, one.

    Each row gets a key, written with it, and the groups are of rows: shared and null ids neither link texts nor keep copies.
    Where the row that stays is there repeatedly, with id and text, each of those stays if ``repeated``, else one of them.
    Null, empty and wordless texts have fingerprint zero, so one of them stays. An empty table gives an empty result; all columns go on.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "rows")
    docs.withColumn("__key", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    fps = fingerprints(rows, "__key", text_col).withColumnRenamed("doc_id", "key")
    fps = cut(fps.join(rows.select(F.col("__key").alias("key"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h")), "key"))
    classes = _classes(cut(fps.groupBy("fp").agg(F.min("key").alias("node"))))
    mine = F.struct(F.col("id").isNull().alias("none"), "id", "key", "fp", "h")
    # the least of a fingerprint first, then that of its class
    least = cut(fps.groupBy("fp").agg(F.min(mine).alias("least")).join(classes, "fp"))
    kept = least.groupBy("c").agg(F.min("least").alias("least")).select("least.*").alias("k")
    same = "r.key = k.key" if not repeated else "r.fp = k.fp AND r.h = k.h AND (r.key = k.key OR r.id = k.id)"
    gone = fps.alias("r").join(kept, F.expr(same), "left_anti").select(F.col("key").alias("__key"))
    return rows.join(gone, "__key", "left_anti").drop("__key")


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
