"""One large JSON map, read by byte ranges."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Place = tuple[str, int]


def _braces(chunk: bytes, inside: bool) -> tuple[int, bool]:
    """(opening less closing braces outside strings, whether a string is open at the end) of a text that begins inside or outside a string."""
    if b'"' not in chunk:
        return (0 if inside else chunk.count(b"{") - chunk.count(b"}")), inside
    raw = np.frombuffer(chunk, np.uint8)
    quote = raw == 34
    if b"\\" in chunk:  # a quote after an odd number of backslashes is a character
        at = np.arange(len(raw))
        other = np.maximum.accumulate(np.where(raw != 92, at, -1))
        run = np.r_[0, at[:-1] - other[:-1]]  # backslashes right before
        quote &= run % 2 == 0
    open_ = (np.cumsum(quote) + inside) % 2 == 1
    outside = ~open_ & ~quote
    return int((outside & (raw == 123)).sum() - (outside & (raw == 125)).sum()), bool(open_[-1])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Place, bytes]]:
    """((file, begin of the byte range), text up to and with a closing brace), in order."""
    for batch in batches:
        for path, begin, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            yield (path, begin), value.encode() + b"}"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each byte range, for either state that it may begin in: the depth it adds, its last state, and how often each depth is reached by closing."""
    place, states = None, []

    def row() -> pa.RecordBatch:
        columns = [[place[0]], [place[1]]]
        for depth, inside, closed in states:
            columns += [[depth], [inside], [list(closed.items())]]
        kinds = [pa.string(), pa.int64(), *[pa.int64(), pa.bool_(), pa.map_(pa.int64(), pa.int64())] * 2]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "begin", "d0", "s0", "c0", "d1", "s1", "c1"])

    for at, chunk in _chunks(batches):
        if at != place:
            if place:
                yield row()
            place, states = at, [[0, False, Counter()], [0, True, Counter()]]
        for state in states:
            more, inside = _braces(chunk, state[1])
            state[0] += more
            state[1] = inside
            if not inside:
                state[2][state[0]] += 1
    if place:
        yield row()


def read_json_map(spark: SparkSession, path: str, value: str, columns: tuple[str, str] = ("key", "value")) -> DataFrame:
    """(path, position, key, value) of each entry of JSON files that are one map from names to objects; ``value`` is an object's type as DDL.

    Files are read in byte ranges, cut at closing braces, a task a range, whatever their lines. A first pass finds what each range adds to the depth
    of braces, for either case that it begins inside a string or not; those few sums (a row a range) say in which state and at which entry each
    range begins. A second pass numbers the entries; one that lies across ranges is put together by its number, and each is parsed alone. Of a repeated
    key the last value counts, at the first one's position, as in a dictionary. Braces and quotes in strings are characters. An entry that doesn't
    parse has a null value; an empty map or file gives no row. Values that aren't objects aren't told apart: such maps have no place here.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    chunks = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"), "value")
    kinds = "path string, begin long, d0 long, s0 boolean, c0 map<long,long>, d1 long, s1 boolean, c1 map<long,long>"
    begins: dict[Place, tuple[bool, int, int]] = {}
    file, inside, depth, entries = None, False, 0, 0
    for r in sorted(chunks.mapInArrow(_survey, kinds).collect(), key=lambda r: (r["path"], r["begin"])):  # a row a byte range
        if r["path"] != file:
            file, inside, depth, entries = r["path"], False, 0, 0
        begins[r["path"], r["begin"]] = (inside, depth, entries)
        which = "1" if inside else "0"
        entries += r["c" + which].get(1 - depth, 0)
        inside, depth = r["s" + which], depth + r["d" + which]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, out = None, [], []
        inside, depth, entry = False, 0, 0

        def send() -> None:
            if held:
                out.append((place[0], place[1], entry, b"".join(held).decode()))
                held.clear()

        for at, chunk in _chunks(batches):
            if at != place:
                send()
                place = at
                inside, depth, entry = begins[at]
            more, inside = _braces(chunk, inside)
            depth += more
            if depth > 0:
                held.append(chunk)
            if depth == 1 and not inside:
                send()
                entry += 1
            if len(out) >= 1000:
                yield _rows(out)
                out = []
        send()
        if out:
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["path", "begin", "position", "text"])

    parts = chunks.mapInArrow(number, "path string, begin long, position long, text string")
    whole = parts.groupBy("path", "position").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "text"))), lambda x: x["text"]), "").alias("text"))
    body = F.concat(F.lit("{"), F.regexp_replace("text", r"^[\s,{]+", ""), F.lit("}"))
    parsed = whole.select("path", "position", F.explode_outer(F.from_json(body, f"map<string,{value}>")).alias("k", "v")).filter("k IS NOT NULL")
    once = parsed.groupBy("path", "k").agg(F.min("position").alias("position"), F.max_by(F.struct("v"), "position").alias("last"))
    return once.select("path", F.col("position"), F.col("k").alias(columns[0]), F.col("last.v").alias(columns[1]))
