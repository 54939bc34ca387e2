"""Periodic runs of words: suffix classes united by decreasing common prefix (operator 13)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.quality import suffix_array
from episodica.llm.shared import column_bytes, slices, table

#: Bytes of text that are searched at once; a longer text stands alone.
SLICE = 700_000
#: Positions of a block of an ordered set; twice as many are split.
BLOCK = 512
RUN = "struct<start: long, length: long, period: long>"
COLUMNS = f"n_words long, runs array<{RUN}>, collapsed string"


def _first(block: list[int]) -> int:
    return block[0]


def _unite(big: list[list[int]], small: list[list[int]]) -> Iterator[tuple[int, int]]:
    """Puts the positions of one ordered set (blocks of ascending numbers) into another, and yields the pairs that become neighbours there."""
    placed = [x for block in small for x in block]
    last = None
    for x, following in zip(placed, [*placed[1:], None], strict=True):
        b = max(0, bisect_right(big, x, key=_first) - 1)
        block = big[b]
        i = bisect_right(block, x)
        before = block[i - 1] if i else None
        after = block[i] if i < len(block) else big[b + 1][0] if b + 1 < len(big) else None
        block.insert(i, x)
        if len(block) > 2 * BLOCK:
            big[b : b + 1] = [block[:BLOCK], block[BLOCK:]]
        if before is not None and before != last:  # two of the small set were neighbours before
            yield before, x
        if after is not None and (following is None or after < following):
            yield x, after
        last = x


def find_runs(word: np.ndarray, doc: np.ndarray, min_words: int = 6, periods: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every maximal run of ``min_words`` words and ``periods`` periods (3 at least) or more, by start, then period.

    Neighbours of the suffix array are united by decreasing common prefix, as Kruskal's algorithm takes edges; a class keeps its positions in
    order, and the smaller set goes into the larger. Positions i and i + p that become neighbours in a class when prefixes of length l unite share
    exactly l words, so words i to i + p + l - 1 have period p and no word after them keeps it. Of a run with smallest period p, its first position and
    the one p on do become neighbours at that length: a position between them in the class would give a shorter period. For the same
    reason no multiple of p is found. Pairs that the word before continues belong to a run that begins earlier.
    """
    slots, common = suffix_array(word, doc)
    least = min(max(min_words - p, (periods - 1) * p) for p in range(1, min_words + 1))  # words that two such positions share
    edges = np.flatnonzero(common >= max(1, least))
    edges = edges[np.argsort(-common[edges], kind="stable")]
    root: dict[int, int] = {}
    sets: dict[int, list[list[int]]] = {}
    seeds: list[tuple[int, int, int]] = []

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            x, root[x] = root.get(x, x), top
        return top

    for x, y, shared in zip(slots[edges - 1].tolist(), slots[edges].tolist(), common[edges].tolist(), strict=True):
        x, y = find(x), find(y)
        a, b = sets.pop(x, None) or [[x]], sets.pop(y, None) or [[y]]
        if (len(a), len(a[0])) < (len(b), len(b[0])):
            x, y, a, b = y, x, b, a
        root[y] = x
        sets[x] = a
        for i, j in _unite(a, b):
            p = j - i
            if (periods - 1) * p <= shared and shared + p >= min_words:
                seeds.append((i, shared + p, p))
    found = np.array(seeds, np.int64).reshape(-1, 3)
    start, length, period = found.T
    before = np.maximum(start - 1, 0)
    continued = (start > 0) & (doc[before] == doc[start]) & (word[before] == word[before + period])
    found = found[~continued]
    return tuple(found[np.lexsort((found[:, 2], found[:, 0]))].T)


def _collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run has after its first period, with one space between."""
    if not len(start):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return b" ".join([w for w, inside in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not inside])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 6, periods: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row: the maximal periodic runs of the whole text's words, and the text with each run cut to a period.

    Words are parted by white space (x20, x09-x0D); a run has ``min_words`` words and ``periods`` times its smallest period at least. Runs may overlap.
    ``collapsed`` has the words that no run holds after its first period. Each text is searched by itself in the scan's tasks, so nothing is
    shuffled, and memory follows the longest text. Null and empty texts have no words, no runs and an empty ``collapsed``. Repeated rows and rows
    without an id are searched each; further columns aren't read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", SLICE):
            words = [(x or b"").split() for x in column_bytes(batch, "t")]
            n = np.array([*map(len, words)], np.int64)
            begins = np.r_[0, np.cumsum(n)]
            seen: dict[bytes, int] = {}
            ids = np.fromiter((seen.setdefault(w, len(seen)) for ws in words for w in ws), np.int64, begins[-1])
            start, length, period = find_runs(ids, np.repeat(np.arange(len(words)), n), min_words, periods)
            cut = np.searchsorted(start, begins)
            start = start - begins[np.searchsorted(begins, start, side="right") - 1]
            texts = [_collapsed(ws, start[i:j], length[i:j], period[i:j]).decode() for ws, i, j in zip(words, cut[:-1], cut[1:], strict=True)]
            rows = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), rows), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id long, {COLUMNS}")


def tiled(doc_id: Column, text: Column) -> Column:
    """The text, of every tenth id by checksum repeated from some word on with a period that its id draws: words from a on are words a to a + p - 1 in turns."""
    draw = F.crc32(doc_id.cast("string"))
    g = F.floor(draw / 10).cast("long")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((draw % 10 == 0) & (n > 0), F.concat_ws(" ", F.slice(words, F.lit(1), a), again)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tiled(F.col("doc_id"), F.col("text")).alias("text"))
    none = F.lit(None).cast(RUN)
    best = F.aggregate("runs", none, lambda b, x: F.when(b.isNull() | (x["length"] * b["period"] > b["length"] * x["period"]), x).otherwise(b))
    lines = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    found = periodic_runs(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")
