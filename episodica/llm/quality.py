"""Quality rules: suffix-array repetition, with the counts of simple rules (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.shared import column_bytes, slices, table

SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
#: Words of the windows of the base rule.
WINDOW = 3
#: Bytes of text that are judged at once; a longer text stands alone.
SLICE = 700_000
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered_words long, longest_repeat long"


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict. Repeats count from ``repeat_words`` words on."""

    min_words: int = 50
    max_window_percent: int = 50
    repeat_words: int = 5
    max_covered_percent: int = 40
    max_repeat_words: int = 200


def _flags(chars: bytes) -> np.ndarray:
    found = np.zeros(256, np.int64)
    found[list(chars)] = 1
    return found


_SYMBOL = _flags(SYMBOLS)
#: 1 for the bytes that begin a code point and aren't white space.
_BEGINS = 1 - _flags(SPACES + bytes(range(0x80, 0xC0)))


def _least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray, block: int = 32) -> np.ndarray:
    """The least of ``values[first]`` to ``values[last]``, for each pair of positions, ``first`` at most ``last``.

    Minima from each position to the ends of its block, and minima of runs of blocks, whose length doubles. One length
    is there at a time, so memory is a few numbers a value.
    """
    n = -(-len(values) // block)
    grid = np.pad(values, (0, n * block - len(values)), mode="edge").reshape(n, block)
    to_start = np.minimum.accumulate(grid, axis=1).ravel()
    to_end = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    b, e = first // block, last // block
    found = np.minimum(to_end[first], to_start[last])
    inner, runs, width = e - b - 1, grid.min(axis=1), 1  # whole blocks between the two
    longest = int(inner.max(initial=0))
    while width <= longest:
        mine = np.flatnonzero((inner >= width) & (inner < 2 * width))
        found[mine] = np.minimum(found[mine], np.minimum(runs[b[mine] + 1], runs[e[mine] - width]))
        runs = np.minimum(runs[:-width], runs[width:])
        width *= 2
    same = np.flatnonzero(b == e)
    found[same] = values[first[same]]
    for step in range(1, block):
        same = same[first[same] + step <= last[same]]
        found[same] = np.minimum(found[same], values[first[same] + step])
    return found


def suffix_array(word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions of the texts laid end to end in the order of their suffixes, and what each slot's suffix shares with the one before.

    A suffix array of every text at once by prefix doubling: ``rank`` is the slot at which a
    suffix's group begins, only groups of two or more are sorted again, by the ranks that lie
    ``k`` words on. The array is cut by text, since the first key holds the text's number. The longest
    common prefixes of neighbours are found where groups part: ``k`` words, and what the suffixes ``k`` words on share, which
    is the least prefix between their two groups, known since they parted.
    Memory is a few numbers a word, however long the repeats.
    """
    n = len(word)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key = doc.astype(np.int64) << 32 | word
    slots = np.argsort(key, kind="stable")
    ordered = key[slots]
    parts = np.r_[True, ordered[1:] != ordered[:-1]]
    heads = np.maximum.accumulate(np.where(parts, np.arange(n), 0))
    common = np.where(parts, 0, n)  # with the slot before; n: the two are not parted yet
    rank = np.empty(n, np.int64)
    rank[slots] = heads
    last = np.searchsorted(doc, doc, side="right")  # the position after the text's end
    k = 1
    active = np.flatnonzero(np.bincount(heads, minlength=n)[rank] > 1)
    while len(active):
        ahead = active + k
        inside = ahead < last[active]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[active]))
        active, second = active[order], second[order]
        old = rank[active]
        at = np.arange(len(active))
        group = np.r_[True, old[1:] != old[:-1]]
        part = group | np.r_[True, second[1:] != second[:-1]]
        begin = np.maximum.accumulate(np.where(group, at, 0))
        new = old + np.maximum.accumulate(np.where(part, at, 0)) - begin
        slots[old + at - begin] = active
        rank[active] = new
        parted = np.flatnonzero(part & ~group)
        if len(parted):
            common[new[parted]] = k
            parted = parted[second[parted - 1] > 0]  # else the one before ends after k words
            common[new[parted]] += _least_between(common, second[parted - 1], second[parted] - 1)
        k *= 2
        active = active[np.bincount(new, minlength=n)[new] > 1]
    return slots, common


def suffix_repeats(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position of the texts laid end to end, the words that its suffix shares with its closest neighbour.

    The larger of the common prefixes with both neighbours is a suffix's longest
    maximal repeat: all members of one interval of common prefixes of length l or more have at least l there.
    """
    slots, common = suffix_array(word, doc)
    longest = np.zeros(len(word), np.int64)
    longest[slots] = np.maximum(common, np.r_[common[1:], 0]) if len(slots) else 0
    return longest


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """1 at each position of the union of spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return (np.cumsum(edge[:-1]) > 0).astype(np.int64)


def _per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values)]
    return total[bounds[1:]] - total[bounds[:-1]]


def measure(texts: list[bytes | None], rules: Rules) -> list[np.ndarray]:
    """The columns of COLUMNS for some texts."""
    texts = [x or b"" for x in texts]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    words = [x.split() for x in texts]
    n_words = np.array([*map(len, words)], np.int64)
    bounds = np.r_[0, np.cumsum(n_words)]
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for ws in words for w in ws), np.int64, bounds[-1])
    dup_lines = []
    for x in texts:
        lines = [line for line in x.split(b"\n") if line.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
    longest = suffix_repeats(ids, np.repeat(np.arange(len(texts)), n_words))
    windows = np.flatnonzero(longest >= WINDOW)
    repeated = _per_doc(_covered(windows, np.full(len(windows), WINDOW), len(ids)), bounds)
    spans = np.flatnonzero(longest >= rules.repeat_words)
    covered = _per_doc(_covered(spans, longest[spans], len(ids)), bounds)
    most = np.zeros(len(texts), np.int64)
    full = np.flatnonzero(n_words)
    if len(full):
        most[full] = np.maximum.reduceat(longest, bounds[full])
    failed = (n_words < rules.min_words) | (100 * repeated > rules.max_window_percent * n_words)
    kept = ~failed & (100 * covered <= rules.max_covered_percent * n_words) & (most <= rules.max_repeat_words)
    return [n_words, _per_doc(_BEGINS[raw], at), _per_doc(_SYMBOL[raw], at), np.array(dup_lines, np.int64), repeated, failed, kept, covered, most]


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(doc_id, COLUMNS) for every row of ``docs``: what the rules measure in the whole text, and their verdict.

    Each text is judged by itself inside the scan's tasks, so nothing is shuffled and memory
    follows the longest text. ``kept`` is false where ``base_failed`` is (too few words, or too many in repeated
    3-word windows); else where repeats of ``rules.repeat_words`` or more words cover more than a share of the text, or
    the longest repeat is too long. Null and empty texts have no words and fail. Repeated rows, and rows
    without an id, are judged each. Further columns aren't read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", SLICE):
            found = measure(column_bytes(batch, "t"), rules)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], names=["doc_id", *(x.split()[0] for x in COLUMNS.split(", "))])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id long, {COLUMNS}")


def keep_good(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, names[at], SLICE):
            yield batch.filter(pa.array(measure(column_bytes(batch, names[at]), rules)[6]))

    plain = docs.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op3_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents"))
