"""Benchmark decontamination: a BM25 inverted index searched with block-max WAND (operator 4)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodica.llm.shared import column_bytes, slices, table

K1, B = 1.2, 0.75
#: Items of a block of the index.
BLOCK = 16
#: Postings that a search expands at once (one passage's may be more).
POSTINGS = 500_000
#: The longest item of an index has at most this many times the words of its shortest.
SPREAD = 8


@dataclass(frozen=True)
class Leak:
    """``score``: of a passage's BM25 score for an item, as a share of the item's score for itself. ``overlap``: of the
    item's shingles of ``shingle`` words that a passage has; ``question`` and ``answer``: of those that begin and end in that part."""

    score: float = 0.5
    shingle: int = 5
    overlap: float = 0.8
    question: float = 0.6
    answer: float = 0.5
    #: Bytes of items whose index a task holds at once; more are searched in turns.
    shard_bytes: int = 16_000_000


#: Letters and digits of ASCII, lowered, and all bytes beyond it; white space for the rest.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
#: Marks beyond ASCII: U+0080-00BF, U+2000-207F and U+3000-303F.
_MARKS = re.compile(rb"\xc2[\x80-\xbf]|\xe2[\x80\x81][\x80-\xbf]|\xe3\x80[\x80-\xbf]")


def words_of(text: bytes | None) -> list[bytes]:
    """Words without case and marks: a copy that is quoted, emphasised or punctuated anew has the same ones."""
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub(b" ", text.decode(errors="replace").lower().encode())
    return text.translate(_FOLD).split()


def answer_at(text: str) -> int:
    """Words before the answer: what follows the last answer mark; else the last line; else the last sentence; else, in an item of one
    sentence, its second half. So both parts have words, if there are two."""
    marks = [*re.finditer(r"(?i)\b(?:answer|a)\s*[:=]", text)]
    if marks:
        return len(words_of(text[: marks[-1].start()].encode()))
    body = text.rstrip()
    cut = body.rfind("\n")
    if cut <= 0:
        cut = max((m.end() for m in re.finditer(r"[.?!]\s", body)), default=0)
    before = len(words_of(body[:cut].encode()))
    return before or len(words_of(body.encode())) // 2


@dataclass
class Index:
    """Postings in blocks of items; weights are shares of the items' own scores."""

    items: list[tuple[int | None, list[bytes], int]]  # id, words, words before the answer
    terms: dict[bytes, int] = field(default_factory=dict)

    def build(self, df: dict[bytes, int], n: int, mean: float) -> Index:
        rows: list[tuple[int, int, float]] = []
        for i, (_, words, _) in enumerate(self.items):
            tf = Counter(words)
            norm = K1 * (1 - B + B * len(words) / max(mean, 1e-9))
            w = {t: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in tf.items()}
            own = sum(w.values()) or 1.0
            rows += [(self.terms.setdefault(t, len(self.terms)), i, x / own) for t, x in w.items()]
        order = sorted(rows)
        self.item = np.array([r[1] for r in order], np.int64)
        self.weight = np.array([r[2] for r in order])
        term = np.array([r[0] for r in order], np.int64)
        self.bounds = np.searchsorted(term, np.arange(len(self.terms) + 1))
        new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (self.item[1:] // BLOCK != self.item[:-1] // BLOCK)]) if len(term) else np.empty(0, np.int64)
        self.block_begins = np.r_[new, len(term)]  # each block's postings
        self.block, self.most = self.item[new] // BLOCK, np.maximum.reduceat(self.weight, new) if len(new) else np.empty(0)
        self.block_bounds = np.searchsorted(term[new], np.arange(len(self.terms) + 1))
        self.bound = np.zeros(len(self.terms))  # a term of another index of the shard has no postings here
        full = self.bounds[1:] > self.bounds[:-1]
        if len(term):
            self.bound[full] = np.maximum.reduceat(self.weight, self.bounds[:-1][full])
        self.longest = max([1, *(len(w) for _, w, _ in self.items)])
        return self


def _spread(bounds: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term its postings: position among ``terms``, position in the postings."""
    n = bounds[terms + 1] - bounds[terms]
    row = np.repeat(np.arange(len(terms)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + bounds[terms][row]


def search(index: Index, passage: np.ndarray, term: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of all at ``least`` or above. The pairs (passage, term) are sorted by passage, each once.

    Block-max WAND for many passages at once. A passage's terms stand in ascending order of their
    upper bounds; up to the pivot, at which the bounds add up to ``least``, they can't make a hit by
    themselves, so only blocks in the lists of the terms from the pivot on are looked at. A block stays if
    its own maxima, and the bounds before the pivot, reach ``least``. Only the items of these are scored.
    """
    if not len(passage):
        return passage, term, np.empty(0)
    begin = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    cost = np.add.reduceat(index.bounds[term + 1] - index.bounds[term], begin)
    turn = np.cumsum(cost) // POSTINGS
    cuts = [*begin[np.flatnonzero(np.r_[True, turn[1:] != turn[:-1]])].tolist(), len(passage)]
    found = [_search(index, passage[a:b], term[a:b], least) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _search(index: Index, passage: np.ndarray, term: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((index.bound[term], passage))
    passage, term = passage[order], term[order]
    total = np.cumsum(index.bound[term])
    begin = np.r_[True, passage[1:] != passage[:-1]]
    head = np.maximum.accumulate(np.where(begin, np.arange(len(passage)), 0))
    so_far = total - total[head] + index.bound[term][head]
    slack = 1e-9
    late = np.flatnonzero(so_far >= least - slack)
    if not len(late):
        return passage[:0], term[:0], np.empty(0)
    first = np.r_[True, passage[late][1:] != passage[late][:-1]]
    early = np.where(late[first] > head[late[first]], so_far[late[first] - 1], 0.0)  # the bounds before the pivot
    row, at = _spread(index.block_bounds, term[late])
    who = np.cumsum(first)[row] - 1
    n_blocks = int(index.block.max()) + 1
    key, back = np.unique(who * n_blocks + index.block[at], return_inverse=True)
    upper = np.bincount(back, index.most[at]) + early[key // n_blocks]
    live = key[upper >= least - slack]
    if not len(live):
        return passage[:0], term[:0], np.empty(0)
    ids = passage[late[first]]  # passages with a pivot
    chosen = np.unique(live // n_blocks)
    mine = np.flatnonzero(np.isin(passage, ids[chosen]))
    row, at = _spread(index.block_bounds, term[mine])
    who = np.searchsorted(ids, passage[mine])[row]
    want = who * n_blocks + index.block[at]
    inside = live[np.minimum(np.searchsorted(live, want), len(live) - 1)] == want  # blocks that are out are never expanded
    who, at = who[inside], at[inside]
    row, at = _spread(index.block_begins, at)
    key, back = np.unique(who[row] * len(index.items) + index.item[at], return_inverse=True)
    score = np.bincount(back, index.weight[at])
    hit = score >= least - slack
    return ids[key[hit] // len(index.items)], key[hit] % len(index.items), score[hit]


def _overlap(words: list[bytes], item: tuple[int | None, list[bytes], int], n: int) -> tuple[float, float, float]:
    """Shares of the item's shingles that the passage has: of all, of those that begin in the question, of those that end in the answer."""
    _, own, cut = item
    n = min(n, len(own))
    have = set(zip(*(words[i:] for i in range(n)), strict=False))
    hits = np.array([x in have for x in zip(*(own[i:] for i in range(n)), strict=False)], bool)
    at = np.arange(len(hits))
    question, answer = hits[at < cut], hits[at + n > cut]
    return hits.mean(), question.mean() if len(question) else 1.0, answer.mean() if len(answer) else 1.0


def leaks_in(shard: list[Index], texts: list[bytes | None], rules: Leak) -> list[tuple[int, int | None, float, float, float, float]]:
    """(text, item, score, overlap, question overlap, answer overlap) of the items that the texts contain.

    ``shard``: indexes that share their terms, of items of similar length each. Passages are windows of twice the longest item's
    words, each beginning in the middle of the one before: whatever an item is copied to lies inside one.
    """
    if not shard:
        return []
    get, width = shard[0].terms.get, len(shard[0].terms)
    docs = [words_of(x) for x in texts]
    known = []
    for words in docs:
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        at = np.flatnonzero(ids >= 0)
        known.append((ids[at], at))
    best: dict[tuple[int, int, int], tuple[float, ...]] = {}
    for k, index in enumerate(shard):
        passage, term, base, starts, step = [], [], 0, [], index.longest
        for words, (ids, at) in zip(docs, known, strict=True):
            n = max(1, -(-len(words) // step) - 1) if words else 0
            half = at // step
            for shift in (0, -1):
                window = half + shift
                ok = (window >= 0) & (window < n)
                passage.append(base + window[ok])
                term.append(ids[ok])
            starts.append(base)
            base += n
        if not passage:
            continue
        pairs = np.unique(np.concatenate(passage) * width + np.concatenate(term))
        terms = pairs % width
        pairs = pairs[index.bounds[terms + 1] > index.bounds[terms]]
        for p, i, score in zip(*(x.tolist() for x in search(index, pairs // width, pairs % width, rules.score)), strict=True):
            d = int(np.searchsorted(starts, p, side="right")) - 1
            begin = (p - starts[d]) * step
            whole, question, answer = _overlap(docs[d][begin : begin + 2 * step], index.items[i], rules.shingle)
            if whole >= rules.overlap and question >= rules.question and answer >= rules.answer:
                best[d, k, i] = max(best.get((d, k, i), (0.0,) * 4), (score, whole, question, answer))
    return [(d, shard[k].items[i][0], *x) for (d, k, i), x in sorted(best.items())]


def similar_lengths(items: list[tuple[int | None, list[bytes], int]]) -> list[list[tuple[int | None, list[bytes], int]]]:
    """The items in groups whose longest has at most SPREAD times the words of the shortest: a long item doesn't stretch the windows
    of short ones."""
    groups: list[list[tuple[int | None, list[bytes], int]]] = []
    for x in sorted(items, key=lambda x: -len(x[1])):
        if not groups or len(groups[-1][0][1]) > SPREAD * len(x[1]):
            groups.append([])
        groups[-1].append(x)
    return groups


def _each_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text: the number of its words, and its different words."""
    for batch in batches:
        words = [words_of(x) for x in column_bytes(batch, "t")]
        yield pa.RecordBatch.from_arrays([pa.array([*map(len, words)], pa.int64()), pa.array([[w.decode() for w in {*ws}] for ws in words], pa.list_(pa.string()))], names=["n", "terms"])


def indexes(items: DataFrame, rules: Leak, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[Index]]:
    """The items' indexes, in shards of a bounded size that are collected in turns. Document frequencies count all items."""
    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("t")).filter("t is not null").distinct()
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(F.pmod(F.xxhash64("item", "t"), F.lit(4096)).alias("part")).agg(F.sum(F.octet_length("t")).alias("n"))
    shards = [(x["part"], x["before"] // rules.shard_bytes) for x in sizes.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before")).collect()]
    total = len(shards) and rows.agg(F.count("*")).first()[0]
    if not total:
        return
    words = rows.select("t").mapInArrow(_each_once, "n long, terms array<string>")
    mean = words.agg(F.avg("n")).first()[0]
    df = words.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    part = F.pmod(F.xxhash64("item", "t"), F.lit(4096))
    for shard in sorted({s for _, s in shards}):
        own = rows.filter(part.isin([p for p, s in shards if s == shard]))
        found = [(x["item"], words_of(x["t"].encode()), answer_at(x["t"])) for x in own.orderBy("item", "t").collect()]
        terms = own.select("t").mapInArrow(_each_once, "n long, terms array<string>").select(F.explode("terms").alias("term")).distinct()
        counts = {x["term"].encode(): x["df"] for x in df.join(terms, "term", "left_semi").collect()}
        found = [x for x in found if x[1]]
        known: dict[bytes, int] = {}
        for _, ws, _ in found:
            for w in ws:
                known.setdefault(w, len(known))
        yield [Index(group, known).build(counts, total, mean) for group in similar_lengths(found)]


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Leak = Leak()) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap): a row for each text and item that it contains.

    Every passage of every text is a query against the items' BM25 index; all items above the score
    are retrieved, then verified by shared shingles. The index is broadcast in shards of at most
    ``rules.shard_bytes`` bytes of items (a benchmark of 16 MB is one); nothing else moves.
    Null and wordless texts or items match nothing. Items without an id are searched for as well, and found with a null item_id; rows
    without an id, and repeated rows, are searched each; repeated items count once. Empty tables give an empty result; further columns aren't read.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    plain = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    found = spark.createDataFrame([], schema)
    for shard in indexes(items, rules):
        shared = spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "t", 1_000_000):
                rows = leaks_in(shared.value, column_bytes(batch, "t"), rules)
                at, item, *rest = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), *(pa.array(x, pa.float64()) for x in rest)], names=[x.split()[0] for x in schema.split(", ")])

        found = found.unionByName(plain.mapInArrow(run, schema))
    return found


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", rules: Leak = Leak()) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns, whatever those are called.

    Null, empty and wordless texts stay; each of repeated rows is judged, with the same verdict. Without items all rows stay; an empty
    table gives an empty result.
    """
    at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    kept = docs.toDF(*names)
    schema = kept.schema
    for shard in indexes(items, rules):
        shared = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, names[at], 1_000_000):
                bad = {x[0] for x in leaks_in(shared.value, column_bytes(batch, names[at]), rules)}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)]))

        kept = kept.mapInArrow(run, schema)
    return kept.toDF(*docs.columns)


def op4_bm25_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
