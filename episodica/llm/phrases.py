"""Phrase collocations from count streams in prefix and suffix order (operator 11)."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodica.llm.shared import cut, slices, table

#: Marks that part a text into pieces, and the white space between words.
PARTS = b".,;:!?\n\v\f\r"
SPACES = b" \t"
LONGEST = 5
#: Bytes of text whose words are numbered at once; a longer text stands alone.
SLICE = 4_000_000
#: Bits of the filter of frequent words or pairs: 8 MB, whatever the corpus.
FILTER_BITS = 1 << 26
#: Counters of the first look at pairs, and those of a block that tasks send: 16 MB a task at most.
COUNTERS, COUNTER_BLOCK = 1 << 24, 1 << 16
GRAM = "lang string, words array<string>, n long"


def _class_table() -> np.ndarray:
    kind = np.ones(256, np.uint8)
    kind[list(SPACES)] = 0
    kind[list(PARTS)] = 2
    return kind


_KIND = _class_table()
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Numbered:
    """The words of some texts: ``id`` of each word in text order, ``names`` by id, and ``room``: the words left in its piece, itself included."""

    def __init__(self, langs: list[str | None], texts: list[bytes | None]) -> None:
        raw = b"\n".join([*((x or b"") for x in texts), b""]).translate(_LOWER)
        size = np.array([len(x or b"") + 1 for x in texts], np.int64)
        bytes_ = np.frombuffer(raw, np.uint8)
        kind = _KIND[bytes_]
        inside = kind == 1
        begin = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
        end = np.flatnonzero(inside & np.r_[~inside[1:], True]) + 1
        offsets = np.r_[0, np.cumsum(end - begin)]
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(bytes_[inside].tobytes())])
        named = column.dictionary_encode()
        text = np.searchsorted(np.cumsum(size), begin, side="right")
        seen: dict[str, int] = {}
        lang = np.array([seen.setdefault("und" if x is None else x, len(seen)) for x in langs], np.int64)[text] if len(begin) else np.empty(0, np.int64)
        self.langs, spelled = list(seen), named.dictionary
        key, self.id = np.unique(lang * max(1, len(spelled)) + named.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        self.lang = key // max(1, len(spelled))
        self.names = spelled.take(pa.array(key % max(1, len(spelled)))).cast(pa.large_string())
        piece = np.cumsum(kind == 2)[begin]
        last = np.searchsorted(piece, piece, side="right")
        self.room = last - np.arange(len(begin))

    def hashes(self) -> np.ndarray:
        """Of each word with its language, as the session's xxhash64(lang, word) gives it."""
        seeds = [xxhash.xxh64_intdigest(x.encode(), 42) for x in self.langs]
        found = (xxhash.xxh64_intdigest(w.as_buffer(), seeds[g]) for w, g in zip(self.names.cast(pa.large_binary()), self.lang.tolist(), strict=True))
        return np.fromiter(found, np.uint64, len(self.lang))


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first ^ (second << np.uint64(17) | second >> np.uint64(47))


def _filter_of(grams: DataFrame, words: int) -> np.ndarray:
    """A bit for the hash of each of the ``grams`` of one or two words: a gram's bit is never missing, others' may be set by chance."""
    split = F.split("phrase", " ", -1)
    hashed = [F.xxhash64("lang", split[i]) for i in range(words)]
    turned = F.shiftleft(hashed[-1], 17).bitwiseXOR(F.shiftrightunsigned(hashed[-1], 47))
    place = (hashed[0] if words == 1 else hashed[0].bitwiseXOR(turned)).bitwiseAND(F.lit(FILTER_BITS - 1))
    found = grams.select(place.alias("place")).selectExpr("CAST(place >> 5 AS INT) AS at", "shiftleft(1L, CAST(place & 31 AS INT)) AS bit")
    rows = found.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # FILTER_BITS / 32 pairs of numbers at most
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return bits


def _is_set(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    at = hashed & np.uint64(32 * len(bits) - 1)
    return (bits[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def _grams(found: Numbered, longest: int, bits: np.ndarray | None, pairs: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, ids of their words as rows, counts) of the texts' different grams: single words without ``bits``; with ``pairs``, pairs
    in that filter of words in the filter ``bits``; else grams of 3 words or more whose pairs are all in ``bits``."""
    ids, room, v = found.id, found.room, max(1, len(found.names))
    if bits is None:
        yield 1, np.arange(len(found.names))[:, None], np.bincount(ids, minlength=len(found.names))
        return
    hashed, code = found.hashes(), ids.astype(np.int64)  # code: a number for the gram of m - 1 words at each place
    at = np.flatnonzero(room >= 2)
    if pairs is not None:
        known = _is_set(bits, hashed)
        at = at[known[ids[at]] & known[ids[at + 1]]]
        runs = [(2, at[_is_set(pairs, _pair_hash(hashed[ids[at]], hashed[ids[at + 1]]))])]
    else:
        at = at[_is_set(bits, _pair_hash(hashed[ids[at]], hashed[ids[at + 1]]))]
        known = np.zeros(len(ids) + longest, bool)
        known[at] = True
        code[at] = np.unique(ids[at] * v + ids[at + 1], return_inverse=True)[1]
        runs = []
        for m in range(3, longest + 1):
            at = at[known[at + m - 2]]
            runs.append((m, at))
    for m, at in runs:
        _, first, code[at], counts = np.unique(code[at] * v + ids[at + m - 1], return_index=True, return_inverse=True, return_counts=True)
        yield m, ids[at[first][:, None] + np.arange(m)], counts


def _seldom(docs: DataFrame, bits: np.ndarray, min_count: int) -> np.ndarray:
    """A bit for each counter that pairs of words in the filter ``bits`` raise to ``min_count``: pairs of other counters are too rare.

    A pair's hash names its counter; several pairs may share one, so a frequent pair's bit is never missing. A task's counters stop at ``min_count``
    and go out as packed blocks, which are summed block by block.
    """
    limit, counters, size = SLICE, COUNTERS, COUNTER_BLOCK
    kind = np.dtype(np.uint8 if min_count < 256 else np.uint32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(counters, kind)
        for batch in slices(batches, "text", limit):
            found = Numbered(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())
            hashed = found.hashes()
            known = _is_set(bits, hashed)[found.id]
            at = np.flatnonzero(found.room >= 2)
            at = at[known[at] & known[at + 1]]
            place, n = np.unique(_pair_hash(hashed[found.id[at]], hashed[found.id[at + 1]]) & np.uint64(counters - 1), return_counts=True)
            held[place] = np.minimum(held[place] + n, min_count)
        for i, block in enumerate(held.reshape(-1, size)):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(block.tobytes(), 1)])], names=["block", "packed"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                block = np.frombuffer(zlib.decompress(packed), kind).astype(np.int64)
                total[i] = np.minimum(total[i] + block, min_count) if i in total else block
        full = [np.packbits(x >= min_count, bitorder="little").tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array(full, pa.binary())], names=["block", "packed"])

    schema = "block int, packed binary"
    found = np.zeros(counters // 8, np.uint8)
    for r in docs.mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect():  # COUNTERS / 8 bytes
        found[r["block"] * size // 8 : (r["block"] + 1) * size // 8] = np.frombuffer(r["packed"], np.uint8)
    return found.view(np.uint32)


def _counts(docs: DataFrame, longest: int, bits: np.ndarray | None, pairs: np.ndarray | None = None) -> DataFrame:
    """(lang, words, phrase, n): how often each gram of :func:`_grams` occurs; with single words, the row of 0 words counts them all."""
    limit = SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", limit):
            found = Numbered(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())
            langs = pa.array(found.langs, pa.string())
            for m, rows, counts in _grams(found, longest, bits, pairs):
                phrase = pc.binary_join_element_wise(*[found.names.take(pa.array(c)) for c in rows.T], pa.scalar(" ", pa.large_string())).cast(pa.string())
                lang = langs.take(pa.array(found.lang[rows[:, 0]]))
                yield pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(rows), m, np.int32)), phrase, pa.array(counts.astype(np.int64))], names=["lang", "words", "phrase", "n"])
                if m == 1:
                    total = np.bincount(found.lang[found.id], minlength=len(langs)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([langs, pa.array(np.zeros(len(langs), np.int32)), pa.array([""] * len(langs), pa.string()), pa.array(total)], names=["lang", "words", "phrase", "n"])

    each = docs.mapInArrow(run, "lang string, words int, phrase string, n long")
    return each.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def frequent_grams(docs: DataFrame, lang_col: str, text_col: str, min_count: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(lang, words: array, n) of every gram of up to ``longest`` words that occurs ``min_count`` times in a language, and (lang, total) words.

    A gram can be frequent only where its parts are, so the corpus is read four times: for words, for a first look at pairs of frequent words,
    for those of them that may be frequent, and for longer grams of frequent pairs. The later ones are thinned in the scan's tasks by filters of fixed
    size, which never miss; in a corpus that fills them they let more through. Counts are exact, as what passes by chance is dropped by its count.
    """
    plain = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    enough = (F.col("n") >= min_count) & (F.col("words") > 0)
    singles = cut(_counts(plain, 1, None).filter(enough | (F.col("words") == 0)))
    words = _filter_of(singles.filter("words = 1"), 1)
    pairs = cut(_counts(plain, 2, words, _seldom(plain, words, min_count)).filter(enough))
    longer = _counts(plain, longest, _filter_of(pairs, 2)).filter(enough) if longest > 2 else pairs.limit(0)
    whole = singles.filter("words = 1").unionByName(pairs).unionByName(longer)
    return cut(whole.select("lang", F.split("phrase", " ", -1).alias("words"), "n")), singles.filter("words = 0").select("lang", F.col("n").alias("total"))


Gram = tuple[str, tuple[str, ...]]


def _bounds(grams: DataFrame, parts: int, each: int = 8) -> list[Gram]:
    """Grams that cut the order by language and words into about ``parts`` equal ranges: every eighth of those with the least hashes."""
    rows = grams.orderBy(F.xxhash64("lang", "words"), "lang", "words").select("lang", "words").limit(parts * each).collect()
    return sorted((r[0], tuple(r[1])) for r in rows)[each::each]


def _in_order(grams: DataFrame, longest: int) -> DataFrame:
    """(part, lang, words, n, own): the stream dealt into ranges of its order, sorted. A gram also goes, with ``own`` false, to each later range
    that its extensions reach: at most ``longest`` - 1 for a bound, as they are all beginnings of the bound."""
    bounds = _bounds(grams, int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            parts: list[int] = []
            for i, (lang, words) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                key = tuple(words)
                at = bisect_right(bounds, (lang, key))
                rows.append(i)
                parts.append(at)
                while at < len(bounds) and bounds[at][0] == lang and bounds[at][1][: len(key)] == key:
                    at += 1
                    rows.append(i)
                    parts.append(at)
            own = np.r_[True, np.diff(rows) > 0] if rows else np.empty(0, bool)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *taken.columns, pa.array(own)], names=["part", "lang", "words", "n", "own"])

    dealt = grams.select("lang", "words", "n").mapInArrow(run, f"part int, {GRAM}, own boolean")
    return dealt.repartition(len(bounds) + 1, "part").sortWithinPartitions("part", "lang", "words")


def _along(stream: DataFrame, name: str, percent: int, backwards: bool) -> DataFrame:
    """(lang, words, n, <name>, covered) of one walk along a sorted stream: the counts of each gram's beginnings, shortest first, as <name>; and a
    row with ``covered`` for a gram that an extension by one word occurs as often as, by ``percent``. The beginnings of a gram are those that
    the walk has last met, so a stack of a few grams is all that is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[tuple[str, ...], int, list[bool]]] = []
        range_ = None
        for batch in batches:
            out: list[tuple] = []
            turn = lambda words: list(reversed(words)) if backwards else list(words)
            for part, lang, words, n, own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                key = tuple(words)
                if range_ != (part, lang):
                    range_, stack = (part, lang), []
                while stack and key[: len(stack[-1][0])] != stack[-1][0]:
                    stack.pop()
                if stack and 100 * n >= percent * stack[-1][1] and not stack[-1][2][0]:
                    stack[-1][2][0] = True
                    if len(stack) > 1:
                        out.append((lang, turn(stack[-1][0]), stack[-1][1], None, True))
                if own and stack:
                    out.append((lang, turn(key), n, [x[1] for x in stack], False))
                stack.append((key, n, [False]))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "words", "n", name, "covered"])

    return stream.mapInArrow(run, f"{GRAM}, {name} array<long>, covered boolean")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = 100, longest: int = 5, percent: int = 100) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of each phrase of 2 to ``longest`` words that a language has ``min_count`` times or more.

    A-Z are lowered; texts part at ``.,;:!?`` and line ends into pieces, those at spaces and tabs into words; phrases stay inside a piece, overlapping
    occurrences count. a is the phrase's count, n the language's words, l and r the counts of its parts at the cut with the least score, which is
    floor(1000 a n / (l r)); of equal cuts the first. Phrases inside a longer one that occurs at least ``percent`` % as often go.

    The frequent counts are two streams, in the order of words and of words from the last to the first, dealt into ranges and sorted. A walk along the first
    finds what a phrase's beginnings count, one along the second what its ends count, and both the extensions by a word; the walks' rows meet by
    sorting on the phrase. No table of all phrases is held anywhere. It's enough to look at extensions by one word: a longer one occurs no more often.

    A null language is ``und``; a null or empty text has no words; repeated rows count each; further columns aren't read; an empty table gives an empty result.
    """
    grams, totals = frequent_grams(docs, lang_col, text_col, min_count, longest)
    forward = _along(_in_order(grams, longest), "lefts", percent, False).withColumn("rights", F.lit(None).cast("array<long>"))
    backward = _along(_in_order(grams.withColumn("words", F.reverse("words")), longest), "rights", percent, True).withColumn("lefts", F.lit(None).cast("array<long>"))
    met = forward.unionByName(backward).groupBy("lang", "words").agg(F.max("n").alias("a"), F.max("lefts").alias("lefts"), F.max("rights").alias("rights"), F.max("covered").alias("covered"))
    kept = met.filter("NOT covered").join(totals, "lang")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for a, lefts, rights, n in zip(*[batch.column(i).to_pylist() for i in range(2, 6)], strict=True):
                cuts = [(1000 * a * n // (x * y), i, x, y) for i, (x, y) in enumerate(zip(lefts, reversed(rights), strict=True))]
                best.append(min(cuts))
            columns = [pa.array([b[i] for b in best], pa.int64()) for i in (2, 3, 0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), columns[0], columns[1], batch.column(5), columns[2]], names=["lang", "phrase", "a", "l", "r", "n", "score"])

    ready = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", "lefts", "rights", F.col("total").alias("n"))
    return ready.mapInArrow(score, "lang string, phrase string, a long, l long, r long, n long, score long")


def top_phrases(phrases: DataFrame, top: int, salts: int = 64) -> DataFrame:
    """The first ``top`` phrases of each language by score, count and phrase, with their rank from 1. A language's phrases are thinned in ``salts`` groups first."""
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = phrases.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top).drop("salt")


def op11_phrase_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_phrases(collocations(table(spark, sf_dir, "documents")), 2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_N_GRAMS = " UNION ALL ".join(f"SELECT lang, {m} AS m, array_to_string(w[i:i + {m - 1}], ' ') AS phrase FROM pieces, range(1, len(w) - {m - 2}) AS t(i)" for m in range(1, LONGEST + 1))
_CUTS = " UNION ALL ".join(f"SELECT lang, phrase, m, a, {k} AS k, array_to_string(w[1:{k}], ' ') AS first, array_to_string(w[{k + 1}:], ' ') AS rest FROM candidates WHERE m > {k}" for k in range(1, LONGEST))
OP11_SQL = f"""WITH split AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), pieces AS (
  SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[ \t]+') IF x <> ''] AS w FROM split
), f AS (SELECT lang, phrase, m, count(*) AS n FROM ({_N_GRAMS}) GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY 1),
candidates AS (SELECT lang, phrase, m, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2),
cuts AS ({_CUTS}),
scored AS (
  SELECT c.lang, c.phrase, c.a, l.n AS l, r.n AS r, t.n AS n, (1000::HUGEINT * c.a * t.n // (l.n::HUGEINT * r.n))::BIGINT AS score,
    row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 1000::HUGEINT * c.a * t.n // (l.n::HUGEINT * r.n), k) AS place
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.phrase = c.rest JOIN totals t ON t.lang = c.lang
), inner_ AS (
  SELECT DISTINCT c.lang, array_to_string(c.w[i:i + s - 1], ' ') AS phrase, s, c.a
  FROM candidates c, range(2, {LONGEST}) AS x(s), range(1, {LONGEST}) AS y(i) WHERE s < c.m AND i + s - 1 <= c.m
), kept AS (
  SELECT * FROM scored s WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = s.lang AND i.phrase = s.phrase AND i.a >= s.a)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""
