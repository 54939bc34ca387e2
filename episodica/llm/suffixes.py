"""Exact repeated passages by bucket-pointer refinement (operator 8)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.shared import fresh_path, slices, table

#: Bytes of the strings that are compared, and of the q-grams of the first buckets.
LENGTH, GRAM = 100, 24
#: Bytes that are bucketed at once; longer texts are cut, with LENGTH - 1 bytes of overlap.
STRETCH = 1_000_000
#: The seed with which Spark hashes, too. With that hash ``h`` of its text, an id names a text; the 17 bits below are of another one.
SEED = 42
#: A run of starts as one number: kind, 17 bits of the text's hash, 36 bits of the first start, 7 bits of how many.
RUN_BITS, START_BITS, TEXT_BITS = 7, 36, 17
KIND = RUN_BITS + START_BITS + TEXT_BITS
SEGMENT, SHARED, WIDE, ASKED, ASKED_WIDE, REPEAT = range(6)
_ROW = "a long, b long, doc long, h long, at long"
#: Bytes of stretches that are settled among themselves before their segments meet those of others.
GROUP = 24 * STRETCH
#: Different segments of a bucket in one group of stretches, and in all: a bucket with more is refined string by string, on all executors.
WIDE_HERE, WIDE_ALL = 64, 4096
#: Strings that a task sorts at once, rows of whole buckets that it holds.
STRINGS, HELD = 200_000, 300_000
#: Texts whose requests are held as objects at once, and their bytes.
ROWS, BYTES = 250, 8_000_000


def _pointer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of the bucket of a string, from those of its two halves: the same on every executor."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x += b
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def refine(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of the GRAM-byte and the 64-byte strings at each position.

    Each step refines the buckets of a length by the identifiers that lie that many bytes on, and
    reuses those for the next: 8, 16, 32, 64 bytes; 100 bytes are a 64-byte pair 36 bytes apart.
    """
    n = len(raw)
    word = np.ndarray((n - 7,), "<u8", raw, 0, (1,)).astype(np.uint64)
    b8 = _pointer(word, word)
    b16 = _pointer(b8[:-8], b8[8:])
    gram = _pointer(b16[: n - GRAM + 1], b8[16 : 16 + n - GRAM + 1])
    b32 = _pointer(b16[:-16], b16[16:])
    return gram, _pointer(b32[:-32], b32[32:])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the position of the (leftmost) least."""
    low, at, span = values, np.arange(len(values), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.minimum(low[step:], low[:-step])
        span += step
    return at


def stretches(texts: list[bytes], size: int = STRETCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts as (raw bytes, row number, offset in the text, begin in raw) of their pieces."""
    rows, offsets, parts, held = [], [], [], 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        begins = np.cumsum([0, *map(len, parts)])
        return np.frombuffer(b"".join(parts), np.uint8), np.array(rows), np.array(offsets), begins

    for i, text in enumerate(texts):
        for offset in range(0, max(len(text) - LENGTH + 1, 0), size):
            parts.append(text[offset : offset + size + LENGTH - 1])
            rows.append(i)
            offsets.append(offset)
            held += len(parts[-1])
            if held >= size:
                yield out()
                rows, offsets, parts, held = [], [], [], 0
    if parts:
        yield out()


def _starts(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every start of a LENGTH-byte string inside one piece, and the piece."""
    n = np.diff(begins) - LENGTH + 1
    piece = np.repeat(np.arange(len(n)), n)
    return np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n) + begins[:-1][piece], piece


def segments(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first start, number of starts, piece, first bucket, segment's identifier): runs of starts of strings that
    fall in the same first bucket.

    A string's first bucket is that of the least q-gram inside it, so equal strings share it wherever
    they stand, and a run of about forty strings shares one, too. A segment's identifier is
    that of all its bytes.
    """
    gram, b64 = refine(raw)
    least = _least(gram, LENGTH - GRAM + 1)
    start, piece = _starts(begins)
    anchor = least[start]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])])
    count = np.diff(np.r_[new, len(start)])
    first = start[new]
    last = first + count - 1
    head, tail = _pointer(b64[first], b64[first + 36]), _pointer(b64[last], b64[last + 36])
    return first, count, piece[new], gram[anchor[new]], _pointer(head, tail + count.astype(np.uint64))


def _batch(a: np.ndarray, b: np.ndarray, doc: np.ndarray, h: np.ndarray, at: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b, doc, h, at | (kind.astype(np.int64) << KIND))], names=["a", "b", "doc", "h", "at"])


def _judge(m: np.ndarray, s: np.ndarray, doc: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted order, and for each row there: whether an earlier row has the same segment, how many different ones its bucket has."""
    order = np.lexsort((at, h, doc, s, m))
    m, s = m[order], s[order]
    bucket = np.r_[True, m[1:] != m[:-1]][: len(m)]
    same = ~bucket
    same[1:] &= s[1:] == s[:-1]
    group = np.cumsum(bucket) - 1
    kinds = np.bincount(group, ~same)[group] if len(m) else np.zeros(0)
    return order, _later(same, doc[order], h[order], at[order]), kinds


def _later(same: np.ndarray, doc: np.ndarray, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of sorted rows that are the same as the one before, those whose place differs from their first's: repeated rows don't repeat each other."""
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    return same & ((doc != doc[head]) | (h != h[head]) | (at != at[head]))


def first_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the texts, settled among themselves, group by group of stretches: of equal ones only the first goes on.

    Rows of kind SEGMENT go on to meet those of other groups. Where a bucket holds several different segments here, each is ASKED for
    refinement, and one SHARED row tells the others. Where it holds very many, they don't meet as a bucket at all: they are
    ASKED_WIDE, and a WIDE row tells. So a bucket gets a bounded number of rows from each group, and a passage that is everywhere one.
    """
    held, size = [], 0
    for batch in slices(batches, "text", BYTES):
        doc, h, texts = _rows(batch)
        once = _once(doc, texts)
        doc, h, texts = doc[once], h[once], [texts[i] for i in once]
        for raw, row, offset, begins in stretches(texts):
            hashes = np.array([xxhash.xxh64_intdigest(texts[i]) & ((1 << TEXT_BITS) - 1) for i in row], np.int64)
            first, count, piece, m, s = segments(raw, begins)
            held.append((m, s, doc[row][piece], h[row][piece], _packed(hashes[piece], first - begins[piece] + offset[piece], count)))
            size += len(raw)
            if size >= GROUP:
                yield from _group(held)
                held, size = [], 0
    if held:
        yield from _group(held)


def _group(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    m, s, ids, own, at = (np.concatenate(x) for x in zip(*held, strict=True))
    order, same, kinds = _judge(m, s, ids, own, at)
    kind = np.select([same, kinds > WIDE_HERE, kinds > 1], [REPEAT, ASKED_WIDE, ASKED], SEGMENT)
    yield _batch(m[order], s[order], ids[order], own[order], at[order], kind)
    for flag, told in ((SHARED, (kinds > 1) & (kinds <= WIDE_HERE)), (WIDE, kinds > WIDE_HERE)):
        buckets = np.unique(m[order][told])
        none = np.zeros(len(buckets), np.int64)
        yield _batch(buckets, none, none, none, none, np.full(len(buckets), flag))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids, hashes of the texts, texts."""
    texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
    return batch.column(0).to_numpy(), np.array([xxhash.xxh64_intdigest(x, SEED) for x in texts], np.uint64).view(np.int64), texts


def _once(doc: np.ndarray, texts: list[bytes]) -> list[int]:
    """The first of each id and text: repeated rows stand at the same place, so one of them tells all."""
    return list({x: i for i, x in reversed(list(enumerate(zip(doc.tolist(), texts, strict=True))))}.values())[::-1]


def _packed(text: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return text << (RUN_BITS + START_BITS) | start << RUN_BITS | count


def _by_bucket(batches: Iterator[pa.RecordBatch], thin) -> Iterator[pa.Table]:
    """Rows that are sorted by ``a`` in tables of whole buckets. Of a bucket with very many rows, ``thin`` keeps those that matter on and gives out others."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < HELD:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        a = rows.column("a").to_numpy()
        end = int(np.searchsorted(a, a[-1]))
        if end:
            yield rows.slice(0, end)
        rest = rows.slice(end)
        if rest.num_rows >= HELD // 2:
            out, rest = thin(rest)
            yield out
        held, n = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _columns(rows: pa.Table) -> list[np.ndarray]:
    return [rows.column(i).to_numpy() for i in range(5)]


def _judged(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """m, s, doc, h, at without kind, kind of the segments in judged order; whether an earlier one is equal; different ones; SHARED; WIDE."""
    m, s, doc, h, at = _columns(rows)
    kind, at = at >> KIND, at & ((1 << KIND) - 1)
    shared, wide = np.unique(m[kind == SHARED]), np.unique(m[kind == WIDE])
    own = (kind == SEGMENT) | (kind == ASKED)
    m, s, doc, h, at, kind = (x[own] for x in (m, s, doc, h, at, kind))
    order, same, kinds = _judge(m, s, doc, h, at)
    m, s, doc, h, at, kind = (x[order] for x in (m, s, doc, h, at, kind))
    return m, s, doc, h, at, kind, same, (kinds > WIDE_ALL) | np.isin(m, wide), (kinds > 1) | np.isin(m, shared)


def _thin_segments(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Of one bucket: what is settled already; and the first of each different segment with the bucket's flags, or, once it is wide, that alone."""
    kind = rows.column("at").to_numpy() >> KIND
    done = rows.filter(pa.array(kind >= ASKED_WIDE))
    m, s, doc, h, at, own, same, very, several = _judged(rows)
    first = ~same
    new = np.where(same, REPEAT, ASKED_WIDE)
    out = same | very
    flags = np.array([SHARED] * bool((kind == SHARED).any()) + [WIDE] * bool(very.any() or (kind == WIDE).any()), np.int64)
    none = np.zeros(len(flags), np.int64)
    on = first & ~very
    settled = pa.Table.from_batches([_batch(m[out], s[out], doc[out], h[out], at[out], new[out])])
    rest = pa.Table.from_batches([_batch(m[on], s[on], doc[on], h[on], at[on], own[on]), _batch(np.full(len(flags), rows.column("a")[0].as_py()), none, none, none, none, flags)])
    return pa.concat_tables([done, settled]), rest


def settle_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of whole buckets, sorted by bucket: all but the first of equal ones are repeats; where there are different ones, they are asked for."""
    for rows in _by_bucket(batches, _thin_segments):
        done = rows.filter(pa.array(rows.column("at").to_numpy() >> KIND >= ASKED_WIDE))
        yield from done.to_batches()
        m, s, doc, h, at, _, same, very, several = _judged(rows)
        new = np.select([same, very, several], [REPEAT, ASKED_WIDE, ASKED], SEGMENT)
        out = new != SEGMENT
        yield _batch(m[out], s[out], doc[out], h[out], at[out], new[out])


def _strings(raw: np.ndarray, first: np.ndarray, own: np.ndarray, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """(pointer, pointer 36 bytes on, id, text's hash, place, start in ``raw``) of each string of segments that begin at ``first`` there."""
    _, b64 = refine(raw)
    count = own & ((1 << RUN_BITS) - 1)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(first, count) + inside
    at = np.repeat(own >> RUN_BITS << RUN_BITS, count) + (inside << RUN_BITS) + 1
    return b64[start].view(np.int64), b64[start + 36].view(np.int64), np.repeat(doc, count), np.repeat(h, count), at, start


def _repeats(a: np.ndarray, b: np.ndarray, doc: np.ndarray, h: np.ndarray, at: np.ndarray, raw: np.ndarray | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket pointers, then by place; and whether the string before is equal: by its bytes, where ``raw`` holds them."""
    order = np.lexsort((at, h, doc, b, a))
    a, b = a[order], b[order]
    same = np.r_[False, (a[1:] == a[:-1]) & (b[1:] == b[:-1])][: len(a)]
    if raw is not None:
        strings, pairs = np.lib.stride_tricks.sliding_window_view(raw, LENGTH), np.flatnonzero(same)
        for i in range(0, len(pairs), 50_000):
            now = pairs[i : i + 50_000]
            same[now] = (strings[start[order[now]]] == strings[start[order[now - 1]]]).all(axis=1)
    return order, _later(same, doc[order], h[order], at[order])


def _runs(doc: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings (runs of one) whose places follow each other as longer runs."""
    order = np.lexsort((at, h, doc))
    doc, h, at = doc[order], h[order], at[order]
    step = 1 << RUN_BITS
    new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (at[1:] - at[:-1] != step)][: len(at)]
    place = np.arange(len(at))
    head = np.maximum.accumulate(np.where(new, place, 0))
    new |= (place - head) % (step - 1) == 0  # as many as a run's bits can count
    begin = np.flatnonzero(new)
    return doc[begin], h[begin], at[begin] - 1 + np.diff(np.r_[begin, len(at)])


def last_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is asked for: the bytes of a segment for its bucket; or, of a wide bucket, each string by itself as bucket pointers."""
    for batch in batches:
        doc, h, texts = _rows(batch)
        once = _once(doc, texts)
        doc, h, texts, requests = doc[once], h[once], [texts[i] for i in once], batch.column(2).take(pa.array(once, pa.int64())).to_pylist()
        out: list[tuple] = []
        for i, asked in enumerate(requests):
            for x in asked:
                at = x["at"] & ((1 << KIND) - 1)
                if x["at"] >> KIND == ASKED:
                    first, count = at >> RUN_BITS & ((1 << START_BITS) - 1), at & ((1 << RUN_BITS) - 1)
                    out.append((x["a"], 0, doc[i], h[i], at, texts[i][first : first + count + LENGTH - 1]))
        yield _asked(*zip(*out, strict=True)) if out else _asked(*[[]] * 6)
        for raw, row, offset, begins in stretches(texts):
            found = []
            for i, o, begin, end in zip(row, offset, begins[:-1], begins[1:], strict=True):
                own = np.array([x["at"] & ((1 << KIND) - 1) for x in requests[i] if x["at"] >> KIND == ASKED_WIDE], np.int64)
                first, _ = _unpacked(own)
                mine = (first >= o) & (first < o + (end - begin) - LENGTH + 1)
                n = int(mine.sum())
                found.append((np.full(n, doc[i]), np.full(n, h[i]), own[mine], first[mine] - o + begin))
            ids, hashes, own, first = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(own):
                a, b, ids, hashes, at, start = _strings(raw, first, own, ids, hashes)
                order, same = _repeats(a, b, ids, hashes, at, raw, start)
                a, b, ids, hashes, at = (x[order] for x in (a, b, ids, hashes, at))
                yield _asked(a[~same], b[~same], ids[~same], hashes[~same], at[~same], None)
                ids, hashes, at = _runs(ids[same], hashes[same], at[same])
                yield _asked(at, np.zeros(len(at), np.int64), ids, hashes, at | (REPEAT << KIND), None)


def _asked(a, b, doc, h, at, text) -> pa.RecordBatch:
    columns = [pa.array(x, pa.int64()) for x in (a, b, doc, h, at)]
    return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.binary()) if text is None else pa.array(text, pa.binary())], names=["a", "b", "doc", "h", "at", "bytes"])


def _runs_of(doc: np.ndarray, h: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, h, at)], names=["doc", "h", "at"])


def _thin_strings(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Of one pointer's strings that came by themselves: the repeats; and the rest, with the first of each."""
    a, b, doc, h, at = _columns(rows)
    single = np.flatnonzero(~rows.column("bytes").is_valid().to_numpy() & (at >> KIND != REPEAT))
    order, same = _repeats(*(x[single] for x in (a, b, doc, h, at)))
    gone = single[order[same]]
    i, j, k = _runs(doc[gone], h[gone], at[gone])
    keep = np.ones(len(a), bool)
    keep[gone] = False
    return pa.Table.from_batches([_asked(k, np.zeros(len(k), np.int64), i, j, k | (REPEAT << KIND), None)]), rows.filter(pa.array(keep))


def settle_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All but the first of equal strings, as runs: of those that came by themselves, and of the buckets' segments, whose bytes are compared."""
    for rows in _by_bucket(batches, _thin_strings):
        a, b, doc, h, at = _columns(rows)
        done = at >> KIND == REPEAT
        yield _runs_of(doc[done], h[done], at[done] & ((1 << KIND) - 1))
        whole = rows.column("bytes").is_valid().to_numpy()
        single = ~whole & ~done
        if single.any():
            order, same = _repeats(a[single], b[single], doc[single], h[single], at[single])
            yield _runs_of(*_runs(doc[single][order][same], h[single][order][same], at[single][order][same]))
        segment = np.flatnonzero(whole)
        segment = segment[np.argsort(a[segment], kind="stable")]
        count = np.cumsum(at[segment] & ((1 << RUN_BITS) - 1))
        begin = 0
        while begin < len(segment):
            end = int(np.searchsorted(count, (count[begin - 1] if begin else 0) + STRINGS, side="right"))
            end = max(end, begin + 1)
            end = int(np.searchsorted(a[segment], a[segment[end - 1]], side="right"))  # with the whole bucket
            mine = segment[begin:end]
            texts = rows.column("bytes").take(pa.array(mine)).to_pylist()
            first = np.cumsum([0, *map(len, texts)])[:-1]
            raw = np.frombuffer(b"".join(texts), np.uint8)
            *strings, start = _strings(raw, first, at[mine], doc[mine], h[mine])
            order, same = _repeats(*strings, raw, start)
            yield _runs_of(*_runs(*(x[order][same] for x in strings[2:])))
            begin = end


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at >> RUN_BITS & ((1 << START_BITS) - 1), at & ((1 << RUN_BITS) - 1)


def spans_of(runs: list[int] | None) -> list[tuple[int, int]]:
    """The union of the bytes that runs of starts cover, as maximal spans."""
    if not runs:
        return []
    first, count = _unpacked(np.array(runs, np.int64))
    order = np.argsort(first, kind="stable")
    begin, end = first[order], np.maximum.accumulate((first + count + LENGTH - 1)[order])
    new = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
    return list(zip(begin[new].tolist(), end[np.r_[new[1:] - 1, len(end) - 1]].tolist(), strict=True))


def repeated_runs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts keyed by id and text hash, their runs of repeated starts) of docs with columns id and text."""
    spark = docs.sparkSession
    keyed = docs.select("id", "text", F.xxhash64("text").alias("hash"))
    kind = F.shiftright("at", KIND)
    found = docs.select("id", "text").mapInArrow(first_buckets, _ROW)
    by_bucket = found.repartition(F.when(kind >= ASKED_WIDE, F.xxhash64("doc", "h", "at")).otherwise(F.col("a")))
    path = fresh_path(spark, "segments")
    by_bucket.sortWithinPartitions("a").mapInArrow(settle_segments, _ROW).select("a", "doc", "h", "at").write.parquet(path)
    settled = spark.read.parquet(path)
    asked = settled.filter(kind != REPEAT).groupBy("doc", "h").agg(F.collect_set(F.struct("a", "at")).alias("asked"))
    strings = keyed.join(asked, (keyed.id == asked.doc) & (keyed.hash == asked.h)).select("id", "text", "asked").mapInArrow(_own(last_buckets), f"{_ROW}, bytes binary")
    later = strings.repartition("a", "b").sortWithinPartitions("a").mapInArrow(settle_strings, "doc long, h long, at long")
    repeats = settled.filter(kind == REPEAT).select("doc", "h", F.col("at").bitwiseAND((1 << KIND) - 1).alias("at"))
    return keyed, repeats.unionByName(later)


def _own(then):
    """Only the requests that belong to the row's text, not to another one of the same id and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def mine() -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, ROWS) for b in slices(batches, "text", BYTES) for i in range(0, b.num_rows, ROWS)):
                asked = []
                for runs, text in zip(batch.column(2).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    mine = set(_of_text([x["at"] & ((1 << KIND) - 1) for x in runs], text))
                    asked.append([x for x in runs if x["at"] & ((1 << KIND) - 1) in mine])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(asked, batch.column(2).type)], names=["id", "text", "asked"])

        return then(mine())

    return run


def _of_text(runs: list[int] | None, text: bytes | None) -> list[int]:
    if not runs:
        return []
    mark = xxhash.xxh64_intdigest(text or b"") & ((1 << TEXT_BITS) - 1)
    return [x for x in runs if x >> (RUN_BITS + START_BITS) & ((1 << TEXT_BITS) - 1) == mark]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept: binary) for every row of ``docs``.

    Removed is each byte covered by a 100-byte string of a text that also starts earlier: in a
    text of smaller id, or before in the same text. Bucket-pointer refinement, level by level:

    1. each string goes to the bucket of its least 24-byte q-gram; runs of strings that share one make
       a segment (2.5 rows for 100 bytes of text). A bucket with one segment needs no refinement, and equal segments are settled by
       their first;
    2. the strings of the other segments are sorted by pointers to the buckets of 64 bytes at
       their offsets 0 and 36, which grew out of those of 8, 16 and 32 bytes. All but the first of equal ones are
       repeats. A segment's bytes travel to its bucket's task for that; those of a bucket with very many different
       segments don't: there each string goes its own way, by its pointers.

    Equals are settled in rounds: in a group of stretches of 24 MB of text, then among all groups; each sends one row of a
    bucket's or string's equals on, so frequent passages stay small. The rows of a bucket come sorted, and a task holds a
    bounded number of them. Equal strings are equal by two pointers of 64 bits, and by their bytes wherever a task has both.

    Null and empty texts keep nothing and lose nothing. A null id counts as the largest. Rows that share
    id and text stand at the same place, so neither repeats the other; rows that share an id alone are told apart by
    two hashes of the text, of 64 and 17 bits, in the order of which they count. What belongs to a row is gathered and joined by id
    and text, so that a list has no more than its own text's runs, however many rows share an id. An empty table gives an empty
    result; further columns aren't read.
    """
    last = F.lit(2**63 - 1)
    keyed, runs = repeated_runs(docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("id"), F.col(text_col).alias("text")))
    by_doc = runs.groupBy("doc", "h").agg(F.collect_set("at").alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BYTES):
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            for i in range(0, len(texts), 500):
                out = []
                for text, found in zip(texts[i : i + 500], batch.column(2).slice(i, 500).to_pylist(), strict=True):
                    spans, end, kept = spans_of(_of_text(found, text)), 0, []
                    for a, b in spans:
                        kept.append(text[end:a])
                        end = b
                    rest = b"".join([*kept, text[end:]])
                    out.append((len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 500), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    found = keyed.join(by_doc, (keyed.id == by_doc.doc) & (keyed.hash == by_doc.h), "left").select("id", "text", "runs")
    done = found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.withColumn("doc_id", F.nullif("doc_id", last))


def op8_bucket_pointer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
