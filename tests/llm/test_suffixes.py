"""Exact repeats against a brute-force reading of the contract."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from episodica.llm import suffixes as S


def brute(rows):
    """(id, bytes, removed bytes, spans, hash of the rest) with every 100-byte string in a dictionary."""
    first = {}
    for i, text in sorted(rows):
        raw = text.encode()
        for s in range(len(raw) - 99):
            first.setdefault(raw[s : s + 100], (i, s))
    out = []
    for i, text in sorted(rows):
        raw = text.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if first[raw[s : s + 100]] < (i, s):
                gone[s : s + 100] = b"\1" * 100
        kept = bytes(x for x, y in zip(raw, gone) if not y)
        spans = sum(1 for j in range(len(raw)) if gone[j] and not (j and gone[j - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=120):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 7))) for _ in range(2000)]
    phrase = lambda a, b: " ".join(r.choice(words) for _ in range(r.randint(a, b)))
    common = [phrase(10, 80) for _ in range(8)]
    rows = []
    for i in range(n):
        text = " ".join(r.choice(common) if r.random() < 0.3 else phrase(1, 30) for _ in range(r.randint(0, 8)))
        kind = r.random()
        if kind < 0.2 and rows:
            text = r.choice(rows)[1]
        elif kind < 0.4 and rows:
            changed = r.choice(rows)[1].split()
            for _ in range(min(2, len(changed))):
                changed[r.randrange(len(changed))] = r.choice(words)
            text = " ".join(changed)
        elif kind < 0.45:
            text = r.choice(["a", "ab ", "xyz"]) * r.randint(0, 200)
        rows.append((3 * i, text))
    return rows


def batches(rows, size):
    for k in range(0, len(rows), size):
        part = rows[k : k + size]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part])], names=["id", "text"])


def local_runs(rows, size):
    """The stages in one process, with texts dealt to tasks of ``size`` rows."""
    found = [b for part in batches(rows, size) for b in S.first_buckets(iter([part]))]
    settled = pa.concat_tables([pa.Table.from_batches([b]) for b in S.settle_segments(iter(found))]).to_pylist()
    mask = (1 << S.KIND) - 1
    runs, asked = {}, {}
    for x in settled:
        if x["at"] >> S.KIND == S.REPEAT:
            runs.setdefault(x["doc"], []).append(x["at"] & mask)
        else:
            asked.setdefault(x["doc"], []).append({"a": x["a"], "at": x["at"]})
    wanted = [(i, t) for i, t in rows if i in asked]
    kind = pa.list_(pa.struct([("a", pa.int64()), ("at", pa.int64())]))
    later = []
    for k in range(0, len(wanted), size):
        part = wanted[k : k + size]
        batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part]), pa.array([asked[x[0]] for x in part], kind)], names=["id", "text", "asked"])
        later += list(S.last_buckets(iter([batch])))
    for b in S.settle_strings(iter(later)):
        for x in b.to_pylist():
            runs.setdefault(x["doc"], []).append(x["at"])
    return runs


@pytest.mark.parametrize("seed,wide_here,wide_all,stretch", [(1, 64, 4096, 10**6), (2, 1, 4096, 900), (3, 64, 1, 500), (4, 2, 3, 300)])
def test_stages_with_wide_buckets_and_short_stretches(monkeypatch, seed, wide_here, wide_all, stretch):
    monkeypatch.setattr(S, "WIDE_HERE", wide_here)
    monkeypatch.setattr(S, "WIDE_ALL", wide_all)
    monkeypatch.setattr(S, "STRINGS", 50)
    monkeypatch.setattr(S.stretches, "__defaults__", (stretch,))
    rows = corpus(seed)
    runs = local_runs(rows, 17)
    got = []
    for i, text in rows:
        raw, end, kept = text.encode(), 0, []
        spans = S.spans_of(runs.get(i))
        for a, b in spans:
            kept.append(raw[end:a])
            end = b
        rest = b"".join([*kept, raw[end:]])
        got.append((i, len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()))
    assert got == brute(rows)


def test_a_bucket_beyond_what_a_task_holds(monkeypatch):
    monkeypatch.setattr(S, "HELD", 40)
    monkeypatch.setattr(S, "GROUP", 1)
    monkeypatch.setattr(S, "WIDE_ALL", 30)
    monkeypatch.setattr(S.stretches, "__defaults__", (400,))
    r = random.Random(3)
    common = "".join(r.choice("abcdefgh ") for _ in range(180))
    tail = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    rows = [(i, (tail(60) if i % 2 else "") + common[: r.randint(100, 180)] + tail(r.randint(0, 90))) for i in range(150)]

    def ordered(found, size=20):
        whole = pa.Table.from_batches(list(found))
        return whole.sort_by("a").to_batches(max_chunksize=size)

    segments, strings = S.settle_segments, S.settle_strings
    monkeypatch.setattr(S, "settle_segments", lambda x: segments(iter(ordered(x))))
    monkeypatch.setattr(S, "settle_strings", lambda x: strings(iter(ordered(x))))
    runs = local_runs(rows, 10)
    got = [(i, sum(b - a for a, b in S.spans_of(runs.get(i)))) for i, _ in rows]
    assert got == [(x[0], x[2]) for x in brute(rows)]


def test_bytes_decide_where_pointers_agree():
    raw, one = np.frombuffer(b"a" * 100 + b"b" * 100 + b"a" * 100, np.uint8), np.zeros(2, np.int64)
    for starts, want in (([0, 100], [False, False]), ([0, 200], [False, True])):
        assert S._repeats(one, one, np.arange(2), one, one, raw, np.array(starts))[1].tolist() == want


def test_on_spark_with_nulls_and_repeated_rows(spark):
    rows = corpus(7, 60)
    long = "word " * 60
    extra = [(1000, None), (1001, ""), (1002, "x" * 99), (1003, "x" * 100), (1003, "x" * 100), (None, long), (1004, long + "é")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows + extra], "doc_id long, text string, id int").repartition(5)
    got = sorted((tuple(r) for r in S.remove_repeats(df).drop("kept").collect()), key=repr)
    last = 2**63 - 1
    want = brute([(last if i is None else i, t or "") for i, t in rows + [x for x in extra if x[0] != 1003] + [extra[3]]])
    want = [(None if x[0] == last else x[0], *x[1:]) for x in want]
    want += [x for x in want if x[0] == 1003]
    assert got == sorted(want, key=repr)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(empty).count() == 0


def test_pointers_tell_strings_apart():
    raw = np.frombuffer(np.random.default_rng(1).bytes(5000), np.uint8)
    gram, b64 = S.refine(raw)
    assert len(np.unique(gram)) == len(gram) == 5000 - S.GRAM + 1
    assert len(np.unique(b64)) == len(b64) == 5000 - 63


def test_many_texts_without_id(spark):
    r = random.Random(5)
    line = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    texts = []
    for i in range(2000):
        own = line(150)
        texts.append(f"{line(130)}{own}{line(140)}" + (own + line(30) if i % 2 else ""))
    copies = [texts[1]] * 40  # repeated rows don't repeat each other
    df = spark.createDataFrame([(None, t) for t in texts + copies], "doc_id long, text string").repartition(5)
    got = sorted(tuple(x)[1:5] for x in S.remove_repeats(df).collect())
    want = [x[1:] for i, t in enumerate(texts) for x in brute([(i, t)])]
    assert got == sorted(want + [want[1]] * 40)


def test_lists_are_bounded_by_their_own_text(spark):
    r = random.Random(6)
    own = "".join(r.choice("abcdefgh ") for _ in range(150))
    tail = lambda: "".join(r.choice("abcdefgh ") for _ in range(150))
    df = spark.createDataFrame([(None, tail() + own + tail()) for _ in range(300)], "doc_id long, text string")
    docs = df.selectExpr("coalesce(doc_id, 9223372036854775807) AS id", "text").repartition(5)
    _, runs = S.repeated_runs(docs)
    assert runs.groupBy("doc", "h").count().agg({"count": "max"}).first()[0] < 10
    assert sum(x["n_removed"] > 0 for x in S.remove_repeats(df).collect()) == 299
