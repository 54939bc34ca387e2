"""Periodic runs against every stretch and every period, by brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from episodica.llm import runs as R

DATA = "/root/testdata/sf0.001"


def brute_runs(words, min_words=6, periods=4):
    n, found = len(words), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_words, periods * q):
                part = words[i : i + length]
                if all(any(part[k] != part[k + d] for k in range(length - d)) for d in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda x: (x[0], x[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if found else (None,) * 3
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def made(r):
    """Words of a small alphabet, with periodic stretches that overlap and nest."""
    out = []
    while len(out) < r.randint(1, 90):
        base = [r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(1, 5))]
        out += base * r.randint(1, 7) + base[: r.randint(0, len(base))]
        if r.random() < 0.2:
            out = out * r.randint(1, 5)
    return out[:300]


@pytest.mark.parametrize("min_words,periods", [(6, 4), (1, 3), (10, 4), (2, 5)])
def test_every_run(min_words, periods):
    r = random.Random(min_words)
    texts = [made(r) for _ in range(150)] + [[], ["a"], ["a"] * 6, ["a"] * 5, ["a", "b"] * 4]
    word = np.array([ord(w) for t in texts for w in t], np.int64)
    doc = np.repeat(np.arange(len(texts)), [*map(len, texts)])
    begins = np.r_[0, np.cumsum([*map(len, texts)])]
    got = [[] for _ in texts]
    for s, length, q in zip(*R.find_runs(word, doc, min_words, periods), strict=True):
        got[doc[s]].append((int(s - begins[doc[s]]), int(length), int(q)))
    assert got == [brute_runs(t, min_words, periods) for t in texts]


def test_blocks_of_an_ordered_set_are_split(monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 3)
    test_every_run(6, 4)


def test_neighbours_of_united_sets():
    r = random.Random(5)
    for _ in range(300):
        a, b = set(r.sample(range(60), r.randint(1, 30))), set(r.sample(range(60), r.randint(1, 30)))
        b = (b - a) or {61}
        big = [sorted(a)[i : i + 4] for i in range(0, len(a), 4)]
        pairs = set(R._unite(big, [sorted(b)]))
        both = sorted(a | b)
        assert [x for block in big for x in block] == both
        assert pairs == {(x, y) for x, y in zip(both, both[1:]) if (x in a) != (y in a)}


def test_long_texts_of_few_words_take_seconds():
    began = time.perf_counter()
    for word in (np.zeros(200_000, np.int64), np.arange(200_000) % 7, np.arange(200_000) % 40_000):
        start, length, period = R.find_runs(word, np.zeros(200_000, np.int64))
        assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [200_000], [int(word.max()) + 1])
    assert time.perf_counter() - began < 60


def test_the_query_on_spark(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    got = {r[0]: tuple(r) for r in R.op13_periodic_runs(spark, DATA).collect()}
    assert len(got) == len(rows)
    texts = {i: t for i, t in rows}
    short = [i for i in texts if len(texts[i] or "") < 4000]
    assert len(short) > 100 and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in short) > 5
    for i in short:
        assert got[i] == brute_row(i, texts[i])


def test_odd_rows(spark, tmp_path):
    r = random.Random(2)
    tenth = [i for i in range(-50, 400) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = [None, "", " \n\t", "a", "x " * 9, "é  é   é \v\f\ré \n" * 3, "one\x1ctwo " * 7, *(" ".join(made(r)) for _ in range(12))]
    rows = [(i, t) for t in texts for i in (None, 1, 1, r.choice(tenth), r.choice(tenth))]
    df = spark.createDataFrame([(a, b, "x", 3) for a, b in rows], "doc_id long, text string, runs string, n_words int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(x) for x in R.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((brute_row(*x) for x in rows), key=repr)
    found = {(x["doc_id"], x["n_words"], x["collapsed"]) for x in R.periodic_runs(df).collect()}
    assert (1, 9, "x") in found and (None, 0, "") in found
    assert R.periodic_runs(df.filter("false")).collect() == []
