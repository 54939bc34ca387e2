"""Phrases against counts in dictionaries."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from episodica.llm import phrases as P

SCHEMA = "doc_id long, lang string, text string, words int, phrase string"


def brute(rows, min_count, longest=5, percent=100):
    f, total = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    candidates = {k: n for k, n in f.items() if n >= min_count and len(k[1]) > 1}
    inner = set()
    for (lang, w), n in candidates.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w) and 100 * n >= percent * f[lang, w[i:j]]:
                    inner.add((lang, w[i:j]))
    out = []
    for (lang, w), a in candidates.items():
        if (lang, w) not in inner:
            score, _, left, right = min((1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, left, right, total[lang], score))
    return sorted(out)


def made(seed, n=150):
    r = random.Random(seed)
    words = ["The", "the", "of", "é", "naïve", "a\x01", "a", "b\x02c", "Ünder", "日本", "x" * 50, "don't"]
    fixed = [" ".join(r.choice(words) for _ in range(r.randint(3, 9))) for _ in range(5)]
    rows = []
    for _ in range(n):
        parts = [r.choice(fixed) if r.random() < 0.4 else " ".join(r.choice(words) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 6))]
        rows.append((r.choice(["en", "en", "en", "fr", None, "und", ""]), r.choice([". ", "\n", " ", "\t ", ",;", " "]).join(parts)))
    return rows + [("en", None), (None, ""), ("de", " \t "), ("fr", ".,;"), ("en", "of the " * 3000)]


def frame(spark, rows):
    return spark.createDataFrame([(1, lang, text, 2, "x") for lang, text in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("min_count,longest,percent", [(3, 5, 100), (2, 5, 60), (20, 5, 100), (300, 5, 100), (4, 2, 100), (4, 3, 100)])
def test_all_phrases(spark, min_count, longest, percent):
    rows = made(min_count)
    got = sorted(tuple(r) for r in P.collocations(frame(spark, rows), min_count=min_count, longest=longest, percent=percent).collect())
    want = brute(rows, min_count, longest, percent)
    assert got == want and len(want) > (5 if min_count < 300 else 0)


def test_slices_ranges_and_a_crowded_filter(spark, monkeypatch):
    """Small slices; a filter in which most bits are set by chance; more ranges than phrases of some first words."""
    monkeypatch.setattr(P, "SLICE", 100)
    monkeypatch.setattr(P, "FILTER_BITS", 64)
    monkeypatch.setattr(P, "COUNTERS", 256)
    monkeypatch.setattr(P, "COUNTER_BLOCK", 64)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        rows = made(9)
        got = sorted(tuple(r) for r in P.collocations(frame(spark, rows), min_count=3).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows, 3)


def test_carried_beginnings(spark, monkeypatch):
    """Each range begins with what the beginnings of its first gram count."""
    rows = [("en", "a b c d e. a b c d f. a b c e. a b d. a c. b c d e f")] * 3
    monkeypatch.setattr(P, "_bounds", lambda grams, parts: [("en", ("a", "b", "c", "d", "e")), ("en", ("a", "b", "c", "d", "f")), ("en", ("a", "b", "d")), ("en", ("b", "c", "d")), ("en", ("e", "d", "c", "b"))])
    got = sorted(tuple(r) for r in P.collocations(frame(spark, rows), min_count=1).collect())
    assert got == brute(rows, 1)


def test_ranks(spark):
    rows = [("en", f"p{i:03}", 5, 10, 10, 1000, i // 7) for i in range(300)] + [("fr", "q", 5, 10, 10, 1000, 2**40)]
    got = P.top_phrases(spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long"), 40, salts=3)
    want = sorted(rows[:300], key=lambda r: (-r[6], -r[2], r[1]))[:40]
    assert [(r["rank"], r["phrase"]) for r in got.filter("lang = 'en'").orderBy("rank").collect()] == [(i + 1, w[1]) for i, w in enumerate(want)]
    assert got.filter("lang = 'fr'").count() == 1


def test_large_numbers_stay_exact(spark, monkeypatch):
    """1000 a n passes 64 bits."""
    n = 3 * 10**9
    grams = spark.createDataFrame([("en", ["a"], n), ("en", ["b"], n + 1), ("en", ["a", "b"], n - 7)], P.GRAM)
    totals = spark.createDataFrame([("en", 10**13 + 1)], "lang string, total long")
    monkeypatch.setattr(P, "frequent_grams", lambda *a: (grams, totals))
    assert [r["score"] for r in P.collocations(grams).collect()] == [1000 * (n - 7) * (10**13 + 1) // (n * (n + 1))]


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert P.top_phrases(P.collocations(none), 10).collect() == []
    assert P.collocations(frame(spark, [(None, None), ("en", " ")])).collect() == []


def test_against_sql(spark):
    import duckdb

    data = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in P.op11_phrase_streams(spark, data).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    assert got == sorted(con.execute(P.OP11_SQL).fetchall()) and len(got) > 50
