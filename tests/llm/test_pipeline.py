"""The pipeline, stage by stage, against brute force on a small table."""

from __future__ import annotations

import corpus_pipeline
from episodica.llm.decontaminate import Leak
from episodica.llm.pii import base_spans
from episodica.llm.quality import Rules
from tests.llm.test_documents import brute_print, brute_quality

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, left = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [r["text"].lower().split() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        if i < 4:
            assert docs.columns == columns, name
            got = {r["doc_id"]: r["text"] for r in docs.collect()}
        if i == 0:
            want = {k: t for k, t in left.items() if brute_quality(t, Rules())[6]}
        elif i == 1:
            fp = {k: brute_print(t) for k, t in left.items()}
            root = {k: k for k in fp}

            def find(k, root=root):
                while root[k] != k:
                    k = root[k]
                return k

            for a in sorted(fp):
                for b in fp:
                    if b < a and (fp[a] ^ fp[b]).bit_count() <= 3:
                        root[max(find(a), find(b))] = min(find(a), find(b))
            want = {k: t for k, t in left.items() if find(k) == k}
        elif i == 2:

            def leaks(text):
                words = text.lower().split()
                have = set(zip(*(words[i:] for i in range(5))))
                shingles = [list(zip(*(w[i:] for i in range(5)))) for w in items]
                return any(sum(x in have for x in s) >= Leak().overlap * len(s) for s in shingles)

            want = {k: t for k, t in left.items() if not leaks(t)}
        elif i == 3:
            assert got.keys() == left.keys()
            for k, t in left.items():
                spans = [t[a:b] for xs in base_spans(t).values() for a, b in xs]
                assert not any(s in got[k] for s in spans)
                assert spans or got[k] == t or "[" in got[k]
            want = got
        else:
            assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == left.keys()
            sums = docs.groupBy("sequence_id").sum("length").collect()
            assert max(r[1] for r in sums) <= 1024
            want = got
        assert got == want, name
        left = got


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, clashing column names and empty tables, stage by stage."""
    clean = " ".join(f"w{i}" for i in range(80))
    rows = [(1, clean, 9), (1, clean, 9), (None, clean, 9), (2, None, 9), (3, "", 9), (None, None, None), (4, f"{clean} mail me: a.b@example.com", 9), (5, "short", 9)]
    docs = spark.createDataFrame([(i, t, "en", "s", n, 0, 0) for i, t, n in rows], "doc_id long, text string, lang string, source string, n_chars long, occ int, anchor int")
    columns = docs.columns
    left, empty = [], docs.limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs, empty = stage(spark, docs, DATA), stage(spark, empty, DATA)
        assert docs.columns == empty.columns == columns and empty.count() == 0, name
        path = str(tmp_path / str(k))
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        left.append(sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr))
    assert left[0] == sorted([(1, clean), (1, clean), (None, clean), rows[6][:2]], key=repr)
    assert left[1] in ([(1, clean)], [(1, clean), rows[6][:2]]) and left[2] == left[1]
    assert all("@" not in t for _, t in left[3]) and len(left[3]) == len(left[2])
    name, pack = corpus_pipeline.STAGES[4]
    assert pack(spark, empty, DATA).count() == 0
    odd = spark.createDataFrame([(None, None), (None, ""), (7, "a"), (7, "a")], "doc_id long, text string")
    assert pack(spark, odd, DATA).count() == 4
    for stage, want in zip((f for _, f in corpus_pipeline.STAGES[1:4]), (2, 4, 4)):
        whole = odd.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source", "length(text) AS n_chars")
        assert stage(spark, whole, DATA).count() == want
