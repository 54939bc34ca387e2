"""Ids, packing and token files against the tokenizers library alone."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from episodica.llm import packing as P
from episodica.llm import tokenfiles as TF
from episodica.llm.tokens import WordCoder, ids_of

TEXTS = [None, "", " ", "a", "one two  three\n\nfour. Five,six ...", "x\x00y", "naïve İstanbul ﬁx ²³ 日本 語", "<|endoftext|> don't", "word " * 3000, "same text here", "same text here"]


def plain(file):
    t = Tokenizer.from_file(public_tokenizers.path(file))  # untouched, as the contract says
    return lambda x: t.encode(x or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("file,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_coder_equals_whole_texts(file, spaced):
    r = random.Random(5)
    parts = [" ", "  ", "\n", "\t", " ", "　", "'s", "a", "bc", "É", "é", "İ", "Σ", "1", ".", ",", "...", "#$", "日本", "̈", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "\x00", "\r\n", "ß", '"', "_", "²"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(4000)] + TEXTS
    coder, want = WordCoder(public_tokenizers.path(file), spaced, keep=500), plain(file)
    for i in range(0, len(texts), 300):
        ids, bounds = ids_of(coder.encode(pa.array(texts[i : i + 300], pa.string())), 2)
        for j, text in enumerate(texts[i : i + 300]):
            assert ids[bounds[j] : bounds[j + 1]].tolist() == want(text), text


@pytest.mark.parametrize("file,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_added_tokens_anywhere(file, spaced):
    coder, want = WordCoder(public_tokenizers.path(file), spaced), plain(file)
    made = [x.replace("{}", t) for t in ("<|endoftext|>", "<|startoftext|>") for x in ("hello {} world", "{}", "{} a", "a {}", "a{}b", "one{}{}two", "a {}, b", "x\n{}\ny", "{}" * 3, "a.{}.")]
    ids, bounds = ids_of(coder.encode(pa.array(made)), 2)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [want(x) for x in made]


def test_fullest_is_the_best_sum():
    r = random.Random(1)
    for _ in range(200):
        counts = {r.randint(1, 12): r.randint(1, 3) for _ in range(4)}
        room = r.randint(0, 30)
        sums = {0}
        for k, n in counts.items():
            sums = {s + i * k for s in sums for i in range(n + 1)}
        got = P.fullest(counts, room)
        assert sum(got) == max(s for s in sums if s <= room)
        assert all(got.count(k) <= counts[k] for k in got)


def test_bins_use_up_the_histogram():
    histogram = {1024: 3, 700: 10, 300: 9, 24: 30, 1: 5}
    used = {}
    for lengths, times in P.minimum_bin_slack(histogram):
        assert sum(lengths) <= 1024
        for k in lengths:
            used[k] = used.get(k, 0) + times
    assert used == histogram and P.minimum_bin_slack({}) == []


def frame(spark):
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)] + [(None, "no id", 1), (3, "a", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)


def test_packing(spark):
    df, want = frame(spark), plain("byte_bpe_50k.json")
    rows = P.pack(df).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(TEXTS):
        ids = want(t)
        mine = sorted(got[i], key=lambda r: r["piece"])
        if i == 3:  # given twice
            mine = mine[::2]
        assert [r["piece"] for r in mine] == list(range(-(-len(ids) // 1024)))
        assert sum(r["length"] for r in mine) == len(ids) and all(r["length"] == 1024 for r in mine[1:])
        for r in mine:
            assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_files(spark, tmp_path):
    df, want = frame(spark), plain("word_bpe_49k.json")
    path = str(tmp_path / "tokens")
    TF.write_tokens(df, path)
    rows = sorted(TF.token_offsets(spark, path).collect(), key=lambda r: r["start"])
    order = [(None, "no id")] + [x for i, t in enumerate(TEXTS) for x in ([(i, t), (3, "a")] if i == 3 else [(i, t)])]
    start = 0
    for r, (i, t) in zip(rows, order, strict=True):
        ids = want(t)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), crc(ids))
        start += len(ids)
    some = TF.read_tokens(spark, path, ("doc_id", "ids"), 4, 6).collect()
    assert {r["doc_id"]: r["ids"] for r in some} == {i: want(TEXTS[i]) for i in (4, 5, 6)}
    for file in sorted((tmp_path / "tokens").glob("*.parquet")):
        footer = pq.ParquetFile(file).metadata
        for group in range(footer.num_row_groups):
            columns = {c.path_in_schema.split(".")[0]: c for c in (footer.row_group(group).column(i) for i in range(footer.num_columns))}
            assert "RLE_DICTIONARY" in columns["ids"].encodings or "PLAIN_DICTIONARY" in columns["ids"].encodings
            for name in ("doc_id", "start", "n_tokens"):
                assert "DELTA_BINARY_PACKED" in columns[name].encodings and columns[name].dictionary_page_offset is None
            assert all(c.has_offset_index for c in columns.values()) and columns["doc_id"].has_column_index
    empty = str(tmp_path / "empty")
    TF.write_tokens(spark.createDataFrame([], "doc_id long, text string"), empty)
    assert TF.token_offsets(spark, empty).count() == 0


def test_row_groups_and_selective_reads(spark, tmp_path):
    path = str(tmp_path / "small")
    df = spark.range(3000).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 20) AS text")
    TF.write_tokens(df.repartition(3), path, layout=TF.LAYOUT | {"parquet.block.size": "4096", "parquet.page.size": "1024", "parquet.page.row.count.limit": "50"})
    groups = sum(pq.ParquetFile(f).metadata.num_row_groups for f in (tmp_path / "small").glob("*.parquet"))
    assert groups > len(list((tmp_path / "small").glob("*.parquet")))
    plan = TF.read_tokens(spark, path, ("doc_id", "n_tokens"), 100, 102)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,100)" in text and "ids" not in text.split("ReadSchema")[1].split("\n")[0]
    assert [r["doc_id"] for r in plan.orderBy("doc_id").collect()] == [100, 101, 102]


def test_hot_and_null_ids_are_dealt_to_several_files(spark, tmp_path):
    path = str(tmp_path / "hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END AS doc_id", "'same words' AS text")
    TF.write_tokens(rows.repartition(4), path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(path).filter("doc_id IS NULL").select("_metadata.file_name").distinct().count() > 1
    found = TF.token_offsets(spark, path)
    assert found.count() == 6000 and found.select("start").distinct().count() == 6000
    ids = [r["doc_id"] for r in found.orderBy("start").collect()]
    assert [x if x is not None else -1 for x in ids] == sorted(x if x is not None else -1 for x in ids)


def test_few_bins_as_the_best_packing():
    r = random.Random(4)

    def best(sizes, room):
        full = (1 << len(sizes)) - 1
        at = {0: (1, 0)}
        for mask in range(full + 1):
            if mask in at:
                bins, used = at[mask]
                for i, x in enumerate(sizes):
                    if not mask >> i & 1:
                        new = (bins, used + x) if used + x <= room else (bins + 1, x)
                        key = mask | 1 << i
                        if key not in at or new < at[key]:
                            at[key] = new
        return at[full][0]

    more = 0
    for _ in range(60):
        sizes = [r.randint(1, 20) for _ in range(r.randint(1, 10))]
        histogram = {x: sizes.count(x) for x in sizes}
        got = sum(times for _, times in P.minimum_bin_slack(histogram, 20))
        assert got <= best(sizes, 20) + 1
        more += got - best(sizes, 20)
    assert more <= 6
