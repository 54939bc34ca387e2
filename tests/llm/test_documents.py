"""Quality, SimHash, decontamination, personal data and licenses against brute-force readings of their contracts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import xxhash

from episodica.llm import components as C
from episodica.llm import decontaminate as D
from episodica.llm import licenses as L
from episodica.llm import pii as I
from episodica.llm import quality as Q
from episodica.llm import simhash as H

SPACE = r"[^\x20\x09-\x0D]+"
DATA = "/root/testdata/sf0.001"


def texts(spark, n=200):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(n).collect()]


def odd_rows():
    r = random.Random(1)
    made = [r.choice(" \n").join(r.choice("abé") for _ in range(r.randint(1, 80))) for _ in range(120)]
    return [None, "", "  \n ", "a", "a a a a a a", "\x1ca b\x1fa b", *made]


# Quality rules


def brute_quality(text, rules):
    words = re.findall(SPACE, text or "")
    n = len(words)

    def covered(size):
        count = Counter(tuple(words[j : j + size]) for j in range(n - size + 1))
        mask = [0] * n
        for j in range(n - size + 1):
            if count[tuple(words[j : j + size])] > 1:
                mask[j : j + size] = [1] * size
        return sum(mask)

    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    longest = 0
    while longest < n and len({tuple(words[j : j + longest + 1]) for j in range(n - longest)}) < n - longest:
        longest += 1
    repeated, spans = covered(3), covered(rules.repeat_words)
    failed = n < 50 or 100 * repeated > 50 * n
    kept = not failed and 100 * spans <= rules.max_covered_percent * n and longest <= rules.max_repeat_words
    return [n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, repeated, failed, kept, spans, longest]


def test_quality(spark):
    rows = [t for _, t in texts(spark) if len(t) < 5000] + odd_rows()
    for rules in (Q.Rules(), Q.Rules(repeat_words=2, max_covered_percent=10, max_repeat_words=4)):
        got = [[v.item() for v in r] for r in zip(*Q.measure([x and x.encode() for x in rows], rules), strict=True)]
        assert got == [brute_quality(t, rules) for t in rows]


def test_quality_on_spark(spark):
    clean = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, clean, 7), (2, "a b c " * 40, 7), (3, None, 7), (None, clean, 7), (1, clean, 7)], "doc_id long, text string, n_words int")
    got = sorted(((r["doc_id"] or 0, r["kept"], r["n_words"]) for r in Q.repetition(df).collect()))
    assert got == [(0, True, 80), (1, True, 80), (1, True, 80), (2, False, 120), (3, False, 0)]
    kept = Q.keep_good(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1]
    assert Q.repetition(df.limit(0)).count() == 0


# SimHash


def brute_print(text):
    words = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_every_near_pair_shares_an_anchor():
    r = random.Random(2)
    x = np.array([r.getrandbits(64) for _ in range(300)], np.uint64)
    for d in range(4):
        y = np.array([int(v) ^ sum(1 << b for b in r.sample(range(64), d)) for v in x], np.uint64)
        a, b = H._anchors(x), H._anchors(y)
        keys = lambda found, i: set(found[1][found[0] == i].tolist())
        for i in range(len(x)):
            assert keys(a, i) & keys(b, i)
            assert len(keys(a, i)) <= 32


def _united(fp, node):
    label = {n: n for n in node}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in ((a, b) for a in range(len(fp)) for b in range(a) if (int(fp[a]) ^ int(fp[b])).bit_count() <= 3):
        x, y = find(node[a]), find(node[b])
        label[max(x, y)] = min(x, y)
    return {n: find(n) for n in node}


def test_groups_give_stars():
    r = random.Random(3)
    base = r.getrandbits(64)
    fp = np.array([base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for _ in range(60)], np.uint64)
    node = np.array(r.sample(range(1000), 60))
    up, down = H._compare(np.zeros(60, np.int64), fp, node, 3)
    assert {(int(a), int(b)) for a, b in zip(up, down)} == {(root, i) for i, root in _united(fp, node.tolist()).items() if root != i}


def test_hot_anchors_are_dealt_anew(spark, monkeypatch):
    r = random.Random(8)
    base = r.getrandbits(64)
    fp = sorted({base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 9))) for _ in range(300)} | {r.getrandbits(64) for _ in range(50)})
    node = r.sample(range(10_000), len(fp))
    rows = [(f - (1 << 64) if f >> 63 else f, n) for f, n in zip(fp, node)]
    want = _united(fp, node)
    for hot in (3, 40, 4096):
        monkeypatch.setattr(H, "HOT", hot)
        got = {r["fp"]: r["c"] for r in H._classes(spark.createDataFrame(rows, "fp long, node long")).collect()}
        assert got == {f: want[n] for f, n in rows}


def test_an_anchor_of_a_hundred_thousand(spark):
    r = np.random.default_rng(5)
    upper = np.unique(r.integers(0, 1 << 32, 100_000, dtype=np.uint64))
    fp = (upper << np.uint64(32)).view(np.int64)  # the lower block is the same in all
    df = spark.createDataFrame(pd.DataFrame({"fp": fp, "node": np.arange(len(fp))}))
    roots = {r["fp"]: r["c"] for r in H._classes(df).collect()}
    assert len(roots) == len(fp)
    for i in range(400):
        linked = np.flatnonzero(np.bitwise_count(upper ^ upper[i]) <= 3)
        assert len({roots[int(fp[j])] for j in linked}) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 300), (300, 250)]
    got = {r["node"]: r["root"] for r in C.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100, 300: 200, 250: 200}
    assert C.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_on_spark(spark):
    rows = texts(spark) + [(10_000 + i, t) for i, t in enumerate(odd_rows())]
    df = spark.createDataFrame([*rows, rows[0], (None, "one two three")], "doc_id long, text string")
    fp = {i: brute_print(t) for i, t in rows}
    ids = sorted(fp)
    label = {i: i for i in ids}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                label[max(find(a), find(b))] = min(find(a), find(b))
    got = H.near_duplicates(df).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and int(r["fingerprint"], 16) == brute_print("one two three")
        else:
            assert (r["fingerprint"], r["component_id"]) == (f"{fp[r['doc_id']]:016x}", find(r["doc_id"]))
    kept = sorted(r["doc_id"] for r in H.keep_one(df.filter("doc_id IS NOT NULL")).collect())
    assert kept == sorted([i for i in ids if find(i) == i] + [rows[0][0]])
    assert H.near_duplicates(df.limit(0)).count() == 0


def test_keep_one_of_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(None, text, "a"), (None, text, "b"), (5, text, "c"), (5, text, "d"), (7, other, "e"), (7, text, "f"), (None, None, "g"), (None, "", "h"), (None, other + " x", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    kept = H.keep_one(df, repeated=False)
    assert kept.columns == df.columns
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sum(t == text for _, t in found) == 1 and (5, text) in found and (7, other) in found and sum(not t for _, t in found) == 1
    assert H.keep_one(df.limit(0)).count() == 0 and H.keep_one(df.limit(0), repeated=False).count() == 0
    assert sum(r["text"] == text for r in H.keep_one(df).collect()) == 2


# Decontamination


def test_search_finds_all_and_only_those_above(spark):
    items = [(r[0], D.words_of(r[1].encode()), D.answer_at(r[1])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").collect()]
    df = Counter(w for _, ws, _ in items for w in set(ws))
    mean = sum(len(ws) for _, ws, _ in items) / len(items)
    index = D.Index(items).build(df, len(items), mean)

    def weights(ws):
        c = Counter(ws)
        w = {t: math.log1p((len(items) - df[t] + 0.5) / (df[t] + 0.5)) * k * (D.K1 + 1) / (k + D.K1 * (1 - D.B + D.B * len(ws) / mean)) for t, k in c.items()}
        return {t: x / sum(w.values()) for t, x in w.items()}

    each = [weights(ws) for _, ws, _ in items]
    r = random.Random(1)
    passages = [{w for w in D.words_of(t.encode())[:120] if w in index.terms} for _, t in texts(spark, 60)]
    for _ in range(100):
        ws = items[r.randrange(len(items))][1]
        passages.append(set(r.sample(ws, int(len(ws) * r.random()))) | set(r.choice(passages[:40])))
    row = np.concatenate([np.full(len(p), i) for i, p in enumerate(passages)])
    term = np.concatenate([np.array([index.terms[w] for w in p], np.int64) for p in passages])
    for least in (0.2, 0.5, 0.8):
        got = {(a, b): s for a, b, s in zip(*(x.tolist() for x in D.search(index, row, term, least)))}
        want = {(i, k): s for i, p in enumerate(passages) for k, w in enumerate(each) if (s := sum(x for t, x in w.items() if t in p)) >= least}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_leaks(spark):
    items = [(1, "what is the colour of the sky on mars at noon. it is butterscotch with dust in it"), (2, "name seven rivers of the north"), (3, None), (None, "an item without an id that is long enough")]
    long = " ".join(f"filler{i}" for i in range(500))
    docs = [(10, f"{long} {items[0][1].upper()} {long}"), (11, long), (12, f"{long}\n{items[1][1]}"), (13, None), (14, ""), (None, items[0][1]), (15, "the colour of the sky"), (16, items[0][1] + " " + items[1][1])]
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for rules in (D.Leak(), D.Leak(shard_bytes=1)):
        got = sorted(((r["doc_id"] or -1, r["item_id"]) for r in D.leaks(frame, bench, rules=rules).collect()))
        assert got == [(-1, 1), (10, 1), (12, 2), (16, 1), (16, 2)]
        assert sorted(r["doc_id"] for r in D.drop_leaks(frame, bench, rules=rules).collect()) == [11, 13, 14, 15]
    assert D.leaks(frame, bench.limit(0)).count() == 0 and D.leaks(frame.limit(0), bench).count() == 0
    assert D.drop_leaks(frame, bench.limit(0)).count() == len(docs)


def test_items_of_all_lengths_without_ids_and_in_part(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    items = [(i if i % 3 else None, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 6, 12, 40, 41, 300, 2000])]
    groups = D.similar_lengths([(i, t.encode().split(), 0) for i, t in items])
    assert sum(map(len, groups)) == len(items) and all(len(g[0][1]) <= 8 * len(g[-1][1]) for g in groups) and len(groups) > 1
    docs = [(i, " ".join(word() for _ in range(50)) + " " + t + " " + " ".join(word() for _ in range(70))) for i, (_, t) in enumerate(items)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert {(i, items[i][0]) for i in range(len(items))} <= got
    kept = D.drop_leaks(spark.createDataFrame([*docs, (99, " ".join(word() for _ in range(90)))], "doc_id long, text string"), bench.filter("length(text) > 20"))
    assert {0, 1, 99} <= {x["doc_id"] for x in kept.collect()} <= {0, 1, 2, 99}


def brute_overlap(words, item, rules):
    """The best window's shares, over all windows of the item's words and a few more."""
    best = (0.0, 0.0, 0.0)
    for i in range(len(words)):
        best = max(best, D._overlap(words[i : i + len(item[1]) + 10], item, rules.shingle))
    return best


def test_partial_copies_are_found(spark):
    r = random.Random(7)
    rules = D.Leak()
    rows = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").collect()
    items = {x["item_id"]: (x["item_id"], D.words_of(x["text"].encode()), D.answer_at(x["text"])) for x in rows}
    fill = [w for _, t in texts(spark, 40) for w in t.split()]
    docs, want = [], set()
    for n in range(300):
        item = items[r.choice(sorted(items))]
        copy = list(item[1])
        for _ in range(r.randint(0, 3)):
            copy[r.randrange(len(copy))] = r.choice(fill).encode()
        if r.random() < 0.3:
            copy = copy[: int(len(copy) * r.uniform(0.8, 1))]
        at = r.randrange(len(fill) - 300)
        words = [w.lower().encode() for w in fill[at : at + r.randint(0, 150)]] + copy + [w.lower().encode() for w in fill[at + 150 : at + 150 + r.randint(0, 150)]]
        docs.append((n, b" ".join(words).decode()))
        whole, question, answer = brute_overlap(D.words_of(docs[-1][1].encode()), item, rules)
        if whole >= rules.overlap and question >= rules.question and answer >= rules.answer:
            want.add((n, item[0]))
    got = {(x["doc_id"], x["item_id"]) for x in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows)).collect()}
    assert len(want) > 100 and len(want & got) >= 0.9 * len(want)


EDITS = {
    "plain": lambda t: t,
    "quoted": lambda t: f"\u201c{t}\u201d",
    "stripped": lambda t: re.sub(r"[^\w\s]", "", t),
    "commas": lambda t: " ".join(w + "," * (i % 4 == 3) for i, w in enumerate(t.split())),
    "emphasised": lambda t: " ".join(f"*{w}*" for w in t.split()),
    "upper": lambda t: t.upper(),
    "other marks": lambda t: re.sub(r"[.,?!]", "\u2026", t).replace("'", ""),
    "lines": lambda t: "\n- ".join(t.split()),
}


def test_copies_with_other_punctuation_are_found(spark):
    """Every item under every edit, inside other text: nine of ten are found and dropped, and no clean text is."""
    rows = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").collect()
    items = spark.createDataFrame(rows)
    fill = [w for _, t in texts(spark, 40) for w in t.split()]
    r = random.Random(8)
    around = lambda: " ".join(fill[(at := r.randrange(len(fill) - 200)) : at + 120])
    for name, edit in EDITS.items():
        docs = [(x["item_id"], f"{around()} {edit(x['text'])} {around()}") for x in rows]
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = {(x["doc_id"], x["item_id"]) for x in D.leaks(df, items).collect()}
        assert sum((x["item_id"],) * 2 in got for x in rows) >= 0.9 * len(rows), name
        assert D.drop_leaks(df, items).count() <= 0.1 * len(rows), name


def test_words_of_odd_items(spark):
    r = random.Random(3)
    rows = ["".join(r.choice("ab\u00e9A0 .,-_\x00\x1f\t\n\u00a0\u00ab\u00bf\u00c0\u2014\u2019\u207f\u2080\u3002\u3042\U0001f600~{\u0130\u03a3\u00c9") for _ in range(30)) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "item_id long, text string")
    found = [index for shard in D.indexes(df, D.Leak()) for index in shard]
    assert {i for index in found for i, _, _ in index.items} == {i for i, t in enumerate(rows) if D.words_of(t.encode())}


def test_many_contaminated_passages_need_little_memory():
    r = np.random.default_rng(1)
    vocabulary = np.array([f"w{i}".encode() for i in range(3000)])
    items = [(i, list(vocabulary[(3000 * r.random(45) ** 3).astype(int)]), 30) for i in range(20_000)]
    df = Counter(w for _, ws, _ in items for w in set(ws))
    index = D.Index(items).build(df, len(items), 45.0)
    texts_ = [b" ".join(items[i][1]) for i in range(0, 20_000, 250)]
    tracemalloc.start()
    found = D.leaks_in([index], texts_, D.Leak())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(d, i) for d, i, *_ in found} >= {(n, i) for n, i in enumerate(range(0, 20_000, 250))} and peak < 200e6


# Personal data


def brute_spans(text):
    luhn = lambda d: sum((int(c) * (1 + i % 2) - 1) % 9 + 1 if int(c) * (1 + i % 2) else 0 for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda t: re.sub("[^0-9]", "", t)
    found = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    found["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    found["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return found


def test_base_spans():
    r = random.Random(2)
    parts = ["a", "1", "23", "@", ".", "-", "+", " ", "(", ")", "255", "256", "é", "4111111111111111", "b.c", "٣", "\n"]
    for _ in range(10_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert I.base_spans(text) == brute_spans(text), text


def test_personal_data(spark):
    rows = [(i, f"please call +1 (743) 555-{1000 + i} now") for i in range(20)]
    rows += [(100, "please call 743-555-9999 now"), (101, "see 743-555-9998 there"), (102, None), (103, ""), (None, "mail a@b.co"), (104, "clean"), (104, "clean"), (105, "x +1 (743) 555-4444 4111111111111111 y")]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    got = I.personal_data(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r["doc_id"]) or ""
        base = ",".join(f"{k}:{a}:{b}" for k, xs in brute_spans(text).items() for a, b in xs)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["spans"] == {100: "phone:12:24", 105: "phone:2:19"}.get(r["doc_id"], base)
    new = {r["doc_id"]: (r["text"], r["n_chars"]) for r in I.redact(df).collect()}
    assert new[100] == ("please call [PHONE] now", 23) and new[0] == ("please call [PHONE] now", 23) and new[None] == ("mail [EMAIL]", 12)
    assert new[105][0] == "x [PHONE] 4111111111111111 y"  # five cards of that make would make it known
    assert new[101][0] == "see 743-555-9998 there" and new[102][0] is None and new[103] == ("", 0)
    assert I.personal_data(df.limit(0)).count() == 0 and I.redact(df.limit(0)).count() == 0


def test_unseen_identifiers_by_context(spark):
    """Held out: keys without a known form, bank and passport numbers, in contexts that seeds of known form teach; and the same forms
    in other contexts, which aren't to be found."""
    r = random.Random(9)
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    odd = lambda: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(9)) + "7"
    fill = lambda n: " ".join(r.choice("lorem ipsum dolor sit amet vel quo ut".split()) for _ in range(n))

    def iban():
        body = "".join(r.choice("0123456789") for _ in range(18))
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    makes = {
        "key": (lambda x: f'{fill(3)} token = "{x}" {fill(3)}', lambda: hexa(40), odd),
        "assigned": (lambda x: f"{fill(3)} api_key={x} {fill(3)}", lambda: hexa(32), odd),
        "bank": (lambda x: f"{fill(3)} pay to account {x} by {fill(3)}", iban, lambda: "".join(r.choice("0123456789") for _ in range(14))),
        "passport": (lambda x: f"{fill(2)} holder of passport no {x}, {fill(3)}", lambda: "C" + "".join(r.choice("0123456789") for _ in range(8)), lambda: "X" + odd()),
    }
    rows, hidden = [], {}
    for make, (line, seed, other) in makes.items():
        rows += [line(seed()) for _ in range(150)]
        for _ in range(20):
            hidden[len(rows)] = other()
            rows.append(line(hidden[len(rows)]))
    clean = range(len(rows), len(rows) + 80)
    rows += [f"{fill(3)} version {odd()} of {fill(3)}" for _ in clean]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(rows)], "doc_id long, text string, n_chars long")
    got = {x["doc_id"]: [tuple(y.split(":")) for y in x["spans"].split(",") if y] for x in I.personal_data(df).collect()}
    caught = [i for i, x in hidden.items() if any(k == "id" and rows[i][int(a) : int(b)] == x for k, a, b in got[i])]
    assert len(caught) >= 0.9 * len(hidden) and not any(got[i] for i in clean)
    new = {x["doc_id"]: x["text"] for x in I.redact(df).collect()}
    assert all(hidden[i] not in new[i] and "[ID]" in new[i] for i in caught) and all(new[i] == rows[i] for i in clean)


def test_no_token_is_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.filter("text RLIKE 'token = \"[0-9a-f]{40}\"'")
    assert held.count() > 0 and I.redact(docs).filter("text RLIKE 'token = \"[0-9a-f]{40}'").count() == 0


def test_long_neighbours_are_whole_and_linear():
    a, b = "x" * 500 + "a", "x" * 500 + "b"
    one, two = (I._context(f"q {w} 5551234", 503 + 1, 511) for w in (a, b))
    assert one[0] != two[0] and len(one[0]) == 64
    began = time.perf_counter()
    I.occurrences("1234567 " * 50_000)
    assert time.perf_counter() - began < 20


# Licenses


def test_licenses(spark):
    assert L.Bands().collision(L.Bands().least()) > 0.9999
    filler = " ".join(f"word{i}" for i in range(300))
    changed = L.TEMPLATES["mit"].replace("free of charge", "without a fee", 1)
    rows = [(i, f"{filler}. {t}\n{filler}") for i, t in enumerate(L.TEMPLATES.values())] + [(50, f"{filler} {changed}"), (51, filler), (52, None), (53, "MIT License"), (None, "Released under the MIT License")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    sets = {k: set(L.shingles(L.words_of(t.encode()))) for k, t in L.TEMPLATES.items()}
    want = set()
    for i, t in rows:
        have = set(L.shingles(L.words_of((t or "").encode())))
        want |= {(i, k) for k, s in sets.items() if len(s & have) >= 0.8 * len(s)}
    assert {(r["doc_id"], r["license"]) for r in L.license_notices(df).collect()} == want
    assert (50, "mit") in want and (None, "mit-line") in want
    assert L.license_notices(df.limit(0)).count() == 0


def test_licenses_at_every_offset():
    found = L.Templates(L.TEMPLATES, L.Bands())
    words = [w.decode() for w in L.words_of(L.TEMPLATES["mit"].encode())]
    for at in (14, 40, 66):  # three words changed: 66 of 81 shingles stay
        words[at] = f"changed{at}"
    put_in = [w.decode() for w in L.words_of(L.TEMPLATES["mit"].encode())]
    put_in[40:40] = [f"holder{i}" for i in range(60)]
    for offset in range(25):
        filler = [f"word{i}" for i in range(offset)]
        share, _, _ = found.scan(" ".join([*filler, *words, *filler]).encode())["mit"]
        assert share == 66 / 81
        share, _, _ = found.scan(" ".join([*filler, *put_in, *filler]).encode())["mit"]
        assert share == 77 / 81


def test_short_templates_by_their_own_length():
    found = L.Templates({"two": "MIT License", "one": "Unlicense"}, L.Bands())
    assert found.scan(b"this is under the MIT License as a whole") == {"two": (1.0, 2, 4)}
    assert set(found.scan(b"unlicense or the mit license")) == {"one", "two"}
    assert found.scan(b"mit the license of many words") == {}


def test_one_row_of_each_group_stays(spark):
    long = lambda k: " ".join(f"{k}word{i}" for i in range(200))
    rows = [(1, long("a")), (5, long("a")), (5, long("b")), (7, long("c")), (7, long("c")), (8, long("c") + " "), (None, long("d")), (None, long("d")), (None, long("c")), (None, long("e"))]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int").repartition(4)
    got = sorted(((r["doc_id"], r["text"][0]) for r in H.keep_one(df).collect()), key=repr)
    assert H.keep_one(df).columns == df.columns
    assert got == sorted([(1, "a"), (5, "b"), (7, "c"), (7, "c"), (None, "d"), (None, "e")], key=repr)
    assert H.keep_one(df.limit(0)).count() == 0


def test_identifiers_in_several_words(spark):
    rows = [(i, f"please call +1 (743) 555-{1000 + i} now") for i in range(20)] + [(50 + i, f"my address is user{i}@host.org thanks") for i in range(20)]
    new = ["030 1234 5678", "555 123 4567", "(555) 123-4567", "0049 30 1234 5678", "030 / 123 45 67"]
    rows += [(100 + i, f"please call {x} now") for i, x in enumerate(new)]
    mails = ["name (at) host (dot) org", "some.name [at] host.org", "name at host dot org", "name @ host.org"]
    rows += [(200 + i, f"my address is {x} thanks") for i, x in enumerate(mails)]
    rows += [(300, "see 030 1234 9999 there"), (301, "look at host dot org there")]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["spans"], r["n_found"]) for r in I.personal_data(df).collect()}
    out = {r["doc_id"]: r["text"] for r in I.redact(df).collect()}
    for i, x in enumerate(new):
        assert got[100 + i] == (f"phone:12:{12 + len(x)}", 1) and out[100 + i] == "please call [PHONE] now"
    for i, x in enumerate(mails):
        assert got[200 + i] == (f"email:14:{14 + len(x)}", 1) and out[200 + i] == "my address is [EMAIL] thanks"
    assert got[300] == ("", 0) and got[301] == ("", 0)


def test_rounds_go_on_while_they_find(spark):
    name = lambda k, j: "abcdefz"[k] + chr(97 + j // 6) + chr(97 + j % 6)  # noqa: E731  no digits, so no two are of one make
    rows = [("phone", True, name(6, i), "w0", "x w0", "r") for i in range(30)]
    for k in range(6):  # each round trusts the next word before
        rows += [("phone", False, name(k, j), f"w{k + d}", f"x w{k + d}", "r") for j in range(30) for d in (0, 1)]
    occ = spark.createDataFrame(rows, "kind string, seed boolean, instance string, left1 string, left2 string, right1 string")
    found = {r["instance"] for r in I.discover(occ, I.Bootstrap(precision=0.3, confidence=0.3)).collect()}
    assert found == {name(k, j) for k in range(6) for j in range(30)}


def test_a_megabyte_of_notices_takes_seconds():
    found = L.Templates(L.TEMPLATES, L.Bands())
    one = " ".join(L.TEMPLATES[k] for k in ("mit-whole", "bsd-3-clause", "gpl-3.0")).encode() + b" "
    began = time.process_time()
    got = found.scan(one * (1_000_000 // len(one)))
    assert {"mit-whole", "mit", "bsd-3-clause", "bsd", "gpl-3.0"} <= set(got) and time.process_time() - began < 30


def test_windows_alone_retrieve():
    """The bands find each template inside other text, before any exact count."""
    r = random.Random(3)
    found = L.Templates(L.TEMPLATES, L.Bands(containment=0.0))
    for name, text in L.TEMPLATES.items():
        filler = [f"word{i}" for i in range(r.randint(0, 40))]
        assert name in found.scan(" ".join([*filler, text, *filler]).encode())


def test_least_between_is_the_least():
    rng = np.random.default_rng(5)
    for n in (1, 31, 32, 33, 1000):
        values, a, b = rng.integers(0, 50, n), rng.integers(0, n, 300), rng.integers(0, n, 300)
        first, last = np.minimum(a, b), np.maximum(a, b)
        assert Q._least_between(values, first, last).tolist() == [int(values[x : y + 1].min()) for x, y in zip(first, last, strict=True)]


def test_repeats_take_memory_by_words_whatever_their_length():
    once = np.random.default_rng(6).integers(0, 5000, 50_000)
    words = np.r_[once, once]
    tracemalloc.start()
    longest = Q.suffix_repeats(words, np.zeros(len(words), np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert longest.max() == 50_000 and longest[0] == 50_000 and longest[49_999] == 1
    assert peak < 220 * len(words)


def test_repeats_of_one_word():
    assert Q.suffix_repeats(np.zeros(1000, np.int64), np.repeat([0, 1], 500)).tolist() == [499, *range(499, 0, -1)] * 2  # of neighbours the longer shares all
