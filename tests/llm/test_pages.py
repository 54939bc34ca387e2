"""Page text and fixity, on held-out labelled pages, on the given pages, and on edge cases."""

from __future__ import annotations

import gzip
import hashlib
import html
import itertools
import random
import re
import time

import duckdb
import numpy as np
from pyspark.sql import functions as F

from episodica.llm import dom as D
from episodica.llm import html_text as H
from episodica.llm import warc as W
from episodica.llm.dom import parse
from episodica.llm.html_labels import labelled_page

DATA = "/root/testdata/sf0.001"


def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    parent, depth = np.array([-1, 0, 0, 1, 1, 2]), np.array([0, 1, 1, 2, 2, 2])
    edge = np.array([0, 1, 2, 3, 4, 5])
    unary, pair = rng.normal(size=(6, 2)), rng.normal(size=(6, 2, 2))
    total, node, joint = 0.0, np.zeros((6, 2)), np.zeros((6, 2, 2))
    for y in itertools.product((0, 1), repeat=6):
        p = np.exp(sum(unary[i, y[i]] for i in range(6)) + sum(pair[edge[i], y[parent[i]], y[i]] for i in range(1, 6)))
        total += p
        for i in range(6):
            node[i, y[i]] += p
            if i:
                joint[i, y[parent[i]], y[i]] += p
    got = H.sum_product(unary, pair, parent, depth, edge)
    assert np.allclose(got[0], node / total) and np.allclose(got[1][1:], joint[1:] / total)


def test_held_out_pages():
    weight, pair = H.fit()
    found = [parse(labelled_page(seed))[0] for seed in range(50_000, 50_150)]
    label = np.array([int(m[1]) if (m := re.search(r'data-y="([01])"', n.attributes)) else 1 for nodes in found for n in nodes])
    has = np.array([n.chars > 0 for nodes in found for n in nodes])
    got = H.content_marginals(found, weight, pair) >= 0.5
    assert (got == label)[has].mean() > 0.99


def test_given_pages(spark):
    got = {r["page_id"]: r for r in H.op1_tree_model_text(spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        body = r["html"][r["html"].find("<article>") + 9 : r["html"].find("</article>")]
        blocks = (" ".join(html.unescape(x).split()) for x in re.split(r"(?:</?p>|</?h1>|<br>|</?b>)+", body))
        assert got[r["page_id"]]["text"] == "\n".join(x for x in blocks if x)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


PAGE = """<html><body><div id="page"><div class="top-bar"><a href=/>Home</a> <a href=/x>News</a></div><div class="cookie-consent"><p>We use cookies to improve your visit.</p><button>OK</button></div>
<div class="layout"><div class="post"><h1>The  title</h1><p>First paragraph of <a href="x>y">lin</a>ked text, long enough to be read.<p>Second&nbsp;one &mdash; with entity &amp more.<br>It goes on.<script>var p = "<p>no</p>"</script><div class="advertisement"><p>Buy now! Only today.</p></div><ul><li>One item<li>Two item</ul><!-- <p>gone</p> --><p>Last words.</p></div>
<div class="sidebar"><h3>Related</h3><ul><li><a href=1>Other story</a></li></ul></div></div>
<section id="comments"><h3>3 comments</h3><article class="comment"><p>I liked this one very much. Thank you.</p></article></section>
<form action=x><p>Sign up here.</p><input></form><div id="footer">Copyright 2020 Someone. All rights reserved.</div></div></body></html>"""


def test_a_page_of_another_make(spark):
    text = "The title\nFirst paragraph of linked text, long enough to be read.\nSecond one — with entity & more. It goes on.\nOne item\nTwo item\nLast words."
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "u", "", "t"), (3, "u", "<p>cut <b", "t"), (4, "u", "plain words only", "t")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    assert got[1] == text and got[2] == "" and got[None] == "" and got[3] == "cut"
    assert H.extract(df.limit(0)).count() == 0


#: Pages of other makes, each with its article's text.
MAKES = [
    ("""<html><head><title>Harbour</title><style>p{color:red}</style></head><body><div id="masthead"><a href="/">The Gazette</a></div><div id="nav"><ul><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li></ul></div>
<div id="story"><h1>Harbour opens again</h1><p class="byline-text">The port took its first ship on Monday. It had been shut since May.</p><p>Crews cleared the channel. <span class="advert">Buy boats now</span> Pilots were pleased.</p></div>
<div id="footer">Copyright 2021 The Gazette. All rights reserved.</div></body></html>""",
     "Harbour opens again\nThe port took its first ship on Monday. It had been shut since May.\nCrews cleared the channel. Pilots were pleased."),
    ("""<body><header><nav><a href=/>Home</a><a href=/b>Blog</a></nav></header><main><article><header><h1>On bread</h1></header><p>Flour, water and salt.<p>Wait a day.<h2>Baking</h2><ul><li>Heat the oven.<li>Bake for an hour.</ul></article></main><aside><h3>Recommended</h3><ul><li><a href=/1>On jam</a><li><a href=/2>On tea</a></ul></aside><footer>Privacy policy</footer></body>""",
     "On bread\nFlour, water and salt.\nWait a day.\nBaking\nHeat the oven.\nBake for an hour."),
    ("""<datalist><option value=a><option value=b></datalist><article><h1>A title</h1><p>Words of the text go here. They are read.</p></article><select><option>x</option></select>""",
     "A title\nWords of the text go here. They are read."),
    ("""<article><p>First words of it.<button>Copy<p>Second words, which stay.</article><footer><button>Top</button> Terms of use</footer>""",
     "First words of it.\nSecond words, which stay."),
    ("""<div class="container"><div class="post-content"><h2>Noise</h2><p>The value <math><mi>x</mi><mo>=</mo><mn>2</mn></math> is shown. <noscript>It needs no script.</noscript></p><table><tr><td>one<td>two</table></div><div class="comments"><h3>2 comments</h3><div class="comment"><p>Nice one. Thanks a lot.</p></div></div></div>""",
     "Noise\nThe value x=2 is shown. It needs no script.\none\ntwo"),
    ("""<html><body><form action=/search><label>Search</label><input><select><option>All<option>News</select><button>Go</button></form><div class=entry><h1>Rain</h1><blockquote>It rained all day, she said. Nobody came.</blockquote><pre>a  b
c</pre></div><div class="share-buttons"><a href=#>Share this</a></div></body></html>""",
     "Rain\nIt rained all day, she said. Nobody came.\na b c"),
    ("""<body><div class="cookie-banner"><p>We use cookies.</p><button>Accept cookies</button></div><section class="article-body"><h1>Two&nbsp;hills</h1><p>East of town, &lt;two&gt; hills stand.</p><figure><img src=h.png><figcaption>The hills at dawn.</figcaption></figure><div class="ad-slot"><p>Sponsored</p></div><p>A road runs between them.</p></section><div class="newsletter"><p>Subscribe to our newsletter.</p></div></body>""",
     "Two hills\nEast of town, <two> hills stand.\nThe hills at dawn.\nA road runs between them."),
    ("""<html><body><table class="layout"><tr><td class="sidebar"><ul><li><a href=a>Index</a></li><li><a href=b>About</a></li></ul></td><td class="content"><h1>Old page</h1><p>This page is laid out in a table. It is old.</p></td></tr></table><p class="footer">Copyright 1999</p></body></html>""",
     "Old page\nThis page is laid out in a table. It is old."),
    ("""<body><main id=content><h1>News</h1><div><p>The <em class="hl">council</em> met <a class="ref" href=/c>on Friday</a>.</p><p>It agreed. <svg><text>icon</text></svg>Work begins soon.</p><script>var a = "<p>no</p>";</script></div></main><section class="related-posts"><h2>Related</h2><p><a href=1>Other story here</a></p></section></body>""",
     "News\nThe council met on Friday.\nIt agreed. Work begins soon."),
    ("""<body><ul class="menu"><li><a href=1>One</a><li><a href=2>Two</a></ul><div role="main"><h3>Notes</h3><dl><dt>First term<dd>What it means, in short.<dt>Second term<dd>What that one means.</dl></div><div style="display:none">Hidden words. Not shown.</div><div id=footer-links><a href=x>Contact</a></div></body>""",
     "Notes\nFirst term\nWhat it means, in short.\nSecond term\nWhat that one means."),
]


def test_pages_of_other_makes():
    got = H.main_texts([page for page, _ in MAKES], *H.fit())
    for (_, want), text in zip(MAKES, got, strict=True):
        assert text == want


def test_stray_quotes_lose_no_text():
    """A quote inside an unquoted value, or after a closed one, is a character, as browsers read it."""
    story = "<p>Rain fell on the city for nine days, and the river rose. People left their houses.</p>"
    cases = [
        ('<p>The mayor read <a href="/x"">the report</a> aloud on Monday evening.</p>', "The mayor read the report aloud on Monday evening."),
        ("<p title=don't>The first bridge was closed, the second one held.</p><p>And it isn't lost at all, said the mayor.</p>", "The first bridge was closed, the second one held.\nAnd it isn't lost at all, said the mayor."),
        ("<p data-x = 'a\"b' class=o'k>Trains stopped, and buses were full.</p>", "Trains stopped, and buses were full."),
        ("<p =x y=>Schools opened again after two weeks.</p>", "Schools opened again after two weeks."),
    ]
    model = H.fit()
    for extra, text in cases:
        page = f'<html><body><nav><a href="/">Home</a> <a href="/n">News</a></nav><article><h1>Rain falls</h1>{story}{extra}{story}<p class="note">The end of the story came in May.</p></article><footer>All rights reserved</footer></body></html>'
        got = H.main_texts([page], *model)[0]
        assert text in got and got.count("Rain fell on the city") == 2 and "The end of the story came in May." in got, extra
    assert D.attributes(""" a="1" b='2"' c=d'e f g= =h""") == {"a": "1", "b": '2"', "c": "d'e", "f": "", "g": "=h"}


def test_bad_markup_takes_linear_time():
    for piece in ("<option>", "<div></p>", "<svg>", "<b></i>", "<a href=x><article>", "<button class=x>", "<ul><li><div><td>", "<x y='", "</p>", "<select><div>", "<!--"):
        page = piece * (1_000_000 // len(piece))
        began = time.process_time()
        parse(page[:500_000])
        half = time.process_time() - began
        began = time.process_time()
        parse(page)
        assert time.process_time() - began < max(4 * half, 1) and half < 5


def test_deep_and_broken_markup():
    deep = "<div>" * 3000 + "x" + "</div>" * 10 + "</p></span><li>"
    nodes, blocks = parse(deep)
    assert len(nodes) >= 3001 and blocks == [(3000, "x")]
    assert parse("<script>never closed <p>x</p>")[1] == [] and parse("a<![CDATA[ <b> ]]>c")[1] == [(0, "a <b> c")]
    assert parse("&lt;p&gt; <textarea><p>no</p></textarea>yes")[1] == [(0, "<p> yes")]


def pages(spark, n=300):
    return spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.repeat(F.concat(F.lit("é"), F.col("id").cast("string")), 3).alias("html"))


def statuses(found):
    return {(r["file"], r["offset"]): r["status"] for r in found.collect()}


def test_audit_of_changed_missing_and_extra_records(spark):
    rows = [(f, o * 1000, 1000, f"{f}-{o}") for f in range(40) for o in range(0, 200, 7)]
    theirs = [r for r in rows if r[:2] != (3, 70_000)]
    theirs = [(*r[:3], "other") if r[:2] == (39, 196_000) else (*r[:2], 999, r[3]) if r[:2] == (0, 0) else r for r in theirs] + [(41, 0, 5, "new")]
    schema = "file long, offset long, length long, digest string"
    ours, found = spark.createDataFrame(rows, schema), spark.createDataFrame(theirs, schema)
    assert statuses(W.audit(ours, found)) == {(3, 70_000): "missing", (39, 196_000): "changed", (0, 0): "changed", (41, 0): "extra"}
    assert W.audit(ours, ours).count() == 0
    empty = ours.limit(0)
    assert W.audit(empty, empty).count() == 0 and set(statuses(W.audit(ours, empty)).values()) == {"missing"} and W.audit(ours, empty).count() == len(rows)


def test_all_rows_have_a_place(spark):
    big = 1 << 62
    rows = [(1, "u", "a"), (1, "u", "b"), (1, "u", "b"), (None, "u", "c"), (None, None, None), (-5, "u", "d"), (big, "u", "e"), (2, None, "f")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    found = W.place(W.records(df), 3).orderBy("file", "nth").collect()
    assert [r["id"] for r in found] == [None, None, -5, 1, 1, 1, 2, big] and [(r["file"], r["nth"]) for r in found] == [(i // 3, i % 3) for i in range(8)]
    for r in found:
        assert r["offset"] == sum(x["length"] for x in found if x["file"] == r["file"] and x["nth"] < r["nth"])
    lost = W.audit(W.place(W.records(df), 3), W.place(W.records(df), 3).filter("id IS NOT NULL AND id <> -5"))
    assert set(statuses(lost).values()) == {"missing"} and lost.count() == 3
    assert W.place(W.records(df.limit(0))).count() == 0


def test_warc_files_are_audited_by_their_bytes(spark, tmp_path):
    path = tmp_path / "warc"
    made = pages(spark).withColumn("html", F.when(F.col("page_id") == 9, F.lit("a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb\n")).otherwise(F.col("html")))
    W.write_warc(made, str(path), 100)
    for p in path.glob("file=*/.*.crc"):
        p.unlink()  # the local file system's own check, which would find the damage first
    files = {int(p.parent.name[5:]): p for p in path.glob("file=*/*.txt")}
    assert sorted(files) == [0, 1, 2]
    ours = spark.createDataFrame(W.read_warc(spark, str(path)).collect())
    assert W.audit(W.place(W.records(made), 100), ours).count() == 0 and ours.count() == 300
    at = {(r["file"], i): r for f in range(3) for i, r in enumerate(sorted((x for x in ours.collect() if x["file"] == f), key=lambda x: x["offset"]))}
    raw = bytearray(files[1].read_bytes())
    raw[at[1, 40]["offset"] + at[1, 40]["length"] - 6] ^= 1  # a flipped bit
    raw[at[1, 60]["offset"] : at[1, 61]["offset"]] = bytes(at[1, 60]["length"])  # an overwritten record
    files[1].write_bytes(raw)
    assert statuses(W.audit(ours, W.read_warc(spark, str(path)))) == {(1, at[1, 40]["offset"]): "changed", (1, at[1, 60]["offset"]): "missing"}
    raw = files[2].read_bytes()
    cut = at[2, 97]["offset"]
    files[2].write_bytes(raw[:cut] + raw[at[2, 98]["offset"] :])  # a lost record: those behind move up
    found = W.audit(ours, W.read_warc(spark, str(path))).filter("file = 2")
    assert statuses(found) == {(2, cut): "changed", (2, at[2, 98]["offset"]): "changed", (2, at[2, 99]["offset"]): "moved"}


def warc(version, name, body, end="\r\n"):
    lines = [f"WARC/{version}", "WARC-Type: response", "X-Long: first", "\tsecond", f"{name}: {len(body)}", "WARC-Record-ID: <urn:x>", "", ""]
    return end.join(lines).encode() + body + 2 * end.encode()


def test_records_of_all_versions_are_parsed():
    inner = warc("1.0", "Content-Length", b"within a payload")
    made = [warc("1.0", "content-length", b"a"), warc("0.17", "CONTENT-LENGTH", b""), warc("1.1", "Content-Length", inner), warc("0.18", "Content-length", b"line\n", "\n")]
    ends = list(itertools.accumulate(map(len, made)))
    want = [(e - len(r), len(r), hashlib.sha256(r).hexdigest()) for e, r in zip(ends, made, strict=True)]
    assert list(W.parse_warc(b"".join(made))) == want == list(W.parse_warc(b"".join(made), gaps=True))
    folded = b"WARC/1.0\r\nContent-Length:\r\n 3\r\n\r\nabc\r\n\r\n"
    assert [x[:2] for x in W.parse_warc(folded)] == [(0, len(folded))]
    assert list(W.parse_warc(b"")) == [] and list(W.parse_warc(b"no record")) == []
    assert [x[:2] for x in W.parse_warc(b"no record", gaps=True)] == [(0, 9)]
    assert [x[:2] for x in W.parse_warc(made[0][:-1], gaps=True)] == [(0, len(made[0]) - 1)]
    broken = made[0] + b"?" * 50 + made[1] + b"tail"
    kinds = [(a, n, d.startswith("unparsed:")) for a, n, d in W.parse_warc(broken, gaps=True)]
    a, b = len(made[0]), len(made[1])
    assert kinds == [(0, a, False), (a, 50, True), (a + 50, b, False), (a + 50 + b, 4, True)]
    assert [x[:2] for x in W.parse_warc(broken)] == [(0, a), (a + 50, b)]


def test_gzip_members_are_records_by_their_compressed_bytes():
    noise = random.Random(3).randbytes(300_000)
    made = [gzip.compress(warc("1.0", "Content-Length", body), mtime=0) for body in (b"a", noise, b"z" * 3_000_000, b"")]
    at = [0, *itertools.accumulate(map(len, made))]
    want = [(i, len(r), hashlib.sha256(r).hexdigest()) for i, r in zip(at, made, strict=False)]
    assert list(W.parse_warc(b"".join(made), gaps=True)) == want
    raw = bytearray(b"".join(made))
    raw[at[1] + 150_000] ^= 1  # the member's check finds it
    found = list(W.parse_warc(bytes(raw), gaps=True))
    assert [x for x in found if not x[2].startswith("unparsed:")] == [want[0], *want[2:]]
    assert [x[:2] for x in found if x[2].startswith("unparsed:")] == [(at[1], len(made[1]))]
    assert list(W.parse_warc(b"".join(made)[:-3])) == want[:-1]
    assert list(W.parse_warc(gzip.compress(b"no record"))) == []


def test_replicas_of_foreign_files_are_audited(spark, tmp_path):
    r = random.Random(5)
    files = {f"crawl/{n}.warc{z}": [warc(r.choice(["1.0", "1.1"]), "Content-Length", r.randbytes(r.randint(0, 900))) for _ in range(150)] for n in ("a", "b c", "é") for z in ("", ".gz")}
    stored = {name: [gzip.compress(x, mtime=0) for x in rs] if name.endswith("gz") else rs for name, rs in files.items()}
    for side in ("ours", "theirs"):
        for name, rs in stored.items():
            (tmp_path / side / "crawl").mkdir(parents=True, exist_ok=True)
            (tmp_path / side / name).write_bytes(b"".join(rs))
    ours, theirs = str(tmp_path / "ours"), str(tmp_path / "theirs")
    numbers = {x["name"]: x["file"] for x in W.warc_files(spark, ours, theirs).collect()}
    assert sorted(numbers.values()) == list(range(6)) and [numbers[n] for n in sorted(numbers, key=str.encode)] == list(range(6))
    read = lambda: (W.read_warc(spark, p, W.warc_files(spark, ours, theirs)) for p in (ours, theirs))
    a, b = read()
    assert a.count() == 900 == W.read_warc(spark, ours).count() and W.audit(a, b).count() == 0
    want = {}
    for name, i in (("crawl/a.warc", 70), ("crawl/b c.warc.gz", 30)):
        raw, at = bytearray(b"".join(stored[name])), sum(map(len, stored[name][:i]))
        raw[at + len(stored[name][i]) // 2] ^= 255
        (tmp_path / "theirs" / name).write_bytes(raw)
        want[numbers[name], at] = {"changed", "missing"}
    (tmp_path / "theirs" / "crawl" / "é.warc").unlink()  # a lost file moves no other's number
    found = statuses(W.audit(*read()))
    lost = {k: v for k, v in found.items() if k[0] == numbers["crawl/é.warc"]}
    assert len(lost) == 150 and set(lost.values()) == {"missing"}
    rest = {k: v for k, v in found.items() if k not in lost}
    assert rest.keys() == want.keys() and all(v in want[k] for k, v in rest.items())


def test_fixity_query_equals_its_sql(spark, tmp_path):
    made = spark.createDataFrame([(None, None, None), (None, "u", "é" * 150), (-3, "v", "x" * 300), (3, "v", ""), (3, "v", "twice"), (3, "v", "twice")], "page_id long, url string, html string")
    more = spark.range(5, 700).select(F.col("id").alias("page_id"), F.lit("w").alias("url"), F.concat(F.repeat(F.lit("é"), 120), F.col("id").cast("string")).alias("html"))
    made.unionByName(more).write.parquet(str(tmp_path / "pages.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = con.execute(W.OP2_SQL).fetchall()
    got = [tuple(r) for r in W.op2_merkle_fixity(spark, str(tmp_path)).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 10
