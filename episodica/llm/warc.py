"""WARC fixity: Merkle trees over the records and offset ranges of replicas, compared from the root down (operator 2)."""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodica.llm.shared import fresh_path, table
from episodica.operators.ranks import ordered_rank

#: A node of the lowest level covers 2^RANGE_BITS bytes of a file; one above has 2^FAN_BITS children. Records of a file.
RANGE_BITS, FAN_BITS, FILE_RECORDS = 16, 4, 4096
#: A header: its version, then named lines, which may go on in lines that begin with white space; names are the same in any case.
_BEGIN = re.compile(rb"WARC/[01]\.[0-9]{1,2}\r?\n")
_LINE = rb"[!-9;-~]+:[^\r\n]*(?:\r?\n[ \t][^\r\n]*)*\r?\n"
_HEADER = re.compile(_BEGIN.pattern + rb"(?:(?!(?i:content-length):)" + _LINE + rb")*(?i:content-length):[ \t]*(?:\r?\n[ \t]+)?([0-9]{1,18})[ \t]*\r?\n(?:" + _LINE + rb")*\r?\n")
_END = re.compile(rb"\r?\n\r?\n")
_MEMBER, _STEP = b"\x1f\x8b\x08", 1 << 16


def warc_record(id_: Column, url: Column, payload: Column) -> Column:
    """A WARC/1.1 resource record as text. A null id or url is an empty one; a null payload has no bytes."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def _written(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def place(rows: DataFrame, records: int = FILE_RECORDS) -> DataFrame:
    """``rows`` (id, url, length, digest, and others) with file, nth and offset: where a replica's files hold them.

    Records stand in order of id, url and digest (nulls first), ``records`` of them a file, each behind the one before. All rows
    have a place, those without an id and repeated ones too: rows are dealt by ranges of that order and their place in the input,
    so no id is too frequent; a row's number is its place in its range plus the sizes of the ranges before, which are as many as
    partitions. An empty table gives an empty result.
    """
    order = [F.col(c).asc_nulls_first() for c in ("id", "url", "digest", "__k")]
    keyed = rows.withColumn("__k", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__k", F.monotonically_increasing_id())
    found = _written(dealt.withColumn("__part", F.shiftright("__k", 33)), "ranges")
    sizes = found.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    nth = F.col("__before") + F.col("__k").bitwiseAND((1 << 33) - 1)
    numbered = found.join(before, "__part").withColumn("__nth", nth)
    filed = numbered.select(*rows.columns, F.floor(F.col("__nth") / records).cast("long").alias("file"), (F.col("__nth") % records).alias("nth"))
    in_file = Window.partitionBy("file").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    return filed.withColumn("offset", F.coalesce(F.sum("length").over(in_file), F.lit(0)))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, url, record, length, digest) of every row."""
    id_ = F.col(id_col).cast("long")
    found = pages.select(id_.alias("id"), F.col(url_col).cast("string").alias("url"), warc_record(id_, F.col(url_col), F.col(payload_col)).alias("record"))
    return found.withColumns({"length": F.octet_length("record").cast("long"), "digest": F.sha2("record", 256)})


def write_warc(pages: DataFrame, path: str, per_file: int = FILE_RECORDS) -> None:
    """Writes the rows of ``pages`` (page_id, url, html) as WARC files: path/file=N/part-..., in the order and at the offsets of :func:`place`."""
    placed = place(records(pages), per_file)
    text = F.expr("substring(record, 1, length(record) - 2)")  # the writer ends each line by the last two characters
    placed.repartition("file").sortWithinPartitions("file", "offset").select("file", text.alias("value")).write.partitionBy("file").option("lineSep", "\r\n").text(path)


def _member(content: bytes, at: int) -> int | None:
    """Where the gzip member that begins at ``at`` ends, if it is whole, passes its check and holds a record; inflated in steps, never kept."""
    inflate, head, fed = zlib.decompressobj(31), b"", at
    try:
        while not inflate.eof:
            if fed >= len(content):
                return None
            out = inflate.decompress(content[fed : fed + _STEP], _STEP)
            fed += _STEP
            while True:
                head += out[: _STEP - len(head)]
                if inflate.eof or not (rest := inflate.unconsumed_tail):
                    break
                out = inflate.decompress(rest, _STEP)
    except zlib.error:
        return None
    return min(fed, len(content)) - len(inflate.unused_data) if _BEGIN.match(head) else None


def _record(content: bytes, at: int) -> int | None:
    """Where the plain record that begins at ``at`` ends, if it is whole."""
    head = _HEADER.match(content, at)
    end = _END.match(content, head.end() + int(head[1])) if head and head.end() + int(head[1]) <= len(content) else None
    return end.end() if end else None


def parse_warc(content: bytes, gaps: bool = False) -> Iterator[tuple[int, int, str]]:
    """(offset, length, digest) of each whole record of a file, by the bytes as they are stored.

    Records of WARC 0.17 to 1.1 are read, with any case of names, folded lines, and line ends of one or two characters; and gzip members, whose offset,
    length and digest are those of the compressed bytes (a member with several records is one leaf). Where no whole one begins, the next
    beginning is searched; with ``gaps`` the bytes between are a row, too, with a digest behind "unparsed:". An empty file has no rows.
    """
    at = gap = 0
    packed = content.startswith(_MEMBER)
    while at < len(content):
        if packed:
            end = _member(content, at) if content.startswith(_MEMBER, at) else None
        else:
            end = _record(content, at)
        if end is None:
            begin = None if packed else _BEGIN.search(content, at + 1)
            at = content.find(_MEMBER, at + 1) if packed else begin.start() if begin else -1
            at = len(content) if at < 0 else at
        if gaps and gap < at and (end is not None or at == len(content)):
            yield gap, at - gap, "unparsed:" + hashlib.sha256(memoryview(content)[gap:at]).hexdigest()
        if end is not None:
            yield at, end - at, hashlib.sha256(memoryview(content)[at:end]).hexdigest()
            at = gap = end


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The files below ``path``, and what their paths begin with."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), whole.rstrip("/") + "/"


def warc_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(name, file): the numbers of the files that replicas have, by their names below each replica's path, in order of names.

    Replicas that are compared take one numbering, so that a file that one has lost moves no other. Contents aren't read.
    """
    names = [df.select(F.substring("path", len(root) + 1, 1 << 20).alias("name")) for df, root in (_stored(spark, p) for p in paths)]
    return ordered_rank(functools.reduce(DataFrame.unionByName, names).distinct(), "name", name="file")


def read_warc(spark: SparkSession, path: str, files: DataFrame | None = None, gaps: bool = False) -> DataFrame:
    """(file, offset, length, digest) of the records of a replica's files, by their bytes (see :func:`parse_warc`). A task holds one file.

    Files are numbered by ``files`` (:func:`warc_files`); without it by N where all paths have a folder file=N, else by the replica's own names. A file
    that ``files`` doesn't name has no rows; a folder without files gives an empty result. With ``gaps``, bytes that are no record are rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(parse_warc(batch.column(1)[i].as_py(), gaps))
                offset, length, digest = zip(*rows, strict=True) if rows else ((), (), ())
                where = batch.column(0)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([where] * len(rows), pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(digest, pa.string())], names=["path", "offset", "length", "digest"])

    stored, root = _stored(spark, path)
    found = stored.select("path", "content").mapInArrow(run, "path string, offset long, length long, digest string")
    numbered = F.regexp_extract("path", r"file=(\d+)/", 1)
    if files is None and stored.filter(numbered == "").isEmpty():
        return found.select(numbered.cast("long").alias("file"), "offset", "length", "digest")
    by = (warc_files(spark, path) if files is None else files).select(F.concat(F.lit(root), "name").alias("path"), F.col("file").cast("long").alias("file"))
    return found.join(by, "path").select("file", "offset", "length", "digest")


def parents(level: DataFrame) -> DataFrame:
    """(side, node, hash) one level up: the digest of at most 2^FAN_BITS children's hashes in order of their place."""
    children = F.array_sort(F.collect_list(F.struct("node", "hash")))
    line = F.array_join(F.transform(children, lambda x: F.concat_ws(":", x["node"], x["hash"])), ",")
    return level.groupBy("side", F.shiftright("node", FAN_BITS).alias("up")).agg(F.sha2(line, 256).alias("hash")).select("side", F.col("up").alias("node"), "hash")


def ranges(leaves: DataFrame) -> DataFrame:
    """(side, node, hash) of the lowest level: the digest of offset, length and digest of the records that begin in a range."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "length", "digest")))
    line = F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["offset"], x["length"], F.coalesce(x["digest"], F.lit("")))), ",")
    return leaves.groupBy("side", "node").agg(F.sha2(line, 256).alias("hash"))


def _differing(level: DataFrame, above: DataFrame | None) -> DataFrame:
    """The nodes where the sides' hashes differ, or one has none; only children of the nodes ``above``."""
    if above is not None:
        level = level.join(above.select(F.col("node").alias("up")), F.shiftright("node", FAN_BITS) == F.col("up"), "left_semi")
    side = lambda i: F.max(F.when(F.col("side") == i, F.col("hash")))
    return level.groupBy("node").agg(side(0).alias("ours"), side(1).alias("theirs")).filter(~F.col("ours").eqNullSafe(F.col("theirs"))).select("node")


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(file, offset, length, status, ours, theirs): where two replicas' records (file, offset, length, digest) differ.

    A leaf is a record: its offset, length and digest. A node of the lowest level covers the records that begin in an ordered range of
    64 kB of a file, one above 16 of those, up to the file, to 16 files, to all. Both trees are written level by level; the roots are
    compared, and below them only the children of nodes that differ. ``status`` of a record: changed (another one begins at its
    offset), missing (only ours), extra (only theirs), or moved: missing or extra here, but the other side's file has it at another
    offset, as after a lost record. ``length`` is ours, or theirs of an extra one.

    Empty replicas have no nodes. Records that share file and offset, which one file can't have, are all leaves of their range, and
    compared as a set. A null digest counts by its presence. No group exceeds 16 hashes of a side, or the records of 64 kB.
    """
    columns = ("file", "offset", "length", "digest")
    both = ours.select(*columns).withColumn("side", F.lit(0)).unionByName(theirs.select(*columns).withColumn("side", F.lit(1)))
    found = _written(both, "leaves")
    most = found.agg(F.max("offset").alias("offset"), F.max("file").alias("file")).first()
    bits = (most["offset"] or 0) >> RANGE_BITS
    width = -(-bits.bit_length() // FAN_BITS) * FAN_BITS
    leaves = found.withColumn("node", F.shiftleft("file", width) + F.shiftright("offset", RANGE_BITS))
    levels, top = [_written(ranges(leaves), "nodes")], ((most["file"] or 0) << width) + bits
    while top:
        top >>= FAN_BITS
        levels.append(_written(parents(levels[-1]), "nodes"))
    bad = None
    for level in reversed(levels):
        bad = _written(_differing(level, bad), "differing")
    left = leaves.join(bad, "node", "left_semi")
    one = lambda i, c: F.max(F.when(F.col("side") == i, F.col(c)))
    sets = left.groupBy("file", "offset").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == 0, F.struct("length", "digest")))).alias("a"), F.sort_array(F.collect_list(F.when(F.col("side") == 1, F.struct("length", "digest")))).alias("b"),
        one(0, "length").alias("n"), one(1, "length").alias("m"), one(0, "digest").alias("ours"), one(1, "digest").alias("theirs"),
    )
    status = F.when(F.size("b") == 0, "missing").when(F.size("a") == 0, "extra").otherwise("changed")
    here = sets.filter("a <> b").select("file", "offset", F.coalesce("n", "m").alias("length"), status.alias("status"), "ours", "theirs")
    here = _written(here, "found")
    stands = here.select("file", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("ours").alias("digest")), F.struct(F.lit(1).alias("side"), F.col("theirs").alias("digest")))).alias("x")).select("file", "x.*")
    twice = stands.filter("digest IS NOT NULL").groupBy("file", "digest").agg(F.countDistinct("side").alias("n")).filter("n = 2").select("file", F.col("digest").alias("d"), F.lit(True).alias("moved"))
    digest = F.when(F.col("status") == "missing", F.col("ours")).when(F.col("status") == "extra", F.col("theirs"))
    marked = here.withColumn("d", digest).join(twice, ["file", "d"], "left")
    return marked.select("file", "offset", "length", F.when(F.col("moved"), "moved").otherwise(F.col("status")).alias("status"), "ours", "theirs")


def rotten(pages: DataFrame) -> DataFrame:
    """``pages`` with ``found``: the html that a replica has after bit rot in place, by the digest of the id, and ``lost``.

    Some pages are reversed, some blanked behind their first 100 characters (lengths stay), some overwritten as a whole (lost).
    """
    mark = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 2)
    start = F.substring("html", 1, 100)
    blank = F.concat(start, F.repeat(F.lit(" "), (F.octet_length("html") - F.octet_length(start)).cast("int")))
    html = F.when(mark < "04", F.reverse("html")).when(mark < "06", blank).otherwise(F.col("html"))
    return pages.withColumns({"found": html, "lost": (mark >= "06") & (mark < "08")})


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damage of a replica after bit rot. Digests of both are taken in one scan of the pages; what is sorted and joined are those."""
    pages = rotten(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    record = lambda c: warc_record(F.col("page_id"), F.col("url"), F.col(c))
    rows = pages.select(F.col("page_id").alias("id"), "url", F.octet_length(record("html")).cast("long").alias("length"), F.sha2(record("html"), 256).alias("digest"), F.when(~F.col("lost"), F.sha2(record("found"), 256)).alias("theirs"))
    placed = _written(place(rows), "replica")
    bad = audit(placed, placed.filter("theirs IS NOT NULL").withColumn("digest", F.col("theirs")))
    named = placed.select(F.col("id").alias("page_id"), "file", "offset")
    return named.join(bad, ["file", "offset"]).select("page_id", "file", "offset", "length", "status", F.col("ours").alias("digest"), F.col("theirs").alias("digest_found"))


OP2_SQL = """
WITH marked AS (
  SELECT page_id, url, html, substr(md5(coalesce(page_id::VARCHAR, '')), 1, 2) AS mark FROM pages
), both_sides AS (
  SELECT page_id, mark, url, coalesce(html, '') AS html,
    CASE WHEN mark < '04' THEN reverse(coalesce(html, ''))
      WHEN mark < '06' THEN substr(coalesce(html, ''), 1, 100) || repeat(' ', strlen(coalesce(html, '')) - strlen(substr(coalesce(html, ''), 1, 100)))
      ELSE coalesce(html, '') END AS theirs
  FROM marked
), record AS (
  SELECT page_id, mark, url,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
      || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
      || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
      || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head,
    chr(13) || chr(10) || chr(13) || chr(10) AS gap, html, theirs
  FROM both_sides
), hashed AS (
  SELECT page_id, url, sha256(head || strlen(html) || gap || html || gap) AS digest,
    CASE WHEN mark >= '06' AND mark < '08' THEN NULL ELSE sha256(head || strlen(theirs) || gap || theirs || gap) END AS digest_found,
    strlen(head || strlen(html) || gap || html || gap) AS length
  FROM record
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, url NULLS FIRST, digest) - 1 AS nth FROM hashed
), placed AS (
  SELECT *, nth // 4096 AS file,
    coalesce(sum(length) OVER (PARTITION BY nth // 4096 ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM numbered
)
SELECT page_id, file, "offset", length, CASE WHEN digest_found IS NULL THEN 'missing' ELSE 'changed' END AS status, digest, digest_found
FROM placed WHERE digest IS DISTINCT FROM digest_found
"""
