"""Web archives: records, files, and a Merkle audit of replicas.

A replica is a table of records (file, offset, length, content).  Records are
hashed; hashes of the records that begin in the same range of 64 KiB of a file,
in order of offset, make a leaf; sixteen neighbouring nodes make one node of the
next level, up to one root a file and one for the archive.  Every node is thus a
hash over an ordered range of offsets, made of at most as many parts as fit into
a range, and no level needs all of a file in one task.

Two replicas are compared from the top: first the archives' roots, then the
files', then only the children of nodes that differ, down to the records.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

RANGE_BITS = 16
FANOUT_BITS = 4
END = "\r\n\r\n"


def response_record(record_id: Column, uri: Column, payload: Column) -> Column:
    """The text of one WARC response record, its closing line feeds included."""
    lines = ["WARC/1.1", "WARC-Type: response", F.concat(F.lit("WARC-Record-ID: <urn:"), record_id, F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), uri), "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string"))]
    head = F.concat_ws("\r\n", *(F.lit(x) if isinstance(x, str) else x for x in lines))
    return F.concat(head, F.lit(END), payload, F.lit(END))


def laid_out(df: DataFrame, file: str, content: str, order: list[str], keep: bool = True) -> DataFrame:
    """Adds length and offset, in bytes, and sha to records: each file holds its
    records in the given order (ties by their hash).  A file is sorted by one
    task, so the caller bounds what a file holds, as any archive does; without
    `keep` the contents go before rows are sorted."""
    df = df.withColumns({"length": F.octet_length(content).cast("long"), "sha": F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit(b"")), 256)})
    df = df if keep else df.drop(content)
    before = Window.partitionBy(file).orderBy(*order, "sha").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def write_warc(df: DataFrame, path: str, file: str = "file", content: str = "content") -> None:
    """Writes laid-out records as one WARC file for each value of `file`, below
    path/file=<value>/.  Records end in an empty line, which separates them."""
    ended = F.expr(f"substring({content}, 1, length({content}) - 4)")
    rows = df.select(file, "offset", ended.alias("value")).repartition(file).sortWithinPartitions(file, "offset")
    rows.select("value", file).write.partitionBy(file).option("lineSep", END).text(path)


RECORD = T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("payload", T.BinaryType())])
HEADER = re.compile(rb"(?P<name>[!-9;-~]+):[ \t]*(?P<value>[^\r\n]*)\r?\n?")


def _members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, stored length, content) of gzip members; of the whole if there are none."""
    if data[:2] != b"\x1f\x8b":
        yield 0, len(data), data
        return
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        try:
            content = z.decompress(data[at:]) + z.flush()
        except zlib.error:
            return
        end = len(data) - len(z.unused_data)
        yield at, end - at, content
        at = end


def records(data: bytes) -> Iterator[tuple[int, int, str | None, str | None, str | None, bytes, bytes]]:
    """The records of a WARC file.  Offsets and lengths are those in the file, of
    the gzip member if there is one.  Bytes that begin no record are skipped up
    to the next version line; a record cut off at the end keeps what is there."""
    for start, stored_length, content in _members(data):
        at = 0
        while (at := content.find(b"WARC/", at)) >= 0:
            head_end = content.find(b"\r\n\r\n", at)
            if head_end < 0:
                break
            fields = {m["name"].lower(): m["value"].decode("utf-8", "replace") for m in HEADER.finditer(content, content.find(b"\n", at) + 1, head_end)}
            size = fields.get(b"content-length", "")
            if not size.isdigit():
                at += 5
                continue
            body = head_end + 4
            end = min(body + int(size) + 4, len(content))
            packed = content is not data
            yield (start if packed else at, stored_length if packed else end - at, fields.get(b"warc-type"), fields.get(b"warc-record-id"), fields.get(b"warc-target-uri"), content[at:end], content[body : body + int(size)])
            at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, type, record_id, uri, content, payload) of the WARC
    files, plain or gzipped by record, below path."""

    @F.arrow_udf(T.ArrayType(RECORD))
    def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("content", pa.binary()), ("payload", pa.binary())]))
        names = [f.name for f in RECORD]
        for batch in batches:
            yield pa.array([[dict(zip(names, r)) for r in records(x.as_py() or b"")] for x in batch], kind)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.explode(parsed("content")).alias("r")).select("file", "r.*")


def record_hashes(df: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """(file, offset, length, sha) of a replica.  The hash covers the content; a
    replica that has it already is taken at its word."""
    sha = F.col("sha") if "sha" in df.columns else F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit(b"")), 256)
    return df.select(F.col(file).alias("file"), "offset", "length", sha.alias("sha"))


def _joined(parts: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(parts), lambda x: x["h"]), ",").cast("binary"), 256)


def tree(hashes: DataFrame, levels: int) -> list[DataFrame]:
    """Levels of nodes (file, node, h) from the leaves to the files' roots.
    Records at one offset (copies) are ordered by length and hash."""
    record = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "sha")
    level = hashes.groupBy("file", F.shiftright("offset", RANGE_BITS).alias("node")).agg(_joined(F.collect_list(F.struct("offset", "length", record.alias("h")))).alias("h"))
    out = [level]
    for _ in range(levels):
        part = F.struct(F.col("node").alias("n"), F.concat_ws(":", F.col("node").cast("string"), "h").alias("h"))
        level = level.select("file", F.shiftright("node", FANOUT_BITS).alias("up"), part.alias("part")).groupBy("file", F.col("up").alias("node")).agg(_joined(F.collect_list("part")).alias("h"))
        out.append(level)
    return out


def archive_root(roots: DataFrame) -> DataFrame:
    """One row (h) over all files' roots: sums of their hashes' words, so that
    neither the order nor the number of files matters to any task."""
    words = [F.sum(F.conv(F.substring(F.sha2(F.concat_ws("|", F.coalesce("file", F.lit("")), "h"), 256), 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(8)]
    return roots.agg(F.concat_ws(",", *words).alias("h"))


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, offset, length, a_sha, b_sha, status) of the records in which
    replicas a and b, as record_hashes gives them, differ; status is `differs`,
    `missing` (from b) or `extra` (in b).  Nulls in file are a file of their own;
    equal replicas and two empty ones give no row; a record that is there more
    than once is compared as a list of its copies.
    """
    a, b = stored(a), stored(b)
    top = a.unionAll(b).agg(F.max("offset")).first()[0]
    levels = max(0, -(-(max(top or 0, 1).bit_length() - RANGE_BITS) // FANOUT_BITS))
    trees = [[stored(level) for level in tree(x, levels)] for x in (a, b)]

    if archive_root(trees[0][-1]).first() == archive_root(trees[1][-1]).first():
        suspect = trees[0][-1].select("file", "node").limit(0)
    else:
        suspect = None
    for left, right in zip(reversed(trees[0]), reversed(trees[1])):
        if suspect is not None:
            left, right = (_below(x, suspect, FANOUT_BITS, "node") for x in (left, right))
        both = left.withColumnRenamed("h", "ha").alias("l").join(right.withColumnRenamed("h", "hb").alias("r"), F.col("l.file").eqNullSafe(F.col("r.file")) & (F.col("l.node") == F.col("r.node")), "full")
        suspect = stored(both.filter(~F.col("ha").eqNullSafe(F.col("hb"))).select(F.coalesce("l.file", "r.file").alias("file"), F.coalesce("l.node", "r.node").alias("node")))

    def listed(x: DataFrame, name: str) -> DataFrame:
        return _below(x, suspect, RANGE_BITS, "offset").groupBy("file", "offset", "length").agg(F.array_join(F.array_sort(F.collect_list("sha")), ",").alias(name))

    l, r = listed(a, "a_sha").alias("l"), listed(b, "b_sha").alias("r")
    both = l.join(r, F.col("l.file").eqNullSafe(F.col("r.file")) & (F.col("l.offset") == F.col("r.offset")) & (F.col("l.length") == F.col("r.length")), "full")
    status = F.when(F.col("b_sha").isNull(), "missing").when(F.col("a_sha").isNull(), "extra").otherwise("differs")
    return both.filter(~F.col("a_sha").eqNullSafe(F.col("b_sha"))).select(*(F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in ("file", "offset", "length")), "a_sha", "b_sha", status.alias("status"))


def _below(level: DataFrame, suspect: DataFrame, bits: int, col: str) -> DataFrame:
    """The rows of a level that stand below suspect nodes."""
    s = suspect.select(F.col("file").alias("_file"), F.col("node").alias("_node"))
    return level.join(s, F.col("file").eqNullSafe(F.col("_file")) & (F.shiftright(col, bits) == F.col("_node")), "left_semi")


def page_archive(pages: DataFrame, per_file: int = 500, keep: bool = True) -> DataFrame:
    """Pages as laid-out WARC records: page_id, file, offset, length, sha and, if
    it is to be kept, content.
    A file holds the pages of `per_file` consecutive ids; pages without an id are
    dealt over 256 files by their address."""
    number = F.floor(F.col("page_id") / per_file)
    none = F.concat(F.lit("pages-none-"), F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 2))
    file = F.when(number.isNull(), none).otherwise(F.format_string("pages-%06d", number))
    digest = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), F.coalesce("url", F.lit(""))).cast("binary"))
    content = response_record(F.concat(F.lit("md5:"), digest), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
    return laid_out(pages.select("page_id", file.alias("file"), content.alias("content")), "file", "content", ["page_id"], keep)


def damaged(pages: DataFrame) -> DataFrame:
    """The second replica of a drill: the first character of every 97th page's
    html is overwritten, which leaves all offsets where they are if it was one byte."""
    hit = (F.col("page_id") % 97 == 5) & F.substring("html", 1, 1).rlike(r"^[\x00-\x7f]$")
    return pages.withColumn("html", F.when(hit, F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))


PAGES_SQL = r"""
WITH r AS (
  SELECT page_id, CASE WHEN page_id IS NULL THEN 'pages-none-' || substr(md5(coalesce(url, '')), 1, 2) ELSE printf('pages-%06d', CAST(floor(page_id / 500) AS BIGINT)) END AS file,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:md5:' || md5(concat_ws('|', page_id, coalesce(url, ''))) || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS content,
    coalesce(page_id % 97 = 5 AND length(html) > 0 AND unicode(html) < 128, FALSE) AS hit
  FROM pages)
SELECT page_id, file, CAST(coalesce(sum(strlen(content)) OVER (PARTITION BY file ORDER BY page_id, sha256(content) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  strlen(content) AS length, sha256(content) AS sha256, CASE WHEN hit THEN 'differs' ELSE 'intact' END AS status
FROM r
"""
