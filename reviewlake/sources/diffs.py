"""Where diffs, documents and labels come from."""

from __future__ import annotations

import difflib
import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DIFFS = "diff_id string, diff_text string, pr_title string, pr_url string"


def diff_files(spark: SparkSession, path: str) -> DataFrame:
    """A diff for each file below path; bytes that aren't UTF-8 are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.col("path").alias("diff_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("diff_text"), F.lit("").alias("pr_title"), F.col("path").alias("pr_url"))


def inline_diff(spark: SparkSession, text: str, title: str = "", url: str = "") -> DataFrame:
    return spark.createDataFrame([("inline", text, title, url)], DIFFS)


def local_diff(repo: str, span: str = "", timeout: int = 60) -> str:
    """`git diff` of base..head in a working copy, three lines of context; the
    defaults are the last commit and the one before."""
    base, _, head = span.partition("..")
    done = subprocess.run(["git", "-C", repo, "diff", "--unified=3", base or "HEAD~1", head or "HEAD"], capture_output=True, timeout=timeout, check=True)
    return done.stdout.decode("utf-8", "replace")


def inline_docs(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """docs(doc_ord, source, text) of (source, text)."""
    return spark.createDataFrame([(i, s or "inline", t) for i, (s, t) in enumerate(texts)], "doc_ord int, source string, text string")


def doc_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """docs of those paths that exist, in their order."""
    found: dict[str, str] = {}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        place = jvm.org.apache.hadoop.fs.Path(p)
        fs = place.getFileSystem(conf)
        if fs.exists(place):
            found.setdefault(fs.makeQualified(place).toString(), p)
    if not found:
        return inline_docs(spark, [])
    order = spark.createDataFrame([(i, p) for i, p in enumerate(found)], "doc_ord int, source string")
    # The names are literal: characters that a pattern would read are escaped.
    raw = spark.read.format("binaryFile").load([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in found]).select(F.col("path").alias("source"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return raw.join(F.broadcast(order), "source").select("doc_ord", "source", "text")


def gold_labels(spark: SparkSession, path: str) -> DataFrame:
    """cases(case_id, title, negative, heldout, expect, semantic, patch) of a label file."""
    schema = "cases array<struct<id:string,title:string,negative:boolean,heldout:boolean,expect_rules:array<string>,expect_semantic:array<string>,patch:string>>"
    each = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("cases").alias("c"))
    return each.select(F.col("c.id").alias("case_id"), "c.title", "c.negative", F.coalesce("c.heldout", F.lit(False)).alias("heldout"), F.col("c.expect_rules").alias("expect"), (F.size(F.coalesce("c.expect_semantic", F.array().cast("array<string>"))) > 0).alias("semantic"), "c.patch")


@F.arrow_udf(T.StringType())
def _made(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for paths, befores, afters in batches:
        out = []
        for p, b, a in zip(paths.to_pylist(), befores.to_pylist(), afters.to_pylist()):
            old, new = (("" if x is None else x if not x or x.endswith("\n") else x + "\n") for x in (b, a))
            body = list(difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"a/{p}" if old else "/dev/null", f"b/{p}" if new else "/dev/null", n=3))
            out.append(f"diff --git a/{p} b/{p}\n" + "".join(body) if body else "")
        yield pa.array(out, pa.string())


def made_diffs(files: DataFrame) -> DataFrame:
    """files(diff_id, path, before, after) -> diffs; unchanged files give nothing."""
    each = files.withColumn("_d", _made("path", "before", "after")).filter(F.col("_d") != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "_d"))), lambda x: x["_d"]), "")
    return each.groupBy("diff_id").agg(joined.alias("diff_text"))


def from_file_list(listing: DataFrame) -> DataFrame:
    """listing(diff_id, at, filename, patch) -> diffs put together from each file's patch."""
    path = F.coalesce("filename", F.lit("unknown"))
    part = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"), F.coalesce("patch", F.lit("")))
    return listing.groupBy("diff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", part.alias("p")))), lambda x: x["p"]), "\n").alias("diff_text"))


def change_ref(text: Column) -> Column:
    """struct<owner, repo, number> of `owner/repo#1`, `owner/repo/1` or a link; null for anything else."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    link = r"https?://[\w.-]+/([\w.-]+)/([\w.-]+)/pull/(\d+)"
    short = r"^([\w.-]+)/([\w.-]+)(?:#|/)(\d+)$"
    make = lambda rx: F.struct(F.regexp_extract(s, rx, 1).alias("owner"), F.regexp_extract(s, rx, 2).alias("repo"), F.regexp_extract(s, rx, 3).try_cast("long").alias("number"))
    return F.when(s.rlike(link), make(link)).when(s.rlike(short), make(short))


def tool_payload(content: Column, structured: Column) -> Column:
    """The text parts of an answer joined by line feeds, else its structured part.
    content: array<struct<type, text>>."""
    texts = F.filter(F.transform(F.filter(content, lambda c: c["type"] == "text"), lambda c: F.coalesce(c["text"], F.lit(""))), lambda t: t != "")
    joined = F.array_join(F.coalesce(texts, F.array().cast("array<string>")), "\n")
    return F.when(joined != "", joined).otherwise(structured)


# Names of the tools, in their order.
DIFF_TOOLS = ("get_pull_request_diff", "pull_request_diff", "get_pr_diff", "get_pull_request_files", "list_pull_request_files")


def chosen_tool(tools: list[str], wanted: tuple[str, ...] = DIFF_TOOLS) -> str:
    """The first wanted tool that there is, else one for pull requests that shares
    a word of more than three letters with a wanted one."""
    for name in wanted:
        if name in tools:
            return name
    words = {w for name in wanted for w in name.split("_") if len(w) > 3}
    near = [t for t in tools if "pull_request" in t.lower() and any(w in t.lower() for w in words)]
    if not near:
        raise LookupError(f"none of {list(wanted)} among {sorted(tools)}")
    return near[0]


def tool_arguments(properties: list[str], required: list[str], owner: str, repo: str, number: int) -> dict:
    """What a tool's schema asks for; the usual three if it asks for nothing known."""
    known = {"owner": owner, "repo": repo, **dict.fromkeys(("pull_number", "pullNumber", "pr_number", "number", "prNumber"), number)}
    asked = {k: v for k, v in known.items() if k in properties or k in required}
    return asked or {"owner": owner, "repo": repo, "pull_number": number}


def http_error(code: Column, path: Column, detail: Column) -> Column:
    """A readable reason for a status; null below 400."""
    d = F.left(F.coalesce(detail, F.lit("")), F.lit(500))
    return (
        F.when(code < 400, None)
        .when(code == 401, F.concat(F.lit("401: the token is wrong or has expired. "), d))
        .when(code == 403, F.concat(F.lit("403: not allowed, or too many requests. "), d))
        .when(code == 404, F.concat(F.lit("404: "), path, F.lit(" isn't there; check names, number and the token's scope. "), d))
        .when(code == 422, F.concat(F.lit("422: refused. "), d))
        .otherwise(F.concat(code.cast("string"), F.lit(": "), d))
    )


class _Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _PagesReader(DataSourceReader):
    def __init__(self, pages: list[str]):
        self.pages = pages

    def partitions(self) -> list[_Page]:
        return [_Page(p) for p in self.pages]

    def read(self, page: _Page):
        import json

        with open(page.path, encoding="utf-8") as f:
            for row in json.load(f):
                yield (row.get("filename"), row.get("patch"))


class ListingSource(DataSource):
    """Recorded pages of a change's file listing, one partition a page, in the
    order of option `pages` (comma-separated).  A page with fewer rows than
    `per_page` is the last.  Stands in for the network, which a plan never calls.
    """

    @classmethod
    def name(cls) -> str:
        return "change_listing"

    def schema(self) -> str:
        return "filename string, patch string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        import json

        kept, most = [], int(self.options.get("per_page", "100"))
        for p in filter(None, self.options.get("pages", "").split(",")):
            with open(p, encoding="utf-8") as f:
                n = len(json.load(f))
            if n:
                kept.append(p)
            if n < most:
                break
        return _PagesReader(kept)
