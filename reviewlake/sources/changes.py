"""Recorded answers of a code host or a tool server, read as tables.

No plan calls the network: answers are recorded first, a row each, so a lost
executor reads them again instead of asking again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The media type of a diff, and a repository's own guides in the order they are tried.
DIFF_MEDIA = "application/vnd.github.v3.diff"
OWN_GUIDES = ("CONTRIBUTING.md", "CODE_STYLE.md", "docs/CONVENTIONS.md", ".editorconfig")


def change_details(answers: DataFrame) -> DataFrame:
    """answers(change_id, number, status, body) -> (change_id, pr_title, pr_url,
    head_sha), where body is a change's JSON.

    A missing title, address or sha is empty; answers of 400 and above and bodies
    that aren't JSON objects give no row."""
    good = answers.filter((F.coalesce("status", F.lit(200)) < 400) & F.schema_of_variant(F.try_parse_json("body")).startswith("OBJECT"))
    part = lambda path: F.coalesce(F.get_json_object("body", path), F.lit(""))
    title = F.trim(F.concat(F.lit("#"), F.col("number").cast("string"), F.lit(" "), part("$.title")))
    return good.select("change_id", title.alias("pr_title"), part("$.html_url").alias("pr_url"), part("$.head.sha").alias("head_sha"))


def media_diffs(answers: DataFrame, details: DataFrame) -> DataFrame:
    """answers(change_id, accept, status, body) -> diffs: the bodies that were asked
    for as diffs, with their change's title and address (empty without one)."""
    texts = answers.filter((F.col("accept") == DIFF_MEDIA) & (F.coalesce("status", F.lit(200)) < 400)).select("change_id", F.coalesce("body", F.lit("")).alias("diff_text"))
    named = texts.join(details.select("change_id", "pr_title", "pr_url"), "change_id", "left")
    return named.select(F.col("change_id").alias("diff_id"), "diff_text", *(F.coalesce(c, F.lit("")).alias(c) for c in ("pr_title", "pr_url")))


def listed_files(pages: DataFrame, per_page: int = 100) -> DataFrame:
    """pages(diff_id, page, body) -> listing(diff_id, at, filename, patch), as
    `from_file_list` takes it; body is a page's JSON array.

    Pages are read up to the first of fewer than per_page files, an empty one or one
    that is no array counting as such.  A file without filename or patch has its
    path or diff instead."""
    files = F.from_json("body", "array<struct<filename string, path string, patch string, diff string>>")
    each = pages.select("diff_id", "page", files.alias("_files")).withColumn("_short", (F.coalesce(F.size("_files"), F.lit(0)) < per_page).cast("int"))
    before = Window.partitionBy("diff_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    kept = each.withColumn("_ended", F.coalesce(F.max("_short").over(before), F.lit(0))).filter(F.col("_ended") == 0)
    rows = kept.select("diff_id", "page", F.posexplode("_files").alias("_no", "f"))
    at = F.struct("page", "_no").alias("at")
    return rows.select("diff_id", at, F.coalesce("f.filename", "f.path").alias("filename"), F.coalesce("f.patch", "f.diff").alias("patch"))


def quoted_path(path: Column) -> Column:
    """A path as part of an address: all but letters, digits, `_.-~/` in per cent."""
    out = F.url_encode(path)
    for java, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(java), F.lit(plain))
    return out


def has_path(wanted: DataFrame, probes: DataFrame) -> DataFrame:
    """wanted(change_id, path) with there: whether a probe(change_id, path, status)
    below 400 was recorded; an error, or no probe, is false."""
    hits = probes.filter(F.col("status") < 400).select("change_id", "path", F.lit(True).alias("there")).distinct()
    return wanted.select("change_id", "path").join(hits, ["change_id", "path"], "left").withColumn("there", F.coalesce("there", F.lit(False)))


def rpc_answers(requests: DataFrame, lines: DataFrame) -> DataFrame:
    """requests(session, id, method) with what lines(session, at, line) of a server
    answer: (session, id, method, status, result, error).

    Lines that aren't JSON objects are noise, and messages of other ids or without
    one are passed over; the first answer counts.  status is `ok`, `error` (the
    server says so) or `no answer` (a timeout, or the server has ended)."""
    said = lines.withColumn("_v", F.try_parse_json("line")).filter(F.schema_of_variant("_v").startswith("OBJECT"))
    each = said.select("session", "at", F.try_variant_get("_v", "$.id", "long").alias("id"), *(F.get_json_object("line", f"$.{c}").alias(c) for c in ("result", "error")))
    first = each.filter(F.col("id").isNotNull()).groupBy("session", "id").agg(F.min_by(F.struct("result", "error"), "at").alias("_a"))
    status = F.when(F.col("_a").isNull(), "no answer").when(F.col("_a.error").isNotNull(), "error").otherwise("ok")
    return requests.join(first, ["session", "id"], "left").select("session", "id", "method", status.alias("status"), "_a.result", "_a.error")


def listed_tools(answers: DataFrame) -> DataFrame:
    """(session, tools) of each session's first answered `tools/list`, which holds for the session."""
    good = answers.filter((F.col("method") == "tools/list") & (F.col("status") == "ok")).groupBy("session").agg(F.min_by("result", "id").alias("result"))
    names = F.from_json("result", "tools array<struct<name string>>")["tools"]["name"]
    return good.select("session", F.coalesce(names, F.array().cast("array<string>")).alias("tools"))


def diff_source(values: Mapping[str, str], tools: Callable[[], DataFrame], host: Callable[[], DataFrame]) -> DataFrame:
    """Diffs from the tool server where the settings name its command, else from the host."""
    return (tools if values.get("MCP_GITHUB_SERVER_CMD", "").strip() else host)()


def guide_paths(spark: SparkSession, explicit: list[str] = (), repo: str = "", bundled: str = "") -> list[str]:
    """Which guides hold: those given; else the first of OWN_GUIDES that the
    repository has; else the `*.md` of the bundled folder, by name."""
    if explicit:
        return list(explicit)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def at(path: str):
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(conf), place

    for name in OWN_GUIDES if repo else ():
        fs, place = at(f"{repo.rstrip('/')}/{name}")
        if fs.exists(place) and fs.getFileStatus(place).isFile():
            return [f"{repo.rstrip('/')}/{name}"]
    if bundled:
        fs, place = at(bundled)
        if fs.exists(place) and fs.getFileStatus(place).isDirectory():
            names = (s.getPath().getName() for s in fs.listStatus(place) if s.isFile())
            return [f"{bundled.rstrip('/')}/{n}" for n in sorted(names) if n.endswith(".md")]
    return []
