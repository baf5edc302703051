"""Unified diffs: text -> files -> numbered lines, and what is derived from them.

A `diff --git` header ends whatever came before it, even inside a hunk, so a text
is cut there first (in the JVM) and the pieces are parsed independently; only the
count-driven reading of hunks within a piece needs a state machine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.functions.text import any_of, suffix_of

GIT_HEADER = re.compile(r"^diff --git a/(?P<old>.+?) b/(?P<new>.+?)$")
HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$")
BINARY = re.compile(r"^Binary files .* differ$|^GIT binary patch$")

LINE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("old_no", T.IntegerType()), T.StructField("new_no", T.IntegerType()), T.StructField("hunk_seq", T.IntegerType())])
HUNK_TYPE = T.StructType([T.StructField("old_start", T.IntegerType()), T.StructField("old_len", T.IntegerType()), T.StructField("new_start", T.IntegerType()), T.StructField("new_len", T.IntegerType()), T.StructField("header", T.StringType())])
FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("old_path", T.StringType()), T.StructField("is_new", T.BooleanType()), T.StructField("is_deleted", T.BooleanType()), T.StructField("is_binary", T.BooleanType()), T.StructField("hunks", T.ArrayType(HUNK_TYPE)), T.StructField("lines", T.ArrayType(LINE))])


def plain_path(path: str) -> str:
    """A path without quotes, their escapes, and the side's prefix."""
    path = path.strip()
    if len(path) > 1 and path[0] == path[-1] == '"' or path == '"':
        path = path[1:-1]
        for shown, real in (("\\t", "\t"), ("\\n", "\n"), ('\\"', '"')):
            path = path.replace(shown, real)
    return path[2:] if path[:2] in ("a/", "b/") else path


class _Parser:
    """Reads one piece of a diff.  Outside hunks it looks for headers; a hunk
    lasts until both of its line counts are used up."""

    def __init__(self) -> None:
        self.files: list[dict] = []
        self.file: dict | None = None
        self.names: tuple[str | None, str | None] = (None, None)
        self.left: list[int] | None = None  # lines to come on the old and the new side
        self.at = [0, 0]

    def close(self) -> None:
        f = self.file
        if f is not None and (f["hunks"] or f["is_new"] or f["is_deleted"] or f["is_binary"]):
            self.files.append(f)
        self.file, self.names, self.left = None, (None, None), None

    def open(self, path: str) -> dict:
        self.file = {"path": path, "old_path": None, "is_new": False, "is_deleted": False, "is_binary": False, "hunks": [], "lines": []}
        return self.file

    def current(self) -> dict:
        return self.file or self.open(plain_path(self.names[1] or self.names[0] or "unknown"))

    def read(self, raw: str) -> None:
        if m := GIT_HEADER.match(raw):
            self.close()
            self.names = (plain_path(m["old"]), plain_path(m["new"]))
        elif self.left is not None:
            self.body(raw)
        elif raw.startswith("--- "):
            self.close()
            self.names = (raw[4:].strip(), None)
        elif raw.startswith("+++ "):
            self.new_side(raw[4:].strip())
        elif BINARY.match(raw):
            self.current()["is_binary"] = True
        elif m := HUNK.match(raw):
            start = [int(m[1]), int(m[3])]
            size = [1 if m[i] is None else int(m[i]) for i in (2, 4)]
            self.current()["hunks"].append({"old_start": start[0], "old_len": size[0], "new_start": start[1], "new_len": size[1], "header": m[5].strip()})
            self.at, self.left = start, size if max(size) > 0 else None

    def new_side(self, name: str) -> None:
        old = self.names[0]
        gone = name == "/dev/null"
        f = self.open(plain_path(name if name and not gone else old or self.names[1] or "unknown"))
        f["is_deleted"] = gone
        if old is not None:
            f["is_new"] = old.strip() == "/dev/null"
            f["old_path"] = plain_path(old) if old and not f["is_new"] else None

    def body(self, raw: str) -> None:
        kind = raw[:1] if raw[:1] in ("+", "-", "\\") else " "
        sides = {"+": (1,), "-": (0,), "\\": ()}.get(kind, (0, 1))
        text = raw if kind == "\\" else raw[1:] if raw[:1] == kind else raw
        self.file["lines"].append({"kind": kind, "text": text, "old_no": self.at[0] if 0 in sides else None, "new_no": self.at[1] if 1 in sides else None, "hunk_seq": len(self.file["hunks"]) - 1})
        for side in sides:
            self.at[side] += 1
            self.left[side] -= 1
        if sides and max(self.left) <= 0:
            self.left = None


def parse_piece(text: str | None) -> list[dict]:
    parser = _Parser()
    for raw in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n") if text else ():
        parser.read(raw)
    parser.close()
    return parser.files


@F.arrow_udf(T.ArrayType(FILE))
def _parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    line = pa.struct([("kind", pa.string()), ("text", pa.string()), ("old_no", pa.int32()), ("new_no", pa.int32()), ("hunk_seq", pa.int32())])
    hunk = pa.struct([("old_start", pa.int32()), ("old_len", pa.int32()), ("new_start", pa.int32()), ("new_len", pa.int32()), ("header", pa.string())])
    kind = pa.list_(pa.struct([("path", pa.string()), ("old_path", pa.string()), ("is_new", pa.bool_()), ("is_deleted", pa.bool_()), ("is_binary", pa.bool_()), ("hunks", pa.list_(hunk)), ("lines", pa.list_(line))]))
    for batch in batches:
        yield pa.array([parse_piece(x.as_py()) for x in batch], kind)


def parse_files(diffs: DataFrame, text: str = "diff_text") -> DataFrame:
    """diffs(diff_id, diff_text) -> a row a file, with its hunks and lines nested.

    file_seq numbers a diff's files in order; it grows but may skip numbers, as
    pieces are parsed apart.  Null, empty and unreadable texts give no file.
    """
    flat = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?", "\n")
    # A header with a path on both sides; the line feed before it goes to neither piece.
    pieces = F.split(flat, r"\n(?=diff --git a/[^\n]+? b/[^\n])", -1)
    cut = diffs.select("diff_id", F.posexplode(pieces).alias("piece", "piece_text")).filter(F.col("piece_text") != "")
    files = cut.select("diff_id", "piece", F.posexplode(_parsed("piece_text")).alias("k", "file"))
    # A piece without its header has one file a header line at most.
    return files.select("diff_id", (F.col("piece").cast("long") * 1_000_000 + F.col("k")).alias("file_seq"), "file.*").withColumn("suffix", suffix_of(F.col("path")))


def file_lines(files: DataFrame) -> DataFrame:
    """A row a line of parse_files' result, numbered in its file by flat_idx."""
    each = files.select("diff_id", "file_seq", "path", "suffix", F.posexplode("lines").alias("flat_idx", "l"))
    return each.select("diff_id", "file_seq", "path", "suffix", "flat_idx", "l.hunk_seq", "l.kind", "l.text", "l.old_no", "l.new_no")


def n_lines(lines: Column, kind: str) -> Column:
    return F.size(F.filter(lines, lambda x: x["kind"] == kind)).cast("long")


def with_counts(files: DataFrame) -> DataFrame:
    return files.withColumns({"added": n_lines(F.col("lines"), "+"), "removed": n_lines(F.col("lines"), "-")})


def diff_stats(files: DataFrame) -> DataFrame:
    """Files, added and removed lines of each diff."""
    return with_counts(files).groupBy("diff_id").agg(F.count(F.lit(1)).alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))


def added_index(lines: DataFrame) -> DataFrame:
    """The places a finding may point at."""
    return lines.filter((F.col("kind") == "+") & F.col("new_no").isNotNull()).select("diff_id", "path", F.col("new_no").alias("line")).distinct()


def line_texts(lines: DataFrame, places: DataFrame) -> DataFrame:
    """places(diff_id, path, line) with the text of the added line there."""
    added = lines.filter(F.col("kind") == "+").select("diff_id", "path", F.col("new_no").alias("line"), "text")
    return places.join(added, ["diff_id", "path", "line"])


def with_frame(lines: DataFrame, radius: int) -> DataFrame:
    """Adds frame, the lines up to radius before and after in the file (deleted
    ones and markers too), as structs, and frame_lo, the place of the first."""
    near = Window.partitionBy("diff_id", "file_seq").orderBy("flat_idx").rowsBetween(-radius, radius)
    return lines.withColumn("frame", F.collect_list(F.struct("text", "kind", "new_no")).over(near)).withColumn("frame_lo", F.greatest(F.col("flat_idx") - radius, F.lit(0)))


# What is not written by people.
SKIP_SUFFIXES = (".lock", ".min.js", ".min.css", ".map", ".svg", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".pdf", ".zip", ".jar", ".pyc", ".class", ".so", ".dll", ".exe", ".snap")
SKIP_PARTS = ("node_modules/", "vendor/", "dist/", "build/", "target/", ".venv/", "venv/", "__pycache__/", "package-lock.json", "poetry.lock", "yarn.lock", "pnpm-lock.yaml", "go.sum", "third_party/", "generated/")


def skip_reason(path: Column, is_binary: Column, is_deleted: Column, added: Column) -> Column:
    """Why a file isn't reviewed, the first reason that holds; null if it is."""
    low = F.lower(path)
    return (
        F.when(is_binary, "binary")
        .when(is_deleted, "deleted")
        .when(added == 0, "no-added-lines")
        .when(any_of([F.endswith(low, F.lit(s)) for s in SKIP_SUFFIXES]), "generated-or-binary-suffix")
        .when(any_of([F.contains(low, F.lit(s)) for s in SKIP_PARTS]), "vendored")
    )


def review_targets(files: DataFrame, max_files: int = 60) -> DataFrame:
    """The first max_files files of each diff that aren't skipped."""
    kept = with_counts(files).withColumn("_why", skip_reason(F.col("path"), F.col("is_binary"), F.col("is_deleted"), F.col("added"))).filter(F.col("_why").isNull()).drop("_why")
    order = Window.partitionBy("diff_id").orderBy("file_seq")
    return kept.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_files).drop("_n")


def render_file(path: Column, is_new: Column, is_deleted: Column, hunks: Column, lines: Column, max_lines: int | None = None) -> Column:
    """A file as text: a title, each hunk's header, its lines with numbers; cut
    with a notice after max_lines lines."""
    shown = F.filter(lines, lambda x: x["kind"] != "\\")
    whole = F.size(shown)
    if max_lines is not None:
        shown = F.slice(shown, 1, max_lines)
    head = lambda h: F.rtrim(F.format_string("@@ -%d,%d +%d,%d @@ %s", h["old_start"], h["old_len"], h["new_start"], h["new_len"], h["header"]))
    line = lambda x: F.concat(F.coalesce(F.concat(x["new_no"].cast("string"), F.lit(":")), F.lit("  -")), F.lit(" "), F.when(x["kind"] == "-", " ").otherwise(x["kind"]), x["text"])
    parts = F.flatten(F.transform(hunks, lambda h, i: F.concat(F.array(head(h)), F.transform(F.filter(shown, lambda x: x["hunk_seq"] == i), line))))
    title = F.array(F.concat(F.lit("### "), path))
    marks = F.array_compact(F.array(F.when(is_new, "(new file)"), F.when(is_deleted, "(deleted file)")))
    notice = F.when(whole >= (max_lines if max_lines is not None else 1 << 30), F.array(F.lit("... (cut)"))).otherwise(F.array().cast("array<string>"))
    if max_lines is not None:  # hunks after the cut don't appear
        last = F.array_max(F.transform(shown, lambda x: x["hunk_seq"]))
        parts = F.when(whole >= max_lines, F.flatten(F.transform(F.slice(hunks, F.lit(1), F.coalesce(last, F.lit(-1)) + 1), lambda h, i: F.concat(F.array(head(h)), F.transform(F.filter(shown, lambda x: x["hunk_seq"] == i), line))))).otherwise(parts)
    return F.array_join(F.concat(title, marks, parts, notice), "\n")
