import re

import pytest

from reviewlake.functions.text import comment_start, suffix_of
from reviewlake.operators import diff
from pyspark.sql import functions as F

ONE = """diff --git a/app/x.py b/app/x.py
index 11aa..22bb 100644
--- a/app/x.py
+++ b/app/x.py
@@ -1,4 +1,5 @@ def f
 import os
-old = 1
+new = 1
+more = 2
 z = 1
 y = 2
\\ No newline at end of file
"""


def files(spark, *texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "diff_id string, diff_text string")
    return diff.parse_files(df)


def lines(spark, text):
    got = diff.file_lines(files(spark, text)).orderBy("file_seq", "flat_idx").collect()
    return [(r["path"], r["kind"], r["text"], r["old_no"], r["new_no"]) for r in got]


def test_numbers_of_both_sides(spark):
    want = [(" ", "import os", 1, 1), ("-", "old = 1", 2, None), ("+", "new = 1", None, 2), ("+", "more = 2", None, 3), (" ", "z = 1", 3, 4), (" ", "y = 2", 4, 5), ("\\", "\\ No newline at end of file", None, None)]
    # The marker after the last counted line belongs to no hunk.
    assert lines(spark, ONE) == [("app/x.py", *w) for w in want[:-1]]
    inside = ONE.replace(" y = 2\n\\ No newline at end of file\n", "\\ No newline at end of file\n y = 2\n")
    assert [x[1] for x in lines(spark, inside)] == [" ", "-", "+", "+", " ", "\\", " "]
    assert lines(spark, ONE.replace("\n", "\r\n")) == lines(spark, ONE) == lines(spark, ONE.replace("\n", "\r"))


def test_new_deleted_binary_and_empty(spark):
    text = "--- /dev/null\n+++ b/n.js\n@@ -0,0 +1,2 @@\n+a\n+b\n--- a/gone.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\ndiff --git a/p.png b/p.png\nBinary files a/p.png and b/p.png differ\ndiff --git a/mode b/mode\nold mode 1\nnew mode 2\n"
    got = [(r["path"], r["is_new"], r["is_deleted"], r["is_binary"], r["suffix"]) for r in files(spark, text).orderBy("file_seq").collect()]
    assert got == [("n.js", True, False, False, ".js"), ("gone.py", False, True, False, ".py"), ("p.png", False, False, True, ".png")]
    assert files(spark, None, "", "just\nprose\n").count() == 0


def test_a_deleted_line_that_looks_like_a_header(spark):
    text = "--- a/q.sql\n+++ b/q.sql\n@@ -1,2 +1,1 @@\n--- old comment\n select\n--- a/r.sql\n+++ b/r.sql\n@@ -1 +1 @@\n-a\n+b\n"
    assert [(x[0], x[1], x[2]) for x in lines(spark, text)] == [("q.sql", "-", "-- old comment"), ("q.sql", " ", "select"), ("r.sql", "-", "a"), ("r.sql", "+", "b")]


def test_a_header_ends_a_hunk_that_promised_more(spark):
    text = "--- a/a\n+++ b/a\n@@ -1,9 +1,9 @@\n x\ndiff --git a/b b/b\n--- a/b\n+++ b/b\n@@ -0,0 +1 @@\n+y\n"
    assert [(x[0], x[2]) for x in lines(spark, text)] == [("a", "x"), ("b", "y")]
    # At the end of the text the last, empty line is taken for context.
    assert [x[2] for x in lines(spark, "--- a/a\n+++ b/a\n@@ -1,9 +1,9 @@\n x\n")] == ["x", ""]


def test_paths(spark):
    assert diff.plain_path('"a/with \\"quotes\\"\\t"') == 'with "quotes"\t' and diff.plain_path("b/x") == "x" and diff.plain_path(" dir/x ") == "dir/x"
    df = spark.createDataFrame([("a/b.PY",), ("a.b/c",), (".env",), ("x.",), ("d/e.tar.gz",)], "p string").select(suffix_of(F.col("p")))
    assert [r[0] for r in df.collect()] == [".py", "", ".env", ".", ".gz"]


def test_stats_index_and_targets(spark):
    text = ONE + "diff --git a/dist/o.js b/dist/o.js\n--- a/dist/o.js\n+++ b/dist/o.js\n@@ -0,0 +1 @@\n+x\n" + "".join(f"--- /dev/null\n+++ b/f{i}.py\n@@ -0,0 +1 @@\n+x\n" for i in range(4))
    f = files(spark, text)
    assert [tuple(r) for r in diff.diff_stats(f).collect()] == [("0", 6, 7, 1)]
    assert {(r["path"], r["line"]) for r in diff.added_index(diff.file_lines(f)).collect()} == {("app/x.py", 2), ("app/x.py", 3), ("dist/o.js", 1), *((f"f{i}.py", 1) for i in range(4))}
    assert [r["path"] for r in diff.review_targets(f, 3).orderBy("file_seq").collect()] == ["app/x.py", "f0.py", "f1.py"]


def test_rendering(spark):
    f = files(spark, ONE)
    show = lambda n: f.select(diff.render_file(F.col("path"), F.col("is_new"), F.col("is_deleted"), F.col("hunks"), F.col("lines"), n)).first()[0]
    assert show(None).split("\n") == ["### app/x.py", "@@ -1,4 +1,5 @@ def f", "1:  import os", "  -  old = 1", "2: +new = 1", "3: +more = 2", "4:  z = 1", "5:  y = 2"]
    assert show(2).split("\n") == ["### app/x.py", "@@ -1,4 +1,5 @@ def f", "1:  import os", "  -  old = 1", "... (cut)"]


def scanner(line, mark):
    quote, i = "", 0
    while i < len(line):
        if line[i] == "\\":
            i += 2
            continue
        if line[i] in "'\"" and quote in ("", line[i]):
            quote = "" if quote else line[i]
        elif not quote and line.startswith(mark, i):
            return i
        i += 1
    return None


@pytest.mark.parametrize(("suffix", "mark"), [(".py", "#"), (".js", "//"), (".sql", "--")])
def test_comment_start_agrees_with_a_scanner(spark, suffix, mark):
    import random

    rng = random.Random(7)
    texts = ["".join(rng.choice(["'", '"', "\\", "#", "/", "//", "-", "--", "a", " ", "😀"]) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", comment_start(F.col("t"), F.lit(suffix)).alias("c"))
    for r in df.collect():
        assert r["c"] == scanner(r["t"], mark), r["t"]
    assert df.select(comment_start(F.col("t"), F.lit(".md"))).filter("NOT isnull(`" + df.select(comment_start(F.col("t"), F.lit(".md"))).columns[0] + "`)").count() == 0


def test_split_points_do_not_change_the_result():
    """Pieces parsed apart give the files that the whole gives."""
    text = ONE + "--- a/m\n+++ b/m\n@@ -1 +1 @@\n-a\n+b\n" + ONE.replace("x.py", "y.py") + "diff --git broken\n"
    whole = diff.parse_piece(text)
    apart = [f for p in re.split(r"\n(?=diff --git a/[^\n]+? b/[^\n])", text) for f in diff.parse_piece(p)]
    assert whole == apart
