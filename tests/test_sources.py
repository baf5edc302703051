import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import diff
from reviewlake.sources import diffs, settings, sinks


def test_diff_and_document_files(spark, tmp_path):
    (tmp_path / "a.diff").write_bytes(b"--- a/x\n+++ b/x\n@@ -0,0 +1 @@\n+caf\xe9\n")
    got = diffs.diff_files(spark, str(tmp_path)).first()
    assert got["pr_url"].endswith("a.diff") and "caf" in got["diff_text"]
    assert diff.parse_files(diffs.diff_files(spark, str(tmp_path))).count() == 1
    (tmp_path / "b.md").write_text("# B\ntext")
    (tmp_path / "a.md").write_text("# A\ntext")
    found = diffs.doc_files(spark, [str(tmp_path / n) for n in ("b.md", "missing.md", "a.md")]).orderBy("doc_ord").collect()
    assert [r["text"][:3] for r in found] == ["# B", "# A"] and diffs.doc_files(spark, ["/missing"]).count() == 0
    assert diffs.inline_diff(spark, "x").count() == 1 and diffs.inline_docs(spark, [("", "t")]).first()["source"] == "inline"


def test_local_diff(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    for text in ("one\n", "one\ntwo\n"):
        (tmp_path / "f.py").write_text(text)
        git("add", "."), git("commit", "-qm", "c")
    text = diffs.local_diff(str(tmp_path))
    assert "+two" in text and text == diffs.local_diff(str(tmp_path), "HEAD~1..HEAD")
    assert tuple(diff.diff_stats(diff.parse_files(diffs.inline_diff(spark, text))).first()) == ("inline", 1, 1, 0)


def test_made_and_listed_diffs(spark):
    rows = [("d", "a.py", "x\ny", "x\nz\n"), ("d", "b.py", None, "new"), ("d", "c.py", "same", "same\n"), ("e", "c.py", "same", "same")]
    made = diffs.made_diffs(spark.createDataFrame(rows, "diff_id string, path string, before string, after string"))
    assert [tuple(r) for r in diff.diff_stats(diff.parse_files(made)).collect()] == [("d", 2, 2, 1)]
    listing = spark.createDataFrame([("d", 1, "p.py", "@@ -0,0 +1 @@\n+x"), ("d", 2, "q.py", None)], "diff_id string, at int, filename string, patch string")
    assert [r["path"] for r in diff.parse_files(diffs.from_file_list(listing)).collect()] == ["p.py"]


def test_references_payloads_and_errors(spark):
    texts = ["o/r#12", " o.x/r-y/3 ", "see https://h.example/o/r/pull/7/files", "o/r", "", None]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(diffs.change_ref(F.col("t"))).collect()]
    assert got == [("o", "r", 12), ("o.x", "r-y", 3), ("o", "r", 7), None, None, None]
    parts = spark.createDataFrame([([("text", "a"), ("image", "b"), ("text", ""), ("text", "c")], "s"), ([], "s"), (None, None)], "c array<struct<type:string,text:string>>, s string")
    assert [r[0] for r in parts.select(diffs.tool_payload(F.col("c"), F.col("s"))).collect()] == ["a\nc", "s", None]
    codes = spark.createDataFrame([(c,) for c in (200, 404, 500)], "c int").select(diffs.http_error(F.col("c"), F.lit("/p"), F.lit("d")))
    assert [r[0] and r[0][:4] for r in codes.collect()] == [None, "404:", "500:"]
    assert diffs.chosen_tool(["x", "get_pr_diff"]) == "get_pr_diff" and diffs.chosen_tool(["read_pull_request_files"]) == "read_pull_request_files"
    with pytest.raises(LookupError):
        diffs.chosen_tool(["nothing"])
    assert diffs.tool_arguments(["pullNumber"], ["owner"], "o", "r", 3) == {"owner": "o", "pullNumber": 3} and diffs.tool_arguments([], [], "o", "r", 3) == {"owner": "o", "repo": "r", "pull_number": 3}


def test_listing_source(spark, tmp_path):
    pages = []
    for i, n in enumerate((2, 1, 2)):
        p = tmp_path / f"{i}.json"
        p.write_text(json.dumps([{"filename": f"f{i}{k}", "patch": "+"} for k in range(n)]))
        pages.append(str(p))
    spark.dataSource.register(diffs.ListingSource)
    got = spark.read.format("change_listing").option("pages", ",".join(pages)).option("per_page", "2").load()
    assert sorted(r["filename"] for r in got.collect()) == ["f00", "f01", "f10"]  # the short page is the last


def test_gold_labels(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"cases": [{"id": "a", "title": "t", "negative": False, "heldout": True, "expect_rules": ["R"], "expect_semantic": ["s"], "patch": "p"}, {"id": "b", "negative": True, "expect_rules": []}]}, indent=1))
    got = {r["case_id"]: r for r in diffs.gold_labels(spark, str(tmp_path / "l.json")).collect()}
    assert got["a"]["semantic"] and got["a"]["heldout"] and not got["b"]["semantic"] and got["b"]["heldout"] is False


def test_settings(spark, tmp_path, monkeypatch):
    text = "# c\nexport A='x y'\nB=\"q\"\n\nbad line\nC= 3 \nD='\n"
    assert settings.dotenv(text) == {"A": "x y", "B": "q", "C": "3", "D": "'"}
    monkeypatch.setenv("C", "kept")
    monkeypatch.delenv("A", raising=False), monkeypatch.delenv("B", raising=False), monkeypatch.delenv("D", raising=False)
    (tmp_path / ".env").write_text(text)
    assert settings.load_dotenv(tmp_path / ".env") == 3 and os.environ["C"] == "kept" and settings.load_dotenv(tmp_path / "no") == 0
    for k in "ABD":
        monkeypatch.delenv(k)
    df = spark.createDataFrame([(0, " Yes "), (1, "0"), (2, ""), (3, None), (4, " 7 "), (5, "1.5")], "i int, t string").orderBy("i")
    got = df.select(settings.as_bool(F.col("t"), True), settings.as_int(F.col("t"), -1), settings.as_float(F.col("t"), -1.0)).collect()
    assert [r[0] for r in got] == [True, False, True, True, False, False] and [r[1] for r in got][:5] == [-1, 0, -1, -1, 7] and [r[2] for r in got][4:] == [7.0, 1.5]
    modes = {(m, u): "live" if (m, u) in ((False, None), (None, True), (False, True)) else "mock" if m and u is not False else "rules" if u is False else "given" for m in (True, False, None) for u in (True, False, None)}
    rows = spark.createDataFrame([(m, u) for m, u in modes], "m boolean, u boolean").select("m", "u", settings.mode(F.col("m"), F.col("u"), F.lit("given")).alias("r")).collect()
    assert {(r["m"], r["u"]): r["r"] for r in rows} == modes
    req = spark.createDataFrame([(1, "d", "rules", "bm25"), (2, "", "odd", "odd"), (3, None, None, None)], "request_id int, diff string, mode string, retrieval_backend string")
    assert sorted((r["request_id"], r["problem"].split()[0]) for r in settings.request_problems(req).collect()) == [(2, "diff"), (2, "unknown"), (2, "unknown"), (3, "diff")]
    assert settings.validated(spark, {"LLM_API_KEY": "short", "LLM_BASE_URL": "ftp:", "SHARD_MAX_CHARS": "10"}).count() == 3 and settings.validated(spark, {}, need_llm=False).count() == 0


def test_posting(spark):
    df = spark.createDataFrame([("d", "a", 1, "RIGHT", "x"), ("d", "bad", 2, "RIGHT", "y"), ("e", "a", 1, "RIGHT", "z")], "diff_id string, path string, line int, side string, body string")

    def send(_, comments):
        if any(c["path"] == "bad" for c in comments):
            raise ValueError("422")

    assert {tuple(r) for r in sinks.tally(sinks.post(df, send)).collect()} == {("d", 1, 1), ("e", 1, 0)}
    assert sinks.dry_run(df).count() == 3


def test_retries():
    class Failed(Exception):
        def __init__(self, status):
            self.status = status

    pauses, left = [], [429, 500]

    def call():
        if left:
            raise Failed(left.pop())
        return "ok"

    assert sinks.with_retries(call, sleep=pauses.append, spread=lambda: 1.0) == "ok" and pauses == [0.8, 1.6]
    with pytest.raises(Failed):
        sinks.with_retries(lambda: (_ for _ in ()).throw(Failed(401)), sleep=pauses.append)
    assert len(pauses) == 2
    left, pauses = [524], []
    assert sinks.with_retries(call, sleep=pauses.append) == "ok" and 0.4 <= pauses[0] <= 0.8


def test_documents_are_read_by_their_whole_path(spark, tmp_path):
    names = ["docs/a.md", "x/docs/a.md", "sp ace/b c.md", "odd[1]{x}.md"]
    for i, n in enumerate(names):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(f"text {i}")
    found = diffs.doc_files(spark, [str(tmp_path / n) for n in (*names, names[0])]).collect()
    assert sorted((r["doc_ord"], r["text"]) for r in found) == [(i, f"text {i}") for i in range(4)]
