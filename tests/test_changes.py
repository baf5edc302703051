import urllib.parse

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import diff, gates, retrieve
from reviewlake.sources import changes, diffs


def test_details_and_diffs(spark):
    body = '{"title": "Add x", "html_url": "http://h/1", "head": {"sha": "abc"}}'
    rows = [("a", 1, 200, body), ("b", 2, 200, "{}"), ("c", 3, 404, body), ("d", 4, 200, "[1]"), ("e", 5, 200, "no json"), ("f", 6, None, None)]
    got = changes.change_details(spark.createDataFrame(rows, "change_id string, number int, status int, body string"))
    assert sorted(map(tuple, got.collect())) == [("a", "#1 Add x", "http://h/1", "abc"), ("b", "#2", "", "")]
    answers = [("a", changes.DIFF_MEDIA, 200, "--- a"), ("a", "application/json", 200, body), ("z", changes.DIFF_MEDIA, None, None), ("c", changes.DIFF_MEDIA, 500, "x")]
    texts = changes.media_diffs(spark.createDataFrame(answers, "change_id string, accept string, status int, body string"), got)
    assert sorted(map(tuple, texts.collect())) == [("a", "--- a", "#1 Add x", "http://h/1"), ("z", "", "", "")]


def test_paths(spark):
    names = ["a b/c.md", "~x*+%.md", "docs/è.md", "plain"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r[0] for r in df.select(changes.quoted_path(F.col("p"))).collect()] == [urllib.parse.quote(n) for n in names]
    wanted = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "d")], "change_id string, path string")
    probes = spark.createDataFrame([("c", "a", 200), ("c", "a", 200), ("c", "b", 404), ("e", "d", 200)], "change_id string, path string, status int")
    assert {r["path"]: r["there"] for r in changes.has_path(wanted, probes).collect()} == {"a": True, "b": False, "d": False}


def test_rpc_answers(spark):
    said = [
        "server starts", '{"id": 9, "result": {}}', '{"method": "note"}', "[1]", '{"id": 1, "result": {"tools": [{"name": "get_pr_diff"}, {"name": "x"}]}}',
        '{"id": 1, "result": {"tools": []}}', '{"id": 2, "error": {"message": "no"}}', "{broken",
    ]
    lines = spark.createDataFrame([("s", i, t) for i, t in enumerate(said)] + [("t", 0, None)], "session string, at int, line string")
    requests = spark.createDataFrame([("s", 1, "tools/list"), ("s", 2, "tools/call"), ("s", 3, "tools/call"), ("t", 1, "tools/list")], "session string, id long, method string")
    got = changes.rpc_answers(requests, lines)
    assert {(r["session"], r["id"]): r["status"] for r in got.collect()} == {("s", 1): "ok", ("s", 2): "error", ("s", 3): "no answer", ("t", 1): "no answer"}
    assert [tuple(r) for r in changes.listed_tools(got).collect()] == [("s", ["get_pr_diff", "x"])]


def test_source_and_guides(spark, tmp_path):
    tools, host = (lambda: "tools"), (lambda: "host")
    assert changes.diff_source({"MCP_GITHUB_SERVER_CMD": "run"}, tools, host) == "tools" and changes.diff_source({"MCP_GITHUB_SERVER_CMD": " "}, tools, host) == "host"
    repo, bundled = tmp_path / "repo", tmp_path / "bundled"
    (repo / "docs").mkdir(parents=True)
    bundled.mkdir()
    for n in ("b.md", "a.md", "c.txt"):
        (bundled / n).write_text("x")
    ask = lambda **x: changes.guide_paths(spark, repo=str(repo), bundled=str(bundled), **x)
    assert ask() == [str(bundled / "a.md"), str(bundled / "b.md")] and ask(explicit=["e"]) == ["e"]
    (repo / "docs/CONVENTIONS.md").write_text("x")
    assert ask() == [str(repo / "docs/CONVENTIONS.md")]
    (repo / "CONTRIBUTING.md").write_text("x")
    assert ask() == [str(repo / "CONTRIBUTING.md")] and changes.guide_paths(spark, bundled=str(tmp_path / "none")) == []


def test_vectors_are_added_once_for_each_instance(spark, tmp_path):
    path = str(tmp_path / "vectors")
    store = retrieve.bm25_store(spark, [], [("a", "# H\nfirst chunk, which is long enough"), ("b", "second chunk, which is long enough")])
    assert retrieve.vectors_of(spark, path, "one") is None
    assert [retrieve.add_vectors(store, path, "one"), retrieve.add_vectors(store, path, "one"), retrieve.add_vectors(store.filter("source = 'a'"), path, "two")] == [2, 0, 1]
    assert (retrieve.vectors_of(spark, path, "one").count(), retrieve.vectors_of(spark, path, "two").count()) == (2, 1)


def test_failing_vectors_leave_bm25(spark, monkeypatch):
    store = retrieve.bm25_store(spark, [], [("a", "never swallow errors without a word")])
    q = spark.createDataFrame([(1, "swallow errors")], "query_id int, text string")
    assert [retrieve.guarded(q, store, b)[1] for b in ("bm25", "hybrid")] == ["", ""]

    def fails(*_):
        raise RuntimeError("no vectors")

    monkeypatch.setattr(retrieve, "hashed_vectors", fails)
    hits, note = retrieve.guarded(q, store, "hybrid")
    assert hits.count() == 1 and "no vectors" in note
    hits, note = retrieve.guarded(q, store, "vector")
    assert hits.count() == 0 and "no vectors" in note
    with pytest.raises(ValueError):
        retrieve.guarded(q, store, "odd")


def test_source_filter(spark):
    rows = spark.createDataFrame([(1, "rule"), (2, "llm")], "finding_seq int, source string")
    assert [r[0] for r in gates.facets(rows, source="llm").collect()] == [2]


def test_pages_are_read_to_the_first_short_one(spark):
    file = '{"filename": "%s", "patch": "@@ -0,0 +1 @@\\n+x"}'
    two = lambda a, b: "[" + file % a + "," + file % b + "]"
    rows = [("d", 1, two("a", "b")), ("d", 2, '[{"path": "c", "diff": "@@ -0,0 +1 @@\\n+y"}]'), ("d", 3, two("e", "f")), ("g", 1, "[]"), ("g", 2, two("h", "i")), ("k", 1, "broken"), ("m", 1, None)]
    got = changes.listed_files(spark.createDataFrame(rows, "diff_id string, page int, body string"), per_page=2)
    assert [(r["diff_id"], r["filename"]) for r in got.orderBy("at").collect()] == [("d", "a"), ("d", "b"), ("d", "c")]
    assert [r["path"] for r in diff.parse_files(diffs.from_file_list(got)).collect()] == ["a", "b", "c"]
