import json

from pyspark.sql import functions as F

from reviewlake.operators import evaluate, report
from reviewlake.plans import requests
from reviewlake.plans.review import Settings

DIFF = "--- /dev/null\n+++ b/app/a.py\n@@ -0,0 +1,2 @@\n+os.system(x)\n+print('x')\n"
COLUMNS = "request_id string, diff string, pr_title string, pr_url string, mode string, mock boolean, use_llm boolean, retrieval_backend string"


def test_requests_are_checked_and_answered(spark):
    rows = [
        ("r", DIFF, "T", "u", "rules", None, None, None), ("m", DIFF, None, None, None, True, None, "bm25"), ("e", "", "", "", None, None, None, None),
        ("l", DIFF, "", "", "live", None, None, None), ("t", DIFF, "x" * 301, "y" * 501, "rules", None, None, None), ("o", DIFF, "", "", "odd", None, None, "odd"), ("n", "nothing", "", "", "rules", None, None, None),
    ]
    answers, refusals = requests.answer(spark.createDataFrame(rows, COLUMNS))
    assert sorted({r["request_id"] for r in refusals.collect()}) == ["e", "l", "o", "t"] and refusals.filter("request_id = 't'").count() == 2
    got = {r["request_id"]: r for r in answers.collect()}
    assert {k: r["mode"] for k, r in got.items()} == {"r": "rules", "m": "mock", "n": "rules"} and got["m"]["stats"]["mode"] == "mock"
    assert {f["rule_id"] for f in got["r"]["findings"]} == {"SEC102", "CONV303"} and got["r"]["stats"]["llm_calls"] == 0
    assert got["m"]["stats"]["llm_calls"] == 1 and got["m"]["pr_title"] == "" and got["n"]["errors"] and not got["n"]["findings"]
    none, refused = requests.answer(spark.createDataFrame([], COLUMNS))
    assert none.count() == refused.count() == 0 and none.columns == answers.columns


def test_settings_are_read_once(monkeypatch):
    monkeypatch.setenv("MAX_FILES", "7")
    assert requests.current_settings(reload=True).max_files == 7
    monkeypatch.setenv("MAX_FILES", "8")
    assert requests.current_settings().max_files == 7 and requests.current_settings(reload=True).max_files == 8
    assert requests.settings_of({"MAX_FILES": "x", "MIN_SEVERITY": " HIGH "}) == Settings(min_severity="high")
    monkeypatch.delenv("MAX_FILES")
    requests.current_settings(reload=True)


def test_shares_and_case_table(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 2), (0, 0, 0)], "n_high int, n_medium int, n_low int")
    assert [tuple(r[0]) for r in df.select(report.shares()).collect()] == [(25.0, 25.0, 50.0), (None, None, None)]
    rows = [("a", False, True, ["x", "y"], ["y"], 2, 1, 1, True), ("b", True, False, [], [], 0, 0, 0, False)]
    res = evaluate.case_results(spark.createDataFrame(rows, "case_id string, negative boolean, heldout boolean, expect array<string>, got array<string>, rule_findings int, llm_findings int, dropped int, semantic boolean"))
    assert [r[0].split() for r in res.orderBy("case_id").select(evaluate.case_line()).collect()] == [["a", "2", "1", "1", "2", "1", "1", "yes", "[held", "out]"], ["b", *"000000", "-", "[clean]"]]
    evaluate.write_results(res, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/table")).count() == 2
    assert json.loads(spark.read.text(str(tmp_path / "out/summary")).first()[0])["hits"] == 1 and spark.read.json(str(tmp_path / "out/results")).filter(F.size("missed") == 1).count() == 1
