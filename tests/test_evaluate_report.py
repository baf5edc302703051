import json

from pyspark.sql import functions as F

from reviewlake.operators import evaluate, report
from reviewlake.plans.review import Settings, mock_responder, review
from reviewlake.sources.diffs import DIFFS

DIFF = "--- /dev/null\n+++ b/app/a.py\n@@ -0,0 +1,4 @@\n+os.system(x)\n+r = requests.get(u)\n+password = \"0123456789ab\"\n+print('x')\n--- a/vendor/v.py\n+++ b/vendor/v.py\n@@ -0,0 +1 @@\n+eval(x)\n"


def reviewed(spark, responder=None, **options):
    df = spark.createDataFrame([("d", DIFF, "Title", "http://u"), ("none", "", "", ""), ("skip", "--- a/x\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\n", None, None)], DIFFS)
    return review(df, Settings(**options), responder=responder)


def test_case_sets_and_metrics(spark):
    rows = [("a", False, False, ["x", "y", "y"], ["y", "z"], 2, 1, 1, True), ("b", False, True, ["x"], [], 0, 0, 1, True), ("c", True, False, [], ["q"], 1, 0, 0, False), ("d", True, False, [], [], 0, 0, 0, False)]
    df = spark.createDataFrame(rows, "case_id string, negative boolean, heldout boolean, expect array<string>, got array<string>, rule_findings int, llm_findings int, dropped int, semantic boolean")
    res = evaluate.case_results(df)
    assert [tuple(r) for r in res.filter("case_id = 'a'").select("hit", "missed", "extra").collect()] == [(["y"], ["x"], ["z"])]
    m = evaluate.summary(res).first()
    assert (m["expected"], m["hits"], m["rule_recall"], m["tuned_recall"], m["heldout_recall"]) == (3, 1, 0.3333, 0.5, 0.0)
    assert (m["false_positive_findings"], m["false_positive_cases"], m["anchor_valid_rate"], m["semantic_rate"], m["over_report_count"], m["rule_misses"]) == (1, 1, round(1 / 3, 4), 0.5, 1, "x")
    m = evaluate.summary(res.limit(0)).first()
    assert (m["cases"], m["rule_recall"], m["anchor_valid_rate"], m["semantic_rate"]) == (0, 0.0, 1.0, None)


def test_review_with_rules_alone(spark):
    done = reviewed(spark)
    assert {(r["rule_id"], r["line"]) for r in done.findings.collect()} == {("SEC102", 1), ("SEC103", 3), ("CONV303", 4)}
    assert {(r["diff_id"], r["error"]) for r in done.errors.collect()} == {("none", "the diff is empty or can't be read"), ("skip", "no added lines to review")}
    s = done.bundled().filter("diff_id = 'd'").first()
    assert (s["files"], s["added_lines"], s["rule_findings"], s["shards"], s["total"], s["block"]) == (1, 4, 3, 0, 3, True)
    assert reviewed(spark, min_severity="high", max_findings_per_file=1).findings.count() == 1


def test_review_with_a_responder(spark):
    s = reviewed(spark, mock_responder).bundled().filter("diff_id = 'd'").first()
    assert (s["llm_calls"], s["llm_findings"], s["shards"], s["dropped_unanchored"]) == (1, 1, 1, 0) and s["total_tokens"] > 0

    def liar(asked):
        text = '{"findings":[{"line":1,"category":"security","severity":"low","title":"same"},{"line":99},{"line":null}]}'
        return asked.select("diff_id", "shard_no", F.lit(text).alias("text"), F.lit(5).cast("long").alias("prompt_tokens"), F.lit(7).cast("long").alias("completion_tokens"))

    done = reviewed(spark, liar)
    both = done.findings.filter("line = 1").first()
    assert both["rule_id"] == "SEC102" and both["corroborated"] and abs(both["confidence"] - 0.95) < 1e-9 and both["alt_titles"] == ["Command run through a shell", "same"]
    s = done.bundled().filter("diff_id = 'd'").first()
    assert (s["dropped_unanchored"], s["merged_duplicates"], s["total_tokens"]) == (2, 1, 12)
    silent = reviewed(spark, lambda asked: liar(asked).limit(0))
    assert "no answer for app/a.py" in {r["error"] for r in silent.errors.collect()}


def test_reports(spark, tmp_path):
    b = reviewed(spark, mock_responder).bundled().cache()
    one, none = b.filter("diff_id = 'd'"), b.filter("diff_id = 'none'")
    text = one.select(report.markdown("now")).first()[0]
    assert "**Generated**: now" in text and "## Verdict: blocked" in text and "## Security (2)" in text and "`app/a.py:1`" in text and text.index("## Security") < text.index("## Convention")
    assert "## Nothing found" in none.select(report.markdown()).first()[0] and "- the diff is empty" in none.select(report.markdown()).first()[0]
    assert "... and 1 more" in one.select(report.markdown(most=1)).first()[0]
    short = one.select(report.pr_comment(most=2)).first()[0]
    assert short.count("\n- **") == 2 and "and 2 more" in short
    assert one.select(report.summary_line()).first()[0].startswith("[review] blocked | 4 findings (high 2 / medium 1 / low 1)")
    loaded = json.loads(one.select(report.json_report()).first()[0])
    assert loaded["verdict"] == {"block": True, "total": 4, "by_severity": {"high": 2, "medium": 1, "low": 1, "info": 0}} and all(f["actionable"] for f in loaded["findings"]) and loaded["stats"]["files"] == 1
    assert "Nothing found" in none.select(report.console()).first()[0] and "SEC102" in one.select(report.console()).first()[0]
    rows = report.comments(b).collect()
    assert {(r["path"], r["side"]) for r in rows} == {("app/a.py", "RIGHT")} and all("> Evidence:" in r["body"] for r in rows)
    assert [r[0] for r in spark.range(1).select(report.event(F.lit(True), True)).collect()] == ["REQUEST_CHANGES"]
    report.write_reports(b, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/text")).count() == 3 and spark.read.json(str(tmp_path / "out/json")).count() == 3
