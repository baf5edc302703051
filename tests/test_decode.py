import pytest
from pyspark.sql import functions as F

from reviewlake.operators import decode


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a":1}', '{"a":1}'),
        ("  [1,2] ", "[1,2]"),
        ('words ```json\n{"a":1}\n``` more', '{"a":1}'),
        ('```\nnot json\n``` then ```JSON {"b":2}```', '{"b":2}'),
        ('Here: {"findings": [{"line": 3}]} ok', '{"findings":[{"line":3}]}'),
        ('x [1,2,] y', "[1,2]"),
        ('{"a":[1,],}', '{"a":[1]}'),
        ('first [1] then {"a":1}', "[1]"),
        ("null", None),
        ("nothing", None),
        ("", None),
        (None, None),
        ("} {", None),
        ("[1", None),
    ],
)
def test_cascade(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(F.to_json(decode.parsed(F.col("t")))).first()[0]
    assert got == want


def coerced(spark, *texts):
    answers = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "diff_id string, shard_no int, text string")
    shards = spark.createDataFrame([("d", i, f"f{i}.py", [1, 2]) for i in range(len(texts))], "diff_id string, shard_no int, file string, line_numbers array<int>")
    return decode.coerced(answers, shards).orderBy("finding_seq").collect()


def test_fields(spark):
    got = coerced(spark, '{"findings":[{"line":2,"title":" a ","category":" Security ","severity":"HIGH","evidence":" e ","confidence":7,"file":"other"},{"line":"1"},{"line":2.9,"confidence":"0.25","severity":"worst","category":"odd"},{"line":"x"},{"line":true},{"line":9,"confidence":null},7,"s"]}')
    assert [(r["line"], r["anchors_ok"]) for r in got] == [(2, True), (1, True), (2, True), (None, False), (1, True), (9, False)]
    a = got[0]
    assert (a["rule_id"], a["title"], a["category"], a["severity"], a["sev_rank"], a["file"], a["evidence"], a["confidence"], a["source"]) == ("LLM-SEC", "a", "security", "high", 0, "f0.py", "e", 1.0, "llm")
    b = got[2]
    assert (b["rule_id"], b["title"], b["category"], b["severity"], b["confidence"]) == ("LLM-CON", decode.TITLE, "convention", "low", 0.25)
    assert got[1]["confidence"] == 0.5 == got[5]["confidence"]


def test_shapes_and_limits(spark):
    got = coerced(spark, '{"findings":[],"comments":[{"line":1}]}', '[{"line":1},[2]]', '{"other":1}', "no json", '{"findings":{"line":1}}', '[{"title":"%s","suggestion":"%s"}]' % ("é" * 100, "s" * 600))
    assert [(r["file"], r["line"]) for r in got] == [("f0.py", 1), ("f1.py", 1), ("f5.py", None)]
    assert (len(got[2]["title"]), len(got[2]["suggestion"])) == (80, 500)
    answers = spark.createDataFrame([("d", 0, "no json"), ("d", 1, "[]")], "diff_id string, shard_no int, text string")
    assert [r["shard_no"] for r in decode.unreadable(answers).collect()] == [0]


def test_findings_that_are_no_list_hide_comments(spark):
    """What is said in `findings` counts, even if it is no list; what counts as nothing gives way to `comments`."""
    texts = ['{"findings":%s,"comments":[{"line":2}]}' % x for x in ('"none"', '{"a":1}', "3", "true", "null", '""', "0", "0.0", "false", "{}", "[]")]
    assert [r["file"] for r in coerced(spark, *texts)] == [f"f{i}.py" for i in range(4, 11)]
    assert [r["confidence"] for r in coerced(spark, '[{"confidence":true},{"confidence":false},{"confidence":"x"}]')] == [1.0, 0.0, 0.5]
