import hashlib
import random

from pyspark.sql import functions as F

from reviewlake.operators import gates

SCHEMA = "diff_id string, finding_seq struct<file_seq:bigint,flat_idx:int,rule_ord:int>, rule_id string, title string, category string, severity string, sev_rank int, file string, line int, evidence string, suggestion string, confidence double, source string, anchors_ok boolean"
RANK = {"high": 0, "medium": 1, "low": 2, "info": 3}


def finding(i, file="a.py", line=1, category="security", severity="high", confidence=0.5, source="rule", title="t", diff_id="d", ok=True):
    return (diff_id, (i, 0, 0), f"R{i}", title, category, severity, RANK[severity], file, line, "e", "s", confidence, source, ok)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plain_merge(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[0], r[7], r[8], r[4]), []).append(r)
    out = []
    for g in groups.values():
        keep = min(g, key=lambda r: (r[12] == "llm", -r[11], r[1]))
        both = {"llm", "rule"} == {r[12] for r in g}
        titles = sorted({r[3] for r in g if r[3]})
        out.append((keep[2], round(min(1.0, keep[11] + 0.1), 6) if both else keep[11], both, titles if both and len(titles) > 1 else None))
    return out


def test_merge_agrees_with_a_literal_reading(spark):
    rng = random.Random(2)
    rows = [finding(i, rng.choice("ab"), rng.choice([1, 2, None]), rng.choice(["security", "convention"]), rng.choice(list(RANK)), rng.choice([0.5, 0.7, 0.95]), rng.choice(["rule", "llm"]), rng.choice(["x", "y", ""]), rng.choice("de")) for i in range(120)]
    got = gates.merged(frame(spark, rows)).collect()
    key = lambda x: (x[0], x[1])
    assert sorted([(r["rule_id"], round(r["confidence"], 6), r["corroborated"], r["alt_titles"]) for r in got], key=key) == sorted(plain_merge(rows), key=key)
    counts = {r["diff_id"]: r["merged_duplicates"] for r in gates.merged_duplicates(frame(spark, rows)).collect()}
    assert sum(counts.values()) == len(rows) - len(got)


def test_fingerprint(spark):
    df = frame(spark, [finding(1, "é.py", 3), finding(2, "b", None)]).select(gates.fingerprint(F.col("file"), F.col("line"), F.col("category")))
    assert [r[0] for r in df.collect()] == [hashlib.sha1(s.encode()).hexdigest()[:12] for s in ("é.py|3|security", "b|None|security")]


def test_anchor_gate(spark):
    index = spark.createDataFrame([("d", "a.py", 1), ("d", "a.py", 2)], "diff_id string, path string, line int")
    kept, lost = gates.anchored(frame(spark, [finding(1), finding(2, line=9), finding(3, line=None), finding(4, file="b"), finding(5, ok=False)]), index)
    assert sorted(r["rule_id"] for r in kept.collect()) == ["R1", "R5"] and all(r["anchors_ok"] for r in kept.collect())
    assert [tuple(r) for r in lost.collect()] == [("d", 3)]


def test_floor_cap_order_and_counts(spark):
    rows = [finding(i, severity=s, confidence=c, line=n) for i, (s, c, n) in enumerate([("low", 0.9, 5), ("high", 0.5, 9), ("high", 0.8, 3), ("info", 1.0, 1), ("medium", 0.6, None), ("high", 0.8, 2)])]
    df = frame(spark, rows)
    assert {r["rule_id"] for r in gates.floored(df).collect()} == {"R0", "R1", "R2", "R4", "R5"} == {r["rule_id"] for r in gates.floored(df, "odd").collect()}
    assert {r["rule_id"] for r in gates.floored(df, "high").collect()} == {"R1", "R2", "R5"} and gates.floored(df, "info").count() == 6
    assert {r["rule_id"] for r in gates.capped(df, 2).collect()} == {"R2", "R5"}
    assert [r["rule_id"] for r in gates.ordered(df).collect()] == ["R5", "R2", "R1", "R4", "R0", "R3"]
    assert tuple(gates.severity_histogram(df).first()) == ("d", 3, 1, 1, 1, 6)
    assert [r["rule_id"] for r in gates.rule_summary(df).collect()][:3] == ["R1", "R2", "R5"]
    assert gates.actionable(df).count() == 5


def test_verdict_facets_and_codes(spark):
    df = frame(spark, [finding(1, ok=False), finding(2, severity="low", title="Weak Hash", diff_id="e")])
    assert {tuple(r) for r in gates.verdict(df).collect()} == {("d", False), ("e", False)}
    assert gates.verdict(frame(spark, [finding(1)])).first()["block"] and gates.verdict(df.limit(0)).count() == 0
    assert [r["rule_id"] for r in gates.facets(df, text=" weak ").collect()] == ["R2"] and gates.facets(df, "high", "security", "r1").count() == 1 and gates.facets(df, category="convention").count() == 0
    one = spark.range(1)
    codes = [gates.exit_code(F.lit(b), ci, F.lit(e), F.lit(f)) for b, ci, e, f in ((True, True, 0, 1), (True, False, 0, 1), (False, True, 1, 0), (False, True, 1, 1))]
    assert list(one.select(*(c.alias(str(i)) for i, c in enumerate(codes))).first()) == [1, 0, 2, 0]
    assert list(one.select(*(gates.badge(F.lit(a), F.lit(b)).alias(f"{a}{b}") for a, b in ((1, 2), (0, 2), (0, 0)))).first()) == ["block", "warn", "pass"]
