import random

from pyspark.sql import functions as F

from reviewlake.functions.text import token_estimate
from reviewlake.operators import diff, semantics, shards


def parsed(spark, text):
    return diff.parse_files(spark.createDataFrame([("d", text)], "diff_id string, diff_text string"))


def literal(path, units, budget):
    """Greedy packing, read literally."""
    head, more = f"### {path}", f"### {path} (continued)"
    if len(head) + 1 + sum(len(t) + 1 for t, _ in units) <= budget:
        return [("\n".join([head, *(t for t, _ in units)]), [n for _, n in units if n])]
    out, own, nums, used = [], [head], [], len(head) + 1
    for t, n in units:
        if used + len(t) + 1 > budget and nums:
            out.append(("\n".join(own), nums))
            own, nums, used = [more], [], len(more) + 1
        own.append(t)
        used += len(t) + 1
        nums += [n] if n else []
    return out + [("\n".join(own), nums)] * bool(nums)


def test_packing_agrees_with_a_literal_reading(spark):
    rng = random.Random(3)
    for budget in (60, 150, 6000):
        kinds = [rng.choice("+++ -") for _ in range(60)] + [" "] * 12
        body = [(k, "x" * rng.choice([0, 3, 30, 200])) for k in kinds]
        old, new = sum(k != "+" for k in kinds), sum(k != "-" for k in kinds)
        text = f"--- a/p.py\n+++ b/p.py\n@@ -1,{old} +1,{new} @@ head\n" + "\n".join(k + t for k, t in body) + "\n"
        units, n = [(f"@@ -1,{old} +1,{new} @@ head", None)], 0
        for k, t in body:
            n += k != "-"
            units.append(("  - -" + t if k == "-" else f"{n}: {k}{t}", n if k == "+" else None))
        got = [(r["text"], r["line_numbers"]) for r in shards.build_shards(parsed(spark, text), budget).orderBy("shard_no").collect()]
        assert got == literal("p.py", units, budget)


def test_shard_cap_and_files_without_lines(spark):
    text = "".join(f"--- /dev/null\n+++ b/f{i}\n@@ -0,0 +1 @@\n+x\n" for i in range(12)) + "diff --git a/b b/b\nBinary files a/b and b/b differ\n"
    got = shards.build_shards(parsed(spark, text), max_files=1).orderBy("shard_no").collect()
    assert [r["file"] for r in got] == [f"f{i}" for i in range(8)] and [r["shard_no"] for r in got] == list(range(8))
    assert shards.build_shards(parsed(spark, text), max_files=0).count() == 1


def test_token_estimate(spark):
    texts = ["", "abc", "a" * 7, "异常处理", "异a"]
    want = [0, 1, 3, 5, int(1 + 1 / 3.5) + 1]
    assert [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(token_estimate(F.col("t"))).collect()] == want


def heuristics(spark, code):
    body = "\n".join(f"{i + 1}: +{line}" for i, line in enumerate(code.split("\n")))
    df = spark.createDataFrame([("d", 0, "intro\n\n" + body)], "diff_id string, shard_no int, prompt string")
    return {(r["line"], r["title"].split()[0]) for r in semantics.heuristic_findings(df).collect()}


def test_heuristics_and_their_vetoes(spark):
    assert heuristics(spark, "def f(user_id):\n    return user_id") == {(1, "Argument")}
    assert heuristics(spark, "def f(user_id):\n    if user_id is None: return") == set()
    assert heuristics(spark, "a.save(x)\nb.delete(y)") == {(1, "Several"), (2, "Several")} and heuristics(spark, "a.save(x)") == set()
    assert heuristics(spark, "with conn:\n    a.save(x)\n    b.delete(y)") == set()
    assert heuristics(spark, "r = requests.get(u)") == {(1, "Outside")} and heuristics(spark, "r = requests.get(u, timeout=3)") == set()
    assert heuristics(spark, "x = a/count") == {(1, "Division")} and heuristics(spark, "x = a/count or 1") == set() and heuristics(spark, "# x = a/count") == set()
    assert heuristics(spark, "_CACHE[k] = 1") == {(1, "Shared")}
    # A veto reaches five lines, no further.
    assert heuristics(spark, "r = requests.get(u)\na\nb\nc\nd\ntry:") == set() and heuristics(spark, "r = requests.get(u)\na\nb\nc\nd\ne\ntry:") == {(1, "Outside")}


def test_stand_in_answers_every_prompt(spark):
    df = spark.createDataFrame([("d", 0, "1: +x = requests.get(u)"), ("d", 1, "nothing")], "diff_id string, shard_no int, prompt string")
    got = {r["shard_no"]: r for r in semantics.stand_in(df).collect()}
    assert got[1]["text"] == '{"findings":[]}' and '"line":1' in got[0]["text"] and got[1]["prompt_tokens"] == int(len(f"{shards.SYSTEM}\nnothing") / 3.5) + 1
    assert tuple(semantics.mock_cost(semantics.stand_in(df)).first())[:2] == ("d", 2)


def test_prompts(spark):
    p = lambda t, c: spark.range(1).select(shards.prompt(F.lit(t), F.lit(c), F.lit("CODE"))).first()[0]
    assert p("T", "C").startswith("Change: T\n\n## Conventions\nC\n\n## Diff\n```\nCODE\n```") and p("", None).startswith("## Conventions\n(none")
