import re

import pytest
from pyspark.sql import functions as F

from reviewlake.functions.catalog import RULES, catalog_listing, count_by_category, selected
from reviewlake.operators import diff, scan
from reviewlake.plans.queries import SNIPPETS, new_file

#: A line or lines that each rule finds, and some that it doesn't.
CASES = {
    "SEC101": ('db.execute("SELECT 1 WHERE a=" + b)', 'db.execute("SELECT 1 WHERE a=?", (b,))'),
    "SEC102": ("subprocess.call(c, shell=True)", "subprocess.call([c], shell=False)"),
    "SEC103": ('API_KEY = "0123456789abcdef"', 'API_KEY = os.environ["API_KEY"]'),
    "SEC104": ("x = eval(data)", "model.eval()"),
    "SEC105": ("yaml.load(f)", "yaml.load(f, Loader=yaml.SafeLoader)"),
    "SEC106": ("get(u, verify=False)", "get(u, verify=True)"),
    "SEC107": ("password_hash = md5(raw)", "checksum = sha256(raw)"),
    "SEC108": ("requests.get(callback_url)", "requests.get(BASE)"),
    "SEC109": ("open(os.path.join(root, filename))", "open(CONFIG)"),
    "SEC110": ("DEBUG = True", "DEBUG = False"),
    "SEC111": ("logger.info(password)", "logger.info(count)"),
    "SEC112": ("jwt.decode(t, verify=False)", "jwt.decode(t, key)"),
    "SEC113": ('allow_origins=["*"]', 'allow_origins=["https://a"]'),
    "SEC114": ("render_template_string(t)", "render_template('a.html')"),
    "PERF201": ("for u in users:\n    db.query(u)", "for u in users:\n    print_(u)"),
    "PERF202": ("async def f():\n    time.sleep(1)", "async def f():\n    await sleep(1)"),
    "PERF203": ("for u in us:\n    s += 'x'", "for u in us:\n    n += 1"),
    "PERF204": ("rows = M.objects.all()", "rows = M.objects.limit(5).all()"),
    "PERF205": ("for u in us:\n    r = re.compile(u)", "for u in us:\n    r = u"),
    "PERF206": ("for a in x:\n    for b in y:\n        if a == b:", "for a in x:\n    if a == b:"),
    "CONV301": ("except ValueError:\n    pass", "except ValueError:\n    raise"),
    "CONV302": ("except:", "except ValueError:"),
    "CONV303": ("print('x')", "log('x')"),
    "CONV304": ("# TODO later", "# done"),
    "CONV305": ("def f(a=[]):", "def f(a=None):"),
    "CONV306": ("if a == None:", "if a is None:"),
    "CONV307": ("assert isinstance(a, int)", "if not isinstance(a, int): raise X"),
    "CONV308": ("f = open(p)", "with open(p) as f:"),
}


def findings(spark, rules=RULES, **texts):
    rows = [(name, text.split("\n")) for name, text in texts.items()]
    df = spark.createDataFrame(rows, "diff_id string, own array<string>")
    df = df.select("diff_id", new_file(F.regexp_replace("diff_id", "_(py|js|md)$", ".$1"), F.col("own")).alias("diff_text"))
    return scan.scan(diff.file_lines(scan.scannable(diff.parse_files(df))), rules)


def test_every_rule_finds_its_case_and_only_it(spark):
    texts = {f"{r}_{kind}_py": CASES[r][i] for r in CASES for i, kind in enumerate(("hit", "miss"))}
    got = {(r["diff_id"], r["rule_id"]) for r in findings(spark, **texts).collect()}
    for r in CASES:
        assert (f"{r}_hit_py", r) in got and (f"{r}_miss_py", r) not in got, r


def brute(path, lines):
    """The rules read literally, line by line, over one new file."""
    seen, out = set(), []
    mark = {".py": "#", ".js": "//"}.get(path[path.rfind("."):])
    for i, line in enumerate(lines):
        comment = None
        if mark:
            m = re.match(r"(?s)((?:\\.|'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|(?!" + mark + r")[^'\"\\])*+)" + mark, line)
            comment = len(m[1]) if m else None
        lo = max(0, i - 4)
        window = "\n".join(lines[lo : i + 5]) or line
        for r in RULES:
            if r.extensions and not path.lower().endswith(r.extensions):
                continue
            target = window if r.needs_context else line
            m = next((m for rx in r.regexes if (m := re.search(rx, target, re.I if r.kind != "convention" else 0))), None)
            if not m:
                continue
            at = i
            if r.needs_context:
                at = lo + target[: m.start()].count("\n")
            elif comment is not None and m.start() >= comment and r.ignore_comments:
                continue
            if (r.rule_id, at) not in seen:
                seen.add((r.rule_id, at))
                out.append((r.rule_id, at + 1, ((m[0] or line).strip().replace("\n", " ⏎ "))[:240]))
    return sorted(out)


def test_scan_agrees_with_a_literal_reading(spark):
    import random

    rng = random.Random(5)
    pool = [*SNIPPETS, *(x for pair in CASES.values() for c in pair for x in c.split("\n")), "é = 'ü#'", "", "  ", "for (x of y) {", "}", "😀 eval(x)"]
    texts = {f"f{i}_{rng.choice(['py', 'js', 'md'])}": "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 25))) for i in range(60)}
    got = {}
    for r in findings(spark, **texts).collect():
        got.setdefault(r["diff_id"], []).append((r["rule_id"], r["line"], r["evidence"]))
    for name, text in texts.items():
        assert sorted(got.get(name, [])) == brute(re.sub(r"_(py|js|md)$", r".\1", name), text.split("\n")), name


def test_comments_extensions_and_counters(spark):
    got = findings(spark, a_py="# os.system(x)\ny = 1  # eval(z)\nurl = 'a#b'; os.system(x)", b_md="except:\nos.system(x)").collect()
    assert {(r["diff_id"], r["rule_id"], r["line"]) for r in got} == {("a_py", "SEC102", 3), ("b_md", "SEC102", 2)}
    assert all(r["source"] == "rule" and r["anchors_ok"] and r["finding_seq"] for r in got)
    text = "--- a/x.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-eval(x)\ndiff --git a/b b/b\nBinary files a/b and b/b differ\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1,2 @@\n+eval(x)\n+eval(y)\n"
    files = diff.parse_files(spark.createDataFrame([("d", text)], "diff_id string, diff_text string"))
    counts, hits = scan.scan_counters(files, scan.scan(diff.file_lines(scan.scannable(files))))
    assert tuple(counts.first()) == ("d", 1, 1, 2) and [tuple(r) for r in hits.collect()] == [("d", "SEC104", 2)]


def test_context_hits_gather_at_the_line_where_they_begin(spark):
    got = findings(spark, f_py="for u in us:\n    a = 1\n    b = q.get(u)\n    c = q.get(u)\nx = 1").filter("rule_id = 'PERF201'").collect()
    assert [(r["line"]) for r in got] == [1] or not got
    got = findings(spark, f_py="for u in us:\n    b = q.get(u)\n    c = q.get(u)\nx = 1").filter("rule_id = 'PERF201'").collect()
    assert [r["line"] for r in got] == [1]


def test_selection_and_catalog(spark):
    assert {r.rule_id for r in selected(disabled={"SEC101"}, min_confidence=0.9)} == {"SEC103", "SEC106", "SEC112", "CONV305"}
    assert findings(spark, selected(min_confidence=2.0), a_py="eval(x)").count() == 0
    assert {tuple(r) for r in count_by_category(spark).collect()} == {("security", 14), ("performance", 6), ("convention", 8)}
    assert catalog_listing(spark).count() == 28 and catalog_listing(spark).filter("rule_id = 'SEC102'").first()["extensions"] == "*"


@pytest.mark.parametrize("text", ["", "plain"])
def test_nothing_to_find(spark, text):
    assert findings(spark, a_py=text).count() == 0


def test_queries_of_all_rules_see_what_their_twins_cannot(spark):
    from reviewlake.functions import catalog
    from reviewlake.plans import queries, registry

    found = registry.queries()
    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey").collect()
    planted = {"SEC104": "return eval(expr)", "SEC105": "data = pickle.loads(blob)"}
    text = [queries.SNIPPETS[r["l_partkey"] % len(queries.SNIPPETS)] for r in lines]
    hits = {r["rule_id"]: r["hits"] for r in found["rule_counts_all"](spark, sf).collect()}
    for rule, t in planted.items():
        assert hits[rule] == text.count(t) > 0
    assert {r.rule_id for r in catalog.RULES if r.needs_context} & set(hits)
    assert registry.FLAGSHIP is found["review_rules_all"] and "review_rules_all" not in registry.oracle_sql()
    assert found["review_rules_all"](spark, sf).filter("rule_id = 'SEC104'").count() > 0
