import hashlib
import random
import re

from reviewlake.llm.secret_scan import candidates, digest, redact_live, secret_scan

BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
}


def brute(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, (rx, flags, ok)) in enumerate(BASE.items()) for m in re.finditer(rx, text or "", flags) if ok(m)]
    return sorted(found)


def listed(found):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)


def test_base_spans_agree_with_brute_force(docs):
    rng = random.Random(4)
    parts = ["token", "Api_Key", "apikey", "PASSWORD", "=", ": ", "'", '"', " ", "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMNOP", "xyz.9/+", "é", "😀", "\n", "", "password:secret:abcdefg", "f" * 24, "0" * 23]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", ("token=abc1234 " + "é" * 50) * 400]
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in digest(secret_scan(docs(rows))).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i]["base_sha256"] == hashlib.sha256(listed(want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(x[3] == k for x in want) for k in BASE]
        assert [x for x in got[i]["spans"].split(",") if x and not x.startswith("owned")] == [x for x in listed(want).split(",") if x]


def test_ownership_separates_examples_from_live_values(docs):
    example, live, mixed = "token = " + "a1" * 12, "token = " + "b2" * 12, "Zx9Kq2Lm8Np4Rt6Vw1YbQ"
    rows = [(i, f"see {example}", "en", f"s{i % 4}", 0) for i in range(20)]
    rows += [(100, f"mine {live}", "en", "s1", 0), (101, f"it is {mixed}", "en", "s1", 0), (102, f"key {mixed}9", "en", "s1", 0), (103, f"key {mixed}9", "en", "s2", 0), (None, f"mine {live}", None, None, None)]
    got = {r["doc_id"]: r for r in secret_scan(docs(rows)).collect()}
    assert all(x["example"] for x in got[0]["spans"]) and len(got[0]["spans"]) == 2
    assert [x["n_owners"] for x in got[100]["spans"]] == [2, 2] and not any(x["example"] for x in got[100]["spans"])
    assert [(x["kind"], x["value"]) for x in got[101]["spans"]] == [("owned", mixed)]
    assert got[102]["spans"] == got[103]["spans"] == []  # two owners
    assert secret_scan(docs([])).count() == 0


def test_redaction_keeps_rows_and_columns(docs):
    rows = [(1, "x token = deadbeef1 y", "en", "s", 21), (1, "x token = deadbeef1 y", "en", "s", 21), (2, "nothing", "en", "s", 7), (3, None, None, None, None), (4, "secret=" + "c" * 30, "en", "s", 37)]
    df = docs(rows).selectExpr("*", "1 AS spans", "2 AS base", "3 AS h")
    out = redact_live(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == [(1, "x [REDACTED] y", 14), (1, "x [REDACTED] y", 14), (2, "nothing", 7), (3, None, None), (4, "[REDACTED]", 10)]


def test_extra_columns_may_clash(docs):
    df = docs([(1, "token=abcdef1", "en", "s", 1)]).selectExpr("*", "9 AS owner", "8 AS repo")
    assert candidates(df).count() == 1
    assert secret_scan(df).select("owner", "repo").first() == (9, 8)
