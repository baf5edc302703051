import math
from collections import defaultdict

import pytest

from tests.llm.test_decontaminate import brute as contained_brute
from tests.llm.test_secret_scan import brute as secret_brute
from tests.llm.test_simhash import plain, roots

corpus_pipeline = pytest.importorskip("corpus_pipeline")

BENCH = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def test_run_agrees_with_brute_force(spark, tmp_path):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(i, f"the {i} story of number {i * i} goes on and on in {i % 7} ways " * 3, ["aa", "bb"][i % 2], f"s{i % 3}", 100) for i in range(30)]
    rows += [(50, base, "aa", "s0", 9), (51, base + " end", "aa", "s1", 9), (52, base, "bb", None, 9), (53, base, "aa", "s0", 9), (53, base, "aa", "s0", 9)]
    rows += [(60, base[:900] + " " + BENCH, "aa", "s0", 9), (61, None, None, None, None), (62, "", "aa", "s1", 0), (63, "12345 !!", "bb", "s2", 3)]
    rows += [(70, "here is token = deadbeef99 and more of it", "aa", "s2", 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    # `prints` by position, since ids repeat; the first of the least id stands for its group.
    prints = {i: plain(r[1]) for i, r in enumerate(kept)}
    groups = defaultdict(list)
    for i, root in roots(prints, list(prints)).items():
        groups[root].append(i)
    kept = [kept[min(g, key=lambda i: kept[i][0])] for g in groups.values()]
    dirty = {d for d, *_ in contained_brute(kept, [(1, BENCH)])}
    want = {}
    for d, text, lang, source, n in kept:
        if d in dirty:
            continue
        found = secret_brute(text)
        if found:
            text = text[: found[0][0]] + "[REDACTED]" + text[found[0][2] :]
            n = len(text)
        want[d] = (text, lang, source, n)

    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*df.columns, "slot", "offset"]
    out = got.collect()
    assert {r["doc_id"]: (r["text"], r["lang"], r["source"], r["n_chars"]) for r in out} == want and len(out) == len(want)
    assert {r["slot"] for r in out} == set(range(math.ceil(len({r["source"] for r in out}))))


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text of its own", "en", "s", 20)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == docs.columns and out.count() == frame.count()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).count() == frame.count()
