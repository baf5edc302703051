import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from reviewlake.functions.text import hash_features, search_tokens
from reviewlake.operators import retrieve

TEXT = "# Errors\nLog every exception with its context.\n\nNever swallow errors silently in services.\n\nshort\n  ## Indented\nSecrets belong in the environment, not code.\n# 异常\n异常处理必须记录日志并且向上抛出，不要静默吞掉任何异常信息。"


def tokens(text):
    low = text.lower()
    out = re.findall(r"[a-z0-9_]+", low)
    for run in re.findall("[一-鿿]+", low):
        out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def index(spark, *texts):
    return retrieve.chunks(spark.createDataFrame([(i, f"s{i}", t) for i, t in enumerate(texts)], "doc_ord int, source string, text string"))


def test_tokens_and_features(spark):
    for text in ("Foo_bar 异常 处理方法 a1", "", "字", "ab 数化查询 é"):
        got = spark.createDataFrame([(text,)], "t string").select(search_tokens(F.col("t")), hash_features(F.col("t"))).first()
        grams = ["#" + s[i : i + 3] for s in re.findall(r"[a-z0-9_]{3,}|[一-鿿]{2,}", text.lower()) for i in range(len(s) - 2)]
        assert got[0] == tokens(text) and got[1] == tokens(text) + grams


def test_chunks(spark):
    got = index(spark, TEXT).orderBy("chunk_no").collect()
    assert [(r["chunk_id"], r["heading"], r["text"][:9]) for r in got] == [("s0#0", "Errors", "Log every"), ("s0#1", "Errors", "Never swa"), ("s0#2", "## Indented", "Secrets b"), ("s0#3", "异常", "异常处理必须记录日")]
    assert got[0]["tokens"][:2] == ["errors", "log"]
    assert index(spark, "", "   \n\n#\n").count() == 0


def test_bm25_agrees_with_the_formula(spark):
    ix = index(spark, TEXT, "# Style\nErrors errors everywhere in this style guide.\n\nUnrelated words about the weather today.")
    rows = ix.collect()
    query = "errors errors style 异常处理"
    mean = sum(len(r["tokens"]) for r in rows) / len(rows)
    want = {}
    for r in rows:
        s = 0.0
        for t in tokens(query):
            tf, df = r["tokens"].count(t), sum(t in x["tokens"] for x in rows)
            if tf:
                s += math.log(1 + (len(rows) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(r["tokens"]) / mean))
        if s > 0:
            want[r["doc_ord"], r["chunk_no"]] = s
    got = retrieve.bm25(spark.createDataFrame([(1, query)], "query_id int, text string"), ix, ["doc_ord", "chunk_no"]).collect()
    assert {(r["doc_ord"], r["chunk_no"]): round(r["score"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert retrieve.bm25(spark.createDataFrame([(1, "!!")], "query_id int, text string"), ix, ["doc_ord", "chunk_no"]).count() == 0


def test_hashed_vectors(spark):
    vec = [0.0] * 512
    text = "parameterised queries 参数化查询"
    for f in spark.createDataFrame([(text,)], "t string").select(hash_features(F.col("t"))).first()[0]:
        v = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
        vec[v % 512] += 1.0 if v >> 63 else -1.0
    norm = math.sqrt(sum(x * x for x in vec))
    got = retrieve.hashed_vectors(spark.createDataFrame([(text,), ("",)], "text string")).collect()
    assert got[0]["vec"] == [x / norm for x in vec] and set(got[1]["vec"]) == {0.0}


def test_nearest_and_fusion(spark):
    rows = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(8)] + [(9, [0.0, 0.0])], "id int, vec array<double>")
    got = retrieve.nearest(spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vec array<double>"), rows, ["id"], 3).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(0, 1.0), (6, round(math.cos(6), 6)), (7, round(math.cos(7), 6))]
    with pytest.raises(ValueError):
        retrieve.nearest(rows.select(F.col("id").alias("query_id"), "vec"), rows, ["id"], 1, most_queries=3)
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, k string, rank int")
    b = spark.createDataFrame([(1, "z", 1), (1, "x", 2)], "query_id int, k string, rank int")
    got = retrieve.fused([(a, 1.0), (b, 1.0)], ["k"], 3).orderBy("rank").collect()
    assert [(r["k"], r["score"]) for r in got] == [("x", round(1 / 61 + 1 / 62, 8)), ("z", round(1 / 61, 8)), ("y", round(1 / 62, 8))]


def test_many_queries_are_searched_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(40)], "id int, vec array<double>")
    queries = rows.select(F.col("id").alias("query_id"), "vec")
    whole = sorted(map(tuple, retrieve.nearest(queries, rows, ["id"], 3).collect()))
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 12)
    assert len(whole) == 120 and sorted(map(tuple, retrieve.nearest(queries, rows, ["id"], 3).collect())) == whole


def test_more_queries_than_one_block_are_all_answered(spark):
    queries = spark.range(10_001).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.5)).alias("vec"))
    assert retrieve.nearest(queries, queries.limit(2).select(F.col("query_id").alias("id"), "vec"), ["id"], 1).count() == 10_001


def test_search_and_context(spark):
    ix = index(spark, TEXT)
    q = spark.createDataFrame([(1, "swallow errors"), (2, "zzz")], "query_id int, text string")
    for backend in ("bm25", "vector", "hybrid"):
        top = retrieve.search(q, ix, backend, 2).filter("query_id = 1 AND rank = 1").first()
        assert top["text"].startswith("Never swallow")
    assert retrieve.search(q, ix, "bm25", 2).filter("query_id = 2").count() == 0
    with pytest.raises(ValueError):
        retrieve.search(q, ix, "odd")
    hits = spark.createDataFrame([(1, 1, "src", "", "a" * 500), (1, 2, "s", "H", "b" * 390), (1, 3, "s", "H", "c" * 390), (1, 4, "s", "H", "d" * 3)], "query_id int, rank int, source string, heading string, text string")
    assert retrieve.context(hits).first()["context"] == "[src]\n" + "a" * 400 + "…\n\n[H]\n" + "b" * 390 + "\n\n[H]\n" + "c" * 390
    assert tuple(retrieve.index_stats(ix).first())[0] == 4


def test_headings_are_searched_by_vectors_and_chunks_are_counted_over_the_store(spark):
    ix = index(spark, "# Zebra crossing\nwalk slowly and look to both sides", "# Other\nnothing of the kind is written here at all\n\nand a second chunk of some length")
    q = spark.createDataFrame([(1, "zebra crossing")], "query_id int, text string")
    got = retrieve.search(q, ix, "vector", 3).orderBy("rank").collect()
    assert got[0]["heading"] == "Zebra crossing" and got[0]["score"] > got[1]["score"]
    same = spark.createDataFrame([(i, "inline", "a chunk that is long enough to stay") for i in range(3)], "doc_ord int, source string, text string")
    assert sorted(r["chunk_id"] for r in retrieve.chunks(same).collect()) == ["inline#0", "inline#1", "inline#2"]


def test_hash_features_count_agrees_with_its_sql_on_texts_without_runs(spark, tmp_path):
    import duckdb

    from reviewlake.plans import queries, registry

    texts = ["Re.", "", None, "!?", "ab cd", "abc", "Erö.", "Foo_bar 处理方法 a1", "处理方法", "字 abcd", "\u0130st \u212aey", "a\nlonger_text b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = dict(db.execute(registry.oracle_sql()["hash_features_count"]).fetchall())
    got = dict(map(tuple, queries.hash_features_count(spark, str(tmp_path)).collect()))
    assert got == want and len(got) == len(texts) and want[0] is None and want[5] == 2


def test_nearest_has_all_rows_and_ties_in_order_without_a_row_a_pair(spark, monkeypatch):
    import random

    monkeypatch.setattr(retrieve.Best, "CELLS", 64)  # many products for few rows
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(4)]) for i in range(300)]
    rows += [(300, None), (301, []), (302, [1.0]), (303, [0.0] * 4), (304, [1.0, None, 1.0, 1.0]), (305, [1e-3] * 4), (None, [1.0] * 4)]
    rng.shuffle(rows)
    vectors = spark.createDataFrame(rows, "id bigint, vec array<double>").repartition(3)
    asked = [(i, v) for i, v in rows if i is not None and i % 10 < 7]

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b or not any(a) or not any(b):
            return None
        a, b = ([x / max(map(abs, v)) for x in v] for v in (a, b))
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6)

    want = []
    for q, a in asked:
        scored = sorted((-s, i is not None, i, s) for i, v in rows if (s := cosine(a, v)) is not None)[:5]
        want += [(q, i, s, n + 1) for n, (_, _, i, s) in enumerate(scored)]
    found = retrieve.nearest(spark.createDataFrame(asked, "query_id bigint, vec array<double>"), vectors, ["id"], 5)
    got = [tuple(r) for r in found.select("query_id", "id", "score", "rank").collect()]
    key = lambda r: (r[0], r[3])
    assert sorted(got, key=key) == sorted(want, key=key)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_puts_scores_that_are_no_numbers_first_and_none_for_no_queries(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 0.0]), (3, [1.0, 1.0]), (4, [float("inf"), 1.0])], "id int, vec array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, vec array<float>")
    got = retrieve.nearest(asked, rows, ["id"], 3).orderBy("rank").collect()
    assert [r["id"] for r in got] == [2, 4, 1] and math.isnan(got[0]["score"]) and got[2]["score"] == 1.0
    assert retrieve.nearest(asked.limit(0), rows, ["id"], 3).count() == 0
