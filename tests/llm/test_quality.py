import zlib

import numpy as np

from reviewlake.llm import quality
from reviewlake.llm.quality import SLOTS, STATS, Features, classify, fit, raw_score


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    m = {"b": np.array([0.1]), "w": rng.normal(size=SLOTS + STATS), "v": rng.normal(size=(SLOTS + STATS, 3))}
    s, x = np.array([1, 5, 9, SLOTS + 2]), rng.normal(size=4)
    pairs = sum(m["v"][s[i]] @ m["v"][s[j]] * x[i] * x[j] for i in range(4) for j in range(i + 1, 4))
    assert abs(raw_score(m, s, x) - (0.1 + m["w"][s] @ x + pairs)) < 1e-9


def test_features_see_the_whole_text():
    f = Features(cache=3)
    a, b = f.of("plain words here " * 500, None), f.of("plain words here " * 500 + "!!!! END", None)
    assert not np.array_equal(a[1], b[1]) and all(len(i) == len(x) and np.isfinite(x).all() for i, x in (a, b, f.of(None, None), f.of("", 0)))


def test_learns_and_scores(spark, docs):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(50)]
    rows, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        text = " ".join(str(w) + ("" if good else "!!$") for w in rng.choice(words, 30))
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
    rows += [(500, None, None, None, None), (501, "", "en", "s", 0), (502, "word1 word2 " * 20000, "en", "s", None), (0, "word1", "en", "s", 5), (None, "word3", "en", "s", 5)]
    labels += [(7, None, 0), (9999, 1, 0)]
    df = docs(rows).selectExpr("*", "1 AS _y", "2 AS _t", "'x' AS score")
    tags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = classify(df, tags).select("doc_id", "held_out", "score", "predicted").collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0) for r in got)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] not in (0, 7)]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.95
    again = {(r["doc_id"], r["score"]) for r in classify(df.repartition(3), tags).select("doc_id", "score").collect()}
    assert again == {(r["doc_id"], r["score"]) for r in got}


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert abs(classify(docs([(1, "a", "en", "s", 1)]), none).first()["score"] - 0.5) < 0.1
    assert classify(docs([]), none).count() == 0


def test_repeated_ids_bring_one_vector(spark, docs, monkeypatch):
    rows = [(1, f"word{i % 5} text", "en", "s", 9) for i in range(300)] + [(2, "other text", "en", "s", 9), (None, "a", "en", "s", 1)]
    tags = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit_machine", lambda x, y, **_: seen.append((len(x), y)))
    fit(docs(rows), tags, rows=10)
    assert seen == [(3, [0, 0, 1])]
