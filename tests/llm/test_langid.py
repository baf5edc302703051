import zlib

import numpy as np

from reviewlake.llm.common import crc_mod
from reviewlake.llm.langid import LEAST, PAD, Model, encode, fit, gradients, identify, init, known_language, predict, probabilities, sample

SAY = {"aa": "the and of this that thing other", "bb": "der und die ßchen fürch schon nicht", "cc": "que los ñando ción para señor está"}


def corpus(n=90):
    rng = np.random.default_rng(0)
    return [(i, " ".join(rng.choice(SAY[lang].split(), rng.integers(5, 40))), lang, "s", 1) for i in range(n) for lang in [["aa", "bb", "cc"][i % 3]]]


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in init(3, 2, 1).items()}
    codes = rng.integers(0, 5, (6, 4)).astype(np.int16)
    codes[5, 2] = PAD
    y = np.array([0, 1, 1, 0])
    grads = gradients(w, codes, y)[1]
    for k in w:
        ix = tuple(rng.integers(0, s) for s in w[k].shape)
        if k[0] == "x":
            ix = (int(codes[2, 1]), ix[1])
        old, step = w[k][ix], 1e-2
        w[k][ix] = old + step
        up = gradients(w, codes, y)[0]
        w[k][ix] = old - step
        down = gradients(w, codes, y)[0]
        w[k][ix] = old
        assert abs((up - down) / 2 / step - grads[k][ix]) < 2e-5


def test_every_byte_counts_and_segments_do_not_depend_on_the_batch():
    w = init(4, 3, 2)
    model = Model(w, ["aa", "bb", "cc"], 16)
    texts = [("Grüße " * 40).encode(), b"", b"x", b"AbC" * 30]
    together = model.pooled(texts, width=5)
    for x, p in zip(texts, together):
        parts = [x[a : a + 16] for a in range(0, len(x), 16)]
        codes = encode(parts, 16) if parts else None
        own = (probabilities(w, codes) * (codes != PAD)[:, :, None]).sum(axis=(0, 1)) / len(x) if parts else np.zeros(3)
        assert np.allclose(p, own, atol=1e-5)
    assert np.allclose(together[0].sum(), 1, atol=1e-5)


def test_held_out_accuracy_and_defined_edges(docs):
    rows = corpus() + [(1000, None, "aa", "s", 0), (1001, "", "bb", "s", 0), (1002, "123 !? 456", "cc", "s", 1), (1003, "der und die nicht " * 2000, None, None, None), (None, "que los para", "cc", "s", 1), (0, "the and of", "aa", "s", 1)]
    df = docs(rows).selectExpr("*", "1 AS score", "'q' AS _id")
    got = identify(df, per_language=40, length=32).select("doc_id", "text", "lang", "held_out", "lang_pred", "score").collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.9
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "bb"]
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = known_language(df, per_language=40, length=32)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3


def test_the_network_decides_what_is_rejected(docs):
    df = docs(corpus())
    scored = predict(df, fit(df.filter(crc_mod("doc_id", 3) != 1), per_language=60, length=32)).select("doc_id", "score").collect()
    middle = sorted(r["score"] for r in scored)[30]
    for least in (middle, LEAST):
        kept = {r["doc_id"] for r in known_language(df, least=least, per_language=60, length=32).collect()}
        assert kept == {r["doc_id"] for r in scored if r["score"] >= least}
    assert len(kept) == 90  # clean texts stay


def test_without_anything_to_learn_every_row_stays(docs):
    df = docs([(i, t, None, "s", 1) for i, t in enumerate(["some text", None, "", "12", "more text"])])
    assert known_language(df).count() == 5


def test_samples_are_bounded_by_ids_not_rows(docs):
    rows = [(7, f"the and of {i}", "aa", "s", 1) for i in range(500)] + corpus(60)
    got = sample(docs(rows), "text", "lang", "doc_id", 10, 2, 24)
    assert len(got) <= 3 * 10 * 2 and {x for x, _ in got} == set(SAY)
    assert got == sample(docs(rows).repartition(5), "text", "lang", "doc_id", 10, 2, 24)


def test_nothing_to_learn_from(docs):
    df = docs([(1, "abc", None, "s", 1)])
    assert identify(df).select("lang_pred", "score").first() == ("und", 0.0)
    assert identify(docs([])).count() == 0
    assert predict(df, fit(docs(corpus(30)), per_language=5)).first()["lang_pred"] in SAY
