import random

import pytest

from reviewlake.llm.token_counts import PieceCounter, frequent_lengths, model_bytes, token_counts

sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")


def test_counts_agree_with_the_library():
    model = model_bytes()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    counter = PieceCounter(model, frequent_lengths(model), cache=50)
    rng = random.Random(1)
    alphabet = ["a", "b", " ", "\n", "▁", "é", "€", "😀", "\t", "<s>", ".", "  ", "\r", "\x00", "the ", "word"]
    for _ in range(5000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert counter.count(text) == len(sp.encode(text)), repr(text)


def test_rows(docs):
    long = "lorem ipsum " * 3000
    rows = [(1, "a b", "en", "s", 3), (2, None, None, None, None), (3, "", "", "", 0), (4, long, "en", "s", 1), (4, long, "en", "s", 1), (None, "é", "fr", "s", 1)]
    df = docs(rows).selectExpr("*", "'x' AS n_tokens")
    sp = sentencepiece.SentencePieceProcessor(model_proto=model_bytes())
    got = token_counts(df).select("doc_id", "text", "n_bytes", "n_tokens", "over_limit").collect()
    assert len(got) == len(rows)
    for r in got:
        n = len(sp.encode(r["text"] or ""))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 4096)
    assert token_counts(docs([])).count() == 0
