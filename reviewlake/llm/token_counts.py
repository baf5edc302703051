"""Token counts by a two-tier lookup on the map side.

A sentencepiece BPE model whose pieces hold the space mark only at their start
never merges across the border between a character and a following space mark,
nor across a character that no piece holds (such as the line feed).  A text is
therefore the sum of its pre-tokens.

Tier 1 is a compact broadcast table (pre-token -> number of pieces) of the words
that the vocabulary itself holds whole; those are the words that were frequent
when it was made, so the table needs no pass over the corpus and its size is
bounded by the vocabulary.  Tier 2 is a cache in each Python worker, in two
generations of bounded size; a miss there encodes the pre-token.  There is no
shuffle: each row is counted where it is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Over this many characters a pre-token is encoded without being cached.
LONG = 64


class PieceCounter:
    """Counts pieces of whole texts; exact for models that `separable` accepts,
    and by encoding each whole text for any other."""

    def __init__(self, model: bytes, frequent: dict[str, int] | None = None, cache: int = 200_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = separable(self.model)
        self.frequent, self.limit = frequent or {}, cache
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _miss(self, word: str, spaced: bool) -> int:
        """word: a pre-token without its space mark; spaced: whether it has one."""
        key = word if spaced else "\n" + word
        n = self.old.get(key)
        if n is None:
            # The encoder puts a space mark before a text; after a line feed a word has none.
            n = len(self.model.encode(word)) if spaced else len(self.model.encode("\n" + word)) - 2
            if len(word) > LONG:
                return n
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = n
        return n

    def _word(self, word: str) -> int:
        """Pieces of a word that follows a space and may hold line feeds."""
        if not word:
            return 1  # a lone space mark
        if "\n" not in word:
            n = self.young.get(word)
            return self._miss(word, True) if n is None else n
        first, *rest = word.split("\n")
        total = len(rest) + (self._known(first) if first else 1)
        for part in rest:
            if part:
                n = self.young.get("\n" + part)
                total += self._miss(part, False) if n is None else n
        return total

    def _known(self, word: str) -> int:
        n = self.frequent.get(word)
        return self._word(word) if n is None else n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.split:
            return len(self.model.encode(text))
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            total = 0
            for run, word in re.findall(f"({MARK}+)([^{MARK}]*)", MARK + text.replace(" ", MARK)):
                total += self._known(word) if len(run) == 1 else self._run(run, word)
            return total
        words = text.split(" ")
        got = list(map(self.frequent.get, words))
        return sum(self._word(w) if n is None else n for w, n in zip(words, got))

    def _run(self, run: str, word: str) -> int:
        # One mark of the run is the one that the encoder adds.
        return len(self.model.encode(run[1:] + word))


def separable(model) -> bool:
    """Whether counts of pre-tokens add up: the text is taken as it is, a mark
    is put before it, no piece holds a mark after another character, and the
    line feed is a byte of its own."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return (
        not any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p for p in pieces)
        and len(model.encode("\n")) == 2
        and model.encode("\n \n") == model.encode("\n") * 2
        and len(model.encode("a  b ")) > len(model.encode("a b"))
    )


def frequent_lengths(model: bytes, most: int = 32_768) -> dict[str, int]:
    """The vocabulary's whole words with the number of pieces each really gets."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    if not separable(sp):
        return {}
    words = [p[1:] for p in map(sp.id_to_piece, range(sp.get_piece_size())) if re.fullmatch(f"{MARK}[^{MARK}]+", p)][:most]
    return dict(zip(words, map(len, sp.encode(words))))


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def token_counts(df: DataFrame, text: str = "text", model_path: str | None = None, limit: int = 4096, frequent: int = 32_768, cache: int = 200_000) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit) to df.

    A null text counts as empty: 0 bytes, 0 tokens, not over the limit.  Columns
    of df with these three names are replaced.  model_path is read on the
    driver; workers get the model (0.5 MB) and the table of frequent words by
    broadcast.
    """
    model = model_bytes(model_path)
    shared = df.sparkSession.sparkContext.broadcast((model, frequent_lengths(model, frequent)))

    @F.arrow_udf("long")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = PieceCounter(*shared.value, cache)
        for batch in batches:
            yield pa.array([counter.count(x.as_py() or "") for x in batch], pa.int64())

    out = df.withColumn("n_bytes", F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"))
    return out.withColumn("n_tokens", n_tokens(F.col(text))).withColumn("over_limit", F.col("n_tokens") > limit)
