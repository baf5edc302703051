"""Quality scores by a factorisation machine.

A document is a sparse vector: the frequencies of its words, hashed to slots and
scaled to unit length, beside statistics of its structure and its metadata.  The
score is the sigmoid of

    b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

the pairwise interactions of all features at a cost linear in their number.  The
machine is fitted in numpy on the driver, on a bounded sample of labelled
documents; the weights are broadcast and every row is scored where it is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod

SLOTS = 4096
CHUNK = 1 << 20

_BYTES = np.arange(256)
#: Kinds of bytes whose shares are features; bytes from 128 on belong to letters beyond ASCII.
_KINDS = np.stack(
    [
        (_BYTES >= 65) & (_BYTES <= 90),
        (_BYTES >= 97) & (_BYTES <= 122),
        (_BYTES >= 48) & (_BYTES <= 57),
        _BYTES >= 128,
        np.isin(_BYTES, list(b" \t\r")),
        _BYTES == 10,
        np.isin(_BYTES, list(b".,;:?'\"-")),
        _BYTES == ord("!"),
        np.isin(_BYTES, list(b"#$%&*+/<=>@\\^_`~")),
        np.isin(_BYTES, list(b"()[]{}|")),
    ],
    axis=1,
).astype(np.float64)
STATS = _KINDS.shape[1] + 8


class Features:
    """Turns texts into (slots, values); a cache of bounded size holds words' slots."""

    def __init__(self, cache: int = 200_000):
        self.slots: dict[str, int] = {}
        self.limit = cache

    def _slot(self, word: str) -> int:
        if len(self.slots) >= self.limit:
            self.slots = {}
        n = zlib.crc32(word.encode("utf-8", "surrogatepass")) % SLOTS
        if len(word) <= 64:
            self.slots[word] = n
        return n

    def of(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.split()
        got = list(map(self.slots.get, words))
        index = np.array([self._slot(w) if n is None else n for w, n in zip(words, got)], np.int64)
        counts = np.bincount(index, minlength=SLOTS)
        slots = np.flatnonzero(counts)
        values = np.sqrt(counts[slots])
        values /= max(np.sqrt((values * values).sum()), 1)

        raw = text.encode("utf-8", "surrogatepass")
        byte = np.zeros(256)
        for a in range(0, len(raw), CHUNK):
            byte += np.bincount(np.frombuffer(raw, np.uint8, min(CHUNK, len(raw) - a), a), minlength=256)
        lines = text.split("\n")
        n, size = max(len(words), 1), max(len(raw), 1)
        lengths = np.fromiter(map(len, words), np.float64, len(words))
        stats = [
            *(byte @ _KINDS / size * 2),
            np.log1p(len(words)) / 10,
            min(lengths.mean() / 10, 3) if words else 0.0,
            min(lengths.std() / 10, 3) if words else 0.0,
            len(set(words)) / n,
            len(set(lines)) / len(lines),
            np.log1p(len(lines)) / 10,
            counts.max() / n,
            np.log1p(max(len(text) if n_chars is None else n_chars, 0)) / 12,
        ]
        return np.concatenate((slots, np.arange(SLOTS, SLOTS + STATS))), np.concatenate((values, stats))


def raw_score(model: dict[str, np.ndarray], slots: np.ndarray, values: np.ndarray) -> float:
    """The score before the sigmoid, by the sum-of-squares identity."""
    vx = model["v"][slots] * values[:, None]
    total = vx.sum(axis=0)
    return float(model["b"][0] + model["w"][slots] @ values + 0.5 * ((total * total).sum() - (vx * vx).sum()))


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -50, 50))))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], rank: int = 8, epochs: int = 12, rate: float = 0.02, decay: float = 1e-4, batch: int = 32, seed: int = 5) -> dict[str, np.ndarray]:
    """Logistic loss, Adam over mini-batches, in a fixed order of random draws."""
    rng = np.random.default_rng(seed)
    size = SLOTS + STATS
    model = {"b": np.zeros(1), "w": np.zeros(size), "v": rng.normal(0, 0.02, (size, rank))}
    m = {k: np.zeros_like(x) for k, x in model.items()}
    s = {k: np.zeros_like(x) for k, x in model.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            step += 1
            g = {k: decay * x for k, x in model.items()}
            at = order[a : a + batch]
            for i in at:
                slots, x = rows[i]
                v = model["v"][slots]
                total = (v * x[:, None]).sum(axis=0)
                d = (sigmoid(raw_score(model, slots, x)) - labels[i]) / len(at)
                g["b"] += d
                g["w"][slots] += d * x
                g["v"][slots] += d * x[:, None] * (total - v * x[:, None])
            for k in model:
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.001 * (g[k] * g[k] - s[k])
                model[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(df: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", n_chars: str | None = "n_chars", rows: int = 2500, **options) -> dict[str, np.ndarray]:
    """Learns from the `rows` labelled documents with the least hashes of their
    ids.  An id counts once, with its least label and the least vector of its
    documents, so at most `rows` sparse vectors of SLOTS + STATS entries come to
    the driver, however often an id is there.  Features are computed on executors."""
    tagged = labels.filter(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label).cast("int")).alias("_y"))
    chosen = tagged.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    size = F.col(n_chars).cast("long") if n_chars else F.lit(None).cast("long")
    texts = df.select(F.col(id_col).alias("_doc"), F.col(text).alias("_t"), size.alias("_n")).join(F.broadcast(chosen), F.col("_doc").eqNullSafe(F.col("_id"))).select("_doc", "_y", "_t", "_n")
    kind = T.StructType([T.StructField("s", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.FloatType()))])

    @F.arrow_udf(kind)
    def vectors(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        f = Features()
        for t, n in batches:
            got = [f.of(a.as_py(), b.as_py()) for a, b in zip(t, n)]
            yield pa.StructArray.from_arrays([pa.array([a.astype(np.int32) for a, _ in got], pa.list_(pa.int32())), pa.array([b.astype(np.float32) for _, b in got], pa.list_(pa.float32()))], ["s", "x"])

    got = texts.select("_doc", "_y", vectors("_t", "_n").alias("f")).groupBy("_doc").agg(F.min(F.struct("_y", "f")).alias("r")).select("_doc", "r.*").collect()
    got.sort(key=lambda r: (r["_doc"] is None, r["_doc"] or 0))
    return fit_machine([(np.array(r["f"]["s"]), np.array(r["f"]["x"])) for r in got], [r["_y"] for r in got], **options)


def score(df: DataFrame, model: dict[str, np.ndarray], text: str = "text", n_chars: str | None = "n_chars", threshold: float = 0.3) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from the threshold on) to df.  Null
    and empty texts are scored by their statistics alone; a null n_chars is
    replaced by the length of the text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def scored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        f, m = Features(), shared.value
        for t, n in batches:
            yield pa.array([sigmoid(raw_score(m, *f.of(a.as_py(), b.as_py()))) for a, b in zip(t, n)], pa.float64())

    size = F.col(n_chars).cast("long") if n_chars else F.lit(None).cast("long")
    return df.withColumn("score", scored(F.col(text), size)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(df: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", folds: int = 5, fold: int = 0, **options) -> DataFrame:
    """Learns from labels whose crc32(id as text) modulo `folds` isn't `fold` and
    adds held_out, score and predicted to all rows of df.  Labels without a
    document, documents without a label and null labels are left out of the
    learning; with nothing to learn from every score is 0.5 or near it."""
    held = crc_mod(id_col, folds) == fold
    model = fit(df, labels.filter(~held), text, id_col, label, **options)
    return score(df.withColumn("held_out", held), model, text)
