"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into segments of fixed length; the network reads
each forwards and backwards, labels every byte with a distribution over the
languages, and a document's probabilities are the means over all its bytes.  The
network is trained in numpy by backpropagation through time, on the driver, on a
bounded sample of labelled documents; the weights (a few 10 kB) are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, packed, text_or_empty

PAD = 256
UNKNOWN = "und"
#: A text of which no language has this mean probability over all bytes is of none
#: of them: little more than four languages have by chance, so that clean texts stay.
LEAST = 0.3


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 60, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def init(hidden: int, classes: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    w = {"out": normal(2 * hidden, classes, scale=0.3), "bias": np.zeros(classes, np.float32)}
    for way in "fb":
        # Input weights are rows by byte, so that reading a byte is a lookup; gates in the order update, reset, new.
        w[f"x{way}"] = normal(257, 3 * hidden, scale=0.3)
        w[f"g{way}"] = normal(hidden, 2 * hidden, scale=hidden**-0.5)
        w[f"n{way}"] = normal(hidden, hidden, scale=hidden**-0.5)
    return w


def _read(w: dict[str, np.ndarray], way: str, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, batch, hidden) of one direction; keep gets what the backward pass needs."""
    steps, batch = codes.shape
    hidden = w["n" + way].shape[0]
    states = np.empty((steps, batch, hidden), np.float32)
    h = np.zeros((batch, hidden), np.float32)
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        x = w["x" + way][codes[t]]
        gates = _sigmoid(x[:, : 2 * hidden] + h @ w["g" + way])
        z, r = gates[:, :hidden], gates[:, hidden:]
        u = h @ w["n" + way]
        n = np.tanh(x[:, 2 * hidden :] + r * u)
        if keep is not None:
            keep.append((t, h, z, r, u, n))
        h = n + z * (h - n)
        states[t] = h
    return states


def probabilities(w: dict[str, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """(time, batch, class) of byte codes (time, batch)."""
    hidden = w["nf"].shape[0]
    logits = _read(w, "f", codes) @ w["out"][:hidden]
    logits += _read(w, "b", codes) @ w["out"][hidden:]
    logits += w["bias"]
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits


def gradients(w: dict[str, np.ndarray], codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all bytes, and its gradients through time."""
    hidden, real = w["nf"].shape[0], (codes != PAD).astype(np.float32)
    real /= max(real.sum(), 1)
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([_read(w, way, codes, kept[way]) for way in "fb"], axis=2)
    logits = states @ w["out"] + w["bias"]
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    rows = np.arange(codes.shape[1])
    loss = float(-(np.log(p[:, rows, labels] + 1e-9) * real).sum())
    p[:, rows, labels] -= 1
    d = p * real[:, :, None]
    flat = d.reshape(-1, d.shape[2])
    grads = {"out": states.reshape(-1, 2 * hidden).T @ flat, "bias": flat.sum(0)}
    into = d @ w["out"].T
    for way, at in (("f", slice(0, hidden)), ("b", slice(hidden, None))):
        gx, gg, gn = (np.zeros_like(w[k + way]) for k in "xgn")
        dh = np.zeros_like(into[0][:, at])
        for t, h, z, r, u, n in reversed(kept[way]):
            dh = dh + into[t][:, at]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * u * r * (1 - r)
            du = dn * r
            dg = np.concatenate([dz, dr], axis=1)
            np.add.at(gx, codes[t], np.concatenate([dg, dn], axis=1))
            gg += h.T @ dg
            gn += h.T @ du
            dh = dh * z + dg @ w["g" + way].T + du @ w["n" + way].T
        grads |= {"x" + way: gx, "g" + way: gg, "n" + way: gn}
    return loss, grads


def adam(w: dict[str, np.ndarray], steps, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Follows the gradients that steps, called with w, yields."""
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    for i, g in enumerate(steps(w), 1):
        norm = float(np.sqrt(sum(float((x * x).sum()) for x in g.values())))
        for k in w:
            x = g[k] * min(1.0, 5.0 / (norm + 1e-9))
            m[k] += 0.1 * (x - m[k])
            v[k] += 0.001 * (x * x - v[k])
            w[k] -= (rate * m[k] / (1 - 0.9**i) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)).astype(w[k].dtype)
    return w


def encode(parts: list[bytes], length: int) -> np.ndarray:
    """(time, batch) codes of parts of at most `length` bytes, A-Z in lower case."""
    codes = np.full((len(parts), length), PAD, np.int16)
    for row, x in zip(codes, parts):
        row[: len(x)] = np.frombuffer(x.lower(), np.uint8)
    return np.ascontiguousarray(codes.T)


def train(parts: list[bytes], labels: list[int], classes: int, hidden: int = 8, length: int = 96, epochs: int = 8, batch: int = 128, seed: int = 11) -> dict[str, np.ndarray]:
    codes, gold = encode([x[:length] for x in parts], length), np.array(labels)
    rng = np.random.default_rng(seed)

    def steps(w):
        for _ in range(epochs):
            order = rng.permutation(len(gold))
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                yield gradients(w, codes[:, at], gold[at])[1]

    return adam(init(hidden, classes, seed), steps)


class Model:
    """Weights, languages and the length of a segment."""

    def __init__(self, weights: dict[str, np.ndarray], languages: list[str], length: int):
        self.weights, self.languages, self.length = weights, languages, length

    def pooled(self, texts: list[bytes], width: int = 2048) -> np.ndarray:
        """Mean probabilities over all bytes of each text; zeros for empty ones."""
        sizes = np.array([len(x) for x in texts], np.int64)
        total = np.zeros((len(texts), len(self.languages)))
        parts, owners = [], []

        def flush() -> None:
            codes = encode(parts, self.length)
            p = probabilities(self.weights, codes)
            p *= (codes != PAD)[:, :, None]
            np.add.at(total, owners, p.sum(axis=0))
            parts.clear()
            owners.clear()

        for i, x in enumerate(texts):
            for a in range(0, len(x), self.length):
                parts.append(x[a : a + self.length])
                owners.append(i)
                if len(parts) == width:
                    flush()
        if parts:
            flush()
        return total / np.maximum(sizes, 1)[:, None]


def sample(df: DataFrame, text: str, lang: str, id_col: str, per_language: int, pieces: int, length: int, margin: float = 4.0) -> list[tuple[str, str]]:
    """Bounded: for each language, `pieces` stretches of `length` characters of
    each of `per_language` documents, those with the least hashes of their ids.

    Rows whose hash is above a bound that leaves about margin * per_language ids
    of their language go where they are read, so neither a language nor an id
    that a third of all rows have meets in one task.  An id counts once a
    language, with the least of its rows' stretches."""
    body, span = text_or_empty(text), F.lit(float(1 << 63))
    rows = df.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("l"), F.col(id_col).alias("i"), body.alias("t"), F.xxhash64(id_col).alias("h"))
    known = rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()  # a row a language
    if not known:
        return []
    bounds = df.sparkSession.createDataFrame([(r["l"], min(1.0, margin * per_language / max(r["n"], 1))) for r in known], T.StructType([T.StructField("_l", rows.schema["l"].dataType), T.StructField("part", T.DoubleType())]))
    near = rows.join(F.broadcast(bounds), F.col("l") == F.col("_l")).filter(F.shiftrightunsigned("h", 1) <= F.col("part") * span)
    cuts = [F.substring("t", F.pmod(F.xxhash64(F.col("i"), F.lit(k)), F.greatest(F.length("t") - length, F.lit(1))).cast("int") + 1, F.lit(length)) for k in range(pieces)]
    each = near.groupBy("l", "h", "i").agg(F.min(F.array_distinct(F.array(*cuts))).alias("x"))
    pick = Window.partitionBy("l").orderBy(F.shiftrightunsigned("h", 1), "h", "i")
    chosen = each.withColumn("_n", F.row_number().over(pick)).filter(F.col("_n") <= per_language)
    got = chosen.select("l", F.explode("x").alias("s")).filter(F.col("s").rlike(r"\p{L}"))
    return sorted((r[0], r[1]) for r in got.collect())


def fit(df: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", per_language: int = 400, pieces: int = 3, hidden: int = 8, length: int = 96, seed: int = 11) -> Model:
    """A model learned from the texts and non-null languages of df only; it sees
    at most per_language documents of each language, of which there may be any
    number (each is a class of the network and per_language rows on the driver)."""
    rows = sample(df, text, lang, id_col, per_language, pieces, length)
    languages = sorted({x for x, _ in rows})
    if not languages:
        return Model({}, [], length)
    index = {x: i for i, x in enumerate(languages)}
    weights = train([s.encode("utf-8", "surrogatepass")[:length] for _, s in rows], [index[x] for x, _ in rows], len(languages), hidden, length, seed=seed)
    return Model(weights, languages, length)


def predict(df: DataFrame, model: Model, text: str = "text", rows: int = 512) -> DataFrame:
    """Adds lang_pred and score to df.

    score is the pooled probability of the predicted language.  Null texts and
    texts without a letter get `und` and 0, as does everything if there was
    nothing to learn from.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.languages, model.length))
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Model(*shared.value)
        for batch in batches:
            names, scores = [], []
            for i in range(0, len(batch), rows):
                p = m.pooled([(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch[i : i + rows]])
                best = p.argmax(axis=1)
                names += [m.languages[k] for k in best]
                scores += p[np.arange(len(p)), best].tolist()
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    known = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) if model.languages else F.lit(False)
    # The model reads every row; a condition around the call would not spare it any.
    out = df.withColumn("_label", label(F.col(text))) if model.languages else df.withColumn("_label", F.lit(None).cast(kind))
    return out.withColumn("lang_pred", F.when(known, F.col("_label.lang_pred")).otherwise(UNKNOWN)).withColumn("score", F.when(known, F.least(F.col("_label.score"), F.lit(1.0))).otherwise(0.0)).drop("_label")


def identify(df: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", folds: int = 3, fold: int = 1, **options) -> DataFrame:
    """Learns from the rows whose crc32(id as text) modulo `folds` isn't `fold`
    and adds held_out, lang_pred and score to all rows.  An empty table gives
    an empty result; rows that are there twice are labelled alike."""
    held = crc_mod(id_col, folds) == fold
    model = fit(df.filter(~held), text, lang, id_col, **options)
    return predict(df.withColumn("held_out", held), model, text)


def known_language(df: DataFrame, text: str = "text", least: float = LEAST, **options) -> DataFrame:
    """The rows whose language the network can tell, with their columns as they
    are.  Rejected are texts without a letter (null and empty ones too) and those
    whose pooled probability is below `least` for every language.  If there is
    nothing to learn from, nothing can be told and every row is kept."""
    rows = packed(df, doc_id=F.col("doc_id"), text=F.col(text), lang=F.col("lang"))
    model = fit(rows.filter(crc_mod("doc_id", 3) != 1), **options)
    if not model.languages:
        return df
    return predict(rows, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
