"""Guideline retrieval: chunks, BM25, hashed vectors, rank fusion, context."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.functions.text import hash_features, search_tokens, strip
from reviewlake.plans.numbering import starts
from reviewlake.plans.storage import forget, stored
from reviewlake.sources.diffs import doc_files, inline_docs

# BM25's k1 and b, the least chunk, RRF's constant.
K1, B, LEAST_CHUNK, RRF_K = 1.5, 0.75, 24, 60

#: Queries of one broadcast, about.
QUERY_BLOCK = 10_000


def chunks(docs: DataFrame, least: int = LEAST_CHUNK) -> DataFrame:
    """docs(doc_ord, source, text) -> (doc_ord, chunk_no, chunk_id, source,
    heading, text, tokens).

    A heading line (`#` first) or a blank line ends a chunk; a chunk belongs to
    the last heading before it and has at least `least` characters; its tokens
    are those of its heading and text.  chunk_no counts a document's chunks;
    chunk_id has the source and the number of chunks before it in all documents.
    """
    lines = docs.select("doc_ord", "source", F.posexplode(F.split("text", "\n", -1)).alias("at", "raw"))
    line = F.regexp_replace("raw", r"(?U)\s+$", "")
    lines = lines.withColumn("line", line)
    is_heading = F.col("line").rlike(r"^(?U:\s*)#")
    # Only leading # go, then white space: an indented heading keeps its marks.
    name = strip(F.regexp_replace("line", r"^#+", ""))
    flags = lines.withColumns({"h": is_heading, "name": F.when(is_heading, name), "stop": is_heading | (strip(F.col("line")) == "")})
    order = Window.partitionBy("doc_ord").orderBy("at")
    flags = flags.withColumns({"group": F.sum(F.col("stop").cast("int")).over(order), "heading": F.coalesce(F.last("name", True).over(order), F.lit(""))})
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    each = flags.filter(~F.col("stop")).groupBy("doc_ord", "source", "group", "heading").agg(body.alias("text")).withColumn("text", strip(F.col("text"))).filter(F.length("text") >= least)
    number = F.row_number().over(Window.partitionBy("doc_ord").orderBy("group")) - 1
    each = each.withColumn("chunk_no", number)
    sizes = each.groupBy("doc_ord").agg(F.count(F.lit(1)).alias("_size"))
    each = each.join(starts(sizes, "doc_ord", "_size").select("doc_ord", "start"), "doc_ord")
    return each.select("doc_ord", "chunk_no", F.concat_ws("#", "source", F.col("start") + F.col("chunk_no")).alias("chunk_id"), "source", "heading", "text", search_tokens(whole_text()).alias("tokens"))


def whole_text() -> Column:
    """A chunk's heading and text, which are searched together."""
    return F.when(F.col("heading") != "", F.concat("heading", F.lit("\n"), "text")).otherwise(F.col("text"))


def doc_freq(index: DataFrame) -> DataFrame:
    return index.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def index_stats(index: DataFrame) -> DataFrame:
    """One row: chunks, vocabulary, mean tokens (1 decimal), sorted sources."""
    return index.agg(F.count(F.lit(1)).alias("chunks"), F.round(F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)), 1).alias("avg_tokens"), F.sort_array(F.collect_set("source")).alias("sources")).crossJoin(
        F.broadcast(doc_freq(index).agg(F.count(F.lit(1)).alias("vocab")))  # one row beside one row
    )


def bm25(queries: DataFrame, index: DataFrame, key: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, *key, score > 0) of queries(query_id, text) over an index with
    the columns key and tokens.  A word that a query repeats counts each time.

    Queries are grouped into (token, times) first; the index is exploded with its
    term frequencies, and only tokens that a query has are joined and counted.
    """
    # The size of the collection is one row; the driver holds no more than that.
    n, mean = index.agg(F.count(F.lit(1)), F.avg(F.size("tokens"))).first()
    asked = queries.select("query_id", F.explode(search_tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    # Word counts stay inside a row: a long text is no row for each of its words.
    postings = index.select(*key, F.size("tokens").alias("dl"), F.explode("tokens").alias("token")).join(asked.select("token").distinct(), "token", "left_semi").groupBy(*key, "dl", "token").agg(F.count(F.lit(1)).alias("tf"))
    freq = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (F.lit(float(n or 0)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = F.greatest(F.col("dl"), F.lit(1)) / F.lit(float(mean or 1) or 1.0)
    part = F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length))
    scored = postings.join(freq, "token").join(asked, "token").withColumn("part", part)
    return scored.groupBy("query_id", *key).agg(F.sum("part").alias("score")).filter(F.col("score") > 0)


def top_k(scored: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k best of each query with their rank, ties in order of key."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hashed_vectors(df: DataFrame, text: str = "text", dim: int = 512) -> DataFrame:
    """Adds vec, the signed feature hash of a text, of unit length (zero stays).

    BLAKE2b has no counterpart in the JVM, so the hashing is a function of Arrow batches;
    the features come from built-in functions."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}
        for batch in batches:
            out = []
            for features in batch.column("_features"):
                vec = [0.0] * dim
                for f in features.as_py() or ():
                    got = known.get(f)
                    if got is None:
                        v = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
                        got = (v % dim, 1.0 if v >> 63 else -1.0)
                        if len(known) < 200_000:
                            known[f] = got
                    vec[got[0]] += got[1]
                norm = math.sqrt(sum(x * x for x in vec)) or 1.0
                out.append([x / norm for x in vec])
            yield batch.drop_columns(["_features"]).append_column("vec", pa.array(out, pa.list_(pa.float64())))

    schema = T.StructType([*df.schema.fields, T.StructField("vec", T.ArrayType(T.DoubleType()))])
    return df.withColumn("_features", hash_features(F.col(text))).mapInArrow(encode, schema)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(queries: DataFrame, vectors: DataFrame, key: list[str], k: int, vec: str = "vec", most_queries: int | None = None) -> DataFrame:
    """(query_id, *key, score, rank): the k rows of most cosine similarity (6
    decimals) for each of queries(query_id, vec).

    Exact: the queries, in blocks of about QUERY_BLOCK that are broadcast,
    against all rows, by products of matrices.  Each task reads its rows in order
    of key and keeps its k best of a query before anything is shuffled.  Vectors
    that are null, hold a null, have no length or another number of values have no
    score.  More than most_queries, where given, raise a ValueError.
    """
    asked = queries.select("query_id", F.col(vec).alias("_q"))
    n = asked.count()
    if most_queries is not None and n > most_queries:
        raise ValueError(f"more than {most_queries} queries: search for them in parts")
    blocks = max(1, -(-n // QUERY_BLOCK))
    # All vectors of one query are in one block, so a block's best are final.
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    rows = vectors.select(*key, F.col(vec).alias("_v"))
    parts = [_nearest(asked.filter(block == i) if blocks > 1 else asked, rows, key, max(k, 1)) for i in range(blocks)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def _nearest(asked: DataFrame, rows: DataFrame, key: list[str], k: int) -> DataFrame:
    table = asked.toArrow()  # a block of queries, which is broadcast
    ids = table.column("query_id").combine_chunks()
    sent = asked.sparkSession.sparkContext.broadcast((ids, _matrices(table.column("_q").combine_chunks())))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = sent.value
        best = {m.shape[1]: (place, Best(m, k)) for place, m in asked}
        for batch in batches:
            keys = batch.drop_columns(["_v"])
            for at, m in _matrices(batch.column("_v")):
                if m.shape[1] in best:
                    place, held = best[m.shape[1]]
                    q, r, score = held.add(m)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(place[q])), *keys.take(pa.array(at[r])).columns, pa.array(score)], names)

    schema = T.StructType([asked.schema["query_id"], *(rows.schema[c] for c in key), T.StructField("score", T.DoubleType())])
    names = schema.names
    return top_k(rows.sortWithinPartitions(*key).mapInArrow(search, schema), key, k)


def _matrices(lists: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each number of values, without those
    that are null or hold a null."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        flat = lists.take(pa.array(at)).flatten()
        whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, d).any(axis=1)
        m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        out.append((at[whole], m[whole]))
    return out


class Best:
    """The k best rows of each of `asked`, rows of a matrix, among those added so
    far; of equal scores (6 decimals) those that were added first.

    A product of matrices finds which rows may enter; only their scores are summed
    again, value by value.
    """

    #: Cells of one product, and by how much a product may be off a score.
    CELLS, OFF = 1 << 21, 1e-9

    def __init__(self, asked: np.ndarray, k: int):
        self.asked, self.k, self.seen = asked, k, 0
        self.squares = _squares(asked)
        self.unit, self.odd = _unit(asked, self.squares), _odd(self.squares)
        # A score that is no number counts as infinite: it comes first, as Spark has it.
        self.score = np.full((len(asked), k), -np.inf)
        self.row = np.full((len(asked), k), -1)

    def add(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which rows of m are among the best now: numbers of queries and rows, scores."""
        squares = _squares(m)
        unit, odd = _unit(m, squares), _odd(squares)
        most = max(1, self.CELLS // max(1, len(self.asked)))
        a = 0
        while a < len(m) and len(self.asked):
            # The first rows all enter, so there are few of them.
            b = min(len(m), a + min(most, max(4 * self.k, 3 * self.seen)))
            with np.errstate(all="ignore"):
                about = self.unit @ unit[a:b].T
            about[self.odd] = about[:, odd[a:b]] = np.inf
            about[self.squares == 0] = about[:, squares[a:b] == 0] = -np.inf
            q, r = np.nonzero(about > (self.score[:, -1:] + 0.5e-6 - self.OFF))
            if len(q):
                self._enter(q, r + a, self._scores(q, m[a:b], r, squares[a:b]))
            self.seen += b - a
            a = b
        q, slot = np.nonzero(self.row >= 0)
        row, score = self.row[q, slot], self.score[q, slot]
        self.row[:] = -1
        return q, row, np.where(np.isinf(score), np.nan, score)

    def _scores(self, q: np.ndarray, m: np.ndarray, r: np.ndarray, squares: np.ndarray) -> np.ndarray:
        dots = np.zeros(len(q))
        with np.errstate(all="ignore"):
            for x, y in zip(self.asked.T, m.T):
                dots += x[q] * y[r]
            x, y = self.squares[q], squares[r]
            both = x * y
            cos = dots / np.where(np.isfinite(both) & (both > 0), np.sqrt(both), np.sqrt(x) * np.sqrt(y)) * 1e6
        whole = np.trunc(cos)
        score = (whole + np.where(np.abs(cos - whole) >= 0.5, np.sign(cos), 0)) / 1e6 + 0.0
        return np.where(np.isnan(score), np.inf, score)

    def _enter(self, q: np.ndarray, r: np.ndarray, score: np.ndarray) -> None:
        of, place = np.unique(q, return_inverse=True)
        place = np.concatenate([np.repeat(np.arange(len(of)), self.k), place])
        score = np.concatenate([self.score[of].ravel(), score])
        row = np.concatenate([self.row[of].ravel(), r])
        order = np.lexsort((-score, place))  # stable: what was there comes first
        place = place[order]
        order = order[np.arange(len(place)) - np.searchsorted(place, place) < self.k]
        self.score[of], self.row[of] = score[order].reshape(-1, self.k), row[order].reshape(-1, self.k)


def _squares(m: np.ndarray) -> np.ndarray:
    """Sums of squares, value by value."""
    out = np.zeros(len(m))
    with np.errstate(all="ignore"):
        for x in m.T:
            out += x * x
    return out


def _odd(squares: np.ndarray) -> np.ndarray:
    """Where a product says nothing about a score: no numbers, or far too large or small ones."""
    return ~((squares > 1e-200) & (squares < 1e200))


def _unit(m: np.ndarray, squares: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return m / np.sqrt(squares)[:, None]


def fused(rankings: list[tuple[DataFrame, float]], key: list[str], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings(query_id, *key, rank) with weights: sums
    of weight / (rrf_k + rank), 8 decimals; ties as they come in the rankings."""
    parts = [df.select("query_id", *key, (F.lit(w) / (rrf_k + F.col("rank"))).alias("part"), (F.lit(i * 1_000_000_000) + F.col("rank")).alias("seen")) for i, (df, w) in enumerate(rankings)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    summed = whole.groupBy("query_id", *key).agg(F.sum("part").alias("_sum"), F.min("seen").alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("_sum", 12)), "seen")
    out = summed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select("query_id", *key, F.round("_sum", 8).alias("score"), "rank")


def pool_size(k: int) -> int:
    return max(4 * k, 12)


def search(queries: DataFrame, index: DataFrame, backend: str = "bm25", k: int = 3) -> DataFrame:
    """(query_id, source, heading, text, score, rank) by bm25, vector or hybrid."""
    key = ["source", "heading", "text"]
    if backend not in ("bm25", "vector", "hybrid"):
        raise ValueError(f"unknown backend {backend!r}")
    place = ["doc_ord", "chunk_no"]
    named = index.select(*place, *key)

    def sparse(n: int) -> DataFrame:
        return top_k(bm25(queries, index, place), place, n).join(named, place)

    def dense(n: int) -> DataFrame:
        return nearest(hashed_vectors(queries), hashed_vectors(index.select(*place, whole_text().alias("text"))), place, n).join(named, place)

    if backend == "hybrid":
        n = pool_size(k)
        return fused([(sparse(n), 1.0), (dense(n), 1.0)], key, k)
    return (sparse if backend == "bm25" else dense)(k).select("query_id", *key, "score", "rank")


def guarded(queries: DataFrame, index: DataFrame, backend: str = "bm25", k: int = 3) -> tuple[DataFrame, str]:
    """(hits, note) of a search.  The hits are written, so that a failure of the
    vectors shows here: then hybrid goes on with BM25 alone, vector has no hits, and
    the note (else empty) says why.  A failure of BM25 is raised."""
    if backend == "bm25":
        return search(queries, index, backend, k), ""
    try:
        return stored(search(queries, index, backend, k)), ""
    except ValueError:
        raise
    except Exception as e:  # noqa: BLE001  whatever the vectors' job failed by
        sparse = search(queries, index, "bm25", k)
        return (sparse if backend == "hybrid" else sparse.filter(F.lit(False))), f"{type(e).__name__}: {str(e)[:300]}"


def bm25_store(spark: SparkSession, paths: list[str] = (), inline: list[tuple[str, str]] = ()) -> DataFrame:
    """The chunks of files, then of texts, for BM25 alone."""
    files = doc_files(spark, list(paths))
    given = inline_docs(spark, list(inline)).withColumn("doc_ord", F.col("doc_ord") + len(paths))
    return chunks(files.unionByName(given))


def add_vectors(index: DataFrame, path: str, instance: str) -> int:
    """Adds the chunks that an instance's table at path has not yet, and returns
    how many.  An instance sees its own rows alone; chunks are told apart by source,
    heading and text, so what was added before is neither hashed nor written again."""
    key = ["source", "heading", "text"]
    fresh = index.select(*key, whole_text().alias("_whole")).dropDuplicates(key)
    old = vectors_of(index.sparkSession, path, instance)
    if old is not None:
        fresh = fresh.join(old.select(*key), key, "left_anti")
    fresh = stored(fresh)
    n = fresh.count()
    if n:
        hashed_vectors(fresh, "_whole").drop("_whole").withColumn("instance", F.lit(instance)).write.mode("append").partitionBy("instance").parquet(path)
    forget(fresh)
    return n


def vectors_of(spark: SparkSession, path: str, instance: str) -> DataFrame | None:
    """(source, heading, text, vec) of one instance, None where there is no table."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    schema = "source string, heading string, text string, vec array<double>, instance string"
    return spark.read.schema(schema).parquet(path).filter(F.col("instance") == instance).drop("instance")


def brief(text: Column, most: int = 400) -> Column:
    t = strip(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(most)), F.lit("…")))


def context(hits: DataFrame, limit: int = 1200) -> DataFrame:
    """(query_id, context): blocks of `[heading or source]` and a brief text, in
    order of rank, up to the first that would exceed limit characters.  Lengths
    only grow, so stopping there is a filter on their running sum."""
    head = F.when(F.col("heading") != "", F.col("heading")).otherwise(F.col("source"))
    blocks = hits.withColumn("block", F.concat(F.lit("["), head, F.lit("]\n"), brief(F.col("text"))))
    so_far = F.sum(F.length("block")).over(Window.partitionBy("query_id").orderBy("rank"))
    kept = blocks.withColumn("_sum", so_far).filter(F.col("_sum") <= limit)
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"))
