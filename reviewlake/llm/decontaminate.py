"""Benchmark decontamination by size-partitioned MinHash containment search, in
DataFrame functions only.

An item of n distinct five-word shingles is contained if at least
need = ceil(0.8 n) of them occur in a document.  Its sketch is the bottom-k
MinHash of its shingles.  Items are partitioned by size and each size gets the
k = n - need + 1 that loses nothing: at most n - need of an item's shingles can
be missing from a document that contains it, so one of any k is there.  (Banded
MinHash of whole documents cannot do this: an item of 30 words in a document of
20,000 has a Jaccard similarity near 0.001.)  On the other side, a document is
only compared with sizes it can hold: it needs `need` positions itself.

Documents that hold a sketch value of such an item are candidates; only they are
read again, and counted exactly, on the shingles as strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, packed, small_side, stored, text_or_empty
from .secret_scan import let




def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    flat = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def shingle_hashes(words: Column, n: int = 5) -> Column:
    """A hash of each run of n words; of the whole sequence if there are fewer."""

    def runs(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(w[i + k] for k in range(n))))
        # The same function as for a run whose missing words are null.
        few = F.array(F.xxhash64(*(F.get(w, F.lit(k)) for k in range(n))))
        return F.when(F.size(w) >= n, many).when(F.size(w) > 0, few).otherwise(F.array().cast("array<bigint>"))

    return let(words, runs)


def shingle_texts(words: Column, n: int = 5) -> Column:
    """The distinct shingles themselves."""

    def runs(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        few = F.array(F.array_join(w, " "))
        return F.array_distinct(F.when(F.size(w) >= n, many).when(F.size(w) > 0, few).otherwise(F.array().cast("array<string>")))

    return let(words, runs)


def row_key(id_col: str = "doc_id", text: str = "text") -> Column:
    """Stands for an (id, text) pair; never null."""
    return F.xxhash64(F.col(id_col), F.col(text))


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = 5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, _key, item_id, n_item, n_found) for every document and item with
    n_found >= threshold * n_item; the n_ are distinct shingles.

    docs has doc_id and text, items has item_id and text; other columns are
    ignored.  Null and empty texts hold no shingle and match nothing.  Rows with
    the same id and text are one document; a null id is kept as null.  Items
    that share an id but not a text are one item with the shingles of both.
    """
    docs = docs.select("doc_id", text_or_empty().alias("text"), row_key().alias("_key"))
    parts = items.select("item_id", F.explode(shingle_texts(words_of(text_or_empty()), n)).alias("s")).distinct()
    parts = parts.withColumn("h", shingle_hashes(F.split("s", " "), n))
    sizes = parts.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"), F.array_sort(F.collect_set(F.col("h")[0])).alias("hs"))
    need = F.ceil(F.col("n_item") * F.lit(threshold) - 1e-9).cast("long")
    sizes = sizes.withColumn("need", F.greatest(need, F.lit(1)))
    sketch = sizes.select("need", F.explode(F.slice("hs", F.lit(1), (F.col("n_item") - F.col("need") + 1).cast("int"))).alias("h"))
    sketch = small_side(stored(sketch.groupBy("h").agg(F.min("need").alias("need"))), broadcast_rows)

    runs = docs.select("_key", shingle_hashes(words_of(F.col("text")), n).alias("hs"))
    each = runs.select("_key", F.size("hs").alias("held"), F.explode("hs").alias("h"))
    hits = each.join(sketch, "h").filter(F.col("held") >= F.col("need")).select("_key").distinct()
    hits = small_side(stored(hits), broadcast_rows)

    again = docs.join(hits, "_key", "left_semi").dropDuplicates(["_key"])
    held = again.select("doc_id", "_key", F.explode(shingle_texts(words_of(F.col("text")), n)).alias("s"))
    wanted = parts.select("item_id", "s").alias("p").join(sizes.select(F.col("item_id").alias("_item"), "n_item", "need"), F.col("item_id").eqNullSafe(F.col("_item"))).select("item_id", "s", "n_item", "need")
    wanted = small_side(stored(wanted), broadcast_rows)
    found = held.join(wanted, "s").groupBy("doc_id", "_key", "item_id", "n_item", "need").agg(F.count(F.lit(1)).alias("n_found"))
    return found.filter(F.col("n_found") >= F.col("need")).drop("need")


def clean(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """The documents that contain no item, with their columns as they are."""
    bad = small_side(stored(contained(docs, items, broadcast_rows=broadcast_rows, **options).select("_key").distinct()), broadcast_rows)
    return packed(docs, _key=row_key()).join(bad, "_key", "left_anti").select("row.*")


CONTAINED_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
dw AS (SELECT doc_id, text, list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM d),
ds AS (SELECT DISTINCT doc_id, text, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM dw),
iw AS (SELECT item_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM iw),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_found, round(count(*) / n_item, 6) AS containment
FROM ds JOIN i USING (s) JOIN n USING (item_id)
GROUP BY doc_id, text, item_id, n_item HAVING count(*) >= greatest(1, ceil(n_item * 0.8 - 1e-9))
"""
