"""SimHash near duplicates by Golay-code fuzzy hashing.

Two words of 23 bits that differ in at most 2 places have a codeword of the
perfect [23, 12] Golay code within distance 4 of both: the one nearest to a word
halfway between.  A word has 1 or 6 codewords within distance 4, and the 12-bit
indices of these are its keys.

A fingerprint of 64 bits is cut into A and B of 23 bits and R of 18.  Let a pair
differ in a, b, r bits of them, 4 or fewer in all.
  r = 0:  a or b is at most 2, so R with a key of A, or R with a key of B, agrees.
  r > 0:  a + b is at most 3.  If a or b is 0, A or B itself agrees.  Else both
          are at most 2, and so is r: a key of A, a key of B and one of the
          three thirds of R agree.
So every link has a key in common; candidates are then verified on all 64 bits.
Keys of 23 or 30 bits keep unlinked fingerprints from meeting by chance.

Fingerprints are made distinct first.  A bucket's members are linked to its
least one (a star), which joins dense groups with one row a member.  What is left
are pairs in one bucket but in different components; only those are compared, and
only against the members outside the bucket's largest component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, packed, stored
from .components import components
from .decontaminate import row_key

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
CHUNK = 1 << 16
#: Fixed value: the generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the code.
GENERATOR = 0b110001110101
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, n: int = 4) -> int:
    """64 majority bits over the hashes of all n-word shingles; 0 without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = min(n, len(words))
    starts, ends = starts[: len(words) - n + 1], ends[n - 1 :]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), CHUNK):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + CHUNK].tolist(), ends[i : i + CHUNK].tolist())], "<u8")
        spread = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
        ones += (np.bincount(spread.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


@F.arrow_udf(T.LongType())
def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array(np.array([fingerprint(x.as_py()) for x in batch], np.uint64).view(np.int64))


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << bit - 11), rest)
    return rest


def _nearby() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome, the message parts of all error patterns of weight 4 or
    less that have it (rows of 6, the first repeated to fill), and how many."""
    patterns = np.array([sum(1 << i for i in c) for w in range(5) for c in combinations(range(23), w)], np.int64)
    at = syndrome(patterns)
    lists: list[list[int]] = [[] for _ in range(2048)]
    for s, p in zip(at.tolist(), patterns.tolist()):
        lists[s].append(p >> 11)
    count = np.array([len(x) for x in lists])
    return np.array([x + x[:1] * (6 - len(x)) for x in lists], np.int64), count


#: Made once; it travels with the functions that use it.
_NEARBY = _nearby()


def codewords(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords near 23-bit words, 6 columns; repeats fill a row."""
    return (words >> 11)[:, None] ^ _NEARBY[0][syndrome(words)]


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys): all keys of unsigned fingerprints, each key once a row."""
    prints = prints.astype(np.uint64)
    a = (prints & np.uint64(0x7FFFFF)).astype(np.int64)
    b = (prints >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
    r = (prints >> np.uint64(46)).astype(np.int64)
    near_a, near_b = codewords(a), codewords(b)
    parts = [
        near_a | r[:, None] << 12,
        near_b | r[:, None] << 12 | 1 << 32,
        a[:, None] | 2 << 32,
        b[:, None] | 3 << 32,
    ]
    pairs = (near_a[:, :, None] << 12 | near_b[:, None, :]).reshape(len(a), -1) << 6
    parts += [pairs | (r >> 6 * i & 63)[:, None] | 4 + i << 32 for i in range(3)]
    keys = np.sort(np.concatenate(parts, axis=1), axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(fresh)[0], keys[fresh]


@F.arrow_udf(T.ArrayType(T.LongType()))
def golay_keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows, keys = keys_of(batch.to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(batch) + 1)), pa.int32()), pa.array(keys))


def close(x: Column, y: Column, bits: int) -> Column:
    return F.bit_count(x.bitwiseXOR(y)) <= bits


def fingerprint_roots(prints: DataFrame, bits: int = 4) -> DataFrame:
    """(f, root) of distinct fingerprints f: the least of those that links of at
    most `bits` (4 at most) differing bits reach; f without links is left out."""
    if not 0 <= bits <= 4:
        raise ValueError("the keys find links of at most 4 bits")
    # The keys are a hundred times as many as the rows: they are made by all tasks and dealt out once.
    # The window's functions look at neighbours in sorted order and hold no bucket in memory.
    spread = prints.select("f").repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = Window.partitionBy("k").orderBy("f")
    keyed = spread.select("f", F.explode(golay_keys("f")).alias("k"))
    keyed = keyed.withColumns({"rep": F.first("f").over(bucket), "_last": F.lag("f").over(bucket), "_next": F.lead("f").over(bucket)})
    many = stored(keyed.filter(F.col("_last").isNotNull() | F.col("_next").isNotNull()).select("k", "f", "rep"))
    stars = many.filter((F.col("f") != F.col("rep")) & close(F.col("f"), F.col("rep"), bits)).select(F.col("f").alias("a"), F.col("rep").alias("b"))
    first = components(stars)

    named = many.select("k", "f").join(first.withColumnRenamed("node", "f"), "f", "left").select("k", "f", F.coalesce("root", "f").alias("c"))
    sizes = named.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("k").agg(F.count(F.lit(1)).alias("_m"), F.max_by("c", F.struct("n", "c")).alias("most")).filter(F.col("_m") > 1).drop("_m")
    named = stored(named.join(mixed, "k"))
    few = named.filter(F.col("c") != F.col("most")).select("k", F.col("f").alias("f1"), F.col("c").alias("c1"))
    other = (F.col("c") != F.col("c1")) & ((F.col("c") == F.col("most")) | (F.col("c1") < F.col("c")))
    links = few.join(named, few["k"].eqNullSafe(named["k"]) & other & close(F.col("f1"), F.col("f"), bits)).select(F.col("c1").alias("a"), F.col("c").alias("b"))
    second = cut(components(links))

    lifted = first.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return lifted.unionAll(second.join(first.select("node"), "node", "left_anti")).withColumnRenamed("node", "f")


def near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", bits: int = 4) -> DataFrame:
    """(id, _key, f, component_id) for each row of df.

    f is the fingerprint as a signed bigint, component_id the least id reachable
    over links of at most `bits` differing bits, the row's own included.  Null
    and empty texts have fingerprint 0 and are linked like any other; repeated
    rows are kept; null ids count only if a component has no other.
    """
    own = stored(df.select(F.col(id_col), row_key(id_col, text).alias("_key"), fingerprints(F.col(text)).alias("f")))
    prints = stored(own.groupBy("f").agg(F.min(id_col).alias("least")))
    roots = cut(fingerprint_roots(prints.select("f"), bits))
    named = prints.join(roots, "f", "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    tops = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(named.join(tops, "root").select("f", "component_id"), "f").select(id_col, "_key", "f", "component_id")


def one_each(df: DataFrame, text: str = "text", id_col: str = "doc_id", bits: int = 4) -> DataFrame:
    """The rows of df that stand for their component: its least id; a row that is
    there twice is kept once.  Columns stay."""
    found = near_duplicates(df, text, id_col, bits)
    # Nulls sort first, so a null id is taken only where there is nothing else.
    keep = found.groupBy("component_id").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), id_col, "_key")).alias("x")).select(F.col("x._key").alias("_key"))
    return packed(df, _key=row_key(id_col, text)).join(keep, "_key", "left_semi").dropDuplicates(["_key"]).select("row.*")


def hex_print(f: Column) -> Column:
    return F.lower(F.lpad(F.hex(f), 16, "0"))
