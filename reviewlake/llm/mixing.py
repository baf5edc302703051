"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of equal cost.  With target shares v / V, exact
fractions, block j (from 1) of a source is released at slot floor((j-1) V / v)
and due at ceil(j V / v).  Earliest deadline first over the released blocks then
fills every slot and keeps each source within less than one block of its target
at every slot, however many there are.  The driver computes the slots of all
blocks: its work grows with the number of blocks (of 64 KiB by default), not
with the rows.

When a source has no block left, the others go on with their weights scaled up
(a new phase), so that no row is dropped.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, stored

#: Rows of one source that one sorting task gets, about.
ROWS_PER_BUCKET = 50_000
#: Broadcast the slots of up to so many blocks; more are joined as Spark sees fit.
FEW_PLACES = 1_000_000


def quantised(weights: dict[str, float], period: int) -> dict[str, int]:
    """Integers of at least 1 that sum to period, by largest remainder."""
    total = sum(weights.values())
    spare = period - len(weights)
    share = {k: w / total * spare for k, w in weights.items()}
    out = {k: 1 + int(x) for k, x in share.items()}
    for k in sorted(share, key=lambda k: (int(share[k]) - share[k], k))[: period - sum(out.values())]:
        out[k] += 1
    return out


def exact(weights: dict[str, float]) -> dict[str, int]:
    """Integers in exactly the proportions of the weights."""
    parts = {k: Fraction(w) for k, w in weights.items()}
    unit = math.lcm(*(x.denominator for x in parts.values()))
    return {k: int(x * unit) for k, x in parts.items()}


def pfair(v: dict[str, int], blocks: dict[str, int], most: int | None = None) -> tuple[dict[str, list[int]], int]:
    """The slots of each source up to where one has had all its blocks (or to
    the first `most`), and their number."""
    total = sum(v.values())
    waiting = [(0, -(-total // w), k, 1) for k, w in v.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {k: [] for k in v}
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, due, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, k, j))
        _, k, j = heapq.heappop(ready)
        slots[k].append(t)
        t += 1
        if j == blocks[k] or t == most:
            return slots, t
        heapq.heappush(waiting, (j * total // v[k], -(-(j + 1) * total // v[k]), k, j + 1))


def pfair_period(a: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period of sum(a.values()) slots."""
    total = sum(a.values())
    slots, _ = pfair(a, {k: total + 1 for k in a}, total)
    return slots


def schedule(blocks: dict[str, int], weights: dict[str, float], period: int | None = None) -> tuple[list[tuple], list[tuple]]:
    """Phases (source, phase, first block, blocks, base slot, a, W) and places
    (source, phase, k, slot) that place every block.  Sources of weight 0 come
    after all others, by their number of blocks.  A phase is one period, however
    long, so that no rounded weight is repeated: `period` has no effect."""
    left, done, base, phase = dict(blocks), dict.fromkeys(blocks, 0), 0, 0
    phases, places = [], []
    while left:
        active = {k: weights[k] for k in left if weights[k] > 0} or {k: float(left[k]) for k in left}
        slots, end = pfair(exact(active), left)
        for k, own in slots.items():
            if own:
                phases.append((k, phase, done[k], len(own), base, len(own), end))
                places += [(k, phase, i, t) for i, t in enumerate(own)]
                done[k] += len(own)
                left[k] -= len(own)
            if not left[k]:
                del left[k]
        base += end
        phase += 1
    return phases, places


def source_key(source: Column) -> Column:
    """A string that tells a null source from an empty one."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def mix(df: DataFrame, weights: dict[str | None, float] | None = None, source: str = "source", id_col: str = "doc_id", cost: str | None = "n_chars", block: int = 65_536, alpha: float = 0.7, period: int = 1024, max_sources: int | None = None, seed: int = 7) -> DataFrame:
    """df with slot, its block's place in the mixture, and offset, the cost of
    what stands before the row in its block; (slot, offset) is the order.

    weights: target share of the cost by source, in any unit; a source that it
    doesn't name has weight 0 and comes last.  By default the share of a source
    is its whole cost to the power alpha.  period has no effect: shares are
    exact.  Rows of a source are in a
    pseudo-random order fixed by id and seed.  A null cost is 0 (a row without
    cost shares its neighbour's block), cost=None gives each row the cost 1, and
    null sources are one source.  More than max_sources sources, where given,
    raise a ValueError; the schedule itself has no bound.  Every row is placed once; an empty table
    gives an empty result.
    """
    unit = F.lit(1).cast("long") if cost is None else F.greatest(F.coalesce(F.col(cost).cast("long"), F.lit(0)), F.lit(0)).cast("long")
    own = [c for c in df.columns if c not in ("slot", "offset")]
    df = packed(df.select(*own), _s=source_key(F.col(source)), _c=unit, _h=F.xxhash64(F.col(id_col), F.lit(seed)))
    sums = df.groupBy("_s").agg(F.sum("_c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    if max_sources is not None and len(sums) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    blocks = {r["_s"]: max(1, -(-r["c"] // block)) for r in sums}
    named = {k: w for k, w in ((("" if k is None else f"={k}"), w) for k, w in weights.items())} if weights is not None else {r["_s"]: max(r["c"], 1) ** alpha for r in sums}
    phases, periods = schedule(blocks, {k: named.get(k, 0.0) for k in blocks}, period)

    # Ranges of the hash (equal high bits, so equal signs) within a source: each is sorted by itself, and starts at the cost of those before it.
    bits = max(10, min(20, math.ceil(math.log2(max(2, max((r["n"] for r in sums), default=0) / ROWS_PER_BUCKET))) + 4))
    df = df.withColumn("_b", F.shiftrightunsigned("_h", 64 - bits).cast("int"))
    each = stored(df.groupBy("_s", "_b").agg(F.sum("_c").alias("_c")))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select("_s", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_s", "_b").orderBy("_h", F.col("row").getField(id_col), "_c").rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("_in", F.coalesce(F.sum("_c").over(inside), F.lit(0))).join(starts, ["_s", "_b"]).withColumn("_at", F.col("_start") + F.col("_in"))

    spark = df.sparkSession
    counts = spark.createDataFrame(list(blocks.items()), "_s string, _n long")
    spans = spark.createDataFrame(phases, "_s string, _p int, _first long, _m long, _base long, _a long, _w long")
    places = spark.createDataFrame(periods, "_s string, _p int, _k long, _slot long")
    # Sources, and at most one phase and one slot a block.
    few = F.broadcast if len(periods) <= FEW_PLACES else (lambda x: x)
    spans = spans.join(counts, "_s")
    at = F.least(F.floor(F.col("_at") / block), F.col("_n") - 1)
    placed = placed.join(few(spans), "_s").withColumn("_j", at).filter((F.col("_j") >= F.col("_first")) & (F.col("_j") < F.col("_first") + F.col("_m")))
    placed = placed.withColumn("_i", F.col("_j") - F.col("_first")).withColumn("_k", F.col("_i") % F.col("_a"))
    placed = placed.join(few(places), ["_s", "_p", "_k"])
    slot = F.col("_base") + F.floor(F.col("_i") / F.col("_a")) * F.col("_w") + F.col("_slot")
    return placed.select("row.*", slot.cast("long").alias("slot"), (F.col("_at") - F.col("_j") * block).cast("long").alias("offset"))
