"""Prompts: files packed into shards of a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = "array<struct<text:string,num:int>>"


def title_of(path: Column) -> Column:
    return F.concat(F.lit("### "), path)


def units(hunks: Column, lines: Column) -> Column:
    """What a file shows: each hunk's header and numbered lines, without end-of-
    file markers and without blank units; num is the number of an added line."""

    def header(h: Column) -> Column:
        text = F.rtrim(F.format_string("@@ -%d,%d +%d,%d @@ %s", h["old_start"], h["old_len"], h["new_start"], h["new_len"], h["header"]))
        return F.struct(text.alias("text"), F.lit(None).cast("int").alias("num"))

    def shown(x: Column) -> Column:
        mark = F.coalesce(F.concat(x["new_no"].cast("string"), F.lit(": ")), F.lit("  - "))
        return F.struct(F.concat(mark, x["kind"], x["text"]).alias("text"), F.when(x["kind"] == "+", x["new_no"]).alias("num"))

    each = F.transform(hunks, lambda h, i: F.concat(F.array(header(h)), F.transform(F.filter(lines, lambda x: (x["hunk_seq"] == i) & (x["kind"] != "\\")), shown)))
    return F.filter(F.flatten(each), lambda u: u["text"].rlike(r"(?U)\S"))


def packed(path: Column, own: Column, budget: int) -> Column:
    """array<struct<lines, nums>>: the shards of one file.

    If all fits into the budget there is one.  Else lines are taken in order, and
    a shard is closed when the next line would exceed the budget and it holds an
    added line already; what is left at the end counts only if it holds one.
    """
    head, more = title_of(path), F.concat(title_of(path), F.lit(" (continued)"))
    size = F.length(head) + 1 + F.aggregate(own, F.lit(0), lambda a, u: a + F.length(u["text"]) + 1)
    texts = lambda us: F.transform(us, lambda u: u["text"])
    nums = lambda us: F.filter(F.transform(us, lambda u: u["num"]), lambda n: n.isNotNull())
    whole = F.array(F.struct(F.concat(F.array(head), texts(own)).alias("lines"), nums(own).alias("nums")))

    # The fold keeps offsets only; the texts are cut out of the units afterwards.
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("first"), (F.length(head) + 1).alias("used"), F.lit(0).alias("held"), F.array().cast("array<struct<first:int,size:int>>").alias("done"))

    def step(s: Column, u: Column) -> Column:
        cost = F.length(u["text"]) + 1
        full = (s["used"] + cost > budget) & (s["held"] > 0)
        counts = F.when(u["num"].isNotNull(), 1).otherwise(0)
        return F.struct(
            (s["at"] + 1).alias("at"),
            F.when(full, s["at"]).otherwise(s["first"]).alias("first"),
            (F.when(full, F.length(more) + 1).otherwise(s["used"]) + cost).alias("used"),
            (F.when(full, 0).otherwise(s["held"]) + counts).alias("held"),
            F.when(full, F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), (s["at"] - s["first"]).alias("size"))))).otherwise(s["done"]).alias("done"),
        )

    ends = F.aggregate(own, state, step, lambda s: F.when(s["held"] > 0, F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), (s["at"] - s["first"]).alias("size"))))).otherwise(s["done"]))
    cut = F.transform(ends, lambda e, i: F.struct(F.concat(F.array(F.when(i == 0, head).otherwise(more)), texts(F.slice(own, e["first"] + 1, e["size"]))).alias("lines"), nums(F.slice(own, e["first"] + 1, e["size"])).alias("nums")))
    return F.when(F.size(own) == 0, F.array().cast("array<struct<lines:array<string>,nums:array<int>>>")).when(size <= budget, whole).otherwise(cut)


def build_shards(files: DataFrame, budget: int = 6000, max_files: int = 8) -> DataFrame:
    """(diff_id, shard_no, file, text, line_numbers) of files, the first
    max(1, 8 * max_files) shards of a diff in their order."""
    each = files.select("diff_id", "file_seq", F.col("path").alias("file"), units(F.col("hunks"), F.col("lines")).alias("units"))
    each = each.select("diff_id", "file_seq", "file", F.posexplode(packed(F.col("file"), F.col("units"), budget)).alias("k", "s"))
    order = Window.partitionBy("diff_id").orderBy("file_seq", "k")
    out = each.withColumn("shard_no", F.row_number().over(order) - 1).filter(F.col("shard_no") < max(1, max_files * 8))
    return out.select("diff_id", "shard_no", "file", F.array_join("s.lines", "\n").alias("text"), F.col("s.nums").alias("line_numbers"))


SYSTEM = "Review the added lines. Answer with JSON: {\"findings\": [{line, title, category, severity, evidence, suggestion, confidence}]}."


def prompt(title: Column, context: Column, text: Column) -> Column:
    """What a model is asked about a shard."""
    has_title, has_context = F.length(F.coalesce(title, F.lit(""))) > 0, F.length(F.coalesce(context, F.lit(""))) > 0
    return F.concat_ws(
        "\n\n",
        F.when(has_title, F.concat(F.lit("Change: "), title)),
        F.when(has_context, F.concat(F.lit("## Conventions\n"), context)).otherwise(F.lit("## Conventions\n(none given; make no remarks on style)")),
        F.concat(F.lit("## Diff\n```\n"), text, F.lit("\n```")),
        F.lit("Answer in JSON now. A line is one of the numbers before the colons above."),
    )
