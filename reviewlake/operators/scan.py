"""Rules over added lines.

The rules become literal expressions in one projection, which keeps the scan in
the JVM and needs no join: a line gets an array of (rule, pattern) numbers, most
arrays are empty, and what is left is joined with the broadcast catalog (bounded
by its number of patterns) to compute offsets and evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions.catalog import RULES, Rule, rules_frame
from reviewlake.functions.text import any_of, comment_start, extract, match_start, strip
from reviewlake.operators.diff import with_frame

RADIUS = 4
MOST_EVIDENCE = 240

FINDING = ("diff_id", "finding_seq", "rule_id", "title", "category", "severity", "sev_rank", "file", "line", "evidence", "suggestion", "confidence", "source", "anchors_ok")


def applies(rule: Rule, path: Column) -> Column:
    low = F.lower(path)
    return any_of([F.endswith(low, F.lit(e)) for e in rule.extensions]) if rule.extensions else F.lit(True)


def first_pattern(rule: Rule, target: Column) -> Column:
    """Number of the first pattern, in their order, that is found anywhere."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(rule.regexes))):
        out = F.when(target.rlike(rule.flags + rule.regexes[i]), F.lit(i)).otherwise(out)
    return out


def hits_of(rules: list[tuple[int, Rule]], path: Column, target: Column) -> Column:
    """array<struct<rule_ord, alt>> of the rules found in target."""
    if not rules:
        return F.array().cast("array<struct<rule_ord:int,alt:int>>")
    # `alt` stands once in the expression, so each pattern is tried once a line.
    each = [F.struct(F.lit(i).alias("rule_ord"), F.when(applies(rule, path), first_pattern(rule, target)).alias("alt")) for i, rule in rules]
    return F.filter(F.array(*each), lambda x: x["alt"].isNotNull())


def scan(lines: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings (columns FINDING) of the rules in lines(diff_id, file_seq, path,
    suffix, flat_idx, kind, text, old_no, new_no), whose files the caller chose.

    A rule without context sees its line alone and is dropped if the match begins
    in a comment.  One with context sees the frame of four lines each way and is
    anchored at the added line where the match begins.  A rule counts once a line
    of a file.  Lines may carry a `frame` already; else it is made here.
    """
    numbered = list(enumerate(rules))
    alone = [x for x in numbered if not x[1].needs_context]
    around = [x for x in numbered if x[1].needs_context]
    added = (F.col("kind") == "+") & F.col("new_no").isNotNull()
    if around and "frame" not in lines.columns:
        lines = with_frame(lines, RADIUS)
    keep = ["diff_id", "file_seq", "path", "suffix", "flat_idx", "text", "new_no"]
    parts = []
    if alone:
        each = lines.filter(added).select(*keep, F.explode(hits_of(alone, F.col("path"), F.col("text"))).alias("hit"))
        parts.append(each.select(*keep, "hit.*", F.col("text").alias("target"), F.lit(None).cast("array<struct<kind:string,new_no:int>>").alias("places")))
    if around:
        text = F.array_join(F.transform("frame", lambda x: x["text"]), "\n")
        framed = lines.filter(added).select(*keep, text.alias("target"), F.transform("frame", lambda x: F.struct(x["kind"].alias("kind"), x["new_no"].alias("new_no"))).alias("places"))
        framed = framed.withColumn("target", F.when(F.col("target") == "", F.col("text")).otherwise(F.col("target")))
        each = framed.select(*keep, "target", "places", F.explode(hits_of(around, F.col("path"), F.col("target"))).alias("hit"))
        parts.append(each.select(*keep, "hit.*", "target", "places"))
    if not parts:
        return _finding_columns(lines.limit(0), rules)
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)

    catalog = rules_frame(lines.sparkSession, rules).select("*", F.posexplode("regexes").alias("alt", "regex")).drop("regexes", "extensions")
    hits = hits.join(F.broadcast(catalog), ["rule_ord", "alt"])
    hits = hits.withColumn("_start", match_start(F.col("target"), F.col("regex"), F.col("flags"))).withColumn("_match", extract(F.col("target"), F.concat("flags", "regex")))
    comment = comment_start(F.col("text"), F.col("suffix"))
    hits = hits.filter(F.col("needs_context") | ~F.col("ignore_comments") | comment.isNull() | (F.col("_start") < comment))
    before = F.length(F.regexp_replace(F.substring(F.col("target"), F.lit(1), F.col("_start")), r"[^\n]", ""))
    place = F.get(F.col("places"), before)
    line = F.when(F.col("needs_context") & (place["kind"] == "+") & place["new_no"].isNotNull(), place["new_no"]).otherwise(F.col("new_no"))
    shown = F.when(F.col("_match") == "", F.col("text")).otherwise(F.col("_match"))
    hits = hits.withColumns({"line": line, "evidence": F.left(F.replace(strip(shown), F.lit("\n"), F.lit(" ⏎ ")), F.lit(MOST_EVIDENCE))})
    first = Window.partitionBy("diff_id", "file_seq", "rule_ord", "line").orderBy("flat_idx")
    hits = hits.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1)
    return _finding_columns(hits, rules)


def sequence(file_seq: Column, flat_idx: Column, rule_ord: Column) -> Column:
    """A number that sorts findings by file, line and rule; no window is needed."""
    return F.struct(file_seq.cast("long").alias("file_seq"), flat_idx.cast("int").alias("flat_idx"), rule_ord.cast("int").alias("rule_ord"))


def _finding_columns(hits: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    if "rule_id" not in hits.columns:
        for c, kind in (("rule_ord", "int"), ("rule_id", "string"), ("title", "string"), ("category", "string"), ("severity", "string"), ("sev_rank", "int"), ("line", "int"), ("evidence", "string"), ("suggestion", "string"), ("confidence", "double")):
            hits = hits.withColumn(c, F.lit(None).cast(kind))
    return hits.select(
        "diff_id",
        sequence(F.col("file_seq"), F.col("flat_idx"), F.col("rule_ord")).alias("finding_seq"),
        "rule_id", "title", "category", "severity", "sev_rank",
        F.col("path").alias("file"), F.col("line").cast("int").alias("line"),
        "evidence", "suggestion", "confidence", F.lit("rule").alias("source"), F.lit(True).alias("anchors_ok"),
    )


def scan_counters(files: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(skipped binary and deleted files and scanned lines of each diff, hits by rule)."""
    read = ~F.col("is_binary") & ~F.col("is_deleted")
    added = F.size(F.filter("lines", lambda x: x["kind"] == "+"))
    counts = files.groupBy("diff_id").agg(F.count_if("is_binary").alias("skipped_binary"), F.count_if(F.col("is_deleted") & ~F.col("is_binary")).alias("skipped_deleted"), F.sum(F.when(read, added).otherwise(0)).alias("scanned_lines"))
    return counts, findings.groupBy("diff_id", "rule_id").agg(F.count(F.lit(1)).alias("hits"))


def scannable(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("is_binary") & ~F.col("is_deleted"))
