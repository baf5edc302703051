"""Scores of reviews against gold labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def case_results(cases: DataFrame) -> DataFrame:
    """cases(case_id, negative, heldout, expect array, got array, ...) with
    hit, missed and extra: sorted, distinct."""
    e, g = F.array_distinct("expect"), F.array_distinct("got")
    return cases.withColumns({"hit": F.sort_array(F.array_intersect(e, g)), "missed": F.sort_array(F.array_except(e, g)), "extra": F.sort_array(F.array_except(g, e)), "n_expect": F.size(e)})


def _share(hit: Column, of: Column, without: float | None = 0.0) -> Column:
    return F.round(F.when(of == 0, F.lit(without).cast("double")).otherwise(hit / of), 4)


def summary(results: DataFrame) -> DataFrame:
    """One row of metrics over case_results' rows, which also need rule_findings,
    llm_findings, dropped and semantic (whether a semantic finding is expected).
    Shares are 0 of nothing, the anchor rate then 1, the semantic rate null."""
    pos, held, neg = ~F.col("negative"), F.col("heldout"), F.col("negative")
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, c)), F.lit(0))
    hits, exp = F.size("hit"), F.col("n_expect")
    found = F.col("rule_findings") + F.col("llm_findings")
    raw = results.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(pos).alias("positive_cases"), F.count_if(neg).alias("negative_cases"),
        total(exp, pos).alias("expected"), total(hits, pos).alias("hits"),
        total(exp, pos & ~held).alias("tuned_expected"), total(hits, pos & ~held).alias("tuned_hits"),
        total(exp, pos & held).alias("heldout_expected"), total(hits, pos & held).alias("heldout_hits"),
        total(F.size("extra"), pos).alias("over_report_count"),
        total(found, neg).alias("false_positive_findings"), F.count_if(neg & (found > 0)).alias("false_positive_cases"),
        F.coalesce(F.sum("llm_findings"), F.lit(0)).alias("kept"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"),
        F.count_if(pos & F.col("semantic")).alias("semantic_cases"), F.count_if(pos & F.col("semantic") & (F.col("llm_findings") > 0)).alias("semantic_hits"),
    )
    for c, name in (("missed", "rule_misses"), ("extra", "over_reported_rules")):
        # Made distinct before they are collected: as many names as there are rules, in one row.
        rules = results.filter(pos).select(F.explode(c).alias("rule")).distinct().agg(F.array_join(F.array_sort(F.collect_list("rule")), ",").alias(name))
        raw = raw.crossJoin(F.broadcast(rules))  # one row beside one row
    return raw.select(
        "*",
        _share(F.col("hits"), F.col("expected")).alias("rule_recall"),
        _share(F.col("tuned_hits"), F.col("tuned_expected")).alias("tuned_recall"),
        _share(F.col("heldout_hits"), F.col("heldout_expected")).alias("heldout_recall"),
        _share(F.col("kept"), F.col("kept") + F.col("dropped"), 1.0).alias("anchor_valid_rate"),
        _share(F.col("semantic_hits"), F.col("semantic_cases"), None).alias("semantic_rate"),
    )


def case_line() -> Column:
    """A case's row of the table, of case_results' columns: expected, hit, missed,
    findings by rules and by the model, dropped, and the semantic hit (`-` where none
    is expected)."""
    semantic = F.when(~F.col("semantic") | F.col("negative"), "-").when(F.col("llm_findings") > 0, "yes").otherwise("no")
    tag = F.when(F.col("negative"), " [clean]").when(F.col("heldout"), " [held out]").otherwise("")
    counts = [F.col("n_expect"), F.size("hit"), F.size("missed"), F.col("rule_findings"), F.col("llm_findings"), F.col("dropped")]
    return F.format_string("%-24s" + "%6d" * len(counts) + "  %s%s", F.col("case_id"), *counts, semantic, tag)


def write_results(results: DataFrame, path: str) -> None:
    """The summary, the cases and their table below path, as JSON lines and text."""
    summary(results).write.mode("overwrite").json(f"{path}/summary")
    results.write.mode("overwrite").json(f"{path}/results")
    results.select(case_line().alias("value")).write.mode("overwrite").text(f"{path}/table")
