"""Reviews as text: columns of one row a diff.

Reports are built from the ordered findings of a diff, which the cap on findings
a file keeps few; everything is an expression, so all diffs of a table are
rendered where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.catalog import CATEGORIES
from reviewlake.operators.gates import SEV_RANK

ICONS = {"high": "🔴", "medium": "🟠", "low": "🟡", "info": "⚪"}
COUNTERS = ("files", "added_lines", "shards", "rule_findings", "llm_findings", "dropped_unanchored", "merged_duplicates", "llm_calls", "prompt_tokens", "completion_tokens")
FIELDS = ("rule_id", "title", "category", "severity", "file", "line", "evidence", "suggestion", "confidence", "source", "anchors_ok", "corroborated")


def bundle(diffs: DataFrame, findings: DataFrame, stats: DataFrame, errors: DataFrame) -> DataFrame:
    """A row a diff of diffs(diff_id, pr_title, pr_url): its findings in order,
    counters (0 if absent), errors, histogram and verdict."""
    key = F.struct("sev_rank", "file", F.coalesce("line", F.lit(2**31 - 1)).alias("at"), "finding_seq", F.struct(*FIELDS).alias("f"))
    own = findings.groupBy("diff_id").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["f"]).alias("findings"))
    none = F.array().cast(own.schema["findings"].dataType)
    bad = errors.groupBy("diff_id").agg(F.sort_array(F.collect_list("error")).alias("errors"))
    out = diffs.select("diff_id", F.coalesce("pr_title", F.lit("")).alias("pr_title"), F.coalesce("pr_url", F.lit("")).alias("pr_url")).join(own, "diff_id", "left").join(stats, "diff_id", "left").join(bad, "diff_id", "left")
    out = out.withColumns({"findings": F.coalesce("findings", none), "errors": F.coalesce("errors", F.array().cast("array<string>")), **{c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in COUNTERS}})
    count = lambda s: F.size(F.filter("findings", lambda x: x["severity"] == s)).cast("long")
    block = F.exists("findings", lambda x: (x["severity"] == "high") & x["line"].isNotNull() & x["anchors_ok"])
    return out.withColumns({**{f"n_{s}": count(s) for s in SEV_RANK}, "total": F.size("findings").cast("long"), "block": block, "total_tokens": F.col("prompt_tokens") + F.col("completion_tokens")})


def place(x: Column, without: str = "") -> Column:
    return F.when(x["line"].isNull(), F.concat(x["file"], F.lit(without))).otherwise(F.concat_ws(":", x["file"], x["line"].cast("string")))


def summary_line() -> Column:
    return F.format_string(
        "[review] %s | %d findings (high %d / medium %d / low %d) | files %d / added lines %d | calls %d / tokens %d",
        F.when(F.col("block"), "blocked").otherwise("passed"), "total", "n_high", "n_medium", "n_low", "files", "added_lines", "llm_calls", "total_tokens",
    )


def shares() -> Column:
    """struct<high, medium, low>: their parts in per cent of all three; null without any."""
    names = ("high", "medium", "low")
    whole = F.col("n_high") + F.col("n_medium") + F.col("n_low")
    return F.struct(*(F.try_divide(F.col(f"n_{s}") * 100.0, whole).alias(s) for s in names))


def _icon(severity: Column) -> Column:
    out = F.lit("")
    for name, icon in ICONS.items():
        out = F.when(severity == name, icon).otherwise(out)
    return out


def finding_markdown(x: Column) -> Column:
    """One finding in full; evidence is cut at 200 characters."""
    head = F.format_string("%s **[%s] %s**  `%s`", _icon(x["severity"]), F.upper(x["severity"]), x["title"], x["rule_id"])
    facts = F.format_string("- Kind: %s, from: %s, confidence: %.2f", x["category"], x["source"], x["confidence"])
    return F.concat_ws("\n", head, F.format_string("- At: `%s`", place(x, " (no line)")), facts, F.when(x["evidence"] != "", F.format_string("- Evidence: `%s`", F.left(F.trim(x["evidence"]), F.lit(200)))), F.when(x["suggestion"] != "", F.concat(F.lit("- Advice: "), F.trim(x["suggestion"]))))


def _lines(*parts: Column | str) -> Column:
    """Joined by line feeds; null parts are left out."""
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def markdown(generated_at: str = "", most: int = 40) -> Column:
    """The full report, at most `most` findings of a category and how many more there are."""
    sections = []
    for c in CATEGORIES:
        own = F.filter("findings", _in_category(c))
        more = F.when(F.size(own) > most, F.format_string("... and %d more, in the JSON report.\n", F.size(own) - most))
        shown = F.array_join(F.transform(F.slice(own, 1, most), lambda x: F.concat(finding_markdown(x), F.lit("\n"))), "\n")
        sections.append(F.when(F.size(own) > 0, _lines(F.format_string(f"## {c.capitalize()} (%d)\n", F.size(own)), shown, more)))
    table = F.concat_ws("\n", *(F.format_string(f"| {s} | %d |", F.col(f"n_{s}")) for s in ("high", "medium", "low")))
    process = F.concat_ws("\n", *(F.format_string(f"| {c} | %d |", F.col(c)) for c in COUNTERS))
    return _lines(
        "# Review\n",
        F.when(F.col("pr_title") != "", F.concat(F.lit("**Change**: "), F.col("pr_title"))),
        F.when(F.col("pr_url") != "", F.concat(F.lit("**Link**: "), F.col("pr_url"))),
        f"**Generated**: {generated_at}\n" if generated_at else F.lit(None).cast("string"),
        F.when(F.col("block"), "## Verdict: blocked\n").otherwise("## Verdict: passed\n"),
        "| Severity | Count |\n| --- | --- |", table, F.format_string("| **all** | **%d** |\n", F.col("total")),
        "## Process\n\n| Counter | Value |\n| --- | --- |", process, "",
        F.when(F.col("dropped_unanchored") > 0, F.format_string("> %d findings named a line that the diff doesn't add and were dropped.\n", F.col("dropped_unanchored"))),
        *sections,
        F.when(F.col("total") == 0, "## Nothing found\n"),
        F.when(F.size("errors") > 0, F.concat(F.lit("## Errors\n\n"), F.array_join(F.transform("errors", lambda e: F.concat(F.lit("- "), e)), "\n"))),
    )


def _in_category(c: str):
    return lambda x: x["category"] == c


def pr_comment(most: int = 10) -> Column:
    """A comment of a screen: at most `most` findings; `=` marks those that a rule and a model agree on."""
    item = lambda x: F.concat(F.format_string("- **%s**%s `%s` (%s, %s)", x["title"], F.when(x["corroborated"], " =").otherwise(""), place(x), x["severity"], x["category"]), F.when(x["suggestion"] != "", F.concat(F.lit("\n  "), x["suggestion"])).otherwise(""))
    return _lines(
        "## Automatic review\n",
        F.when(F.col("block"), "> **Severe findings: to be mended before merging.**\n").otherwise("> Nothing that blocks. What follows may be improved.\n"),
        F.format_string("high **%d**, medium **%d**, low **%d**; %d files, %d added lines\n", "n_high", "n_medium", "n_low", "files", "added_lines"),
        F.when(F.col("total") > 0, F.array_join(F.transform(F.slice("findings", 1, most), item), "\n")),
        F.when(F.col("total") > most, F.format_string("- ... and %d more", F.col("total") - most)),
        F.when(F.col("dropped_unanchored") > 0, F.format_string("\n<sub>%d findings without a line of the diff were dropped.</sub>", F.col("dropped_unanchored"))),
        F.format_string("\n<sub>tokens %d, rules %d, model %d</sub>", "total_tokens", "rule_findings", "llm_findings"),
    )


def json_report(generated_at: str = "") -> Column:
    """Everything, confidence to 3 decimals, with whether a finding can be posted;
    without generated_at the time of the query."""
    when = F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    own = F.transform("findings", lambda x: F.struct(*(x[c].alias(c) for c in ("rule_id", "title", "category", "severity", "file", "line", "evidence", "suggestion")), F.round(x["confidence"], 3).alias("confidence"), x["source"].alias("source"), (x["line"].isNotNull() & x["anchors_ok"]).alias("actionable")))
    verdict = F.struct("block", "total", F.struct(*(F.col(f"n_{s}").alias(s) for s in SEV_RANK)).alias("by_severity"))
    return F.to_json(F.struct(when.alias("generated_at"), "pr_title", "pr_url", verdict.alias("verdict"), F.struct(*COUNTERS, "total_tokens").alias("stats"), own.alias("findings"), "errors"), {"ignoreNullFields": "false"})


def console() -> Column:
    rule = "=" * 72
    item = lambda x: _lines(F.format_string("%s [%-6s] %-9s %s", F.when(x["corroborated"], "=").otherwise(" "), F.upper(x["severity"]), x["rule_id"], place(x, " (no line)")), F.concat(F.lit("    "), x["title"]), F.when(x["evidence"] != "", F.concat(F.lit("    evidence: "), F.left(x["evidence"], F.lit(100)))), F.when(x["suggestion"] != "", F.concat(F.lit("    advice: "), F.left(x["suggestion"], F.lit(120)))), "")
    return _lines("", rule, summary_line(), rule, F.when(F.col("total") == 0, "  Nothing found.").otherwise(F.array_join(F.transform("findings", item), "\n")), F.when(F.size("errors") > 0, F.array_join(F.transform("errors", lambda e: F.concat(F.lit("  ! "), e)), "\n")), rule)


def comments(bundled: DataFrame) -> DataFrame:
    """(diff_id, path, line, side, body) of what can be posted at a line."""
    each = bundled.select("diff_id", F.explode("findings").alias("f")).filter(F.col("f.line").isNotNull() & F.col("f.anchors_ok"))
    body = F.concat(F.format_string("**[%s] %s**  `%s`\n\n%s", "f.severity", "f.title", "f.rule_id", "f.suggestion"), F.when(F.col("f.evidence") != "", F.format_string("\n\n> Evidence: `%s`", "f.evidence")).otherwise(""))
    return each.select("diff_id", F.col("f.file").alias("path"), "f.line", F.lit("RIGHT").alias("side"), body.alias("body"))


def event(block: Column, may_block: bool) -> Column:
    return F.when(block & F.lit(may_block), "REQUEST_CHANGES").otherwise("COMMENT")


def write_reports(bundled: DataFrame, path: str) -> None:
    """Markdown, comment and JSON of every diff, below path, by any Hadoop file system."""
    bundled.select("diff_id", markdown().alias("markdown"), pr_comment().alias("comment")).write.mode("overwrite").parquet(f"{path}/text")
    bundled.select(json_report().alias("value")).write.mode("overwrite").text(f"{path}/json")
