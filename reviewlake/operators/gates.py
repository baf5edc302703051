"""From findings to a review: anchor gate, merge, floor, cap, order, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEV_RANK = {"high": 0, "medium": 1, "low": 2, "info": 3}


def sev_rank(severity: Column) -> Column:
    out = F.lit(9)
    for name, rank in SEV_RANK.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def anchored(findings: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings at an added line, how many of each diff are not)."""
    places = index.select("diff_id", F.col("path").alias("file"), "line")
    kept = findings.join(places, ["diff_id", "file", "line"], "left_semi")
    lost = findings.join(places, ["diff_id", "file", "line"], "left_anti")
    return kept.withColumn("anchors_ok", F.lit(True)).select(*findings.columns), lost.groupBy("diff_id").agg(F.count(F.lit(1)).alias("dropped_unanchored"))


def actionable(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("line").isNotNull() & F.col("anchors_ok"))


def fingerprint(file: Column, line: Column, category: Column) -> Column:
    """Twelve hex digits for one kind of remark at one place."""
    return F.left(F.sha1(F.concat(file, F.lit("|"), F.coalesce(line.cast("string"), F.lit("None")), F.lit("|"), category).cast("binary")), F.lit(12))


def merged(findings: DataFrame) -> DataFrame:
    """One finding a fingerprint: a rule's before a model's, then the surest, then
    the first.  If both kinds are there it is corroborated: its confidence rises
    by 0.1, to 1 at most, and alt_titles lists the titles if there are several.
    """
    key = ["diff_id", "fp"]
    df = findings.withColumn("fp", fingerprint(F.col("file"), F.col("line"), F.col("category")))
    best = Window.partitionBy(*key).orderBy(F.col("source") == "llm", F.desc("confidence"), "finding_seq")
    whole = Window.partitionBy(*key)
    llm = F.col("source") == "llm"
    df = df.withColumns({
        "_n": F.row_number().over(best),
        "group_size": F.count(F.lit(1)).over(whole),
        "corroborated": F.bool_or(llm).over(whole) & F.bool_or(~llm).over(whole),
        "_titles": F.sort_array(F.collect_set(F.when(F.col("title") != "", F.col("title"))).over(whole)),
    })
    df = df.filter(F.col("_n") == 1)
    raised = F.when(F.col("corroborated"), F.least(F.lit(1.0), F.col("confidence") + 0.1)).otherwise(F.col("confidence"))
    titles = F.when(F.col("corroborated") & (F.size("_titles") > 1), F.col("_titles"))
    return df.withColumns({"confidence": raised, "alt_titles": titles}).drop("_n", "_titles", "fp")


def merged_duplicates(findings: DataFrame) -> DataFrame:
    """How many findings of each diff merging takes away."""
    fp = fingerprint(F.col("file"), F.col("line"), F.col("category"))
    return findings.groupBy("diff_id").agg((F.count(F.lit(1)) - F.count_distinct(fp)).alias("merged_duplicates"))


def floored(findings: DataFrame, min_severity: str = "low") -> DataFrame:
    """Findings at least so severe; an unknown name means `low`."""
    return findings.filter(F.col("sev_rank") <= SEV_RANK.get(min_severity, 2))


def capped(findings: DataFrame, cap: int = 6) -> DataFrame:
    """The cap first findings of each file, by severity, then confidence."""
    order = Window.partitionBy("diff_id", "file").orderBy("sev_rank", F.desc("confidence"), "finding_seq")
    return findings.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap).drop("_n")


def ordered(findings: DataFrame) -> DataFrame:
    """By severity, file and line, those without a line last."""
    return findings.orderBy("diff_id", "sev_rank", "file", F.col("line").asc_nulls_last(), "finding_seq")


def severity_histogram(findings: DataFrame) -> DataFrame:
    """Findings of each severity, 0 included, for each diff."""
    return findings.groupBy("diff_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEV_RANK), F.count(F.lit(1)).alias("total"))


def verdict(findings: DataFrame) -> DataFrame:
    """Whether a diff is blocked: a severe finding that points at a line."""
    points = F.col("line").isNotNull() & F.col("anchors_ok")
    return findings.groupBy("diff_id").agg(F.coalesce(F.bool_or((F.col("severity") == "high") & points), F.lit(False)).alias("block"))


def rule_summary(findings: DataFrame, by: tuple[str, ...] = ("diff_id",)) -> DataFrame:
    """Findings of each rule with the first one's title, category and severity."""
    out = findings.groupBy(*by, "rule_id").agg(*(F.min_by(c, F.struct("sev_rank", "file", "line", "finding_seq")).alias(c) for c in ("title", "category", "severity", "sev_rank")), F.count(F.lit(1)).alias("n"))
    return out.orderBy(*by, "sev_rank", F.desc("n"), "rule_id")


def by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("diff_id", "category").agg(F.array_sort(F.collect_list("finding_seq")).alias("findings"), F.count(F.lit(1)).alias("n"))


def facets(findings: DataFrame, severity: str | None = None, category: str | None = None, text: str = "", source: str | None = None) -> DataFrame:
    """Findings of a severity, of a category, with a text in title, file or rule, of
    a source (`rule` or `llm`)."""
    out = findings
    if severity:
        out = out.filter(F.col("severity") == severity)
    if category:
        out = out.filter(F.col("category") == category)
    if source:
        out = out.filter(F.col("source") == source)
    if text.strip():
        out = out.filter(F.contains(F.lower(F.concat_ws(" ", "title", "file", "rule_id")), F.lit(text.strip().lower())))
    return out


def badge(n_high: Column, total: Column) -> Column:
    return F.when(n_high > 0, "block").when(total > 0, "warn").otherwise("pass")


def exit_code(block: Column, ci: bool, n_errors: Column, n_findings: Column) -> Column:
    return F.when(F.lit(ci) & block, 1).when((n_errors > 0) & (n_findings == 0), 2).otherwise(0)
