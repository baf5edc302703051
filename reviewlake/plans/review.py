"""The review as one plan: diffs in, findings, counters and errors out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.catalog import RULES, Rule
from reviewlake.operators import decode, gates, report, retrieve, scan, semantics, shards
from reviewlake.operators.diff import added_index, file_lines, parse_files, review_targets
from reviewlake.plans.storage import stored


@dataclass(frozen=True)
class Settings:
    """Defaults are fixed values of the review's contract."""

    max_findings_per_file: int = 6
    min_severity: str = "low"
    max_files: int = 60
    shard_max_chars: int = 6000
    shard_max_files: int = 8
    retrieval_backend: str = "bm25"
    top_k: int = 3


#: Answers prompts(diff_id, shard_no, prompt) with (diff_id, shard_no, text, prompt_tokens, completion_tokens).
Responder = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Review:
    diffs: DataFrame
    findings: DataFrame
    stats: DataFrame
    errors: DataFrame

    def bundled(self) -> DataFrame:
        return report.bundle(self.diffs, self.findings, self.stats, self.errors)


def prompts(targets: DataFrame, diffs: DataFrame, conventions: DataFrame | None, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(shards, prompts), each shard's with what the conventions say on its file and title."""
    cut = stored(shards.build_shards(targets, settings.shard_max_chars, settings.shard_max_files))
    named = cut.join(diffs.select("diff_id", F.coalesce("pr_title", F.lit("")).alias("pr_title")), "diff_id")
    if conventions is None:
        return cut, named.select("diff_id", "shard_no", shards.prompt(F.col("pr_title"), F.lit(""), F.col("text")).alias("prompt"))
    query = F.trim(F.concat_ws(" ", "file", "pr_title"))
    asked = named.select(query.alias("text")).distinct().select(F.sha1(F.col("text").cast("binary")).alias("query_id"), "text")
    found = retrieve.context(retrieve.search(asked, conventions, settings.retrieval_backend, settings.top_k))
    with_context = named.withColumn("query_id", F.sha1(query.cast("binary"))).join(found, "query_id", "left")
    return cut, with_context.select("diff_id", "shard_no", shards.prompt(F.col("pr_title"), F.col("context"), F.col("text")).alias("prompt"))


def review(diffs: DataFrame, settings: Settings = Settings(), rules: tuple[Rule, ...] = RULES, responder: Responder | None = None, conventions: DataFrame | None = None) -> Review:
    """diffs(diff_id, diff_text, pr_title, pr_url) -> Review.

    Files that aren't for review go before anything is scanned.  The responder's
    findings (None: rules only) count only at added lines.  Findings are merged,
    floored and capped.  A diff without files, or without files for review, has
    an error instead.  What several results need (files, the rules' findings,
    answers) is written to the shared folder when the plan is made.
    """
    files = stored(parse_files(diffs))
    targets = review_targets(files, settings.max_files)
    lines = file_lines(targets)
    ruled = stored(scan.scan(lines, rules))
    zero = F.lit(0).cast("long")
    stats = targets.groupBy("diff_id").agg(F.count(F.lit(1)).alias("files"), F.sum("added").alias("added_lines"))
    stats = stats.join(ruled.groupBy("diff_id").agg(F.count(F.lit(1)).alias("rule_findings")), "diff_id", "left")
    found = ruled
    failures = None
    if responder is not None:
        cut, asked = prompts(targets, diffs, conventions, settings)
        # Written once: a responder is asked once about a shard.
        answers = stored(responder(asked))
        kept, lost = gates.anchored(decode.coerced(answers, cut), added_index(lines))
        found = ruled.unionByName(kept)
        cost = answers.groupBy("diff_id").agg(F.count(F.lit(1)).alias("llm_calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
        for part in (cut.groupBy("diff_id").agg(F.count(F.lit(1)).alias("shards")), cost, kept.groupBy("diff_id").agg(F.count(F.lit(1)).alias("llm_findings")), lost):
            stats = stats.join(part, "diff_id", "left")
        failures = cut.join(answers.select("diff_id", "shard_no"), ["diff_id", "shard_no"], "left_anti").select("diff_id", F.concat(F.lit("no answer for "), "file").alias("error"))
    else:
        stats = stats.withColumns({c: zero for c in ("shards", "llm_calls", "prompt_tokens", "completion_tokens", "llm_findings", "dropped_unanchored")})
    stats = stats.join(gates.merged_duplicates(found), "diff_id", "left")
    findings = gates.capped(gates.floored(gates.merged(found), settings.min_severity), settings.max_findings_per_file)

    has_files = diffs.select("diff_id").join(files.select("diff_id"), "diff_id", "left_semi")
    errors = diffs.select("diff_id").join(files.select("diff_id"), "diff_id", "left_anti").select("diff_id", F.lit("the diff is empty or can't be read").alias("error"))
    errors = errors.unionByName(has_files.join(targets.select("diff_id"), "diff_id", "left_anti").select("diff_id", F.lit("no added lines to review").alias("error")))
    if failures is not None:
        errors = errors.unionByName(failures)
    return Review(diffs, findings, stats, errors)


def mock_responder(asked: DataFrame) -> DataFrame:
    return semantics.stand_in(asked)
