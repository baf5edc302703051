"""Requests for a review: checked, answered in their mode, and laid out as answers."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.operators.report import COUNTERS
from reviewlake.plans.review import Responder, Settings, mock_responder, review
from reviewlake.plans.storage import stored
from reviewlake.sources.settings import mode, request_problems

# The longest title and address of a request.
MOST_TITLE, MOST_URL = 300, 500

_current: list[Settings] = []


def settings_of(values: Mapping[str, str]) -> Settings:
    """Settings by their names in capitals; what isn't there or no number keeps its default."""
    given = {}
    for f in fields(Settings):
        raw = values.get(f.name.upper(), "").strip()
        try:
            given[f.name] = int(raw) if isinstance(f.default, int) else raw.lower() or f.default
        except ValueError:
            given[f.name] = f.default
    return Settings(**given)


def current_settings(reload: bool = False) -> Settings:
    """The environment's settings, read once until asked to reload."""
    if reload or not _current:
        _current[:] = [settings_of(os.environ)]
    return _current[0]


def answer(requests: DataFrame, live: Responder | None = None, settings: Settings = Settings(), conventions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, refusals) of requests(request_id, diff, pr_title, pr_url, mode, mock,
    use_llm, retrieval_backend), request_id a string of its own.

    refusals(request_id, problem) have a row a problem and no answer.  answers
    (request_id, mode, pr_title, pr_url, findings, stats, errors) have a row for each
    other request.  Null titles and addresses are empty; a null backend is the
    settings'.  There are at most seven kinds of request, a plan each.
    """
    problems = request_problems(requests).unionByName(requests.select("request_id", F.explode(F.array_compact(F.array(
        F.when(F.length("pr_title") > MOST_TITLE, "pr_title is too long"),
        F.when(F.length("pr_url") > MOST_URL, "pr_url is too long"),
    ))).alias("problem")))
    way = mode(F.col("mock"), F.col("use_llm"), F.col("mode"))
    if live is None:
        problems = problems.unionByName(requests.filter(way == "live").select("request_id", F.lit("live needs a responder").alias("problem")))
    problems = stored(problems)
    kept = requests.join(problems, "request_id", "left_anti").withColumn("way", way)
    backend = F.when(F.col("way") == "rules", "").otherwise(F.coalesce("retrieval_backend", F.lit(settings.retrieval_backend)))
    kept = stored(kept.select(F.col("request_id").cast("string").alias("diff_id"), F.col("diff").alias("diff_text"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("pr_title", "pr_url")), "way", backend.alias("backend")))
    out = None
    for kind in kept.select("way", "backend").distinct().orderBy("way", "backend").collect():  # seven rows at most
        responder = {"rules": None, "mock": mock_responder, "live": live}[kind["way"]]
        own = Settings(**{f.name: getattr(settings, f.name) for f in fields(Settings)} | ({"retrieval_backend": kind["backend"]} if kind["backend"] else {}))
        asked = kept.filter((F.col("way") == kind["way"]) & (F.col("backend") == kind["backend"])).drop("way", "backend")
        rows = review(asked, own, responder=responder, conventions=conventions).bundled()
        stats = F.struct(*COUNTERS, "total_tokens", F.lit(kind["way"]).alias("mode"))
        each = rows.select(F.col("diff_id").alias("request_id"), F.lit(kind["way"]).alias("mode"), "pr_title", "pr_url", "findings", stats.alias("stats"), "errors")
        out = each if out is None else out.unionByName(each)
    if out is None:
        empty = review(kept.drop("way", "backend"), settings).bundled()
        out = empty.select(F.col("diff_id").alias("request_id"), F.lit("rules").alias("mode"), "pr_title", "pr_url", "findings", F.struct(*COUNTERS, "total_tokens", F.lit("rules").alias("mode")).alias("stats"), "errors")
    return out, problems
