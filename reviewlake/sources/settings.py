"""Settings from a file or the environment, decoded tolerantly."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions.text import strip

TRUE = ("1", "true", "yes", "on")
MODES = ("rules", "mock", "live")


def dotenv(text: str) -> dict[str, str]:
    """KEY=value lines; comments, blank lines and `export` are passed over, and a
    value loses one pair of quotes."""
    out = {}
    for raw in text.splitlines():
        line = raw.strip()
        key, sign, value = line.partition("=")
        if not line or line.startswith("#") or not sign:
            continue
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        out[key.removeprefix("export ").strip()] = value
    return out


def load_dotenv(path: str | Path, override: bool = False) -> int:
    """Puts a file's values into the environment; returns how many were new."""
    place = Path(path)
    if not place.exists():
        return 0
    fresh = {k: v for k, v in dotenv(place.read_text(encoding="utf-8")).items() if override or k not in os.environ}
    os.environ.update(fresh)
    return len(fresh)


def as_bool(c: Column, default: bool) -> Column:
    s = F.lower(strip(c))
    return F.when(c.isNull() | (s == ""), default).otherwise(s.isin(*TRUE))


def as_int(c: Column, default: int) -> Column:
    return F.coalesce(strip(c).try_cast("int"), F.lit(default))


def as_float(c: Column, default: float) -> Column:
    return F.coalesce(strip(c).try_cast("double"), F.lit(default))


def mode(mock: Column, use_llm: Column, given: Column) -> Column:
    """One of MODES from two older switches and a newer one.  A switch alone says
    what its user meant; both multiply; without any the newer one holds."""
    return (
        F.when(mock.isNull() & use_llm.isNull(), F.coalesce(given, F.lit("rules")))
        .when(use_llm.isNull(), F.when(mock, "mock").otherwise("live"))
        .when(~use_llm, "rules")
        .when(mock.isNull() | ~mock, "live")
        .otherwise("mock")
    )


def request_problems(requests: DataFrame, most_chars: int = 2_000_000) -> DataFrame:
    """requests(request_id, diff, mode, retrieval_backend) -> (request_id, problem)."""
    checks = F.array_compact(F.array(
        F.when(F.length(F.coalesce("diff", F.lit(""))) == 0, "diff is empty"),
        F.when(F.length("diff") > most_chars, "diff is too long"),
        F.when(~F.coalesce("mode", F.lit("rules")).isin(*MODES), "unknown mode"),
        F.when(~F.coalesce("retrieval_backend", F.lit("bm25")).isin("bm25", "vector", "hybrid"), "unknown retrieval backend"),
    ))
    return requests.select("request_id", F.explode(checks).alias("problem"))


def validated(spark: SparkSession, values: dict[str, str], need_llm: bool = True) -> DataFrame:
    """(problem) rows; none means that the settings can be used."""
    problems = []
    key = values.get("LLM_API_KEY", "")
    if need_llm and values.get("LLM_MOCK", "").lower() not in TRUE and not key:
        problems.append("LLM_API_KEY is missing")
    if key and len(key) < 20:
        problems.append(f"LLM_API_KEY has only {len(key)} characters")
    if not values.get("LLM_BASE_URL", "https://").startswith(("http://", "https://")):
        problems.append("LLM_BASE_URL is no address")
    if values.get("SHARD_MAX_CHARS", "6000").isdigit() and int(values.get("SHARD_MAX_CHARS", "6000")) < 500:
        problems.append("SHARD_MAX_CHARS is below 500")
    return spark.createDataFrame([(p,) for p in problems], "problem string")
