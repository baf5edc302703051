"""Model answers: tolerant JSON, and findings coerced field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import let, strip
from reviewlake.operators.gates import sev_rank

TITLE = "Reported by the model"
#: JSON of values that count as nothing.
NOTHING = r"^(null|false|\"\"|\[\]|\{\}|-?0(\.0*)?([eE].*)?)$"


def parsed(text: Column) -> Column:
    """A variant, or null: the text itself, else its fenced blocks in their order,
    else what lies between the outermost brackets, those that open first being
    tried first, as it is and then without trailing commas."""
    return let(strip(F.coalesce(text, F.lit(""))), _cascade)


def _cascade(s: Column) -> Column:
    fences = F.transform(F.regexp_extract_all(s, F.lit(r"```(?:json|JSON)?\s*([\s\S]*?)```"), F.lit(1)), lambda b: F.try_parse_json(strip(b)))

    def span(opener: str, closer: str) -> Column:
        first = F.instr(s, opener)
        last = F.length(s) - F.instr(F.reverse(s), closer) + 1
        return F.when((first > 0) & F.contains(s, F.lit(closer)) & (last > first), F.struct(first.alias("at"), F.substring(s, first, last - first + 1).alias("t")))

    spans = F.array_sort(F.array_compact(F.array(span("[", "]"), span("{", "}"))))
    fixed = lambda t: F.regexp_replace(t, r",\s*([\]}])", "$1")
    tries = F.flatten(F.transform(spans, lambda x: F.array(F.try_parse_json(x["t"]), F.try_parse_json(fixed(x["t"])))))
    first = lambda found: F.get(F.filter(found, lambda v: v.isNotNull() & ~F.is_variant_null(v)), F.lit(0))
    # A later stage runs only where those before it found nothing.
    return F.coalesce(first(F.array(F.try_parse_json(s))), first(fences), first(tries))


def items(payload: Column) -> Column:
    """The objects of a payload: its `findings` unless they are null, empty, zero
    or false, then its `comments`; or a bare list.  What isn't a list has none."""
    empty = F.array().cast("array<variant>")
    listed = lambda v: F.try_variant_get(v, "$", "array<variant>")
    said = lambda v: ~F.coalesce(F.to_json(v), F.lit("null")).rlike(NOTHING)

    def own(p: Column) -> Column:
        findings, comments = (F.try_variant_get(p, f"$.{name}", "variant") for name in ("findings", "comments"))
        named = let(findings, lambda f: F.when(said(f), F.coalesce(listed(f), empty)).otherwise(F.coalesce(listed(comments), empty)))
        return F.filter(F.coalesce(listed(p), named), lambda v: F.schema_of_variant(v).startswith("OBJECT"))

    return let(payload, own)


def _text(item: Column, name: str, most: int, default: str = "") -> Column:
    got = strip(F.coalesce(F.try_variant_get(item, f"$.{name}", "string"), F.lit("")))
    return F.left(F.when(got == "", F.lit(default)).otherwise(got), F.lit(most))


def line_of(item: Column) -> Column:
    """A number, cut to an integer, a string of digits, or a boolean as 1 or 0; else null."""
    raw = F.try_variant_get(item, "$.line", "variant")
    kind = F.schema_of_variant(raw)
    text = strip(F.try_variant_get(item, "$.line", "string"))
    number = F.try_variant_get(item, "$.line", "double")
    return F.when(kind == "STRING", F.when(text.rlike(r"^\d+$"), text.try_cast("int"))).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), number.try_cast("int")).when(kind == "BOOLEAN", F.try_variant_get(item, "$.line", "boolean").cast("int"))


def coerced(answers: DataFrame, shards: DataFrame) -> DataFrame:
    """Findings of answers(diff_id, shard_no, text); the file is the shard's,
    whatever the answer says.  An unreadable answer gives none.
    """
    each = answers.select("diff_id", "shard_no", F.posexplode(items(parsed(F.col("text")))).alias("k", "item"))
    each = each.join(shards.select("diff_id", "shard_no", "file", "line_numbers"), ["diff_id", "shard_no"])
    low = lambda name, default: F.lower(strip(F.coalesce(F.try_variant_get("item", f"$.{name}", "string"), F.lit(default))))
    category = F.when(low("category", "convention").isin("security", "performance", "convention"), low("category", "convention")).otherwise("convention")
    severity = F.when(low("severity", "low").isin("high", "medium", "low", "info"), low("severity", "low")).otherwise("low")
    sure = F.try_variant_get("item", "$.confidence", "string")
    confidence = F.coalesce(F.when(sure == "true", 1.0).when(sure == "false", 0.0).otherwise(sure.try_cast("double")), F.lit(0.5))
    out = each.withColumns({"line": line_of(F.col("item")), "category": category, "severity": severity})
    return out.select(
        "diff_id",
        # After the rules' findings, in order of shard and item.
        F.struct((F.lit(1 << 60) + F.col("shard_no")).cast("long").alias("file_seq"), F.col("k").cast("int").alias("flat_idx"), F.lit(0).alias("rule_ord")).alias("finding_seq"),
        F.concat(F.lit("LLM-"), F.upper(F.left("category", F.lit(3)))).alias("rule_id"),
        _text(F.col("item"), "title", 80, TITLE).alias("title"),
        "category", "severity", sev_rank(F.col("severity")).alias("sev_rank"), "file", "line",
        _text(F.col("item"), "evidence", 240).alias("evidence"),
        _text(F.col("item"), "suggestion", 500).alias("suggestion"),
        F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        F.lit("llm").alias("source"),
        F.coalesce(F.array_contains("line_numbers", F.col("line")), F.lit(False)).alias("anchors_ok"),
    )


def unreadable(answers: DataFrame) -> DataFrame:
    """(diff_id, shard_no, error) of answers without JSON."""
    return answers.filter(parsed(F.col("text")).isNull()).select("diff_id", "shard_no", F.concat(F.lit("no JSON in the answer: "), F.left(F.coalesce("text", F.lit("")), F.lit(200))).alias("error"))
