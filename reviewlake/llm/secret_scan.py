"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Finding.  Every pattern is applied to the whole text: its matches are set between
marks of a private-use character, the text is split there, and the lengths of the
pieces give offsets in code points.  (A text that holds the mark itself has it
replaced by another non-ASCII character first, which moves nothing.)

Ownership.  The hashes of all candidate values are counted over the corpus by
distinct repositories and owners.  A value that many owners have in many
repositories is a widely copied example; any other is live-looking.  Besides the
three base kinds there is a loose one, `owned`: long runs of mixed letters and
digits, too common a shape to report by itself; they count only if exactly one
owner has the value and no base span overlaps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, small_side, stored, text_or_empty

#: The kinds in their order, their patterns, the group that holds
#: the value, and the least length of that group.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # a run is maximal, so its least length may stand in the pattern
)
OWNED = ("owned", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", 0, 20)
MIXED = (r"[a-z]", r"[A-Z]", r"[0-9]")
MARK = "\ue000"
BLOCK = 64


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _starts(lengths: Column) -> Column:
    """Sums of all lengths before each; by blocks, so that a text with very many
    matches doesn't cost their square."""

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda a, b: a + b)

    def by_block(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(n, b * BLOCK + 1, F.lit(BLOCK))))
        return let(
            blocks,
            lambda s: let(
                F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))),
                lambda before: F.transform(n, lambda _, i: before[F.floor(i / BLOCK).cast("int")] + total(F.slice(n, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))),
            ),
        )

    return let(lengths, by_block)


def _found(text: Column, k: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, k, end, kind, value>> of one kind."""
    none = F.array().cast("array<struct<start:int,k:int,end:int,kind:string,value:string>>")

    def spans(marked: Column) -> Column:
        return let(
            F.split(marked, MARK, -1),
            lambda pieces: let(
                _starts(F.transform(pieces, F.length)),
                lambda starts: F.filter(
                    F.transform(
                        F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)),
                        lambda i: F.struct(
                            starts[i].alias("start"),
                            F.lit(k).alias("k"),
                            (starts[i] + F.length(pieces[i])).alias("end"),
                            F.lit(kind).alias("kind"),
                            (F.regexp_extract(pieces[i], pattern, group) if group else pieces[i]).alias("value"),
                        ),
                    ),
                    lambda x: F.length(x["value"]) >= least,
                ),
            ),
        )

    return let(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), lambda m: F.when(F.contains(m, F.lit(MARK)), spans(m)).otherwise(none))


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `base` and `loose`, arrays of spans, to df."""
    body = text_or_empty(text)
    df = df.withColumn("_body", F.when(F.contains(body, F.lit(MARK)), F.translate(body, MARK, "\ufffd")).otherwise(body))
    df = df.withColumn("base", F.concat(*(_found(F.col("_body"), k, *kind) for k, kind in enumerate(KINDS))))
    loose = F.filter(_found(F.col("_body"), len(KINDS), *OWNED), lambda x: x["value"].rlike(MIXED[0]) & x["value"].rlike(MIXED[1]) & x["value"].rlike(MIXED[2]))
    df = df.withColumn("_loose", loose)
    clear = F.filter("_loose", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return df.withColumn("loose", clear).drop("_body", "_loose")


def ownership(found: DataFrame) -> DataFrame:
    """(h, n_owners, n_repos) of all candidate values in found(h, owner, repo).

    Rows are made distinct before any value is counted, and counted by owner
    before the owners are, so a value that a third of all rows hold is summed
    up by each task that reads it.  A repository belongs to an owner; null
    owners and repositories count as one each.
    """
    each = found.select("h", "owner", "repo").distinct().groupBy("h", "owner").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("h").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repos"))


def secret_scan(df: DataFrame, text: str = "text", owner: str = "source", repo: str = "doc_id", example_owners: int = 3, example_repos: int = 5) -> DataFrame:
    """Every row of df, without its text, with what was found in it.

    Adds spans (array<struct<start, k, end, kind, value, n_owners, n_repos,
    example>>, by start and kind; offsets in code points, end exclusive).
    A value is an example if at least `example_owners` owners have it in at
    least `example_repos` repositories.  A null or empty text has no spans;
    repeated rows are each kept and count as one repository; an empty table
    gives an empty result.
    """
    small = candidates(df, text).drop(text).withColumn("_rid", F.monotonically_increasing_id())
    small = stored(small.withColumn("_owner", F.col(owner)).withColumn("_repo", F.col(repo)))
    bare = (F.size("base") + F.size("loose")) == 0
    kept = [c for c in small.columns if c not in ("base", "loose", "_rid", "_owner", "_repo")]
    each = small.filter(~bare).select("_rid", F.col("_owner").alias("owner"), F.col("_repo").alias("repo"), F.explode(F.concat("base", "loose")).alias("x")).withColumn("h", F.sha2(F.col("x.value"), 256))
    example = (F.col("n_owners") >= example_owners) & (F.col("n_repos") >= example_repos)
    judged = each.join(ownership(each), "h").filter((F.col("x.k") < len(KINDS)) | (F.col("n_owners") == 1))
    whole = F.struct("x.start", "x.k", "x.end", "x.kind", "x.value", "n_owners", "n_repos", example.alias("example"))
    spans = judged.groupBy("_rid").agg(F.array_sort(F.collect_list(whole)).alias("spans"))
    empty = F.array().cast(spans.schema["spans"].dataType)
    out = small.filter(~bare).join(spans, "_rid", "left").select(*kept, F.coalesce("spans", empty).alias("spans"))
    return out.unionByName(small.filter(bare).select(*kept, empty.alias("spans")))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of_kind(k: int):
    return lambda x: x["k"] == k


def digest(found: DataFrame) -> DataFrame:
    """The result of secret_scan, its spans as counts, a hash and a string."""
    base = F.filter("spans", lambda x: x["k"] < len(KINDS))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{kind[0]}") for k, kind in enumerate(KINDS)]
    sha = F.sha2(listed(base).cast("binary"), 256)
    n_example = F.size(F.filter("spans", lambda x: x["example"])).cast("long")
    return found.select("doc_id", *counts, sha.alias("base_sha256"), listed(F.col("spans")).alias("spans"), (F.size("spans") - n_example).cast("long").alias("n_live"), n_example.alias("n_example"))


def redact(text: Column, spans: Column) -> Column:
    """text with each stretch of overlapping spans replaced by one placeholder."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("[REDACTED]"))
        # A span that begins exactly where the last one ended is a new one, except at offset 0 where nothing ended.
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact_live(df: DataFrame, text: str = "text", broadcast_rows: int = 200_000, **options) -> DataFrame:
    """df with all spans of live-looking secrets redacted; rows and columns stay,
    n_chars (if there is one) is counted again for the rows that change."""
    key = F.xxhash64(F.col("doc_id"), F.col(text))
    found = secret_scan(df.select("doc_id", "source", text, key.alias("_key")), text, **options)
    live = found.select("_key", F.transform(F.filter("spans", lambda x: ~x["example"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("_live")).filter(F.size("_live") > 0).dropDuplicates(["_key"])
    # Few rows change; they go to the texts where they fit a broadcast, else the texts are shuffled.
    live = small_side(stored(live), broadcast_rows)
    hit = F.col("_live").isNotNull()
    old = F.col("row").getField(text)
    out = packed(df, _key=key).join(live, "_key", "left").withColumn("_new", F.when(hit, redact(old, F.col("_live"))).otherwise(old))
    size = lambda c: F.when(hit, F.length("_new")).otherwise(c).cast(df.schema["n_chars"].dataType)
    own = {c: F.col("row").getField(c) for c in df.columns}
    return out.select(*(F.col("_new").alias(c) if c == text else size(x).alias(c) if c == "n_chars" else x.alias(c) for c, x in own.items()))


def _scan_sql() -> str:
    """The twin of digest(secret_scan(documents)) with its default options."""
    mark = "chr(57344)"
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = [*KINDS, (OWNED[0], OWNED[1].split(")", 1)[1], *OWNED[2:])]  # a run is maximal without its look-behind
    cuts = " UNION ALL ".join(f"SELECT rid, {k} AS k, {quoted(kind)} AS kind, {group} AS grp, {least} AS least, {quoted(rx)} AS rx, string_split(regexp_replace(t, {quoted(rx)}, {mark} || '\\0' || {mark}, 'g'), {mark}) AS p FROM d" for k, (kind, rx, group, least) in enumerate(kinds))
    value = f"CASE WHEN k = 0 THEN regexp_extract(piece, {quoted(KINDS[0][1])}, 2) ELSE piece END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, replace(coalesce(text, ''), {mark}, chr(65533)) AS t FROM documents),
cuts AS ({cuts}),
pieces AS (SELECT rid, k, kind, least, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM cuts WHERE len(p) > 1),
placed AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY rid, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM pieces),
spans AS (SELECT rid, k, kind, a, a + length(piece) AS b, {value} AS v FROM placed WHERE i % 2 = 0 AND length({value}) >= least),
cand AS (SELECT * FROM spans s WHERE k < 3 OR (regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]') AND NOT EXISTS (SELECT 1 FROM spans x WHERE x.rid = s.rid AND x.k < 3 AND x.a < s.b AND s.a < x.b))),
own AS (SELECT v, count(DISTINCT coalesce('=' || source, '')) AS n_owners, count(DISTINCT (coalesce('=' || source, ''), coalesce(doc_id, -1))) AS n_repos FROM cand JOIN d USING (rid) GROUP BY v),
judged AS (SELECT cand.*, n_owners >= 3 AND n_repos >= 5 AS example FROM cand JOIN own USING (v) WHERE k < 3 OR n_owners = 1),
agg AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans, count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example) AS n_example FROM judged GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN agg USING (rid)
"""


SCAN_SQL = _scan_sql()
