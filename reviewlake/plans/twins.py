"""SQL twins of the whole review: all rules of the catalog, frames, heuristics, reports.

The twin's engine has no look-around, so the few patterns that look around are
said again without it (`WITHOUT_LOOKAROUND`).  Lines are rows of `code` (o, path,
ext, n, t); all lines of a diff are added, and a diff is one file in one shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from reviewlake.functions import catalog
from reviewlake.operators import report, semantics, shards

#: The stand-in's answer where it has nothing to say.
NOTHING = '{"findings":[]}'
SPACE = "' ' || chr(9) || chr(10) || chr(13)"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@dataclass(frozen=True)
class Said:
    """A pattern as what stands before the match, the match, what follows it, and
    a pattern that no line of a match has."""

    match: str
    before: str = ""
    after: str = ""
    unless: str = ""


#: By rule and number of the pattern.  What `\s*` gives back before a negative
#: look-ahead is a case of its own in SEC104; SEC114's look-ahead never decides,
#: since a letter has to follow; PERF204 begins at the start of a line.
WITHOUT_LOOKAROUND = {
    ("SEC102", 3): Said(r"exec\.(?:Command|CommandLine)\s*\(", before=r"(?:^|[^\w.])"),
    ("SEC104", 0): Said(r"(?:eval|exec)\s*\(\s*", before=r"(?:^|[^\w.])", after=r"""(?:$|[^"'\s]|["']\s*(?:$|[^"'\s])|\s["']\s*["'])"""),
    ("SEC105", 3): Said(r"yaml\.load\s*\([^)]*\)", unless=r"yaml\.load\s*\([^)]*SafeLoader"),
    ("SEC114", 1): Said(r"""jinja2\.Template\s*\(\s*(?:[a-z_]|f["'])"""),
    ("PERF204", 0): Said(r"^[^\n]*\.(?:all|findall|find_all|getall|toList)\s*\(\s*\)\s*\)?\s*$", unless=r"\b(?:limit|offset|first|take|top|paginate|batch_size|fetchmany|page_size)\b"),
    ("PERF204", 1): Said(r"""^(?:SELECT\s+\*|select\s+\*)\s+FROM\s+\w+\s*["']?\s*\)?\s*$""", unless=r"\b(?:limit|offset|page_size)\b"),
    ("PERF204", 2): Said(r"^[^\n]*\.(?:find|scan)\s*\(\s*\{\s*\}\s*\)\s*$", unless=r"\b(?:limit|batch_size)\b"),
}


def found_sql(comment: str, rules: tuple[catalog.Rule, ...] = catalog.RULES) -> str:
    """CTEs up to `found`: a row for each finding of rules in `code`.  comment is
    the offset of a comment in t; rule_ord sorts findings by line and rule."""
    each = []
    for i, r in enumerate(rules):
        flag = "(?i)" if r.kind != "convention" else ""
        target = "frame" if r.needs_context else "t"
        where = "ext IN (" + ", ".join(map(quoted, r.extensions)) + ")" if r.extensions else "TRUE"
        for alt, rx in enumerate(r.regexes):
            said = WITHOUT_LOOKAROUND.get((r.rule_id, alt), Said(rx))
            whole = quoted(f"{flag}^((?s:.*?){said.before})({said.match}){said.after}")
            unless = f" AND NOT regexp_matches({target}, {quoted(flag + said.unless)})" if said.unless else ""
            each.append(
                f"SELECT o, path, n, t, ext, {target} AS target, {i} AS ord, {alt} AS alt, length(regexp_extract({target}, {whole}, 1)) AS start, regexp_extract({target}, {whole}, 2) AS m FROM framed WHERE {where} AND regexp_matches({target}, {whole}){unless}"
            )
    facts = ", ".join(f"({i}, {quoted(r.rule_id)}, {quoted(r.title)}, {quoted(r.kind)}, {quoted(r.severity)}, CAST({r.confidence} AS DOUBLE), {quoted(r.suggestion)}, {str(r.needs_context).upper()}, {str(r.ignore_comments).upper()})" for i, r in enumerate(rules))
    return (
        "framed AS (SELECT *, string_agg(t, chr(10)) OVER (PARTITION BY o ORDER BY n ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS frame FROM code), "
        f"facts(ord, rule_id, title, category, severity, confidence, suggestion, ctx, guarded) AS (VALUES {facts}), "
        "alts AS (" + " UNION ALL ".join(each) + "), "
        "first_alt AS (SELECT * FROM alts QUALIFY row_number() OVER (PARTITION BY o, n, ord ORDER BY alt) = 1), "
        f"marked AS (SELECT *, {comment} AS c FROM first_alt JOIN facts USING (ord)), "
        "placed AS (SELECT *, CASE WHEN ctx THEN greatest(n - 4, 1) + length(left(target, start)) - length(replace(left(target, start), chr(10), '')) ELSE n END AS line FROM marked WHERE ctx OR NOT guarded OR c IS NULL OR start < c), "
        "once AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY o, ord, line ORDER BY n) = 1), "
        "found AS (SELECT o, path, line AS n, n * 1000 + ord AS rule_ord, rule_id, title, category, severity, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS sev_rank, confidence, "
        f"left(replace(trim(CASE WHEN m = '' THEN t ELSE m END, {SPACE}), chr(10), ' ⏎ '), 240) AS evidence, suggestion FROM once)"
    )


def heuristics_sql() -> str:
    """CTEs up to `heard`: what the heuristics see in the prompt of each diff."""
    head = "## Conventions\n(none given; make no remarks on style)\n\n## Diff\n```\n"
    tail = "\n```\n\nAnswer in JSON now. A line is one of the numbers before the colons above."
    form = quoted(r"^\s*(\d+):\s*([+ -]?)\s?(.*)$")
    each = []
    for i, (title, category, severity, confidence, patterns, veto, suggestion) in enumerate(semantics.HEURISTICS):
        tests = [f"regexp_matches(lower(code), {quoted(rx)})" if kind == "lower" else f"regexp_matches(code, {quoted(('(?i)' if 'i' in kind else '') + rx)})" for kind, rx in patterns]
        tests += ["writes >= 2"] if i == 1 else []
        tests += [f"NOT regexp_matches(near, {quoted('(?i)' + veto)})"] if veto else []
        each.append(f"SELECT o, pos, {i} AS h, no AS n, {quoted(title)} AS title, {quoted(category)} AS category, {quoted(severity)} AS severity, CAST({confidence} AS DOUBLE) AS confidence, left(trim(code, {SPACE}), 200) AS evidence, {quoted(suggestion)} AS suggestion FROM told WHERE " + " AND ".join(tests))
    return (
        f"prompts AS (SELECT o, any_value(path) AS path, count(*) AS added, {quoted(head)} || '### ' || any_value(path) || chr(10) || '@@ -0,0 +1,' || count(*) || ' @@' || chr(10) || string_agg(n || ': +' || t, chr(10) ORDER BY n) || {quoted(tail)} AS prompt FROM code GROUP BY o), "
        "said AS (SELECT o, unnest(string_split(prompt, chr(10))) AS line, generate_subscripts(string_split(prompt, chr(10)), 1) AS pos FROM prompts), "
        f"seen AS (SELECT o, pos, string_agg(line, chr(10)) OVER (PARTITION BY o ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near, CASE WHEN regexp_matches(line, {form}) THEN CAST(regexp_extract(line, {form}, 1) AS INTEGER) END AS no, CASE WHEN regexp_matches(line, {form}) THEN regexp_extract(line, {form}, 3) END AS code FROM said), "
        f"counted AS (SELECT *, count(*) FILTER (regexp_matches(code, {quoted(semantics.WRITES)})) OVER (PARTITION BY o) AS writes FROM seen), "
        f"told AS (SELECT * FROM counted WHERE no IS NOT NULL AND NOT regexp_matches(trim(code, {SPACE}), '^(?:#|//|\\*|/\\*)')), "
        "heard AS (" + " UNION ALL ".join(each) + ")"
    )


def review_sql(cap: int) -> str:
    """CTEs after `found` and `heard` up to `final` (the findings that stay, numbered
    as they are reported) and `bundle` (a row a diff: counters and verdict)."""
    tokens = "CAST(floor(length({0}) / 3.5) + 1 AS BIGINT)"
    item = "to_json({'line': n, 'title': title, 'category': category, 'severity': severity, 'evidence': evidence, 'suggestion': suggestion, 'confidence': confidence})"
    count = ", ".join(f"count(f.o) FILTER (f.severity = '{s}') AS n_{s}" for s in catalog.SEVERITIES)
    return (
        "both_kinds AS (SELECT o, path, n, rule_ord, rule_id, title, category, severity, sev_rank, confidence, evidence, suggestion, FALSE AS llm FROM found UNION ALL "
        "SELECT o, path, n, pos * 1000 + h, 'LLM-' || upper(left(category, 3)), title, category, severity, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, confidence, evidence, suggestion, TRUE FROM heard JOIN prompts USING (o)), "
        "grouped AS (SELECT *, row_number() OVER w AS pick, bool_or(llm) OVER g AND bool_or(NOT llm) OVER g AS corroborated FROM both_kinds WINDOW g AS (PARTITION BY o, path, n, category), w AS (PARTITION BY o, path, n, category ORDER BY llm, confidence DESC, rule_ord)), "
        "merged AS (SELECT * REPLACE (CASE WHEN corroborated THEN least(1.0, confidence + 0.1) ELSE confidence END AS confidence) FROM grouped WHERE pick = 1), "
        f"capped AS (SELECT * FROM merged WHERE sev_rank <= 2 QUALIFY row_number() OVER (PARTITION BY o, path ORDER BY sev_rank, confidence DESC, llm, rule_ord) <= {cap}), "
        "final AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY sev_rank, path, n, llm, rule_ord) AS pos FROM capped), "
        "kinds AS (SELECT o, count(*) FILTER (NOT llm) AS rule_findings, count(*) FILTER (llm) AS llm_findings, count(*) - count(DISTINCT (path, n, category)) AS merged_duplicates FROM both_kinds GROUP BY o), "
        f"""answers AS (SELECT o, '{{"findings":[' || string_agg({item}, ',' ORDER BY pos, h) || ']}}' AS answer FROM heard GROUP BY o), """
        f"cost AS (SELECT o, path, added, {tokens.format(quoted(shards.SYSTEM + chr(10)) + ' || prompt')} AS prompt_tokens, {tokens.format('coalesce(answer, ' + quoted(NOTHING) + ')')} AS completion_tokens FROM prompts LEFT JOIN answers USING (o)), "
        f"sums AS (SELECT p.o, count(f.o) AS total, {count} FROM prompts p LEFT JOIN final f USING (o) GROUP BY p.o), "
        "bundle AS (SELECT o, CAST(o AS VARCHAR) AS diff_id, 1 AS files, added AS added_lines, 1 AS shards, coalesce(rule_findings, 0) AS rule_findings, coalesce(llm_findings, 0) AS llm_findings, 0 AS dropped_unanchored, coalesce(merged_duplicates, 0) AS merged_duplicates, 1 AS llm_calls, "
        "prompt_tokens, completion_tokens, prompt_tokens + completion_tokens AS total_tokens, sums.* EXCLUDE (o), n_high > 0 AS block FROM cost LEFT JOIN kinds USING (o) JOIN sums USING (o))"
    )


COMMENTS = "SELECT CAST(o AS VARCHAR) AS diff_id, path, n AS line, 'RIGHT' AS side, '**[' || severity || '] ' || title || '**  `' || rule_id || '`' || chr(10) || chr(10) || suggestion || CASE WHEN evidence <> '' THEN chr(10) || chr(10) || '> Evidence: `' || evidence || '`' ELSE '' END AS body FROM final"

FULL = "SELECT diff_id, " + ", ".join(report.COUNTERS) + ", total_tokens, total, block, '' AS errors FROM bundle"

#: A finding's lines on a console.
_SUMMARY = "'[review] ' || CASE WHEN block THEN 'blocked' ELSE 'passed' END || ' | ' || total || ' findings (high ' || n_high || ' / medium ' || n_medium || ' / low ' || n_low || ') | files ' || files || ' / added lines ' || added_lines || ' | calls ' || llm_calls || ' / tokens ' || total_tokens"
_SHOWN = (
    "concat_ws(chr(10), CASE WHEN corroborated THEN '=' ELSE ' ' END || ' [' || rpad(upper(severity), 6, ' ') || '] ' || rpad(rule_id, CAST(greatest(length(rule_id), 9) AS INTEGER), ' ') || ' ' || path || ':' || n, '    ' || title, "
    "CASE WHEN evidence <> '' THEN '    evidence: ' || left(evidence, 100) END, CASE WHEN suggestion <> '' THEN '    advice: ' || left(suggestion, 120) END, '')"
)
LINES = (
    f", shown AS (SELECT o, string_agg({_SHOWN}, chr(10) ORDER BY pos) AS shown FROM final GROUP BY o) "
    f"SELECT diff_id, {_SUMMARY} AS summary, concat_ws(chr(10), '', repeat('=', 72), {_SUMMARY}, repeat('=', 72), coalesce(shown, '  Nothing found.'), repeat('=', 72)) AS console FROM bundle LEFT JOIN shown USING (o)"
)


def markdown_sql(generated_at: str) -> str:
    icon = "CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in report.ICONS.items()) + " END"
    source = "CASE WHEN llm THEN 'llm' ELSE 'rule' END"
    full = (
        f"concat_ws(chr(10), {icon} || ' **[' || upper(severity) || '] ' || title || '**  `' || rule_id || '`', '- At: `' || path || ':' || n || '`', '- Kind: ' || category || ', from: ' || {source} || ', confidence: ' || printf('%.2f', confidence), "
        "CASE WHEN evidence <> '' THEN '- Evidence: `' || left(trim(evidence), 200) || '`' END, CASE WHEN suggestion <> '' THEN '- Advice: ' || trim(suggestion) END)"
    )
    brief = "'- **' || title || '**' || CASE WHEN corroborated THEN ' =' ELSE '' END || ' `' || path || ':' || n || '` (' || severity || ', ' || category || ')' || CASE WHEN suggestion <> '' THEN chr(10) || '  ' || suggestion ELSE '' END"
    record = f"{{'rule_id': rule_id, 'title': title, 'category': category, 'severity': severity, 'file': path, 'line': n, 'evidence': evidence, 'suggestion': suggestion, 'confidence': round(confidence, 3), 'source': {source}, 'actionable': TRUE}}"
    texts = [f"string_agg({full} || chr(10), chr(10) ORDER BY pos) FILTER (category = '{c}') AS {c}_text, count(*) FILTER (category = '{c}') AS {c}_n" for c in catalog.CATEGORIES]
    sections = ", ".join(f"CASE WHEN {c}_n > 0 THEN concat_ws(chr(10), '## {c.capitalize()} (' || {c}_n || ')' || chr(10), {c}_text) END" for c in catalog.CATEGORIES)
    table = ", ".join(f"'| {s} | ' || n_{s} || ' |'" for s in ("high", "medium", "low"))
    process = ", ".join(f"'| {c} | ' || {c} || ' |'" for c in report.COUNTERS)
    md = (
        f"concat_ws(chr(10), '# Review' || chr(10), '## Verdict: ' || CASE WHEN block THEN 'blocked' ELSE 'passed' END || chr(10), '| Severity | Count |', '| --- | --- |', {table}, '| **all** | **' || total || '** |' || chr(10), "
        f"'## Process' || chr(10), '| Counter | Value |', '| --- | --- |', {process}, '', {sections}, CASE WHEN total = 0 THEN '## Nothing found' || chr(10) END)"
    )
    comment = (
        "concat_ws(chr(10), '## Automatic review' || chr(10), CASE WHEN block THEN '> **Severe findings: to be mended before merging.**' ELSE '> Nothing that blocks. What follows may be improved.' END || chr(10), "
        "'high **' || n_high || '**, medium **' || n_medium || '**, low **' || n_low || '**; ' || files || ' files, ' || added_lines || ' added lines' || chr(10), brief, "
        "chr(10) || '<sub>tokens ' || total_tokens || ', rules ' || rule_findings || ', model ' || llm_findings || '</sub>')"
    )
    sums = "{" + ", ".join(f"'{s}': n_{s}" for s in catalog.SEVERITIES) + "}"
    stats = "{" + ", ".join(f"'{c}': {c}" for c in (*report.COUNTERS, "total_tokens")) + "}"
    whole = f"CAST(to_json({{'generated_at': {quoted(generated_at)}, 'pr_title': '', 'pr_url': '', 'verdict': {{'block': block, 'total': total, 'by_severity': {sums}}}, 'stats': {stats}, 'findings': coalesce(records, []), 'errors': CAST([] AS VARCHAR[])}}) AS VARCHAR)"
    return (
        f", texts AS (SELECT o, {', '.join(texts)}, string_agg({brief}, chr(10) ORDER BY pos) AS brief, list({record} ORDER BY pos) AS records FROM final GROUP BY o) "
        f"SELECT diff_id, {md} AS markdown, {comment} AS comment, {whole} AS json FROM bundle LEFT JOIN texts USING (o)"
    )
